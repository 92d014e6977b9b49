"""Models behind an OpenAI-like server: requests with bounded retries, and answers that a later run goes on from."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Replies after which a request is made again: the server is busy or lost its own.
AGAIN = (408, 425, 429, 500, 502, 503, 504)


class ServerError(Exception):
    pass


class ServerPredictor:
    """A :class:`predict.Predictor`: prompts, or messages as JSON, go to a server, some at a time.

    A request that finds no server, or a busy one, is made again ``retries`` times, after waits that double; what fails
    then, or is refused, is an error of its row. Prompts over the model's length have an empty answer.
    """

    def __init__(self, url: str, model: str, key: str = "", retries: int = 4, wait: float = 0.5, threads: int = 8, timeout: float = 600.0, **options):
        self.url, self.model, self.key = url.rstrip("/"), model, key
        self.retries, self.wait, self.threads, self.timeout, self.options = retries, wait, threads, timeout, options

    def post(self, path: str, body: dict) -> dict:
        data = json.dumps({"model": self.model, **body}).encode()
        request = urllib.request.Request(f"{self.url}{path}", data, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310
                    return json.load(r)
            except urllib.error.HTTPError as e:
                text = e.read().decode(errors="replace")
                if "maximum context length" in text:
                    return {}
                failure = ServerError(f"{e.code}: {text[:300]}")
                if e.code not in AGAIN:
                    raise failure from None
            except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError) as e:
                failure = ServerError(f"no answer: {e}")
            if attempt < self.retries:
                time.sleep(self.wait * 2**attempt)
        raise failure

    @staticmethod
    def messages(prompt: str) -> list[dict]:
        """A JSON list of messages, or else one message of a user."""
        try:
            found = json.loads(prompt)
        except ValueError:
            found = None
        return found if isinstance(found, list) and all(isinstance(m, dict) and "role" in m for m in found) and found else [{"role": "user", "content": prompt}]

    def chat(self, prompt: str, **more) -> dict:
        """The first choice; an answer that is begun is gone on with."""
        said = self.messages(prompt)
        ends = said[-1]["role"] == "assistant"
        got = self.post("/v1/chat/completions", {"messages": said, "n": 1, "add_generation_prompt": not ends, "continue_final_message": ends, **self.options, **more})
        return got["choices"][0] if got else {}

    def each(self, f, prompts: list[str]) -> list:
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(f, prompts))

    def generate(self, prompts: list[str]) -> list[str]:
        return self.each(lambda p: self.chat(p).get("message", {}).get("content") or "", prompts)

    def probabilities(self, prompts: list[str], choices: list[str]) -> list[dict[str, float]]:
        """By the likeliest first tokens, spaces around them left out; what isn't among these has 0."""

        def one(prompt):
            choice = self.chat(prompt, max_tokens=1, logprobs=True, top_logprobs=20)
            first = ((choice.get("logprobs") or {}).get("content") or [{}])[0].get("top_logprobs", [])
            out = dict.fromkeys(choices, 0.0)
            for t in first:
                if (name := t["token"].strip()) in out:
                    out[name] += math.exp(t["logprob"])
            return out

        return self.each(one, prompts)

    def log_probs(self, prompts: list[str]) -> list[list[tuple[int, float, int, int]]]:
        """(id, log-probability, start, end) of a prompt's own tokens; the first has none before it and 0."""

        def one(prompt):
            got = self.post("/v1/completions", {"prompt": prompt, "max_tokens": 1, "echo": True, "logprobs": 1})
            found = got["choices"][0]["logprobs"] if got else {"tokens": [], "token_logprobs": [], "text_offset": []}
            rows = zip(found.get("token_ids") or range(len(found["tokens"])), found["token_logprobs"], found["text_offset"], found["tokens"])
            return [(i, p or 0.0, at, at + len(t)) for i, p, at, t in rows if at < len(prompt)]

        return self.each(one, prompts)


def answers(df: DataFrame, key: str, prompt: str, make, out: str, waves: int = 16) -> DataFrame:
    """Answers of a predictor to each key's prompt, kept in the folder ``out``: (key, pred_text, error).

    Keys go in ``waves`` by hash, each of which is written when it is done; a run that was broken off is gone on with by
    calling it again, which asks for what ``out`` doesn't hold: at most one wave is asked twice. Rows with an error are
    kept and asked again by the next call. A key should be there once; null keys aren't asked.
    """
    from ..operators.predict import generate

    spark, schema = df.sparkSession, f"{key} {df.schema[key].dataType.simpleString()}, pred_text string, error string"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def held():
        return spark.read.schema(schema).parquet(out) if files.exists(path) else spark.createDataFrame([], schema)

    todo = df.filter(F.col(key).isNotNull()).select(key, prompt)
    wave = F.pmod(F.xxhash64(key), F.lit(waves))
    for k in range(waves):
        done = held().filter(F.col("error").isNull() & (wave == k)).select(key)
        rows = todo.filter(wave == k).join(done, key, "left_anti")
        if not rows.isEmpty():
            generate(rows, prompt, make).select(key, "pred_text", "error").write.mode("append").parquet(out)
    best = held().groupBy(key).agg(F.min(F.struct(F.col("error").isNotNull().alias("bad"), "pred_text", "error")).alias("a"))
    return df.join(best.select(key, "a.pred_text", "a.error"), key, "left")

"""Readers of datasets, results and configuration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dataset(spark: SparkSession, path: str, form: str = "parquet", split: str | None = None) -> DataFrame:
    """A dataset, or one split of it where ``split`` is a partition column."""
    df = spark.read.format(form).load(path)
    return df if split is None else df.filter(F.col("split") == split)


def slices(spark: SparkSession, paths: dict[str, str], form: str = "parquet") -> DataFrame:
    """Slices in one read, each row with its slice's name."""
    df = spark.read.format(form).load(list(paths.values())).withColumn("__file", F.input_file_name())
    name = F.coalesce(*[F.when(F.col("__file").contains(p), F.lit(n)) for n, p in paths.items()])
    return df.withColumn("slice", name).drop("__file")


def jsonl(spark: SparkSession, path: str, schema=None, first: int | None = None) -> DataFrame:
    """Lines of JSON; on request the first n, by their places in the files."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.json(path)
    if first is None:
        return df
    # A file's first bytes come first; lines keep their order within a file's blocks, and blocks theirs.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    return lines.orderBy("__f", "__b", "__i").limit(first).select(F.from_json("value", df.schema).alias("d")).select("d.*")


def json_arrays(spark: SparkSession, paths: list[str], schema=None) -> DataFrame:
    """Files with one JSON array each, one after another."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(paths)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Indented JSON documents that follow one another in a file.

    A line with a closing brace alone ends a document; each is cut there and parsed.
    """
    text = spark.read.option("lineSep", "\n}\n").text(path)
    body = F.regexp_replace(F.col("value"), r"\s+$", "")
    whole = F.when(body.rlike(r"\n\}$|^\{.*\}$"), body).otherwise(F.concat(body, F.lit("\n}")))
    return text.filter(F.trim("value") != "").select(F.from_json(whole, schema).alias("d")).select("d.*")


def results(spark: SparkSession, root: str) -> DataFrame:
    """(model, task, leaderboard_result, time) of all ``*_total.jsonl`` below a folder, one or two levels down."""
    schema = "leaderboard_result double, time double, task_name string"
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_total.jsonl").json(root)
    file = F.input_file_name()
    own = raw.withColumn("file", file).withColumn("task", F.regexp_extract("file", r"([^/]+)_total\.jsonl$", 1)).withColumn("model", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    return own.filter(~F.col("file").rlike(r"/\.[^/]+/")).select("model", "task", "leaderboard_result", "time")


def battles(spark: SparkSession, folder: str) -> DataFrame:
    """Battles of all JSON files of a folder, without invalid ones."""
    return spark.read.option("multiLine", True).json(f"{folder}/*.json").filter("outcome <> 'invalid'")


def model_names(battles_: DataFrame) -> DataFrame:
    return battles_.select(F.explode(F.array("model_name", "reference_model_name")).alias("model")).distinct()


def task_configs(path: str) -> list[dict]:
    """Task settings of a YAML file: defaults, then each task's own; max_len is taken for max_prompt_len."""
    import yaml

    spec = yaml.safe_load(open(path, encoding="utf-8")) or {}
    out = []
    for task in spec.get("tasks", []):
        own = {**(spec.get("defaults") or {}), **task}
        own.setdefault("max_prompt_len", own.get("max_len"))
        out.append(own)
    return out


def mapping(path: str) -> dict:
    """Category map, metric map or chat template."""
    return json.load(open(path, encoding="utf-8"))


def first_known(configured: DataFrame, registered: DataFrame, key: str = "task") -> DataFrame:
    """Tasks from configuration, then registered ones that it doesn't name."""
    return configured.unionByName(registered.join(configured, key, "left_anti"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image_url): files as data URLs, their kind told by their first bytes; other files have none."""
    head = F.hex(F.substring("content", 1, 12))
    kind = F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E47"), "png").when(head.startswith("47494638"), "gif").when(head.rlike("^52494646.{8}57454250"), "webp").when(head.startswith("424D"), "bmp")
    url = F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64("content"))
    return spark.read.format("binaryFile").load(path).select("path", url.alias("image_url"))


def model_info(url: str, timeout: float = 10.0) -> dict[str, dict]:
    """Models that an OpenAI-like server lists, by name."""
    import urllib.request

    with urllib.request.urlopen(f"{url.rstrip('/')}/v1/models", timeout=timeout) as r:  # noqa: S310
        return {m["id"]: m for m in json.load(r)["data"]}


class TokenCounter:
    """Token counts of a server's ``/tokenize``; each text is asked for on its own, so one failure doesn't spoil the others."""

    def __init__(self, url: str, model: str, timeout: float = 30.0):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def __call__(self, text: str) -> int | None:
        import urllib.error
        import urllib.request

        body = json.dumps({"model": self.model, "prompt": text}).encode()
        request = urllib.request.Request(f"{self.url}/tokenize", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310
                return int(json.load(r)["count"])
        except (urllib.error.URLError, KeyError, ValueError, OSError):
            return None


def token_counts(df: DataFrame, text: str, url: str, model: str) -> DataFrame:
    """Adds ``tokens``: a server's count, null where it gave none."""
    import pandas as pd

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(TokenCounter(url, model)).astype("Int32")

    return df.withColumn("tokens", count(F.col(text)))

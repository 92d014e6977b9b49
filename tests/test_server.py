"""Servers that fail at times, over local HTTP."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from evalspark.operators import predict
from evalspark.sources import server


@pytest.fixture
def web():
    """(url, counts by prompt, switch): each prompt's first two requests fail; those that start with bad are refused, and
    with ``down`` in the switch, those that end with x find the server failing for good."""
    seen, switch, lock = Counter(), set(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = body["messages"][-1]["content"] if "messages" in body else body["prompt"]
            with lock:
                seen[said] += 1
            if said.startswith("bad"):
                return self.reply(400, {"error": "no"})
            if said.startswith("long"):
                return self.reply(400, {"error": "maximum context length is 5"})
            if seen[said] <= 2 or ("down" in switch and said.endswith("x")):
                return self.reply(503, {"error": "busy"})
            if "messages" not in body:
                tokens = [said[i : i + 2] for i in range(0, len(said), 2)] + ["!"]
                return self.reply(200, {"choices": [{"logprobs": {"tokens": tokens, "token_logprobs": [None] + [-1.5] * (len(tokens) - 1), "text_offset": list(range(0, 2 * len(tokens), 2))}}]})
            top = [{"token": " Yes", "logprob": -0.1}, {"token": "Yes", "logprob": -3.0}, {"token": "so", "logprob": -4.0}]
            self.reply(200, {"choices": [{"message": {"content": f"to {said}"}, "logprobs": {"content": [{"top_logprobs": top}]}}]})

        def reply(self, code, body):
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen, switch
    http.shutdown()


def test_busy_servers_are_asked_again(spark, web):
    url, seen, _ = web
    make = lambda: server.ServerPredictor(url, "m", retries=3, wait=0.01)
    df = spark.createDataFrame([(1, "one"), (2, "bad two"), (3, "long three"), (4, json.dumps([{"role": "user", "content": "u"}, {"role": "assistant", "content": "begun"}]))], "id int, prompt string")
    got = {r.id: (r.pred_text, r.error) for r in predict.generate(df, "prompt", make).collect()}
    assert got[1] == ("to one", None) and got[3] == ("", None) and got[4] == ("to begun", None)
    assert got[2][0] == "" and got[2][1].startswith("400") and seen["one"] >= 3 and seen["bad two"] <= 3
    few = server.ServerPredictor(url, "m", retries=1, wait=0.01)
    with pytest.raises(server.ServerError, match="503"):
        few.generate(["another"])
    assert seen["another"] == 2
    with pytest.raises(server.ServerError, match="no answer"):
        server.ServerPredictor("http://127.0.0.1:9", "m", retries=1, wait=0.01).generate(["x"])


def test_probabilities_of_a_server(web):
    url, _, _ = web
    model = server.ServerPredictor(url, "m", retries=3, wait=0.01)
    (p,) = model.probabilities(["q"], ["Yes", "No"])
    assert p["No"] == 0 and p["Yes"] == pytest.approx(0.9548, abs=1e-3)
    assert model.log_probs(["abcde"]) == [[(0, 0.0, 0, 2), (1, -1.5, 2, 4), (2, -1.5, 4, 5)]]


def test_answers_go_on_from_what_is_written(spark, web, tmp_path):
    url, seen, switch = web
    make = lambda: server.ServerPredictor(url, "m", retries=3, wait=0.01)
    df = spark.createDataFrame([(i, f"p{i}" + "x" * (i % 2)) for i in range(12)] + [(None, "none")], "id int, prompt string")
    switch.add("down")
    first = {r.id: r for r in server.answers(df, "id", "prompt", make, str(tmp_path / "out"), waves=3).collect()}
    assert all((first[i].error is None) == (i % 2 == 0) for i in range(12)) and first[None].pred_text is None
    switch.clear()
    asked = dict(seen)
    second = {r.id: r for r in server.answers(df, "id", "prompt", make, str(tmp_path / "out"), waves=3).collect()}
    assert all(second[i].pred_text == "to " + second[i].prompt and second[i].error is None for i in range(12))
    assert all(seen[f"p{i}"] == asked[f"p{i}"] for i in range(0, 12, 2)) and "none" not in seen

"""Providers, the answer pipeline and the command line."""

import hashlib
import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexmill import cli
from lexmill.functions import providers
from lexmill.operators import answering, vectors
from lexmill.params import Params

DIR = "/root/testdata/sf0.001"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


class Fixed:
    def __init__(self, said, fail=()):
        self.said, self.fail = said, list(fail)

    def embed(self, texts):
        return providers.DevProvider().embed(texts)

    def stream(self, messages):
        for piece in self.said:
            yield piece
        if self.fail:
            raise RuntimeError(self.fail.pop(0))

    def diagnose(self):
        return "fixed"


def test_budget_and_retry():
    closed = []

    def endless():
        try:
            while True:
                yield "abc " * 10
        finally:
            closed.append(1)

    assert len(providers.budgeted(endless(), Params(answer_chars=100, loop_times=99))) == 120 and closed == [1]
    assert len(providers.budgeted(endless(), Params(answer_chars=10**6))) < 400
    ticks = iter(range(0, 1000, 30))
    assert providers.budgeted(iter(["a", "b", "c", "d"]), clock=lambda: next(ticks)) == "abc"
    assert providers.ask(Fixed(["ok"], ["Cancelled"]), []) == "ok"
    assert providers.ask(Fixed(["x" * 130], ["boom"]), []).endswith("[incomplete: boom]")
    with pytest.raises(RuntimeError, match="boom"):
        providers.ask(Fixed(["x"], ["boom"]), [])


def test_choice():
    assert providers.choose([("absent", {}), ("http", {"base": "http://127.0.0.1:9"}), ("dev", {})]).diagnose().startswith("development")
    with pytest.raises(RuntimeError, match="absent"):
        providers.choose([("absent", {})])


def test_http_provider():
    class Handler(BaseHTTPRequestHandler):
        def _send(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self._send({"data": [{"id": "m"}]})

        def do_POST(self):
            got = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "input" in got:
                self._send({"data": [{"index": k, "embedding": [float(k)]} for k in reversed(range(len(got["input"])))]})
            else:
                self._send({"choices": [{"message": {"content": got["messages"][-1]["content"].upper()}}]})

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    p = providers.HttpProvider(f"http://127.0.0.1:{server.server_port}")
    assert p.diagnose() == "models: m" and p.embed(["a", "b"]) == [[0.0], [1.0]]
    assert providers.ask(p, [{"role": "user", "content": "hi"}]) == "HI"
    server.shutdown()


def test_http_provider_finds_server_and_models():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": [{"id": "big-embed-1"}, {"id": "talker-4b"}, {"id": "talker-9b"}]}).encode())

        def do_POST(self):
            got = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(got["model"])
            self.send_response(500 if got["model"] == "talker-9b" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": [{"index": 0, "embedding": [1.0]}], "choices": [{"message": {"content": "yes"}}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    found = f"http://127.0.0.1:1, http://127.0.0.1:{server.server_port}/v1"
    p = providers.HttpProvider(found)
    assert not asked  # nothing is asked before it is needed
    assert p.embed(["a"]) == [[1.0]] and providers.ask(p, [{"role": "user", "content": "hi"}]) == "yes" and providers.ask(p, [{"role": "user", "content": "hi"}]) == "yes"
    assert asked.count("/v1/models") == 2 and asked[2:] == ["big-embed-1", "talker-4b", "talker-4b"]
    with pytest.raises(OSError, match="500"):
        providers.ask(providers.HttpProvider(found, chat_model="talker-9"), [{"role": "user", "content": "hi"}])
    with pytest.raises(ValueError, match="no model absent"):
        providers.HttpProvider(found, chat_model="absent").model("absent", False)
    server.shutdown()
    with pytest.raises(OSError, match="no server"):
        providers.HttpProvider("http://127.0.0.1:1").base


def test_answer_pipeline(spark):
    asked = spark.createDataFrame([(1, "kira?"), (2, "other?"), (3, "nothing?")], "qid long, text string")
    corpus = spark.createDataFrame([(10, "ABC m. 1", "I. Kira", "text one"), (11, "ABC m. 2 (1/2)", "", "text two")], "doc_id long, label string, heading string, content string")
    results = spark.createDataFrame([(1, 10, 1, True, True), (1, 11, 2, True, True), (2, 10, 1, False, True)], "qid long, doc_id long, rank int, relevant boolean, in_context boolean")
    run = lambda said: {r.qid: r for r in answering.answer(asked, results, corpus, lambda: Fixed([said])).collect()}
    got = run("<think>hm</think>DAYANAK: [ABC m. 2]\nCEVAP: Evet.")
    assert got[1].answer == "Evet.\n\nDAYANAK: [ABC m. 2]" and got[1].trusted and got[1].sources == ["ABC m. 1 — I. Kira", "ABC m. 2 (1/2)"]
    assert not got[2].trusted and got[3].shown == []
    got = run("Evet, on yıl.")
    assert got[1].auto_cited and got[1].trusted and got[1].citations == ["ABC m. 1", "ABC m. 2"]
    got = run("Bağlamda yok.")
    assert all(r.trusted and r.unknown for r in got.values())
    got = run("Bkz. [ABC m. 9].")
    assert got[1].unsupported == ["ABC M. 9"] and not got[1].trusted
    raw = spark.createDataFrame([(1, "Evet.", ["ABC'ya işlenemeyen hüküm — m. 5"], True)], "qid long, raw string, shown array<string>, in_scope boolean")
    r = answering.finish(raw).first()
    assert r.auto_cited and r.trusted and r.citations == ["ABC'ya işlenemeyen hüküm — m. 5"] and not r.unsupported
    failed = answering.generate(spark.createDataFrame([(1, [("user", "x")])], "qid long, messages array<struct<role:string,content:string>>"), lambda: Fixed([], ["down", "down"])).first()
    assert failed.error == "down" and failed.raw == ""


def test_embed(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: r.vec for r in answering.embed(df, F.col("text"), providers.DevProvider, "doc_id").collect()}
    assert len(got) == 41 and abs(sum(x * x for x in got[3]) - 1) < 1e-5

    class Short(providers.DevProvider):
        def embed(self, texts):
            return []

    with pytest.raises(Exception, match="vectors for"):
        answering.embed(df, F.col("text"), Short, "doc_id").collect()


def test_command_line(spark, capsys, monkeypatch, tmp_path):
    run = lambda *a: cli.main(["--data", DIR, *a])
    assert run("article", "7") == 0 and run("article", "none") == 1
    assert run("search", "madde 7 the ering") == 0
    assert "SRC7 m. 7" in capsys.readouterr().out
    assert run("ask", "madde 7") == 0 and "sources:" in capsys.readouterr().out
    vec = str(tmp_path / "vec")
    assert run("--vectors", vec, "ask", "madde 7") == 0 and "out of scope" not in capsys.readouterr().out
    assert run("--vectors", vec, "search", "madde 7 the ering") == 0 and "vector" in capsys.readouterr().out
    # nothing in the corpus is like this question, so it is refused, by the vectors written before
    assert run("--vectors", vec, "ask", "zzxq wqqk vvvj 0xqz") == 0 and "out of scope" in capsys.readouterr().out
    assert run("diagnose") == 0 and run("health") == 0
    with pytest.raises(RuntimeError, match="no provider"):
        run("--provider", "http", "--url", "http://127.0.0.1:1", "diagnose")
    assert run("--provider", "http,dev", "--url", "http://127.0.0.1:1", "diagnose") == 0
    monkeypatch.setattr("sys.stdin", iter(["madde 3\n", "exit\n"]))
    assert run("chat") == 0
    assert run("ingest", str(tmp_path / "out"), str(tmp_path / "mark")) == 0 and spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_hash_embedding_is_the_development_provider(spark):
    texts = [(1, "Kira sözleşmesi, İHBAR süresi"), (2, ""), (3, None), (4, "ab"), (5, "ÇĞİÖŞÜ âîû Straße x" * 30), (6, "--")]
    df = spark.createDataFrame(texts, "item_id long, text string")
    want = providers.DevProvider().embed([t or "" for _, t in texts])
    got = {}
    for r in vectors.hash_embedding(df, F.col("text"), "item_id").collect():
        got.setdefault(r.item_id, {})[r.dim] = r.weight
    for (i, _), v in zip(texts, want):
        assert got[i] == {d: round(x, 6) for d, x in enumerate(v) if x}
    # fixed value: the digest of "abc" cut to four bytes
    assert providers.bucket("abc") == int(hashlib.blake2b(b"abc", digest_size=4).hexdigest(), 16) % 512


def test_semi_delete_leaves_and_deletes(spark):
    from lexmill.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    every = {r.source for r in spark.read.parquet(f"{d}/documents.parquet").select("source").distinct().collect()}
    left = {r.source for r in QUERIES["semi_delete"](spark, d).collect()}
    assert left and left < every

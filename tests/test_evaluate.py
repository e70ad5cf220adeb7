"""Question files, the evaluation report, payloads through a cache, and queries whose rows must hold the rare cases."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill import cli
from lexmill.functions import providers
from lexmill.operators import evaluation
from lexmill.plans.queries import QUERIES
from lexmill.sources import store

DIR = "/root/testdata/sf0.001"
QUESTIONS = [
    {"id": "q1", "question": "madde 7", "kind": "answerable", "expected": ["7"]},
    {"id": "q2", "question": "madde 9", "kind": "answerable", "expected": ["no such article"]},
    {"id": "q3", "question": "zzxq wqqk vvvj 0xqz", "kind": "out_of_scope"},
    {"id": "q4", "question": None},
]


def test_question_file_to_report(spark, tmp_path, capsys):
    path = tmp_path / "questions.json"
    path.write_text(json.dumps(QUESTIONS))
    assert cli.main(["--data", DIR, "evaluate", str(path), str(tmp_path / "out"), "--answers"]) == 0
    said = capsys.readouterr().out
    summary = spark.read.json(str(tmp_path / "out/summary")).first()
    assert (summary.questions, summary.answerable, summary.out_of_scope) == (4, 3, 1) and summary.hit_at_1 == 33.3 and summary.missed_ids == ["q2", "q4"]
    assert summary.gate_out_of_scope == 100.0 and summary.gate_answerable == 66.7 and summary.errors == 0 and summary.median_ms >= 0 and "hit_at_1: 33.3" in said
    rows = {r.id: r for r in spark.read.json(str(tmp_path / "out/questions")).collect()}
    assert rows["q1"].first_hit == 1 and "7" in rows["q1"].retrieved and rows["q1"].cited_expected is False and rows["q3"].relevant is False and rows["q3"].refused is not None


def test_questions_by_line(spark, tmp_path):
    path = tmp_path / "questions.jsonl"
    path.write_text("\n".join(json.dumps(q) for q in QUESTIONS))
    assert [r.id for r in store.read_questions(spark, str(path)).orderBy("id").collect()] == ["q1", "q2", "q3", "q4"]


def test_failed_questions_are_counted(spark):
    schema = "id string, answerable boolean, first_hit int, relevant boolean, cited_expected boolean, unsupported array<string>, refused boolean, success boolean, auto_cited boolean, error string, generation_ms double"
    rows = [("a", True, 1, True, True, [], None, True, True, "", 10.0), ("b", True, None, True, False, ["X"], None, False, False, "", 30.0), ("c", True, 3, False, None, [], None, None, False, "down", 0.0), ("d", False, None, False, None, [], True, True, False, "", 20.0), ("e", False, None, True, None, [], False, False, False, "", 40.0)]
    df = spark.createDataFrame(rows, schema)
    hits = df.withColumns({**{f"hit{n}": F.coalesce(F.col("first_hit") <= n, F.lit(False)) for n in (1, 3, 5)}, "rr": F.coalesce(1 / F.col("first_hit"), F.lit(0.0))})
    r = evaluation.report(hits)
    got = r.first().asDict()
    want = {"questions": 5, "answerable": 3, "out_of_scope": 2, "hit_at_1": 33.3, "hit_at_3": 66.7, "hit_at_5": 66.7, "mrr": 0.4444, "missed": 1, "gate_answerable": 66.7, "gate_out_of_scope": 50.0, "missed_ids": ["b"]}
    want |= {"cited_expected": 33.3, "with_unsupported": 1, "refused": 50.0, "success": 40.0, "errors": 1, "auto_cited": 1, "mean_ms": 25.0, "median_ms": 20.0}
    assert got == want
    empty = evaluation.report(hits.limit(0)).first()
    assert empty.questions == 0 and empty.hit_at_1 == 0.0 and empty.missed_ids == []


def test_payloads_through_a_cache(spark, tmp_path):
    src, cache = tmp_path / "src", str(tmp_path / "cache")
    src.mkdir()
    good = lambda x: f"<p>MADDE 1 {x}</p>".encode() + b" " * 100
    files = {"a.htm": good("one"), "b.htm": b"<p>login please</p>" + b" " * 100, "c.htm": good("three")}

    def put(more):
        for name, content in more.items():
            (src / name).write_bytes(content)

    def run(force=False):
        rows = spark.read.format("binaryFile").load(str(src)).select("path", "content")
        return {r.name: (bytes(r.content).strip() if r.content else None, r.reason) for r in store.admitted(rows, cache, 50, "madde", force).collect()}

    put(files)
    first = run()
    assert first["a.htm"] == (good("one").strip(), None) and first["b.htm"] == (None, "no marker")
    put({"a.htm": good("new"), "c.htm": b"short", "b.htm": good("two")})
    assert run() == {"a.htm": (good("one").strip(), None), "b.htm": (good("two").strip(), None), "c.htm": (good("three").strip(), None)}
    forced = run(force=True)
    assert forced["a.htm"] == (good("new").strip(), None) and forced["c.htm"] == (good("three").strip(), "short")  # a refused payload keeps the cached one
    assert spark.read.parquet(cache).count() == 3 and run() == {k: (v[0], None) for k, v in forced.items()}


def test_source_urls(spark):
    df = spark.createDataFrame([(1, 5, 6098)], "kind int, edition int, number int")
    assert df.select(store.source_url("https://x.test/d").alias("u")).first().u == "https://x.test/d/1.5.6098.htm"


def test_rare_cases_occur_in_the_queries(spark):
    d = "/root/testdata/sf0.01"
    outline = QUERIES["outline_articles"](spark, d)
    kinds = {(r.kind, r.note != ""): r["count"] for r in outline.groupBy("kind", "note").count().collect()}
    assert all(kinds.get((k, o), 0) > 0 for k in ("madde", "gecici", "ek") for o in (True, False))
    # no block after a document's end: articles of table-ended documents come from the first 40 lines
    ended = outline.where("source_id % 5 = 2 and kind = 'madde'").agg(F.max(F.col("article_no").cast("int"))).first()[0]
    assert 30 < ended <= 40
    meta = {r[0]: r[1] for r in QUERIES["header_meta"](spark, d).groupBy((F.col("gazette") != "").alias("found")).count().collect()}
    assert meta[True] > 20 and meta[False] > 20
    plain, marked = (QUERIES[q](spark, d).orderBy("page_id").collect() for q in ("page_text", "page_notes"))
    assert [r.text for r in plain] == [r.text for r in marked]  # all marks are gone again


def test_provider_fall_through():
    with pytest.raises(RuntimeError, match="nosuch"):
        providers.choose([("nosuch", {})])


def test_pieces_of_a_long_article(spark):
    rows = spark.range(30_000).select(F.lit("law").alias("source"), F.lit(1).alias("article_no"), F.col("id").alias("part_no"), F.format_string("part %06d", "id").alias("content"))
    got = evaluation.reassemble_pieces(rows.repartition(5), "source", "article_no", size=50_000).orderBy("piece").collect()
    assert len(got) == 8 and max(len(r.text) for r in got) <= 50_000 + 12 and "\n".join(r.text for r in got) == "\n".join(f"part {k:06d}" for k in range(30_000))

"""Jobs: incremental over growing input, safe to run again, command line; and the library parts that they are made of."""

import json
import os

import pytest
from compare import difference
from pyspark.sql import functions as F

from jobs import audit_corpus, queries, refresh_corpus
from jobs.config import options
from lexmill.functions.html import page_blocks
from lexmill.operators import bounded, evaluation
from lexmill.streaming import ingest

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def held(spark, out):
    return sorted((r.doc_id, r.law, r.part_no, r.chunk) for r in refresh_corpus.read_corpus(spark, out).collect())


def test_refresh_takes_only_what_is_new(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "source")
    docs.where("doc_id % 2 = 0").write.mode("append").parquet(f"{src}/first")
    one = refresh_corpus.run(spark, src, out, mark)
    files = sorted(f for d, _, names in os.walk(out) for f in names)
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(f"{src}/second")
    two = refresh_corpus.run(spark, src, out, mark)
    assert one["read"] == docs.where("doc_id % 2 = 0").count() and two["read"] == docs.where("doc_id % 2 = 1").count()
    assert set(files) <= {f for d, _, names in os.walk(out) for f in names}  # nothing written before was touched
    before = held(spark, out)
    assert refresh_corpus.run(spark, src, out, mark) == {"read": 0, "written": 0, "batches": 0} and held(spark, out) == before
    whole = str(tmp_path / "whole")
    refresh_corpus.run(spark, src, whole, str(tmp_path / "mark2"))
    assert held(spark, whole) == before


def test_a_document_that_comes_again_replaces_its_version(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    long = "\n".join(["sentence one. " * 100] * 4)
    put(spark, src, [(1, "old text", "a"), (2, "stays", "a"), (3, long, "b"), (None, "no id", None), (None, "no id either", "a")], "x")
    refresh_corpus.run(spark, src, out, mark)
    put(spark, src, [(1, "new text", "b"), (3, None, "b"), (4, "", "c"), (None, "a third", "a")], "y")
    refresh_corpus.run(spark, src, out, mark)
    got = refresh_corpus.read_corpus(spark, out).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.law, r.chunk))
    assert by[1] == [("B", "new text")] and by[2] == [("A", "stays")] and by[3] == [("B", "")] and by[4] == [("C", "")]
    assert sorted(x for _, x in by[None]) == ["a third", "no id", "no id either"] and len(got) == 7


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, src, [(k, f"text {k}", "ab"[k % 2]) for k in range(20)], "x")
    refresh_corpus.run(spark, src, out, mark)
    before = held(spark, out)
    commits = [f for f in os.listdir(f"{mark}/commits") if not f.startswith(".")]
    for f in commits:  # as if the run had been cut off before its commit
        os.remove(f"{mark}/commits/{f}")
        if os.path.exists(f"{mark}/commits/.{f}.crc"):
            os.remove(f"{mark}/commits/.{f}.crc")
    assert refresh_corpus.run(spark, src, out, mark)["batches"] == 1 and held(spark, out) == before and spark.read.parquet(out).count() == 20


def test_small_batches_and_repeated_rows(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, src, [(1, "same", "a"), (1, "same", "a")], "x")
    put(spark, src, [(2, "two", "a")], "y")
    got = refresh_corpus.run(spark, src, out, mark, files_a_batch=1)
    assert got["batches"] == 2 and [(r[0], r[3]) for r in held(spark, out)] == [(1, "same"), (2, "two")]


def test_pages_that_come_again(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    page = lambda rows, name: spark.createDataFrame(rows, ingest.PAGES).coalesce(1).write.parquet(f"{src}/{name}")
    page([(1, "u", "<p>old text</p><p>more</p>"), (2, "u", "<p>two</p>"), (3, "u", "<p>three</p>")], "a")
    ingest.ingest_stream(spark, src, out, mark, "*.parquet").awaitTermination(120)
    page([(1, "u", "<p>new text</p>"), (3, "u", "nothing")], "b")
    for _ in range(2):
        ingest.ingest_stream(spark, src, out, mark, "*.parquet").awaitTermination(120)
    assert sorted((r.page_id, r.pos, r.text) for r in ingest.current_blocks(spark, out).collect()) == [(1, 0, "new text"), (2, 0, "two")]
    want = page_blocks(spark.createDataFrame([(1, "<p>new text</p>"), (2, "<p>two</p>")], "page_id long, html string"))
    assert ingest.current_blocks(spark, out).select(want.columns).exceptAll(want).count() == 0


def test_audit_again_leaves_the_same_report(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "", "a"), (2, None, "a"), (2, "x" * 50, "a"), (7, " (1) and MADDE 3 - so on " * 3, "a"), (None, "short", "a"), (3, "y" * 60, None), (10**12, "z" * 45, "b")]
    put(spark, src, rows, "x")
    for _ in range(2):
        counts = audit_corpus.run(spark, f"{src}/x", out, examples=2)
    assert counts == {"written": counts["written"], "read": 7, "empty": 2, "short": 1, "contaminated": 1, "repeated": 1, "gap": 4 + 2 + 10**12 - 1}
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault((r.check, r.law), {})[r["rank"]] = (r.article_no, r.value)
    assert got["empty", "A"] == {0: (None, 2), 1: (1, 0), 2: (2, 0)} and got["short", "A"] == {0: (None, 1), 1: (None, 5)}
    assert got["gap", "A"] == {0: (None, 4), 1: (3, 6)} and got["gap", None] == {0: (None, 2), 1: (1, 2)} and got["gap", "B"] == {0: (None, 10**12 - 1), 1: (1, 10**12 - 1)}
    assert got["repeated", "A"] == {0: (None, 1), 1: (2, 2)} and got["repeated", "B"] == {0: (None, 0)} and got["longest", "A"][1][0] == 7 and len(got) == 7 * 3
    # what is mended leaves the report
    put(spark, str(tmp_path / "clean"), [(1, "w" * 50, "a")], "x")
    audit_corpus.run(spark, str(tmp_path / "clean/x"), out)
    assert spark.read.parquet(out).where("rank > 0 and check not in ('longest', 'shortest')").count() == 0 and spark.read.parquet(out).select("law").distinct().count() == 1


def test_options(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"short": 5}))
    base = tmp_path / "base.json"
    base.write_text(json.dumps({"short": 40, "examples": 3}))
    assert options("x", base, ["--documents", "d", "--out", "o", "--config", str(path), "--examples", "9"], ("documents", "out")) == {"short": 5, "examples": 9, "documents": "d", "out": "o"}
    with pytest.raises(SystemExit):
        options("x", base, ["--out", "o"], ("documents", "out"))


def test_command_line(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    r = subprocess.run([sys.executable, "-m", "jobs.audit_corpus", "--documents", f"{DIR}/documents.parquet", "--out", str(tmp_path / "o")], cwd=repo, capture_output=True, text=True, timeout=300)
    assert "read 200 articles" in r.stderr and (tmp_path / "o" / "check=gap").is_dir() and r.returncode in (0, 1)


def test_a_gap_of_any_width_is_one_row(spark):
    rows = spark.createDataFrame([("a", 10**12), ("a", 3), (None, 2)], "grp string, n long")
    assert sorted(map(tuple, evaluation.missing_ranges(rows, "n", "grp").collect()), key=repr) == sorted([("a", 1, 2), ("a", 4, 10**12 - 1), (None, 1, 1)], key=repr)
    with pytest.raises(ValueError, match="missing_ranges"):
        evaluation.missing_numbers(rows, "n", "grp")
    wide = spark.createDataFrame([("a", 5_000_000)], "grp string, n long")
    assert evaluation.missing_numbers(wide, "n", "grp").agg(F.count("*"), F.sum("number")).first()[:] == (4_999_999, 4_999_999 * 5_000_000 // 2)


def test_top_rows_against_a_window(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 1009).alias("x"), F.col("id").cast("string").alias("s"), F.array("id").alias("more"))
    df = df.withColumn("g", F.when(F.col("g") != 3, F.col("g")))
    want = df.withColumn("rank", F.row_number().over(evaluation.W.partitionBy("g").orderBy(F.desc_nulls_last("x"), "s"))).where("rank <= 4")
    for most in (200_000, 3):
        monkeypatch.setattr(bounded, "MOST_KEPT", most)
        got = bounded.top_rows(df.repartition(5), ["g"], [("x", False), ("s", True)], 4)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert bounded.top_rows(df.limit(0), ["g"], [("x", True)], 2).count() == 0


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_query(spark, name):
    assert difference(spark, DIR, name, queries.QUERIES[name], queries.SQL[name]) == ""

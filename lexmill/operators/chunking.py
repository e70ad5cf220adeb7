"""Paragraph-respecting chunks, as one fold per row inside SQL: no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.params import DEFAULT, Params


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def _state(out: Column, buf: Column, n: Column) -> Column:
    return F.struct(out.alias("out"), buf.alias("buf"), n.cast("int").alias("n"))


def _flushed(a: Column, sep: str) -> Column:
    return F.when(F.size(a["buf"]) > 0, F.concat(a["out"], F.array(F.array_join(a["buf"], sep)))).otherwise(a["out"])


def _empty() -> Column:
    return _state(F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit(0))


def pack_sentences(text: Column, limit: int) -> Column:
    """A long paragraph as groups of whole sentences; a longer sentence stands alone, uncut."""

    def step(a: Column, s: Column) -> Column:
        full = (F.size(a["buf"]) > 0) & (a["n"] + F.length(s) > limit)
        return F.when(full, _state(_flushed(a, " "), F.array(s), F.length(s) + 1)).otherwise(_state(a["out"], F.concat(a["buf"], F.array(s)), a["n"] + F.length(s) + 1))

    return F.aggregate(sentences(text), _empty(), step, lambda a: _flushed(a, " "))


def chunk_paragraphs(paragraphs: Column, p: Params = DEFAULT) -> Column:
    """Chunks of an array of paragraphs: greedy, with the last paragraph's tail carried over; long paragraphs by sentence."""

    def step(a: Column, f: Column) -> Column:
        long = _state(F.concat(_flushed(a, "\n"), pack_sentences(f, p.chunk_chars)), F.array().cast("array<string>"), F.lit(0))
        tail = F.substring(F.element_at(a["buf"], -1), -p.chunk_overlap, p.chunk_overlap) if p.chunk_overlap else F.lit("")
        keep = F.when(tail == "", F.array().cast("array<string>")).otherwise(F.array(tail))
        full = (F.size(a["buf"]) > 0) & (a["n"] + F.length(f) > p.chunk_chars)
        cut = _state(_flushed(a, "\n"), F.concat(keep, F.array(f)), F.length(tail) + F.length(f) + 1)
        more = _state(a["out"], F.concat(a["buf"], F.array(f)), a["n"] + F.length(f) + 1)
        return F.when(F.length(f) > p.chunk_chars, long).when(full, cut).otherwise(more)

    packed = F.aggregate(paragraphs, _empty(), step, lambda a: _flushed(a, "\n"))
    return F.filter(F.transform(packed, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def chunk(docs: DataFrame, paragraphs: Column, whole: Column, p: Params = DEFAULT) -> DataFrame:
    """docs with part_no, parts and chunk, one row a chunk; the whole text where no chunk is left."""
    parts = F.coalesce(chunk_paragraphs(paragraphs, p), F.array().cast("array<string>"))
    out = docs.withColumn("_parts", F.when(F.size(parts) > 0, parts).otherwise(F.array(whole)))
    out = out.select(*docs.columns, F.size("_parts").alias("parts"), F.posexplode("_parts").alias("_at", "chunk"))
    return out.withColumn("part_no", F.col("_at") + 1).drop("_at")


def citation_label(law: Column, number: Column, kind: Column, note: Column, part_no: Column, parts: Column) -> Column:
    """LAW m. 27, with (i/n) where an article has several chunks; provisions outside the law are labelled so."""
    bare = F.regexp_replace(F.regexp_replace(number, "^GEÇİCİ ", ""), "^EK ", "")
    outside = F.concat(law, F.lit("'ya işlenemeyen hüküm — "), F.when(kind == "gecici", "Geçici m. ").otherwise("m. "), bare)
    label = F.when(note == "İŞLENEMEYEN HÜKÜM", outside).otherwise(F.concat(law, F.lit(" m. "), number))
    return F.when(parts > 1, F.concat(label, F.lit(" ("), part_no, F.lit("/"), parts, F.lit(")"))).otherwise(label)


def context_header(name: Column, law_no: Column, label: Column, heading: Column, topic: Column, path: Column, note: Column) -> Column:
    """Lines that go before a chunk's text when it is embedded; empty parts leave no line."""
    line = lambda head, value: F.when(value != "", F.concat(F.lit(head), value))
    first = F.concat(name, F.lit(" ("), law_no, F.lit(") — "), label)
    topic_line = F.when((topic != "") & (topic != heading), F.concat(F.lit("Konu: "), topic))
    return F.concat_ws("\n", first, line("Kenar başlığı: ", heading), topic_line, line("Bağlam: ", path), line("Not: ", note))

"""The structural fold: a stream of blocks becomes articles with a heading path and structural levels.

There is no state object. Every block is an event at its position; what holds at an article is found by forward-filling
windows with a recency guard: a value of level L set at h is valid unless a shallower level was set, or everything was
reset, after h.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.functions.html import OUTLINE

# How structure, articles and the text's end are written.
ORDINAL = (
    r"(?:(?:ON|YİRMİ|OTUZ|KIRK|ELLİ|ALTMIŞ)\s*)?"
    r"(?:BİRİNCİ|İKİNCİ|ÜÇÜNCÜ|DÖRDÜNCÜ|BEŞİNCİ|ALTINCI|YEDİNCİ|SEKİZİNCİ|DOKUZUNCU|ONUNCU|YİRMİNCİ|OTUZUNCU|KIRKINCI|ELLİNCİ|SON)"
)
STRUCTURE = rf"(?U)^({ORDINAL}\s+(KİTAP|KISIM|BÖLÜM|AYIRIM|AYRIM|FASIL)\b)"
ARTICLE = r"(?U)^(GEÇİCİ\s+MADDE|EK\s+MADDE|MADDE)\s+(\d+)\s*(?:/\s*([A-Za-zÇĞİÖŞÜçğıöşü]))?\s*[-–—]?\s*"
TABLE_START = "SAYILI KANUNA EK VE DEĞİŞİKLİK GETİREN"
OUTSIDE_START = "SAYILI KANUNA İŞLENEMEYEN HÜKÜMLER"
OUTSIDE_NOTE = "İŞLENEMEYEN HÜKÜM"
FOOTNOTE_TEXT = r"^\s*\[\d+\]\s"
LEVELS = ("KİTAP", "KISIM", "BÖLÜM", "AYIRIM")
ALIASES = {"AYRIM": "AYIRIM", "FASIL": "BÖLÜM"}
ROMAN = "^(?:I|II|III|IV|VI|VII|VIII|IX|XI|XII|XIII|XIV|XV|XVI|XVII|XVIII|XIX|XX)$"
ACCEPTED = r"Kabul\s*Tarihi\s*:\s*([\d/]+)"
GAZETTE = r"Resm[îi]\s*Gazete\s*:\s*Tarih\s*:\s*([\d/]+)\s*Say[ıi]\s*:\s*(\d+)"
N_OUTLINE = 5


def header_meta(blocks: DataFrame, id_col: str = "source_id", first: int = 40) -> DataFrame:
    """Acceptance date and gazette from the first blocks of each source; empty where not found."""
    head = blocks.where(F.col("pos") < first).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    plain = F.array_join(F.transform("b", lambda x: x["text"]), " ")
    day, number = (F.regexp_extract(plain, GAZETTE, k) for k in (1, 2))
    return head.select(id_col, F.regexp_extract(plain, ACCEPTED, 1).alias("accepted"), F.when(day != "", F.concat(day, F.lit(" tarihli, "), number, F.lit(" sayılı Resmî Gazete"))).otherwise("").alias("gazette"))


def marker_level(marker: Column) -> Column:
    """Outline level of a marker: A. 1, I. 2, 1. 3, a. 4, aa. 5. Of single letters only I is Roman."""
    return F.when(marker.rlike(r"^\d+$"), 3).when(marker == F.lower(marker), F.when(F.length(marker) >= 2, 5).otherwise(4)).when(marker.rlike(ROMAN), 2).otherwise(1)


def articles(blocks: DataFrame, id_col: str = "source_id") -> DataFrame:
    """Articles of blocks(source_id, pos, text, text_raw, is_heading), one row each.

    Columns: source_id, article_no, kind, heading (the deepest valid one), topic (path of headings), book, part, chapter,
    section, note, ordinal, paragraphs. Articles without text are dropped, their ordinals stay used. One shuffle: every
    window and aggregation is by source.
    """
    own = W.partitionBy(id_col)
    before = own.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    stops = blocks.withColumn("_stop", F.min(F.when(F.contains("text", F.lit(TABLE_START)) | F.col("text_raw").rlike(FOOTNOTE_TEXT), F.col("pos"))).over(own))
    live = stops.where(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
    text = F.col("text")
    kind = F.when(F.contains(text, F.lit(OUTSIDE_START)), "outside").when(text.rlike(STRUCTURE), "structure").when(text.rlike(ARTICLE), "article").when(F.col("is_heading"), "heading").otherwise("body")
    seen = live.withColumns({"at": F.col("pos").cast("double"), "event": kind})
    # the name of a structural heading may be the next block, section switches apart
    label = F.regexp_extract(text, STRUCTURE, 1)
    inline = F.regexp_replace(F.substring(text, F.length(label) + 1, F.length(text)), "^[ \\-–—]+|[ \\-–—]+$", "")
    seen = seen.withColumns({"level": F.regexp_extract(text, STRUCTURE, 2), "label": label, "inline": inline})
    rows = seen.where("event != 'outside'").withColumn("pending", (F.col("event") == "structure") & (F.col("inline") == ""))
    ahead = own.orderBy("pos")
    rows = rows.withColumns({"was": F.lag("pending").over(ahead), "was_level": F.lag("level").over(ahead), "was_label": F.lag("label").over(ahead)})
    waited = F.coalesce(F.col("was"), F.lit(False))
    is_name = waited & F.col("event").isin("heading", "body")
    columns = [id_col, "pos", "at", "event", "text", "set_level", "set_text"]
    named = rows.withColumns(
        {
            "set_level": F.when(is_name, F.col("was_level")).when((F.col("event") == "structure") & (F.col("inline") != ""), F.col("level")),
            "set_text": F.when(is_name, F.concat_ws(" ", "was_label", "text")).when((F.col("event") == "structure") & (F.col("inline") != ""), F.concat_ws(" ", "label", "inline")),
            "event": F.when(is_name, "name").otherwise(F.col("event")),
        }
    ).select(columns)
    # no name came: the label alone is set just before the article or structure that came instead
    alone = rows.where(waited & F.col("event").isin("article", "structure")).select(id_col, "pos", (F.col("at") - 0.5).alias("at"), F.lit("name").alias("event"), "text", F.col("was_level").alias("set_level"), F.col("was_label").alias("set_text"))
    outside = seen.where("event = 'outside'").select(id_col, "pos", "at", "event", "text", F.lit(None).cast("string").alias("set_level"), F.lit(None).cast("string").alias("set_text"))
    stream = named.unionByName(alone).unionByName(outside)
    for alias, name in ALIASES.items():
        stream = stream.withColumn("set_level", F.when(F.col("set_level") == alias, name).otherwise(F.col("set_level")))
    marker = F.regexp_extract("text", OUTLINE, 1)
    depth = F.when(F.col("event") == "heading", F.when(F.col("text").rlike(OUTLINE), marker_level(marker)).otherwise(1))
    unmarked = (F.col("event") == "heading") & ~F.col("text").rlike(OUTLINE)
    stream = stream.withColumns({"depth": depth, "clears": F.col("event").isin("structure", "name", "outside") | unmarked, "closes": F.col("event").isin("structure", "outside")})
    last = lambda test, value: F.last(F.when(test, F.col(value)), ignorenulls=True).over(before)
    filled = {"_reset": last(F.col("clears"), "at"), "_closed": last(F.col("closes"), "at"), "_article": last(F.col("event") == "article", "at"), "_outside": last(F.col("event") == "outside", "at")}
    for k in range(1, N_OUTLINE + 1):
        filled |= {f"_h{k}": last(F.col("depth") == k, "at"), f"_t{k}": last(F.col("depth") == k, "text")}
    for k, name in enumerate(LEVELS, 1):
        filled |= {f"_s{k}": last(F.col("set_level") == name, "at"), f"_v{k}": last(F.col("set_level") == name, "set_text")}
    full = stream.withColumns(filled)
    zero = F.lit(-1.0)
    # an unmarked heading clears all and is itself at level 1, so equality with the reset is valid there
    def valid(k: int) -> Column:
        shallower = [F.coalesce(f"_h{j}", zero) for j in range(1, k)]
        guard = reduce(lambda a, b: F.greatest(a, b), [F.coalesce("_reset", zero), *shallower])
        return F.col(f"_h{k}").isNotNull() & ((F.col(f"_h{k}") > guard) | ((F.col(f"_h{k}") == F.col("_reset")) if k == 1 else F.lit(False)))

    def level(k: int) -> Column:
        shallower = [F.coalesce(f"_s{j}", zero) for j in range(1, k)]
        guard = reduce(lambda a, b: F.greatest(a, b), shallower, zero)
        return F.when(F.col(f"_s{k}") > guard, F.col(f"_v{k}")).otherwise("")

    path = F.filter(F.array(*[F.when(valid(k), F.col(f"_t{k}")) for k in range(1, N_OUTLINE + 1)]), lambda x: x.isNotNull())
    word, letter = F.regexp_extract("text", ARTICLE, 1), F.regexp_extract("text", ARTICLE, 3)
    number = F.concat(F.regexp_extract("text", ARTICLE, 2), F.when(letter != "", F.concat(F.lit("/"), F.upper(letter))).otherwise(""))
    what = F.when(word.startswith("GEÇİCİ"), "gecici").when(word.startswith("EK"), "ek").otherwise("madde")
    heads = full.where("event = 'article'").select(
        F.col(id_col), F.col("at").alias("_at"),
        F.when(what == "gecici", F.concat(F.lit("GEÇİCİ "), number)).when(what == "ek", F.concat(F.lit("EK "), number)).otherwise(number).alias("article_no"),
        what.alias("kind"), F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit("")).alias("heading"),
        F.array_join(path, " > ").alias("topic"), *[level(k).alias(c) for k, c in enumerate(("book", "part", "chapter", "section"), 1)],
        F.when(F.col("_outside").isNotNull(), OUTSIDE_NOTE).otherwise("").alias("note"), F.row_number().over(own.orderBy("at")).cast("int").alias("ordinal"),
    )
    first = F.trim(F.regexp_replace("text", ARTICLE, ""))
    inside = full.where("event in ('article', 'body') and _article is not null and _article > coalesce(_closed, -1)")
    said = inside.select(F.col(id_col), F.col("_article").alias("_at"), F.struct("at", F.when(F.col("event") == "article", first).otherwise(F.col("text")).alias("text")).alias("p")).where("p.text != ''")
    texts = said.groupBy(id_col, "_at").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["text"]).alias("paragraphs"))
    return heads.join(texts, [id_col, "_at"]).drop("_at")

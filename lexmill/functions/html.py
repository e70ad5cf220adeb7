"""HTML pages to blocks, as columns: body, block split, attributes, footnotes, plain text, heading roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import clean_text, normalize

# Character references that are decoded, the ampersand last.
ENTITIES = {
    "&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&apos;": "'",
    "&copy;": "©", "&reg;": "®", "&middot;": "·", "&bull;": "•", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&laquo;": "«", "&raquo;": "»", "&sect;": "§",
    "&ccedil;": "ç", "&Ccedil;": "Ç", "&ouml;": "ö", "&Ouml;": "Ö", "&uuml;": "ü", "&Uuml;": "Ü", "&acirc;": "â", "&icirc;": "î",
    "&amp;": "&",
}
# Footnote marks, removed with their content, outline markers of headings, and how a block opens, closes, names
# its class and shows bold.
FOOTNOTE_MARKS = (
    r"(?is)<sup\b[^>]*>.*?</sup>"
    r"|<span[^>]*vertical-align:\s*super[^>]*>.*?</span>"
    r"|<span[^>]*class=[\"']?MsoFootnoteReference[^>]*>.*?</span>\s*(?:</span>)?"
    r"|<a[^>]*href=[\"']?#_ftn[^>]*>.*?</a>"
)
OUTLINE = r"^([A-ZÇĞİÖŞÜ]|[IVXLCDM]{1,5}|\d{1,2}|[a-zçğıöşü]{1,3})\s*[.)]\s+(\S.*)$"
_OPEN = r"(?is)^<(h[1-6]|p)\b([^>]*)>"
_CLASS = r"class=[\"']?([A-Za-z0-9_-]+)"
_CLOSE = r"(?is)</(?:p|h[1-6])\s*>.*$"
_BOLD = r"(?is)<(?:b|strong)\b[^>]*>(.*?)</(?:b|strong)\s*>"


def page_body(html: Column) -> Column:
    """The body without scripts and styles; the whole page where there is no body."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    body = F.regexp_extract(plain, r"(?is)<body[^>]*>(.*)</body>", 1)
    return F.when(plain.rlike(r"(?is)<body[^>]*>.*</body>"), body).otherwise(plain)


def plain_text(fragment: Column) -> Column:
    """Text of a fragment: footnote marks and tags go, references are decoded, white space is single."""
    out = F.regexp_replace(F.regexp_replace(fragment, FOOTNOTE_MARKS, " "), r"(?is)<[^>]+>", " ")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.replace(out, F.lit(" "), F.lit(" ")), r"\s+", " "))


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep_empty: bool = False) -> DataFrame:
    """One row a heading or paragraph: pos, tag, class, centered, text, text_raw, bold_chars, chars, is_heading.

    A block runs from its open tag to the next one and is cut at its first closing tag, so unclosed paragraphs are fine.
    Footnote and footer classes and empty blocks go; pos counts the blocks that stay. No shuffle: rows stay where they are.
    keep_empty leaves a row of nulls for a page without blocks.
    """
    pieces = F.filter(F.split(page_body(F.col(html_col)), r"(?i)(?=<(?:h[1-6]|p)\b[^>]*>)"), lambda x: x.rlike(_OPEN))

    def block(x: Column) -> Column:
        attrs = F.regexp_extract(x, _OPEN, 2)
        return F.struct(
            F.lower(F.regexp_extract(x, _OPEN, 1)).alias("tag"),
            F.regexp_extract(attrs, _CLASS, 1).alias("class"),
            F.contains(F.lower(attrs), F.lit("center")).alias("centered"),
            F.regexp_replace(F.regexp_replace(x, _OPEN, ""), _CLOSE, "").alias("inner"),
        )

    def texts(b: Column) -> Column:
        raw = plain_text(b["inner"])
        bold = F.regexp_extract_all(b["inner"], F.lit(_BOLD), F.lit(1))
        return F.struct(b["tag"].alias("tag"), b["class"].alias("class"), b["centered"].alias("centered"), raw.alias("text_raw"), plain_text(F.array_join(bold, " ")).alias("bold"))

    parts = F.transform(F.filter(F.transform(pieces, block), lambda b: ~b["class"].rlike(r"(?i)(footnotetext|footer)")), texts)
    cleaned = F.transform(
        parts,
        lambda b: F.struct(
            b["tag"].alias("tag"), b["class"].alias("class"), b["centered"].alias("centered"), b["text_raw"].alias("text_raw"), b["bold"].alias("bold"),
            F.trim(F.regexp_replace(clean_text(F.regexp_replace(b["text_raw"], r"\[\d+\]", " ")), r"\s+", " ")).alias("text"),
        ),
    )
    out = pages.select(F.col(id_col), F.filter(cleaned, lambda b: b["text"] != "").alias("_blocks"))
    explode = F.posexplode_outer if keep_empty else F.posexplode
    out = out.select(id_col, explode("_blocks").alias("pos", "b")).select(id_col, "pos", "b.*")
    out = out.withColumns({"bold_chars": F.length(normalize(F.col("bold"))), "chars": F.length(normalize(F.col("text_raw")))}).drop("bold")
    return out.withColumn("is_heading", heading_role(F.col("tag"), F.col("class"), F.col("centered"), (F.col("bold_chars") > 0) & (F.col("bold_chars") >= 0.9 * F.col("chars")), F.col("text")))


def heading_role(tag: Column, cls: Column, centered: Column, bold: Column, text: Column) -> Column:
    """Sure marks first (heading tag, centred, style class), then all bold, then title classes by the text's form."""
    unsure = ~text.rlike(r"[.!?;:]$") & ((text.rlike(OUTLINE) & (F.length(text) <= 120)) | (F.length(text) <= 60))
    return F.when(tag.startswith("h") | centered | cls.rlike("(?i)^stil"), True).when(bold, True).when(cls.rlike("(?i)title|heading"), unsure).otherwise(False)


def admission(content: Column, least: int, marker: str) -> Column:
    """Why a payload is refused, or null: too short, or the marker missing (case apart)."""
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) < least, F.lit("short")).when(~F.contains(F.upper(content), F.lit(marker.upper())), F.lit("no marker"))

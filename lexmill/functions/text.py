"""String functions as columns: normalisation, query terms, numbers, synonyms, output clean-up. No UDF.

Normalisation is also there for one string and for Arrow arrays."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.params import DEFAULT, Params

# Letters mapped before lower-casing, and quotes and dashes that become spaces.
FIRST_FROM = "İIıŞşÇçĞğÖöÜüÂâÎîÛûÊê'’‘–—−"
FIRST_TO = "iiissccggoouuaaiiuuee" + " " * 6

# Words without weight in a query.
STOP_WORDS = [
    "ve", "veya", "ile", "ama", "fakat", "ancak", "ise", "de", "da", "ki", "bir", "bu", "su", "o", "the", "icin",
    "gibi", "kadar", "gore", "daha", "cok", "az", "her", "hic", "ne", "nedir", "nasil", "neden", "nicin", "kim",
    "kimdir", "hangi", "hangisi", "mi", "mu", "midir", "var", "yok", "olur", "olmaz", "olarak", "sonra", "once",
    "en", "tum", "butun", "bazi", "ben", "sen", "biz", "siz", "onlar", "beni", "bana", "yapmak", "etmek", "olmak",
    "diye", "eger", "ya", "hem", "ayni",
]

# Query word or pair -> words of the corpus. The key "isten cikarma" is spelled so that it matches.
SYNONYMS = {
    "ihtiyac": ["gereksinim"],
    "ihtiyaci": ["gereksinim"],
    "depozito": ["guvence"],
    "teminat": ["guvence"],
    "tahliye": ["sona", "erdirme", "geri", "verme"],
    "cikarmak": ["sona", "erdirme", "fesih"],
    "cikarabilir": ["sona", "erdirme", "fesih"],
    "cikarma": ["sona", "erdirme", "fesih"],
    "zam": ["kira", "bedeli", "artis"],
    "zammi": ["kira", "bedeli", "artis"],
    "kontrat": ["sozlesme"],
    "emlakci": ["kiraya", "veren"],
    "evsahibi": ["kiraya", "veren"],
    "gabin": ["asiri", "yararlanma"],
    "cezai": ["ceza", "kosulu"],
    "cezai sart": ["ceza", "kosulu"],
    "iptal": ["gecersiz", "hukumsuz"],
    "gecersizlik": ["hukumsuzluk"],
    "butlan": ["kesin", "hukumsuzluk"],
    "fesih": ["sona", "erdirme"],
    "vade": ["muaccel"],
    "vadesi": ["muaccel"],
    "gecikme faizi": ["temerrut", "faizi"],
    "borcun ifasi": ["ifa"],
    "odenmemesi": ["temerrut"],
    "odememe": ["temerrut"],
    "kaza": ["haksiz", "fiil", "zarar"],
    "isveren sorumlulugu": ["adam", "calistiran"],
    "patron": ["adam", "calistiran", "isveren"],
    "bina": ["yapi", "eseri"],
    "binadan": ["yapi", "eseri"],
    "hayvan": ["hayvan", "bulunduran"],
    "kefil": ["kefalet"],
    "vekalet": ["vekil"],
    "avukatlik": ["vekalet"],
    "muteahhit": ["yuklenici"],
    "insaat": ["eser", "sozlesmesi", "yuklenici"],
    "tamir": ["eser", "sozlesmesi"],
    "isci": ["hizmet", "sozlesmesi", "iscinin"],
    "maas": ["ucret"],
    "isten cikarma": ["fesih"],
    "zaman asimi": ["zamanasimi"],
    "hak dusurucu": ["zamanasimi"],
}

# Abbreviations of statutes, and how article numbers are written in questions.
LAWS = "tbk|tck|tmk|hmk|cmk|kvkk|ttk"
NUMBER_PATTERNS = (
    r"(?iu)\bmadde\s*(\d+)\s*(?:/\s*([a-zçğıöşü]))?",
    r"(?iu)\bm\s*\.?\s*(\d+)\s*(?:/\s*([a-zçğıöşü]))?",
    r"(?iu)\b(\d+)\s*\.?\s*madde()",
    rf"(?iu)\b(?:{LAWS})\s*[.:]?\s*(\d+)()",
)


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Latin letters with marks and their ASCII letters, by the rule of canonical decomposition."""
    pairs = []
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for code in block:
            base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
            if len(base) == 1 and base.isascii():
                pairs.append((chr(code), base.lower()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize(text: Column) -> Column:
    """ASCII lower-case words with single spaces; null is empty. The letter map runs before lower()."""
    first = F.lower(F.translate(F.coalesce(text, F.lit("")), FIRST_FROM, FIRST_TO))
    plain = F.regexp_replace(F.translate(first, *accent_table()), r"[̀-ͯ]+", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


@lru_cache(maxsize=1)
def _letter_maps() -> tuple[dict, dict]:
    return str.maketrans(FIRST_FROM, FIRST_TO), str.maketrans(*accent_table())


def _plain(text: str) -> str:
    """ASCII letters for letters with marks, in lower case; marks that stand alone vanish."""
    first, accents = _letter_maps()
    return re.sub("[\u0300-\u036f]+", "", text.translate(first).lower().translate(accents))


def normalized(text: str) -> str:
    """The same as normalize, for one string."""
    return re.sub("[^a-z0-9]+", " ", _plain(text)).strip()


#: No code point from here on stands for an ASCII letter or digit.
LETTERS_END = 0x3000


@lru_cache(maxsize=1)
def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """What normalize makes of a byte of UTF-8, and of a code point up to LETTERS_END: a letter or digit, a space, or 0 for nothing."""
    out = np.full(LETTERS_END + 1, 32, np.uint8)
    for code in range(LETTERS_END):
        plain = _plain(chr(code))
        if not plain or re.fullmatch("[a-z0-9]", plain):
            out[code] = ord(plain or "\0")
    return np.r_[out[:128], np.zeros(64, np.uint8), np.full(64, 32, np.uint8)], out


def normalized_array(texts: pa.Array) -> pa.Array:
    """The same as normalize, for an array of strings: its bytes are looked up at once. Memory: about 20 times the texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:  # bytes that are no UTF-8 are replaced, as by the JVM
        texts = pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())
    if not len(texts):
        return pa.array([], pa.string())
    _, offsets, values = texts.buffers()
    edge = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values or b"", np.uint8)[edge[0] : edge[-1]]
    by_byte, by_code = letter_table()
    out, edge = by_byte[data], edge - edge[0]
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead].astype(np.int32)
    second, third = (data[np.minimum(lead + n, len(data) - 1)].astype(np.int32) & 63 for n in (1, 2))
    code = np.where(first < 0xE0, (first & 31) << 6 | second, np.where(first < 0xF0, (first & 15) << 12 | second << 6 | third, LETTERS_END))
    out[lead] = by_code[np.minimum(code, LETTERS_END)]
    out, edge = _without(out, edge, out == 0)
    space = out == 32
    again = np.r_[True, space[:-1]][: len(out)]
    again[edge[:-1][edge[:-1] < len(out)]] = True  # a text begins
    out, edge = _without(out, edge, space & again)
    last = np.zeros(len(out), bool)
    last[edge[1:][np.diff(edge) > 0] - 1] = True
    out, edge = _without(out, edge, last & (out == 32))
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(out))


def _without(data: np.ndarray, edge: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that are not dropped, and where texts begin and end among them."""
    return data[~drop], edge - np.searchsorted(np.flatnonzero(drop), edge)


def clean_text(text: Column) -> Column:
    """No-break spaces become spaces, zero-width ones vanish, runs of blanks shrink, ends are trimmed."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" ")), F.lit("​"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(plain, "[ \\t]+", " "), r"^\s+|\s+$", "")


def words(normalized: Column) -> Column:
    return F.array_remove(F.split(normalized, " "), "")


def extract_numbers(text: Column) -> Column:
    """Article numbers of a question in order of pattern, then place, each once; n/x with its letter in lower case.

    A number right after "geçici madde" or "ek madde" names another provision: it gets that word as a prefix.
    """
    text = F.coalesce(text, F.lit(""))
    special = F.zip_with(
        F.regexp_extract_all(text, F.lit(r"(?iu)\b(geçici|ek)\s+madde\s*(\d+)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"(?iu)\b(geçici|ek)\s+madde\s*(\d+)"), F.lit(2)),
        lambda kind, n: F.concat(F.when(F.lower(kind) == "ek", F.lit("EK ")).otherwise(F.lit("GEÇİCİ ")), n),
    )
    rest = F.regexp_replace(text, r"(?iu)\b(?:geçici|ek)\s+madde\s*\d+", " ")
    plain = [
        F.zip_with(
            F.regexp_extract_all(rest, F.lit(p), F.lit(1)),
            F.regexp_extract_all(rest, F.lit(p), F.lit(2)),
            lambda n, x: F.when(x == "", n).otherwise(F.concat(n, F.lit("/"), F.lower(x))),
        )
        for p in NUMBER_PATTERNS
    ]
    return F.array_distinct(F.concat(special, *plain))


def law_abbreviation(text: Column) -> Column:
    """The first statute abbreviation in upper case, or an empty string."""
    return F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?i)\b({LAWS})\b", 1))


def query_terms(text: Column) -> Column:
    """Terms of a question in order, each once: numbers exact, others as prefixes ending in *; long words lose a fifth."""
    kept = F.filter(words(normalize(text)), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))
    stem = lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(5), F.floor(F.length(w) * 4 / 5).cast("int")))
    term = lambda w: F.when(w.rlike("^[0-9]+$"), w).when(F.length(w) >= 6, F.concat(stem(w), F.lit("*"))).otherwise(F.concat(w, F.lit("*")))
    return F.array_distinct(F.transform(kept, term))


def synonym_words(text: Column) -> Column:
    """Words that the synonym list adds: single words' entries first, then pairs', without words already there."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = words(normalize(text))
    pairs = F.transform(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(own, i + 1)))
    hits = F.filter(F.transform(F.concat(own, pairs), lambda k: F.element_at(table, k)), lambda v: v.isNotNull())
    return F.array_except(F.array_distinct(F.flatten(hits)), own)


def synonym_expand(text: Column) -> Column:
    """The normalised question with its synonyms behind it."""
    added = synonym_words(text)
    return F.when(F.size(added) == 0, normalize(text)).otherwise(F.concat_ws(" ", normalize(text), F.array_join(added, " ")))


def strip_think(text: Column) -> Column:
    """Model output without its reasoning blocks."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>\s*", ""), r"^\s+|\s+$", "")


def repetition_loop(text: Column, p: Params = DEFAULT) -> Column:
    """Whether the last ``loop_tail`` characters occur ``loop_times`` times or more."""
    text = F.coalesce(text, F.lit(""))
    tail = F.substring(text, -p.loop_tail, p.loop_tail)
    times = (F.length(text) - F.length(F.replace(text, tail, F.lit("")))) / p.loop_tail
    return (F.length(text) >= p.loop_tail) & (times >= p.loop_times)


def char_grams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the normalised text; a shorter text is its own only gram."""
    norm = normalize(text)
    return F.when(F.length(norm) < n, F.array(norm)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(norm) - n + 1, F.lit(1))), lambda i: F.substring(norm, i, F.lit(n))))

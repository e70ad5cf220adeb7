"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of a lexicon, its distance to words of the second person, rates of capitals, of ! and ?, and
of disguised words. The lexicon is learned from the labelled rows too: beginnings of words, and whole words, that toxic
documents hold far more often than others, each with a cautious log ratio of rates. Disguised words (digits and signs for
letters, signs between letters, letters drawn out or set apart) are looked up by what they stand for.

A bounded sample of labelled rows (SAMPLE_ROWS) fits lexicon, trees and calibration; every document is scored whole, by
Arrow batches: what is asked of a word is asked once per distinct word of a batch, and then summed by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import boosting
from lexmill.llm.wordids import pieces_of
from lexmill.sources.tables import arrow_map, drop_materialized, materialize

#: Labelled rows that the model is fitted on at most, but for chance (one in 10^9), chosen by hash of doc_id.
SAMPLE_ROWS = 20_000
#: Beginnings of words that are counted, in code points; toxic documents that must hold a key; keys counted and kept at most.
SHORTEST, LONGEST, LEAST_DOCS, MOST_KEYS, MOST_ENTRIES = 3, 8, 3, 200_000, 4_000
#: How many standard errors are taken off a key's log ratio, and what must be left.
CAUTION, LEAST_WEIGHT = 1.5, 1.0
#: Log ratios from which a word counts as weakly, clearly and strongly toxic.
GRADES = (1.0, 2.0, 3.0)
NEAR = 5
CUT = 0.7
PIECE_BYTES = 4 << 20

# Pronouns of the second person in English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner ihr euch euer eure "
    "tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros vosotras vuestro vuestra"
).split()
# Signs and digits written for letters.
SIGNS, LETTERS = "0134578@$!|", "oieastbasil"

FEATURES = (
    "log_words", "weak", "clear", "strong", "log_clear", "log_strong", "mean_weight", "max_weight", "kinds", "you", "near_you", "near_share",
    "capitals", "exclaims", "asks", "disguised", "disguised_hits", "apart_hits",
)


@dataclass
class Lexicon:
    """keys: beginnings of words; a whole word ends in a blank. weights: their cautious log ratios."""

    keys: list[str]
    weights: np.ndarray

    def weigh(self, words: pa.Array) -> np.ndarray:
        """The greatest weight of a key that fits each word, 0 if none does."""
        out = np.zeros(len(words))
        if not len(self.keys) or not len(words):
            return out
        known, table = pa.array(self.keys, words.type), np.r_[self.weights, 0.0]
        for part in _keys(words):
            at = pc.fill_null(pc.index_in(part, value_set=known), len(self.keys)).to_numpy(zero_copy_only=False)
            out = np.maximum(out, table[at])
        return out


def _keys(words: pa.Array) -> Iterator[pa.Array]:
    """Per length the beginning of each word (null if the word is shorter), and last the word with a blank (null if shorter than 2)."""
    size = pc.utf8_length(words)
    for n in range(SHORTEST, LONGEST + 1):
        yield pc.if_else(pc.greater_equal(size, n), pc.utf8_slice_codeunits(words, 0, n), pa.scalar(None, words.type))
    yield pc.if_else(pc.greater_equal(size, 2), pc.binary_join_element_wise(words, pa.scalar("", words.type), pa.scalar(" ", words.type)), pa.scalar(None, words.type))


@dataclass
class Words:
    """The words of some texts: row r has word[start[r]:start[r + 1]], indices into the distinct ones."""

    word: np.ndarray
    start: np.ndarray
    token: pa.Array  # distinct, as they stand
    core: pa.Array  # lower case, without signs around them
    plain: pa.Array  # what a disguised word stands for, else the core
    odd: np.ndarray  # whether the word is disguised


def split(texts: pa.Array) -> Words:
    words = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    start = words.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    token = coded.dictionary
    low = pc.utf8_lower(token)
    core = pc.replace_substring_regex(low, r"^[^\pL\pN]+|[^\pL\pN]+$", "")
    sign = pc.match_substring_regex(low, r"^[^\pL]*[@$!|]\pL{2}|\pL[0-9@$!|]+\pL|\pL[0-9]$|^[0-9]\pL{2}")
    between = pc.match_substring_regex(core, r"^\pL(?:[-._*~+]+\pL){3,}$")
    drawn = pc.match_substring_regex(core, r"aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|lll|mmm|nnn|ooo|ppp|qqq|rrr|sss|ttt|uuu|vvv|www|xxx|yyy|zzz")
    odd = pc.or_(pc.or_(sign, between), drawn).to_numpy(zero_copy_only=False).astype(bool)
    plain = core
    if odd.any():
        at = np.flatnonzero(odd)
        plain = pc.replace_with_mask(core, pa.array(odd), pa.array([_plain(x) for x in low.take(pa.array(at)).to_pylist()], core.type))
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), start - start[0], token, core, plain, odd)


_TABLE = str.maketrans(SIGNS, LETTERS)


def _plain(word: str) -> str:
    """Letters for signs, no other signs, and letters drawn out three times or more once."""
    out: list[str] = []
    word = word.rstrip("!|?.,;:")
    for c in word.translate(_TABLE):
        if c.isalpha() and not (len(out) > 1 and out[-1] == c and out[-2] == c):
            out.append(c)
    text = "".join(out)
    for c in {a for a, b in zip(text, text[1:]) if a == b}:
        if c * 3 in word.translate(_TABLE):
            text = text.replace(c * 2, c)
    return text


def _apart(w: Words, length: np.ndarray) -> list[tuple[int, str]]:
    """(row, letters) of every run of four or more words that are single letters."""
    single = (length == 1)[w.word]
    if not single.any():
        return []
    edge = np.diff(np.r_[0, single.astype(np.int8), 0])
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = []
    for a, b in zip(first[last - first >= 4], last[last - first >= 4]):
        cuts = w.start[(w.start > a) & (w.start < b)]  # a run ends with its text
        for i, j in zip(np.r_[a, cuts], np.r_[cuts, b]):
            if j - i >= 4:
                row = int(np.searchsorted(w.start, i, side="right")) - 1
                out.append((row, "".join(w.core.take(pa.array(w.word[i:j])).to_pylist())))
    return out


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row a text, one column a feature; null and empty texts have zeros."""
    w, n = split(texts), len(texts)
    row = np.repeat(np.arange(n), np.diff(w.start))
    own, other = lexicon.weigh(w.core), np.zeros(len(w.odd))
    if w.odd.any():
        other[w.odd] = lexicon.weigh(w.plain.filter(pa.array(w.odd)))
    weight = np.maximum(own, other)
    flag = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    size = pc.utf8_length(w.core).to_numpy(zero_copy_only=False)
    shout = flag(pc.match_substring_regex(w.token, r"^\P{L}*\p{Lu}{3,}\P{L}*$"))
    you = flag(pc.is_in(w.core, value_set=pa.array(SECOND_PERSON, w.core.type)))
    total = lambda x: np.bincount(row, x[w.word], n) if len(row) else np.zeros(n)
    words = np.diff(w.start).astype(float)
    per = np.maximum(words, 1)
    weak, clear, strong = (total((weight >= g).astype(float)) for g in GRADES)
    top, kinds, near = np.zeros(n), np.zeros(n), np.zeros(n)
    hit = np.flatnonzero((weight >= GRADES[1])[w.word])
    if len(hit):
        np.maximum.at(top, row[hit], weight[w.word[hit]])
        kinds = np.bincount(np.unique(row[hit] * len(w.odd) + w.word[hit]) // max(1, len(w.odd)), minlength=n).astype(float)
        before = np.r_[0, np.cumsum(you[w.word])]
        lo, hi = np.maximum(hit - NEAR, w.start[row[hit]]), np.minimum(hit + NEAR + 1, w.start[row[hit] + 1])
        near = np.bincount(row[hit], (before[hi] > before[lo]).astype(float), n)
    apart = np.zeros(n)
    if runs := _apart(w, size):
        for (r, _), g in zip(runs, lexicon.weigh(pa.array([t for _, t in runs], pa.large_string()))):
            apart[r] += g >= GRADES[1]
    count = lambda sign: total(flag(pc.match_substring(w.token, sign)).astype(float)) / per
    return np.column_stack(
        [
            np.log1p(words), weak / per, clear / per, strong / per, np.log1p(clear), np.log1p(strong), total(weight) / per, top, np.log1p(kinds), total(you.astype(float)) / per, near / per, near / np.maximum(clear, 1),
            total(shout.astype(float)) / per, count("!"), count("?"), total(w.odd.astype(float)) / per, total((w.odd & (other >= GRADES[1])).astype(float)) / per, apart / per,
        ]
    )


@dataclass
class ToxicModel:
    lexicon: Lexicon
    trees: boosting.Boosted
    at: np.ndarray
    rate: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated scores; within a flat stretch of the calibration the margin still orders rows by a thousandth."""
        margin = self.trees.margin(rows)
        return np.clip(0.999 * np.interp(margin, self.at, self.rate) + 0.001 * boosting.sigmoid(margin), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, y, check, text): labelled documents that aren't held out, one row an id and label. check marks the third that calibrates.

    Ids are chosen by a threshold on their hash, so nothing is sorted; only they are broadcast.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
    own = own.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    n, spread = own.count(), 1 << 30
    if n > sample_rows:
        most = int(spread * (sample_rows - 6 * sample_rows**0.5) / n)
        own = own.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(spread)) < most)
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    met = texts.join(F.broadcast(own), F.col("_doc") == F.col("id"))
    one = met.groupBy("id", "y").agg(F.min("text").alias("text"))  # repeated ids; minima are taken in the map task
    return one.select("id", "y", (F.pmod(F.xxhash64("id", F.lit(12)), F.lit(3)) == 0).alias("check"), "text")


def _count_keys(rows: DataFrame, wanted: list[str] | None) -> DataFrame:
    """(key, docs, uses) of rows(text): how many documents hold a key, and how often; of all keys, or of the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else pa.array(wanted, pa.large_string())
        docs, uses = (None, None) if known is None else (np.zeros(len(known) + 1, np.int64), np.zeros(len(known) + 1, np.int64))
        for batch in batches:
            for part in pieces_of(batch, 0, PIECE_BYTES):
                w = split(part.column(0))
                row = np.repeat(np.arange(part.num_rows), np.diff(w.start))
                for keys in _keys(w.plain):
                    if known is None:
                        coded = keys.dictionary_encode()
                        names, at = coded.dictionary, pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                    else:
                        names, at = known, pc.fill_null(pc.index_in(keys, value_set=known), len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
                    place, m = at[w.word], len(names) + 1
                    pairs, times = np.unique(row * m + place, return_counts=True)
                    d, u = np.bincount(pairs % m, minlength=m), np.bincount(pairs % m, times, m).astype(np.int64)
                    if known is None:
                        yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(d[:-1].astype(np.int64)), pa.array(u[:-1])], ["key", "docs", "uses"])
                    else:
                        docs += d
                        uses += u
        if known is not None and docs[:-1].any():
            at = np.flatnonzero(docs[:-1])
            yield pa.RecordBatch.from_arrays([known.take(pa.array(at)).cast(pa.string()), pa.array(docs[at]), pa.array(uses[at])], ["key", "docs", "uses"])

    sent = rows.select("text").transform(arrow_map, run, "key string, docs long, uses long")
    return sent.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """From rows(y, text): keys of the toxic ones that LEAST_DOCS of them hold, then how often the others hold these."""
    n_words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    size = {r.y: r for r in rows.groupBy("y").agg(F.sum(n_words).alias("words")).collect()}
    if 0 not in size or 1 not in size:
        return Lexicon([], np.empty(0))
    toxic = _count_keys(rows.where("y = 1"), None).where(F.col("docs") >= LEAST_DOCS)
    toxic = {r.key: r for r in toxic.orderBy(F.desc("docs"), "key").limit(MOST_KEYS).collect()}
    if not toxic:
        return Lexicon([], np.empty(0))
    clean = {r.key: r for r in _count_keys(rows.where("y = 0"), sorted(toxic)).collect()}
    found = []
    for key, t in toxic.items():
        c = clean.get(key)
        ratio = np.log((t.uses + 0.5) / size[1].words) - np.log(((c.uses if c else 0) + 0.5) / size[0].words)
        weight = ratio - CAUTION * np.sqrt(1 / (t.docs + 0.5) + 1 / ((c.docs if c else 0) + 0.5))
        if weight >= LEAST_WEIGHT:
            found.append((-float(weight), key))
    found = sorted(found)[:MOST_ENTRIES]
    return Lexicon([k for _, k in found], np.array([-w for w, _ in found]))


def fit(rows: np.ndarray, y: np.ndarray, check: np.ndarray, lexicon: Lexicon) -> ToxicModel:
    """Trees on the rows that don't calibrate; calibration on the others, or on all if they lack either class.

    Without both classes the score is constant: the smoothed share of toxic rows; a half without any row.
    """
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return ToxicModel(lexicon, boosting.Boosted(float(np.log(share / (1 - share)))), np.zeros(1), np.array([share]))
    learn = ~check if 0 < y[~check].sum() < (~check).sum() else np.ones(len(y), bool)
    trees = boosting.boost(rows[learn], y[learn])
    judge = check if min(y[check].sum(), (1 - y[check]).sum()) >= 20 else np.ones(len(y), bool)
    return ToxicModel(lexicon, trees, *boosting.isotonic(trees.margin(rows[judge]), y[judge]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """The model from the labels of documents that aren't held out; labels other than 0 and 1, and null ids, are ignored.

    What reaches the driver: keys of the lexicon, and one row of features a sampled document.
    """
    seen = materialize(sample(docs, labels, id_col, text_col, sample_rows), "toxic-sample")
    lexicon = learn_lexicon(seen.where("not check"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 3, PIECE_BYTES):
                x = features(part.column(3), lexicon)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["id", "y", "check", "x"])

    got = sorted(tuple(r) for r in arrow_map(seen, run, "id long, y int, check boolean, x array<double>").collect())
    drop_materialized(seen)
    table = np.array([r[3] for r in got], float).reshape(len(got), len(FEATURES))
    return fit(table, np.array([r[1] for r in got], np.int64), np.array([r[2] for r in got], bool), lexicon)


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from CUT on).

    Null and empty texts are scored by their zero features; texts of any length are read whole; repeated rows score alike;
    other columns pass through, columns with the names of results are replaced; an empty table stays empty.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    inner = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*keep).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 0, PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(model.scores(features(part.column(0), model.lexicon)))], ["row", "score"])

    out = arrow_map(inner, run, f"row {inner.schema['row'].dataType.simpleString()}, score double")
    return out.select("row.*", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

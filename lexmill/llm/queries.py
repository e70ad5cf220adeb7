"""The thin opN queries over whole tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chat, html_extract, importance, packing, pii, piece_fst, quality_rules, rule_ensemble, simhash, token_files, toxicity, vector_dedup
from lexmill.sources.tables import materialize, read_table, scratch_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.digests(read_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = materialize(pii.candidates(read_table(spark, sf_dir, "documents")), "pii")
    return pii.digest(pii.decide(spans, pii.fit(spans)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path)
    return token_files.token_digests(spark, path)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_rules.fit_weights(docs, quality_rules.trusted_ids(read_table(spark, sf_dir, "labels")))
    out = quality_rules.apply_rules(docs, weights)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("log_ratio", 6).alias("log_ratio"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    path = scratch_path(spark, "chat")
    chat.format_turns(rows).write.parquet(path)
    return chat.digests(chat.read_formatted(spark, path))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_components(read_table(spark, sf_dir, "embeddings"))


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.train(docs, read_table(spark, sf_dir, "labels"))
    out = rule_ensemble.score(docs, model)
    return out.select("doc_id", rule_ensemble.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_token_files": op5_token_files,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_extract": op7_html_extract,
    "op8_chat": op8_chat,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_rule_ensemble": op10_rule_ensemble,
    "op11_toxicity": op11_toxicity,
    "op12_importance_resample": op12_importance_resample,
}

def _control_pattern() -> str:
    """The strings that chat.escape marks, longest first, for a SQL regular expression."""
    strings = sorted((chat.OPEN, chat.BODY, chat.CLOSE, chat.ESCAPE, *chat.FOREIGN), key=len, reverse=True)
    return "|".join(re.sub(r"([\\|\[\]])", r"\\\1", s) for s in strings)


def _escaped(x: str) -> str:
    return rf"regexp_replace({x}, '({_control_pattern()})', '\\\1', 'g')"


_MARKS = len(chat.OPEN + chat.BODY + chat.CLOSE)
# the articles of these pages hold no nested menus or notices, so cutting them out by pattern gives the same text
_ARTICLE = r"regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _ARTICLE = f"replace({_ARTICLE}, '{_name}', '{_char}')"

ORACLE_SQL: dict[str, str] = {
    "op7_html_extract": rf"WITH t AS (SELECT page_id, url, trim(regexp_replace({_ARTICLE}, '\s+', ' ', 'g')) AS text FROM pages) SELECT page_id, url, text, length(text) AS n_chars FROM t",
    "op8_chat": rf"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS loss,
 sum(length({_escaped('role')}) + length({_escaped('text')}) + {_MARKS}) AS formatted_chars FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::bigint AS formatted_chars FROM g""",
    # all pairs by brute force: the index finds every link of these vectors
    "op9_vector_dedup": """WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.95),
c AS (SELECT vec_id AS a, vec_id AS r FROM u UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.a), m AS (SELECT a, min(r) AS component_id FROM c GROUP BY a)
SELECT m.a AS vec_id, (SELECT count(*) FROM l WHERE l.a = m.a) AS n_links, m.component_id, m.a = m.component_id AS kept FROM m""",
    # the checksum byte by byte from its table, once a distinct word
    "op12_importance_resample": rf"""WITH RECURSIVE b AS (SELECT range AS i, range::ubigint AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::ubigint) ELSE c >> 1 END, k + 1 FROM b WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM b WHERE k = 8),
w AS MATERIALIZED (SELECT o, id, word FROM (SELECT o, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
 FROM (SELECT 0 AS o, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark))),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM w)),
k AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(x), 2), lambda j: ('0x' || x[j:j + 1])::ubigint)), lambda a, c: xor(a >> 8, tab[(xor(a & 255, c) + 1)::bigint])), 4294967295::ubigint) % {importance.BUCKETS} AS bucket FROM h, crc),
g AS (SELECT bucket, count(*) FILTER (o = 0) AS s, count(*) FILTER (o = 1) AS t FROM w JOIN k USING (word) GROUP BY bucket), n AS (SELECT sum(s) AS s, sum(t) AS t FROM g),
gain AS (SELECT bucket, floor(1000 * ln((g.t + 1)::double * (n.s + {importance.BUCKETS}) / ((g.s + 1)::double * (n.t + {importance.BUCKETS}))))::bigint AS v FROM g, n),
f AS (SELECT id, count(*) AS n, floor(sum(v)::double / count(*))::bigint AS weight FROM w JOIN k USING (word) JOIN gain USING (bucket) WHERE o = 0 GROUP BY id),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('{importance.SEED}:' || doc_id), 8))::ubigint::double AS h FROM documents LEFT JOIN f ON id = doc_id),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint AS score FROM d),
r AS (SELECT *, CASE WHEN n_features >= {importance.LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {importance.LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= {importance.LEAST_WORDS}) OVER () AS m FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * m // 100 THEN place END AS rank FROM r""",
}

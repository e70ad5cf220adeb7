"""DuckDB SQL for the registered queries, on views named like the tables."""

from __future__ import annotations

from lexmill.functions.answers import CITATION, IRRELEVANT, NOTHING, RELEVANT, SAMPLE, SYSTEM_PROMPT, UNKNOWN
from lexmill.functions.html import ENTITIES, FOOTNOTE_MARKS
from lexmill.functions.text import FIRST_FROM, FIRST_TO, LAWS, STOP_WORDS, SYNONYMS
from lexmill.operators.outline import ACCEPTED, GAZETTE, OUTSIDE_NOTE, OUTSIDE_START, TABLE_START
from lexmill.params import DEFAULT as P


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(translate(coalesce({x}, ''), {lit(FIRST_FROM)}, {lit(FIRST_TO)}))), '[^a-z0-9]+', ' ', 'g'))"


STRIP = r"'^\s+|\s+$', '', 'g'"
CORPUS = r"""corpus AS (SELECT doc_id, upper(source) AS law, cast(doc_id AS varchar) AS article_no, left(string_split(coalesce(text, ''), chr(10))[1], 60) AS heading,
  coalesce(text, '') AS content, upper(source) || ' m. ' || cast(doc_id AS varchar) AS label FROM documents)"""
ASKED = "asked AS (SELECT item_id AS qid, text || CASE WHEN item_id % 5 = 0 THEN ' madde ' || cast(item_id * 7 AS varchar) ELSE '' END AS text FROM benchmark)"


def terms_of(source: str, name: str, text: str = "text") -> str:
    stops = ", ".join(map(lit, STOP_WORDS))
    return f"""{name}_w AS (SELECT qid, unnest(string_split(nt, ' ')) AS w, unnest(range(1, len(string_split(nt, ' ')) + 1)) AS pos FROM (SELECT qid, {norm(text)} AS nt FROM {source})),
{name}_t AS (SELECT qid, pos, CASE WHEN regexp_full_match(w, '[0-9]+') THEN w WHEN length(w) >= 6 THEN left(w, greatest(5, length(w) * 4 // 5)) || '*' ELSE w || '*' END AS term
  FROM {name}_w WHERE length(w) >= 2 AND w NOT IN ({stops})),
{name} AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY min(pos)) - 1 AS place FROM {name}_t GROUP BY qid, term)"""


POST = f"""tokens AS (SELECT doc_id, unnest(string_split({norm('content')} || ' ' || {norm('heading')} || ' ' || {norm('label')}, ' ')) AS token FROM corpus),
post AS (SELECT doc_id, token, count(*) AS tf FROM tokens WHERE token <> '' GROUP BY ALL),
lens AS (SELECT doc_id, sum(tf) AS n_tokens FROM post GROUP BY doc_id),
sizes AS (SELECT (SELECT count(*) FROM corpus) AS n, (SELECT sum(n_tokens) FROM lens)::double / (SELECT count(*) FROM corpus) AS average)"""


def found_of(name: str) -> str:
    return f"""{name}_m AS (SELECT t.term, v.token FROM (SELECT DISTINCT term FROM {name}) t JOIN (SELECT DISTINCT token FROM post) v
  ON CASE WHEN ends_with(t.term, '*') THEN starts_with(v.token, rtrim(t.term, '*')) ELSE v.token = t.term END),
{name}_f AS (SELECT m.term, p.doc_id, sum(p.tf) AS tf FROM {name}_m m JOIN post p ON m.token = p.token GROUP BY ALL),
{name}_df AS (SELECT t.term, coalesce(c.df, 0) AS df FROM (SELECT DISTINCT term FROM {name}) t LEFT JOIN (SELECT term, count(*) AS df FROM {name}_f GROUP BY term) c ON t.term = c.term)"""


def kept_of(name: str, out: str, limit: float = P.df_limit) -> str:
    return f"""{out}_k AS (SELECT t.qid, t.term, d.df, t.place, d.df <= greatest(1, cast(floor((SELECT n FROM sizes) * {limit}::double) AS bigint)) AS fits FROM {name} t JOIN {name}_df d ON t.term = d.term WHERE d.df > 0),
{out}_r AS (SELECT *, bool_or(fits) OVER (PARTITION BY qid) AS any_fits, row_number() OVER (PARTITION BY qid ORDER BY df, place) AS rk FROM {out}_k),
{out} AS (SELECT qid, term, df FROM {out}_r WHERE CASE WHEN any_fits THEN fits ELSE rk <= {P.rare_terms} END)"""


def bm25_of(name: str, kept: str, out: str, k: int = P.candidates) -> str:
    return f"""{out}_s AS (SELECT k.qid, f.doc_id, round(sum((CASE WHEN ln((s.n - k.df + 0.5::double) / (k.df + 0.5::double)) <= 0 THEN 1e-6::double ELSE ln((s.n - k.df + 0.5::double) / (k.df + 0.5::double)) END)
   * f.tf * 2.2::double / (f.tf + 1.2::double * (0.25::double + 0.75::double * l.n_tokens / s.average))), 6) AS score
  FROM {kept} k JOIN {name}_f f ON k.term = f.term JOIN lens l ON f.doc_id = l.doc_id CROSS JOIN sizes s GROUP BY ALL),
{out} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {out}_s QUALIFY rank <= {k})"""


COS = "round(list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) / sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 6)"
SIMS = f"sims AS (SELECT q.qid, b.vec_id AS doc_id, {COS} AS sim FROM asked q JOIN embeddings a ON a.vec_id = q.qid CROSS JOIN embeddings b)"


def vec_of(k: int = P.candidates) -> str:
    return f"vec AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_id) AS rank FROM sims QUALIFY rank <= {k})"


NUM = """num_n AS (SELECT qid, unnest(list_distinct(regexp_extract_all(text, '(?i)\\bmadde\\s*(\\d+)', 1))) AS number FROM asked),
num AS (SELECT n.qid, c.doc_id, row_number() OVER (PARTITION BY n.qid ORDER BY c.doc_id) AS rank FROM num_n n JOIN corpus c ON c.article_no = n.number)"""
FUSED = f"""adds AS (SELECT qid, doc_id, 'vector' AS source, {P.w_vector}::double / ({P.rrf_k} + rank) AS add, rank AS ord FROM vec
 UNION ALL SELECT qid, doc_id, 'lexical', {P.w_lexical}::double / ({P.rrf_k} + rank), 1000000 + rank FROM lex
 UNION ALL SELECT qid, doc_id, 'number', {P.w_number}::double / ({P.rrf_k} + rank), 2000000 + rank FROM num),
fused AS (SELECT qid, doc_id, round(sum(add), 6) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(ord) AS tie FROM adds GROUP BY qid, doc_id)"""
SYN = "syn AS (SELECT * FROM (VALUES " + ", ".join(f"({lit(k)}, {lit(' '.join(v))})" for k, v in SYNONYMS.items()) + ") v(k, words))"


def expand_of(source: str, name: str, text: str = "text") -> str:
    """{name}(qid, expanded): normalised text and the synonyms' words, unigram hits before bigram hits."""
    return f"""{name}_n AS (SELECT qid, {norm(text)} AS nt FROM {source}),
{name}_w AS (SELECT qid, unnest(string_split(nt, ' ')) AS w, unnest(range(1, len(string_split(nt, ' ')) + 1)) AS pos FROM {name}_n),
{name}_g AS (SELECT qid, 0 AS kind, pos, w AS k FROM {name}_w UNION ALL SELECT qid, 1, pos, w || ' ' || lead(w) OVER (PARTITION BY qid ORDER BY pos) FROM {name}_w),
{name}_a AS (SELECT g.qid, g.kind, g.pos, unnest(string_split(s.words, ' ')) AS word, unnest(range(1, len(string_split(s.words, ' ')) + 1)) AS pl FROM {name}_g g JOIN syn s ON g.k = s.k),
{name}_d AS (SELECT a.qid, a.word, min(a.kind * 1000000000 + a.pos * 1000 + a.pl) AS o FROM {name}_a a WHERE NOT EXISTS (SELECT 1 FROM {name}_w w WHERE w.qid = a.qid AND w.w = a.word) GROUP BY a.qid, a.word),
{name} AS (SELECT n.qid, n.nt || coalesce(' ' || d.added, '') AS expanded FROM {name}_n n LEFT JOIN (SELECT qid, string_agg(word, ' ' ORDER BY o) AS added FROM {name}_d GROUP BY qid) d ON n.qid = d.qid)"""


LEX_PLAIN = ",\n".join([CORPUS, ASKED, terms_of("asked", "terms"), POST, found_of("terms")])
LEX_SYN = ",\n".join([CORPUS, ASKED, SYN, expand_of("asked", "ex"), terms_of("ex", "terms", "expanded"), POST, found_of("terms")])
HYBRID = ",\n".join([LEX_SYN, kept_of("terms", "kept"), bm25_of("terms", "kept", "lex"), SIMS, vec_of(), NUM, FUSED]) + f""",
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tie, doc_id) AS rank FROM fused QUALIFY rank <= {P.top_k}),
gate AS (SELECT q.qid, coalesce((SELECT max(sim) FROM sims s WHERE s.qid = q.qid), 0) AS max_sim, EXISTS (SELECT 1 FROM num n WHERE n.qid = q.qid) AS by_number FROM asked q),
hybrid0 AS (SELECT b.*, coalesce(s.sim, 0) AS sim, g.max_sim, g.by_number OR g.max_sim >= {P.relevance_min} AS relevant, b.sources LIKE '%number%' AS isnum, round(coalesce(s.sim, 0), 4) >= g.max_sim * {P.context_ratio}::double AS near
  FROM best b JOIN gate g ON b.qid = g.qid LEFT JOIN sims s ON s.qid = b.qid AND s.doc_id = b.doc_id),
hybrid AS (SELECT *, CASE WHEN max_sim <= 0 THEN true WHEN bool_or(isnum) OVER (PARTITION BY qid) THEN isnum
  WHEN count_if(near) OVER (PARTITION BY qid) >= {P.context_min} THEN near ELSE rank <= {P.context_min} END AS in_context FROM hybrid0)"""

BODY_PLAIN = r"regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
BODY = rf"body0 AS (SELECT page_id, {BODY_PLAIN} AS h FROM pages), body AS (SELECT page_id, CASE WHEN regexp_matches(h, '(?is)<body[^>]*>.*</body>') THEN regexp_extract(h, '(?is)<body[^>]*>(.*)</body>', 1) ELSE h END AS body FROM body0)"


MARKED = """marked AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?i)(<p\\b[^>]*>[^<]*)', '\\1<sup>1</sup><span style="vertical-align: super">2</span><a href="#_ftn3">3</a>', 'g') AS html FROM pages)"""


def plain(x: str) -> str:
    for pattern in (FOOTNOTE_MARKS, r"(?is)<[^>]+>"):
        x = f"regexp_replace({x}, {lit(pattern)}, ' ', 'g')"
    for name, char in ENTITIES.items():
        x = f"replace({x}, {lit(name)}, {lit(char)})"
    return rf"trim(regexp_replace(replace({x}, chr(160), ' '), '\s+', ' ', 'g'))"


BLOCKS = BODY + rf""",
pieces AS (SELECT page_id, unnest(string_split(regexp_replace(body, '(?i)(<(?:h[1-6]|p)\b[^>]*>)', chr(1) || '\1', 'g'), chr(1))) AS x, unnest(range(len(string_split(regexp_replace(body, '(?i)(<(?:h[1-6]|p)\b[^>]*>)', chr(1) || '\1', 'g'), chr(1))))) AS pl FROM body),
opened AS (SELECT page_id, pl, lower(regexp_extract(x, '(?is)^<(h[1-6]|p)\b', 1)) AS tag, regexp_extract(x, '(?is)^<(?:h[1-6]|p)\b([^>]*)>', 1) AS attrs,
  regexp_replace(regexp_replace(x, '(?is)^<(h[1-6]|p)\b([^>]*)>', ''), '(?is)</(?:p|h[1-6])\s*>.*$', '') AS inner_html FROM pieces WHERE regexp_matches(x, '(?is)^<(h[1-6]|p)\b([^>]*)>')),
texts AS (SELECT page_id, pl, tag, regexp_extract(attrs, 'class=["'']?([A-Za-z0-9_-]+)', 1) AS css, contains(lower(attrs), 'center') AS centered, {plain('inner_html')} AS text_raw,
  {plain("array_to_string(regexp_extract_all(inner_html, '(?is)<(?:b|strong)" + chr(92) + "b[^>]*>(.*?)</(?:b|strong)" + chr(92) + "s*>', 1), ' ')")} AS bold FROM opened),
cleaned AS (SELECT *, trim(regexp_replace(regexp_replace(text_raw, '\[\d+\]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM texts WHERE NOT regexp_matches(css, '(?i)(footnotetext|footer)')),
blocks AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pl) - 1 AS pos, tag, css, centered, text, length({norm('bold')}) AS bold_chars, length({norm('text_raw')}) AS chars FROM cleaned WHERE text <> '')"""

ANSWERS = r"""answers AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN text || ' [ABC m. ' || conv_id || '] ve [ABC m.  ' || (conv_id + 1) || ']' WHEN 1 THEN 'DAYANAK: [ABC m. ' || conv_id || ']' || chr(10) || 'CEVAP: ' || text
  WHEN 2 THEN 'Bağlamda yok: ' || text WHEN 3 THEN '[ABC m. EK ' || conv_id || '/a] ' || text ELSE text END AS answer,
  'ABC m. ' || conv_id AS shown1, 'ABC m. EK ' || conv_id || '/A' AS shown2, conv_id % 7 <> 0 AS in_scope FROM conversations WHERE role = 'assistant')"""


def cited_of(source: str, text: str, name: str) -> str:
    return rf"""{name}_e AS (SELECT conv_id, turn, unnest(regexp_extract_all({text}, {lit(CITATION)}, 1)) AS a, unnest(regexp_extract_all({text}, {lit(CITATION)}, 2)) AS b, unnest(range(len(regexp_extract_all({text}, {lit(CITATION)}, 1)))) AS pl FROM {source}),
{name} AS (SELECT conv_id, turn, upper(a) || ' m. ' || upper(trim(regexp_replace(b, '\s+', ' ', 'g'))) AS cite, min(pl) AS pl FROM {name}_e GROUP BY ALL)"""


FLAGGED = ",\n".join([ANSWERS, cited_of("answers", "answer", "c0")]) + rf""",
net AS (SELECT a.*, CASE WHEN in_scope AND NOT contains(lower(answer), lower('{UNKNOWN}')) AND NOT EXISTS (SELECT 1 FROM c0 c WHERE c.conv_id = a.conv_id AND c.turn = a.turn) AND NOT contains(answer, '[' || shown1 || ']') AND NOT contains(answer, '[' || shown2 || ']')
  THEN regexp_replace(answer, '\s+$', '') || chr(10) || chr(10) || 'DAYANAK: [' || shown1 || '], [' || shown2 || ']' ELSE answer END AS final FROM answers a),
{cited_of('net', 'final', 'c1')},
flags AS (SELECT n.*, (SELECT count(*) FROM c1 c WHERE c.conv_id = n.conv_id AND c.turn = n.turn) AS n_cited, (SELECT count(*) FROM c1 c WHERE c.conv_id = n.conv_id AND c.turn = n.turn AND c.cite NOT IN (n.shown1, n.shown2)) AS n_bad,
  contains(lower(final), lower('{UNKNOWN}')) AS unknown FROM net n),
flagged AS (SELECT *, CASE WHEN n_bad > 0 THEN false WHEN NOT in_scope THEN unknown ELSE unknown OR n_cited > 0 END AS trusted FROM flags)"""

CHUNKS = r"""lines AS (SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pl, len(string_split(coalesce(text, ''), chr(10))) AS parts FROM documents),
chunks AS (SELECT source, doc_id AS article_no, upper(source) || ' m. ' || doc_id || CASE WHEN parts > 1 THEN ' (' || (pl + 1) || '/' || parts || ')' ELSE '' END AS label, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'h' END AS heading,
  CASE WHEN doc_id % 15 = 0 THEN NULL ELSE 't' END AS topic, pl + 1 AS part_no, parts, content FROM lines)"""
VECTOR_ASKED = f"sims AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, a.label AS own, b.label, {COS} AS sim FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0)"
HITS = VECTOR_ASKED + f""", best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_id) AS rank FROM sims WHERE qid <> doc_id QUALIFY rank <= {P.top_k}),
hits AS (SELECT q.vec_id AS qid, min(b.rank) AS first_hit FROM embeddings q LEFT JOIN best b ON b.qid = q.vec_id AND b.label = b.own WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id)"""
EVERY_HIT = HITS.replace(" WHERE a.vec_id % 100 = 0", "").replace(" WHERE q.vec_id % 100 = 0", "")  # every row asks
RATES = """coalesce(floor(1000 * avg(CASE WHEN first_hit <= 1 THEN 1.0::double ELSE 0 END) + 0.5 + 1e-6) / 10, 0) AS hit_at_1, coalesce(floor(1000 * avg(CASE WHEN first_hit <= 3 THEN 1.0::double ELSE 0 END) + 0.5 + 1e-6) / 10, 0) AS hit_at_3,
 coalesce(floor(1000 * avg(CASE WHEN first_hit <= 5 THEN 1.0::double ELSE 0 END) + 0.5 + 1e-6) / 10, 0) AS hit_at_5, coalesce(floor(avg(coalesce(1.0::double / first_hit, 0)) * 10000 + 0.5 + 1e-6) / 10000, 0) AS mrr, count_if(first_hit IS NULL) AS missed, count(*) AS n"""


def _share(test: str, among: str) -> str:
    return f"coalesce(floor(1000 * avg(CASE WHEN {among} THEN CASE WHEN {test} THEN 1.0::double ELSE 0 END END) + 0.5 + 1e-6) / 10, 0)"


def grid_sql(rows: list[tuple]) -> str:
    """rows as in plans.queries._grid."""
    most = max(r[0] for r in rows)
    parts = [CORPUS, ASKED, POST, SIMS, vec_of(most), NUM]
    if any(r[4] for r in rows):
        parts += [SYN, expand_of("asked", "ex")]
    ranked = ["SELECT qid, doc_id, 'vector' AS channel, '-' AS variant, rank FROM vec", "SELECT qid, doc_id, 'number', '-', rank FROM num"]
    for syn in sorted({r[4] for r in rows}):
        name = f"t{int(syn)}"
        parts += [terms_of("ex", name, "expanded") if syn else terms_of("asked", name), found_of(name)]
        for n, limit in enumerate(sorted({r[3] for r in rows if r[4] == syn})):
            parts += [kept_of(name, f"{name}k{n}", limit), bm25_of(name, f"{name}k{n}", f"{name}b{n}", most)]
            ranked.append(f"SELECT qid, doc_id, 'lexical', '{limit}{syn}', rank FROM {name}b{n}")
    values = ", ".join(f"({k}, {pool}, {wv}::double, {wl}::double, '{limit}{syn}')" for k, (pool, wv, wl, limit, syn) in enumerate(rows))
    return "WITH " + ",\n".join(parts) + f""",
ranked AS ({' UNION ALL '.join(ranked)}), params AS (SELECT * FROM (VALUES {values}) v(param_id, pool, wv, wl, variant)),
used AS (SELECT p.param_id, r.qid, r.doc_id, CASE r.channel WHEN 'vector' THEN p.wv WHEN 'lexical' THEN p.wl ELSE 3.0::double END / (60 + r.rank) AS add,
  CASE r.channel WHEN 'vector' THEN 0 WHEN 'lexical' THEN 1000000 ELSE 2000000 END + r.rank AS ord FROM params p JOIN ranked r ON (r.channel = 'lexical' AND r.variant = p.variant) OR r.channel <> 'lexical' WHERE r.channel = 'number' OR r.rank <= p.pool),
f AS (SELECT param_id, qid, doc_id, round(sum(add), 6) AS score, min(ord) AS tie FROM used GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY param_id, qid ORDER BY score DESC, tie, doc_id) AS rank FROM f QUALIFY rank <= 5),
h AS (SELECT p.param_id, q.qid, min(CASE WHEN x.label = y.label AND b.doc_id <> b.qid THEN b.rank END) AS first_hit FROM params p CROSS JOIN asked q LEFT JOIN b ON b.param_id = p.param_id AND b.qid = q.qid
  LEFT JOIN embeddings x ON x.vec_id = b.doc_id LEFT JOIN embeddings y ON y.vec_id = b.qid GROUP BY ALL)
SELECT param_id, {RATES} FROM h GROUP BY param_id"""


def _prompt_sql() -> str:
    def filled(template: str) -> str:
        out = lit(template)
        for name, value in (("n", "cast(n AS varchar)"), ("context", "context"), ("question", "trim(text)"), ("unknown", lit(UNKNOWN))):
            out = out.replace("{" + name + "}", f"' || {value} || '")
        return out

    rows = [(0, "system", lit(SYSTEM_PROMPT), "true"), (1, "user", lit(SAMPLE[0]), "relevant"), (2, "assistant", lit(SAMPLE[1]), "relevant"), (3, "user", filled(RELEVANT), "relevant"), (1, "user", filled(IRRELEVANT), "NOT relevant")]
    union = " UNION ALL ".join(f"SELECT qid, {pl} AS pl, '{role}' AS role, {content} AS content FROM ctx WHERE {test}" for pl, role, content, test in rows)
    return f"""WITH {HYBRID}, used AS (SELECT h.qid, count(*) AS n, bool_or(h.relevant) AS relevant, string_agg('[' || c.label || ']' || CASE WHEN c.heading <> '' THEN ' ' || c.heading ELSE '' END || chr(10) || c.content, chr(10) || chr(10) ORDER BY h.rank) AS context
  FROM hybrid h JOIN corpus c ON h.doc_id = c.doc_id WHERE h.in_context GROUP BY h.qid),
ctx AS (SELECT q.qid, q.text, coalesce(u.n, 0) AS n, coalesce(u.relevant, false) AS relevant, coalesce(u.context, {lit(NOTHING)}) AS context FROM asked q LEFT JOIN used u ON q.qid = u.qid), m AS ({union})
SELECT qid, pl AS place, role, md5(content) AS md5, length(content) AS chars FROM m"""


CHUNKED = rf"""WITH RECURSIVE par AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS f, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, len(string_split(text, chr(10))) AS pars FROM documents),
sen AS (SELECT doc_id, pos, unnest(x) AS c, unnest(range(1, len(x) + 1)) AS k, len(x) AS n FROM (SELECT doc_id, pos, string_split(regexp_replace(f, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM par WHERE length(f) > {P.chunk_chars})),
inner_r AS (SELECT doc_id, pos, k, n, c AS buf, length(c) + 1 AS m, []::varchar[] AS out FROM sen WHERE k = 1
 UNION ALL SELECT s.doc_id, s.pos, s.k, s.n, CASE WHEN r.m + length(s.c) > {P.chunk_chars} THEN s.c ELSE r.buf || ' ' || s.c END, CASE WHEN r.m + length(s.c) > {P.chunk_chars} THEN 0 ELSE r.m END + length(s.c) + 1,
  CASE WHEN r.m + length(s.c) > {P.chunk_chars} THEN list_append(r.out, r.buf) ELSE r.out END FROM inner_r r JOIN sen s ON s.doc_id = r.doc_id AND s.pos = r.pos AND s.k = r.k + 1),
long_par AS (SELECT doc_id, pos, list_append(out, buf) AS parts FROM inner_r WHERE k = n),
step AS (SELECT p.*, l.parts FROM par p LEFT JOIN long_par l ON p.doc_id = l.doc_id AND p.pos = l.pos),
outer_r AS (SELECT DISTINCT doc_id, 0::bigint AS pos, pars, false AS has, '' AS buf, '' AS tail, 0::bigint AS n, []::varchar[] AS out FROM par
 UNION ALL SELECT s.doc_id, s.pos, s.pars, s.parts IS NULL,
  CASE WHEN s.parts IS NOT NULL THEN '' WHEN NOT r.has THEN s.f WHEN r.n + length(s.f) > {P.chunk_chars} THEN CASE WHEN r.tail = '' THEN '' ELSE r.tail || chr(10) END || s.f ELSE r.buf || chr(10) || s.f END,
  CASE WHEN s.parts IS NOT NULL THEN '' ELSE right(s.f, {P.chunk_overlap}) END,
  CASE WHEN s.parts IS NOT NULL THEN 0 WHEN r.has AND r.n + length(s.f) > {P.chunk_chars} THEN length(r.tail) + length(s.f) + 1 ELSE r.n + length(s.f) + 1 END,
  CASE WHEN s.parts IS NOT NULL THEN list_concat(CASE WHEN r.has THEN list_append(r.out, r.buf) ELSE r.out END, s.parts) WHEN r.has AND r.n + length(s.f) > {P.chunk_chars} THEN list_append(r.out, r.buf) ELSE r.out END
  FROM outer_r r JOIN step s ON s.doc_id = r.doc_id AND s.pos = r.pos + 1),
done AS (SELECT doc_id, CASE WHEN has THEN list_append(out, buf) ELSE out END AS parts FROM outer_r WHERE pos = pars),
each AS (SELECT doc_id, regexp_replace(x, {STRIP}) AS chunk, k FROM (SELECT doc_id, unnest(parts) AS x, unnest(range(len(parts))) AS k FROM done)),
kept AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS part_no, count(*) OVER (PARTITION BY doc_id) AS parts FROM each WHERE chunk <> ''),
whole AS (SELECT doc_id, text AS chunk, 1 AS part_no, 1 AS parts FROM documents d WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = d.doc_id))
SELECT doc_id, part_no, parts, length(chunk) AS chars, md5(chunk) AS md5 FROM (SELECT * FROM kept UNION ALL SELECT doc_id, chunk, part_no, parts FROM whole)"""

OUTLINED = rf"""WITH l AS (SELECT doc_id AS source_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
b0 AS (SELECT *, CASE WHEN pos = 20 AND source_id % 3 = 1 THEN -1 WHEN pos = 40 AND source_id % 5 = 2 THEN -2 ELSE (pos + source_id) % 12 END AS k FROM l),
b1 AS (SELECT source_id, pos, k, CASE WHEN k = -1 THEN '6098 {OUTSIDE_START}' WHEN k = -2 THEN '6098 {TABLE_START} LİSTE' WHEN k = 0 THEN 'BİRİNCİ BÖLÜM' WHEN k = 2 THEN 'A. ' || line WHEN k = 3 THEN 'I. ' || line
  WHEN k = 4 THEN 'MADDE ' || (pos + 1) || '- ' || line WHEN k = 6 THEN 'GEÇİCİ MADDE ' || (pos + 1) || '- ' || line WHEN k = 9 THEN 'EK MADDE ' || (pos + 1) || '/a- ' || line WHEN k = 8 THEN '2. ' || line WHEN k = 11 THEN 'İKİNCİ AYIRIM' ELSE trim(line) END AS text FROM b0),
b AS (SELECT * FROM (SELECT *, min(CASE WHEN k = -2 OR (pos = 30 AND source_id % 5 = 3) THEN pos END) OVER (PARTITION BY source_id) AS stop FROM b1 WHERE text <> '') WHERE stop IS NULL OR pos < stop),
e AS (SELECT *, CASE WHEN k IN (0, 11) THEN 'structure' WHEN k IN (4, 6, 9) THEN 'article' WHEN k IN (2, 3, 8) THEN 'heading' ELSE 'body' END AS kind, lag(k) OVER (PARTITION BY source_id ORDER BY pos) IN (0, 11) AS waited, lag(text) OVER (PARTITION BY source_id ORDER BY pos) AS label,
  lag(k) OVER (PARTITION BY source_id ORDER BY pos) AS was FROM b WHERE k >= 0),
s AS (SELECT source_id, pos::double AS p, CASE WHEN waited AND kind IN ('heading', 'body') THEN 'name' ELSE kind END AS kind, text, CASE WHEN waited AND kind IN ('heading', 'body') THEN was END AS lev, label || ' ' || text AS val FROM e
 UNION ALL SELECT source_id, pos - 0.5, 'name', text, was, label FROM e WHERE waited AND kind IN ('article', 'structure') UNION ALL SELECT source_id, pos, 'outside', text, NULL, NULL FROM b WHERE k = -1),
m AS (SELECT *, CASE WHEN kind = 'heading' THEN CASE WHEN regexp_matches(text, '^(A|I|2)[.] +\S') THEN CASE text[1] WHEN 'A' THEN 1 WHEN 'I' THEN 2 ELSE 3 END ELSE 0 END END AS depth FROM s),
f AS (SELECT *, max(CASE WHEN kind IN ('structure', 'name', 'outside') OR depth = 0 THEN p END) OVER w AS reset, max(CASE WHEN kind IN ('structure', 'outside') THEN p END) OVER w AS closed, max(CASE WHEN kind = 'article' THEN p END) OVER w AS art, max(CASE WHEN kind = 'outside' THEN p END) OVER w AS out,
  max(CASE WHEN depth IN (0, 1) THEN p END) OVER w AS h1, last_value(CASE WHEN depth IN (0, 1) THEN text END IGNORE NULLS) OVER w AS t1, max(CASE WHEN depth = 2 THEN p END) OVER w AS h2, last_value(CASE WHEN depth = 2 THEN text END IGNORE NULLS) OVER w AS t2,
  max(CASE WHEN depth = 3 THEN p END) OVER w AS h3, last_value(CASE WHEN depth = 3 THEN text END IGNORE NULLS) OVER w AS t3, max(CASE WHEN lev = 0 THEN p END) OVER w AS s3, last_value(CASE WHEN lev = 0 THEN val END IGNORE NULLS) OVER w AS v3,
  max(CASE WHEN lev = 11 THEN p END) OVER w AS s4, last_value(CASE WHEN lev = 11 THEN val END IGNORE NULLS) OVER w AS v4 FROM m WINDOW w AS (PARTITION BY source_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT source_id, p, text[1] AS first, regexp_extract(text, 'MADDE (\d+)', 1) AS no, CASE WHEN out IS NOT NULL THEN '{OUTSIDE_NOTE}' ELSE '' END AS note, row_number() OVER (PARTITION BY source_id ORDER BY p) AS ordinal, CASE WHEN h1 >= coalesce(reset, -1) THEN t1 END AS x1, CASE WHEN h2 > greatest(coalesce(reset, -1), coalesce(h1, -1)) THEN t2 END AS x2,
  CASE WHEN h3 > greatest(coalesce(reset, -1), coalesce(h1, -1), coalesce(h2, -1)) THEN t3 END AS x3, coalesce(v3, '') AS chapter, CASE WHEN s4 > coalesce(s3, -1) THEN v4 ELSE '' END AS section FROM f WHERE kind = 'article'),
t AS (SELECT source_id, art AS p, count(*) AS paragraphs, md5(string_agg(said, chr(10) ORDER BY q)) AS md5 FROM (SELECT source_id, art, p AS q, CASE WHEN kind = 'article' THEN trim(regexp_replace(text, '^(GEÇİCİ |EK )?MADDE \d+(/a)?\s*[-–—]?\s*', '')) ELSE text END AS said FROM f WHERE kind IN ('article', 'body') AND art > coalesce(closed, -1)) WHERE said <> '' GROUP BY ALL)
SELECT a.source_id, CASE first WHEN 'G' THEN 'GEÇİCİ ' || no WHEN 'E' THEN 'EK ' || no || '/A' ELSE no END AS article_no, CASE first WHEN 'G' THEN 'gecici' WHEN 'E' THEN 'ek' ELSE 'madde' END AS kind, coalesce(x3, x2, x1, '') AS heading, concat_ws(' > ', x1, x2, x3) AS topic, chapter, section, note, ordinal, paragraphs, md5
FROM a JOIN t ON a.source_id = t.source_id AND a.p = t.p"""

CLEANED = rf"""WITH {ANSWERS}, c AS (SELECT conv_id, turn, '[ABC m. 1] I. Genel' || chr(10) || 'kopya satır' || chr(10) || chr(10) || '**Özetle:** ' || answer AS t FROM answers),
g AS (SELECT *, trim(regexp_extract(t, '(?im)^[ 	]*\**[ 	]*dayanak[ 	]*\**[ 	]*:[ 	]*\**(.*)$', 1)) AS grounds, regexp_replace(t, '(?im)^[ 	]*\**[ 	]*dayanak[ 	]*\**[ 	]*:[ 	]*\**(.*)$
?', '') AS r0 FROM c),
r AS (SELECT *, regexp_replace(r0, '(?ims)\A.*?^\s*\**\s*cevap\s*\**\s*:\s*\**\s*', '') AS rest FROM g),
n AS (SELECT conv_id, turn, unnest(string_split(rest, chr(10))) AS line, unnest(range(len(string_split(rest, chr(10))))) AS i FROM r),
h AS (SELECT *, CASE WHEN trim(line) = '' THEN 0 WHEN regexp_matches(trim(line), '^\[[^\]]{{3,60}}\](?:\s*(?:[IVXLC]+|\d+|[A-ZÇĞİÖŞÜ])\s*[.)]\s*[^
]{{0,60}})?\s*$') AND NOT regexp_matches(trim(line), '[.!?]$') THEN 1 END AS ev FROM n),
k AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) AS inside FROM h), f AS (SELECT conv_id, turn, min(i) AS first FROM k WHERE ev IS NULL AND inside = 0 GROUP BY ALL),
j AS (SELECT n.conv_id, n.turn, string_agg(n.line, chr(10) ORDER BY n.i) AS body FROM n JOIN f ON n.conv_id = f.conv_id AND n.turn = f.turn AND n.i >= f.first GROUP BY ALL),
z AS (SELECT r.conv_id, r.turn, grounds, regexp_replace(regexp_replace(regexp_replace(CASE WHEN trim(coalesce(body, '')) = '' THEN rest ELSE body END, {STRIP}), '(?i)^\s*(\*\*)?\s*(özet|özetle|sonuç|yanıt)\s*(\*\*)?\s*:\s*(\*\*)?\s*', ''), {STRIP}) AS x FROM r LEFT JOIN j ON r.conv_id = j.conv_id AND r.turn = j.turn)
SELECT conv_id, turn, CASE WHEN grounds <> '' AND NOT contains(x, grounds) THEN regexp_replace(x || chr(10) || chr(10) || 'DAYANAK: ' || grounds, {STRIP}) ELSE x END AS answer FROM z"""

# The digest's initial state, and where in each round's order of message words the first one stands.
BLAKE_IV = (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1, 0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)
BLAKE_PLACE = (0, 10, 3, 13, 1, 4, 8, 9, 6, 15, 0, 10)


def digest_of(grams: str, dims: int = 512) -> str:
    """bucket(gram, dim): the 4-byte BLAKE2b digest of each of {grams}(gram), of at most 7 ASCII characters, modulo dims.

    A gram fills part of the first message word and the others are zero, so of each round's sixteen words only the place
    of the first one matters. 96 steps over the state as a list; a step turns four of its words.
    """
    word = lambda x: f"{x}::uhugeint"
    full = word((1 << 64) - 1)
    turned = lambda x, n: f"((({x}) >> {n}) | ((({x}) << {64 - n}) & {full}))"
    first = [BLAKE_IV[0] ^ 0x01010004, *BLAKE_IV[1:], *BLAKE_IV]
    first[14] ^= (1 << 64) - 1
    state = ", ".join(f"xor({word(v)}, length(gram)::uhugeint)" if k == 12 else word(v) for k, v in enumerate(first))
    return f"""m0 AS (SELECT gram, list_sum([ord(gram[i])::uhugeint << ((i - 1) * 8)::uhugeint FOR i IN range(1, length(gram) + 1)])::uhugeint AS m FROM (SELECT DISTINCT gram FROM {grams})),
steps AS (SELECT k, g, CASE WHEN g < 4 THEN g ELSE g - 4 END + 1 AS a, CASE WHEN g < 4 THEN g + 4 ELSE 4 + (g - 3) % 4 END + 1 AS b, CASE WHEN g < 4 THEN g + 8 ELSE 8 + (g - 2) % 4 END + 1 AS c, CASE WHEN g < 4 THEN g + 12 ELSE 12 + (g - 1) % 4 END + 1 AS d,
  spot = 2 * g AS x, spot = 2 * g + 1 AS y FROM (SELECT range AS k, range % 8 AS g, {list(BLAKE_PLACE)}[range // 8 + 1] AS spot FROM range(96))),
run AS (SELECT gram, coalesce(m, 0::uhugeint) AS m, 0::bigint AS k, [{state}] AS v FROM m0
 UNION ALL SELECT gram, m, k + 1, list_transform(v, lambda e, i: CASE i WHEN a THEN a2 WHEN b THEN b2 WHEN c THEN c2 WHEN d THEN d2 ELSE e END) FROM (SELECT *, {turned('xor(b1, c2)', 63)} AS b2 FROM (SELECT *, (c1 + d2) & {full} AS c2 FROM (SELECT *, {turned('xor(d1, a2)', 16)} AS d2 FROM (
  SELECT *, (a1 + b1 + CASE WHEN y THEN m ELSE 0::uhugeint END) & {full} AS a2 FROM (SELECT *, {turned('xor(v[b], c1)', 24)} AS b1 FROM (SELECT *, (v[c] + d1) & {full} AS c1 FROM (SELECT *, {turned('xor(v[d], a1)', 32)} AS d1 FROM (
  SELECT run.gram, run.m, run.v, steps.*, (run.v[a] + run.v[b] + CASE WHEN x THEN run.m ELSE 0::uhugeint END) & {full} AS a1 FROM run JOIN steps ON steps.k = run.k))))))))),
bucket AS (SELECT gram, ((h & 255) * 16777216 + ((h >> 8) & 255) * 65536 + ((h >> 16) & 255) * 256 + ((h >> 24) & 255)) % {dims} AS dim FROM (SELECT gram, (xor(xor({word(first[0])}, v[1]), v[9]) & 4294967295::uhugeint)::bigint AS h FROM run WHERE k = 96))"""


HASHED = f"""WITH RECURSIVE n AS (SELECT item_id, {norm('text')} AS t FROM benchmark), grams AS (SELECT item_id, unnest(CASE WHEN length(t) < 3 THEN [t] ELSE [substring(t, i, 3) FOR i IN range(1, length(t) - 1)] END) AS gram FROM n),
{digest_of('grams')}, c AS (SELECT item_id, dim, count(*) AS n FROM grams JOIN bucket USING (gram) GROUP BY ALL)
SELECT item_id, dim::int AS dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM c"""

NUMBER_LINE = "'Madde ' || item_id || '/A ve TBK ' || (item_id + 1) || ' ile ' || (item_id % 9) || '. maddesi, m. ' || item_id || ' ' || text"


def sql() -> dict[str, str]:
    from lexmill.plans.queries import ABLATION, GRID_LIMITS, GRID_POOLS, GRID_WEIGHTS

    keys = "[" + ", ".join(lit(k) for k in SYNONYMS) + "]"
    statute = f"({keys}[(item_id * 3 % {len(SYNONYMS)} + 1)::int] || ' nedir ' || {keys}[(item_id * 7 % {len(SYNONYMS)} + 1)::int] || ' ' || text)"
    kind = "CASE WHEN doc_id % 11 = 0 THEN 'gecici' WHEN doc_id % 13 = 0 THEN 'ek' ELSE 'madde' END"
    return {
        "normalize_text": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
        "clean_text": rf"SELECT doc_id, regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(8203), ''), '[ \t]+', ' ', 'g'), {STRIP}) AS clean FROM documents",
        "content_hash": "SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1",
        "page_admission": "SELECT page_id, strlen(coalesce(html, '')) >= 4000 AND contains(upper(html), '</ARTICLE>') AS admitted, CASE WHEN strlen(coalesce(html, '')) < 4000 THEN 'short' WHEN NOT contains(upper(html), '</ARTICLE>') THEN 'no marker' ELSE '' END AS reason FROM pages",
        "page_body": f"WITH {BODY} SELECT page_id, body FROM body",
        "page_text": f"WITH {BODY} SELECT page_id, {plain('body')} AS text FROM body",
        "page_notes": f"WITH {BODY.replace('FROM pages)', 'FROM marked)').replace('body0 AS', MARKED + ', body0 AS', 1)} SELECT page_id, {plain('body')} AS text FROM body",
        "page_stream": f"WITH {BLOCKS} SELECT page_id, pos, tag, css, centered, text FROM blocks",
        "source_urls": "SELECT doc_id, 'https://example.org/file/' || (doc_id % 3 + 1) || '.' || (doc_id % 5 + 1) || '.' || doc_id || '.htm' AS url FROM documents",
        "page_blocks": f"WITH {BLOCKS} SELECT page_id, pos, tag, css, centered, text FROM blocks",
        "page_headings": rf"""WITH {BLOCKS} SELECT page_id, count_if(CASE WHEN starts_with(tag, 'h') OR centered OR regexp_matches(css, '(?i)^stil') THEN true WHEN bold_chars > 0 AND bold_chars >= 0.9 * chars THEN true
 WHEN regexp_matches(css, '(?i)title|heading') THEN NOT regexp_matches(text, '[.!?;:]$') AND length(text) <= 60 ELSE false END) AS headings, count(*) AS blocks, sum(chars) AS chars, sum(bold_chars) AS bold_chars FROM blocks GROUP BY page_id""",
        "sentence_split": r"WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents) SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS sentence FROM s",
        "extract_numbers": rf"""WITH q AS (SELECT item_id, {NUMBER_LINE} AS line FROM benchmark),
n AS (SELECT item_id, 1 AS k, unnest(regexp_extract_all(line, '(?i)\bmadde\s*(\d+)\s*(?:/\s*([a-zçğıöşü]))?', 1)) AS a, unnest(regexp_extract_all(line, '(?i)\bmadde\s*(\d+)\s*(?:/\s*([a-zçğıöşü]))?', 2)) AS b, unnest(range(len(regexp_extract_all(line, '(?i)\bmadde\s*(\d+)\s*(?:/\s*([a-zçğıöşü]))?', 1)))) AS pl FROM q
 UNION ALL SELECT item_id, 2, unnest(regexp_extract_all(line, '(?i)\bm\s*\.?\s*(\d+)\s*(?:/\s*([a-zçğıöşü]))?', 1)), unnest(regexp_extract_all(line, '(?i)\bm\s*\.?\s*(\d+)\s*(?:/\s*([a-zçğıöşü]))?', 2)), unnest(range(len(regexp_extract_all(line, '(?i)\bm\s*\.?\s*(\d+)\s*(?:/\s*([a-zçğıöşü]))?', 1)))) FROM q
 UNION ALL SELECT item_id, 3, unnest(regexp_extract_all(line, '(?i)\b(\d+)\s*\.?\s*madde', 1)), '', unnest(range(len(regexp_extract_all(line, '(?i)\b(\d+)\s*\.?\s*madde', 1)))) FROM q
 UNION ALL SELECT item_id, 4, unnest(regexp_extract_all(line, '(?i)\b(?:{LAWS})\s*[.:]?\s*(\d+)', 1)), '', unnest(range(len(regexp_extract_all(line, '(?i)\b(?:{LAWS})\s*[.:]?\s*(\d+)', 1)))) FROM q),
d AS (SELECT item_id, CASE WHEN coalesce(b, '') = '' THEN a ELSE a || '/' || lower(b) END AS number, min(k * 1000 + pl) AS o FROM n GROUP BY ALL)
SELECT q.item_id, (SELECT string_agg(number, ',' ORDER BY o) FROM d WHERE d.item_id = q.item_id) AS numbers, upper(regexp_extract(line, '(?i)\b({LAWS})\b', 1)) AS law FROM q""",
        "query_terms": f"WITH asked AS (SELECT item_id AS qid, text FROM benchmark), {terms_of('asked', 'terms')} SELECT qid AS item_id, place, term FROM terms",
        "fts_expression": f"WITH asked AS (SELECT item_id AS qid, text FROM benchmark), {terms_of('asked', 'terms')} SELECT item_id, coalesce((SELECT string_agg(term, ' OR ' ORDER BY place) FROM terms WHERE qid = item_id), '') AS expression FROM benchmark",
        "synonym_expand": f"WITH asked AS (SELECT item_id AS qid, {statute} AS text FROM benchmark), {SYN}, {expand_of('asked', 'ex')} SELECT qid AS item_id, expanded FROM ex",
        "search_fields": f"WITH {CORPUS} SELECT doc_id, {norm('content')} AS content_norm, {norm('heading')} AS heading_norm, {norm('label')} AS label_norm FROM corpus",
        "citation_label": f"""WITH {CORPUS} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN law || '''ya işlenemeyen hüküm — ' || CASE WHEN {kind} = 'gecici' THEN 'Geçici m. ' ELSE 'm. ' END || article_no
 ELSE law || ' m. ' || CASE {kind} WHEN 'gecici' THEN 'GEÇİCİ ' WHEN 'ek' THEN 'EK ' ELSE '' END || article_no END || CASE WHEN length(content) // {P.chunk_chars} + 1 > 1 THEN ' (1/' || (length(content) // {P.chunk_chars} + 1) || ')' ELSE '' END AS label FROM corpus""",
        "chunk_documents": CHUNKED,
        "outline_articles": OUTLINED,
        "clean_answer": CLEANED,
        "context_header": f"""WITH {CORPUS} SELECT doc_id, concat_ws(chr(10), 'Law ' || law || ' (6098) — ' || label, CASE WHEN heading <> '' THEN 'Kenar başlığı: ' || heading END, CASE WHEN doc_id % 3 <> 0 THEN 'Konu: A. > ' || heading END,
 CASE WHEN doc_id % 7 = 0 THEN 'Not: İŞLENEMEYEN HÜKÜM' END) || chr(10) || '---' || chr(10) || content AS embedding_text FROM corpus""",
        "header_meta": rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
h AS (SELECT doc_id AS source_id, string_agg(CASE WHEN pos = doc_id % 45 THEN line || ' Kabul Tarihi : ' || (doc_id % 28 + 1) || '/1/2011 Resmî Gazete : Tarih : 4/2/' || (doc_id % 30 + 1990) || ' Sayı : ' || doc_id ELSE line END, ' ' ORDER BY pos) AS t FROM l WHERE pos < 40 GROUP BY doc_id)
SELECT source_id, regexp_extract(t, {lit(ACCEPTED)}, 1) AS accepted, CASE WHEN regexp_extract(t, {lit(GAZETTE)}, 1) <> '' THEN regexp_extract(t, {lit(GAZETTE)}, 1) || ' tarihli, ' || regexp_extract(t, {lit(GAZETTE)}, 2) || ' sayılı Resmî Gazete' ELSE '' END AS gazette FROM h""",
        "chunk_source_join": f"WITH {CORPUS}, s AS (SELECT upper(source) AS law, min(doc_id) AS source_id, count(*) AS source_docs FROM documents GROUP BY 1) SELECT c.doc_id, c.law, s.source_id, s.source_docs, c.label FROM corpus c JOIN s ON c.law = s.law",
        "semi_delete": "SELECT source, count(*) AS docs, max(doc_id) AS last_doc FROM documents GROUP BY source HAVING min(doc_id) % 3 <> 0",
        "upsert_latest": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels UNION ALL SELECT doc_id + 1000000, quality, toxic FROM labels",
        "latest_version": "SELECT conv_id, role, turn, length(text) AS chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) = 1",
        "lookup_by_key": f"WITH {CORPUS} SELECT b.item_id AS qid, c.doc_id, c.label FROM benchmark b JOIN corpus c ON c.doc_id = b.item_id * 3",
        "document_frequency": f"WITH {LEX_PLAIN} SELECT term, df FROM terms_df",
        "df_filter": f"WITH {LEX_PLAIN}, {kept_of('terms', 'kept')} SELECT qid, term, df FROM kept",
        "bm25_search": f"WITH {LEX_PLAIN}, {kept_of('terms', 'kept')}, {bm25_of('terms', 'kept', 'lex')} SELECT qid, doc_id, score, rank FROM lex",
        "vector_search": f"WITH {VECTOR_ASKED} SELECT qid, doc_id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_id) AS rank FROM sims QUALIFY rank <= {P.candidates}",
        "hash_embedding": HASHED,
        "number_search": f"WITH {CORPUS}, {ASKED}, {NUM} SELECT qid, doc_id, rank FROM num",
        "rrf_fusion": f"WITH {LEX_PLAIN}, {kept_of('terms', 'kept')}, {bm25_of('terms', 'kept', 'lex')}, {SIMS}, {vec_of()}, {NUM}, {FUSED} SELECT qid, doc_id, score, sources, tie FROM fused",
        "relevance_gate": f"""WITH {CORPUS}, {ASKED}, {SIMS}, {NUM}, g AS (SELECT q.qid, coalesce((SELECT max(sim) FROM sims s WHERE s.qid = q.qid AND s.doc_id <> s.qid), 0) AS max_sim, EXISTS (SELECT 1 FROM num n WHERE n.qid = q.qid) AS by_number FROM asked q)
SELECT qid, max_sim, by_number OR max_sim >= {P.relevance_min} AS relevant FROM g""",
        "hybrid_search": f"WITH {HYBRID} SELECT qid, rank, doc_id, score, sources, round(sim, 4) AS sim, relevant FROM hybrid",
        "context_filter": f"WITH {HYBRID} SELECT qid, rank, doc_id, in_context FROM hybrid",
        "build_prompt": _prompt_sql(),
        "message_rewrite": r"""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND NOT contains(text, '/no_think') THEN rtrim(text) || ' /no_think' ELSE text END AS content FROM conversations),
s AS (SELECT conv_id, string_agg(content, chr(10) || chr(10) ORDER BY turn) AS sys FROM m WHERE role = 'system' GROUP BY conv_id), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pl, count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS users FROM m WHERE role <> 'system'),
j AS (SELECT r.*, s.sys, bool_or(role = 'user') OVER (PARTITION BY r.conv_id) AS has_user FROM r LEFT JOIN s ON r.conv_id = s.conv_id)
SELECT conv_id, pl + CASE WHEN sys IS NOT NULL AND NOT has_user THEN 1 ELSE 0 END AS place, role, CASE WHEN role = 'user' AND users = 1 AND sys IS NOT NULL THEN sys || chr(10) || chr(10) || '---' || chr(10) || chr(10) || content ELSE content END AS content FROM j
UNION ALL SELECT s.conv_id, 0, 'user', s.sys FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = s.conv_id AND r.role = 'user')""",
        "strip_think": rf"SELECT conv_id, turn, regexp_replace(regexp_replace('<think>' || left(text, 50) || chr(10) || '</think>' || chr(10) || ' ' || text || ' <THINK>x</THINK> ', '(?is)<think>.*?</think>\s*', '', 'g'), {STRIP}) AS answer FROM conversations",
        "repetition_loop": f"""WITH t AS (SELECT doc_id, text AS a, text || repeat(left(text, 60), 3) AS b FROM documents)
SELECT doc_id, length(a) >= {P.loop_tail} AND (length(a) - length(replace(a, right(a, {P.loop_tail}), ''))) / {P.loop_tail}.0 >= {P.loop_times} AS loops, length(b) >= {P.loop_tail} AND (length(b) - length(replace(b, right(b, {P.loop_tail}), ''))) / {P.loop_tail}.0 >= {P.loop_times} AS made_to_loop FROM t""",
        "stream_budget": f"WITH p AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) SELECT conv_id, count(*) AS pieces, sum(length(text)) AS chars FROM p WHERE before < {P.answer_chars} GROUP BY conv_id",
        "extract_citations": f"WITH {ANSWERS}, {cited_of('answers', 'answer', 'c0')} SELECT a.conv_id, a.turn, coalesce((SELECT string_agg(cite, ';' ORDER BY pl) FROM c0 c WHERE c.conv_id = a.conv_id AND c.turn = a.turn), '') AS citations FROM answers a",
        "unsupported_citations": f"WITH {ANSWERS}, {cited_of('answers', 'answer', 'c0')} SELECT a.conv_id, a.turn, coalesce((SELECT string_agg(cite, ';' ORDER BY pl) FROM c0 c WHERE c.conv_id = a.conv_id AND c.turn = a.turn AND c.cite NOT IN (a.shown1, a.shown2)), '') AS unsupported FROM answers a",
        "citation_safety_net": f"WITH {FLAGGED} SELECT conv_id, turn, final AS answer FROM flagged",
        "answer_flags": f"WITH {FLAGGED} SELECT conv_id, turn, unknown, n_bad > 0 AS has_unsupported, trusted, final <> answer AS auto_cited FROM flagged",
        "answer_metrics": f"""WITH {FLAGGED} SELECT count(*) AS answers, coalesce(floor(1000 * avg(CASE WHEN in_scope AND n_cited > 0 THEN 1.0::double ELSE 0 END) + 0.5 + 1e-6) / 10, 0) AS cited_percent, count_if(n_bad > 0) AS with_unsupported, count_if(NOT in_scope AND unknown) AS refused,
 coalesce(floor(1000 * avg(CASE WHEN CASE WHEN in_scope THEN trusted AND NOT unknown ELSE unknown END THEN 1.0::double ELSE 0 END) + 0.5 + 1e-6) / 10, 0) AS success_percent, count_if(final <> answer) AS auto_cited FROM flagged""",
        "corpus_stats": f"WITH {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT source) AS sources, (SELECT count(*) FROM (SELECT DISTINCT source, article_no FROM chunks)) AS articles, (SELECT count(*) FROM embeddings) AS vectors, (SELECT max(len(embedding)) FROM embeddings) AS dim FROM chunks",
        "corpus_integrity": rf"""WITH {CHUNKS} SELECT count(*) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT source, article_no FROM chunks)) AS articles, count_if(length(content) = 0) AS empty, count_if(length(content) BETWEEN 1 AND 39) AS short, count_if(regexp_matches(content, 'MADDE \d+\s*[-–]')) AS contaminated,
 count_if(coalesce(heading, '') = '') AS no_heading, count_if(coalesce(topic, '') = '') AS no_topic, round(avg(length(content)), 1) AS mean_chars, max(length(content)) AS longest, min(length(content)) AS shortest,
 (SELECT count(*) FROM (SELECT source, article_no FROM chunks GROUP BY ALL HAVING count(*) > 1 AND max(parts) <= 1)) AS repeated_numbers, (SELECT count(*) FROM (SELECT label FROM chunks GROUP BY label HAVING count(*) > 1)) AS repeated_labels FROM chunks""",
        "missing_numbers": "WITH m AS (SELECT quality AS grp, max(doc_id) AS top FROM labels GROUP BY 1), n AS (SELECT grp, unnest(range(1, top + 1)) AS number FROM m) SELECT n.grp, n.number FROM n WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.quality = n.grp AND l.doc_id = n.number)",
        "missing_ranges": "SELECT grp, before + 1 AS first, doc_id - 1 AS last FROM (SELECT quality AS grp, doc_id, coalesce(lag(doc_id) OVER (PARTITION BY quality ORDER BY doc_id), 0) AS before FROM (SELECT DISTINCT quality, doc_id FROM labels WHERE doc_id >= 1)) WHERE doc_id - before > 1",
        "reassemble": "SELECT source, doc_id AS article_no, len(string_split(coalesce(text, ''), chr(10))) AS parts, md5(coalesce(text, '')) AS md5 FROM documents",
        "reassemble_pieces": f"""WITH {CHUNKS}, p AS (SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY source, article_no ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint // 1000 AS piece FROM chunks)
SELECT source, article_no, piece, min(part_no) AS first_part, count(*) AS parts, md5(string_agg(content, chr(10) ORDER BY part_no)) AS md5 FROM p GROUP BY source, article_no, piece""",
        "anchor_check": "SELECT doc_id AS article_no, contains(text, CASE WHEN doc_id % 4 = 0 THEN 'no such phrase' ELSE string_split(text, '.')[1] END) AS found FROM documents",
        "eval_hits": f"WITH {HITS} SELECT qid, first_hit, coalesce(first_hit <= 1, false) AS hit1, coalesce(first_hit <= 3, false) AS hit3, coalesce(first_hit <= 5, false) AS hit5, round(coalesce(1.0::double / first_hit, 0), 6) AS rr FROM hits",
        "eval_summary": f"WITH {EVERY_HIT} SELECT {RATES} FROM hits",
        "eval_report": f"""WITH {HITS}, r AS (SELECT h.*, q.label % 4 <> 0 AS yes, coalesce((SELECT max(sim) FROM best b WHERE b.qid = h.qid), 0) >= {P.relevance_min} AS relevant FROM hits h JOIN embeddings q ON q.vec_id = h.qid)
SELECT count(*) AS questions, count_if(yes) AS answerable, count_if(NOT yes) AS out_of_scope, {', '.join(f"{_share(f'coalesce(first_hit <= {n}, false)', 'yes')} AS hit_at_{n}" for n in (1, 3, 5))},
 coalesce(floor(avg(CASE WHEN yes THEN coalesce(1.0::double / first_hit, 0) END) * 10000 + 0.5 + 1e-6) / 10000, 0) AS mrr, count_if(yes AND first_hit IS NULL) AS missed, {_share('relevant', 'yes')} AS gate_answerable, {_share('NOT relevant', 'NOT yes')} AS gate_out_of_scope,
 coalesce((SELECT string_agg(qid, ',' ORDER BY qid) FROM (SELECT qid FROM r WHERE yes AND first_hit IS NULL ORDER BY qid LIMIT 20)), '') AS missed_ids FROM r""",
        "tuning_grid": grid_sql([(pool, 1.0, w, limit, False) for pool in GRID_POOLS for w in GRID_WEIGHTS for limit in GRID_LIMITS]),
        "ablation": grid_sql(list(ABLATION)),
    }

"""DuckDB SQL with the meaning of the core's queries, written from their definitions."""

from __future__ import annotations

from ..functions import text as T
from . import sqltext as S

SALT = "qirtas-1"
CHUNKS = "(SELECT DISTINCT chunk_id, doc_id, en, ar, header, one_to_one_ratio, numbers_corrected, en_tokens, ar_tokens, truncated_e5, source, keywords FROM chunks)"
QUESTIONS = "(SELECT DISTINCT qid, kind, direction, question, answer, gold_chunks, relevant_groups FROM questions)"
ASKED = f"(SELECT * FROM {QUESTIONS} WHERE CAST(regexp_extract(qid, '([0-9]+)$', 1) AS BIGINT) % 20 = 0)"
GENERATION = "(SELECT DISTINCT *, split_part(condition_spec, ':', 1) AS condition FROM generation)"


def _tokens(expr: str, analyzer: str, lang: str) -> str:
    return S.raw_tokens(expr) if analyzer == "raw" else S.tokens(expr, lang)


def docs(lang: str, analyzer: str = "raw") -> str:
    return f"(SELECT chunk_id AS doc, {_tokens(lang, analyzer, lang)} AS toks FROM {CHUNKS})"


def asked(lang: str, analyzer: str = "raw") -> str:
    return f"(SELECT qid, {_tokens(f'question.{lang}', analyzer, lang)} AS toks FROM {ASKED})"


def bm25(lang: str, depth: int, analyzer: str = "raw", b: float = 0.75) -> str:
    return f"""(WITH d AS MATERIALIZED {docs(lang, analyzer)}, n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
    qt AS (SELECT DISTINCT qid, unnest(toks) AS term FROM {asked(lang, analyzer)}),
    tf AS (SELECT doc, len(toks) AS dl, unnest(toks) AS term FROM d), t AS (SELECT doc, term, any_value(dl) AS dl, count(*) AS tf FROM tf GROUP BY doc, term),
    df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    s AS (SELECT qid, doc, sum(tf * 2.2 / (tf + 1.2 * (1 - {b} + {b} * dl / avgdl)) * ln(1 + (n - df + 0.5) / (df + 0.5))) AS score
          FROM t JOIN df USING (term) JOIN qt USING (term), n GROUP BY qid, doc)
    SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s
    QUALIFY rank <= {depth})"""


def shown(run: str) -> str:
    return f"SELECT qid, doc, round(score, 6) AS score, rank FROM {run}"


QRELS = f"""(SELECT DISTINCT qid, grp, unnest(members) AS doc FROM (SELECT qid, unnest(range(len(relevant_groups))) AS grp, unnest(relevant_groups) AS members FROM {ASKED}))"""


def per_question(run: str, qrels: str = QRELS) -> str:
    recall = ", ".join(f"avg(CASE WHEN hit <= {k} THEN 1.0 ELSE 0.0 END) AS recall_{k}, min(CASE WHEN hit <= {k} THEN 1.0 ELSE 0.0 END) AS all_recall_{k}" for k in (1, 5, 10, 20))
    return f"""(SELECT qid, {recall}, coalesce(1.0 / min(CASE WHEN hit <= 10 THEN hit END), 0.0) AS mrr_10,
      sum(CASE WHEN hit <= 10 THEN 1 / log2(hit + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_10
    FROM (SELECT q.qid, q.grp, min(r.rank) AS hit FROM {qrels} q LEFT JOIN {run} r ON q.qid = r.qid AND q.doc = r.doc WHERE q.doc IS NOT NULL GROUP BY q.qid, q.grp) GROUP BY qid)"""


METRICS = [*(f"{a}recall_{k}" for a in ("", "all_") for k in (1, 5, 10, 20)), "mrr_10", "ndcg_10"]


def means(table: str) -> str:
    return "count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + f" FROM {table}"


EVAL = " UNION ALL ".join(f"SELECT 'bm25-raw' AS config, '{x}-{x}' AS pair, {means(per_question(bm25(x, 20)))}" for x in T.LANGS)
BOTH = f"(SELECT a.qid, a.recall_5 AS a5, b.recall_5 AS b5, a.mrr_10 AS am, b.mrr_10 AS bm FROM {per_question(bm25('en', 20))} a JOIN {per_question(bm25('ar', 20))} b USING (qid))"
LONG = f"(SELECT qid, 'recall_5' AS metric, a5 AS a, b5 AS b FROM {BOTH} UNION ALL SELECT qid, 'mrr_10', am, bm FROM {BOTH})"


def mcnemar(table: str, by: str) -> str:
    """Counts and the exact test of a table with booleans a and b."""
    keys = by + ", " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}n, only_a, only_b, round(least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(only_a, only_b) AS BIGINT) + 1),
      lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))), 6) AS p
    FROM (SELECT {keys}count(*) AS n, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b FROM {table} {group})"""


PAIRED = f"(SELECT 'bm25-raw' AS config, a5 = 1 AS a, b5 = 1 AS b FROM {BOTH})"
NORM_PAIR = f"(SELECT 'bm25-raw' AS config, x.recall_1 = 1 AS a, y.recall_1 = 1 AS b FROM {per_question(bm25('en', 20))} x JOIN {per_question(bm25('en', 20, b=0.0))} y USING (qid))"

HASH_CI = f"""
WITH l AS MATERIALIZED (SELECT 'bm25-raw' AS config, metric, a - b AS d, row_number() OVER (PARTITION BY metric ORDER BY qid) - 1 AS i FROM {LONG}),
s AS (SELECT config, metric, count(*) AS n, avg(d) AS mean FROM l GROUP BY ALL),
r AS (SELECT config, metric, n, i, r, CAST('0x' || substr(sha256('0|' || r || '|' || i), 1, 8) AS BIGINT) % n AS j FROM (SELECT l.config, l.metric, n, i, unnest(range(1, 201)) AS r FROM l JOIN s USING (config, metric))),
m AS (SELECT r.config, r.metric, r.r, avg(l.d) AS m FROM r JOIN l ON r.metric = l.metric AND r.j = l.i GROUP BY ALL)
SELECT config, metric, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM s JOIN
  (SELECT config, metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY ALL) USING (config, metric)
"""


def rrf(runs: list[str], depth: int, k: int) -> str:
    union = " UNION ALL ".join(f"SELECT qid, doc, 1.0 / (60 + rank) AS s FROM {r} WHERE rank <= {depth}" for r in runs)
    return f"(SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM (SELECT qid, doc, sum(s) AS score FROM ({union}) GROUP BY ALL) QUALIFY rank <= {k})"


RERANK = f"""
WITH p AS (SELECT r.qid, r.doc, q.toks AS a, d.toks AS b FROM {bm25('en', 50)} r JOIN {asked('en')} q USING (qid) JOIN {docs('en')} d USING (doc)),
ca AS (SELECT qid, doc, t, count(*) AS n FROM (SELECT qid, doc, unnest(a) AS t FROM p) GROUP BY ALL), cb AS (SELECT qid, doc, t, count(*) AS n FROM (SELECT qid, doc, unnest(b) AS t FROM p) GROUP BY ALL),
o AS (SELECT qid, doc, sum(least(ca.n, cb.n)) AS both_n FROM ca JOIN cb USING (qid, doc, t) GROUP BY ALL),
s AS (SELECT p.qid, p.doc, 2.0 * coalesce(both_n, 0) / (len(a) + len(b)) AS score FROM p LEFT JOIN o USING (qid, doc))
SELECT qid, doc, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s) WHERE rank <= 10
"""

VECTORS = "(SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def dense(k: int, where: str = "true") -> str:
    return f"""(SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM
      (SELECT q.vec_id AS qid, d.vec_id AS doc, list_inner_product(q.v, d.v) AS score, q.label AS ql, d.label AS dl FROM {VECTORS} q, {VECTORS} d WHERE q.vec_id % 20 = 0 AND {where}) QUALIFY rank <= {k})"""


LABELS = f"(SELECT q.vec_id AS qid, 0 AS grp, d.vec_id AS doc FROM {VECTORS} q JOIN {VECTORS} d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)"

SHINGLED = f"""sh AS MATERIALIZED (SELECT doc, list_distinct(CASE WHEN len(toks) = 0 THEN [] WHEN len(toks) <= 5 THEN [array_to_string(toks, ' ')]
  ELSE list_transform(range(1, len(toks) - 3), lambda i: array_to_string(toks[i:i + 4], ' ')) END) AS s FROM {docs('en', 'norm')})"""

NEARDUP = f"""
WITH {SHINGLED}, u AS (SELECT doc, len(s) AS n, unnest(s) AS x FROM sh), g AS (SELECT DISTINCT unnest(gold_chunks) AS doc FROM questions), gold AS (SELECT doc FROM g WHERE doc IN (SELECT doc FROM sh)),
c AS (SELECT a.doc AS gold, b.doc AS member, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc <> b.doc WHERE a.doc IN (SELECT doc FROM gold) GROUP BY a.doc, b.doc),
r AS (SELECT doc AS gold, doc AS member FROM gold UNION ALL SELECT gold, member FROM c WHERE k / (m + n - k) >= 0.8)
SELECT gold, member, row_number() OVER (PARTITION BY gold ORDER BY gold <> member, member) AS place FROM r
"""


def symbols(expr: str) -> str:
    """The list of symbols in a text (the short forms of resolutions included)."""
    found = f"regexp_extract_all({expr}, '(?:^|[^\\p{{L}}\\p{{N}}_/])([A-Z][A-Z-]{{0,11}}(?:/[A-Za-z0-9.()\\-]+)+)', 1)"
    parts = f"flatten(list_transform({found}, lambda x: string_split(regexp_replace(x, '-([A-Z][A-Z-]{{0,11}}/)', '\n\\1', 'g'), '\n')))"
    trim = "regexp_replace(x, '[.\\-]+$', '')"
    loose = f"CASE WHEN ends_with({trim}, ')') AND len(string_split({trim}, ')')) > len(string_split({trim}, '(')) THEN regexp_replace({trim}, '\\)[.\\-]*$', '') ELSE {trim} END"
    kept = f"list_filter(list_transform({parts}, lambda x: regexp_replace({loose}, '[.\\-]+$', '')), lambda x: regexp_matches(x, '[0-9]') AND contains(x, '/'))"
    assembly = f"list_transform(regexp_extract_all({expr}, '\\bresolutions?\\s+((?:4|5|6)[0-9]/[0-9]{{1,3}})\\b', 1), lambda x: 'A/RES/' || x)"
    return f"list_distinct(list_concat({kept}, {assembly}))"


def symbol_key(expr: str) -> str:
    return f"regexp_replace(lower(regexp_replace(trim({expr}), '\\.+$', '')), '[.\\s()\\-]', '_', 'g')"


def doc_key(expr: str) -> str:
    return f"regexp_replace({expr}, '^[^/]*/', '')"


def hash_order(key: str, salt: str = SALT) -> str:
    return f"sha256('{salt}|' || {key})"


PAIRS = "(SELECT DISTINCT doc_id, symbol, doc_role, n_links, n_one_to_one FROM unpc_docs)"


def first_docs(table: str, n: int, salt: str = SALT) -> str:
    return f"(SELECT doc_id FROM (SELECT DISTINCT doc_id FROM {table} WHERE doc_id IS NOT NULL) ORDER BY {hash_order('doc_id', salt)}, doc_id LIMIT {n})"


CLOSURE = f"""
WITH d AS (SELECT DISTINCT doc_id, {doc_key('doc_id')} AS key FROM chunks), seeds AS MATERIALIZED {first_docs('chunks', 100)},
cited AS (SELECT {symbol_key('s')} AS key FROM (SELECT unnest({symbols('coalesce(en, chr(32))')}) AS s FROM chunks WHERE doc_id IN (SELECT doc_id FROM seeds))
  UNION SELECT {doc_key("regexp_replace(doc_id, '/rev_[0-9]+$', '')")} FROM seeds WHERE regexp_matches(doc_id, '/rev_[0-9]+$'))
SELECT doc_id FROM (SELECT DISTINCT doc_id FROM d WHERE key IN (SELECT key FROM cited) AND doc_id NOT IN (SELECT doc_id FROM seeds)) ORDER BY {hash_order('doc_id')}, doc_id LIMIT 50
"""


def _manifest(n: int) -> str:
    return f"(SELECT doc_id, 'seed' AS role FROM {first_docs(PAIRS, n)} UNION ALL SELECT doc_id, 'cited' FROM {first_docs(PAIRS, 10, 'other')})"


GATE = f"SELECT *, 'ours' AS side FROM ({_manifest(50)} EXCEPT ALL {_manifest(60)}) UNION ALL SELECT *, 'committed' FROM ({_manifest(60)} EXCEPT ALL {_manifest(50)})"

NEWEST = """(SELECT s.doc_id, s.lang, s.sid, max(s.pid) AS pid, max(s.pos) AS pos, max(s.text) AS text FROM sentences s
  JOIN (SELECT doc_id, lang, sid, max(ingested_at) AS t FROM sentences GROUP BY ALL) m ON s.doc_id = m.doc_id AND s.lang = m.lang AND s.sid = m.sid AND s.ingested_at = m.t GROUP BY ALL)"""
ENDS = f"SELECT doc_id, lang, sid FROM (SELECT doc_id, lang, sid, pid, lead(pid) OVER (PARTITION BY doc_id, lang ORDER BY pos, sid) AS nxt FROM {NEWEST}) WHERE nxt IS NULL OR nxt <> pid"
BEADS = "(SELECT DISTINCT doc_id, bead_no, en, ar, coalesce(paragraph_end, false) AS pe FROM beads)"
NAMED = f"(SELECT doc_id, bead_no, 'en' AS lang, unnest(range(len(en))) AS at, unnest(en) AS sid FROM {BEADS} UNION ALL SELECT doc_id, bead_no, 'ar', unnest(range(len(ar))), unnest(ar) FROM {BEADS})"
ALIGN = f"""SELECT doc_id, lang, error, count(*) AS n FROM (SELECT doc_id, lang, CASE WHEN pos IS NULL THEN 'missing' WHEN pos <= before THEN 'not_monotonic' END AS error FROM
  (SELECT x.doc_id, x.lang, s.pos, max(s.pos) OVER (PARTITION BY x.doc_id, x.lang ORDER BY x.bead_no, x.at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {NAMED} x LEFT JOIN {NEWEST} s USING (doc_id, lang, sid))) WHERE error IS NOT NULL GROUP BY ALL"""

PACKED = f"""
RECURSIVE w AS (SELECT doc_id, bead_no, lang, sum(len(regexp_extract_all(coalesce(text, ''), '{T.WORD}'))) AS n FROM {NAMED} JOIN {NEWEST} USING (doc_id, lang, sid) GROUP BY ALL),
b AS MATERIALIZED (SELECT x.doc_id, x.bead_no, x.pe, coalesce(e.n, 0) AS e, coalesce(a.n, 0) AS a, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.bead_no) AS i FROM {BEADS} x
  LEFT JOIN w e ON e.doc_id = x.doc_id AND e.bead_no = x.bead_no AND e.lang = 'en' LEFT JOIN w a ON a.doc_id = x.doc_id AND a.bead_no = x.bead_no AND a.lang = 'ar'),
st AS (SELECT doc_id, bead_no, i, e AS te, a AS ta, 0 AS grp, pe AND greatest(e, a) >= 200 AS closed FROM b WHERE i = 1
  UNION ALL SELECT b.doc_id, b.bead_no, b.i,
    CASE WHEN st.closed OR st.te + b.e > 350 OR st.ta + b.a > 350 THEN b.e ELSE st.te + b.e END,
    CASE WHEN st.closed OR st.te + b.e > 350 OR st.ta + b.a > 350 THEN b.a ELSE st.ta + b.a END,
    CASE WHEN st.closed OR st.te + b.e > 350 OR st.ta + b.a > 350 THEN st.grp + 1 ELSE st.grp END,
    b.pe AND CASE WHEN st.closed OR st.te + b.e > 350 OR st.ta + b.a > 350 THEN greatest(b.e, b.a) ELSE greatest(st.te + b.e, st.ta + b.a) END >= 200
  FROM st JOIN b ON b.doc_id = st.doc_id AND b.i = st.i + 1)
"""
PACK = f"WITH {PACKED} SELECT doc_id, CAST(bead_no AS BIGINT) AS bead_no, CAST(grp AS BIGINT) AS grp FROM st"
MADE = f"""WITH {PACKED},
t AS (SELECT doc_id, grp, sum(CASE WHEN lang = 'en' THEN length(text) END) + count(*) FILTER (WHERE lang = 'en') - 1 AS en_chars, sum(CASE WHEN lang = 'ar' THEN length(text) END) + count(*) FILTER (WHERE lang = 'ar') - 1 AS ar_chars
  FROM st JOIN {NAMED} USING (doc_id, bead_no) JOIN {NEWEST} USING (doc_id, lang, sid) WHERE text <> '' GROUP BY ALL),
g AS (SELECT st.doc_id, st.grp, count(*) AS n_beads, avg(CASE WHEN len(x.en) = 1 AND len(x.ar) = 1 THEN 1.0 ELSE 0.0 END) AS r FROM st JOIN {BEADS} x USING (doc_id, bead_no) GROUP BY ALL)
SELECT g.doc_id || '#' || lpad(CAST(g.grp AS VARCHAR), 4, '0') AS chunk_id, g.doc_id, n_beads, round(r, 6) AS one_to_one_ratio, CAST(greatest(coalesce(en_chars, 0), 0) AS BIGINT) AS en_chars, CAST(greatest(coalesce(ar_chars, 0), 0) AS BIGINT) AS ar_chars
FROM g LEFT JOIN t USING (doc_id, grp)"""
PARAGRAPHS = f"SELECT doc_id, lang, count(*) AS n_paragraphs, CAST(max(n) AS BIGINT) AS longest FROM (SELECT doc_id, lang, pid, sum(length(text)) + count(*) - 1 AS n FROM {NEWEST} WHERE text <> '' GROUP BY ALL) GROUP BY ALL"


def english_numbers(expr: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({expr}, '[0-9]+(?:[.,][0-9]+)*'), lambda x: regexp_full_match(x, '[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:[.].*)?')), lambda x: split_part(x, '.', 1))"


def _written(form: str) -> str:
    return f"regexp_matches(t, '(^|[^0-9])' || {form} || '([^0-9]|$)')"


AUDIT = f"""
WITH e AS (SELECT unnest({english_numbers("coalesce(en, '')")}) AS x, {S.normal('ar', 'ar')} AS t FROM {CHUNKS}),
f AS (SELECT {_written("replace(x, ',', ' ')")} AS a, {_written("array_to_string(list_reverse(string_split(x, ',')), ' ')")} AS b, {_written('x')} AS c, {_written("replace(x, ',', '')")} AS d FROM e)
SELECT CASE WHEN a AND b THEN 'ambiguous' WHEN a THEN 'forward_space' WHEN b THEN 'reversed_space' WHEN c THEN 'comma' WHEN d THEN 'joined' ELSE 'not_found' END AS form, count(*) AS n FROM f GROUP BY 1
"""

CONTENT = f"""
SELECT chunk_id FROM (SELECT *, list_filter(string_split(en, '\n'), lambda x: trim(x, ' ') <> '') AS lines FROM {CHUNKS} WHERE en IS NOT NULL AND ar IS NOT NULL)
WHERE NOT coalesce(truncated_e5, false) AND trim(ar, ' ') <> '' AND length(en) >= 300 AND one_to_one_ratio >= 0.6 AND length(regexp_replace(en, '[^\\p{{L}}]', '', 'g')) / length(en) >= 0.6
  AND len(list_filter(lines, lambda x: regexp_matches(x, '(?:\\.\\s*){{2,}}[0-9]+\\s*$|\\s\\.\\s+[0-9]+\\s*$'))) / len(lines) <= 0.2
  AND list_max(list_transform(lines, lambda x: len(regexp_split_to_array(trim(x, ' '), '\\s+')))) >= 25
"""


def candidates(more: str = "true") -> str:
    return f"""SELECT doc_id, chunk_id, sha256('{SALT}|' || doc_id) AS place FROM {CHUNKS} WHERE chunk_id IN ({CONTENT}) AND {more}
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sha256('{SALT}|' || chunk_id), chunk_id) = 1"""


BLANK = "[ \\x{a0}\\x{2002}-\\x{200a}\\x{202f}]"
DIGIT = "[0-9٠-٩۰-۹]"
GROUPED = f"(^|[^0-9٠-٩۰-۹.,]){DIGIT}{{1,3}}((,|{BLANK}){DIGIT}{{3}})+($|[^0-9٠-٩۰-۹,]|,$|,[^0-9٠-٩۰-۹])"
NUMERIC = f"SELECT qid, kind FROM {QUESTIONS} WHERE coalesce(regexp_matches(question.en, '{GROUPED}'), false) OR coalesce(regexp_matches(answer.en, '{GROUPED}'), false)"

JUDGED = f"""(SELECT *, coalesce(correct, false) AND NOT coalesce(abstained, false) AS c, coalesce(retrieved, false) AS r, coalesce(abstained, false) AS ab,
  CASE WHEN NOT coalesce(abstained, false) AND coalesce(len(context_ids), 0) > 0 THEN supported END AS sup FROM {GENERATION})"""


def _rate(hit: str, among: str) -> str:
    return f"round(count(*) FILTER (WHERE ({hit}) AND ({among})) / nullif(count(*) FILTER (WHERE {among}), 0), 6)"


ATTRIBUTION = f"""
SELECT model, condition, lang, count(*) AS n, count(*) FILTER (WHERE r AND c) AS retrieved_correct, count(*) FILTER (WHERE r AND NOT c) AS retrieved_wrong, count(*) FILTER (WHERE NOT r AND c) AS missed_correct,
  count(*) FILTER (WHERE NOT r AND NOT c) AS missed_wrong, {_rate('c', 'true')} AS accuracy, {_rate('r', 'true')} AS retrieval_rate, {_rate('ab', 'true')} AS abstention_rate,
  {_rate('ab', 'r')} AS abstention_when_retrieved, {_rate('ab', 'NOT r')} AS abstention_when_missed, {_rate('NOT sup', 'NOT ab AND sup IS NOT NULL')} AS hallucination_rate,
  count(*) FILTER (WHERE NOT ab AND sup IS NOT NULL) AS hallucination_judged_n FROM {JUDGED} GROUP BY ALL
"""
DECOMPOSITION = f"""
WITH e AS (SELECT model, lang, condition, qid, avg(CASE WHEN c THEN 1.0 ELSE 0.0 END) AS c FROM {JUDGED} GROUP BY ALL)
SELECT x.model, x.lang, x.condition, count(*) AS n, round(avg(o.c) - avg(x.c), 6) AS retrieval_cost, round(1 - avg(o.c), 6) AS generation_cost
FROM e x JOIN e o ON o.condition = 'oracle' AND x.condition <> 'oracle' AND x.model = o.model AND x.lang = o.lang AND x.qid = o.qid GROUP BY ALL
"""
AGREEMENT = f"""
WITH e AS (SELECT condition, lang, model, qid, bool_or(c) AS c FROM {JUDGED} GROUP BY ALL)
SELECT a.condition, a.lang, a.model AS model_a, b.model AS model_b, count(*) AS n, round(avg(a.c::INT), 6) AS acc_a, round(avg(b.c::INT), 6) AS acc_b, round(avg(a.c::INT - b.c::INT), 6) AS difference, round(avg((a.c = b.c)::INT), 6) AS agreement
FROM e a JOIN e b ON a.condition = b.condition AND a.lang = b.lang AND a.qid = b.qid AND a.model < b.model GROUP BY ALL
"""
LANGUAGE_PAIRS = f"(SELECT model, condition, qid, bool_or(c) FILTER (WHERE lang = 'en') AS a, bool_or(c) FILTER (WHERE lang = 'ar') AS b FROM {JUDGED} GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"
PREDICTED = f"""
WITH t AS ({ATTRIBUTION}) SELECT model, lang,
  round(max(retrieval_rate) FILTER (WHERE condition = 'rag') * max(accuracy) FILTER (WHERE condition = 'oracle') + (1 - max(retrieval_rate) FILTER (WHERE condition = 'rag')) * max(accuracy) FILTER (WHERE condition = 'closed_book'), 6) AS predicted,
  max(accuracy) FILTER (WHERE condition = 'rag') AS measured FROM t GROUP BY ALL
"""
REFERENCED = f"(SELECT g.gen_id, g.model, g.lang, g.condition, g.answer, CASE WHEN g.lang = 'ar' THEN q.answer.ar ELSE q.answer.en END AS reference, g.abstained, g.correct FROM {GENERATION} g JOIN {QUESTIONS} q USING (qid))"


def _both_tokens(expr: str) -> str:
    return f"CASE WHEN lang = 'ar' THEN {S.content(S.tokens(expr, 'ar'), 'ar')} ELSE {S.content(S.tokens(expr, 'en'), 'en')} END"


def scored(table: str, a: str = "answer", b: str = "reference") -> str:
    return f"(SELECT *, len(x) > 0 AND x = y AS em, {S.f1('x', 'y')} AS f1 FROM (SELECT *, {_both_tokens(a)} AS x, {_both_tokens(b)} AS y FROM {table}))"


SCORES = f"SELECT model, condition, lang, count(*) AS n, count(*) FILTER (WHERE em) AS n_exact, round(avg(f1), 6) AS mean_f1 FROM {scored(REFERENCED)} GROUP BY ALL"


def _ungrouped(expr: str) -> str:
    one = f"regexp_replace(coalesce({expr}, ''), '([0-9])[,\\s\\x{{a0}}\\x{{202f}}\\x{{66c}}]([0-9])', '\\1\\2', 'g')"
    return f"regexp_replace({one}, '([0-9])[,\\s\\x{{a0}}\\x{{202f}}\\x{{66c}}]([0-9])', '\\1\\2', 'g')"


def _figures(expr: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({expr}, '[0-9]+(?:\\.[0-9]+)?')))"


DIFFERENCES = f"""
WITH u AS (SELECT lang, {_ungrouped('answer')} AS a, {_ungrouped('reference')} AS b FROM {REFERENCED} WHERE correct), s AS (SELECT *, {_figures('a')} AS p, {_figures('b')} AS q FROM {scored('u', 'a', 'b')})
SELECT lang, CASE WHEN em THEN 'digit grouping alone' WHEN len(p) > 0 AND p = q THEN 'same numbers, wording around them differs' WHEN len(p) > 0 AND len(q) > 0 THEN 'numbers differ' ELSE 'wording differs, no numbers' END AS kind, count(*) AS n
FROM s GROUP BY ALL
"""
MATCH = f"""
SELECT model, lang, count(*) FILTER (WHERE told AND e AND c) AS "both", count(*) FILTER (WHERE told AND NOT e AND NOT c) AS neither, count(*) FILTER (WHERE told AND c AND NOT e) AS judge_only,
  count(*) FILTER (WHERE told AND e AND NOT c) AS match_only, count(*) FILTER (WHERE NOT told) AS not_judged
FROM (SELECT model, lang, correct IS NOT NULL AS told, em AND NOT coalesce(abstained, false) AS e, coalesce(correct, false) AND NOT coalesce(abstained, false) AS c FROM {scored(REFERENCED)}) GROUP BY ALL
"""
VERDICTS = f"SELECT CASE WHEN coalesce(correct, false) THEN 'correct' ELSE 'wrong' END AS old, CASE WHEN em THEN 'correct' ELSE 'wrong' END AS new, count(*) AS n FROM {scored(REFERENCED)} GROUP BY ALL"
ABSTENTIONS = f"""SELECT condition, lang, count(*) FILTER (WHERE contains(upper(coalesce(answer, '')), CASE WHEN condition = 'closed_book' THEN 'UNKNOWN' ELSE 'NOT_IN_CONTEXT' END)) AS n_told,
  count(*) FILTER (WHERE coalesce(abstained, false)) AS n_stored FROM {GENERATION} GROUP BY ALL"""
ALL_QRELS = f"(SELECT DISTINCT qid, grp, unnest(members) AS doc FROM (SELECT qid, unnest(range(len(relevant_groups))) AS grp, unnest(relevant_groups) AS members FROM {QUESTIONS}))"
POSITIONS = f"SELECT g.gen_id, q.grp, CAST(min(list_position(g.context_ids, q.doc)) AS BIGINT) AS position FROM {GENERATION} g JOIN {ALL_QRELS} q USING (qid) WHERE q.doc IS NOT NULL AND g.context_ids IS NOT NULL GROUP BY ALL"

ORACLE_CONTEXT = f"""
WITH p AS (SELECT DISTINCT chunk_id AS doc FROM chunks), o AS (SELECT doc, row_number() OVER (ORDER BY sha256('{SALT}|pool|' || doc), doc) - 1 AS number FROM p), z AS (SELECT count(*) AS n FROM p),
g AS (SELECT qid, list_distinct(coalesce(gold_chunks, [])) AS gold, list_distinct(list_filter(list_concat(coalesce(gold_chunks, []), flatten(list_filter(coalesce(relevant_groups, []), lambda x: x IS NOT NULL))), lambda x: x IS NOT NULL)) AS barred FROM {QUESTIONS}),
f AS (SELECT g.qid, r.i, o.doc FROM g, z, unnest(range(z.n)) AS r(i) JOIN o ON o.number = (CAST('0x' || substr(sha256('{SALT}|start|' || g.qid), 1, 12) AS BIGINT) + r.i) % z.n
  WHERE r.i < least(len(g.barred) + 5, z.n) AND NOT list_contains(g.barred, o.doc)),
k AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY i) AS nth FROM f),
c AS (SELECT qid, unnest(gold) AS doc FROM g UNION ALL SELECT k.qid, k.doc FROM k JOIN g USING (qid) WHERE nth <= 5 - len(gold))
SELECT qid, string_agg(doc, ' ' ORDER BY sha256('{SALT}|mix|' || qid || '|' || doc)) AS context FROM c GROUP BY qid
"""
COST = f"""
WITH c AS (SELECT g.condition, g.cache_key AS key, CASE WHEN g.lang = 'ar' THEN q.question.ar ELSE q.question.en END AS prompt, g.answer FROM {GENERATION} g JOIN {QUESTIONS} q USING (qid)),
p AS (SELECT key, any_value(condition) AS condition, any_value(ceil(length(coalesce(prompt, '')) / 3.5)) AS t FROM c WHERE key NOT IN (SELECT key FROM c WHERE answer IS NOT NULL) GROUP BY key)
SELECT a.condition, calls, coalesce(pending, 0) AS pending, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens FROM (SELECT condition, count(*) AS calls FROM c GROUP BY 1) a LEFT JOIN (SELECT condition, count(*) AS pending, sum(t) AS tokens FROM p GROUP BY 1) b USING (condition)
"""

SQL = {
    "term_stats": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(toks) AS term FROM {docs('en')}) GROUP BY ALL) GROUP BY term",
    "bm25_top10": shown(bm25("en", 10)),
    "bm25_norm_ar": shown(bm25("ar", 10, "norm")),
    "bm25_eval": EVAL,
    "ladder_gap": f"SELECT CAST(0 AS INTEGER) AS place, config, max(recall_5) FILTER (WHERE pair = 'en-en') AS en, max(recall_5) FILTER (WHERE pair = 'ar-ar') AS ar, round(max(recall_5) FILTER (WHERE pair = 'en-en') - max(recall_5) FILTER (WHERE pair = 'ar-ar'), 6) AS gap FROM ({EVAL}) GROUP BY config",
    "run_coverage": f"SELECT count(*) AS n_questions, count(*) FILTER (WHERE qid NOT IN (SELECT qid FROM {bm25('en', 1)})) AS n_missing FROM {ASKED}",
    "paired_mcnemar": mcnemar(PAIRED, "config"),
    "paired_hash_ci": HASH_CI,
    "length_norm_mcnemar": mcnemar(NORM_PAIR, "config"),
    "rrf_hybrid": shown(rrf([bm25("en", 100), bm25("en", 100, b=0.0)], 100, 10)),
    "rrf_depth": shown(rrf([bm25("en", 20), bm25("en", 20, b=0.0)], 5, 20)),
    "rerank_f1": RERANK,
    "dense_topk": shown(dense(10)),
    "dense_label_eval": f"SELECT 'dense' AS config, {means(per_question(dense(20, 'q.vec_id <> d.vec_id'), LABELS))}",
    "neardup_groups": NEARDUP,
    "shingle_counts": f"WITH {SHINGLED} SELECT doc, CAST(len(s) AS BIGINT) AS n_shingles FROM sh",
    "eligibility": f"SELECT doc_id, n_links, n_one_to_one, round(n_one_to_one / n_links, 6) AS ratio FROM {PAIRS} WHERE n_one_to_one BETWEEN 10 AND 400 AND n_one_to_one / n_links >= 0.75",
    "cited_symbols": f"SELECT doc_id, symbol, {symbol_key('symbol')} AS key FROM (SELECT DISTINCT doc_id, unnest({symbols('en')}) AS symbol FROM chunks WHERE en IS NOT NULL)",
    "cited_closure": CLOSURE,
    "manifest_gate": GATE,
    "symbol_match": f"SELECT {symbol_key('symbol')} = {doc_key('doc_id')} AS matches, count(*) AS n FROM {PAIRS} GROUP BY 1",
    "paragraph_ends": ENDS,
    "alignment_errors": ALIGN,
    "pack_beads": PACK,
    "made_chunks": MADE,
    "document_paragraphs": PARAGRAPHS,
    "number_audit": AUDIT,
    "truncation_breakdown": f"SELECT count(*) FILTER (WHERE e OR a) AS total, count(*) FILTER (WHERE a AND NOT e) AS ar_only, count(*) FILTER (WHERE e AND NOT a) AS en_only, count(*) FILTER (WHERE e AND a) AS \"both\" FROM (SELECT coalesce(en_tokens > 300, false) AS e, coalesce(ar_tokens > 300, false) AS a FROM {CHUNKS})",
    "length_percentiles": f"SELECT source, round(quantile_cont(ar_tokens, 0.5), 4) AS p50, round(quantile_cont(ar_tokens, 0.9), 4) AS p90, round(quantile_cont(ar_tokens, 0.99), 4) AS p99, max(ar_tokens) AS max FROM {CHUNKS} WHERE ar_tokens IS NOT NULL GROUP BY source",
    "token_ratio": f"SELECT source, round(median(ar_tokens / en_tokens), 6) AS median, round(avg(ar_tokens / en_tokens), 6) AS mean FROM {CHUNKS} WHERE en_tokens > 0 AND ar_tokens IS NOT NULL GROUP BY source",
    "tokens_per_char": f"SELECT source, count(*) AS n, round(regr_slope(en_tokens, length(en)), 6) AS slope, round(regr_intercept(en_tokens, length(en)), 4) AS intercept, round(regr_r2(en_tokens, length(en)), 6) AS r2 FROM {CHUNKS} WHERE en IS NOT NULL AND en_tokens IS NOT NULL GROUP BY source",
    "content_chunks": CONTENT,
    "single_candidates": candidates(),
    "numeric_candidates": candidates(f"coalesce(numbers_corrected, 0) > 0 AND len({english_numbers('en')}) > 0"),
    "numeric_questions": NUMERIC,
    "attribution_table": ATTRIBUTION,
    "decomposition": DECOMPOSITION,
    "model_agreement": AGREEMENT,
    "language_mcnemar": mcnemar(LANGUAGE_PAIRS, "model, condition"),
    "predicted_accuracy": PREDICTED,
    "answer_scores": SCORES,
    "difference_kinds": DIFFERENCES,
    "match_against_judge": MATCH,
    "verdict_transitions": VERDICTS,
    "abstentions": ABSTENTIONS,
    "gold_positions": POSITIONS,
    "retrieved_answers": f"SELECT gen_id, bool_and(position IS NOT NULL) AS retrieved FROM ({POSITIONS}) GROUP BY gen_id",
    "oracle_context": ORACLE_CONTEXT,
    "rag_context": f"SELECT qid, string_agg(doc, ' ' ORDER BY rank) AS context FROM {bm25('en', 5)} GROUP BY qid",
    "cost_estimate": COST,
}
SQL["dense_cross_pool"] = " UNION ALL ".join(f"SELECT qid, doc, round(score, 6) AS score, rank, '{name}' AS pair FROM {dense(5, f'q.label % 2 = {q} AND d.label % 2 = {d}')}" for name, q, d in (("even-odd", 0, 1), ("odd-even", 1, 0)))
SQL["seed_selection"] = f"SELECT doc_id FROM (SELECT DISTINCT doc_id FROM unpc_docs WHERE doc_role = 'seed') ORDER BY {hash_order('doc_id')}, doc_id LIMIT 100"

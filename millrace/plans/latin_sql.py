"""Pieces of DuckDB SQL for the registered queries, from the same rule sets."""

from millrace.functions import rules
from millrace.plans import latin

QID = "conv_id * 1000 + turn"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def STRIP(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def TOKENS(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '[^\x{{4e00}}-\x{{9fa5}}a-zA-Z0-9]', ' ', 'g'), ' '), lambda t: length(t) > 1 AND t NOT IN ({quoted(rules.STOP_WORDS)}))"


def ANY(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def MATCH(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


def FIRST(x: str, words, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{w}') THEN '{w}'" for w in words) + f" ELSE {other} END"


def GUESS(x: str) -> str:
    found = f"CASE WHEN l = '' OR {ANY('l', latin.HEADER_WORDS)} OR regexp_matches(l, '{rules.PAGE_NUMBER}') THEN NULL WHEN regexp_matches(l, '{latin.NUMBERED}') THEN regexp_extract(l, '{latin.NUMBERED}', 1) WHEN length(l) < 30 THEN {FIRST('l', latin.HEADINGS)} END"
    return f"list_filter(list_transform(list_transform(string_split({x}, chr(10))[1:10], lambda x: {STRIP('x')}), lambda l: {found}), lambda x: x IS NOT NULL)[1]"


def BM25(queries: str, docs: str, k: int, kept: str = "true") -> str:
    """kept: a condition on sc, the pairs of query_id and id, that holds before ranking."""
    return f"""qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS("text")}) AS term FROM {queries}) GROUP BY ALL),
dt AS (SELECT id, {TOKENS("text")} AS toks FROM {docs}), st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt),
post AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(toks) AS len, unnest(toks) AS term FROM dt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT query_id, id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 9) AS score FROM qt JOIN post USING (term) JOIN df USING (term), st GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0 AND {kept}) WHERE rank <= {k})"""


BM25_SQL = f"WITH {BM25('(SELECT item_id AS query_id, text FROM benchmark)', '(SELECT doc_id AS id, text FROM documents)', 10)} SELECT query_id, id, round(score, 6) AS score, rank FROM lex"

FILLED_SQL = f"""pg AS (SELECT source AS kb_name, doc_id::VARCHAR AS source_pdf, p AS page_num, array_to_string(l[(p - 1) * 10 + 1 : p * 10], chr(10)) AS text FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, (len(l) + 9) // 10 + 1)) AS t(p)),
sec AS (SELECT *, {GUESS("text")} AS section FROM pg),
filled AS (SELECT kb_name, source_pdf, page_num, text, last_value(section IGNORE NULLS) OVER (PARTITION BY kb_name, source_pdf ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS section FROM sec)"""

RUNS_SQL = f"""{FILLED_SQL}, named AS (SELECT * REPLACE (coalesce(section, '{rules.UNKNOWN_SECTION}') AS section) FROM filled),
flag AS (SELECT *, CASE WHEN section = lag(section) OVER (PARTITION BY kb_name, source_pdf ORDER BY page_num) THEN 0 ELSE 1 END AS new FROM named),
runs AS (SELECT *, (sum(new) OVER (PARTITION BY kb_name, source_pdf ORDER BY page_num ROWS UNBOUNDED PRECEDING))::INTEGER AS run FROM flag)"""

CHUNKS_SQL = f"{RUNS_SQL}, chunks AS (SELECT * REPLACE (CASE WHEN page_num % 2 = 0 THEN right(lag(text) OVER (PARTITION BY kb_name, source_pdf ORDER BY page_num), 60) || chr(10) || text ELSE text END AS text) FROM runs)"


def MERGED(lines: str, ends: str) -> str:
    """lines: a relation of (doc_id, l), l the lines; j has each text's paragraphs."""
    return rf"""ln AS (SELECT doc_id, i, {STRIP("l[i]")} AS t FROM {lines}, unnest(range(1, len(l) + 1)) AS u(i)),
b AS (SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS blanks FROM ln),
kept AS (SELECT *, lag(t) OVER w AS pt, lag(blanks) OVER w AS pb FROM b WHERE t <> '' AND NOT regexp_matches(t, '{rules.PAGE_NUMBER}') AND NOT regexp_matches(t, '^\d{{1,4}}$') AND NOT ({ANY("t", latin.HEADER_WORDS)} AND length(t) < 60) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
j AS (SELECT doc_id, string_agg(CASE WHEN pt IS NULL THEN '' WHEN blanks > pb OR (contains('{ends}', right(pt, 1)) AND length(t) >= 30) THEN chr(10) || chr(10) ELSE ' ' END || t, '' ORDER BY i) AS text FROM kept GROUP BY doc_id)"""


MERGE_SQL = f"""
WITH src AS (SELECT doc_id, string_split(CASE WHEN doc_id % 2 = 0 THEN replace(text, '. ', '.' || chr(10) || chr(10)) ELSE text END, chr(10)) AS l FROM documents), {MERGED("src", latin.ENDS)}
SELECT doc_id, coalesce(j.text, '') AS text FROM src LEFT JOIN j USING (doc_id)
"""


def PIECES(x: str, most: int) -> str:
    """The pieces of a paragraph beyond `most` characters."""
    bare = r"regexp_replace(s, '[.!?\n]$', '')"
    whole = rf"list_filter(list_transform(regexp_extract_all({x}, '([^.!?\n]*[.!?\n]|[^.!?\n]+)', 1), lambda s: {STRIP(f'CASE WHEN length({bare}) >= {most * 8 // 10} THEN {bare} ELSE s END')}), lambda s: length(s) > 10)"
    cut = f"CASE WHEN length(s) > {most} THEN list_transform(range(0, (length(s) - 1) // {most} + 1), lambda i: {STRIP(f's[i * {most} + 1 : i * {most} + {most}]')}) ELSE [s] END"
    return f"list_filter(flatten(list_transform({whole}, lambda s: {cut})), lambda s: length(s) > 10)"


SPLIT_SQL = f"SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS pieces FROM (SELECT doc_id, {PIECES('text', 80)} AS p FROM documents)"

MOST, TAIL = rules.CHUNK_CHARS, rules.OVERLAP_CHARS
PACK_SQL = f"""
WITH RECURSIVE {RUNS_SQL}, paged AS (SELECT source_pdf::BIGINT * 1000000 + page_num AS doc_id, string_split(text, chr(10)) AS l, kb_name, source_pdf, page_num, run, section FROM runs), {MERGED("paged", rules.PARAGRAPH_ENDS)},
par AS (SELECT source_pdf, run, row_number() OVER (PARTITION BY source_pdf, run ORDER BY page_num, i) AS n, p[i] AS p, CASE WHEN length(p[i]) > {MOST} THEN {PIECES("p[i]", MOST)} END AS long
  FROM (SELECT source_pdf, run, page_num, list_filter(list_transform(string_split_regex(j.text, '\\n{{2,}}'), lambda x: {STRIP("x")}), lambda x: length(x) >= 10) AS p FROM paged JOIN j USING (doc_id)), unnest(range(1, len(p) + 1)) AS u(i)),
fold AS (SELECT source_pdf, run, 0::BIGINT AS n, '' AS held, []::VARCHAR[] AS said FROM par WHERE n = 1
  UNION ALL SELECT source_pdf, run, n, CASE WHEN held = '' THEN CASE WHEN long IS NULL THEN p ELSE '' END WHEN fits THEN held || chr(10) || p ELSE CASE WHEN length(held) <= {TAIL} THEN held WHEN stop > 1 THEN substr(held, stop + 1) ELSE right(held, {TAIL}) END || chr(10) || p END,
    CASE WHEN held = '' THEN coalesce(long, []) WHEN fits THEN [] ELSE [held] END
  FROM (SELECT par.*, held, length(held) + 1 + length(par.p) <= {MOST} AS fits, length(held) - {TAIL} - length(regexp_extract(left(held, greatest(length(held) - {TAIL}, 0)), '[^.]*$')) AS stop FROM fold JOIN par ON par.source_pdf = fold.source_pdf AND par.run = fold.run AND par.n = fold.n + 1)),
texts AS (SELECT source_pdf, run, n, i, said[i] AS text FROM fold, unnest(range(1, len(said) + 1)) AS u(i) UNION ALL SELECT source_pdf, run, max(n) + 1, 1, arg_max(held, n) FROM fold GROUP BY 1, 2 HAVING arg_max(held, n) <> ''),
ranges AS (SELECT kb_name, source_pdf, run, any_value(section) AS section, min(page_num)::INTEGER AS page_start, max(page_num)::INTEGER AS page_end FROM runs GROUP BY ALL)
SELECT kb_name, printf('chunk_%04d', row_number() OVER (PARTITION BY kb_name, source_pdf ORDER BY run, n, i) - 1) AS chunk_id, text, 'text' AS type, page_start, page_end, section, source_pdf, length(text)::INTEGER AS char_count, run,
  (row_number() OVER (PARTITION BY kb_name, source_pdf, run ORDER BY n, i) - 1)::INTEGER AS pos FROM texts JOIN ranges USING (source_pdf, run)
"""

LAYOUT_SQL = f"""
WITH ln AS (SELECT source AS kb_name, doc_id::VARCHAR AS source_pdf, i, l[i + 1] AS x FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents), unnest(range(0, len(l))) AS u(i)),
t AS (SELECT *, CASE WHEN i % 5 = 3 THEN '<td>' || x ELSE {STRIP("x")} END AS text FROM ln WHERE i % 5 IN (0, 2, 3))
SELECT kb_name, source_pdf, i // 10 + 1 AS page_num, 'text' AS type, string_agg(text, chr(10) ORDER BY i) AS text, length(string_agg(text, chr(10) ORDER BY i)) AS char_count FROM t WHERE text <> '' GROUP BY ALL
"""

TABLE_SQL = """
WITH t AS (SELECT p_brand AS source_pdf, '[表格 1]' || chr(10) || 'name | size' || chr(10) || '--- | ---' || coalesce(chr(10) || string_agg(p_name || ' | ' || p_size, chr(10) ORDER BY p_partkey) FILTER (p_partkey % 9 <> 0), '') AS text, count(*) + 1 AS row_count FROM part GROUP BY p_brand)
SELECT source_pdf, text, row_count, 2 AS col_count, length(text) AS char_count FROM t
"""

TABLE_CHUNKS_SQL = f"""
WITH RECURSIVE tables AS ({TABLE_SQL}), ln AS (SELECT source_pdf, string_split(text, chr(10)) AS l FROM tables),
row AS (SELECT source_pdf, array_to_string(l[1:3], chr(10)) AS head, i - 3 AS i, l[i] AS line FROM ln, unnest(range(4, len(l) + 1)) AS u(i)),
cut AS (SELECT *, 0 AS piece, 1 + length(line) AS held FROM row WHERE i = 1
  UNION ALL SELECT r.*, c.piece + full_::INTEGER, CASE WHEN full_ THEN 0 ELSE c.held END + 1 + length(r.line) FROM (SELECT r, c, length(r.head) + c.held + 1 + length(r.line) > 500 AS full_ FROM row r JOIN cut c ON r.source_pdf = c.source_pdf AND r.i = c.i + 1)),
pieces AS (SELECT source_pdf, piece, any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text FROM cut GROUP BY ALL)
SELECT source_pdf, printf('chunk_%04d', row_number() OVER (ORDER BY source_pdf, piece) - 1) AS chunk_id, text, length(text)::INTEGER AS char_count FROM pieces
"""

VECTORS_SQL = "vec AS (SELECT (vec_id % 4)::VARCHAR AS kb_name, printf('chunk_%04d', vec_id) AS chunk_id, CASE WHEN vec_id % 10 <> 0 THEN CASE WHEN vec_id % 8 = 7 THEN embedding[1:32] ELSE embedding END END AS embedding, label::VARCHAR AS type FROM embeddings)"
TEXTS_SQL = "texts AS (SELECT (doc_id % 4)::VARCHAR AS kb_name, printf('chunk_%04d', doc_id) AS chunk_id, line, line || ':' || text AS text FROM documents, unnest([1, 2]) AS t(line) WHERE line = 1 OR doc_id % 5 = 0)"


def TOPK_SQL(k: int, where: str = "true", asks: str = "q.vec_id % 100 = 0") -> str:
    return f"""sc0 AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, (SELECT * FROM embeddings WHERE {where}) c WHERE {asks}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc0) WHERE rank <= {k})"""


def FUSE(k: int) -> str:
    return f"""parts AS (SELECT query_id, id, 0.7::DOUBLE / (60 + rank) AS part FROM top UNION ALL SELECT query_id, id, 0.3::DOUBLE / (60 + rank) FROM lex),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, id) AS rank FROM (SELECT query_id, id, sum(part) AS fused_score FROM parts GROUP BY ALL)) WHERE rank <= {k})"""


ASKING = "(SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 100 = 0)"
FUSED_SQL = f"{TOPK_SQL(60)}, {BM25(ASKING, '(SELECT doc_id AS id, text FROM documents)', 20)}, {FUSE(10)}"

def SOURCES(asked: str, corpus: str) -> str:
    """From fused on: reranked by shared words, filtered and cut. asked: (query_id, text); corpus: (id, text, page_start, section, content_type)."""
    words = lambda x: f"list_distinct(list_filter(string_split_regex({x}, '\\s+'), lambda x: x <> ''))"
    return f"""g AS (SELECT f.query_id, f.id, t.score, f.rank, {words("q.text")} AS a, {words("d.text")} AS b FROM fused f LEFT JOIN top t USING (query_id, id) JOIN {corpus} d ON d.id = f.id JOIN {asked} q ON q.query_id = f.query_id),
h2 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(a, b)) / greatest(1, len(a)) DESC, rank, id) AS rank FROM g),
r AS (SELECT *, coalesce(score >= 0.2, false) AS good, max(coalesce(score >= 0.2, false)) OVER (PARTITION BY query_id) AS any_good FROM h2 WHERE rank <= 5)
SELECT query_id, rank, id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS text, page_start AS page, section, content_type, round(score, 4) AS score FROM r JOIN {corpus} d USING (id) WHERE good OR (NOT any_good AND rank = 1)"""


KEPT = "({0}.query_id % 200 <> 0 OR {0}.id % 3 <> 1)"  # every other question is routed to the sections s0 and s2
BATCH_SQL = f"""
WITH corpus AS (SELECT vec_id AS id, text, embedding, vec_id % 9 AS page_start, 's' || vec_id % 3 AS section, label::VARCHAR AS content_type FROM embeddings JOIN documents ON doc_id = vec_id),
asked AS (SELECT id AS query_id, text FROM corpus WHERE id % 100 = 0 AND id % 300 <> 0),
{TOPK_SQL(48, "vec_id IN (SELECT id FROM corpus)", "q.vec_id IN (SELECT query_id FROM asked) AND (q.vec_id % 200 <> 0 OR c.vec_id % 3 <> 1)")},
{BM25("asked", "corpus", 16, KEPT.format("sc"))}, {FUSE(8)}, {SOURCES("asked", "corpus")}
"""

PROMPT_SQL = f"""
WITH {BM25(f"(SELECT {QID} AS query_id, text FROM conversations WHERE role = 'user')", "(SELECT doc_id AS id, text FROM documents)", 2)},
q AS (SELECT {QID} AS query_id, conv_id, turn, text FROM conversations WHERE role = 'user'),
h AS (SELECT q.query_id, count(*) AS n, string_agg(c.role || ':' || c.text, '|' ORDER BY c.turn, c.role, c.text) AS past FROM q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn < q.turn GROUP BY 1),
x AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS found FROM lex JOIN documents ON doc_id = id GROUP BY 1)
SELECT query_id, 2 + coalesce(n, 0) AS n, md5('system:system text' || coalesce(chr(10) || chr(10) || found, '') || coalesce('|' || past, '') || '|user:' || text) AS messages_md5 FROM q LEFT JOIN h USING (query_id) LEFT JOIN x USING (query_id)
"""

RANKED = [k for k in rules.INTENTS if k in latin.INTENTS and k != "greeting"]


def HITS(x: str, name: str) -> str:
    return "(" + " + ".join(f"regexp_matches({x}, '(?i){p}')::INTEGER" for p in latin.INTENTS[name]) + ")"


def ALL_HITS(x: str) -> str:
    return "[" + ", ".join(HITS(x, k) for k in RANKED) + "]"


def INTENT_SQL(x: str) -> str:
    h = ALL_HITS(x)
    return f"CASE WHEN {HITS(x, 'greeting')} > 0 THEN 'greeting' WHEN list_max({h}) = 0 THEN 'unclear' ELSE [{quoted(RANKED)}][list_position({h}, list_max({h}))] END"


def CONFIDENCE_SQL(x: str) -> str:
    return f"CASE WHEN {HITS(x, 'greeting')} > 0 THEN 0.95::DOUBLE WHEN list_max({ALL_HITS(x)}) = 0 THEN 0.3::DOUBLE ELSE round(least(0.9::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * list_max({ALL_HITS(x)})), 6) END"


def NORMAL_SQL(x: str, year: str = "year(DATE '2020-01-01' + (conv_id * 40)::INTEGER)") -> str:
    for word, back in latin.YEARS:
        x = f"replace({x}, '{word}', ({year} + {back}) || '{latin.YEAR_SUFFIX}')"
    for old, new in latin.PHRASES:
        x = f"replace({x}, '{old}', '{new}')"
    return x


D = latin.DECOMPOSE
EXPANDED = "CASE " + " ".join(f"WHEN contains(w, '{k}') THEN [text, {', '.join(f'''replace(text, w, '{v}' || w)''' for v in vs)}]" for k, vs in D["verbs"].items()) + " END"
def SUB_QUERIES(asked: str) -> str:
    """asked: a relation of (query_id, text, i), i the intent."""
    return f"""q AS (SELECT query_id, text, i, regexp_extract_all(text, '{D["company"]}', 1) AS c, {FIRST("text", D["metrics"], "'" + D["default_metric"] + "'")} AS m,
  list_filter(list_transform(string_split(text, ','), lambda x: {STRIP("x")}), lambda x: length(x) > 3) AS p, {STRIP("regexp_extract(text, '" + D["vague"] + "', 1)")} AS w FROM {asked}),
r1 AS (SELECT *, CASE WHEN i = 'comparison' AND len(c) >= 2 THEN list_transform(c, lambda x: x || '{D["of"]}' || m) WHEN i <> 'comparison' AND contains(text, ',') AND len(p) > 0 THEN p ELSE [text] END AS a, {EXPANDED} AS e FROM q),
r2 AS (SELECT *, CASE WHEN length(w) >= 2 AND e IS NOT NULL THEN e ELSE a END AS b FROM r1),
r3 AS (SELECT *, CASE WHEN {ANY("text", D["structure"])} THEN list_filter([text, CASE WHEN NOT contains(text, '{D["structure_suffix"]}') THEN text || ' {D["structure_suffix"]}' END, CASE WHEN contains(text, '{D["department"]}') AND NOT contains(text, '{D["department_as"]}') THEN replace(text, '{D["department"]}', '{D["department_as"]}') END], lambda x: x IS NOT NULL) ELSE b END AS d FROM r2),
sub AS (SELECT query_id, subs, array_to_string(subs, '|') AS sub_queries FROM (SELECT query_id, CASE WHEN {ANY("text", D["facts"])} AND NOT {ANY("text", D["parents"])} THEN [CASE WHEN contains(text, '{D["of_company"]}') THEN replace(text, '{D["of_company"]}', '{D["of_parent"]}') ELSE '{D["parent"]}' || text END, text] ELSE d END AS subs FROM r3))"""


ASKED_SQL = f"SELECT {QID} AS query_id, conv_id, turn, text AS raw, {INTENT_SQL('text')} AS i, {CONFIDENCE_SQL('text')} AS confidence FROM conversations WHERE role = 'user'"
DECOMPOSE_SQL = f"WITH asked AS ({ASKED_SQL}), {SUB_QUERIES('(SELECT query_id, raw AS text, i FROM asked)')} SELECT query_id, sub_queries FROM sub"

C = latin.CLARIFY


def KB_SQL(x: str) -> str:
    order = sorted(latin.ALIASES, key=lambda a: (-len(a[1]), a[0]))
    return "CASE " + " ".join(f"WHEN contains({x}, '{a}') THEN '{k}'" for k, a in order) + " END"


def CLARIFIED(reason: str, company: str) -> str:
    named = rules.BASE_COMMA.join(rules.BASE_QUOTE + b + rules.BASE_QUOTE for b in latin.BASES)
    return f"CASE {reason} " + " ".join(f"WHEN '{k}' THEN replace(replace('{t}', '{{company}}', coalesce({company}, '')), '{{bases}}', '{named}')" for k, t in rules.CLARIFY_TEXTS.items()) + " END"


ENTITIES_SQL = f"""
WITH RECURSIVE k AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{p}')" for k, p in latin.ENTITIES.items())}) t(type, pattern)),
m AS (SELECT {QID} AS query_id, type, pattern, text AS rest, 0 AS done, regexp_extract(text, pattern, 1) AS word FROM conversations, k WHERE role = 'user'
  UNION ALL SELECT query_id, type, pattern, rest, done, regexp_extract(rest, pattern, 1) FROM (SELECT query_id, type, pattern, substr(rest, strpos(rest, word) + length(word)) AS rest, done + strpos(rest, word) + length(word) - 1 AS done FROM m WHERE word <> ''))
SELECT query_id, word AS text, type, min(done + strpos(rest, word) - 1)::INTEGER AS start, min(done + strpos(rest, word) - 1 + length(word))::INTEGER AS "end" FROM m WHERE word <> '' GROUP BY ALL
"""

UNDERSTOOD = f"""asked AS ({ASKED_SQL}),
known AS (SELECT *, {NORMAL_SQL("raw", "2024")} AS text, nullif(regexp_extract(raw, '{D["company"]}', 1), '') AS company, CASE WHEN NOT regexp_matches(raw, '(?i){latin.COMPARISON}') THEN {KB_SQL("raw")} END AS kb_name FROM asked),
h AS (SELECT *, last_value(company IGNORE NULLS) OVER w AS last, last_value(kb_name IGNORE NULLS) OVER w AS last_kb FROM known WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE WHEN i = 'unclear' THEN 'unclear' WHEN i = 'financial' AND NOT regexp_matches(raw, '{latin.ENTITIES["TIME"]}') AND NOT {MATCH("raw", C["no_time"])} THEN 'time'
  WHEN {ANY("raw", C["pronouns"])} AND last IS NOT NULL THEN 'pronoun' WHEN kb_name IS NULL AND i NOT IN ('comparison', 'greeting', 'unclear') AND {MATCH("raw", C["signs"])} AND last_kb IS NULL THEN 'company' END AS clarification FROM h),
{SUB_QUERIES("known")}"""
CLARIFY_SQL = f"WITH {UNDERSTOOD} SELECT query_id, clarification AS reason FROM c"
UNDERSTAND_SQL = f"""
WITH {UNDERSTOOD}
SELECT query_id, kb_name, i AS intent, confidence AS intent_confidence, md5(text) AS normalized_md5, md5(sub_queries) AS sub_queries_md5, clarification, clarification IS NOT NULL AS needs_clarification, {CLARIFIED("clarification", "last")} AS clarification_prompt FROM c JOIN sub USING (query_id)
"""


def ROUTE_SQL(x: str) -> str:
    words = " ".join(f"WHEN contains({x}, '{k}') THEN '{'|'.join(s)}'" for k, s in latin.KEYWORDS.items())
    intents = " ".join(f"WHEN {INTENT_SQL(x)} = '{k}' THEN '{'|'.join(s)}'" for k, s in latin.BY_INTENT.items())
    return f"CASE WHEN NOT {MATCH(x, ['(?i)' + p for p in latin.UNROUTED])} THEN CASE {words} {intents} END END"


def ROUTED(x: str, i: str) -> str:
    """The sections, as a list, for a text and its intent."""
    words = " ".join(f"WHEN contains({x}, '{k}') THEN [{quoted(w)}]" for k, w in latin.KEYWORDS.items())
    intents = " ".join(f"WHEN {i} = '{k}' THEN [{quoted(w)}]" for k, w in latin.BY_INTENT.items())
    return f"CASE WHEN NOT {MATCH(x, ['(?i)' + p for p in latin.UNROUTED])} THEN CASE {words} {intents} END END"


FITS = "({0}.kb_name IS NULL OR {1}.kb_name = {0}.kb_name) AND ({0}.sections IS NULL OR list_contains({0}.sections, {1}.section))"
ANSWER_SQL = f"""
WITH {UNDERSTOOD},
corpus AS (SELECT vec_id AS id, text, embedding, vec_id % 9 AS page_start, [{quoted(latin.SECTIONS)}][vec_id % {len(latin.SECTIONS)} + 1] AS section, label::VARCHAR AS content_type, [{quoted(latin.BASES)}][vec_id % {len(latin.BASES)} + 1] AS kb_name FROM embeddings JOIN documents ON doc_id = vec_id),
qs AS (SELECT query_id, kb_name, CASE WHEN len(subs) > 1 THEN array_to_string(list_filter(subs, lambda x, i: list_position(subs, x) = i), ' ') ELSE text END AS text, {ROUTED("text", "i")} AS sections FROM c JOIN sub USING (query_id) WHERE clarification IS NULL),
v AS (SELECT *, list_transform(range(1, 65), lambda j: (ord(substr(md5(text || j), 1, 1)) % 16) / 8.0::DOUBLE - 1) AS e FROM qs),
sc0 AS (SELECT v.query_id, d.id, list_dot_product(v.e, d.embedding::DOUBLE[]) AS score FROM v JOIN corpus d ON {FITS.format("v", "d")}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc0) WHERE rank <= 48),
{BM25("qs", "corpus", 16, f"EXISTS (SELECT 1 FROM qs, corpus d WHERE qs.query_id = sc.query_id AND d.id = sc.id AND {FITS.format('qs', 'd')})")}, {FUSE(8)}, {SOURCES("qs", "corpus")}
"""

ROUTE_ALL_SQL = f"""
WITH q AS (SELECT {QID} AS query_id, text, {" || ".join(f"CASE WHEN contains(text, '{k}') THEN [{quoted(s)}] ELSE [] END" for k, s in latin.KEYWORDS.items())} AS l,
  CASE {" ".join(f"WHEN {INTENT_SQL('text')} = '{k}' THEN '{'|'.join(s)}'" for k, s in latin.BY_INTENT.items())} ELSE '' END AS o FROM conversations WHERE role = 'user')
SELECT query_id, CASE WHEN len(l) > 0 THEN array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') ELSE o END AS sections FROM q
"""

LOG_SQL = "(SELECT event_id, ts, event_type AS intent, 'about ' || event_type || ' no ' || (event_id % 5) || [' ante', ' post', ' now'][event_id % 3 + 1] AS query, CASE WHEN event_id % 7 <> 0 THEN round(1 + value % 4, 2) END AS feedback FROM events)"
PATTERN_SQL = rf"regexp_replace(translate(query, '{latin.STOPS}', ''), '\d+', '[NUM]', 'g')"


def REPLAYED(key: str, first: str, step: str) -> str:
    """The events of each key in order, with `state` and `said` carried from one to the next; `was` is the state before, t the microseconds."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM (SELECT *, {key} AS key FROM events)),
s AS (SELECT event_id, key, n, {first} FROM e WHERE n = 1 UNION ALL SELECT event_id, key, n, {step} FROM (SELECT e.*, s.state AS was FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1))"""


RECENT = "list_filter(was, lambda x: x > t - 86400000000)"
LIMIT_SQL = f"{REPLAYED('user_id', '[t] AS state, true AS said', f'CASE WHEN len({RECENT}) < 3 THEN list_append({RECENT}, t) ELSE {RECENT} END, len({RECENT}) < 3')} SELECT event_id, key AS client, said AS accepted FROM s"
REPLAY_SQL = f"{REPLAYED("event_type || '/' || user_id", 't AS state, false AS said', 'CASE WHEN t - was < 432000000000 THEN was ELSE t END, t - was < 432000000000')} SELECT event_id, key AS cache_key, said AS hit FROM s"

VERDICTS_SQL = "v AS (SELECT doc_id, quality, toxic, doc_id % 5 AS k, round(quality * 0.7::DOUBLE + (doc_id % 10) * 0.05::DOUBLE - 0.1::DOUBLE, 2) AS s FROM labels)"
SCORE_SQL = "CASE WHEN k <= 2 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, s)) WHEN k = 3 THEN round(quality * 0.1::DOUBLE + 0.05::DOUBLE, 2) ELSE 0.0::DOUBLE END"
ITEMS_SQL = f"""{VERDICTS_SQL}, x AS (SELECT *, {SCORE_SQL} AS sc, doc_id % 11 = 0 AS silent, toxic = 1 AS negative, CASE WHEN k <= 2 THEN toxic = 1 ELSE {SCORE_SQL} > 0.7 END AS refused FROM v),
scored AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'eval' END AS "group", negative,
  CASE WHEN silent THEN 0 WHEN negative THEN refused::INTEGER ELSE sc END AS faithfulness, CASE WHEN silent THEN 0 WHEN negative THEN refused::INTEGER ELSE sc END AS answer_relevancy,
  CASE WHEN silent OR negative THEN 0 ELSE sc END AS context_precision, CASE WHEN silent THEN 0 WHEN negative THEN refused::INTEGER WHEN doc_id % 3 = 0 THEN 0 ELSE sc END AS context_recall,
  CASE WHEN silent AND negative THEN 1 WHEN negative THEN sc END AS hallucination_score FROM x)"""
SUMMARY_SQL = f"""
WITH {ITEMS_SQL}, m AS (SELECT "group", count(*) AS items, round(avg(faithfulness) FILTER (NOT negative), 4) AS faithfulness, round(avg(answer_relevancy) FILTER (NOT negative), 4) AS answer_relevancy,
  round(avg(context_precision) FILTER (NOT negative), 4) AS context_precision, round(avg(context_recall) FILTER (NOT negative), 4) AS context_recall, round(avg(hallucination_score) FILTER (negative), 4) AS hallucination_resistance FROM scored GROUP BY 1)
SELECT *, CASE WHEN (faithfulness + answer_relevancy + context_precision + context_recall) / 4 >= 0.8 THEN 'excellent' WHEN (faithfulness + answer_relevancy + context_precision + context_recall) / 4 >= 0.6 THEN 'good'
  WHEN (faithfulness + answer_relevancy + context_precision + context_recall) / 4 >= 0.4 THEN 'fair' ELSE 'poor' END AS band FROM m
"""

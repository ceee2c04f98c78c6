"""Questions in Chinese for the default rule tables, derived from the user turns: each word becomes a phrase by its digest, so they grow with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules, text
from millrace.operators import understanding
from millrace.plans.latin_sql import FIRST, MATCH, QID, STRIP, quoted

#: What questions and headings are put together from (fixed values).
PARTS = (
    "公司", "华为公司", "营业收入", "是多少", "2023年", "去年", "前年", "近期", "上期", "风险", "有哪些", "和", "与", "的", "注册资本", "主营业务", "你好", "对比", "供应商", "专利", "毛利率", "董事长", "是谁", "发行", "股东",
    "介绍一下", "诉讼", "它", "15.3%", "300万元", "1-1-1", "第三节 本次发行概况", "释 义", "Net assets", "在 一个", "变化", "某某科技", "产品", "独立董事", "，", "？",
)
SAID = f"list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: [{quoted(PARTS)}][('0x' || substr(md5(w), 1, 4))::INTEGER % {len(PARTS)} + 1])"
#: Every turn's first eight words make the question, and all its words the lines of a page.
ASKED_SQL = f"(SELECT {QID} AS query_id, array_to_string(({SAID})[1:turn % 8 + 1], '') AS text, array_to_string({SAID}, chr(10)) AS page FROM conversations WHERE role = 'user')"
YEAR = 2024


def asked(turns: DataFrame) -> DataFrame:
    """(query_id, text, page) from user turns (query_id, turn, query)."""
    names = F.array(*[F.lit(p) for p in PARTS])
    words = F.filter(F.split("query", " "), lambda w: w != "")
    said = F.transform(words, lambda w: F.element_at(names, (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % len(PARTS) + 1).cast("int")))
    return turns.select("query_id", F.array_join(F.slice(said, 1, (F.col("turn") % 8 + 1).cast("int")), "").alias("text"), F.array_join(said, "\n").alias("page"))


def hits(name: str) -> str:
    return "(" + " + ".join(f"regexp_matches(text, '(?i){p}')::INTEGER" for p in rules.INTENT_PATTERNS[name]) + ")"


RANKED = [k for k in rules.INTENTS if k in rules.INTENT_PATTERNS and k != "greeting"]
ALL = "[" + ", ".join(map(hits, RANKED)) + "]"
INTENT = f"CASE WHEN {hits('greeting')} > 0 THEN 'greeting' WHEN list_max({ALL}) = 0 THEN 'unclear' ELSE [{quoted(RANKED)}][list_position({ALL}, list_max({ALL}))] END"
CONFIDENCE = f"CASE WHEN {hits('greeting')} > 0 THEN 0.95::DOUBLE WHEN list_max({ALL}) = 0 THEN 0.3::DOUBLE ELSE round(least(0.9::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * list_max({ALL})), 6) END"
INTENT_SQL = f"SELECT query_id, {INTENT} AS intent, {CONFIDENCE} AS confidence FROM {ASKED_SQL}"

TOKENS_SQL = rf"""
WITH p AS (SELECT query_id, regexp_extract_all(text, '([\x{{4e00}}-\x{{9fa5}}]+|[a-zA-Z0-9]{{2,}})', 1) AS parts FROM {ASKED_SQL}),
t AS (SELECT query_id, list_filter(flatten(list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^[a-zA-Z0-9]') THEN [x] ELSE list_transform(range(1, greatest(length(x) - 1, 1) + 1), lambda i: substr(x, i, 2)) END)), lambda x: length(x) > 1 AND x NOT IN ({quoted(rules.STOP_WORDS)})) AS w FROM p)
SELECT query_id, len(w)::INTEGER AS n, md5(array_to_string(w, ' ')) AS tokens_md5 FROM t
"""


def normal() -> str:
    x = "text"
    for word, back in rules.RELATIVE_YEARS:
        x = f"replace({x}, '{word}', '{YEAR + back}{rules.YEAR_SUFFIX}')"
    for old, new in rules.PHRASES:
        x = f"replace({x}, '{old}', '{new}')"
    return x


NORMAL_SQL = f"SELECT query_id, {normal()} AS normalized FROM {ASKED_SQL}"

WORDS = " ".join(f"WHEN contains(text, '{k}') THEN '{'|'.join(s)}'" for k, s in rules.KEYWORD_SECTIONS.items())
BY_INTENT = " ".join(f"WHEN {INTENT} = '{k}' THEN '{'|'.join(s)}'" for k, s in rules.INTENT_SECTIONS.items())
ROUTE_SQL = f"SELECT query_id, CASE WHEN NOT {MATCH('text', ['(?i)' + p for p in rules.UNROUTED])} THEN CASE {WORDS} {BY_INTENT} END END AS sections FROM {ASKED_SQL}"

FOUND = f"CASE WHEN l = '' OR regexp_matches(l, '{rules.PAGE_NUMBER}') THEN NULL WHEN regexp_matches(l, '{rules.NUMBERED_HEADING}') THEN regexp_extract(l, '{rules.NUMBERED_HEADING}', 1) WHEN length(l) < 30 THEN {FIRST('l', rules.HEADINGS)} END"
HEADING_SQL = f"SELECT query_id, list_filter(list_transform(list_transform(string_split(page, chr(10))[1:10], lambda x: {STRIP('x')}), lambda l: {FOUND}), lambda x: x IS NOT NULL)[1] AS section FROM {ASKED_SQL}"

ENTITIES_SQL = f"""
WITH RECURSIVE k AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{p}')" for k, p in rules.ENTITY_PATTERNS.items())}) t(type, pattern)),
m AS (SELECT query_id, type, pattern, text AS rest, 0 AS done, regexp_extract(text, pattern, 1) AS word FROM {ASKED_SQL}, k
  UNION ALL SELECT query_id, type, pattern, rest, done, regexp_extract(rest, pattern, 1) FROM (SELECT query_id, type, pattern, substr(rest, strpos(rest, word) + length(word)) AS rest, done + strpos(rest, word) + length(word) - 1 AS done FROM m WHERE word <> ''))
SELECT query_id, word AS text, type, min(done + strpos(rest, word) - 1)::INTEGER AS start, min(done + strpos(rest, word) - 1 + length(word))::INTEGER AS "end" FROM m WHERE word <> '' GROUP BY ALL
"""


def intent(x: Column) -> Column:
    return understanding.intent(x)["intent"]


def queries(turns) -> dict:
    """Name to (query, SQL); turns: (spark, sf_dir) to the user turns."""

    def on(make):
        return lambda spark, sf_dir: make(asked(turns(spark, sf_dir)))

    def tokens(q: DataFrame) -> DataFrame:
        return q.select("query_id", text.tokens(F.col("text")).alias("w")).select("query_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))

    def normal_form(q: DataFrame) -> DataFrame:
        return q.select("query_id", understanding.normalize_time(F.col("text"), F.lit(f"{YEAR}-06-01").cast("date")).alias("normalized"))

    return {
        "tokenize_chinese": (on(tokens), TOKENS_SQL),
        "intent_chinese": (on(lambda q: q.select("query_id", understanding.intent(F.col("text")).alias("i")).select("query_id", "i.*")), INTENT_SQL),
        "normalize_time_chinese": (on(normal_form), NORMAL_SQL),
        "section_route_chinese": (on(lambda q: q.select("query_id", F.array_join(understanding.section_route(F.col("text"), intent(F.col("text"))), "|").alias("sections"))), ROUTE_SQL),
        "guess_section_chinese": (on(lambda q: q.select("query_id", text.guess_section(F.col("page")).alias("section"))), HEADING_SQL),
        "entities_chinese": (on(lambda q: understanding.entities(q, query_col="text").select("query_id", F.inline("entities"))), ENTITIES_SQL),
    }

"""Questions: intent, entities, normal form, sub-questions, clarification, knowledge base and sections."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import phrases, rules, text

ENTITY = "array<struct<text:string,type:string,start:int,end:int>>"


def intent(query: Column, patterns: Mapping[str, Sequence[str]] = rules.INTENT_PATTERNS, order: Sequence[str] = rules.INTENTS, greeting: str = "greeting", unclear: str = "unclear") -> Column:
    """struct(intent, confidence): the intent with most matching patterns, the first in order of several; a greeting goes before all."""
    hits = {name: sum((F.when(query.rlike(text.any_case(p)), 1).otherwise(0) for p in ps), F.lit(0)) for name, ps in patterns.items()}
    best = F.array_max(F.array(*[F.struct(hits.get(name, F.lit(0)).alias("hits"), F.lit(-i).alias("ord"), F.lit(name).alias("name")) for i, name in enumerate(order)]))
    answer = lambda name, confidence: F.struct(name.alias("intent"), confidence.cast("double").alias("confidence"))
    chosen = F.when(best["hits"] > 0, answer(best["name"], F.round(F.least(F.lit(0.9), 0.5 + best["hits"] * 0.1), 6))).otherwise(answer(F.lit(unclear), F.lit(0.3)))
    return F.when(hits[greeting] > 0, answer(F.lit(greeting), F.lit(0.95))).otherwise(chosen) if greeting in hits else chosen


def entities(queries: DataFrame, patterns: Mapping[str, str] = rules.ENTITY_PATTERNS, query_col: str = "query") -> DataFrame:
    """queries with entities: all matches of each type with their places, by start, the first of each text and type. Places need a helper, as built-in extraction gives texts only."""
    compiled = [(kind, re.compile(p)) for kind, p in patterns.items()]

    @F.pandas_udf(ENTITY)
    def find(query: pd.Series) -> pd.Series:
        def one(q):
            seen, out = set(), []
            for start, end, kind, word in sorted(((m.start(1), m.end(1), kind, m[1]) for kind, p in compiled for m in p.finditer(q or "")), key=lambda e: e[0]):
                if (word, kind) not in seen:
                    seen.add((word, kind))
                    out.append({"text": word, "type": kind, "start": start, "end": end})
            return out

        return query.map(one)

    return queries.withColumn("entities", find(query_col))


def normalize_time(query: Column, day: Column, years: Sequence[tuple[str, int]] = rules.RELATIVE_YEARS, phrases: Sequence[tuple[str, str]] = rules.PHRASES, suffix: str = rules.YEAR_SUFFIX) -> Column:
    """Relative years as years before `day`, then fixed phrases, in that order."""
    for word, back in years:
        query = F.replace(query, F.lit(word), F.concat((F.year(day) + back).cast("string"), F.lit(suffix)))
    for old, new in phrases:
        query = F.replace(query, F.lit(old), F.lit(new))
    return query


def decompose(
    query: Column, intent_name: Column, company: str = rules.COMPARED_COMPANY, metrics: Sequence[str] = rules.METRICS, default_metric: str = rules.DEFAULT_METRIC, of: str = "的", conjunctions: Sequence[str] = rules.CONJUNCTIONS,
    vague: str = rules.VAGUE, verbs: Mapping[str, Sequence[str]] = rules.VAGUE_VERBS, structure: Sequence[str] = rules.STRUCTURE_WORDS, structure_suffix: str = rules.STRUCTURE_SUFFIX, department: str = rules.DEPARTMENT,
    department_as: str = rules.DEPARTMENT_AS, facts: Sequence[str] = rules.COMPANY_FACTS, parents: Sequence[str] = rules.PARENT_NAMES, of_company: str = rules.OF_COMPANY, of_parent: str = rules.OF_PARENT, parent: str = rules.PARENT,
) -> Column:
    """Sub-questions: by compared companies, else by conjunctions; what a vague question expands to, a question on structure and one on company facts go over these, each over the one before."""
    alone = F.array(query)
    companies = F.regexp_extract_all(query, F.lit(company), F.lit(1))
    metric = F.coalesce(text.first_of(query, metrics), F.lit(default_metric))
    by_company = F.transform(companies, lambda c: F.concat(c, F.lit(of), metric))
    parts = F.filter(F.transform(F.split(query, f"[{''.join(conjunctions)}]"), text.strip), lambda p: F.length(p) > 3)
    split = F.when(F.size(parts) > 0, parts).otherwise(alone)
    compared = intent_name == "comparison"
    result = F.when(compared & (F.size(companies) >= 2), by_company).when(~compared & text.any_of(query, conjunctions), split).otherwise(alone)
    word = text.strip(F.regexp_extract(query, vague, 1))
    expanded = F.lit(None).cast("array<string>")
    for key, own in reversed(list(verbs.items())):
        more = F.array_distinct(F.concat(alone, F.array(*[F.replace(query, word, F.concat(F.lit(v), word)) for v in own])))
        expanded = F.when(F.contains(word, F.lit(key)), more).otherwise(expanded)
    result = F.when((F.length(word) >= 2) & (F.size(expanded) > 1), expanded).otherwise(result)
    with_suffix = F.when(~F.contains(query, F.lit(structure_suffix)), F.concat(query, F.lit(f" {structure_suffix}")))
    as_structure = F.when(F.contains(query, F.lit(department)) & ~F.contains(query, F.lit(department_as)), F.replace(query, F.lit(department), F.lit(department_as)))
    result = F.when(text.any_of(query, structure), F.array_distinct(F.array_compact(F.array(query, with_suffix, as_structure)))).otherwise(result)
    rewritten = F.when(F.contains(query, F.lit(of_company)), F.replace(query, F.lit(of_company), F.lit(of_parent))).otherwise(F.concat(F.lit(parent), query))
    return F.when(text.any_of(query, facts) & ~text.any_of(query, parents), F.array(rewritten, query)).otherwise(result)


def clarify(query: Column, intent_name: Column, has_time: Column, last_company: Column, kb: Column, history_kb: Column, no_time: Sequence[str] = rules.NO_TIME_NEEDED, pronouns: Sequence[str] = rules.PRONOUNS, signs: Sequence[str] = rules.COMPANY_SIGNS) -> Column:
    """Why a question needs clarification, or null: unclear, out_of_scope, time, pronoun, company, in that order.

    last_company: of the latest earlier question that names one; history_kb: what an earlier question resolved to.
    """
    return (
        F.when(intent_name == "unclear", "unclear")
        .when(intent_name == "out_of_scope", "out_of_scope")
        .when((intent_name == "financial") & ~has_time & ~text.matches_any(query, no_time), "time")
        .when(text.any_of(query, pronouns) & last_company.isNotNull(), "pronoun")
        .when(kb.isNull() & ~intent_name.isin("comparison", "greeting", "unclear") & text.matches_any(query, signs) & history_kb.isNull(), "company")
    )


def clarification_text(reason: Column, company: Column, bases: Sequence[str] = (), texts: Mapping[str, str] = rules.CLARIFY_TEXTS) -> Column:
    """What a question with this reason is answered with, the company meant and the names of knowledge bases put in; null without a reason."""
    named = rules.BASE_COMMA.join(f"{rules.BASE_QUOTE}{b}{rules.BASE_QUOTE}" for b in bases)
    said = F.coalesce(*[F.when(reason == k, F.lit(t.replace("{bases}", named))) for k, t in texts.items()])
    return F.replace(said, F.lit("{company}"), F.coalesce(company, F.lit("")))


def resolve_kb(queries: DataFrame, aliases: DataFrame, query_col: str = "query", comparison: str = rules.COMPARISON) -> DataFrame:
    """queries with kb_name: of the longest alias that the question contains (the first by name of several); null for comparisons and without one.

    aliases (kb_name, alias) become automata of a bounded size, one or more by the table's
    size, which read a question once each. An alias table is read on the driver block by
    block; of an alias with several names the first by name counts.
    """
    named = aliases.where((F.length("alias") > 0) & F.col("kb_name").isNotNull()).groupBy("alias").agg(F.min("kb_name").alias("kb_name"))
    table = named.orderBy(F.desc(F.length("alias")), "kb_name", "alias")  # the first that a question contains is the best
    asked = F.when(~F.col(query_col).rlike(text.any_case(comparison)), F.col(query_col))
    return queries.withColumn("kb_name", phrases.first_found(queries.sparkSession, asked, ((r.alias, r.kb_name) for r in table.toLocalIterator())))


def routed(query: Column, unrouted: Sequence[str] = rules.UNROUTED) -> Column:
    """Whether sections are chosen for a question at all."""
    return ~text.matches_any(query, [text.any_case(p) for p in unrouted])


def section_route(query: Column, intent_name: Column, keywords: Mapping[str, Sequence[str]] = rules.KEYWORD_SECTIONS, by_intent: Mapping[str, Sequence[str]] = rules.INTENT_SECTIONS, unrouted: Sequence[str] = rules.UNROUTED) -> Column:
    """Sections of the first keyword in the question, else of its intent, else null."""
    listed = lambda s: F.array(*[F.lit(x) for x in s])
    of_word = F.coalesce(*[F.when(F.contains(query, F.lit(k)), listed(s)) for k, s in keywords.items()]) if keywords else F.lit(None)
    of_intent = F.coalesce(*[F.when(intent_name == k, listed(s)) for k, s in by_intent.items()]) if by_intent else F.lit(None)
    return F.when(routed(query, unrouted), F.coalesce(of_word, of_intent))


def section_route_all(query: Column, intent_name: Column, keywords: Mapping[str, Sequence[str]] = rules.KEYWORD_SECTIONS, by_intent: Mapping[str, Sequence[str]] = rules.INTENT_SECTIONS) -> Column:
    """Sections of all keywords in the question, each once, in the table's order; else of its intent; else none."""
    none = F.array().cast("array<string>")
    listed = lambda s: F.array(*[F.lit(x) for x in s])
    of_words = F.array_distinct(F.concat(none, *[F.when(F.contains(query, F.lit(k)), listed(s)).otherwise(none) for k, s in keywords.items()]))
    of_intent = F.coalesce(*[F.when(intent_name == k, listed(s)) for k, s in by_intent.items()], none)
    return F.when(F.size(of_words) > 0, of_words).otherwise(of_intent)


def section_routes(queries: DataFrame, keywords: DataFrame, intent_sections: DataFrame | None = None, query_col: str = "query", unrouted: Sequence[str] = rules.UNROUTED, every: bool = False) -> DataFrame:
    """section_route (or, with every, section_route_all) by tables of any size: queries with sections.

    keywords: ord, keyword, sections; intent_sections: intent, sections, for queries with an
    intent. Keywords are looked for by automata, as aliases are; one that stands twice counts
    where it stands first.
    """
    spark = queries.sparkSession
    listed = [(r.keyword, list(r.sections)) for r in keywords.where(F.length("keyword") > 0).groupBy("keyword").agg(F.min("ord").alias("ord"), F.min_by("sections", "ord").alias("sections")).orderBy("ord", "keyword").toLocalIterator()]
    groups, at = [], 0
    for own in phrases.blocks(listed):
        groups.append((at, own))
        at += len(own)
    table = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(listed)], "__number int, __sections array<string>")
    numbered = queries.withColumn("__row", F.monotonically_increasing_id())
    asked = F.col(query_col) if every else F.when(routed(F.col(query_col), unrouted), F.col(query_col))

    def numbers(low: int, own: list) -> Column:
        return F.transform(phrases.found_in(spark, asked, [k for k, _ in own]), lambda i: i + low)

    found = F.flatten(F.array(*[numbers(*g) for g in groups])) if groups else F.array().cast("array<int>")
    numbered = numbered.withColumn("__found", found if every else F.slice(found, 1, 1))
    hit = numbered.select("__row", F.explode("__found").alias("__number")).join(table, "__number").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__number", "__sections"))).alias("__hit"))
    merged = numbered.join(hit, "__row", "left").withColumn("sections", F.array_distinct(F.flatten(F.transform("__hit", lambda h: h["__sections"]))))
    if intent_sections is not None:
        by = intent_sections.select("intent", F.col("sections").alias("__of_intent"))
        merged = merged.join(by, "intent", "left")
        own = F.col("__of_intent") if every else F.when(routed(F.col(query_col), unrouted), F.col("__of_intent"))
        merged = merged.withColumn("sections", F.coalesce("sections", own))
    if every:
        merged = merged.withColumn("sections", F.coalesce("sections", F.array().cast("array<string>")))
    return merged.select(*queries.columns, "sections")


def hits_in_sections(hits: DataFrame, routes: DataFrame) -> DataFrame:
    """Hits whose section their query (query_id, sections) is routed to; queries with null sections keep all."""
    wanted = routes.select("query_id", F.explode("sections").alias("section"))
    free = routes.where(F.col("sections").isNull()).select("query_id")
    return hits.join(wanted, ["query_id", "section"], "left_semi").unionByName(hits.join(free, "query_id", "left_semi").select(hits.columns), allowMissingColumns=False)


def understand(queries: DataFrame, aliases: DataFrame, day: Column, session: str = "session_id", turn: str = "turn", entity_patterns: Mapping[str, str] = rules.ENTITY_PATTERNS, company_type: str = "COMPANY", time_type: str = "TIME", bases: Sequence[str] = (), **rule_sets) -> DataFrame:
    """The whole understanding of each question (query_id, session_id, turn, query); what a session asked before counts as its history. bases: names of knowledge bases to offer where the company is open."""
    x = entities(resolve_kb(queries, aliases, **rule_sets.get("resolve_kb", {})), entity_patterns)
    x = x.withColumn("__intent", intent(F.col("query"), **rule_sets.get("intent", {})))
    x = x.withColumn("normalized_query", normalize_time(F.col("query"), day, **rule_sets.get("normalize", {})))
    x = x.withColumns({"intent": F.col("__intent.intent"), "intent_confidence": F.col("__intent.confidence")}).drop("__intent")
    before = W.partitionBy(session).orderBy(turn).rowsBetween(W.unboundedPreceding, -1)
    company = F.try_element_at(F.filter("entities", lambda e: e["type"] == company_type), F.lit(1))["text"]
    x = x.withColumn("__company", company)
    x = x.withColumns({"__last": F.last("__company", ignorenulls=True).over(before), "__kb": F.last("kb_name", ignorenulls=True).over(before)})
    reason = clarify(F.col("query"), F.col("intent"), F.exists("entities", lambda e: e["type"] == time_type), F.col("__last"), F.col("kb_name"), F.col("__kb"), **rule_sets.get("clarify", {}))
    x = x.withColumns({"sub_queries": decompose(F.col("normalized_query"), F.col("intent"), **rule_sets.get("decompose", {})), "clarification": reason})
    said = clarification_text(F.col("clarification"), F.col("__last"), bases, **rule_sets.get("clarification_text", {}))
    return x.withColumns({"needs_clarification": F.col("clarification").isNotNull(), "clarification_prompt": said}).drop("__company", "__last", "__kb")

"""Retrieval from questions to answer sources in one plan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import lexical, search, understanding
from millrace.sources.shared import stash


def batch_retrieve(queries: DataFrame, corpus: DataFrame, k: int = 8, rerank_k: int = 5, least: float = 0.2, scorer: Callable[[pd.DataFrame], pd.Series] | None = None, score: str = "score", index: lexical.LexicalIndex | None = None, vectors: search.VectorIndex | None = None, **filters) -> DataFrame:
    """Sources of each question (query_id, query, embedding[, needs_clarification][, kb_name][, sections]) from corpus rows (id, text, embedding, page_start, section, content_type and the filters' columns).

    A question's knowledge base, where it has one, and its sections, where it is routed to
    any, are held to before anything is ranked: 6k vector candidates and 2k lexical ones of
    these rows are fused to k, reranked to rerank_k, filtered by `score` (the inner product,
    or fused_score) and cut to sources. Questions that need clarification get none. Of a
    corpus in partitions by kb_name those that questions ask for are read.

    index: of the corpus's texts with kb_name and section in its scope, else made for this;
    vectors: an inverted file over the same rows, else all rows are compared. filters hold
    for all questions; with an index of its own the corpus must be filtered by the caller.
    """
    if "needs_clarification" in queries.columns:
        queries = queries.where(~F.coalesce(F.col("needs_clarification"), F.lit(False)))
    if index is not None and any(v is not None for v in filters.values()):
        raise ValueError("an index holds the whole corpus: put filters into the questions' own columns")
    corpus = corpus.where(search.matching(filters))
    scope = [c for c in ("kb_name", "section") if c in corpus.columns and (c if c == "kb_name" else "sections") in queries.columns]
    asked = queries.withColumnRenamed("sections", "section") if "section" in scope else queries
    vector = search.vector_topk(asked, corpus, 6 * k, scope) if vectors is None else search.ivf_ask(vectors, asked, 6 * k, scope=scope)
    words = asked.select("query_id", F.col("query").alias("text"), *scope)
    found = lexical.bm25_topk(words, corpus.select("id", "text", *scope), 2 * k, scope=scope) if index is None else lexical.bm25_ask(index, words, 2 * k)
    fused = search.hybrid_topk(vector, found, k)
    texts = corpus.select("id", "text", "page_start", "section", "content_type")
    # a corpus row joins only where it was found: the hits are few, so Spark sends them to the corpus
    full = fused.join(texts, "id").join(queries.select("query_id", "query"), "query_id")
    ranked = search.rerank(full, scorer, rerank_k).withColumnRenamed("new_rank", "rank")
    return search.sources(search.score_filter(ranked, least, rerank_k, score))


def answer_sources(questions: DataFrame, aliases: DataFrame, day: Column, corpus: DataFrame, encode: Callable[[Column], Column], scorer: Callable[[pd.DataFrame], pd.Series] | None = None, rule_sets: dict | None = None, routing: dict | None = None, **options) -> DataFrame:
    """From questions (query_id, session_id, turn, query) to sources: understanding, sub-questions, knowledge base and sections, then batch_retrieve.

    A question that names a company is asked of that company's knowledge base (kb_name), one
    that compares is asked of all. Several sub-questions are asked as one. encode: a vector of
    what is asked; rule_sets and routing: of understand and section_route.
    """
    known = understanding.understand(questions, aliases, day, **(rule_sets or {}))
    asked = known.select(
        "query_id", "kb_name", "needs_clarification", search.compound_query(F.col("sub_queries"), F.col("normalized_query")).alias("query"),
        understanding.section_route(F.col("normalized_query"), F.col("intent"), **(routing or {})).alias("sections"),
    )
    told = stash(asked.withColumn("embedding", encode(F.col("query"))), "asked")  # read by both searches and for the texts: understood once
    return batch_retrieve(told, corpus, scorer=scorer, **options)

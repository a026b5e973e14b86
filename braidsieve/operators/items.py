"""Benchmark items and corpus documents as tables of one shape.

Items: (item_id, benchmark, split, question, choices, answer).  Documents: (doc_key, doc_id, text[, tokens]); doc_key is unique
and orders the corpus, doc_id is what a result names.  A null id becomes ``row-{doc_key}``; a null text is malformed.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidsieve.operators.numbering import running_before

QUESTION, QUESTION_CHOICES = "question", "question_choices"


def view_text(view: str) -> Column:
    """The text that is searched: the question, with the choices on lines of their own if the view has them.  Answers are
    never searched."""
    if view not in (QUESTION, QUESTION_CHOICES):
        raise ValueError(f"unknown view {view!r}")
    question = F.coalesce("question", F.lit(""))
    if view == QUESTION:
        return question
    return F.when(F.coalesce(F.size("choices"), F.lit(0)) <= 0, question).otherwise(F.concat_ws("\n", question, "choices"))


def rendered() -> Column:
    """An item as it would stand on a page."""
    return view_text(QUESTION_CHOICES)


def benchmark_of(item_id: Column) -> Column:
    """The part of an item id before its first colon."""
    return F.split_part(item_id, F.lit(":"), F.lit(1))


def corpus(df: DataFrame, key: str, id: str, text: str = "text", tokens: str | None = None) -> DataFrame:
    """Any table as documents."""
    name = F.coalesce(F.col(id).cast("string"), F.concat(F.lit("row-"), F.col(key).cast("string")))
    more = [F.coalesce(F.col(tokens), F.lit(0)).alias("tokens")] if tokens else []
    return df.select(F.col(key).alias("doc_key"), name.alias("doc_id"), F.col(text).alias("text"), *more)


def last_within(docs: DataFrame, max_docs: int | None = None, max_tokens: int | None = None) -> Any:
    """The last doc_key of ``within_budget``; None if there is none."""
    return within_budget(docs, max_docs, max_tokens).agg(F.max("doc_key")).first()[0]


def within_budget(docs: DataFrame, max_docs: int | None = None, max_tokens: int | None = None) -> DataFrame:
    """The first documents by doc_key, until a budget is used up: a document is taken while the tokens of those before it are
    below the budget, so the one that crosses it is kept.

    Only keys and token counts are moved to find the last key; the documents are then filtered by it at the scan."""
    for amount, most in ((F.lit(1), max_docs), (F.col("tokens") if max_tokens is not None else None, max_tokens)):
        if most is not None:
            last = running_before(docs, "doc_key", amount).where(F.col("before") < most).agg(F.max("doc_key")).first()[0]
            docs = docs.where(F.col("doc_key") <= last if last is not None else F.lit(False))
    return docs

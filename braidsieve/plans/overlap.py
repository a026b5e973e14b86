"""Queries of the overlap scan: normal forms, the index, hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsieve.functions.text import normal_form, token_count, token_line
from braidsieve.operators import containment as ct
from braidsieve.operators import lookup
from braidsieve.operators.items import QUESTION, QUESTION_CHOICES, benchmark_of, corpus, view_text, within_budget
from braidsieve.plans import oracle as sql

COLUMNS = "item_id, doc_key, doc_id, level, containment, matched_ngrams, total_ngrams, ngram_size, exact, short, window_start, snippet"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/mini_benchmark.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark.read.parquet(f"{sf_dir}/mini_corpus.parquet"), "pos", "id", tokens="token_count")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "doc_id")


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/eval_items.parquet")


def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_key", normal_form("text").alias("normal"))


def token_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_key", token_line("text").alias("line"))


def token_counts(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_key", token_count(token_line("text")).alias("tokens"))


def item_views(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", benchmark_of(F.col("item_id")).alias("of"), view_text(QUESTION).alias("question_text"), view_text(QUESTION_CHOICES).alias("full_text"))


def item_lengths(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", token_count(token_line(view_text(QUESTION_CHOICES))).alias("tokens"))


def gpt3_n(spark, sf_dir):
    return ct.adaptive_size(items(spark, sf_dir))


def _gram_texts(line: F.Column, n: int) -> F.Column:
    words = F.split(line, " ")
    last = F.greatest(F.size(words) - n + 1, F.lit(0))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, n)))).otherwise(F.array().cast("array<string>"))


def ngram_df(spark, sf_dir):
    """In how many distinct item texts each 3-gram stands."""
    lines, _ = ct.entry_lines(items(spark, sf_dir), QUESTION_CHOICES, 3)
    return lines.select(F.explode(F.array_distinct(_gram_texts(F.col("line"), 3))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))


def stop_ngrams(spark, sf_dir):
    """3-grams of at least five distinct item texts."""
    return ngram_df(spark, sf_dir).where("texts >= 5")


def duplicate_item_groups(spark, sf_dir):
    lines, _ = ct.entry_lines(items(spark, sf_dir), QUESTION, 1)
    return lines.where(F.size("item_ids") > 1).select("item_ids", "tokens")


def index_entries(spark, sf_dir):
    e = ct.build_index(items(spark, sf_dir), n=8, stop_k=5).entries
    return e.select("line", "item_ids", "size", "total", "short")


def index_summary(spark, sf_dir):
    return ct.build_index(items(spark, sf_dir), n=8).summary()


def skipped_items(spark, sf_dir):
    return ct.build_index(items(spark, sf_dir), view=QUESTION, n=3, stop_k=5).skipped


def indexed_by_benchmark(spark, sf_dir):
    """Items and indexed items of each benchmark."""
    all_ = items(spark, sf_dir)
    found = ct.build_index(all_, n=3, stop_k=5).item_ids()
    both = all_.select("item_id").join(found.withColumn("in", F.lit(1)), "item_id", "left")
    return both.groupBy(benchmark_of(F.col("item_id")).alias("benchmark")).agg(F.count(F.lit(1)).alias("items"), F.count("in").alias("indexed"))


def _hits(spark, sf_dir, at, n, view=QUESTION, stop_k=None, min_tokens=None, **how):
    """Held-out items in the pages."""
    index = ct.build_index(held_out(spark, sf_dir), view=view, n=n, stop_k=stop_k, min_tokens=min_tokens)
    out = ct.scan(pages(spark, sf_dir), index, at, **how)
    index.drop()  # 240 items are sent to the tasks
    return out


def hits_default(spark, sf_dir):
    """The library's defaults: n = 8, question and choices."""
    return _hits(spark, sf_dir, ct.Thresholds(), 8, QUESTION_CHOICES)


def hits_question(spark, sf_dir):
    return _hits(spark, sf_dir, ct.Thresholds(), 8)


def hits_corpus(spark, sf_dir):
    """All benchmark items in the corpus."""
    return ct.scan(docs(spark, sf_dir), ct.build_index(items(spark, sf_dir), view=QUESTION, n=2), ct.Thresholds(0.3, 0.9))


def hits_corpus_joined(spark, sf_dir):
    """The same in rounds, as a large index is read, with windows and snippets."""
    index = ct.build_index(items(spark, sf_dir), view=QUESTION, n=2)
    return ct.scan(docs(spark, sf_dir), index, ct.Thresholds(0.3, 0.9), window_slack=1.5, snippet_chars=80, block_grams=0)


def hits_scan_config(spark, sf_dir):
    return _hits(spark, sf_dir, ct.Thresholds(0.5, 0.9), 3, window_slack=1.5, snippet_chars=200)


def hits_stop_grams(spark, sf_dir):
    return _hits(spark, sf_dir, ct.Thresholds(0.5, 0.9), 3, stop_k=5, window_slack=1.5)


def containment_whole(spark, sf_dir):
    """Whole-document containment of held-out questions in the pages."""
    return _hits(spark, sf_dir, ct.Thresholds(0.3, 0.8), 3)


def containment_windowed(spark, sf_dir):
    return _hits(spark, sf_dir, ct.Thresholds(0.3, 0.8), 2, window_slack=1.5)


def exact_match(spark, sf_dir):
    return hits_question(spark, sf_dir).where("exact").select("item_id", "doc_key")


def short_item_hits(spark, sf_dir):
    """Items of fewer than 25 tokens, matched whole, in the questions and choices of all items."""
    texts = items(spark, sf_dir).select("pos", "item_id", view_text(QUESTION_CHOICES).alias("text"))
    index = ct.build_index(items(spark, sf_dir), view=QUESTION, n=25, min_tokens=2, only_short=True)
    return ct.scan(corpus(texts, "pos", "item_id"), index, ct.Thresholds())


def gpt3_flags(spark, sf_dir):
    """Any shared n-gram flags an item; n by the items' lengths, short items whole."""
    index = ct.build_adaptive_index(held_out(spark, sf_dir))
    return ct.scan(pages(spark, sf_dir), index, ct.ANY_OVERLAP).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("containment").alias("most"))


def scan_stats(spark, sf_dir):
    return ct.scan_stats(pages(spark, sf_dir), hits_question(spark, sf_dir))


def token_budget(spark, sf_dir):
    return within_budget(docs(spark, sf_dir), max_tokens=20_000).select("doc_key", "doc_id", "tokens")


def doc_budget(spark, sf_dir):
    return within_budget(docs(spark, sf_dir), max_docs=50).select("doc_key", "doc_id")


def find_documents(spark, sf_dir):
    """Documents looked up by id, and the ids that are missing."""
    out = lookup.find_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["7", "11", "no such id"])
    return out.select("doc_id", "found", F.length("text").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, token_lines, token_counts, item_views, item_lengths, gpt3_n, ngram_df, stop_ngrams, duplicate_item_groups, index_entries, index_summary, skipped_items,
        indexed_by_benchmark, hits_default, hits_question, hits_corpus, hits_corpus_joined, hits_scan_config, hits_stop_grams, containment_whole, containment_windowed, exact_match, short_item_hits, gpt3_flags, scan_stats,
        token_budget, doc_budget, find_documents,
    )
}

_DOCS = f"SELECT doc_key, {{}} FROM (SELECT pos AS doc_key, text FROM mini_corpus)"
_DF = f"""WITH it AS (SELECT DISTINCT {sql.tokens(sql.view(True))} AS tok FROM mini_benchmark),
g AS (SELECT gram, count(*) AS texts FROM (SELECT unnest(list_distinct({sql.grams('tok', '3')})) AS gram FROM it) GROUP BY gram)
"""
_EVAL = dict(items="eval_items", choices=False, docs=sql.DOCUMENTS)

_GPT3_N = f"""gl AS (SELECT len({sql.tokens(sql.view(True))}) AS tokens FROM eval_items), gr AS (SELECT tokens, row_number() OVER (ORDER BY tokens) AS r, count(*) OVER () AS c FROM gl),
gn AS (SELECT greatest(1, least(13, tokens)) AS n FROM gr WHERE r = greatest(ceil(0.05 * c), 1))"""

SQL = {
    "normalize_text": _DOCS.format(sql.normal("text") + " AS normal"),
    "token_lines": _DOCS.format(f"array_to_string({sql.tokens('text')}, ' ') AS line"),
    "token_counts": f"SELECT doc_id AS doc_key, len({sql.tokens('text')}) AS tokens FROM documents",
    "item_views": f"SELECT item_id, split_part(item_id, ':', 1) AS of, {sql.view(False)} AS question_text, {sql.view(True)} AS full_text FROM mini_benchmark",
    "item_lengths": f"SELECT item_id, len({sql.tokens(sql.view(True))}) AS tokens FROM mini_benchmark",
    "gpt3_n": f"""WITH l AS (SELECT len({sql.tokens(sql.view(True))}) AS tokens FROM mini_benchmark), r AS (SELECT tokens, row_number() OVER (ORDER BY tokens) AS n, count(*) OVER () AS c FROM l)
SELECT c AS items, greatest(1, least(13, tokens)) AS n FROM r WHERE n = greatest(ceil(0.05 * c), 1)""",
    "ngram_df": _DF + "SELECT * FROM g",
    "stop_ngrams": _DF + "SELECT * FROM g WHERE texts >= 5",
    "duplicate_item_groups": f"""SELECT list(item_id ORDER BY item_id) AS item_ids, len(tok) AS tokens FROM (SELECT item_id, {sql.tokens(sql.view(False))} AS tok FROM mini_benchmark)
WHERE len(tok) >= 1 GROUP BY tok HAVING count(*) > 1""",
    "index_entries": f"WITH {sql.index(8, stop_k=5)} SELECT array_to_string(tok, ' ') AS line, ids AS item_ids, size, total, len < 8 AS short FROM ent JOIN tot USING (eid)",
    "index_summary": f"""WITH {sql.index(8)} SELECT sum(len(ids))::BIGINT AS indexed_items, count(*) AS entries, list_sort(list(DISTINCT size)) AS sizes,
(SELECT count(*) FROM (SELECT DISTINCT size, g FROM kept)) AS table_size FROM ent""",
    "skipped_items": f"""WITH {sql.index(3, choices=False, stop_k=5)} SELECT item_id, 'too_short' AS reason FROM it WHERE len(tok) < 3
UNION ALL SELECT unnest(ids), 'all_stop_ngrams' FROM ent WHERE eid NOT IN (SELECT eid FROM tot)""",
    "indexed_by_benchmark": f"""WITH {sql.index(3, stop_k=5)}, i AS (SELECT unnest(ids) AS item_id FROM ent JOIN tot USING (eid))
SELECT split_part(item_id, ':', 1) AS benchmark, count(*) AS items, count(i.item_id) AS indexed FROM mini_benchmark b LEFT JOIN i USING (item_id) GROUP BY 1""",
    "hits_default": sql.hits(8, 0.5, 0.8, **(_EVAL | {"choices": True})) + f"SELECT {COLUMNS} FROM hits",
    "hits_question": sql.hits(8, 0.5, 0.8, **_EVAL) + f"SELECT {COLUMNS} FROM hits",
    "hits_corpus": sql.hits(2, 0.3, 0.9, choices=False) + f"SELECT {COLUMNS} FROM hits",
    "hits_corpus_joined": sql.hits(2, 0.3, 0.9, slack=1.5, snippet=80, choices=False) + f"SELECT {COLUMNS} FROM hits",
    "gpt3_flags": sql.hits("(SELECT n FROM gn)", 1e-9, 0.8, min_tokens=1, **(_EVAL | {"choices": True})).replace("WITH ", f"WITH {_GPT3_N}, ", 1) + "SELECT item_id, count(*) AS documents, max(containment) AS most FROM hits GROUP BY 1",
    "hits_scan_config": sql.hits(3, 0.5, 0.9, slack=1.5, snippet=200, **_EVAL) + f"SELECT {COLUMNS} FROM hits",
    "hits_stop_grams": sql.hits(3, 0.5, 0.9, slack=1.5, stop_k=5, **_EVAL) + f"SELECT {COLUMNS} FROM hits",
    "containment_whole": sql.hits(3, 0.3, 0.8, **_EVAL) + f"SELECT {COLUMNS} FROM hits",
    "containment_windowed": sql.hits(2, 0.3, 0.8, slack=1.5, **_EVAL) + f"SELECT {COLUMNS} FROM hits",
    "exact_match": sql.hits(8, 0.5, 0.8, **_EVAL) + "SELECT item_id, doc_key FROM hits WHERE exact",
    "short_item_hits": sql.hits(25, 0.5, 0.8, min_tokens=2, choices=False, docs=f"SELECT pos AS doc_key, item_id AS doc_id, {sql.view(True)} AS text FROM mini_benchmark") + f"SELECT {COLUMNS} FROM hits WHERE short",
    "scan_stats": sql.hits(8, 0.5, 0.8, **_EVAL) + "SELECT (SELECT count(*) FROM d) AS documents, (SELECT sum(len(tok)) FROM d)::BIGINT AS tokens, (SELECT count(*) FROM hits) AS hits, (SELECT count(*) FROM documents WHERE text IS NULL) AS malformed",
    "token_budget": """SELECT doc_key, doc_id, tokens FROM (SELECT pos AS doc_key, coalesce(id, 'row-' || pos) AS doc_id, coalesce(token_count, 0) AS tokens,
coalesce(sum(coalesce(token_count, 0)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mini_corpus) WHERE before < 20000""",
    "doc_budget": "SELECT pos AS doc_key, coalesce(id, 'row-' || pos) AS doc_id FROM mini_corpus ORDER BY pos LIMIT 50",
    "find_documents": "SELECT w.doc_id, text IS NOT NULL AS found, length(text) AS chars FROM (SELECT unnest(['7', '11', 'no such id']) AS doc_id) w LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = w.doc_id",
}

"""Queries of corruptions, planted corpora, evaluations and the fuzzy and streaming scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from braidsieve.operators import corrupt, evaluate, plant
from braidsieve.operators.compare import compare_methods as compare
from braidsieve.operators.fuzzy import fuzzy_scan
from braidsieve.operators.items import QUESTION, QUESTION_CHOICES, corpus
from braidsieve.plans import oracle as sql
from braidsieve.plans.overlap import held_out, items, pages
from braidsieve.scratch import folder, save
from braidsieve.sources import synthetic
from braidsieve.sources.files import remove


def _one(spec: corrupt.Spec):
    def run(spark, sf_dir):
        return items(spark, sf_dir).select("item_id", corrupt.corrupted(spec).alias("planted"))

    return run


corrupt_verbatim = _one(corrupt.Spec("verbatim"))
corrupt_punct_delete = _one(corrupt.Spec("punct_delete"))
corrupt_labelled_dot = _one(corrupt.Spec("labelled_dot"))
corrupt_labelled_paren = _one(corrupt.Spec("labelled_paren"))
corrupt_truncate = _one(corrupt.Spec("truncate", 0.6))


def corrupt_by_chance(spark, sf_dir):
    """All 20 conditions of every held-out item."""
    return corrupt.corrupt_all(held_out(spark, sf_dir), corrupt.default_specs())


def _planted(spark, sf_dir, per_spec=240):
    """All conditions of all held-out items."""
    return plant.plant(held_out(spark, sf_dir), pages(spark, sf_dir), items_per_spec=per_spec, controls=500, seed=3)


def planted_corpus(spark, sf_dir):
    """The manifest of a corpus planted with all conditions."""
    return _planted(spark, sf_dir).plants


def planted_shortfalls(spark, sf_dir):
    return _planted(spark, sf_dir, per_spec=1000).shortfalls


def verify_plants(spark, sf_dir):
    """Plants that do not stand where the manifest says, in a corpus that lost the documents of one condition and in which the
    plants of another were overwritten."""
    made = _planted(spark, sf_dir)
    whole = made.documents.where("doc_id not like 'plant:html_wrap:%'")
    broken = whole.withColumn("text", F.when(F.col("doc_id").like("plant:truncate@0.6:%"), F.translate("text", "aeiou", "bbbbb")).otherwise(F.col("text")))
    return plant.verify(plant.PlantedCorpus(broken, made.plants, made.controls, made.shortfalls))


def eval_summary(spark, sf_dir):
    point = evaluate.OperatingPoint(3, 5, QUESTION_CHOICES, 0.3, 0.9, 0.0, 0.0)
    return evaluate.evaluate_at(held_out(spark, sf_dir), _planted(spark, sf_dir), point)


def macro_recall(spark, sf_dir):
    return evaluate.macro_recall(eval_summary(spark, sf_dir))


def eval_json(spark, sf_dir):
    """The summary as JSON, a record for each condition."""
    return eval_summary(spark, sf_dir).select("spec", F.to_json(F.struct("*")).alias("record"))


def _sweep(spark, sf_dir):
    return evaluate.sweep(held_out(spark, sf_dir), _planted(spark, sf_dir), ns=(3, 5), views=(QUESTION_CHOICES,), partials=(0.3, 0.5), window_slacks=(None, 1.5))


def threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


def operating_point(spark, sf_dir):
    """Settings from the best on, within the bound on control flags."""
    return evaluate.ranked_points(_sweep(spark, sf_dir), view=QUESTION_CHOICES, max_control_fpr_upper=0.2)


def compare_methods(spark, sf_dir):
    return compare(held_out(spark, sf_dir), _planted(spark, sf_dir)).drop("seconds")


def fuzzy_hits(spark, sf_dir):
    """Held-out questions within windows of the pages."""
    return fuzzy_scan(pages(spark, sf_dir), held_out(spark, sf_dir), view=QUESTION, k=3)


def synthetic_background(spark, sf_dir):
    return synthetic.background(spark, 200, 5)


def synthetic_items(spark, sf_dir):
    return synthetic.items(spark, 200, 5)


def streaming_scan(spark, sf_dir):
    """The held-out items over the pages as a stream of files."""
    from braidsieve.streaming.scan import ScanConfig, run_scan, scan_hits

    path = f"{sf_dir}/documents.parquet"
    out = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    run_scan(spark, held_out(spark, sf_dir), path, schema, out, ScanConfig(view=QUESTION), as_documents=lambda df: corpus(df, "doc_id", "doc_id"))
    hits = save(scan_hits(spark, out), "hits")
    remove(spark, out)
    return hits.df


QUERIES = {
    "corrupt_verbatim": corrupt_verbatim,
    "corrupt_punct_delete": corrupt_punct_delete,
    "corrupt_labelled_dot": corrupt_labelled_dot,
    "corrupt_labelled_paren": corrupt_labelled_paren,
    "corrupt_truncate": corrupt_truncate,
} | {
    f.__name__: f
    for f in (
        corrupt_by_chance, planted_corpus, planted_shortfalls, verify_plants, eval_summary, macro_recall, eval_json, threshold_sweep, operating_point, compare_methods, fuzzy_hits, synthetic_background, synthetic_items, streaming_scan,
    )
}

_FULL = sql.view(True)
_EACH = "array_to_string([coalesce(question, '')] || [{0} for c, i in choices], chr(10))"

SQL = {
    "corrupt_verbatim": f"SELECT item_id, {_FULL} AS planted FROM mini_benchmark",
    "corrupt_punct_delete": f"SELECT item_id, nullif(regexp_replace({_FULL}, '\\p{{P}}', '', 'g'), {_FULL}) AS planted FROM mini_benchmark",
    "corrupt_labelled_dot": f"SELECT item_id, CASE WHEN len(choices) > 0 THEN {_EACH.format("chr((64 + i)::INT) || '. ' || c")} END AS planted FROM mini_benchmark",
    "corrupt_labelled_paren": f"SELECT item_id, CASE WHEN len(choices) > 0 THEN {_EACH.format("'(' || chr((64 + i)::INT) || ') ' || c")} END AS planted FROM mini_benchmark",
    "corrupt_truncate": f"""SELECT item_id, CASE WHEN len(w) > 0 THEN array_to_string(w[: greatest(1, round_even(len(w) * 0.6::DOUBLE, 0))::INT], '') END AS planted
FROM (SELECT item_id, regexp_extract_all({_FULL}, '[\\s\\p{{Z}}\\x{{85}}\\x{{0b}}]*[^\\s\\p{{Z}}\\x{{85}}\\x{{0b}}]+') AS w FROM mini_benchmark)""",
    "streaming_scan": sql.hits(3, 0.5, 0.9, slack=1.5, snippet=200, items="eval_items", choices=False, docs=sql.DOCUMENTS) + "SELECT item_id, doc_key, doc_id, level, containment, matched_ngrams, total_ngrams, ngram_size, exact, short, window_start, snippet FROM hits",
    "verify_plants": """SELECT 'plant:html_wrap:' || item_id AS doc_id, 'document missing' AS problem FROM eval_items
UNION ALL SELECT 'plant:truncate@0.6:' || item_id, 'text does not match the digest' FROM eval_items""",
}

"""Queries over hits and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsieve.functions.stats import candidate_probability, wilson
from braidsieve.functions.text import token_count, token_line
from braidsieve.operators import labels, report
from braidsieve.operators.items import QUESTION, view_text
from braidsieve.plans import oracle as sql
from braidsieve.plans.overlap import items
from braidsieve.sources.files import hit_records


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels_q as hits: cleaned rows with an item, a level and a containment."""
    rows = labels.clean_hits(spark.read.parquet(f"{sf_dir}/labels_q.parquet"))
    return rows.where("item_id is not null and rank is not null and containment is not null")


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", token_count(token_line(view_text(QUESTION))).alias("tokens"))


def clean_labels(spark, sf_dir):
    return labels.clean_hits(spark.read.parquet(f"{sf_dir}/labels_q.parquet"))


def strongest_levels(spark, sf_dir):
    return report.strongest(hits(spark, sf_dir))


def level_report(spark, sf_dir):
    """The headline over mini_benchmark: items of at least three tokens are indexed."""
    indexed = lengths(spark, sf_dir).where("tokens >= 3").select("item_id")
    return report.headline(items(spark, sf_dir), indexed, hits(spark, sf_dir))


def top_hits(spark, sf_dir):
    return report.top_hits(hits(spark, sf_dir), 25, "hit_id").select("hit_id", "item_id", "level", "containment")


def best_hit_per_item(spark, sf_dir):
    from braidsieve.operators.containment import best_hit_per_item as best

    return best(hits(spark, sf_dir), F.col("rank"), "hit_id").select("item_id", "hit_id", "level", "containment")


def filter_by_length(spark, sf_dir):
    return report.filter_hits(hits(spark, sf_dir), lengths(spark, sf_dir), 12, 2).select("hit_id", "item_id", "rank")


def flagrate_by_min_length(spark, sf_dir):
    skipped = lengths(spark, sf_dir).where("tokens < 3").select("item_id")
    return report.flag_rates(lengths(spark, sf_dir), skipped, hits(spark, sf_dir), [3, 8, 12, 20, 30])


def hits_by_length_bucket(spark, sf_dir):
    return report.hits_by_length(hits(spark, sf_dir), lengths(spark, sf_dir), 30)


def compare_corpora_newcombe(spark, sf_dir):
    """Hits of the edu strata against those of the web strata, which search items of three and of eight tokens on."""
    all_, known = hits(spark, sf_dir), lengths(spark, sf_dir)
    return report.compare_scans(known.where("tokens >= 3"), known.where("tokens >= 8"), all_.where("stratum like 'edu%'"), all_.where("stratum like 'web%'"))


def labelled_shares(spark, sf_dir):
    """Items labelled t, and t or b, of the edu and the web strata."""
    return report.labelled_shares(lengths(spark, sf_dir).where("tokens >= 3"), clean_labels(spark, sf_dir).where("item_id is not null and stratum is not null"), F.substring("stratum", 1, 3))


def hits_per_million(spark, sf_dir):
    tokens = spark.read.parquet(f"{sf_dir}/mini_corpus.parquet").agg(F.sum("token_count").alias("tokens"))
    return report.hits_per_million(hits(spark, sf_dir), tokens)


def label_summary(spark, sf_dir):
    return labels.label_summary(clean_labels(spark, sf_dir))


def label_kappa(spark, sf_dir):
    """Agreement of the first and the last label of pairs that were labelled more than once."""
    return labels.agreement(labels.relabelled(clean_labels(spark, sf_dir)).select("first", "second"))


def label_pairs(spark, sf_dir):
    return labels.relabelled(clean_labels(spark, sf_dir))


def first_hits(spark, sf_dir):
    """The first hit of every (item, document)."""
    return labels.first_of_pairs(clean_labels(spark, sf_dir).where("item_id is not null and doc_id is not null")).select("hit_id", "item_id", "doc_id")


def label_sample(spark, sf_dir):
    return labels.label_sample(hits(spark, sf_dir)).select("stratum", "hit_id", "item_id", "containment", "part")


def label_sample_top(spark, sf_dir):
    return label_sample(spark, sf_dir).where("part = 'top'").select("stratum", "hit_id")


QUOTAS = {"true_contamination": 40, "shared_source_text": 30, "benign_discussion": 20, "coincidental": 20}


def annotation_pick(spark, sf_dir):
    return labels.annotation_pick(clean_labels(spark, sf_dir), QUOTAS).select("label", "item_id", "doc_id", "hit_id")


def annotation_pack(spark, sf_dir):
    return labels.annotation_pack(labels.annotation_pick(clean_labels(spark, sf_dir), QUOTAS))


def wilson_table(spark, sf_dir):
    """Intervals of the share of exact hits of each stratum."""
    rows = hits(spark, sf_dir).groupBy("stratum").agg(F.count_if(F.col("rank") == 3).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return rows.select("stratum", "k", "n", low.alias("low"), high.alias("high"))


def banding_curve(spark, sf_dir):
    s = spark.range(0, 21).select((F.col("id") / 20.0).alias("similarity"))
    return s.select("similarity", candidate_probability(F.col("similarity"), 32, 4).alias("probability"))


def rounded_hits(spark, sf_dir):
    """Containments as hits are written: half-even to four places."""
    h = hits(spark, sf_dir).select("hit_id", (F.col("containment") / 3).alias("containment"))
    names = {c: F.lit(None) for c in ("item_id", "doc_id", "level", "matched_ngrams", "total_ngrams", "ngram_size", "exact", "short", "window_start", "snippet")}
    return hit_records(h.withColumns(names).withColumn("doc_id", F.col("hit_id"))).select(F.col("doc_id").alias("hit_id"), "containment")


QUERIES = {
    f.__name__: f
    for f in (
        clean_labels, strongest_levels, level_report, top_hits, best_hit_per_item, filter_by_length, flagrate_by_min_length, hits_by_length_bucket, compare_corpora_newcombe, labelled_shares,
        hits_per_million, label_summary, label_kappa, label_pairs, first_hits, label_sample, label_sample_top, annotation_pick, annotation_pack, wilson_table, banding_curve, rounded_hits,
    )
}

_LEVEL = r"CASE upper(regexp_replace(level, '[\s _\-]+', '', 'g')) WHEN 'EXACT' THEN 3 WHEN 'NEARDUPLICATE' THEN 2 WHEN 'PARTIAL' THEN 1 WHEN 'NONE' THEN 0 END"
_LABEL = "CASE WHEN {0} IN ('t') THEN 'true_contamination' WHEN {0} = 'p' THEN 'shared_source_text' WHEN {0} = 'c' THEN 'coincidental' WHEN {0} = 'b' THEN 'benign_discussion' WHEN {0} IN ('true_contamination', 'shared_source_text', 'coincidental', 'benign_discussion') THEN {0} END".format("lower(trim(label))")
_CLEAN = rf"""WITH clean AS (
SELECT hit_id, regexp_replace(stratum, '^\x{{FEFF}}', '') AS stratum, lower(regexp_replace(item_id, '^\s+|\s+$', '', 'g')) AS item_id, doc_id, {_LEVEL} AS rank,
  ['NONE', 'PARTIAL', 'NEAR_DUPLICATE', 'EXACT'][{_LEVEL} + 1] AS level, CASE WHEN NOT isnan(containment) AND containment BETWEEN 0 AND 1 THEN containment END AS containment, {_LABEL} AS label
FROM labels_q),
hits AS (SELECT * FROM clean WHERE item_id IS NOT NULL AND rank IS NOT NULL AND containment IS NOT NULL),
best AS (SELECT item_id, max(rank) AS rank FROM hits GROUP BY 1),
lengths AS (SELECT item_id, len({sql.tokens(sql.view(False))}) AS tokens FROM mini_benchmark)
"""


def _intervals(names: tuple[str, ...], n: str) -> str:
    parts = []
    for name in names:
        low, high = sql.wilson(name, n)
        parts += [f"{low} AS {name}_low", f"{high} AS {name}_high"]
    return ", ".join(parts)


def _picks() -> str:
    """CTEs: rows, the first labelled hit of each pair, and picked, one label's quota after another."""
    parts = [", rows AS (SELECT * FROM clean WHERE label IS NOT NULL AND item_id IS NOT NULL AND doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY hit_id) = 1)"]
    before = []
    for i, (label, quota) in enumerate(QUOTAS.items()):
        used = " AND ".join(f"item_id NOT IN (SELECT item_id FROM k{j})" for j in before) or "true"
        parts.append(f"k{i} AS (SELECT * FROM (SELECT * FROM rows WHERE label = '{label}' AND {used} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY md5('0|' || hit_id), hit_id) = 1) ORDER BY md5('0|' || hit_id), hit_id LIMIT {quota})")
        before.append(i)
    return ", ".join(parts) + ", picked AS (" + " UNION ALL ".join(f"SELECT * FROM k{j}" for j in before) + ") "


_PICK = _picks()
_THREE = ("partial_or_more", "near_or_more", "exact")
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {{0}} >= {i}) AS {n}" for i, n in enumerate(_THREE, 1))
_DIFF = "in_a::DOUBLE / eligible_a - in_b::DOUBLE / eligible_b"
_LA, _HA = sql.wilson("in_a", "eligible_a")
_LB, _HB = sql.wilson("in_b", "eligible_b")
_WIL = sql.wilson("k", "n")
_TRUE = sql.wilson("true_contamination", "labelled")

SQL = {
    "clean_labels": _CLEAN + "SELECT * FROM clean",
    "strongest_levels": _CLEAN + "SELECT * FROM best",
    "level_report": _CLEAN + f""", c AS (SELECT split_part(l.item_id, ':', 1) AS benchmark, count(*) AS items, count(*) FILTER (WHERE tokens >= 3) AS indexed, {_COUNTS.format('CASE WHEN tokens >= 3 THEN rank END')}
FROM lengths l LEFT JOIN best USING (item_id) GROUP BY 1) SELECT *, {_intervals(_THREE, 'indexed')} FROM c""",
    "top_hits": _CLEAN + "SELECT hit_id, item_id, level, containment FROM hits ORDER BY rank DESC, containment DESC, item_id, hit_id LIMIT 25",
    "best_hit_per_item": _CLEAN + "SELECT item_id, hit_id, level, containment FROM hits QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank DESC, containment DESC, hit_id) = 1",
    "filter_by_length": _CLEAN + "SELECT hit_id, item_id, rank FROM hits JOIN lengths USING (item_id) WHERE tokens >= 12 AND rank >= 2",
    "flagrate_by_min_length": _CLEAN + f""", m AS (SELECT unnest([3, 8, 12, 20, 30]) AS min_tokens), c AS (
SELECT min_tokens, count(item_id) AS eligible, {_COUNTS.format('rank')} FROM m LEFT JOIN (SELECT * FROM lengths LEFT JOIN best USING (item_id) WHERE tokens >= 3) x ON x.tokens >= min_tokens GROUP BY 1)
SELECT *, {_intervals(_THREE[:2], 'eligible')} FROM c""",
    "hits_by_length_bucket": _CLEAN + "SELECT CASE WHEN tokens < 30 THEN 'short' ELSE 'long' END AS bucket, count(*) AS hits, count(DISTINCT item_id) AS items FROM hits JOIN lengths USING (item_id) GROUP BY 1",
    "compare_corpora_newcombe": _CLEAN + f""", a AS (SELECT item_id, max(rank) AS a FROM hits WHERE stratum LIKE 'edu%' GROUP BY 1), b AS (SELECT item_id, max(rank) AS b FROM hits WHERE stratum LIKE 'web%' GROUP BY 1),
x AS (SELECT split_part(item_id, ':', 1) AS benchmark, level, tokens >= 8 AS eb, coalesce(a >= r, false) AS ia, coalesce(tokens >= 8 AND b >= r, false) AS ib FROM lengths LEFT JOIN a USING (item_id) LEFT JOIN b USING (item_id) CROSS JOIN (VALUES (1, 'PARTIAL'), (2, 'NEAR_DUPLICATE'), (3, 'EXACT')) t(r, level) WHERE tokens >= 3),
c AS (SELECT benchmark, level, count(*) AS eligible_a, count(*) FILTER (WHERE eb) AS eligible_b, count(*) FILTER (WHERE ia) AS in_a, count(*) FILTER (WHERE ib) AS in_b, count(*) FILTER (WHERE ia AND ib) AS in_both, count(*) FILTER (WHERE ia AND NOT ib) AS only_a, count(*) FILTER (WHERE ib AND NOT ia) AS only_b FROM x GROUP BY 1, 2)
SELECT *, {_DIFF} AS difference, {_DIFF} - sqrt((in_a::DOUBLE / eligible_a - {_LA}) ** 2 + ({_HB} - in_b::DOUBLE / eligible_b) ** 2) AS difference_low,
  {_DIFF} + sqrt(({_HA} - in_a::DOUBLE / eligible_a) ** 2 + (in_b::DOUBLE / eligible_b - {_LB}) ** 2) AS difference_high FROM c""",
    "labelled_shares": _CLEAN + f""", e AS (SELECT item_id FROM lengths WHERE tokens >= 3), n AS (SELECT split_part(item_id, ':', 1) AS benchmark, count(*) AS eligible FROM e GROUP BY 1),
m AS (SELECT substring(stratum, 1, 3) AS scan, item_id, bool_or(label = 'true_contamination') AS t FROM clean WHERE label IN ('true_contamination', 'benign_discussion') AND item_id IN (SELECT item_id FROM e) AND stratum IS NOT NULL GROUP BY 1, 2),
c AS (SELECT scan, split_part(item_id, ':', 1) AS benchmark, count(*) FILTER (WHERE t) AS t, count(*) AS t_or_b FROM m GROUP BY 1, 2)
SELECT scan, benchmark, eligible, t, t_or_b, {_intervals(('t', 't_or_b'), 'eligible')} FROM c JOIN n USING (benchmark)""",
    "hits_per_million": _CLEAN + ", t AS (SELECT sum(token_count)::BIGINT AS tokens FROM mini_corpus) SELECT hits, tokens, 1e6 * hits / greatest(tokens, 1) AS per_million FROM (SELECT count(*) AS hits FROM hits), t",
    "label_summary": _CLEAN + f""", c AS (SELECT stratum, count(label) AS labelled, {', '.join(f"count(*) FILTER (WHERE label = '{x}') AS {x}" for x in labels.LABELS)} FROM clean GROUP BY 1)
SELECT *, {_TRUE[0]} AS true_low, {_TRUE[1]} AS true_high FROM c""",
    "label_pairs": _CLEAN + """SELECT item_id, doc_id, arg_min_null(label, hit_id) AS first, arg_max_null(label, hit_id) AS second FROM clean
WHERE item_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""",
    "label_kappa": _CLEAN + """, p AS (SELECT * FROM (SELECT item_id, doc_id, arg_min_null(label, hit_id) AS a, arg_max_null(label, hit_id) AS b FROM clean
WHERE item_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) WHERE a IS NOT NULL AND b IS NOT NULL),
n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE a = b) AS agree FROM p),
e AS (SELECT coalesce(sum(x.c::DOUBLE * y.c), 0) AS s FROM (SELECT a AS l, count(*) AS c FROM p GROUP BY 1) x JOIN (SELECT b AS l, count(*) AS c FROM p GROUP BY 1) y USING (l))
SELECT rows, agree, CASE WHEN s / (rows::DOUBLE * rows) >= 1 THEN 1.0 ELSE (agree::DOUBLE / rows - s / (rows::DOUBLE * rows)) / (1 - s / (rows::DOUBLE * rows)) END AS kappa FROM n, e""",
    "first_hits": _CLEAN + "SELECT min(hit_id) AS hit_id, item_id, doc_id FROM clean WHERE item_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 2, 3",
    "label_sample_top": _CLEAN + "SELECT stratum, hit_id FROM hits QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY containment DESC, item_id, doc_id NULLS FIRST, hit_id) <= 20",
    "label_sample": _CLEAN + """, t AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY containment DESC, item_id, doc_id NULLS FIRST, hit_id) AS n FROM hits),
o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('11|' || hit_id), hit_id) AS m FROM t WHERE n > 20)
SELECT stratum, hit_id, item_id, containment, 'top' AS part FROM t WHERE n <= 20 UNION ALL SELECT stratum, hit_id, item_id, containment, 'random' FROM o WHERE m <= 20""",
    "annotation_pick": _CLEAN + _PICK + "SELECT label, item_id, doc_id, hit_id FROM picked",
    "wilson_table": _CLEAN + f", c AS (SELECT stratum, count(*) FILTER (WHERE rank = 3) AS k, count(*) AS n FROM hits GROUP BY 1) SELECT stratum, k, n, {_WIL[0]} AS low, {_WIL[1]} AS high FROM c",
    "banding_curve": "SELECT i / 20.0::DOUBLE AS similarity, 1 - (1 - (i / 20.0::DOUBLE) ** 4) ** 32 AS probability FROM range(21) t(i)",
    "rounded_hits": _CLEAN + "SELECT hit_id, round_even(containment / 3, 4) AS containment FROM hits",
}

"""Command line: scan, report, dupes, evaluate and compare over files that Spark reads."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsieve import __version__, session
from braidsieve.operators import dupes, report
from braidsieve.operators.compare import compare_methods
from braidsieve.operators.evaluate import OperatingPoint, macro_recall
from braidsieve.operators.items import QUESTION, QUESTION_CHOICES, corpus, last_within, view_text
from braidsieve.operators.plant import plant
from braidsieve.operators.split import split_documents, split_items
from braidsieve.scratch import scope
from braidsieve.sources import synthetic
from braidsieve.sources.benchmarks import load_benchmark, load_items_jsonl
from braidsieve.sources.files import read_json, write_csv
from braidsieve.streaming.scan import ScanConfig, ScanError, progress, run_scan, scan_hits

LEVELS = ("PARTIAL", "NEAR_DUPLICATE", "EXACT")
# Settings of a scan, by their flags.
SETTINGS = {"n": int, "partial": float, "near-duplicate": float, "window-slack": float, "stop-ngram-k": int, "min-tokens": int, "snippet-chars": int, "files-per-batch": int}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="braidsieve", description="Text-overlap analytics on Spark")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> Callable[..., argparse.Action]:
        c = sub.add_parser(name, help=text)
        add = c.add_argument
        add("--items", action="append", default=[], help="items as parquet folder or JSON Lines; may be given again")
        add("--benchmark", action="append", default=[], metavar="NAME=PATH", help="parquet rows of a known benchmark")
        add("--max-items", type=int, default=0, help="of each source, 0 for all")
        add("--demo", action="store_true", help="generated items and documents")
        add("--demo-items", type=int, default=40), add("--demo-docs", type=int, default=200)
        add("--seed", type=int, default=0), add("--view", choices=(QUESTION, QUESTION_CHOICES))
        return add

    def documents(add: Callable[..., argparse.Action], name: str) -> None:
        add(f"--{name}", help="folder of documents")
        add("--format", choices=("parquet", "jsonl"), default="parquet")
        add("--id", default="id"), add("--text", default="text")

    add = command("scan", "find items in documents")
    documents(add, "documents")
    add("--key", help="column that orders the documents for a budget; the id if not given"), add("--tokens", help="column with a document's tokens")
    add("--max-docs", type=int), add("--max-tokens", type=int)
    add("--out", required=True), add("--operating-point"), add("--no-window", action="store_true")
    add("--resume", action="store_true"), add("--overwrite", action="store_true")
    for name, kind in SETTINGS.items():
        add(f"--{name}", type=kind)
    add = command("report", "levels per benchmark of a scan")
    add("--scan", required=True), add("--top", type=int, default=10)
    add = command("dupes", "near-duplicate items, within one list or across two")
    add("--other", help="second list of items"), add("--shingle", type=int, default=3), add("--threshold", type=float, default=0.5)
    add("--show", type=int, default=10), add("--out")
    for name, text in (("evaluate", "tune on dev, freeze, judge on test"), ("compare", "detectors side by side on the test half")):
        add = command(name, text)
        documents(add, "background")
        add("--out", required=True), add("--items-per-spec", type=int, default=100), add("--controls", type=int, default=500)
        if name == "evaluate":
            add("--ns", type=int, nargs="+", default=[5, 8, 13]), add("--stop-ks", type=int, nargs="+", default=[], help="stop filters besides none")
            add("--window-slacks", type=float, nargs="+", default=[], help="windows besides the whole document")
            add("--control-bound", type=float, default=0.05), add("--no-test-sweep", action="store_true"), add("--no-charts", action="store_true")
        else:
            add("--ns", type=int, nargs="+", default=[2, 3, 5]), add("--windowed-ns", type=int, nargs="*", default=[3]), add("--window-slack", type=float, default=1.5)
            add("--fuzzy-ks", type=int, nargs="*", default=[2, 3]), add("--threshold", type=float, default=0.3), add("--hashes", type=int, default=64), add("--bands", type=int, default=32)
    return p


def settings(args: argparse.Namespace, point: OperatingPoint | None = None) -> ScanConfig:
    """A flag counts before the operating point, and that before the default."""
    found = {"source": f"{args.documents or 'demo'}|{args.max_docs}|{args.max_tokens}"}
    if point is not None:
        found |= {k: getattr(point, k) for k in ("n", "view", "partial", "near_duplicate", "window_slack", "stop_ngram_k")}
    for k in ("view", *(name.replace("-", "_") for name in SETTINGS)):
        if getattr(args, k) is not None:
            found[k] = getattr(args, k)
    if args.no_window:
        found["window_slack"] = None
    return ScanConfig(**found)


def _one_list(spark: SparkSession, path: str) -> DataFrame:
    return load_items_jsonl(spark, path) if path.endswith((".jsonl", ".json")) else spark.read.parquet(path)


def _items(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    lists = [synthetic.items(spark, args.demo_items, args.seed)] if args.demo else []
    given = [load_benchmark(spark, *spec.split("=", 1)) if "=" in spec else None for spec in args.benchmark]
    if None in given:
        raise ValueError("--benchmark needs NAME=PATH")
    for df in [*given, *(_one_list(spark, p) for p in args.items)]:
        lists.append(df.orderBy("item_id").limit(args.max_items) if args.max_items else df)
    if not lists:
        raise ValueError("give --items, --benchmark or --demo")
    cols = ["item_id", "benchmark", "split", "question", "choices", "answer"]
    out = lists[0].select(cols)
    for df in lists[1:]:
        out = out.unionByName(df.select(cols))
    return out


def _columns(args: argparse.Namespace) -> list[str]:
    more = [getattr(args, k, None) for k in ("key", "tokens")]
    return list(dict.fromkeys([args.id, args.text, *[c for c in more if c]]))


def _schema(spark: SparkSession, args: argparse.Namespace, path: str) -> str:
    """The columns that are read; those of JSON Lines are strings, but for the key and the tokens."""
    if args.format == "parquet":
        stored = spark.read.parquet(path).schema
        return ", ".join(f"`{c}` {stored[c].dataType.simpleString()}" for c in _columns(args))
    numbers = {getattr(args, "key", None), getattr(args, "tokens", None)} - {args.id, None}
    return ", ".join(f"`{c}` {'bigint' if c in numbers else 'string'}" for c in _columns(args))


def _background(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.demo and not args.background:
        return synthetic.background(spark, args.demo_docs, args.seed)
    if not args.background:
        raise ValueError("give --background or --demo")
    rows = spark.read.schema(_schema(spark, args, args.background)).format("json" if args.format == "jsonl" else "parquet").load(args.background)
    return corpus(rows, args.id, args.id, args.text)


def _report(spark: SparkSession, items: DataFrame, scan: str, top: int) -> str:
    state = progress(spark, scan)
    hits = scan_hits(spark, scan).withColumn("rank", F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")).cast("int"))
    skipped = spark.read.schema("item_id string, reason string").json(f"{scan}/skipped")
    indexed = items.select("item_id").join(skipped, "item_id", "left_anti")
    return report.show_report(report.headline(items, indexed, hits), report.top_hits(hits, top, "doc_id"), state, skipped.count())


def _scan(args: argparse.Namespace, spark: SparkSession) -> None:
    items = _items(spark, args)
    if args.demo and not args.documents:
        args.documents, args.id, args.text, args.format = f"{args.out}/demo", "doc_id", "text", "parquet"
        made = plant(items, synthetic.background(spark, args.demo_docs, args.seed), items_per_spec=5, controls=args.demo_docs, seed=args.seed)
        made.documents.select("doc_id", "text").write.mode("overwrite").parquet(args.documents)
    if not args.documents:
        raise ValueError("give --documents or --demo")
    schema, kind = _schema(spark, args, args.documents), "json" if args.format == "jsonl" else "parquet"
    key = args.key or args.id

    def rows(df: DataFrame) -> DataFrame:
        return corpus(df, key, args.id, args.text, args.tokens)

    if args.max_tokens is not None and not args.tokens:
        raise ValueError("--max-tokens needs --tokens")
    budget = args.max_docs is not None or args.max_tokens is not None
    last = last_within(rows(spark.read.schema(schema).format(kind).load(args.documents)), args.max_docs, args.max_tokens) if budget else None
    point = OperatingPoint.from_record(read_json(spark, args.operating_point)) if args.operating_point else None
    done = run_scan(
        spark, items, args.documents, schema, args.out, settings(args, point), as_documents=lambda df: rows(df).where(F.col("doc_key") <= last if last is not None else F.lit(not budget)), format=kind,
        resume=args.resume, overwrite=args.overwrite, on_batch=lambda r: print(f"batch {r['batch']}: {r['documents']} documents, {r['hits']} hits"),
    )
    print(done)
    print(_report(spark, items, args.out, 10))


def _dupes(args: argparse.Namespace, spark: SparkSession) -> None:
    view = view_text(args.view or QUESTION)
    items = _items(spark, args)
    other = _one_list(spark, args.other) if args.other else None
    left, right = (None if df is None else dupes.shingle_sets(df, "item_id", view, args.shingle) for df in (items, other))
    pairs = dupes.similar_pairs(left, right, least=args.threshold)
    levels = [t for t in (0.5, 0.7, 0.9) if t >= args.threshold]
    counts = pairs.agg(F.count(F.lit(1)), *[F.count_if(F.col("jaccard") >= t - 1e-12) for t in levels]).first()
    print(f"pairs: {counts[0]}" + "".join(f"; at {t}: {n}" for t, n in zip(levels, counts[1:])))
    text = items.select("item_id", "question") if other is None else items.select("item_id", "question").unionByName(other.select("item_id", "question"))
    first = pairs.orderBy(F.desc("jaccard"), "id_a", "id_b").limit(args.show)
    named = first.join(text.groupBy("item_id").agg(F.first("question").alias("a")), F.col("id_a") == F.col("item_id")).drop("item_id").join(text.groupBy("item_id").agg(F.first("question").alias("b")), F.col("id_b") == F.col("item_id"))
    for r in named.orderBy(F.desc("jaccard"), "id_a", "id_b").collect():
        print(f"{r['jaccard']:.2f}  {r['id_a']}  {r['id_b']}\n    {r['a'][:90]}\n    {r['b'][:90]}")
    if args.out:
        write_csv(pairs.withColumn("jaccard", F.bround("jaccard", 4)).orderBy(F.desc("jaccard"), "id_a", "id_b"), args.out)


def _evaluate(args: argparse.Namespace, spark: SparkSession) -> None:
    from braidsieve.experiment import Experiment, run_experiment

    grid = {"ns": tuple(args.ns), "stop_ks": (None, *args.stop_ks), "window_slacks": (None, *args.window_slacks)}
    how = Experiment(
        grid=grid, truth={"items_per_spec": args.items_per_spec, "controls": args.controls}, view=args.view or QUESTION_CHOICES, control_bound=args.control_bound, seed=args.seed,
        sweep_test=not args.no_test_sweep, charts=not args.no_charts,
    )
    found = run_experiment(_items(spark, args), _background(spark, args), args.out, how, source=args.background or "demo")
    print(f"items: {found.items}\n{found.point}\nmacro recall on test: {macro_recall(found.summary).first()['macro_recall']:.3f}")
    found.summary.select("spec", "planted", "recall", "recall_low", "recall_high").orderBy("spec").show(50, False)


def _compare(args: argparse.Namespace, spark: SparkSession) -> None:
    items = _items(spark, args)
    test = [df.where("side = 'test'").drop("side") for df in (split_items(items, 0.5, args.seed), split_documents(_background(spark, args), 0.5, args.seed))]
    made = plant(*test, items_per_spec=args.items_per_spec, controls=args.controls, seed=args.seed)
    rows = compare_methods(
        items, made, ns=tuple(args.ns), windowed=tuple((n, args.window_slack) for n in args.windowed_ns), fuzzy_ks=tuple(args.fuzzy_ks), least=args.threshold, view=args.view or QUESTION, hashes=args.hashes, bands=args.bands, seed=args.seed
    )
    write_csv(rows.orderBy("method", "spec"), args.out)
    spark.read.option("header", True).option("inferSchema", True).csv(args.out).groupBy("spec").pivot("method").agg(F.first("recall")).orderBy("spec").show(50, False)


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    with scope():
        if args.command == "report":
            print(_report(spark, _items(spark, args), args.scan, args.top))
        else:
            {"scan": _scan, "dupes": _dupes, "evaluate": _evaluate, "compare": _compare}[args.command](args, spark)
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or session.local()
    session.ship(spark)
    try:
        return run(args, spark)
    except (ScanError, ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

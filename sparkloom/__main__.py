"""python -m sparkloom ingest|build|refine|evaluate|extract|delete|clean|inspect|fetch: the job and its tools."""

from __future__ import annotations

import argparse

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions.text import preview
from sparkloom.operators import graph, job, providers, stats
from sparkloom.session import session
from sparkloom.sources import dataset, graph_store, results


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="flatten a result log to CSV or JSON lines")
    e.add_argument("log")
    e.add_argument("out")
    e.add_argument("--category", type=int)
    e.add_argument("--format", choices=["csv", "jsonl"], default="csv")
    d = sub.add_parser("delete", help="delete results of samples and categories; the old log is kept as a backup")
    d.add_argument("log")
    d.add_argument("--samples", nargs="+")
    d.add_argument("--categories", nargs="+", type=int)
    c = sub.add_parser("clean", help="write the graph without some levels to another folder")
    c.add_argument("graph")
    c.add_argument("out")
    c.add_argument("--levels", nargs="+", default=["scene", "persona"])
    i = sub.add_parser("inspect", help="count and list the nodes of a graph")
    i.add_argument("graph")
    i.add_argument("--all", action="store_true", help="list every node, not the first five of a level")
    i.add_argument("--out", help="write the report with edges to a file")
    n = sub.add_parser("ingest", help="turns of a dataset become facts that evolve")
    v = sub.add_parser("evaluate", help="the whole run: ingest, build, refine, answer, score, sum up")
    for x in (n, v):
        x.add_argument("dataset")
        x.add_argument("graph")
        x.add_argument("--ratio", type=float, default=1.0, help="the first share of the samples, over 0 and at most 1")
    b = sub.add_parser("build", help="scenes and personas of a stored graph")
    b.add_argument("graph")
    r = sub.add_parser("refine", help="refine the scenes that aren't yet")
    r.add_argument("graph")
    v.add_argument("out", help="folder of the result log")
    v.add_argument("--strategy", choices=job.STRATEGIES, default="graph_traversal")
    v.add_argument("--rewrite", action="store_true", help="search by keywords a provider makes of the question")
    v.add_argument("--no-refinement", action="store_true")
    v.add_argument("--retrieve_k", type=int, help="memories a question is answered from; by its category if not given")
    v.add_argument("--top-k-levels", type=int, nargs="+", help="how many personas, scenes and facts a walk takes")
    for x in (n, v, b, r):
        x.add_argument("--backend", help="a registered provider; without one the offline rules")
        x.add_argument("--model")
        x.add_argument("--api-key", help="of a remote provider, if it isn't in the environment")
        x.add_argument("--log", help="write messages to this file too")
    f = sub.add_parser("fetch", help="load models once so that later runs find them")
    f.add_argument("models", nargs="+")
    return p


def _job(args: argparse.Namespace, spark) -> None:
    job.set_logging(args.log)
    given = {"backend": args.backend} | ({"model": args.model} if args.model and args.backend else {}) | ({"api_key": args.api_key} if args.api_key and args.backend else {})
    if args.command in ("ingest", "evaluate"):
        samples = dataset.read_dataset(spark, args.dataset)
        if args.ratio != 1:
            place = F.row_number().over(Window.orderBy(F.length("sample_id"), "sample_id"))  # a row a sample: the ids alone
            kept = stats.head_sample(samples.select("sample_id").withColumn("i", place), "i", args.ratio)
            samples = samples.join(kept.select("sample_id"), "sample_id", "left_semi")
        turns = dataset.numbered(dataset.turns(samples)).select("sample_id", "turn_seq", "date_time", "speaker", "text")
    if args.command == "ingest":
        job.ingest_turns(spark, turns, args.graph, **given)
    elif args.command == "build":
        job.build(spark, args.graph, **given)
    elif args.command == "refine":
        job.refine(spark, args.graph, **given)
    else:
        asked = dataset.qa(samples).withColumn("reference", F.col("final_answer"))
        made = job.run(spark, turns, asked, args.graph, args.out, args.strategy, args.backend, args.model or "offline", args.ratio, not args.no_refinement, args.rewrite, args.retrieve_k, tuple(args.top_k_levels or ()) or None, **({"api_key": args.api_key} if args.api_key and args.backend else {}))
        made.show(truncate=False, vertical=True)


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    if args.command == "delete" and args.samples is None and args.categories is None:
        raise SystemExit("delete needs --samples or --categories")
    if args.command == "fetch":
        for name, state in providers.fetch_models(args.models).items():
            print(f"{name}: {state}")
        return
    spark = session(args.master)
    if args.command in ("ingest", "build", "refine", "evaluate"):
        _job(args, spark)
    elif args.command == "inspect" and args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(job.graph_report(spark, args.graph, 1_000_000 if args.all else 5))
    elif args.command == "extract":
        results.export(results.results(results.read_log(spark, args.log)), args.out, args.format, args.category)
    elif args.command == "delete":
        print("backup:", results.rewrite(spark, args.log, args.samples, args.categories))
    elif args.command == "clean":
        keys = ["sample_id"]
        nodes, edges = graph.without_levels(graph_store.load(spark, args.graph, "nodes"), graph_store.load(spark, args.graph, "edges"), keys, tuple(args.levels))
        graph_store.append(nodes, args.out, "nodes")
        graph_store.append(edges, args.out, "edges")
    else:
        nodes = graph_store.load(spark, args.graph, "nodes")
        nodes.groupBy("level").agg(F.count("*").alias("n")).orderBy("level").show(truncate=False)
        for level in ("persona", "scene", "fact"):
            some = nodes.where(F.col("level") == level).orderBy(F.coalesce("timestamp", F.lit("")), "sample_id", "node_seq").select("sample_id", "node_seq", preview("content").alias("content"))
            some.show(1_000_000 if args.all else 5, truncate=False)


if __name__ == "__main__":
    main()

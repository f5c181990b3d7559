"""python -m lattica: list, run, explain or time the registered queries, build and ask a map, and say what is there."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lattica")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        q = sub.add_parser(name)
        q.add_argument("query")
        q.add_argument("--data", required=True)
        q.add_argument("--rows", type=int, default=20)
    ask = sub.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--data", required=True)
    sub.add_parser("check", help="what is installed")
    sub.add_parser("backends", help="detectors, segmenters and encoders")
    demo = sub.add_parser("demo", help="a synthetic room, asked what is in it")
    demo.add_argument("--seed", type=int, default=7)
    build = sub.add_parser("map", help="build a map from observations and points (Parquet) and save it")
    for name in ("observations", "points", "out"):
        build.add_argument(name)
    build.add_argument("--voxel-size", type=float, default=0.05)
    find = sub.add_parser("query", help="find objects of a saved map by a text")
    find.add_argument("map")
    find.add_argument("text")
    find.add_argument("-k", type=int, default=5)
    bench = sub.add_parser("bench", help="seconds of queries")
    bench.add_argument("queries", nargs="+")
    bench.add_argument("--data", required=True)
    label = sub.add_parser("label", help="write accepted labels (Parquet: frame_id, label, score, box, reason)")
    label.add_argument("labels")
    label.add_argument("out")
    a = p.parse_args(args)
    from lattica.queries import QUERIES

    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    wanted = [a.query] if a.command in ("run", "explain") else a.queries if a.command == "bench" else []
    for name in wanted:
        if name not in QUERIES:
            print(f"no query is called {name}", file=sys.stderr)
            return 2
    if a.command == "check":
        from importlib.util import find_spec

        print("\n".join(f"{m}: {'there' if find_spec(m) else 'not there'}" for m in ("pyspark", "pyarrow", "pandas", "numpy", "duckdb", "tiktoken", "tokenizers", "xxhash")))
        return 0
    if a.command == "backends":
        from lattica.operators.perception import REGISTRY

        print("\n".join(f"{kind}: {', '.join(sorted(names))}" for kind, names in REGISTRY.items()))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "ask":
        from lattica.operators.scene import SceneMap
        from lattica.queries.language import named_objects

        intent, rows = SceneMap(named_objects(spark, a.data)).answer(a.question)
        print(intent)
        rows.show(20, False)
        return 0
    if a.command in ("demo", "map", "query"):
        from lattica.operators.scene import SceneMap, built
        from lattica.sources.synthetic import rooms

        if a.command == "demo":
            m = SceneMap(rooms(spark, [a.seed]))
            print("\n".join(m.reply(q).text for q in ("describe", "where is the cup", "how many chairs")))
        elif a.command == "map":
            built(spark.read.parquet(a.observations), spark.read.parquet(a.points), a.voxel_size).save(a.out)
        else:
            SceneMap.load(spark, a.map).query_text(a.text, a.k, level="object").show(a.k, False)
        return 0
    if a.command == "label":
        from lattica.sources.scenes import write_labels

        write_labels(spark.read.parquet(a.labels), a.out)
        return 0
    if a.command == "bench":
        import time

        from lattica.operators.reports import format_metrics

        seconds = {}
        for name in a.queries:
            start = time.monotonic()
            QUERIES[name](spark, a.data).write.format("noop").mode("overwrite").save()
            seconds[name] = time.monotonic() - start
        print(format_metrics(seconds))
        return 0
    df = QUERIES[a.query](spark, a.data)
    df.explain("formatted") if a.command == "explain" else df.show(a.rows, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

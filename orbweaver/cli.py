"""python -m orbweaver.cli --grammar FILE --graph FILE --out FOLDER [--filter]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.closure import closure
from .sources.files import read_grammar, read_graph, write_edges
from .sources.tables import drop_all


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Closure of an edge-labelled graph under a context-free grammar.")
    p.add_argument("--grammar", required=True)
    p.add_argument("--graph", required=True)
    p.add_argument("--out", help="folder for the closed edges, as Parquet by label")
    p.add_argument("--filter", action="store_true", help="dataflow grammars only: join new edges with the graph's own alone")
    p.add_argument("--inverses", nargs="*", default=[], metavar="LABEL", help="add reverse edges for these labels")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("orbweaver").getOrCreate()
    grammar, graph = read_grammar(spark, args.grammar), read_graph(spark, args.graph)
    if args.inverses:
        graph = graph.with_inverses(args.inverses)
    result = closure(graph, grammar, "dataflow" if args.filter else "full", on_pass=lambda k, new, total: print(f"pass {k}: {new} new edges, {total} in all", flush=True))
    if args.out:
        write_edges(result.edges, args.out)
    drop_all(spark)
    print(f"edges: {result.count}; passes: {len(result.passes)}; seconds: {sum(p[3] for p in result.passes):.1f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

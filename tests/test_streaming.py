from orbweaver.plans.grammar import Grammar
from orbweaver.streaming.incremental import closure_stream, extend, read_closure

from .worklist import closed

SCHEMA = "src long, label string, dst long"
GRAMMAR = Grammar.of("P ::= n", "P ::= P P", "S ::=")
RULES = [(r.lhs, r.rhs1, r.rhs2) for r in GRAMMAR.rules]


def test_extend_gives_what_is_missing(spark):
    first, second = [(0, "n", 1), (2, "n", 3)], [(1, "n", 2)]
    have = closed(first, RULES, range(4))
    added = {tuple(r) for r in extend(spark.createDataFrame(sorted(have), SCHEMA), spark.createDataFrame(second, SCHEMA), GRAMMAR).collect()}
    assert added == closed([*first, *second], RULES, range(4)) - have


def test_stream_of_edges(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    batches = [[(0, "n", 1), (2, "n", 3)], [(1, "n", 2)], [(3, "n", 0)]]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = closure_stream(spark, spark.readStream.schema(SCHEMA).parquet(source), GRAMMAR, out, f"{tmp_path}/checkpoint")
        query.processAllAvailable()
        query.stop()
    got = [tuple(r) for r in read_closure(spark, out).collect()]
    assert len(got) == len(set(got)) and set(got) == closed([e for b in batches for e in b], RULES, range(4))

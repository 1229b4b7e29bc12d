import pytest

from orbweaver.cli import main
from orbweaver.operators.graph import LabeledGraph
from orbweaver.plans.grammar import Rule
from orbweaver.sources.files import adjacency, bitmaps, edges_of, read_edges, read_grammar, read_graph, write_edges, write_graph


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_read_graph(spark, tmp_path):
    f = tmp_path / "g.txt"
    f.write_bytes(b"# sizes\r\n3\t5\r\n\r\n# edges\n2\t0\tb\r\n0\t1\ta\n0\t1\ta\n")
    g = read_graph(spark, f"file://{f}")
    assert rows(g.edges) == [(0, "a", 1), (2, "b", 0)] and g.vertices.count() == 5


@pytest.mark.parametrize("text", ["", "1\t5\n", "1\t5\n0\t1\n", "1\t5\n0\tx\ta\n", "1\t5\n0\t5\ta\n", "1\t5\n0\t1\ta\tb\n", "2\t5\n0\t1\ta\n", "0\t1\ta\n"])
def test_read_graph_refuses(spark, tmp_path, text):
    f = tmp_path / "g.txt"
    f.write_text(text)
    with pytest.raises(ValueError):
        read_graph(spark, f"file://{f}")


def test_write_graph_and_grammar(spark, tmp_path):
    edges = spark.createDataFrame([(3, "a", 1), (0, "-a", 2), (0, "a", 2)], "src long, label string, dst long")
    write_graph(LabeledGraph.from_dataframe(edges, 7), f"file://{tmp_path}/out")
    back = read_graph(spark, f"file://{tmp_path}/out")
    assert rows(back.edges) == rows(edges) and back.vertices.count() == 7
    (tmp_path / "r.txt").write_text("1\nA\ta\n")
    assert read_grammar(spark, f"file://{tmp_path}/r.txt").rules == (Rule("A", "a"),)


def test_edges_by_label_and_adjacency(spark, tmp_path):
    edges = spark.createDataFrame([(0, "a", 2), (0, "a", 1), (0, "b", 40000), (3, "a", 1)], "src long, label string, dst long")
    write_edges(edges, f"file://{tmp_path}/e")
    assert rows(read_edges(spark, f"file://{tmp_path}/e")) == rows(edges)
    assert rows(read_edges(spark, f"file://{tmp_path}/e", ["b"])) == [(0, "b", 40000)]
    assert rows(read_edges(spark, f"file://{tmp_path}/e", sources=(1, 3))) == [(3, "a", 1)]
    lists = adjacency(edges)
    assert {(r.src, r.label, r.base): r.targets for r in lists.collect()} == {(0, "a", 0): [1, 2], (0, "b", 208): [40000], (3, "a", 0): [1]}
    assert rows(edges_of(lists)) == rows(edges)
    assert bitmaps(edges).count() == 3


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "r.txt").write_text("2\nP\tn\nP\tP\tn\n")
    (tmp_path / "g.txt").write_text("2\t3\n0\t1\tn\n1\t2\tn\n")
    assert main(["--grammar", f"{tmp_path}/r.txt", "--graph", f"{tmp_path}/g.txt", "--out", f"{tmp_path}/out"]) == 0
    assert "edges: 5" in capsys.readouterr().out
    assert read_edges(spark, f"{tmp_path}/out").count() == 5


def test_tables_go_and_a_cluster_needs_a_shared_folder(spark, monkeypatch, tmp_path):
    from orbweaver.sources import tables

    class Conf(dict):
        set = dict.__setitem__

    class Context:
        master, applicationId = "spark://host:7077", "app-1"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        tables.shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = f"file://{tmp_path}"
    assert tables.shared_dir(Session()) == f"file://{tmp_path}"
    for master in ("local[4]", "local", "local[*]"):
        Context.master, Session.conf = master, Conf()
        assert tables.shared_dir(Session()).startswith("file://")
    monkeypatch.setattr(tables, "own_dir", lambda _: f"file://{tmp_path}/own")
    kept = tables.written(spark.range(3), "some")
    assert kept.count() == 3 and (tmp_path / "own").exists()
    tables.drop_all(spark)
    assert not (tmp_path / "own").exists()

"""An edge-labelled directed graph: edges (src long, label string, dst long) and vertices (id long)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = ("src", "label", "dst")


@dataclass
class LabeledGraph:
    """Edges are a set; vertices are declared, so that ones without edges are there.

    rows: the edges before they are made distinct, or None; touched: the vertices are just those that edges touch;
    inverses: pairs of labels, the second of which has the inverses of all edges of the first, and perhaps others.
    """

    edges: DataFrame
    vertices: DataFrame
    rows: DataFrame | None = None
    touched: bool = False
    inverses: tuple[tuple[str, str], ...] = ()

    @classmethod
    def from_dataframe(cls, edges: DataFrame, vertices: DataFrame | int | None = None) -> LabeledGraph:
        """vertices: a DataFrame with a column id, their number n (0 .. n - 1), or None for those that edges touch."""
        rows = edges.select(F.col("src").cast("long"), F.col("label").cast("string"), F.col("dst").cast("long"))
        edges = rows.distinct()
        if vertices is None:
            ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        elif isinstance(vertices, int):
            ids = edges.sparkSession.range(vertices)
        else:
            ids = vertices.select(F.col("id").cast("long")).distinct()
        return cls(edges, ids, rows, vertices is None)

    def with_inverses(self, labels: list[str], prefix: str = "-") -> LabeledGraph:
        """With an edge (dst, prefix + label, src) for every edge of the labels."""
        own = F.struct(*EDGE)
        turned = F.struct(F.col("dst").alias("src"), F.concat(F.lit(prefix), "label").alias("label"), F.col("src").alias("dst"))
        both = F.when(F.col("label").isin(labels), F.array(own, turned)).otherwise(F.array(own))
        rows = (self.edges if self.rows is None else self.rows).select(F.explode(both).alias("e")).select("e.*")
        made = {prefix + x for x in labels}
        pairs = [x for x in self.inverses if x[0] not in made] + [(x, prefix + x) for x in labels if x not in made]
        return LabeledGraph(rows.distinct(), self.vertices, rows, self.touched, tuple(pairs))

    def validate(self, labels: list[str] | None = None) -> LabeledGraph:
        """Raise ValueError for nulls, edges between undeclared vertices and, if labels are given, other labels."""
        if self.edges.where("src is null or label is null or dst is null").limit(1).count():
            raise ValueError("an edge has a null")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        if ends.join(self.vertices, "id", "left_anti").limit(1).count():
            raise ValueError("an edge touches a vertex that is not declared")
        if labels is not None and self.edges.where(~F.col("label").isin(labels)).limit(1).count():
            raise ValueError("an edge has a label that no rule names")
        return self

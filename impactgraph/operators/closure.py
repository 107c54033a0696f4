"""Transitive closures as frontier loops: each round joins what is new with the edges and drops what is known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import discard, staged


def reachable_pairs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, member): all nodes reachable from each root over edges (src, dst), the root included.

    A pair enters once, in the round of its distance, so cycles end. edges are hashed by src once and reused by every round; what is known is gathered every few
    rounds, so plans stay short.
    """
    edges = staged(edges.select("src", "dst").where("src <> dst").distinct().repartition("src"), "closure-edges")
    front = staged(roots.select(F.col("root"), F.col("root").alias("member")).distinct(), "closure")
    parts = [front]
    while True:
        step = front.join(edges, F.col("member") == F.col("src")).select("root", F.col("dst").alias("member")).distinct()
        front = staged(step.join(reduce(DataFrame.unionByName, parts), ["root", "member"], "left_anti"), "closure")
        if front.isEmpty():
            discard(front, edges)
            return reduce(DataFrame.unionByName, parts)
        parts = gathered([*parts, front], "closure", keep=1)


def gathered(parts: list[DataFrame], name: str, most: int = 8, keep: int = 0) -> list[DataFrame]:
    """parts, made one table when there are more than `most`; the last `keep` stay as tables of their own beside it."""
    if len(parts) <= most:
        return parts
    old = parts[: len(parts) - keep]
    one = staged(reduce(DataFrame.unionByName, old), name)
    discard(*old)
    return [one, *parts[len(parts) - keep :]]


def importer_closure(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, member): the files that import root directly or through others, root included. roots has a column root."""
    return reachable_pairs(imports.select(F.col("to_file").alias("src"), F.col("from_file").alias("dst")), roots)

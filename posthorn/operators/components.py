"""Connected components of an edge table.

Alternating large-star and small-star steps: each step links nodes to the smallest neighbour
they know, so a component becomes a star around its smallest node after a number of rounds that
grows with the logarithm of its size. A step only needs each node's minimum (a partial
aggregate) and a join by node, so no neighbourhood is ever collected; nodes of many links, as the
centre of a star is, are joined by a broadcast of these few. Every round is written to
the shared folder, which bounds the plan and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posthorn.plans.scratch import drop, materialise


#: Keys with more rows than this, and than one in MOST_HOT of all rows, are hot; so there are at most MOST_HOT of them.
HOT, MOST_HOT = 1_000, 50_000


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``table``, which is written once and has each key once, and in ``weight`` how many of ``rows`` have it.

    Hot keys are joined by a broadcast of their rows of ``table``, the others by a shuffle, so a key
    of a third of all rows is not one task. The weights' sum bounds the number of hot keys: there are at
    most MOST_HOT, whatever the number of rows.
    """
    table = materialise(table, "by-key")
    found = table.agg(F.sum(weight).alias("total"), F.max(weight).alias("most")).first()
    floor = max(HOT, (found.total or 0) // MOST_HOT)
    if (found.most or 0) <= floor:
        return rows.join(table, keys)
    hot = F.col(weight) > floor
    few, many = F.broadcast(table.where(hot)), table.where(~hot)
    rest = rows.join(few.select(*keys), keys, "left_anti").join(many, keys)
    return rows.join(few, keys).unionByName(rest)


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node among it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n")).select("src", F.least("src", "m").alias("m"), "n")
    return (
        join_by_key(both, least, ["src"], "n").where(F.col("dst") > F.col("src"))
        .select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges have src > dst."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n"))
    moved = join_by_key(edges, least, ["src"], "n").where(F.col("dst") != F.col("m")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """A number of edges and an order-free checksum, to see when nothing changes any more."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for every node of ``edges``.

    ``edges`` has two columns ``src`` and ``dst`` of one orderable type, in either direction;
    self-links, repeats and nulls are ignored. An empty table gives an empty one.
    """
    now = materialise(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(),
        "edges",
    )
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        old, large = now, materialise(_large(now), "edges")
        now = materialise(_small(large), "edges")
        before, state = state, _state(now)
        drop(now.sparkSession, old)
        drop(now.sparkSession, large)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    )

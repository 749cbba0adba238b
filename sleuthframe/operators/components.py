"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.plans.lineage import materialise

#: Rows beyond which a node is a hub, and how many hubs there may be at most.
HUB_ROWS, HUBS = 100_000, 10_000


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set: its size and an order-free hash sum."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _with_least(rows: DataFrame, least: DataFrame, size: int) -> DataFrame:
    """``a, b`` with ``m`` of ``a`` from ``least`` (``a, m, n``; ``n`` rows of it among about ``size``).

    In the end every component is one star, so the rows of its centre would be
    sorted in one task. Hubs, of which there are HUBS or so at most, are told to
    all tasks instead; only the others' rows are shuffled.
    """
    bound = max(HUB_ROWS, size // HUBS)
    if size <= bound:
        return rows.join(least.select("a", "m"), "a")
    hubs = F.broadcast(least.where(F.col("n") > bound).select("a", F.col("m").alias("hub_m")))
    told = rows.join(hubs, "a", "left")
    others = told.where("hub_m is null").select("a", "b").join(least.where(F.col("n") <= bound).select("a", "m"), "a")
    return others.unionByName(told.where("hub_m is not null").select("a", "b", F.col("hub_m").alias("m")))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Label the nodes of an undirected graph with the smallest node reachable.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Returns ``node``
    and ``component`` for every node that has an edge. Loops, repeated edges and
    either direction are allowed; rows with a null end are ignored.

    Large-star links every greater neighbour of a node to its least neighbour,
    small-star links the lesser ones. A neighbourhood is only ever reduced to its
    minimum (partial aggregation) and joined back; a large one's rows stay where
    they are (``_with_least``), so no task holds one whole.
    """
    star = materialise(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _mark(star)
    if not before[0]:
        return star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(both.where(F.col("b") > F.col("a")), least, 2 * before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            _with_least(large, low, before[0])
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        star = materialise(small)
        after = _mark(star)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

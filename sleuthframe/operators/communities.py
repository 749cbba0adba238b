"""Communities by modularity, level by level, and what is known of their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.operators.rollups import both_ways
from sleuthframe.plans.lineage import written

#: A level that adds less modularity than this is not taken.
LEAST_GAIN = 1e-7
#: Bands of members who count as assessed and as flagged.
INSUFFICIENT, FLAGGED = "insufficient", ("elevated", "notable")


def weighted_pairs(edges: DataFrame) -> DataFrame:
    """Undirected ``src <= dst, w`` from ``a, b, weight``: parallel links added up, loops kept, weights of 0 or less dropped."""
    return edges.where("weight > 0").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum(F.col("weight").cast("double")).alias("w"))


def strengths(pairs: DataFrame) -> DataFrame:
    """``ref, k``: the weight at each node; a loop counts at both of its ends. Also ``links`` to others, ``loops`` and ``near``, the least of the others."""
    other = F.when(F.col("ref") != F.col("other"), F.col("other"))
    return both_ways(pairs).groupBy("ref").agg(F.sum("w").alias("k"), F.count(other).alias("links"), F.count(F.when(other.isNull(), 1)).alias("loops"), F.min(other).alias("near"))


def folded_leaves(pairs: DataFrame, strength: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The graph without its leaves, which become loops of the node they hang on, and ``ref, c`` of all nodes; None without leaves.

    A leaf, a node of one link and no loop, is together with its neighbour in every
    partition of greatest modularity: moving there gains ``w * (2m - total) / m``,
    more than 0. So leaves need no rounds. Of two nodes with nothing but a link
    between them the greater is the leaf. ``strength`` is as ``strengths`` tells.
    A community is named after its smallest member.
    """
    leaves = strength.where("links = 1 and loops = 0").select("ref", "near", "k")
    if leaves.isEmpty():
        return None
    ends = leaves.groupBy(F.least("ref", "near").alias("src"), F.greatest("ref", "near").alias("dst")).agg(F.max("ref").alias("leaf"), F.max("k").alias("w"))
    cut = written(ends.select("src", "dst", "leaf", F.when(F.col("leaf") == F.col("dst"), F.col("src")).otherwise(F.col("dst")).alias("hub"), "w"))
    part = strength.select("ref").join(cut.select(F.col("leaf").alias("ref"), "hub"), "ref", "left").select("ref", F.coalesce("hub", "ref").alias("c"))
    names = written(cut.groupBy(F.col("hub").alias("c")).agg(F.min("leaf").alias("name")).where("name < c"))
    renamed = not names.isEmpty()
    if renamed:
        part = part.join(names, "c", "left").select("ref", F.coalesce("name", "c").alias("c"))
    part = written(part)
    rest = pairs.join(cut.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(cut.groupBy("hub").agg(F.sum("w").alias("w")).select(F.col("hub").alias("src"), F.col("hub").alias("dst"), "w"))
    if renamed:
        for end in ("src", "dst"):
            rest = rest.join(names.withColumnRenamed("c", end), end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    return written(weighted_pairs(rest.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("weight")))), part


def _best_moves(links: DataFrame, at: DataFrame, turn: Column, twice: float) -> DataFrame:
    """``ref, best``: the community, of those beside it and its own, that is best for each node (``ref, k, c``) whose ``turn`` it is.

    ``links`` lie by their node, so that they are summed up by community before they
    go anywhere: what is shuffled are a node's communities, not its links.
    """
    sized = at.join(at.groupBy("c").agg(F.sum("k").alias("total")), "c").select("ref", "k", "c", "total")
    near = links.where(turn).join(sized.select(F.col("ref").alias("other"), "c", "total"), "other").select("ref", "c", "w", "total")
    own = sized.where(turn).select("ref", "c", F.lit(0.0).alias("w"), "total")
    options = near.unionByName(own).groupBy("ref", "c").agg(F.sum("w").alias("w_in"), F.max("total").alias("total"))
    options = options.join(at.where(turn).select("ref", "k", F.col("c").alias("own")), "ref")
    gain = F.col("w_in") - (F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) * F.col("k") / twice
    return options.groupBy("ref").agg(F.min_by("c", F.struct(-F.round(gain, 9), (F.col("c") != F.col("own")).cast("int"), F.col("c"))).alias("best"))


def local_moves(pairs: DataFrame, strength: DataFrame, twice: float, rounds: int) -> tuple[DataFrame, bool]:
    """``ref, c`` after nodes have moved to the neighbouring community with the greatest gain, and whether none wants to move any more.

    Each round about every second node (by a hash of node and pair of rounds; the
    others follow in the next) goes where ``w_in - total * k / 2m`` is greatest,
    ties to the own community, then to the smallest; so neighbours don't swap for
    ever. Only the links of nodes whose turn it is are looked at; when neither half
    of a pair of rounds moves, none wants to. A community is named after its
    smallest member. No task holds the graph.
    """
    links = written(both_ways(pairs.where("src <> dst")).select("ref", "other", "w").repartition("ref").sortWithinPartitions("ref"))
    at, settled, still = strength.select("ref", "k", F.col("ref").alias("c")), False, False
    for r in range(rounds):
        turn = F.pmod(F.xxhash64("ref", F.lit(r // 2)), F.lit(2)) == r % 2
        at = written(at.join(_best_moves(links, at, turn, twice), "ref", "left").select("ref", "k", F.coalesce("best", "c").alias("c"), (F.col("best") != F.col("c")).alias("moved")))
        quiet, still = still, not at.agg(F.max("moved")).first()[0]
        at = at.drop("moved")
        if still and quiet and r % 2:
            settled = True
            break
    if still and not settled:
        rest = F.pmod(F.xxhash64("ref", F.lit((rounds - 1) // 2)), F.lit(2)) != (rounds - 1) % 2
        settled = at.join(_best_moves(links, at, rest, twice), "ref").where("best <> c").isEmpty()
    name = at.groupBy("c").agg(F.min("ref").alias("name"))
    return written(at.join(name, "c").select("ref", F.col("name").alias("c"))), settled


def modularity(pairs: DataFrame, parts: DataFrame) -> float:
    """Of a partition (``ref, c``): the share of weight within communities less what chance would put there; 0 without links."""
    ends = pairs.join(parts.toDF("src", "c_src"), "src").join(parts.toDF("dst", "c_dst"), "dst")
    inner = ends.where("c_src = c_dst").agg(F.sum("w").alias("w")).first()["w"] or 0.0
    sums = strengths(pairs).join(parts, "ref").groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum("k").alias("whole"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
    whole = sums["whole"] or 0.0
    return 2 * inner / whole - sums["squares"] / whole**2 if whole else 0.0


def _merged_modularity(pairs: DataFrame, strength: DataFrame) -> float:
    """The same of a graph whose nodes are the communities: its loops are the weight within."""
    inner = pairs.where("src = dst").agg(F.sum("w").alias("w")).first()["w"] or 0.0
    sums = strength.agg(F.sum("k").alias("whole"), F.sum(F.col("k") * F.col("k")).alias("squares")).first()
    whole = sums["whole"] or 0.0
    return 2 * inner / whole - sums["squares"] / whole**2 if whole else 0.0


def louvain(edges: DataFrame, levels: int = 10, rounds: int = 40) -> DataFrame:
    """``ref, community, level, settled``: communities of undirected weighted links ``a, b, weight``, by modularity.

    Leaves join their only neighbour first (``folded_leaves``). Nodes move until
    none gains (``local_moves``); then each community becomes one node, links
    between two communities one link and those within a loop, and the same is done
    to that smaller graph, until a level adds nothing. ``level`` is how many levels
    were taken, the leaves' one included, ``settled`` whether every level ended
    before its rounds did. A community is named after its smallest member. Nodes
    are those with a link of positive weight; loops count for their node. No rows
    without any.
    """
    pairs = written(weighted_pairs(edges))
    strength = written(strengths(pairs))
    parts, settled, taken = strength.select("ref", F.col("ref").alias("c")), True, 0
    folded = folded_leaves(pairs, strength)
    if folded:
        (pairs, parts), taken = folded, 1
        strength = written(strengths(pairs))
    twice = strength.agg(F.sum("k")).first()[0] or 0.0
    best = _merged_modularity(pairs, strength)
    for _ in range(levels):
        if pairs.where("src <> dst").isEmpty():
            break
        moved, still = local_moves(pairs, strength, twice, rounds)
        named = pairs.join(moved.toDF("src", "a"), "src").join(moved.toDF("dst", "b"), "dst")
        merged = written(weighted_pairs(named.select("a", "b", F.col("w").alias("weight"))))
        sums = written(strengths(merged))
        found = _merged_modularity(merged, sums)
        if found <= best + LEAST_GAIN:
            break
        parts = written(parts.join(moved.toDF("c", "then"), "c").select("ref", F.col("then").alias("c")))
        pairs, strength, best, taken, settled = merged, sums, found, taken + 1, settled and still
    return parts.select("ref", F.col("c").alias("community"), F.lit(taken).alias("level"), F.lit(settled).alias("settled"))


def community_summary(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is known of each community (``ref, community``) from ``nodes`` (``ref, band, score``): ``community, size, assessed, flagged, top_ref, top_band, top_score``.

    Assessed are members with a band other than INSUFFICIENT, flagged those in
    FLAGGED: counts beside their denominators, and no mean over members whose
    scores rest on different evidence. The top member has the greatest score,
    ties to the smallest ref; without any score it is the smallest ref. Members
    that ``nodes`` lacks count in the size alone.
    """
    joined = members.select("community", "ref").join(nodes.select("ref", "band", "score"), "ref", "left")
    count = lambda c: F.count(F.when(c, 1))
    top = F.min_by(F.struct("ref", "band", "score"), F.struct(F.col("score").isNull(), -F.col("score"), F.col("ref")))
    sums = joined.groupBy("community").agg(F.count(F.lit(1)).alias("size"), count(F.col("band") != INSUFFICIENT).alias("assessed"), count(F.col("band").isin(*FLAGGED)).alias("flagged"), top.alias("top"))
    return sums.select("community", "size", "assessed", "flagged", *[F.col(f"top.{c}").alias(f"top_{c}") for c in ("ref", "band", "score")])


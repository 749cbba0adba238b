"""Graph operators as joins and aggregations over edge tables."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.operators.components import connected_components
from sleuthframe.operators.rollups import both_ways
from sleuthframe.plans.lineage import materialise, written

#: Rounds after which an iterative operator writes its state and goes on from there.
ROUNDS_PER_CUT = 4
#: Sources that go by the bits of one number.
GROUPED = 62
#: Seeds of a list, about, that an edge is brought together with.
SEEDS = 4_096
#: Steps of an amount that half-trails are joined by at a time; hashes of their ends that a task holds, and how many times over.
STEPS, KEYS, PASSES = 8, 1 << 20, 8
#: Transfers that may follow one, on average, at the loss with which the best trails are first sought.
FIRST_RATE = 0.4


def _every(df: DataFrame, k: int) -> DataFrame:
    return materialise(df) if k % ROUNDS_PER_CUT == ROUNDS_PER_CUT - 1 else df


def neighbours(edges: DataFrame) -> DataFrame:
    """``ref, other, outgoing, edge_id`` from either end of every edge."""
    return both_ways(edges.select("src", "dst", "edge_id"))


def within_hops(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``seed, ref, hops``: least number of edges (either direction) from each seed, up to ``hops``, the seed itself included."""
    links = both_ways(edges.select("src", "dst")).where("ref <> other").select("ref", "other").distinct()
    seen = seeds.select(F.col("ref").alias("seed"), "ref", F.lit(0).alias("hops"))
    frontier = seen
    for k in range(1, hops + 1):
        reached = frontier.join(links, "ref").select("seed", F.col("other").alias("ref")).distinct()
        frontier = written(reached.join(seen, ["seed", "ref"], "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(seeds: DataFrame, edges: DataFrame, depth: int = 3, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """What is around each seed, as a graph: nodes ``seed, ref, hops`` and links ``seed, edge_id, src, dst, beyond``.

    Nodes are the seed and the next ones in either direction up to ``depth``, at
    most ``most`` of them by hops and then by ref; a seed that is full goes no
    further. Links are all those at a node within less than ``depth``, each once
    a seed; ``beyond`` says that an end is not among the nodes, so that a cut is
    seen where it was made. A hub is joined, but not more than ``most`` of what
    it leads to goes on.
    """
    ways = written(both_ways(edges.select("src", "dst", "edge_id")))
    links = ways.where("ref <> other").select("ref", "other").distinct()
    nodes = seeds.select(F.col("ref").alias("seed"), "ref", F.lit(0).alias("hops")).distinct()
    front = nodes
    for k in range(1, depth + 1):
        room = nodes.groupBy("seed").agg((most - F.count(F.lit(1))).alias("room")).where("room > 0")
        reached = front.join(links, "ref").select("seed", F.col("other").alias("ref")).distinct().join(nodes.select("seed", "ref"), ["seed", "ref"], "left_anti")
        placed = reached.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy("ref"))).where(F.col("place") < most)
        front = written(placed.join(room, "seed").where("place <= room").select("seed", "ref", F.lit(k).alias("hops")))
        nodes = written(nodes.unionByName(front))
        if front.isEmpty():
            break
    return nodes, _links_around(nodes, ways.where("outgoing").select("edge_id", F.col("ref").alias("src"), F.col("other").alias("dst")).distinct(), depth)


def _links_around(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``seed, edge_id, src, dst, beyond`` of the edges at nodes (``seed, ref, hops``) within less than ``depth``.

    An edge meets the lists of seeds that have its ends, SEEDS or so in a list,
    so that what is shuffled is a row an edge and list, not one an edge and seed.
    """
    lists = -(-nodes.where("hops = 0").count() // SEEDS)
    own = lambda near: F.array_sort(F.collect_list(F.when(near, F.col("seed"))))
    held = written(nodes.groupBy("ref", F.pmod(F.xxhash64("seed"), F.lit(max(1, lists))).alias("list")).agg(own(F.col("hops") < depth).alias("within"), own(F.col("hops") >= depth).alias("last")))
    none = F.array().cast(held.schema["within"].dataType)
    sides = None
    for end in ("src", "dst"):
        there = {f"{c}_{e}": F.col(c) if e == end else F.lit(None).cast(held.schema["within"].dataType) for e in ("src", "dst") for c in ("within", "last")}
        side = edges.join(held, edges[end] == held["ref"]).select("edge_id", "src", "dst", "list", *[v.alias(k) for k, v in there.items()])
        sides = side if sides is None else sides.unionByName(side)
    columns = [c for c in sides.columns if c not in ("edge_id", "src", "dst", "list")]
    met = sides.repartition("edge_id", "src", "dst", "list").groupBy("edge_id", "src", "dst", "list").agg(*[F.coalesce(F.first(c, ignorenulls=True), none).alias(c) for c in columns])
    met = met.withColumn("touched", F.array_union("within_src", "within_dst"))
    met = met.withColumn("inside", F.array_intersect(F.array_intersect("touched", F.concat("within_src", "last_src")), F.concat("within_dst", "last_dst")))
    told = lambda seeds, beyond: F.transform(seeds, lambda x: F.struct(x.alias("seed"), F.lit(beyond).alias("beyond")))
    rows = met.select("edge_id", "src", "dst", F.inline(F.concat(told(F.col("inside"), False), told(F.array_except("touched", "inside"), True))))
    return rows.select("seed", "edge_id", "src", "dst", "beyond")


def paths_from(sources: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """``a, b, length, path``: an undirected shortest path of at most ``most`` edges from each source (``ref``) to every node that it reaches, itself left out.

    Of paths of equal length the one whose predecessors are least. Every round
    keeps one way to each node reached, so nothing grows but the frontier.
    """
    links = written(both_ways(edges.select("src", "dst")).where("ref <> other").select("ref", "other").distinct())
    ways = sources.select(F.col("ref").alias("a")).distinct().select("a", F.col("a").alias("ref"), F.array("a").alias("path"))
    seen, found = ways.select("a", "ref"), []
    for k in range(1, most + 1):
        step = ways.join(links, "ref").groupBy("a", "other").agg(F.min("path").alias("path"))
        step = step.select("a", F.col("other").alias("ref"), F.concat("path", F.array("other")).alias("path"))
        ways = written(step.join(seen, ["a", "ref"], "left_anti"))
        found.append(ways.select("a", F.col("ref").alias("b"), F.lit(k).alias("length"), "path"))
        if k == most or ways.isEmpty():
            break
        seen = written(seen.unionByName(ways.select("a", "ref")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def distances_from(sources: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """``a, b, length``: the least number of edges, at most ``most``, from each source (``ref``) to every node that it reaches, itself left out.

    Sources go in groups of 62, one bit of a number each, so that a round carries
    a row a node and group and not a row a node and source.
    """
    links = written(both_ways(edges.select("src", "dst")).where("ref <> other").select("ref", "other").distinct())
    numbered = written(sources.select("ref").distinct().withColumn("id", F.monotonically_increasing_id())).select("ref", F.floor(F.col("id") / GROUPED).alias("g"), (F.col("id") % GROUPED).cast("int").alias("bit"))
    front = numbered.select("g", "ref", F.expr("shiftleft(1L, bit)").alias("bits"))
    seen, found = front, []
    for k in range(1, most + 1):
        step = front.join(links, "ref").groupBy("g", F.col("other").alias("ref")).agg(F.bit_or("bits").alias("bits"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        front = written(step.join(seen.withColumnRenamed("bits", "old"), ["g", "ref"], "left").select("g", "ref", fresh.alias("bits")).where("bits <> 0"))
        found.append(front.withColumn("length", F.lit(k)))
        if k == most or front.isEmpty():
            break
        seen = written(seen.unionByName(front).groupBy("g", "ref").agg(F.bit_or("bits").alias("bits")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    names = numbered.groupBy("g").agg(F.collect_list(F.struct("bit", F.col("ref").alias("a"))).alias("names"))
    held = F.filter("names", lambda x: F.call_function("getbit", F.col("bits"), x["bit"]) == 1)
    return every.join(names, "g").select(F.explode(F.transform(held, lambda x: x["a"])).alias("a"), F.col("ref").alias("b"), "length")


def shortest_paths(pairs: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """``a, b, length, path``: an undirected shortest path of at most ``most`` edges for each pair that has one, as ``paths_from``; a node to itself has length 0."""
    wanted = pairs.select("a", "b").distinct()
    found = paths_from(wanted.select(F.col("a").alias("ref")), edges, most).join(wanted, ["a", "b"], "left_semi")
    return found.unionByName(wanted.where("a = b").select("a", "b", F.lit(0).alias("length"), F.array("a").alias("path")))


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """``ref, rank`` by weighted PageRank without normalisation: (1 - d) + d times what comes in; what ends in a sink is lost.

    ``edges`` has ``src, dst, weight``; parallel edges are added up once, before the rounds.
    """
    sums = edges.where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    total = sums.groupBy("src").agg(F.sum("w").alias("t"))
    share = materialise(sums.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("share")))
    nodes = materialise(vertices.select("ref").distinct())
    rank = nodes.withColumn("rank", F.lit(1.0))
    for k in range(rounds):
        flow = share.join(rank.withColumnRenamed("ref", "src"), "src").groupBy(F.col("dst").alias("ref")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        rank = _every(nodes.join(flow, "ref", "left").select("ref", (F.lit(1 - damping) + damping * F.coalesce("flow", F.lit(0.0))).alias("rank")), k)
    return rank


def successors(transfers: DataFrame, days: int = 7, least: float = 0.85, most: float = 1.0) -> DataFrame:
    """Pairs of transfers, the second leaving the account that the first reached: ``edge_id, next_id, src, dst, next_dst, amount, next_amount, ts, next_ts, retention``.

    They are at most ``days`` apart, in either order, and the second has between
    ``least`` and ``most`` of the first's amount. They meet by account and time
    bucket, so a busy account is spread over its buckets.
    """
    span = days * 86_400_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = transfers.select("edge_id", "src", "dst", "amount", "ts", micros.alias("us"))
    first = timed.where("amount > 0").withColumn("account", F.col("dst")).withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("us") / span) + k)))
    second = timed.select(F.col("edge_id").alias("next_id"), F.col("src").alias("account"), F.col("dst").alias("next_dst"), F.col("amount").alias("next_amount"), F.col("ts").alias("next_ts"), F.col("us").alias("next_us"), F.floor(F.col("us") / span).alias("bucket"))
    near = (F.abs(F.col("us") - F.col("next_us")) <= span) & (F.col("next_amount") <= most * F.col("amount")) & (F.col("next_amount") >= least * F.col("amount")) & (F.col("edge_id") != F.col("next_id"))
    pairs = first.join(second, ["account", "bucket"]).where(near)
    return pairs.select("edge_id", "next_id", "src", "dst", "next_dst", "amount", "next_amount", "ts", "next_ts", (F.col("next_amount") / F.col("amount")).alias("retention"))


def funds_cycles(transfers: DataFrame, hops: int = 8, days: int = 7, least: float = 0.85) -> DataFrame:
    """Money that comes back: ``cycle`` (sorted transfer ids), ``hops, total, retention``.

    A path of 3 to ``hops`` successive transfers whose last one ends where the
    first began; no account is passed twice, but that the first transfer may
    stay where it is. Paths over the same transfers count once.
    """
    pairs = materialise(successors(transfers, days, least))
    path = pairs.select(F.col("src").alias("origin"), F.array("edge_id", "next_id").alias("ids"), F.array_distinct(F.array("src", "dst", "next_dst")).alias("seen"), F.col("next_id").alias("last"), "next_dst", F.col("amount").alias("first_amount"), F.col("next_amount").alias("last_amount"), (F.col("amount") + F.col("next_amount")).alias("total"), F.col("dst").alias("through"), F.col("next_dst").alias("target"))
    path = path.where((F.col("next_dst") != F.col("origin")) & (F.col("next_dst") != F.col("through")))
    step = pairs.select(F.col("edge_id").alias("last"), F.col("next_id").alias("then"), F.col("next_dst").alias("then_dst"), F.col("next_amount").alias("then_amount"))
    closed = None
    for k in range(3, hops + 1):
        longer = path.join(step, "last").where(~F.array_contains("ids", F.col("then")))
        longer = longer.select("origin", F.concat("ids", F.array("then")).alias("ids"), "seen", F.col("then").alias("last"), F.col("then_dst").alias("next_dst"), "first_amount", F.col("then_amount").alias("last_amount"), (F.col("total") + F.col("then_amount")).alias("total"))
        longer = materialise(longer)
        back = longer.where(F.col("next_dst") == F.col("origin")).select(F.array_sort("ids").alias("cycle"), F.lit(k).alias("hops"), "total", (F.col("last_amount") / F.col("first_amount")).alias("retention"))
        closed = back if closed is None else closed.unionByName(back)
        path = longer.where((F.col("next_dst") != F.col("origin")) & ~F.array_contains("seen", F.col("next_dst"))).withColumn("seen", F.concat("seen", F.array("next_dst")))
    return closed.groupBy("cycle", "hops").agg(F.max("total").alias("total"), F.max("retention").alias("retention"))


def _amount_bucket(amount: Column, kept: float) -> Column:
    """Steps of an amount's logarithm, a little wider than the loss that ``kept`` allows: what fits is in the same step or the one below."""
    return F.floor(F.log(amount) / (-math.log(kept) * 1.000001))


def _passes_on(then: str, before: str, kept: float) -> Column:
    return (F.col(then) <= F.col(before)) & (F.col(then) >= kept * F.col(before))


def _near_steps(amount: Column, kept: float) -> tuple[Column, Column]:
    """STEPS of those steps as one, to join by: an amount's own, and all those of amounts which it may follow, mostly one."""
    width = -math.log(kept) * 1.000001
    own = lambda more: F.floor((F.log(amount) + more) / (STEPS * width))
    return own(0.0), F.array_distinct(F.array(own(0.0), own(width)))


def _money(transfers: DataFrame) -> DataFrame:
    return written(transfers.where("amount > 0").select("edge_id", "src", "dst", F.col("amount").cast("double").alias("amount")))


def half_trails(money: DataFrame, hops: int, kept: float, total: float = 0.0) -> list[DataFrame]:
    """Trails of 1, 2, ... ``hops`` transfers (``edge_id, src, dst, amount``, positive), none twice: ``origin, at, ids, first, last, between``, which is what those between first and last sum up to.

    Each transfer has ``kept`` to all of the one before and the last ``total`` of
    the first, whatever their times. They meet by account and by steps of the
    amount's logarithm, so that only amounts which may fit are compared.
    """
    then = money.select(F.col("edge_id").alias("then"), F.col("src").alias("at"), F.col("dst").alias("to"), F.col("amount").alias("onward"), F.explode(_near_steps(F.col("amount"), kept)[1]).alias("bucket"))
    trails = [money.select(F.col("src").alias("origin"), F.col("dst").alias("at"), F.array("edge_id").alias("ids"), F.col("amount").alias("first"), F.col("amount").alias("last"), F.lit(0.0).alias("between"))]
    for k in range(hops - 1):
        near = trails[-1].withColumn("bucket", _near_steps(F.col("last"), kept)[0]).join(then, ["at", "bucket"])
        fits = _passes_on("onward", "last", kept) & (F.col("onward") >= total * F.col("first")) & ~F.array_contains("ids", F.col("then"))
        passed = F.col("between") + (F.col("last") if k else F.lit(0.0))
        trails.append(written(near.where(fits).select("origin", F.col("to").alias("at"), F.concat("ids", F.array("then")).alias("ids"), "first", F.col("onward").alias("last"), passed.alias("between"))))
    return trails


def _meeting(halves: list[DataFrame], lengths: list[int], kept: float, total: float) -> DataFrame:
    """Half-trails that close to trails of the given lengths.

    They meet by both of their ends and by steps of the amount. First the hashes
    of these alone are brought together, as most half-trails meet none; those
    on both sides pick the half-trails that are shuffled, KEYS hashes at a time.
    Where more than PASSES times as many meet, all half-trails are shuffled.
    """
    bucket = _amount_bucket(F.col("first"), kept)
    one, two = (reduce(DataFrame.unionByName, [halves[n - 1].withColumn("n", F.lit(n)) for n in sorted(sizes)]) for sizes in ({-(-x // 2) for x in lengths}, {x // 2 for x in lengths}))
    one = one.withColumn("key", F.xxhash64("origin", "at", _amount_bucket(F.col("last"), kept)))
    two = two.select(F.col("origin").alias("at"), F.col("at").alias("origin"), F.explode(F.array(F.xxhash64("at", "origin", bucket), F.xxhash64("at", "origin", bucket + 1))).alias("key"), F.col("ids").alias("then"), F.col("first").alias("onward"), F.col("last").alias("end"), F.when(F.col("n") > 1, F.col("between") + F.col("last")).otherwise(0.0).alias("rest"), F.col("n").alias("m"))
    sides = one.select("key", F.lit(1).alias("side")).unionByName(two.select("key", F.lit(2).alias("side")))
    keys = written(sides.groupBy("key").agg(F.bit_or("side").alias("side")).where("side = 3").select("key"))
    passes = max(1, -(-keys.count() // KEYS))
    held = [keys.where(F.pmod("key", F.lit(passes)) == i) for i in range(passes)] if passes <= PASSES else [None]
    fits = _passes_on("onward", "last", kept) & (F.col("end") >= total * F.col("first")) & ~F.arrays_overlap("ids", "then") & F.col("n").isin(*{-(-x // 2) for x in lengths}) & (F.col("n") - F.col("m")).isin(0, 1) & (F.col("n") + F.col("m")).isin(*lengths)
    closed = None
    for some in held:
        left, right = (df if some is None else df.join(F.broadcast(some), "key", "left_semi") for df in (one, two))  # KEYS rows
        near = left.join(right, ["key", "origin", "at"]).where(fits)
        sums = F.col("first") + F.col("between") + F.when(F.col("n") > 1, F.col("last")).otherwise(0.0) + F.col("onward") + F.col("rest")
        found = near.select(F.concat("ids", "then").alias("trail"), (F.col("n") + F.col("m")).alias("length"), sums.alias("total"), (F.col("end") / F.col("first")).alias("retention"))
        closed = found if closed is None else closed.unionByName(found)
    return closed


def closed_trails(transfers: DataFrame, least: int = 3, most: int = 6, kept: float = 0.85, total: float = 0.0) -> DataFrame:
    """Trails of ``least`` to ``most`` transfers, none twice, that end where they began: ``trail, length, total, retention``.

    Each transfer has ``kept`` to all of the one before, and the last ``total`` of
    the first; times don't count. Half-trails of at most half the length meet in
    the middle, by both of their ends and by steps of the amount, so nothing
    longer is built that doesn't close. ``trail`` has the transfers in order.
    """
    kept = max(kept, total)
    return _meeting(half_trails(_money(transfers), -(-most // 2), kept, total), list(range(least, most + 1)), kept, total)


def _successors_a_loss(money: DataFrame) -> float:
    """About how many transfers may follow one, for each unit of loss: by what goes through the accounts and how close amounts are in all."""
    ways = money.groupBy(F.col("src").alias("at")).agg(F.count(F.lit(1)).cast("double").alias("out")).join(money.groupBy(F.col("dst").alias("at")).agg(F.count(F.lit(1)).alias("in")), "at").agg(F.sum(F.col("out") * F.col("in"))).first()[0]
    near = money.groupBy(F.floor(F.log("amount") * 100)).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares")).first()
    return (ways or 0.0) * 100 * near["squares"] / near["n"] ** 3 if near["n"] else 0.0


def _wider(left: list[int], counts: dict[int, int], k: int, rate: float) -> float:
    """By how much the loss should grow until each length that is left has ``k`` trails, from ``counts`` at a loss where ``rate`` transfers follow one.

    Trails of n grow as the loss to the power n - 1, and of one more there are
    ``rate / n`` times as many. Twice at most, but that 2 follow one.
    """
    wants = [1.1]
    for n in left:
        base = max((m for m in counts if m <= n and counts[m] >= 5), default=None)
        likely = counts[base] * rate ** (n - base) * math.factorial(base - 1) / math.factorial(n - 1) if base else 0
        wants.append((1.4 * k / likely) ** (1 / (n - 1)) if likely else math.inf)
    return min(max(wants), max(2.0, 2 / rate if rate and counts else 2.0))


def best_trails(transfers: DataFrame, k: int = 25, least: int = 3, most: int = 6, kept: float = 0.85, gap: float = 1e-4) -> DataFrame:
    """For each length the ``k`` closed trails that keep most of the money, ties by their transfers: as ``closed_trails``, with ``rank``.

    All closed trails of a dense graph are far too many to list. But a trail that
    keeps a share of the whole keeps at least that at each transfer. So trails are
    sought that lose ``gap`` at most or as much that a few transfers in ten are
    followed by another, then more, by what was found (``_wider``), until a length
    has ``k`` of them, which are then its best, or may lose all that ``kept`` allows.
    Every loss gives the same trails; it only decides how many are looked at. The
    first one is for short trails, which tell how much the longer ones need.
    """
    money = _money(transfers)
    size, out, left = money.count(), [], list(range(least, most + 1))
    gap = max(gap, min(FIRST_RATE / max(_successors_a_loss(money), 1e-9), 1 - kept ** (most - 1)))
    asked = [n for n in left if n <= 4] or left
    while left:
        near = max(kept, 1 - gap)
        halves = half_trails(money, -(-max(asked) // 2), near, 1 - gap)
        found = written(_meeting(halves, asked, near, 1 - gap))
        counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
        done = [n for n in asked if counts.get(n, 0) >= k or 1 - gap <= kept ** (n - 1)]
        out.append(found.where(F.col("length").isin(done)))
        left = asked = [n for n in left if n not in done]
        if left:
            gap = min(1.0, gap * _wider(left, counts, k, halves[1].count() / size if len(halves) > 1 and size else 0.0))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("length").orderBy(F.desc("retention"), F.asc("trail"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def overview(nodes: DataFrame, edges: DataFrame, seeds: int = 25, most: int = 400) -> DataFrame:
    """The largest ``most`` edges (``edge_id, src, dst, amount``) at the ``seeds`` nodes with the highest positive ``score``, ties by ref."""
    top = F.broadcast(nodes.where("score > 0").orderBy(F.desc("score"), "ref").limit(seeds).select(F.col("ref").alias("_seed")))  # ``seeds`` rows
    touching = edges.join(top, (F.col("src") == F.col("_seed")) | (F.col("dst") == F.col("_seed")), "left_semi")
    return touching.orderBy(F.desc("amount"), "edge_id").limit(most)


def projection(kinds: list[tuple[DataFrame, float | None, bool]]) -> DataFrame:
    """Weighted edges ``src, dst, weight`` of several kinds: (edges, weight or None for their own, directed). Undirected ones go both ways; parallel ones of a kind add up."""
    out = None
    for edges, weight, directed in kinds:
        rows = edges.select("src", "dst", (F.col("weight") if weight is None else F.lit(weight)).alias("weight"))
        rows = rows if directed else rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        rows = rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


def propagate(seeds: DataFrame, edges: DataFrame, hops: int = 3, share: float = 0.6) -> DataFrame:
    """Risk handed on from scored seeds (``ref, score``): ``ref, hops, delta, risk``.

    Hop k adds ``score / k * share`` of each parent to every node reached for
    the first time; the sum is kept, the greatest is handed on. Parallel edges
    count once, risk ends at 100.
    """
    links = both_ways(edges.select("src", "dst")).where("ref <> other").select("ref", "other").distinct()
    front = seeds.where("score is not null").groupBy("ref").agg(F.max("score").alias("carried"))
    seen, out = front.select("ref"), None
    for k in range(1, hops + 1):
        reached = front.join(links, "ref").groupBy(F.col("other").alias("ref")).agg(F.sum(F.col("carried") / k * share).alias("delta"), F.max(F.col("carried") / k * share).alias("carried"))
        reached = materialise(reached.join(seen, "ref", "left_anti"))
        step = reached.select("ref", F.lit(k).alias("hops"), "delta", F.round(F.least(F.lit(100.0), "delta"), 1).alias("risk"))
        out = step if out is None else out.unionByName(step)
        front, seen = reached.select("ref", "carried"), seen.unionByName(reached.select("ref"))
    return out


def forward_reach(subjects: DataFrame, transfers: DataFrame, hops: int = 4, days: int = 30, least: float = 0.80, carried: float = 0.55, most: int | None = 400) -> DataFrame:
    """Where each subject's money goes: ``subject, ref, hops, carried, first_amount, first_seen, last_seen, truncated``.

    ``subjects`` has ``subject, ref`` (its accounts). The first hop takes the
    largest transfer to each target; a later one must pass on ``least`` to all
    of what came, keep ``carried`` of the first amount, and all of the way must
    fit into ``days``. Of several ways to a target the one that carries most is
    kept, then the smaller transfer id; no target is reached twice.

    From the second hop on a subject goes on from the ``most`` targets that carry
    most (ties to the smaller ref); ``truncated`` says that it had more, so that
    what wasn't followed isn't taken for nothing there. Only subjects over the
    bound are ranked, and each task passes on its best ``most`` of them. With None
    all targets are followed and nobody is truncated.
    """
    span = days * 86_400_000_000
    micros = lambda ts: F.unix_micros(ts.cast("timestamp"))
    step_of = lambda amount: _amount_bucket(F.col(amount).cast("double"), min(least, 0.999))
    money = written(transfers.where("amount > 0").groupBy("src", "dst", "ts", "edge_id").agg(F.max("amount").alias("amount")).where("src <> dst"))
    own = subjects.select("subject", "ref").distinct()
    # rows are dealt as they are: the sums of max_by are wider than what they sum up, and few rows meet before
    start = own.join(money, own["ref"] == money["src"]).select("subject", F.col("dst").alias("at"), "amount", "ts", "edge_id").repartition("subject", "at").groupBy("subject", "at").agg(F.max_by(F.struct("amount", "ts"), F.struct("amount", -F.col("edge_id"))).alias("t"))
    front = start.select("subject", "at", F.col("t.amount").alias("first_amount"), F.col("t.amount").alias("amount"), F.col("t.ts").alias("first_seen"), F.col("t.ts").alias("last_seen"))
    seen = own.select("subject", F.col("ref").alias("at"))
    front = written(front.join(seen, ["subject", "at"], "left_anti"))
    out, cut = front.withColumn("hops", F.lit(1)), None
    # what may follow is in the same step of the amount's logarithm or the one below
    on = money.select(F.col("src").alias("at"), F.col("dst").alias("then"), F.col("amount").alias("onward"), F.col("ts").alias("then_ts"), "edge_id", step_of("amount").alias("step"))
    for k in range(2, hops + 1):
        seen = seen.unionByName(front.select("subject", "at"))
        begun, ended = F.least("first_seen", "then_ts"), F.greatest("last_seen", "then_ts")
        fits = (F.col("onward") <= F.col("amount")) & (F.col("onward") >= least * F.col("amount")) & (F.col("onward") >= carried * F.col("first_amount")) & (micros(ended) - micros(begun) <= span)
        step = front.withColumn("step", F.explode(F.array(step_of("amount"), step_of("amount") - 1))).join(on, ["at", "step"]).where(fits)
        way = F.struct("first_amount", F.col("onward").alias("amount"), "first_seen", "last_seen")
        step = step.select("subject", F.col("then").alias("at"), "first_amount", "onward", begun.alias("first_seen"), ended.alias("last_seen"), "edge_id").repartition("subject", "at")
        best = step.groupBy("subject", "at").agg(F.max_by(way, F.struct(F.col("onward") / F.col("first_amount"), -F.col("edge_id"))).alias("t"))
        front = written(best.select("subject", "at", "t.*").join(seen, ["subject", "at"], "left_anti"))
        if most is not None:
            over = written(front.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("subject"))
            if not over.isEmpty():
                order = Window.partitionBy("subject").orderBy(F.desc(F.col("amount") / F.col("first_amount")), F.asc("at"))
                strongest = front.join(over, "subject", "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")
                front = written(front.join(over, "subject", "left_anti").unionByName(strongest))
                cut = over if cut is None else cut.unionByName(over)
        out = out.unionByName(front.withColumn("hops", F.lit(k)))
    columns = ["subject", F.col("at").alias("ref"), "hops", (F.col("amount") / F.col("first_amount")).alias("carried"), "first_amount", "first_seen", "last_seen"]
    if cut is None:
        return out.select(*columns, F.lit(False).alias("truncated"))
    return out.join(cut.distinct().withColumn("cut", F.lit(True)), "subject", "left").select(*columns, F.coalesce("cut", F.lit(False)).alias("truncated"))


#: Links that a task holds for betweenness, and sources that it follows at a time, by nodes.
HELD_LINKS, HELD_STATES = 1 << 22, 1 << 22


def _block_betweenness(asked: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """``ref, score``: what shortest paths from a block of sources (``source``) give to the nodes of ``links`` (``ref, other``, both ways)."""
    names, at = np.unique(links["ref"].to_numpy(), return_inverse=True)
    other = np.searchsorted(names, links["other"].to_numpy())[np.argsort(at, kind="stable")]
    n, degree = len(names), np.bincount(at, minlength=len(names))
    first, score = np.cumsum(degree) - degree, np.zeros(len(names))
    sources = np.searchsorted(names, asked["source"].to_numpy())
    step = max(1, HELD_STATES // max(1, n))
    for begin in range(0, len(sources), step):
        some = sources[begin : begin + step]
        ways, level, place = np.zeros(len(some) * n), np.full(len(some) * n, -1, dtype="int32"), np.zeros(len(some) * n, dtype="int64")

        def around(front):
            """From each state of ``front`` (its place there) to the states beside it."""
            many = degree[front % n]
            origin = np.repeat(np.arange(len(front)), many)
            link = np.arange(len(origin)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[front % n], many)
            return origin, (front - front % n)[origin] + other[link]

        front = np.arange(len(some)) * n + some
        ways[front], level[front], levels = 1.0, 0, []
        while len(front):
            levels.append(front)
            origin, there = around(front)
            new = level[there] < 0
            origin, there = origin[new], there[new]
            level[there] = len(levels)
            np.add.at(ways, there, ways[front][origin])
            place[there] = np.arange(len(there))
            front = there[place[there] == np.arange(len(there))]
        part = np.zeros(len(some) * n)
        for k in range(len(levels) - 1, 0, -1):
            front = levels[k]
            origin, there = around(front)
            before = level[there] == k - 1
            origin, there = origin[before], there[before]
            np.add.at(part, there, ways[there] * ((1 + part[front]) / ways[front])[origin])
            score += np.bincount(front % n, weights=part[front], minlength=n)
    return pd.DataFrame({"ref": names, "score": score})[score > 0]


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``ref, score``: unweighted betweenness from the given sources (all nodes: exact), each pair counted once.

    Sources are dealt to blocks, and every block meets the links in a task, which
    searches from some sources at a time and keeps a sum a node; nothing as large
    as sources times nodes is shuffled or written. More links than HELD_LINKS
    are joined a level at a time (``joined_betweenness``).
    """
    links = written(both_ways(edges.select("src", "dst")).where("ref <> other").select("ref", "other").distinct())
    asked = written(sources.select(F.col("ref").alias("source")).distinct().join(links.select(F.col("ref").alias("source")).distinct(), "source", "left_semi"))
    if links.count() > HELD_LINKS:
        return joined_betweenness(links, asked)
    blocks = max(1, min(asked.count(), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    left = asked.select(F.pmod(F.xxhash64("source"), F.lit(blocks).cast("long")).alias("block"), "source")
    right = links.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "ref", "other")
    kind = links.schema["ref"].dataType.simpleString()
    found = left.repartition(blocks, "block").groupBy("block").cogroup(right.repartition(blocks, "block").groupBy("block")).applyInPandas(_block_betweenness, f"ref {kind}, score double")
    return found.groupBy("ref").agg((F.sum("score") / 2).alias("score"))


def joined_betweenness(links: DataFrame, asked: DataFrame) -> DataFrame:
    """The same by joins from links both ways (``ref, other``) and sources that have any (``source``).

    A breadth-first search from all sources at once, a join a level, counts the
    ways to each node; what lies beside a level is of the next one, itself or the
    one before. Going back, a node hands its share to those before it. The state
    is a row a source and node reached, written once each way.
    """
    front = written(asked.select("source", F.col("source").alias("ref"), F.lit(1.0).alias("ways")))
    levels = [front]
    while True:
        reached = front.join(links, "ref").groupBy("source", F.col("other").alias("ref")).agg(F.sum("ways").alias("ways"))
        seen = front.select("source", "ref") if len(levels) == 1 else front.select("source", "ref").unionByName(levels[-2].select("source", "ref"))
        front = written(reached.join(seen, ["source", "ref"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
    part = levels[-1].select("source", "ref", "ways", F.lit(0.0).alias("part"))
    sums = None
    for level in reversed(levels[:-1]):
        scored = part.select("ref", F.col("part").alias("score"))
        sums = scored if sums is None else written(sums.unionByName(scored).groupBy("ref").agg(F.sum("score").alias("score")))
        hand = part.join(links, "ref").select("source", F.col("other").alias("ref"), ((1 + F.col("part")) / F.col("ways")).alias("share"))
        got = hand.groupBy("source", "ref").agg(F.sum("share").alias("share"))
        part = written(level.join(got, ["source", "ref"], "left").select("source", "ref", "ways", (F.col("ways") * F.coalesce("share", F.lit(0.0))).alias("part")))
    if sums is None:
        return links.limit(0).select("ref", F.lit(0.0).alias("score"))
    return sums.groupBy("ref").agg((F.sum("score") / 2).alias("score")).where("score > 0")


def bridges(edges: DataFrame) -> DataFrame:
    """``cluster, a, b``: links (``cluster, a, b``; parallel ones are one) whose loss would split their cluster.

    A breadth-first tree grows from the least node of each component, a level a
    join. Every link outside the tree gets a 64-bit number; on its way up from
    the leaves, a node gathers the numbers of the links that end in its subtree
    by exclusive or, so that links with both ends there cancel out. A tree link
    is a bridge if nothing is left: no other link leaves the subtree. Different
    numbers cancel out by chance once in 2^64. No task holds a cluster; the
    rounds are as many as the tree is deep.
    """
    kinds = dict(edges.dtypes)
    once = written(edges.where("a <> b").select("cluster", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ways = written(once.select("cluster", F.col("a").alias("ref"), F.col("b").alias("other")).unionByName(once.select("cluster", F.col("b").alias("ref"), F.col("a").alias("other"))))
    names = ways.select(F.xxhash64("cluster", "ref").alias("id"), "cluster", "ref").distinct()
    part = connected_components(once.select(F.xxhash64("cluster", "a").alias("a"), F.xxhash64("cluster", "b").alias("b")))
    root = names.join(part, names["id"] == part["node"]).groupBy("component").agg(F.min(F.struct("cluster", "ref")).alias("r")).select("r.*")
    front = written(root.withColumn("parent", F.lit(None).cast(kinds["a"])))
    seen, levels = front.select("cluster", "ref"), [front]
    while True:
        reached = front.join(ways, ["cluster", "ref"]).groupBy("cluster", F.col("other").alias("ref2")).agg(F.min("ref").alias("parent")).withColumnRenamed("ref2", "ref")
        front = written(reached.join(seen, ["cluster", "ref"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = written(seen.unionByName(front.select("cluster", "ref")))
    tree = None
    for level in levels[1:]:
        rows = level.select("cluster", F.least("ref", "parent").alias("a"), F.greatest("ref", "parent").alias("b"))
        tree = rows if tree is None else tree.unionByName(rows)
    if tree is None:
        return once.limit(0)
    rest = once.join(tree, ["cluster", "a", "b"], "left_anti").withColumn("number", F.xxhash64("cluster", "a", "b"))
    ends = rest.select("cluster", F.col("a").alias("ref"), "number").unionByName(rest.select("cluster", F.col("b").alias("ref"), "number"))
    own = written(ends.groupBy("cluster", "ref").agg(F.bit_xor("number").alias("own")))
    cut, above = None, None
    for level in reversed(levels[1:]):
        held = level.join(own, ["cluster", "ref"], "left").withColumn("left", F.coalesce("own", F.lit(0).cast("long")))
        if above is not None:
            held = held.join(above, ["cluster", "ref"], "left").withColumn("left", F.col("left").bitwiseXOR(F.coalesce("below", F.lit(0).cast("long"))))
        held = written(held.select("cluster", "ref", "parent", "left"))
        found = held.where("left = 0").select("cluster", F.least("ref", "parent").alias("a"), F.greatest("ref", "parent").alias("b"))
        cut = found if cut is None else cut.unionByName(found)
        above = held.groupBy("cluster", F.col("parent").alias("ref")).agg(F.bit_xor("left").alias("below"))
    return cut


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


#: Queries and rows of a block, and queries scored at a time; similarities closer than NEAR are worked out exactly.
QUERY_BLOCK, ROW_BLOCK, AT_A_TIME, NEAR = 32_768, 65_536, 256, 1e-9


def _exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine row by row, summed in the order of ``cosine``."""
    dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for d in range(x.shape[1]):
        dot, xx, yy = dot + x[:, d] * y[:, d], xx + x[:, d] * x[:, d], yy + y[:, d] * y[:, d]
    with np.errstate(all="ignore"):
        return dot / (np.sqrt(xx) * np.sqrt(yy))


def _block_best(k: int, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Of one block of rows (``ref, vector``) each query's (``q, qv``) best ``k`` and all that are nearly as good as the last of them; those without a similarity after the others."""
    rows = rows.sort_values("ref", kind="stable")
    refs, out = rows["ref"].to_numpy(), []
    fine = lambda v: v is not None and len(v) > 0 and np.linalg.norm(np.asarray(v, dtype="float64")) > 0
    sizes, wide = (np.array([len(v) if fine(v) else 0 for v in c]) for c in (rows["vector"], asked["qv"]))
    for size in np.unique(wide):
        able = np.flatnonzero(sizes == size) if size else np.empty(0, dtype="int64")
        x = np.array([rows["vector"].iloc[i] for i in able], dtype="float64").reshape(len(able), size)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        rest = refs[np.flatnonzero(sizes != size) if size else slice(None)][: k + 1]
        part = np.flatnonzero(wide == size)
        for at in range(0, len(part), AT_A_TIME):
            some = part[at : at + AT_A_TIME]
            y, q = np.array([asked["qv"].iloc[i] for i in some if size], dtype="float64").reshape(len(some) if size else 0, size), asked["q"].to_numpy()[some]
            if len(able):
                near = (y / np.linalg.norm(y, axis=1, keepdims=True)) @ unit.T
                near[q[:, None] == refs[able][None, :]] = -2
                last = np.partition(near, len(able) - k, axis=1)[:, len(able) - k] if len(able) > k else np.full(len(some), -1.5)
                i, j = np.nonzero(near >= np.maximum(last - NEAR, -1.5)[:, None])
                out.append(pd.DataFrame({"ref": q[i], "other": refs[able][j], "similarity": _exact_cosine(x[j], y[i])}))
            if len(able) <= k and len(rest):
                pairs = np.array([(a, b) for a in q for b in rest if a != b], dtype=refs.dtype).reshape(-1, 2)
                out.append(pd.DataFrame({"ref": pairs[:, 0], "other": pairs[:, 1], "similarity": np.nan}))
    return pd.concat(out) if out else pd.DataFrame({"ref": refs[:0], "other": refs[:0], "similarity": np.empty(0)})


def most_similar(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``ref, other, similarity, rank``: the ``k`` most similar vectors (``ref, vector``) of the queries, ties to the smaller ``other``.

    Every block of rows meets every block of queries in one task, as a product of
    matrices that picks each query's best ``k`` of the block and what is nearly as
    good; their similarities are worked out exactly and ranked. Vectors that can't
    be compared have none and come last.
    """
    blocks = lambda df, size: max(1, -(-df.count() // size))
    across = blocks(queries, QUERY_BLOCK)
    down = max(blocks(vectors, ROW_BLOCK), -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // across))  # no more copies of the queries than tasks ask for
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind = vectors.schema["ref"].dataType.simpleString()
    doubles = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c).cast("array<double>"))
    left = vectors.select(F.pmod(F.xxhash64("ref"), F.lit(down)).cast("int").alias("i"), every(across).alias("j"), "ref", doubles("vector").alias("vector"))
    right = queries.select(every(down).alias("i"), F.pmod(F.xxhash64("ref"), F.lit(across)).cast("int").alias("j"), F.col("ref").alias("q"), doubles("vector").alias("qv"))
    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(lambda x, y: _block_best(k, x, y), f"ref {kind}, other {kind}, similarity double")
    order = Window.partitionBy("ref").orderBy(F.desc_nulls_last("similarity"), "other")
    ranked = best.withColumn("similarity", F.nanvl("similarity", F.lit(None).cast("double"))).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def random_walks(edges: DataFrame, length: int = 12, per_node: int = 4, seed: int = 42) -> DataFrame:
    """``walk, path``: walks from every node over ``src, dst`` in either direction, steps chosen by a seeded hash."""
    links = both_ways(edges.select("src", "dst")).where("ref <> other").select("ref", "other").distinct()
    order = Window.partitionBy("ref").orderBy("other")
    numbered = materialise(links.withColumn("i", F.row_number().over(order) - 1).join(links.groupBy("ref").agg(F.count(F.lit(1)).alias("n")), "ref"))
    walks = links.select("ref").distinct().select("ref", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("j")).select(F.concat_ws("-", "ref", "j").alias("walk"), F.col("ref").alias("at"), F.array(F.col("ref").cast("string")).alias("path"))
    sizes = materialise(numbered.select("ref", "n").distinct())
    for k in range(length - 1):
        pick = F.pmod(F.xxhash64("walk", F.lit(k), F.lit(seed)), F.col("n"))
        step = walks.join(sizes, walks["at"] == sizes["ref"]).select("walk", "path", "at", pick.alias("i"))
        walks = _every(step.join(numbered, (step["at"] == numbered["ref"]) & (step["i"] == numbered["i"])).select("walk", F.col("other").alias("at"), F.concat("path", F.array(F.col("other").cast("string"))).alias("path")), k)
    return walks.select("walk", "path")

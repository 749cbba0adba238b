"""Which pairs of subjects to look at, and how strongly eight dimensions link them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.operators import correlation as c
from sleuthframe.operators import geo
from sleuthframe.plans.lineage import written

# Where pairs come from. The first five are keys that two subjects share, the others are pairs as such.
KEYED = ("shared_counterparty", "co_attendance", "communication_shared", "affiliation", "shared_corridor")
SOURCES = (*KEYED, "communication_direct", "funds_path")
#: Trigger and full strength of the dimensions.
RAMPS = {"shared_counterparty": (3.0, 8.0), "co_attendance": (0.60, 2.00), "communication_shared": (0.70, 2.20), "affiliation": (0.40, 1.60), "proximity": (25.0, 2.0), "coincidence": (1.8, 2.6)}
#: Direct contacts that are full strength, and what an identifying family must reach to count.
CONTACTS, FLOOR = 3, 0.25
#: Added before rounding and comparing, so that halves and borders don't hang on the order of a sum.
TIE = 1e-9
DIMENSIONS = tuple(c.DIMENSIONS)


def key_sizes(owned: DataFrame, population: int) -> DataFrame:
    """``source, key, n, weight``: subjects of each key (``source, subject, key``, each once) and its rarity."""
    sizes = owned.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("weight", c.rarity(F.col("n"), F.lit(float(population))))


def shared_keys(owned: DataFrame, sizes: DataFrame, fan_out: int = c.FAN_OUT) -> DataFrame:
    """``a < b, source, shared, observed``: keys of at most ``fan_out`` subjects that both have, and their summed rarity.

    No key gives more than its subjects times ``fan_out`` pairs, so rows grow with
    ``owned``, whatever a hub is shared by.
    """
    pairs = proposed_by_keys(sizes, fan_out)
    met = c.dealt(few_lists(owned, sizes, fan_out).select("source", "weight", "a", "others"), pairs)
    return met.groupBy("a", "b", "source").agg(F.count(F.lit(1)).alias("shared"), F.sum("weight").alias("observed"))


def within(sizes: DataFrame, fan_out: int | None) -> DataFrame:
    """Keys of at most ``fan_out`` subjects; all of them if it is None."""
    return sizes if fan_out is None else sizes.where(F.col("n") <= fan_out)


def proposed_by_keys(sizes: DataFrame, fan_out: int | None) -> int:
    """How many pairs keys of at most ``fan_out`` subjects give, a pair once a key."""
    return int(within(sizes, fan_out).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0)


def few_lists(owned: DataFrame, sizes: DataFrame, fan_out: int | None) -> DataFrame:
    """``source, key, weight, a, others`` of keys of at most ``fan_out`` subjects (None: of all keys): a row a subject and key with the greater ones, not one a pair; several of a large key."""
    few = owned.select("source", "subject", "key")
    return c.met_lists(few, within(sizes, fan_out).select("source", "key", "n", "weight"), "source", "key", "weight", by=("source", "key"))


def proposed_pairs(owned: DataFrame, sizes: DataFrame, direct: dict[str, DataFrame], fan_out: int | None = c.FAN_OUT) -> DataFrame:
    """What ``candidate_pairs`` gives for ``shared_keys``, summed up once and where the pairs are made; without ``fan_out`` for keys of any size."""
    bits = F.create_map(*[F.lit(x) for i, name in enumerate(KEYED) for x in (name, 1 << i)])
    rows = few_lists(owned, sizes, fan_out).select("a", bits[F.col("source")].alias("bit"), "others")
    for name, pairs in direct.items():
        rows = rows.unionByName(pairs.select("a", F.lit(1 << SOURCES.index(name)).alias("bit"), F.array("b").alias("others")))
    return c.dealt(rows, proposed_by_keys(sizes, fan_out)).groupBy("a", "b").agg(F.bit_or("bit").cast("int").alias("sources"))


def candidate_pairs(shared: DataFrame, direct: dict[str, DataFrame]) -> DataFrame:
    """``a, b, sources``: pairs that any source proposes, with a bit for each that does (bit i: SOURCES[i])."""
    bits = F.create_map(*[F.lit(x) for i, name in enumerate(KEYED) for x in (name, 1 << i)])
    rows = shared.select("a", "b", bits[F.col("source")].alias("bit"))
    for name, pairs in direct.items():
        rows = rows.unionByName(pairs.select("a", "b", F.lit(1 << SOURCES.index(name)).alias("bit")))
    return rows.groupBy("a", "b").agg(F.bit_or("bit").cast("int").alias("sources"))


def candidate_report(sizes: DataFrame, direct: dict[str, DataFrame], fan_out: int = c.FAN_OUT, most: int = 10) -> DataFrame:
    """What was and wasn't looked at: ``source, keys, skipped, proposed, not_proposed, examples``.

    ``skipped`` are keys of more than ``fan_out`` subjects, whose ``not_proposed``
    pairs are only counted: a key is one row with its size, its members are those
    of ``owned``. ``examples`` are the largest ``most`` of them, ties by key.
    """
    large, pairs = F.col("n") > fan_out, F.col("n") * (F.col("n") - 1) / 2
    order = F.struct((-F.col("n")).alias("size"), F.col("key"))
    sums = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("keys"), F.count(F.when(large, 1)).alias("skipped"), F.sum(F.when(large, 0).otherwise(pairs)).cast("long").alias("proposed"), F.sum(F.when(large, pairs).otherwise(0)).cast("long").alias("not_proposed"),
    )
    ranked = sizes.where(large).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "key"))).where(F.col("place") <= most)
    told = ranked.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.concat(x["key"], F.lit(" ("), (-x["size"]).cast("string"), F.lit(" subjects)"))).alias("examples"))
    out = sums.join(told, "source", "left").select("source", "keys", "skipped", "proposed", "not_proposed", F.array_join("examples", "; ").alias("examples"))
    for name, found in direct.items():
        out = out.unionByName(found.agg(F.lit(name).alias("source"), F.lit(0).cast("long").alias("keys"), F.lit(0).cast("long").alias("skipped"), F.count(F.lit(1)).alias("proposed"), F.lit(0).cast("long").alias("not_proposed"), F.lit(None).cast("string").alias("examples")))
    return out


def with_large_keys(pairs: DataFrame, shared: DataFrame, owned: DataFrame, sizes: DataFrame, fan_out: int = c.FAN_OUT) -> DataFrame:
    """``shared`` with what the candidate pairs share in keys over ``fan_out`` too, found from the pairs and not from the keys."""
    many = owned.join(sizes.where((F.col("n") > fan_out) & (F.col("weight") > 0)).select("source", "key", "weight"), ["source", "key"])
    left, right = many.select(F.col("subject").alias("a"), "source", "key", "weight"), many.select(F.col("subject").alias("b"), "source", "key")
    more = pairs.select("a", "b").join(left, "a").join(right, ["b", "source", "key"]).groupBy("a", "b", "source").agg(F.count(F.lit(1)).alias("shared"), F.sum("weight").alias("observed"))
    return shared.unionByName(more).groupBy("a", "b", "source").agg(F.sum("shared").alias("shared"), F.sum("observed").alias("observed"))


def identifying(shared: DataFrame, owned: DataFrame, sizes: DataFrame, direct: DataFrame, paths: DataFrame) -> DataFrame:
    """``a, b, dimension, raw``, more than 0, of the dimensions that say who somebody deals with.

    Counterparties count by lift over what chance would share; events, and
    organisations by summed rarity; a corridor by its own rarity; contact by its
    number, and only without any by rare correspondents in common. ``direct`` has
    ``a, b, n``, ``paths`` has ``a, b, raw``.
    """
    told = lambda rows, name, raw: rows.select("a", "b", F.lit(name).alias("dimension"), raw.alias("raw")).where("raw > 0")
    of = lambda name: shared.where(F.col("source") == name)
    slope = lambda value, name: c.slope(F.col(value), *RAMPS[name])
    deals = owned.where(F.col("source") == "shared_counterparty").groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.where(F.col("source") == "shared_counterparty").agg(F.count(F.lit(1)).alias("d"), F.avg("weight").alias("mean"))
    lifted = of("shared_counterparty").join(deals.toDF("a", "n_a"), "a").join(deals.toDF("b", "n_b"), "b").join(F.broadcast(whole))  # one row
    lifted = lifted.withColumn("lift", F.try_divide(F.col("observed"), F.col("n_a") * F.col("n_b") / F.col("d") * F.col("mean")))
    apart = of("communication_shared").join(direct.select("a", "b"), ["a", "b"], "left_anti")
    parts = [
        told(lifted, "shared_counterparty", slope("lift", "shared_counterparty")), told(of("co_attendance"), "co_attendance", slope("observed", "co_attendance")),
        told(of("affiliation"), "affiliation", slope("observed", "affiliation")), told(of("shared_corridor"), "shared_corridor", F.col("observed")),
        told(direct, "communication", F.least(F.lit(1.0), F.col("n") / CONTACTS)), told(apart, "communication", slope("observed", "communication_shared")), told(paths, "funds_path", F.col("raw")),
    ]
    return reduce(DataFrame.unionByName, parts)


def able_subjects(evaluable: dict[str, DataFrame], truncated: DataFrame | None = None) -> DataFrame:
    """``subject, able, cut``: a bit for each dimension that a subject has anything to be judged by, and whether its search was cut short."""
    rows = reduce(DataFrame.unionByName, [rows.select("subject", F.lit(1 << DIMENSIONS.index(name)).alias("bit")) for name, rows in evaluable.items()])
    able = rows.groupBy("subject").agg(F.bit_or("bit").cast("int").alias("able"))
    if truncated is None:
        return able.withColumn("cut", F.lit(False))
    return able.join(truncated.select("subject", F.lit(True).alias("cut")).distinct(), "subject", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))


def unlisted(owned: DataFrame, sizes: DataFrame, backed: DataFrame, fan_out: int = c.FAN_OUT, least: float = 0.30) -> DataFrame:
    """``source, subject, key``: what of keys over ``fan_out`` may make a link of two subjects that nothing else proposes.

    Two such subjects have nothing else in common, so neither dimension is more than
    one's own large keys give if the other has them all; only counterparties, which
    count by lift, have no such bound. A source proposes where that reaches FLOOR, a
    subject if with what else could support it (``backed``: ``subject, located, active``)
    its strength could be ``least``. No other pair of large keys can be a link.
    """
    top = lambda name: F.max(F.when(F.col("source") == name, F.col("bound")))
    large = sizes.where((F.col("n") > fan_out) & (F.col("weight") > 0)).select("source", "key", "weight")
    many = owned.join(large, ["source", "key"])
    bound = F.when(F.col("source") == "shared_counterparty", 1.0)
    for name in ("co_attendance", "communication_shared", "affiliation"):
        bound = bound.when(F.col("source") == name, ramp(F.col("u") + TIE, name))
    most = many.groupBy("subject", "source").agg(F.sum("weight").alias("u")).withColumn("bound", bound.otherwise(F.col("u") + TIE))
    of = {family: [name for name in KEYED if c.DIMENSIONS.get(name.replace("communication_shared", "communication")) == family] for family in c.IDENTIFYING}
    sums = most.groupBy("subject").agg(*[F.greatest(F.lit(0.0), *[top(name) for name in names]).alias(family) for family, names in of.items()])
    sums = sums.join(backed, "subject", "left").withColumns({"spatial": F.coalesce("located", F.lit(False)).cast("double"), "temporal": F.coalesce("active", F.lit(False)).cast("double")})
    could = reduce(lambda x, y: x * y, [1 - F.least(F.lit(1.0), F.col(family) * c.CEILINGS[family]) for family in (*of, "spatial", "temporal")])
    able = sums.where(1 - could >= least - 1e-3).select("subject")  # parts are rounded to four digits
    return many.join(most.where(F.col("bound") >= FLOOR).select("subject", "source"), ["subject", "source"], "left_semi").join(able, "subject", "left_semi").select("source", "subject", "key")


def pair_sums(owned: DataFrame, sizes: DataFrame, direct: DataFrame, paths: DataFrame, fan_out: int, more: DataFrame | None = None) -> DataFrame:
    """``a, b``, a column a source of KEYED with the summed rarity of keys of at most ``fan_out`` subjects, ``contacts`` and ``path``: a row a pair that anything proposes.

    Pairs are made and summed up where ``a`` is. ``more`` (``source, subject, key``) proposes pairs of its own, without a sum.
    """
    names = (*KEYED, "contacts", "path")
    codes = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])
    rows, pairs = few_lists(owned, sizes, fan_out).select("a", codes[F.col("source")].alias("code"), F.col("weight").alias("v"), "others"), proposed_by_keys(sizes, fan_out)
    for name, found, value in (("contacts", direct, "n"), ("path", paths, "raw")):
        rows = rows.unionByName(found.select("a", F.lit(names.index(name)).alias("code"), F.col(value).cast("double").alias("v"), F.array("b").alias("others")))
    if more is not None:
        extent = more.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("weight"))
        rows = rows.unionByName(few_lists(more, extent, None).select("a", F.lit(-1).alias("code"), F.col("weight").alias("v"), "others"))
        pairs += proposed_by_keys(extent, None)
    return c.dealt(rows, pairs).groupBy("a", "b").agg(*[F.sum(F.when(F.col("code") == i, F.col("v"))).alias(name) for i, name in enumerate(names)])


def subject_traits(owned: DataFrame, sizes: DataFrame, able: DataFrame, backed: DataFrame, fan_out: int) -> tuple[DataFrame, list[str], list[str]]:
    """A row a subject with all that its pairs are judged by; and the sources of whose keys over ``fan_out`` it has one at most (``<source>_key, <source>_weight``), or several (``<source>_large``)."""
    deals = owned.where(F.col("source") == "shared_counterparty").groupBy("subject").agg(F.count(F.lit(1)).alias("deals"))
    out = able.join(deals, "subject", "full_outer").join(backed, "subject", "full_outer")
    large = sizes.where((F.col("n") > fan_out) & (F.col("weight") > 0)).withColumn("id", F.monotonically_increasing_id())
    many = written(owned.join(written(large.select("source", "key", "id", "weight")), ["source", "key"]).select("source", "subject", "id", "weight"))
    most = {r["source"]: r["most"] for r in many.groupBy("source", "subject").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("most")).collect()}  # a row a source
    for name, n in most.items():
        rows = many.where(F.col("source") == name)
        if n == 1:
            rows = rows.select("subject", F.col("id").alias(f"{name}_key"), F.col("weight").alias(f"{name}_weight"))
        else:
            rows = rows.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("id", "weight"))).alias(f"{name}_large"))
        out = out.join(rows, "subject", "full_outer")
    return written(out), [k for k, n in most.items() if n == 1], [k for k, n in most.items() if n > 1]


def ramp(value: Column, name: str) -> Column:
    """``correlation.slope`` that has its value once, as long expressions many times over aren't compiled; 0 of null."""
    trigger, full = RAMPS[name]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (trigger - value) / (trigger - full)))


def rounded(value: Column) -> Column:
    """To four digits, as ``round`` after ``TIE``, which goes by decimal digits and takes longer than all the rest."""
    return F.floor((value + TIE) * 10_000 + 0.5) / 10_000


def judged_pairs(sums: DataFrame, traits: DataFrame, single: list[str], several: list[str], whole: tuple[int, float | None]) -> DataFrame:
    """``a, b`` with the raw strength of each identifying dimension (0 without any), nearness, and what both can be judged by; pairs of which an identifying one reaches FLOOR.

    Counterparties count by lift over what chance would share (``whole``: number of
    keys and their mean rarity); events, and organisations by summed rarity; a
    corridor by its own rarity; contact by its number, and only without any by rare
    correspondents in common. Keys too large to propose count too, from either's own.
    """
    side = lambda s: traits.select(F.col("subject").alias(s), *[F.col(x).alias(f"{x}_{s}") for x in traits.columns if x != "subject"])
    rows = sums.join(side("a"), "a", "left").join(side("b"), "b", "left")
    for name in single:
        met = F.when(F.col(f"{name}_key_a") == F.col(f"{name}_key_b"), F.col(f"{name}_weight_a"))
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), met).otherwise(F.col(name) + F.coalesce(met, F.lit(0.0))))
    for name in several:
        met = F.aggregate(F.array_intersect(f"{name}_large_a", f"{name}_large_b"), F.lit(0.0), lambda v, x: v + x["weight"])
        rows = rows.withColumn(name, F.when(met > 0, F.coalesce(name, F.lit(0.0)) + met).otherwise(F.col(name)))
    keys, mean = whole
    lift = F.try_divide(F.col("shared_counterparty"), F.col("deals_a") * F.col("deals_b") / F.lit(keys) * F.lit(mean).cast("double"))
    km = F.when(F.col("lat_a").isNotNull() & F.col("lat_b").isNotNull(), geo.haversine_km(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b")))
    raws = {
        "shared_counterparty": ramp(lift, "shared_counterparty"), "funds_path": F.col("path"), "co_attendance": ramp(F.col("co_attendance"), "co_attendance"),
        "communication": F.when(F.col("contacts").isNotNull(), F.least(F.lit(1.0), F.col("contacts") / CONTACTS)).otherwise(ramp(F.col("communication_shared"), "communication_shared")),
        "affiliation": ramp(F.col("affiliation"), "affiliation"), "shared_corridor": F.col("shared_corridor"),
    }
    known = rows.select(
        "a", "b", *[F.greatest(F.lit(0.0), raw).alias(f"raw_{name}") for name, raw in raws.items()], ramp(km, "proximity").alias("raw_proximity"),
        F.coalesce("able_a", F.lit(0)).bitwiseAND(F.coalesce("able_b", F.lit(0))).alias("able"), (F.coalesce("cut_a", F.lit(False)) | F.coalesce("cut_b", F.lit(False))).alias("cut"),
        (F.coalesce("active_a", F.lit(False)) & F.coalesce("active_b", F.lit(False))).alias("active"),
    )
    return known.where(F.greatest(*[F.col(f"raw_{name}") for name in raws]) >= FLOOR)


def score_links(pairs: DataFrame) -> DataFrame:
    """``a, b, strength, tier, coverage, evaluable, families, supporting`` of pairs with enough identifying evidence.

    ``pairs`` are those of ``judged_pairs`` with ``raw_coincidence``. The best
    dimension of each family counts, up to the family's ceiling; the strength is the
    noisy-or of that. ``evaluable`` are the dimensions that both subjects can be judged
    by; a path that wasn't found by a search cut short is none of them. ``families``
    are identifying ones that reach FLOOR; without any there is no link, and fewer than
    two, or less than half of the dimensions evaluable, are not ``established``.
    ``supporting`` are other families that reach it.
    """
    best = {family: F.greatest(F.lit(0.0), *[F.col(f"raw_{name}") for name, of in c.DIMENSIONS.items() if of == family]) for family in c.CEILINGS}
    rows = pairs.withColumns({f"best_{family}": raw for family, raw in best.items()})
    part = lambda family: rounded(F.col(f"best_{family}") * c.CEILINGS[family])
    missed = reduce(lambda x, y: x * y, [1 - F.least(F.lit(1.0), part(family)) for family in c.CEILINGS])
    rows = rows.withColumn("strength", 1 - missed).where(F.col("strength") + TIE >= 0.30)
    unknown = F.when((F.col("raw_funds_path") <= 0) & F.col("cut"), 1 << DIMENSIONS.index("funds_path")).otherwise(0)
    rows = rows.withColumn("evaluable", F.bit_count(F.col("able").bitwiseAND(F.bitwise_not(unknown)))).withColumn("coverage", F.col("evaluable") / len(DIMENSIONS))  # eighths
    (families, n), (others, _) = named_families(c.IDENTIFYING), named_families([x for x in c.CEILINGS if x not in c.IDENTIFYING])
    tier = F.when((F.col("strength") + TIE >= 0.60) & (n >= 2) & (F.col("coverage") >= 0.5), "established").when(F.col("strength") + TIE >= 0.45, "probable").otherwise("possible")
    return rows.select("a", "b", rounded(F.col("strength")).alias("strength"), tier.alias("tier"), "coverage", "evaluable", families.alias("families"), others.alias("supporting"))


def named_families(of: Iterable[str]) -> tuple[Column, Column]:
    """The names, sorted, of those families that reach FLOOR, and how many they are."""
    of = sorted(of)
    reached = [(F.col(f"best_{family}") >= FLOOR).cast("int") for family in of]
    sets = F.array(*[F.array(*[F.lit(x) for i, x in enumerate(of) if bits >> i & 1]).cast("array<string>") for bits in range(1 << len(of))])
    return F.element_at(sets, reduce(lambda x, y: x + y, [r * (1 << i) for i, r in enumerate(reached)]) + 1), reduce(lambda x, y: x + y, reached)


def link_subjects(owned: DataFrame, population: int, direct: DataFrame, paths: DataFrame, places: DataFrame, activity: DataFrame, able: DataFrame, same: DataFrame | None = None, fan_out: int = c.FAN_OUT, every: bool = False) -> DataFrame:
    """All of it: candidates from seven sources, the identifying dimensions of all of them, the others of those that may be links, scored.

    Keys over ``fan_out`` propose no pairs; with ``every`` they do, all that can be a
    link. Pairs of ``same`` (one thing seen twice) are no links.
    """
    sizes = written(key_sizes(owned, population))
    middle = geo.centroids(places, "subject").where("n_located >= 2").select("subject", "lat", "lng", F.lit(True).alias("located"))
    often = activity.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("subject", F.lit(True).alias("active"))
    backed = written(middle.join(often, "subject", "full_outer"))
    more = written(unlisted(owned, sizes, backed, fan_out)) if every else None
    traits, single, several = subject_traits(owned, sizes, able, backed.drop("located"), fan_out)
    whole = sizes.where(F.col("source") == "shared_counterparty").agg(F.count(F.lit(1)), F.avg("weight")).first()
    sums = pair_sums(owned, sizes, direct, paths, fan_out, more)
    if same is not None:
        sums = sums.join(same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    strong = written(judged_pairs(sums, traits, single, several, whole))
    asked = strong.where("active")
    timed = c.coincidences(activity, asked).select("a", "b", ramp(F.col("lift"), "coincidence").alias("raw_coincidence"))
    return score_links(strong.where("not active").withColumn("raw_coincidence", F.lit(0.0)).unionByName(asked.join(timed, ["a", "b"], "left")))

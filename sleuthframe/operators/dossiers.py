"""Read models of analysts' work: an investigation with all that hangs off it, its history, and what else touches a subject."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The lists of an investigation, with the events that an item's beginning and end write to the history (None: it doesn't end).
LISTS = {
    "alerts": ("alert_attached", "alert_detached"), "entities": ("entity_linked", "entity_unlinked"), "findings": ("finding_recorded", "finding_withdrawn"), "actions": ("action_recorded", "action_completed"),
    "assessments": ("assessment_recorded", "assessment_withdrawn"), "reviews": ("reviewed", None),
}


def items(**lists: DataFrame) -> DataFrame:
    """The named lists (``investigation, item, at, ended_at, note``) under each other, with ``list``. An unknown name is a ValueError."""
    if unknown := sorted(set(lists) - set(LISTS)):
        raise ValueError(f"no list of an investigation: {', '.join(unknown)}")
    part = lambda name, rows: rows.select("investigation", F.lit(name).alias("list"), F.col("item").cast("string").alias("item"), F.col("at").cast("timestamp_ntz").alias("at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), F.col("note").cast("string").alias("note"))
    return reduce(DataFrame.unionByName, [part(name, rows) for name, rows in lists.items()])


def dossiers(heads: DataFrame, rows: DataFrame, most: int = 100) -> DataFrame:
    """``heads`` (``investigation``) with its lists as arrays of ``item, at, ended_at, note``, oldest first, ended ones too.

    Beside each list are ``n_<list>``, its true length, and ``n_<list>_standing``,
    those that haven't ended; ``truncated`` says whether any list is longer than
    the ``most`` that are shown. An investigation without items has empty lists.
    The first ``most`` are picked before rows are shuffled, so that one with a
    third of all items costs ``most`` rows a task. Items at equal times are in
    order of their names; rows of no head are left out.
    """
    entry = "struct<item: string, at: timestamp_ntz, ended_at: timestamp_ntz, note: string>"
    order = [F.asc_nulls_last("at"), F.asc("item"), F.asc("ended_at"), F.asc("note")]
    first = rows.withColumn("_place", F.row_number().over(Window.partitionBy("investigation", "list").orderBy(*order))).where(F.col("_place") <= most)
    shown = first.groupBy("investigation").agg(*[F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("_place", "item", "at", "ended_at", "note")))).alias(name) for name in LISTS])
    of = lambda name, also=F.lit(True): F.count_if((F.col("list") == name) & also)
    counts = rows.groupBy("investigation").agg(*[of(name).alias(f"n_{name}") for name in LISTS], *[of(name, F.col("ended_at").isNull()).alias(f"n_{name}_standing") for name in LISTS])
    joined = heads.join(counts, "investigation", "left").join(shown, "investigation", "left")
    lists = {name: F.coalesce(F.transform(name, lambda x: F.struct(x["item"].alias("item"), x["at"].alias("at"), x["ended_at"].alias("ended_at"), x["note"].alias("note"))), F.array().cast(f"array<{entry}>")) for name in LISTS}
    numbers = [f"n_{name}{end}" for name in LISTS for end in ("", "_standing")]
    out = joined.withColumns({**lists, **{n: F.coalesce(n, F.lit(0)) for n in numbers}})
    return out.withColumn("truncated", F.greatest(*[F.col(f"n_{name}") for name in LISTS]) > most)


def history(rows: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """``investigation, at, event, field, old_value, new_value, note``: what the items' beginnings and ends and the changes of fields write.

    ``changes`` are ``field_changes``. Read an investigation's own in order of
    ``at``; an item that has ended has written two events.
    """
    begun = F.create_map(*[F.lit(x) for name, (event, _) in LISTS.items() for x in (name, event)])
    ended = F.create_map(*[F.lit(x) for name, (_, event) in LISTS.items() if event for x in (name, event)])
    none = F.lit(None).cast("string")
    both = F.array(F.struct(F.col("at").alias("at"), begun[F.col("list")].alias("event")), F.struct(F.col("ended_at").alias("at"), ended[F.col("list")].alias("event")))
    told = rows.select("investigation", "item", "note", F.explode(both).alias("e")).where("e.at is not null and e.event is not null")
    note = F.concat_ws(": ", "item", F.nullif(F.trim("note"), F.lit("")))
    out = told.select("investigation", "e.at", "e.event", none.alias("field"), none.alias("old_value"), none.alias("new_value"), note.alias("note"))
    if changes is None:
        return out
    return out.unionByName(changes.select("investigation", F.col("at").cast("timestamp_ntz").alias("at"), F.lit("field_changed").alias("event"), "field", "old_value", "new_value", none.alias("note")))


def field_changes(versions: DataFrame, fields: list[str], tie: str = "id") -> DataFrame:
    """``investigation, at, field, old_value, new_value`` of all fields that a version (``investigation, at``, ties by ``tie``) has changed against the one before.

    The first version changes nothing. Null counts as a value: an assignee taken
    away is a change. Values are written as text.
    """
    order = Window.partitionBy("investigation").orderBy("at", tie)
    now = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    seen = versions.select("investigation", "at", now.alias("_now"), F.lag(now).over(order).alias("_was")).where("_was is not null")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_was.{f}").alias("old_value"), F.col(f"_now.{f}").alias("new_value")) for f in fields])
    return seen.select("investigation", "at", F.explode(pairs).alias("c")).select("investigation", "at", "c.*").where("not (old_value <=> new_value)")


def closures(transitions: DataFrame) -> DataFrame:
    """``investigation, state, outcome, closed_at``: how each stands after its moves (``investigation, at, id, to_state, outcome``).

    Only a closed one has an outcome and a time of closing; one that was opened
    again has neither, whatever it was closed with before.
    """
    last = transitions.groupBy("investigation").agg(F.max_by(F.struct("to_state", "outcome", "at"), F.struct("at", "id")).alias("r"))
    closed = F.col("r.to_state") == "closed"
    return last.select("investigation", F.col("r.to_state").alias("state"), F.when(closed, F.col("r.outcome")).alias("outcome"), F.when(closed, F.col("r.at")).alias("closed_at"))


def related_cases(subjects: DataFrame, linked: DataFrame, cases: DataFrame) -> DataFrame:
    """``subject, case_id, opened_at``: all cases that a subject is linked to (``case_id, subject, removed``) and hasn't been taken off, each once."""
    standing = linked.where(~F.coalesce("removed", F.lit(False))).select("subject", "case_id").join(subjects.select("subject").distinct(), "subject", "left_semi").distinct()
    return standing.join(cases.select("case_id", "opened_at"), "case_id").select("subject", "case_id", "opened_at")


def newest_of(subjects: DataFrame, rows: DataFrame, item: str, most: int = 20) -> DataFrame:
    """``subject, <item>, at, place, total``: a subject's newest rows (``subject, <item>, at``), ``most`` at most, and how many there are; equal times by the item."""
    mine = rows.join(subjects.select("subject").distinct(), "subject", "left_semi").select("subject", item, "at")
    ranked = mine.withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc_nulls_last("at"), item))).where(F.col("place") <= most)
    return ranked.join(mine.groupBy("subject").agg(F.count(F.lit(1)).alias("total")), "subject")


def links_of(subjects: DataFrame, links: DataFrame, evidence: DataFrame, most: int = 50) -> DataFrame:
    """A subject's links, the strongest first: ``subject, other, strength, tier, place, total, dimensions``.

    ``links`` has ``a, b, strength, tier`` and is read from both ends. ``evidence``
    (``a, b, dimension, raw``) of a link is an array of ``dimension, raw``, the
    strongest first, at most one a dimension. ``total`` is how many links there are
    beside the ``most`` that are shown.
    """
    by_link = evidence.groupBy("a", "b", "dimension").agg(F.max("raw").alias("raw")).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct((-F.col("raw")).alias("r"), "dimension"))).alias("_d"))
    told = links.join(by_link, ["a", "b"], "left").withColumn("dimensions", F.transform(F.coalesce("_d", F.array().cast(by_link.schema["_d"].dataType)), lambda x: F.struct(x["dimension"].alias("dimension"), (-x["r"]).alias("raw"))))
    ends = F.explode(F.array(F.struct(F.col("a").alias("subject"), F.col("b").alias("other")), F.struct(F.col("b").alias("subject"), F.col("a").alias("other"))))
    wanted = subjects.select("subject").distinct()
    keys = links.select("a", "b", "strength", "tier", ends.alias("e")).select("e.*", "a", "b", "strength", "tier").join(wanted, "subject", "left_semi")
    ranked = keys.withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("strength"), "other"))).where(F.col("place") <= most)
    counted = ranked.join(keys.groupBy("subject").agg(F.count(F.lit(1)).alias("total")), "subject")
    return counted.join(told.select("a", "b", "dimensions"), ["a", "b"]).select("subject", "other", "strength", "tier", "place", "total", "dimensions")


def standing_items(rows: DataFrame, until: Column) -> DataFrame:
    """The items that hung off investigations at a time: begun by then and not ended yet."""
    return rows.where((F.col("at") <= until) & (F.col("ended_at").isNull() | (F.col("ended_at") > until)))

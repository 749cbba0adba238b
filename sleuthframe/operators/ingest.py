"""Ingestion and provenance: idempotent landing, mapping with dead letters, drift, belief as of a time."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sleuthframe.operators.rollups import volume_baseline

# What makes a batch suspicious, a volume odd, and the queue's delays in seconds.
QUARANTINE_FROM, QUARANTINE_SHARE, LEAST_SAMPLES, ODD_Z = 20, 0.5, 5, 3.0
FIRST_DELAY, MOST_DELAY, RELEASE_DELAY, MOST_ATTEMPTS = 5, 900, 30, 5
#: Depth to which nested keys are listed.
DEPTH = 6
#: An epoch of at least this size is in milliseconds.
MILLIS_FROM = 1e11
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "MM/dd/yyyy", "yyyyMMdd")


def canonical(text: str) -> str:
    """A JSON text with sorted keys and no spaces; anything else as it is."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), default=str)
    except ValueError:
        return text


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def content_hash(payload: Column) -> Column:
    """Equal for equal records, whatever the order of their keys."""
    return F.sha2(_canonical(payload), 256)


def paths_of(text: str | None) -> list[str]:
    """All dotted paths of keys in a JSON object, DEPTH deep; lists are leaves."""
    try:
        top = json.loads(text or "null")
    except ValueError:
        return []
    found, todo = set(), [("", top, 0)]
    while todo:
        prefix, value, depth = todo.pop()
        if isinstance(value, dict) and depth < DEPTH:
            for key, inner in value.items():
                found.add(prefix + key)
                todo.append((f"{prefix}{key}.", inner, depth + 1))
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.StringType()))
def field_paths(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: paths_of(t if isinstance(t, str) else None))


def lenient_time(text: Column) -> Column:
    """ISO times; null for what isn't one."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).cast("timestamp_ntz")


def any_time(text: Column, zone: str | None = None) -> Column:
    """Epochs in seconds or milliseconds, ISO times, FORMATS in order: as UTC struct(at, reason).

    A time that names no zone is read in ``zone``; without one it is null, and ``reason`` says so.
    """
    number = F.when(text.rlike(r"^\s*-?\d{9,}(\.\d+)?\s*$"), text.try_cast("double"))
    epoch = F.timestamp_micros((F.when(F.abs(number) >= MILLIS_FROM, number / 1000).otherwise(number) * 1_000_000).cast("bigint")).cast("timestamp_ntz")
    aware = text.rlike(r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    iso = F.when(aware, F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).cast("timestamp_ntz"))
    local = F.coalesce(F.try_to_timestamp(text).cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in FORMATS])
    placed = F.to_utc_timestamp(local.cast("timestamp"), zone).cast("timestamp_ntz") if zone else F.lit(None).cast("timestamp_ntz")
    at = F.coalesce(epoch, iso, placed)
    reason = F.when(at.isNotNull(), None).when(text.isNull() | (F.trim(text) == ""), "no time").when(local.isNotNull(), "no time zone").otherwise("not a time")
    return F.struct(at.alias("at"), reason.alias("reason"))


def landed(feed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """New raw records (``connector, payload``): one for each connector and content, none that has landed before (``connector, hash``)."""
    fresh = feed.withColumn("hash", content_hash(F.col("payload"))).dropDuplicates(["connector", "hash"])
    return fresh if before is None else fresh.join(before.select("connector", "hash"), ["connector", "hash"], "left_anti")


@dataclass
class Mapping:
    """Where a record's fields are: JSON paths, which must be there, prefix to type, and attributes to match by."""

    subject: str
    time: str
    kind: str | None = None
    required: tuple[str, ...] = ()
    prefixes: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)
    zone: str | None = None


def mapped(raw: DataFrame, mapping: Mapping) -> DataFrame:
    """``raw`` with ``subject, subject_type, occurred_at, attributes, stage, reason``; stage is ok, or where the record failed.

    All missing required fields are named at once. Attributes drop nulls and empty values.
    """
    get = lambda path: F.nullif(F.trim(F.get_json_object("payload", f"$.{path}")), F.lit(""))
    missing = F.array_compact(F.array(*[F.when(get(p).isNull(), F.lit(p)) for p in (*mapping.required, mapping.subject)])).cast("array<string>")
    when = any_time(get(mapping.time), mapping.zone)
    subject = get(mapping.subject)
    kind = F.coalesce(*[F.when(F.startswith(subject, F.lit(p)), t) for p, t in mapping.prefixes.items()], F.lit("unknown"))
    pairs = [F.struct(F.lit(k).alias("k"), get(p).alias("v")) for k, p in mapping.attributes.items()]
    attributes = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"].isNotNull() & ~e["v"].isin("[]", "{}"))) if pairs else F.create_map().cast("map<string,string>")
    parsed = F.try_parse_json("payload")
    reason = F.when(parsed.isNull(), "not a JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(missing), ", "))).otherwise(when["reason"])
    out = raw.withColumns({"subject": subject, "subject_type": kind, "occurred_at": when["at"], "attributes": attributes, "reason": reason})
    return out.withColumn("stage", F.when(F.col("reason").isNull(), "ok").otherwise("validate"))


def resolved(records: DataFrame, known: DataFrame) -> DataFrame:
    """Mapped records held against the known subjects (``subject``): those without one fail at stage ``resolve``."""
    hit = known.select("subject").distinct().withColumn("_known", F.lit(True))
    joined = records.join(hit, "subject", "left")
    lost = (F.col("stage") == "ok") & F.col("_known").isNull()
    return joined.withColumn("reason", F.when(lost, F.concat(F.lit("unknown subject "), F.coalesce("subject", F.lit("")))).otherwise(F.col("reason"))).withColumn("stage", F.when(lost, "resolve").otherwise(F.col("stage"))).drop("_known")


def replayed(letters: DataFrame, raw: DataFrame, mapping: Mapping, observed: DataFrame) -> DataFrame:
    """Dead letters after another run of their stored records through a corrected mapping.

    ``letters`` has ``letter, connector, raw_id, status, replay_count``, ``raw``
    ``raw_id, payload``, ``observed`` the ``connector, hash`` of the observations
    there are. Gives ``letter, connector, status, replay_count, subject,
    occurred_at, hash, created, error``. What maps now is ``resolved``, and
    ``created`` says whether it makes an observation: of letters with one content
    the least makes it, unless it is there already. What fails again keeps its
    status and says why. A letter without a stored record (it failed when it was
    fetched) can't be replayed, and a resolved one isn't: neither counts as a try.
    """
    stored = letters.join(raw.select("raw_id", "payload").dropDuplicates(["raw_id"]), "raw_id", "left")
    tried = (F.col("status") != "resolved") & F.col("payload").isNotNull()
    again = mapped(stored, mapping).withColumn("_tried", tried).withColumn("_ok", tried & (F.col("stage") == "ok")).withColumn("hash", F.when(F.col("_ok"), content_hash(F.col("payload"))))
    makers = again.where("_ok").groupBy("connector", "hash").agg(F.min("letter").alias("letter")).join(observed.select("connector", "hash"), ["connector", "hash"], "left_anti")
    joined = again.join(makers.select("letter", F.lit(True).alias("_makes")), "letter", "left")
    error = F.when(F.col("status") == "resolved", None).when(F.col("payload").isNull(), "no stored record").when(~F.col("_ok"), F.col("reason"))
    when = lambda c: F.when(F.col("_ok"), F.col(c))
    return joined.select(
        "letter", "connector", F.when(F.col("_ok"), "resolved").otherwise(F.col("status")).alias("status"), (F.col("replay_count") + F.col("_tried").cast("int")).alias("replay_count"), when("subject").alias("subject"), when("occurred_at").alias("occurred_at"),
        "hash", F.coalesce("_makes", F.lit(False)).alias("created"), error.alias("error"),
    )


def drift(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Paths that a connector's records have and its known fields (``connector, path``) don't: ``connector, path, n``."""
    paths = raw.select("connector", F.explode(field_paths("payload")).alias("path"))
    return paths.groupBy("connector", "path").agg(F.count(F.lit(1)).alias("n")).join(known.select("connector", "path"), ["connector", "path"], "left_anti")


def quarantined(batches: DataFrame) -> DataFrame:
    """Batches (``connector, fetched, failed``) of which half or more failed, from QUARANTINE_FROM records on."""
    return batches.where((F.col("fetched") >= QUARANTINE_FROM) & (F.col("failed") >= QUARANTINE_SHARE * F.col("fetched")))


def odd_volumes(history: DataFrame, newest: DataFrame, key: str = "connector") -> DataFrame:
    """Newest batches (``n``) that stand ODD_Z deviations off the last twenty: ``key, n, mean, deviation, z``."""
    base = volume_baseline(history, key).where((F.col("samples") >= LEAST_SAMPLES) & (F.col("deviation") > 0))
    return newest.join(base, key).withColumn("z", (F.col("n") - F.col("mean")) / F.col("deviation")).where(F.abs("z") >= ODD_Z).select(key, "n", "mean", "deviation", "z")


def stale(connectors: DataFrame, now: Column) -> DataFrame:
    """Connectors past their expected silence (``expected_hours``; null: no expectation): ``connector, status``."""
    late = F.col("last_success") < now - F.make_dt_interval(hours=F.col("expected_hours"))
    status = F.when(F.col("last_success").isNull(), "never_produced").when(late, "stopped")
    return connectors.where("expected_hours is not null").select("connector", status.alias("status")).where("status is not null")


def due(connectors: DataFrame, now: Column) -> DataFrame:
    """Enabled connectors that aren't quarantined and whose interval is over, never-run ones first: ``connector, idempotency_key``."""
    seconds = F.unix_seconds(now.cast("timestamp"))
    last = F.unix_seconds(F.col("last_run").cast("timestamp"))
    ready = connectors.where(F.col("enabled") & ~F.col("quarantined") & (last.isNull() | (last <= seconds - F.col("interval_s"))))
    return ready.select("connector", "last_run", F.concat_ws(":", "connector", F.floor(seconds / F.col("interval_s")).cast("string")).alias("idempotency_key"))


def next_state(jobs: DataFrame) -> DataFrame:
    """What becomes of jobs (``job, attempts, outcome``; outcome: done, failed, released): ``state, attempts, delay_s``.

    A failure waits 5 seconds, twice as long each time, up to 900, and is dead
    after five attempts; a release waits 30 and doesn't count as an attempt.
    """
    tried = F.col("attempts") + F.when(F.col("outcome") == "released", 0).otherwise(1)
    state = F.when(F.col("outcome") == "done", "complete").when(F.col("outcome") == "released", "queued").when(tried >= MOST_ATTEMPTS, "dead").otherwise("queued")
    delay = F.when(F.col("outcome") == "released", RELEASE_DELAY).when(state == "queued", F.least(F.lit(MOST_DELAY), FIRST_DELAY * F.pow(F.lit(2), tried - 1)).cast("int"))
    return jobs.select("job", state.alias("state"), tried.alias("attempts"), delay.alias("delay_s"))


def believed(assertions: DataFrame, at: Column | None = None) -> DataFrame:
    """Assertions (``asserted_at, retracted_at, superseded_at``) that stood at a time, or stand now."""
    if at is None:
        return assertions.where("retracted_at is null and superseded_at is null")
    open_at = lambda c: F.col(c).isNull() | (F.col(c) > at)
    return assertions.where((F.col("asserted_at") <= at) & open_at("retracted_at") & open_at("superseded_at"))


def conflicts(assertions: DataFrame) -> DataFrame:
    """All sides of every (subject, predicate) that current assertions give more than one object."""
    now = believed(assertions)
    split = now.groupBy("subject", "predicate").agg(F.countDistinct("object").alias("n_sides")).where("n_sides > 1")
    return now.join(split, ["subject", "predicate"])


def attribute_status(properties: DataFrame, observations: DataFrame, assertions: DataFrame) -> DataFrame:
    """``ref, field, value, status``: unattributed, reported if an observation has the value, modified if only others do; a current assertion's kind overrides.

    ``properties`` and ``observations`` have ``ref, field, value``; of several assertions the last counts.
    """
    seen = observations.groupBy("ref", "field").agg(F.collect_set("value").alias("values"))
    said = believed(assertions).groupBy(F.col("subject").alias("ref"), F.col("predicate").alias("field")).agg(F.max_by("kind", "asserted_at").alias("kind"))
    joined = properties.join(seen, ["ref", "field"], "left").join(said, ["ref", "field"], "left")
    observed = F.when(F.col("values").isNull(), "unattributed").when(F.array_contains("values", F.col("value")), "reported").otherwise("modified")
    return joined.select("ref", "field", "value", F.coalesce("kind", observed).alias("status"))


def corroboration(stances: DataFrame) -> DataFrame:
    """``assertion, supporting, contradicting``: how many independent groups of sources take each side."""
    side = lambda s: F.countDistinct(F.when(F.col("stance") == s, F.col("source_group")))
    return stances.groupBy("assertion").agg(side("supports").alias("supporting"), side("contradicts").alias("contradicting"))

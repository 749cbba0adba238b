"""Records kept by analysts and feeds: filters, lifecycles, events and read models over append-only rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.operators.resolution import name_tokens, phone_digits, phonetic
from sleuthframe.operators.rollups import latest_per

# Columns that hold what was planted, which no analysis may read.
INADMISSIBLE = frozenset({"risk_score", "risk_factors", "flags", "flagged", "storyline_id", "community_ids", "route_anomaly", "inconsistency_type", "Storyline", "Incident", "CONTROLS", "SHARES_DEVICE", "Case", "INVOLVES", "LINKED_TO"})


def filtered(rows: DataFrame, equal: dict[str, object], least: dict[str, float] | None = None) -> DataFrame:
    """``rows`` by those filters whose value is given; None lets all through."""
    for column, value in equal.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    for column, value in (least or {}).items():
        rows = rows if value is None else rows.where(F.col(column) >= value)
    return rows


def admissible(rows: DataFrame) -> DataFrame:
    """``rows`` without the columns that no analysis may read."""
    return rows.drop(*[c for c in rows.columns if c in INADMISSIBLE])


def check_admissible(rows: DataFrame) -> None:
    """A ValueError that names the columns which no analysis may read, if there are any."""
    if found := sorted(INADMISSIBLE & set(rows.columns)):
        raise ValueError(f"not admissible: {', '.join(found)}")


def named(assertions: DataFrame, users: DataFrame) -> DataFrame:
    """``assertions`` with ``who``: the name (``user, name``) where ``asserted_by`` is ``user:`` and an id, else ``asserted_by`` itself."""
    key = F.when(F.startswith("asserted_by", F.lit("user:")), F.substring("asserted_by", 6, 1_000))
    joined = assertions.withColumn("_user", key).join(users.select(F.col("user").alias("_user"), F.col("name").alias("_name")), "_user", "left")
    return joined.withColumn("who", F.coalesce("_name", "asserted_by")).drop("_user", "_name")


def capped(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key with ``rank``, and ``truncated`` where there are more."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)
    size = rows.groupBy(key).agg((F.count(F.lit(1)) > most).alias("truncated"))
    return ranked.join(size, key)


def blocking_keys(rows: DataFrame, *also: str) -> DataFrame:
    """``ref, keys`` (array of ``kind, key``) from what a record has of ``name, born, city, country, phone, plate, imei, mac``.

    Names give their phonetic codes, sorted, four at most; the last word with the
    year of birth or the city; the whole name with the country. Phones give their
    last eight digits, devices and plates all of themselves. A missing or empty
    part gives no key. Columns ``also`` come along.
    """
    has = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    words = name_tokens(F.lower(has("name")))
    codes = F.slice(F.array_sort(F.array_distinct(F.transform(words, phonetic))), 1, 4)
    surname, digits = F.element_at(words, -1), phone_digits(has("phone"))
    parts = {
        "phonetic": F.concat(F.lit("ph:"), F.array_join(codes, "-")), "surname_year": F.concat(F.lit("sy:"), surname, F.lit("|"), F.substring(has("born"), 1, 4)), "surname_city": F.concat(F.lit("sc:"), surname, F.lit("|"), F.lower(has("city"))),
        "name_country": F.concat(F.lit("nc:"), F.lower(has("name")), F.lit("|"), F.lower(has("country"))), "phone": F.when(F.length(digits) >= 8, F.concat(F.lit("tel:"), F.right(digits, F.lit(8)))),
        **{k: F.concat(F.lit(f"{k}:"), F.upper(F.regexp_replace(has(k), r"[^\p{L}\p{N}]", ""))) for k in ("plate", "imei", "mac")},
    }
    keys = F.array_compact(F.array(*[F.when(key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.alias("key"))) for kind, key in parts.items()]))
    return rows.select("ref", *also, keys.alias("keys"))


def keyed(rows: DataFrame) -> DataFrame:
    """``ref, kind, key``, a row a key."""
    return rows.select("ref", F.explode("keys").alias("k")).select("ref", "k.kind", "k.key")


def swept(before: DataFrame, found: DataFrame, complete: bool) -> DataFrame:
    """Candidates (``pair, status``) after a sweep that found ``pair``: decided ones stay as they are, new ones are open; only a complete sweep withdraws open ones that it didn't find."""
    joined = before.join(found.select("pair").distinct().withColumn("_found", F.lit(True)), "pair", "full_outer")
    gone = F.col("_found").isNull() & (F.col("status") == "open") & F.lit(complete)
    status = F.when(F.col("status") == "decided", "decided").when(gone, "withdrawn").when(F.col("_found"), "open").otherwise(F.col("status"))
    return joined.select("pair", status.alias("status"))


def recorded(assertions: DataFrame, retractions: DataFrame) -> DataFrame:
    """``assertions`` (``id, subject, predicate, object, asserted_at``) with ``superseded_at, retracted_at, status``.

    A later assertion on the same subject and predicate supersedes; a retraction
    (``id, retracted_at``) is the last word. Nothing is changed in place.
    """
    order = Window.partitionBy("subject", "predicate").orderBy("asserted_at", "id")
    first = retractions.groupBy("id").agg(F.min("retracted_at").alias("retracted_at"))
    joined = assertions.withColumn("superseded_at", F.lead("asserted_at").over(order)).join(first, "id", "left")
    return joined.withColumn("status", F.when(F.col("retracted_at").isNotNull(), "retracted").when(F.col("superseded_at").isNotNull(), "superseded").otherwise("current"))


def known_at(rows: DataFrame, until: Column, context: DataFrame, time: str = "ts") -> DataFrame:
    """``rows`` recorded at or before ``until``, which may read the one row of ``context``."""
    return rows.join(F.broadcast(context)).where(F.col(time) <= until).select(*rows.columns)  # one row


def replayed_letters(letters: DataFrame) -> DataFrame:
    """Dead letters after one more try (``mapped``: null if it failed again): ``replay_count`` one higher, ``status`` resolved or failed."""
    return letters.withColumns({"replay_count": F.col("replay_count") + 1, "status": F.when(F.col("mapped").isNull(), "failed").otherwise("resolved")})


def backfill(nodes: DataFrame, there: DataFrame, fields: list[str]) -> DataFrame:
    """Observations ``ref, field, value`` of the nodes that have none yet (``there``: ``ref``), a row a field that isn't null; run again it gives nothing new."""
    fresh = nodes.join(there.select("ref"), "ref", "left_anti")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return fresh.select("ref", pairs.alias("p")).select("ref", "p.field", "p.value").where("value is not null")


def change_events(rows: DataFrame, key: str, order: list[str], field: str, event: str) -> DataFrame:
    """Events that the changes of a field write: ``event, key, field, old_value, new_value``; the first value has no old one, equal ones write nothing."""
    by = Window.partitionBy(key).orderBy(*order)
    seen = rows.withColumns({"_old": F.lag(field).over(by), "_n": F.row_number().over(by)}).where((F.col("_n") == 1) | ~F.col("_old").eqNullSafe(F.col(field)))
    return seen.select(event, key, F.lit(field).alias("field"), F.col("_old").alias("old_value"), F.col(field).alias("new_value"))


def standing_judgments(rows: DataFrame, key: str, author: str, order: list[str]) -> DataFrame:
    """The newest judgment of each author on each key, of those that aren't ``withdrawn``."""
    return latest_per(rows.where(~F.col("withdrawn")).withColumn("_by", F.struct(key, author)), "_by", order[0], order[1]).drop("_by")


def cases_with_links(cases: DataFrame, linked: DataFrame) -> DataFrame:
    """``cases`` (``case_id``) with ``n_linked``: different entities linked and not ``removed``."""
    counts = linked.where(~F.col("removed")).groupBy("case_id").agg(F.count_distinct("entity").alias("n_linked"))
    return cases.join(counts, "case_id", "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0)))


def context(wanted: DataFrame, ledger: DataFrame, places: DataFrame) -> DataFrame:
    """Each ``ref`` asked for with its current band and place; unknown ones have nulls."""
    bands = latest_per(ledger, "subject").select(F.col("subject").alias("ref"), "band")
    return wanted.join(bands, "ref", "left").join(places, "ref", "left")


def evidence(ledger: DataFrame, bands: tuple[str, ...] = ("elevated", "notable")) -> DataFrame:
    """The newest row of each subject in one of ``bands``, with the ``previous`` band."""
    by = Window.partitionBy("subject").orderBy("computed_at", "id")
    return latest_per(ledger.withColumn("previous", F.lag("band").over(by)), "subject").where(F.col("band").isin(*bands))


def evaluated(alerts: DataFrame, planted: DataFrame) -> DataFrame:
    """By rule: ``n_alerts, n_hit, precision`` against planted subjects (``subject, story``), and ``n_stories`` that it reaches."""
    joined = alerts.join(planted.dropDuplicates(["subject", "story"]), "subject", "left")
    sums = joined.groupBy("rule").agg(F.count(F.lit(1)).alias("n_alerts"), F.count("story").alias("n_hit"), F.count_distinct("story").alias("n_stories"))
    return sums.withColumn("precision", F.try_divide("n_hit", "n_alerts"))

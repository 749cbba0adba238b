"""Rules over assessments, links and clusters; grouping, priority, suppression and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.operators.sequences import decay, previous_of

# Order of the bands (there is no place for routine), moves between alert states and between investigation states,
# reasons of a dismissal with whether it counts against the rule, and outcomes of an investigation with whether it confirms the alerts.
BAND_ORDER = {"insufficient": 0, "clear": 1, "notable": 2, "elevated": 3}
ALERT_MOVES = {
    "open": ("acknowledged", "investigating", "dismissed"), "acknowledged": ("investigating", "dismissed", "open"), "investigating": ("resolved", "dismissed", "acknowledged"),
    "resolved": ("investigating", "open"), "dismissed": ("open", "investigating"),
}
CASE_MOVES = {"open": ("active", "closed"), "active": ("open", "closed"), "closed": ("active",)}
DISMISSALS = {"false_positive": True, "known_benign": False, "not_relevant": False, "insufficient_evidence": False, "duplicate": False}
OUTCOMES = {"confirmed": True, "unfounded": False, "inconclusive": None, "referred": None}
#: Priorities from which an alert is high or medium.
HIGH, MEDIUM = 0.55, 0.30


def alert_key(rule: Column, version: Column, scope: Column) -> Column:
    return F.substring(F.sha2(F.concat(rule, F.lit("@"), version.cast("string"), F.lit("::"), F.array_join(F.array_sort(scope.cast("array<string>")), ",")), 256), 1, 32)


def firing(rows: DataFrame, rule: str, scope: Column, magnitude: Column, confidence: Column, version: int = 1) -> DataFrame:
    """``key, rule, version, scope, magnitude, confidence, evidence_at`` from rows with ``computed_at``."""
    made = rows.select(F.lit(rule).alias("rule"), F.lit(version).alias("version"), F.array_sort(scope.cast("array<string>")).alias("scope"), magnitude.alias("magnitude"), confidence.alias("confidence"), F.col("computed_at").alias("evidence_at"))
    return made.withColumn("key", alert_key(F.col("rule"), F.col("version"), F.col("scope")))


def elevated(current: DataFrame) -> DataFrame:
    """Every elevated subject."""
    return firing(current.where("band = 'elevated'"), "assessment.elevated", F.array("subject"), F.least(F.lit(1.0), F.col("score") / 100), F.col("coverage"))


def escalated(ledger: DataFrame) -> DataFrame:
    """Subjects whose newest band ranks above the one before. ``routine`` has no rank, so a rise from it isn't seen."""
    ranks = F.create_map(*[F.lit(x) for pair in BAND_ORDER.items() for x in pair])
    rank = lambda c: F.coalesce(ranks[F.col(c)], F.lit(-1))
    with_before = previous_of(ledger, "subject", "band", "computed_at", "id")
    newest = with_before.groupBy("subject").agg(F.max_by(F.struct("band", "previous", "coverage", "computed_at"), F.struct("computed_at", "id")).alias("r")).select("subject", "r.*")
    risen = newest.where((rank("previous") >= 0) & (rank("band") > rank("previous")) & F.col("band").isin("notable", "elevated"))
    return firing(risen, "assessment.escalated", F.array("subject"), F.least(F.lit(1.0), (rank("band") - rank("previous")) / 3), F.col("coverage"))


def convergences(members: DataFrame, current: DataFrame) -> DataFrame:
    """Clusters (``cluster, subject``) of which at least two members are elevated or notable."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    hit = members.join(current.where(F.col("band").isin("elevated", "notable")), "subject")
    sums = hit.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("coverage"), F.collect_set("subject").alias("subjects"), F.max("computed_at").alias("computed_at")).where("n >= 2").join(size, "cluster")
    return firing(sums, "convergence.assessed_cluster", F.col("subjects"), F.col("n") / F.col("size"), F.col("coverage"))


def grouped(alerts: DataFrame, members: DataFrame) -> DataFrame:
    """``alerts`` with ``group_key``: the least cluster that touches the scope, else the scope itself."""
    touched = alerts.select("key", F.explode("scope").alias("subject")).join(members.select(F.col("subject").cast("string").alias("subject"), "cluster"), "subject").groupBy("key").agg(F.min("cluster").alias("cluster"))
    basis = F.when(F.col("cluster").isNotNull(), F.concat(F.lit("cluster::"), F.col("cluster").cast("string"))).otherwise(F.concat(F.lit("scope::"), F.array_join("scope", ",")))
    return alerts.join(touched, "key", "left").withColumn("group_key", basis).drop("cluster")


def prioritised(alerts: DataFrame, now: Column) -> DataFrame:
    """``group_key, n_rules, n_alerts, priority, level, rules``: corroboration times the best confidence x magnitude x recency.

    One rule alone counts as it is, two or more half again as much; 1 at most.
    Confidence and magnitude count as 0 to 1, ages by the second.
    """
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("evidence_at").cast("timestamp"))) / 86_400_000_000
    worth = unit("confidence") * unit("magnitude") * decay(age)
    sums = alerts.groupBy("group_key").agg(F.countDistinct("rule").alias("n_rules"), F.countDistinct("key").alias("n_alerts"), F.max(worth).alias("worth"), F.sort_array(F.collect_set("rule")).alias("rules"))
    priority = F.least(F.lit(1.0), F.when(F.col("n_rules") > 1, 1.5).otherwise(1.0) * F.col("worth"))
    return sums.select("group_key", "n_rules", "n_alerts", priority.alias("priority"), F.when(priority >= HIGH, "high").when(priority >= MEDIUM, "medium").otherwise("low").alias("level"), "rules")


def suppressed(alerts: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """``alerts`` with ``suppressed_by``: the narrowest active suppression that fits (one by rule and subject before those by either), then the least id.

    ``rules`` has ``id, rule, subject, expires_at, revoked``; active are those that aren't revoked or over.
    """
    active = rules.where(~F.col("revoked") & (F.col("expires_at") > now)).where("rule is not null or subject is not null")
    active = active.select(F.col("id").alias("sid"), F.col("rule").alias("srule"), F.col("subject").alias("ssubject"))
    at = alerts.select("key", "rule", F.explode("scope").alias("subject"))
    by_subject = at.join(active.where("ssubject is not null"), (F.col("subject") == F.col("ssubject")) & (F.col("srule").isNull() | (F.col("srule") == F.col("rule"))))
    by_rule = at.join(active.where("ssubject is null"), F.col("rule") == F.col("srule"))
    weight = F.col("srule").isNotNull().cast("int") + F.col("ssubject").isNotNull().cast("int")
    best = by_subject.select("key", weight.alias("w"), "sid").unionByName(by_rule.select("key", weight.alias("w"), "sid")).groupBy("key").agg(F.min_by("sid", F.struct(-F.col("w"), F.col("sid"))).alias("suppressed_by"))
    return alerts.join(best, "key", "left")


def accepted_suppressions(wanted: DataFrame) -> DataFrame:
    """Suppressions that may be created: they name a rule or a subject, run 90 days at most and say why in ten characters."""
    days = (F.unix_micros(F.col("expires_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86_400_000_000
    return wanted.where("rule is not null or subject is not null").where((days > 0) & (days <= 90) & (F.length(F.trim("note")) >= 10))


def upserted(queue: DataFrame, run: DataFrame, run_at: Column) -> DataFrame:
    """The queue after a run: ``key, rule, occurrences, first_seen, last_seen, change``; of equal keys in a run the first counts."""
    once = run.groupBy("key").agg(F.min("rule").alias("rule"))
    q, r = queue.alias("q"), once.alias("r")
    joined = q.join(r, "key", "full_outer")
    change = F.when(F.col("q.occurrences").isNull(), "created").when(F.col("r.rule").isNull(), "unchanged").otherwise("repeated")
    count = F.coalesce("q.occurrences", F.lit(0)) + F.col("r.rule").isNotNull().cast("long")
    return joined.select("key", F.coalesce("q.rule", "r.rule").alias("rule"), count.alias("occurrences"), F.coalesce("q.first_seen", run_at).alias("first_seen"), F.when(F.col("r.rule").isNotNull(), run_at).otherwise(F.col("q.last_seen")).alias("last_seen"), change.alias("change"))


def transitions(requests: DataFrame, state: DataFrame, moves: dict[str, tuple[str, ...]] = ALERT_MOVES, reasons: tuple[str, ...] = tuple(DISMISSALS)) -> DataFrame:
    """``requests`` (``key, from_state, to_state, reason``) with ``accepted`` and ``why``: the optimistic lock, the moves, and for a dismissal a reason of the vocabulary."""
    allowed = F.lit(False)
    for a, to in moves.items():
        allowed = allowed | (F.col("from_state") == a) & F.col("to_state").isin(*to)
    joined = requests.join(state.select("key", "state"), "key", "left")
    why = (
        F.when(~F.col("to_state").isin(*moves), "no such state").when(F.col("state").isNull(), "unknown").when(F.col("state") != F.col("from_state"), "state has changed")
        .when(F.col("from_state") == F.col("to_state"), "nothing would change").when(~allowed, "no such move")
        .when((F.col("to_state") == "dismissed") & ~F.coalesce(F.col("reason").isin(*reasons), F.lit(False)), "a dismissal needs a known reason")
    )
    return joined.select("key", "from_state", "to_state", "reason", why.isNull().alias("accepted"), why.alias("why"))


def listed(queue: DataFrame, states: tuple[str, ...] = (), assignee: str | None = None, level: str | None = None, rule: str | None = None, unassigned: bool = False) -> DataFrame:
    """The alerts of one of the queue's listings, with ``total``, their true number: any filter that is left out lets all through."""
    kept = queue
    for given, test in ((states, lambda: F.col("state").isin(*states)), (assignee, lambda: F.col("assignee") == assignee), (level, lambda: F.col("level") == level), (rule, lambda: F.array_contains("rules", rule)), (unassigned, lambda: F.col("assignee").isNull())):
        kept = kept.where(test()) if given else kept
    return kept.join(F.broadcast(kept.agg(F.count(F.lit(1)).alias("total"))))  # one row


def rule_quality(dismissed: DataFrame) -> DataFrame:
    """By rule: closed alerts (``rule, state, reason``), and the share that was a false positive of those that say whether the rule was right."""
    wrong = F.col("reason").isin(*[r for r, against in DISMISSALS.items() if against])
    sums = dismissed.groupBy("rule").agg(F.count_if((F.col("state") == "resolved") | wrong).alias("n_judged"), F.count_if((F.col("state") == "dismissed") & wrong).alias("n_wrong"), F.count_if((F.col("state") == "dismissed") & ~wrong).alias("n_out_of_scope"))
    return sums.withColumn("false_positive_rate", F.try_divide("n_wrong", "n_judged"))


def partly_updated(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` with the fields replaced whose ``set_<field>`` is true, by null as well."""
    c = changes.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields], *[f"set_{f}" for f in fields])
    joined = rows.join(c, key, "left")
    return joined.withColumns({f: F.when(F.coalesce(f"set_{f}", F.lit(False)), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}).drop(*[f"_new_{f}" for f in fields], *[f"set_{f}" for f in fields])


def preview(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The newest ``most`` rows of each key, with ``coverage``: complete or truncated."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), "id")
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    kept = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return kept.join(total, key).withColumn("coverage", F.when(F.col("_n") > most, "truncated").otherwise("complete")).drop("_r", "_n")

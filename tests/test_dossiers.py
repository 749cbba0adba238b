"""Alert runs, replays and read models on small rows whose answers are known."""

import datetime

import pytest
from pyspark.sql import functions as F

from sleuthframe.operators import alert_runs as runs
from sleuthframe.operators import alerting, ingest
from sleuthframe.operators import dossiers as ds


def now():
    return F.lit("2024-03-01").cast("timestamp_ntz")


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


LEDGER = "id int, subject string, band string, score double, coverage double, computed_at timestamp_ntz"
SUPPRESSIONS = "id string, rule string, subject string, expires_at timestamp_ntz, revoked boolean"


@pytest.fixture(scope="module")
def found(spark):
    """Subjects a to f: a rose to elevated, b is elevated, c notable, d clear, e has nothing; a, b and d are one cluster."""
    ledger = [(1, "a", "clear", 5.0, 0.5, day(0)), (2, "a", "elevated", 80.0, 0.5, day(60)), (3, "b", "elevated", 250.0, 1.0, day(30)), (4, "c", "routine", 1.0, 1.0, day(0)), (5, "c", "notable", 40.0, 1.0, day(10)), (6, "d", "clear", 1.0, 0.9, day(60))]
    current = runs.current_findings(spark.createDataFrame(ledger, LEDGER))
    links = spark.createDataFrame([("b", "a", "established", 0.8, 0.75), ("a", "b", "established", 0.6, 0.75), ("e", "f", "established", 0.7, 0.5), ("a", "d", "probable", 0.5, 0.5)], "a string, b string, tier string, strength double, coverage double")
    members = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k1", "d"), ("k1", "d"), ("k2", "c"), ("k2", "e")], "cluster string, subject string")
    return current, links, members


def fired(found):
    return runs.firings(*found)


def test_four_rules_fire_about_the_right_subjects(found):
    got = {}
    for row in fired(found).collect():
        got.setdefault((row["rule"], row["ref"]), []).append((row["subject"], round(row["magnitude"], 4), round(row["confidence"], 4)))
    assert {k: sorted(v) for k, v in got.items()} == {
        ("assessment.elevated", "a"): [("a", 0.8, 0.5)], ("assessment.elevated", "b"): [("b", 1.0, 1.0)], ("assessment.escalated", "a"): [("a", 0.6667, 0.5)],
        ("correlation.established_pair", "a|b"): [("a", 0.8, 0.75), ("b", 0.8, 0.75)], ("correlation.established_pair", "e|f"): [("e", 0.7, 0.5), ("f", 0.7, 0.5)],
        ("convergence.assessed_cluster", "k1"): [("a", 0.6667, 0.75), ("b", 0.6667, 0.75), ("d", 0.6667, 0.75)],
    }


def test_alerts_have_priority_group_and_the_narrowest_suppression(spark, found):
    until, over = day(90), day(20)
    quiet = [("z", "assessment.elevated", "a", until, False), ("m", None, "a", until, False), ("b", "assessment.elevated", None, until, False), ("a", "assessment.escalated", None, until, False), ("old", None, "b", over, False), ("off", "correlation.established_pair", None, until, True), ("all", None, None, until, False)]
    rows = runs.raised(fired(found), found[0], found[2], spark.createDataFrame(quiet, SUPPRESSIONS), now()).collect()
    got = {(r["rule"], r["ref"]): r for r in rows}
    assert len({r["key"] for r in rows}) == len(rows) == 6
    # narrowest first, then the least id: rule and subject; rule before subject by name; a pair by its member; none if over, revoked or about all
    assert {k: r["suppressed_by"] for k, r in got.items()} == {
        ("assessment.elevated", "a"): "z", ("assessment.elevated", "b"): "b", ("assessment.escalated", "a"): "a", ("correlation.established_pair", "a|b"): "m", ("correlation.established_pair", "e|f"): None, ("convergence.assessed_cluster", "k1"): "m",
    }
    # evidence of day 60 is this day's, of day 30 a half-life old; two methods concur in the cluster; without any assessment it is new
    assert {k: round(r["priority"], 4) for k, r in got.items()} == {
        ("assessment.elevated", "a"): 0.4, ("assessment.elevated", "b"): 0.5, ("assessment.escalated", "a"): 0.3333, ("correlation.established_pair", "a|b"): 0.6, ("correlation.established_pair", "e|f"): 0.35, ("convergence.assessed_cluster", "k1"): 0.75,
    }
    groups = {}
    for k, r in got.items():
        groups.setdefault(r["group_key"], set()).add(k)
    assert sorted(len(g) for g in groups.values()) == [1, 5]
    assert got[("convergence.assessed_cluster", "k1")]["n_subjects"] == 3


def test_keys_hang_on_the_set_alone(spark, found):
    other = found[2].withColumn("cluster", F.concat(F.lit("renamed-"), "cluster")).orderBy(F.desc("subject"))
    none = spark.createDataFrame([], SUPPRESSIONS)
    key = lambda members: {r["rule"] + str(r["n_subjects"]): r["key"] for r in runs.raised(runs.firings(found[0], found[1].where("a <> 'e'"), members), found[0], members, none, now()).where("rule like 'conv%' or rule like 'corr%'").collect()}
    assert key(found[2]) == key(other)


def test_a_run_renews_and_keeps_what_analysts_did(spark, found):
    alerts = runs.raised(fired(found), found[0], found[2], spark.createDataFrame([], SUPPRESSIONS), now())
    first = runs.brought_in(None, alerts.where("rule <> 'assessment.escalated'"), F.lit(1))
    queue = first.withColumns({"state": F.when(F.col("rule") == "assessment.elevated", "dismissed").otherwise("open"), "priority": F.lit(0.0)}).drop("change")
    after = runs.brought_in(queue, alerts.where("ref <> 'e|f'"), F.lit(2))
    rows = {(r["rule"], r["priority"] > 0): (r["state"], r["occurrences"], r["first_run"], r["last_run"], r["change"]) for r in after.collect()}
    assert rows == {
        ("assessment.elevated", True): ("dismissed", 2, 1, 2, "repeated"), ("assessment.escalated", True): ("open", 1, 2, 2, "created"), ("convergence.assessed_cluster", True): ("open", 2, 1, 2, "repeated"),
        ("correlation.established_pair", True): ("open", 2, 1, 2, "repeated"), ("correlation.established_pair", False): ("open", 1, 1, 1, "unchanged"),
    }
    again = runs.brought_in(after.drop("change"), alerts.where("ref <> 'e|f'"), F.lit(2))
    assert {r["change"] for r in again.collect()} == {"unchanged"} and sorted(again.select("key", "occurrences").collect()) == sorted(after.select("key", "occurrences").collect())
    report = runs.run_report(alerts.where("ref <> 'e|f'"), after).first().asDict()
    assert report == {"n_firings": 5, "n_alerts": 5, "n_created": 1, "n_repeated": 4, "n_suppressed": 0, "n_groups": 1}
    assert [tuple(r)[1:] for r in runs.openings(after).collect()] == [(None, "open", "raised by assessment.escalated")]


def test_an_empty_ledger_raises_nothing(spark, found):
    current = found[0].where("false")
    alerts = runs.raised(runs.firings(current, found[1].where("false"), found[2]), current, found[2], spark.createDataFrame([], SUPPRESSIONS), now())
    after = runs.brought_in(None, alerts, F.lit(1))
    assert after.count() == 0
    assert runs.run_report(alerts, after).first().asDict() == dict.fromkeys(["n_firings", "n_alerts", "n_created", "n_repeated", "n_suppressed", "n_groups"], 0)


def test_suppression_by_subject_or_rule_are_equally_narrow(spark):
    alerts = spark.createDataFrame([("k", "r", ["a"])], "key string, rule string, scope array<string>")
    rows = [("2", None, "a", day(90), False), ("1", "r", None, day(90), False)]
    assert alerting.suppressed(alerts, spark.createDataFrame(rows, SUPPRESSIONS), now()).first()["suppressed_by"] == "1"
    both = [*rows, ("3", "r", "a", day(90), False)]
    assert alerting.suppressed(alerts, spark.createDataFrame(both, SUPPRESSIONS), now()).first()["suppressed_by"] == "3"


def test_letters_are_replayed_once_and_say_why_they_fail(spark):
    good, bad = '{"n": "7", "t": "2024-01-01T00:00:00Z"}', '{"n": "7", "t": "soon"}'
    raw = spark.createDataFrame([(1, good), (2, bad), (3, good), (4, '{"n": "8", "t": "2024-01-01T00:00:00Z"}'), (5, None)], "raw_id int, payload string")
    letters = [(10, "c", 3, "failed", 0), (11, "c", 1, "failed", 2), (12, "c", 2, "failed", 0), (13, "c", None, "failed", 0), (14, "c", 4, "failed", 0), (15, "c", 1, "resolved", 1), (16, "other", 1, "failed", 0), (17, "c", 5, "failed", 0)]
    observed = ingest.landed(spark.createDataFrame([("c", '{"t": "2024-01-01T00:00:00Z", "n": "8"}')], "connector string, payload string")).select("connector", "hash")
    rows = ingest.replayed(spark.createDataFrame(letters, "letter int, connector string, raw_id int, status string, replay_count int"), raw, ingest.Mapping(subject="n", time="t"), observed).collect()
    assert {r["letter"]: (r["status"], r["replay_count"], r["subject"], r["created"], r["error"]) for r in rows} == {
        10: ("resolved", 1, "7", True, None), 11: ("resolved", 3, "7", False, None), 12: ("failed", 1, None, False, "not a time"), 13: ("failed", 0, None, False, "no stored record"), 14: ("resolved", 1, "8", False, None),
        15: ("resolved", 1, None, False, None), 16: ("resolved", 1, "7", True, None), 17: ("failed", 0, None, False, "no stored record"),
    }


ITEM = "investigation int, item string, at timestamp_ntz, ended_at timestamp_ntz, note string"


def test_a_dossier_shows_the_first_items_and_counts_all(spark):
    alerts = spark.createDataFrame([(1, f"a{i}", day(i), day(50) if i == 2 else None, None) for i in (3, 1, 2)] + [(9, "lost", day(0), None, "x")], ITEM)
    findings = spark.createDataFrame([(1, "f", day(0), day(1), "  ")], ITEM)
    heads = spark.createDataFrame([(1, "t"), (2, "u")], "investigation int, title string")
    rows = ds.items(alerts=alerts, findings=findings)
    one, two = sorted(ds.dossiers(heads, rows, most=2).collect())
    assert [(x["item"], x["ended_at"]) for x in one["alerts"]] == [("a1", None), ("a2", day(50))]
    assert (one["n_alerts"], one["n_alerts_standing"], one["n_findings"], one["n_findings_standing"], one["n_reviews"], one["truncated"]) == (3, 2, 1, 0, 0, True)
    assert (two["alerts"], two["n_alerts"], two["truncated"], two["title"]) == ([], 0, False, "u")
    assert not ds.dossiers(heads, rows, most=3).where("investigation = 1").first()["truncated"]
    told = sorted((r["at"], r["event"], r["note"]) for r in ds.history(rows).where("investigation = 1").collect())
    assert told == [(day(0), "finding_recorded", "f"), (day(1), "alert_attached", "a1"), (day(1), "finding_withdrawn", "f"), (day(2), "alert_attached", "a2"), (day(3), "alert_attached", "a3"), (day(50), "alert_detached", "a2")]
    assert {r["item"] for r in ds.standing_items(rows, F.lit("2024-01-03").cast("timestamp_ntz")).collect()} == {"a1", "a2", "lost"}
    with pytest.raises(ValueError, match="notes"):
        ds.items(notes=alerts)


def test_changes_of_fields_count_null_as_a_value(spark):
    rows = spark.createDataFrame([(1, day(0), 1, "x", "me"), (1, day(0), 2, "x", None), (1, day(2), 1, "y", None), (2, day(0), 1, "x", None)], "investigation int, at timestamp_ntz, id int, title string, who string")
    got = sorted(tuple(r) for r in ds.field_changes(rows, ["title", "who"]).collect())
    assert got == [(1, day(0), "who", "me", None), (1, day(2), "title", "x", "y")]


def test_an_investigation_opened_again_has_no_outcome(spark):
    rows = [(1, day(0), 1, "closed", "confirmed"), (1, day(1), 2, "active", None), (2, day(0), 1, "active", None), (2, day(3), 2, "closed", "unfounded")]
    got = sorted(tuple(r) for r in ds.closures(spark.createDataFrame(rows, "investigation int, at timestamp_ntz, id int, to_state string, outcome string")).collect())
    assert got == [(1, "active", None, None), (2, "closed", "unfounded", day(3))]


def test_what_touches_a_subject(spark):
    subjects = spark.createDataFrame([("a",), ("a",), ("q",)], "subject string")
    cases = spark.createDataFrame([(1, day(0)), (2, day(1))], "case_id int, opened_at timestamp_ntz")
    linked = spark.createDataFrame([(1, "a", False), (1, "a", None), (2, "a", True), (2, "b", False)], "case_id int, subject string, removed boolean")
    assert [tuple(r) for r in ds.related_cases(subjects, linked, cases).collect()] == [("a", 1, day(0))]
    rows = spark.createDataFrame([("a", i, day(i % 3)) for i in range(5)] + [("b", 9, day(0))], "subject string, alert int, at timestamp_ntz")
    assert sorted((r["place"], r["alert"], r["total"]) for r in ds.newest_of(subjects, rows, "alert", 3).collect()) == [(1, 2, 5), (2, 1, 5), (3, 4, 5)]
    links = spark.createDataFrame([("a", "b", 0.5, "probable"), ("c", "a", 0.9, "established"), ("b", "c", 0.4, "possible"), ("a", "d", 0.1, "possible")], "a string, b string, strength double, tier string")
    evidence = spark.createDataFrame([("a", "b", "x", 0.2), ("a", "b", "y", 0.7), ("a", "b", "x", 0.3)], "a string, b string, dimension string, raw double")
    got = sorted((r["place"], r["other"], r["total"], [tuple(d) for d in r["dimensions"]]) for r in ds.links_of(subjects, links, evidence, 2).collect())
    assert got == [(1, "c", 3, []), (2, "b", 3, [("y", 0.7), ("x", 0.3)])]

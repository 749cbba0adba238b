"""Rates of assessments, signals and alerts on a few subjects whose answers can be counted by hand."""

from pyspark.sql import functions as F

from sleuthframe.operators import reports
from sleuthframe.sources.feeds import described

CURRENT = [("a", "elevated", 90.0), ("b", "elevated", 90.0), ("c", "notable", 40.0), ("d", "clear", 10.0), ("e", "insufficient", None), ("f", None, None)]
LABELS = [("a", "ring"), ("a", "ring"), ("a", "cycle"), ("c", "ring"), ("d", None), ("e", "ring"), ("zz", "ring"), ("f", "identity_overlap")]


def frames(spark):
    return spark.createDataFrame(CURRENT, "subject string, band string, score double"), spark.createDataFrame(LABELS, "subject string, storyline string")


def test_assessment_rates_count_only_who_was_assessed(spark):
    got = {r["measure"]: tuple(r)[1:] for r in reports.assessment_rates(*frames(spark), most=3).collect()}
    assert got == {"elevated": (2, 1, 5, 0.5, 0.2), "notable_or_better": (3, 2, 5, 0.6667, 0.4), "elevated_storyline_only": (2, 1, 4, 0.5, 0.25), "top": (3, 2, 5, 0.6667, 0.4)}


def test_rates_over_nothing_are_null(spark):
    current, labels = frames(spark)
    got = {r["measure"]: tuple(r)[1:] for r in reports.assessment_rates(current.where("false"), labels).collect()}
    assert set(got.values()) == {(0, 0, 0, None, None)}
    assert reports.alert_rates(spark.createDataFrame([], "key string, rule string, subject string"), spark.createDataFrame([], "story string, kind string, subject string")).first().asDict() == {
        "alerts": 0, "subjects": 0, "labelled": 0, "reachable": 0, "reached": 0, "precision": None, "recall": None, "unlabelled": None
    }


def test_storylines_out_of_reach_are_listed(spark):
    got = {r["storyline"]: tuple(r)[1:] for r in reports.assessment_storylines(*frames(spark)).collect()}
    assert got == {"ring": (3, 1, 2, 1, 0.6667, True), "cycle": (1, 1, 1, 0, 1.0, True), "identity_overlap": (1, 0, 0, 0, 0.0, False), "document_forgery_ring": (0, 0, 0, 0, None, False)}


def test_signals_that_cannot_be_judged_are_not_silent_ones(spark):
    rows = [("s", "a", 0.5), ("s", "b", 0.1), ("s", "c", 0.0), ("s", "d", None), ("never", "a", 0.0), ("blind", "a", None)]
    got = {r["signal"]: tuple(r)[1:] for r in reports.signal_rates(spark.createDataFrame(rows, "signal string, subject string, magnitude double"), frames(spark)[1]).collect()}
    assert got == {"s": (3, 1, 2, 1, 0.6667, 0.5), "never": (1, 0, 0, 0, 0.0, None), "blind": (0, 1, 0, 0, None, None)}


def test_alerts_are_judged_by_subjects_and_recall_by_what_is_in_reach(spark):
    scopes = spark.createDataFrame([("1", "r", "a"), ("1", "r", "b"), ("2", "r", "a"), ("3", "q", "c"), ("4", "q", "h")], "key string, rule string, subject string")
    planted = spark.createDataFrame([("s1", "ring", "a"), ("s1", "ring", "a"), ("s2", "ring", "a"), ("s2", "ring", "x"), ("s3", "identity_overlap", "h"), ("s3", "identity_overlap", "x"), ("s4", "identity_overlap", "y")], "story string, kind string, subject string")
    assert reports.alert_rates(scopes, planted).first().asDict() == {"alerts": 4, "subjects": 4, "labelled": 2, "reachable": 2, "reached": 1, "precision": 0.5, "recall": 0.5, "unlabelled": 0.5}
    assert {r["rule"]: tuple(r)[1:] for r in reports.alert_rules(scopes, planted).collect()} == {"r": (2, 2, 1, 0.5), "q": (2, 2, 1, 0.5)}
    assert {r["kind"]: tuple(r)[1:] for r in reports.alert_storylines(scopes, planted).collect()} == {
        "ring": (3, 2, 0.6667, ["r"], True), "identity_overlap": (3, 1, 0.3333, ["q"], False), "document_forgery_ring": (0, 0, None, [], False)
    }


def test_a_null_magnitude_or_band_is_neither_hit_nor_error(spark):
    current, labels = frames(spark)
    assert reports.assessment_rates(current.withColumn("band", F.lit(None).cast("string")), labels).where("measure = 'elevated'").first()["selected"] == 0


def test_a_description_has_no_secrets():
    assert described({"path": "/x", "api_key": "1", "AuthToken": "2", "Password": "3", "client_secret": "4", "pattern": "*"}) == {"path": "/x", "pattern": "*"}

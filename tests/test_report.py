from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.operators import report

BRIEF = (
    "site_id string, o3_now double, no2_now double, o3_avg double, no2_avg double, o3_peak double, no2_peak double, peak_o3_hour int, "
    "peak_no2_hour int, o3_delta double, no2_delta double, alert_count int, hotspot_o3_delta double, hotspot_no2_delta double"
)
LOCATIONS = "key string, name string, country string, catalog_rank int, o3 double, no2 double, us_aqi double, european_aqi double"
ALERTS = "site_id string, timestamp timestamp_ntz, pollutant string, pollutant_rank int, value double, threshold double, severity string"


def made(spark, rows, alerts=(), locations=(("k", "Delhi", "India", 0, 50.0, 20.0, 90.0, 40.0),)):
    totals = spark.createDataFrame([(7, 171679, 10, ["a"], ["O3", "NO2"])], "total_sites long, total_train_rows long, total_unseen_rows long, features array<string>, targets array<string>")
    sections = report.report_sections(spark.createDataFrame(rows, BRIEF), spark.createDataFrame(list(locations), LOCATIONS), spark.createDataFrame(list(alerts), ALERTS), totals)
    return {r["site_id"]: r for r in sections.collect()}


def test_sections_of_a_site(spark):
    rows = [("a", 40.0, 30.0, 45.25, 10.0, 80.0, 60.0, 5, None, -5.25, 20.0, 0, 10.0, -10.0), ("b", None, None, None, None, 90.0, None, 1, None, None, None, 2, None, None)]
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    alerts = [("b", at, "O3", 0, 120.0, 100.0, "critical"), ("b", at, "NO2", 1, 90.0, 80.0, "warning")]
    got = made(spark, rows, alerts)
    a, b = got["a"], got["b"]
    # -5.25 is exactly half way; ties go to even.
    assert "That puts O3 -5.2 ug/m3 versus baseline and NO2 +20.0 ug/m3" in a["situation"]
    assert "O3 80.0 ug/m3 around lead hour +5 and NO2 60.0 ug/m3 around n/a." in a["outlook"]
    assert a["network"].startswith("The top live-network comparison point is Delhi, India, with O3 50.0 ug/m3, NO2 20.0 ug/m3, and modeled US AQI estimate 90.0.")
    assert a["actions"].startswith(report.NO_ALERTS) and b["actions"].startswith(report.ACTIVE_ALERTS)
    assert "NO2 is the pollutant to watch first. NO2 is farther from its recent SIH baseline: +20.0 ug/m3 versus O3 -5.2 ug/m3. " in a["alert"]
    assert b["alert"].startswith("The active alert layer is being driven by O3. Its reported value is 120.0 ug/m3 against a threshold of 100.0 ug/m3, with severity critical.")
    assert "171,679 SIH training rows across 7 sites, with targets O3, NO2." in a["dataset"]
    assert "O3 at n/a ug/m3" in b["situation"] and "O3 n/a and NO2 n/a." in b["network"]
    empty = made(spark, rows[:1], locations=())["a"]
    assert empty["network"].startswith("The top live-network comparison point is the live network, with O3 n/a")


def test_sections_in_the_order_of_the_intent(spark):
    sections = spark.createDataFrame([("a", *report.TITLES)], ", ".join(f"{c} string" for c in ("site_id", *report.TITLES)))
    told = report.ordered_sections(sections, F.lit("alert")).first()["report"]
    assert [(part["key"], part["content"]) for part in told] == [(k, k) for k in ("alert", "outlook", "actions", "situation")]
    assert told[0]["title"] == "Alert Driver"
    assert len(report.ordered_sections(sections, F.lit("unheard of")).first()["report"]) == 5


def test_comparison_of_two_places(spark):
    schema = "named string, named_o3 double, named_no2 double, named_aqi double, hotspot string, hotspot_o3 double, hotspot_no2 double, hotspot_aqi double"
    rows = [("Site", 10.0, 30.0, None, "Delhi, India", 40.0, 30.0, 99.0), ("Delhi, India", 40.0, 30.0, 99.0, "Delhi, India", 40.0, 30.0, 99.0)]
    two, same = report.comparison_sections(spark.createDataFrame(rows, schema)).orderBy(F.desc("named")).collect()
    assert two["title"] == "Site vs Delhi, India"
    assert two["content"].startswith("Site currently shows O3 10.0 ug/m3, NO2 30.0 ug/m3. Delhi, India currently shows O3 40.0")
    assert two["content"].endswith("is O3 +30.0 and NO2 +0.0. That means O3 is currently stronger in Delhi, India, while NO2 is stronger in Site.")
    assert same["title"] == report.SAME_TITLE and "same location: Delhi, India." in same["content"]

"""Edge rules of the table operators on small hand-made inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazegrid.operators import alerts, brief, forecast, network, resample, retrieval, sessions


def at(hour, day=1):
    return dt.datetime(2024, 1, day, hour)


POINTS = "site_id string, timestamp timestamp_ntz, o3 double, no2 double"


def test_a_wrong_year_costs_rows_but_no_array(spark):
    """A time stamp in the year 9999: all hours up to it are made, in blocks; with a longest gap none are."""
    hours = [("a", dt.datetime(2024, 1, 1, 0), 1.0), ("a", dt.datetime(2024, 1, 1, 2), 3.0), ("a", dt.datetime(9999, 12, 31, 23), 5.0), ("b", dt.datetime(1900, 1, 1), 2.0)]
    df = spark.createDataFrame(hours, "site_id string, timestamp timestamp_ntz, v double")
    expected = (dt.datetime(9999, 12, 31, 23) - dt.datetime(2024, 1, 1)) // dt.timedelta(hours=1) + 1
    assert resample.hourly_grid(df).where("site_id = 'a'").count() == expected
    near = resample.interpolate_hourly(df, ["v"]).where("timestamp < TIMESTAMP_NTZ'2024-01-01 05:00:00' AND site_id = 'a'").orderBy("timestamp")
    assert [round(r["v"], 3) for r in near.collect()] == [1.0, 2.0, 3.0, 3.0, 3.0]
    short = resample.interpolate_hourly(df, ["v"], longest_gap=24 * 366).orderBy("site_id", "timestamp").collect()
    assert [(r["site_id"], r["v"]) for r in short] == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 5.0), ("b", 2.0)]


def test_interpolation_over_blocks_equals_one_line(spark, monkeypatch):
    monkeypatch.setattr(resample, "GAP_BLOCK_HOURS", 7)
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 0.0), ("a", dt.datetime(2024, 1, 3), None), ("a", dt.datetime(2024, 1, 5), 96.0)], "site_id string, timestamp timestamp_ntz, v double")
    got = resample.interpolate_hourly(df, ["v"]).orderBy("timestamp").collect()
    assert [round(r["v"], 9) for r in got] == [float(i) for i in range(97)]
    assert [r["timestamp"] for r in got] == [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(97)]


def test_interpolation_holds_the_ends(spark):
    rows = [("a", at(0), None), ("a", at(1), 2.0), ("a", at(1), 4.0), ("a", at(4), 9.0), ("a", at(5), None), ("b", at(0), None), ("b", at(2), None)]
    df = spark.createDataFrame(rows, "site_id string, timestamp timestamp_ntz, v double")
    got = resample.interpolate_hourly(df, ["v"]).orderBy("site_id", "timestamp").collect()
    assert [r["v"] for r in got if r["site_id"] == "a"] == [3.0, 3.0, 5.0, 7.0, 9.0, 9.0]
    assert [r["v"] for r in got if r["site_id"] == "b"] == [None, None, None]


def test_alert_limits(spark):
    df = spark.createDataFrame([("a", at(1), 100.0, 79.9), ("a", at(0), 120.0, 80.0), ("b", at(0), 99.9, 96.0)], POINTS)
    found = alerts.ordered_alerts(alerts.threshold_alerts(df)).collect()
    assert [(r["site_id"], r["timestamp"].hour, r["pollutant"], r["severity"]) for r in found] == [
        ("a", 0, "O3", "critical"),
        ("a", 0, "NO2", "warning"),
        ("b", 0, "NO2", "critical"),
        ("a", 1, "O3", "warning"),
    ]
    assert {r["threshold"] for r in found} == {100.0, 80.0}


def test_lead_and_highest_alert_ties(spark):
    df = spark.createDataFrame([("a", at(2), 130.0, 0.0), ("a", at(1), 130.0, 0.0), ("a", at(0), 100.0, 80.0)], POINTS)
    found = alerts.threshold_alerts(df)
    assert alerts.lead_alert(found).first()["timestamp"] == at(1)
    assert alerts.highest_alert(found).first()["timestamp"] == at(1)
    assert [r["place"] for r in alerts.first_alerts(found, 2).orderBy("place").collect()] == [1, 2]
    sites = spark.createDataFrame([("a",), ("quiet",)], "site_id string")
    counts = {r["site_id"]: (r["critical"], r["warning"], r["info"]) for r in alerts.severity_counts(found, sites).collect()}
    assert counts == {"a": (2, 2, 0), "quiet": (0, 0, 0)}


def test_peaks_take_the_earliest(spark):
    df = spark.createDataFrame([("a", at(i), o, n) for i, (o, n) in enumerate([(1.0, 9.0), (5.0, 9.0), (5.0, 2.0)])], POINTS)
    row = forecast.peaks(forecast.lead_hours(df)).first()
    assert (row["peak_o3"], row["peak_o3_hour"], row["peak_no2"], row["peak_no2_hour"]) == (5.0, 2, 9.0, 1)
    ranked = forecast.pulse(forecast.lead_hours(df), 2).orderBy("pulse_rank").collect()
    assert [r["lead_hour"] for r in ranked] == [2, 3]


def test_horizon_default():
    assert [forecast.horizon_or_default(n) for n in (0, None, 5)] == [24, 24, 5]


def test_passthrough_and_fallback_errors(spark):
    df = spark.createDataFrame([("a", at(i), float(i), 1.0) for i in range(5)], POINTS)
    errors = spark.createDataFrame(
        [("baseline_random_forest", "O3_target", 10.0), ("baseline_random_forest", "NO2_target", 1.0), ("lstm", "O3_target", 2.0), ("lstm", "NO2_target", 3.0)],
        "model string, target string, sigma double",
    )
    got = forecast.passthrough_forecast(df, errors, "unknown", 2, "o3", "no2").orderBy("timestamp").collect()
    assert [r["o3"] for r in got] == [3.0, 4.0] and got[0]["o3_upper"] == pytest.approx(3 + 19.6)
    own = forecast.passthrough_forecast(df, errors, "lstm", 1, "o3", "no2").first()
    assert own["no2_lower"] == pytest.approx(1 - 5.88) and own["model_name"] == "lstm"
    assert forecast.model_errors(errors, "unknown", fallback=None).count() == 0


def test_reanchor_and_timeline(spark):
    points = forecast.lead_hours(spark.createDataFrame([("a", at(0), 1.0, 1.0), ("b", at(0), 1.0, 1.0)], POINTS))
    live = spark.createDataFrame([("a", at(7, 3), 2.0, 2.0)], POINTS)
    moved = {r["site_id"]: r["timestamp"] for r in forecast.reanchor(points, live).collect()}
    assert moved == {"a": at(8, 3), "b": at(0)}
    phases = [r["phase"] for r in forecast.timeline(live, points).collect()]
    assert sorted(phases) == ["forecast", "forecast", "live"]


def test_anomalies_in_order(spark):
    past = spark.createDataFrame([("a", at(0), 100.0, 80.0), ("a", at(1), 10.0, 10.0)], POINTS)
    live = spark.createDataFrame([("a", at(0), 96.0, 10.0), ("a", at(2), 95.0, 71.0)], POINTS)
    found = forecast.anomalies(past, live)
    got = sorted((r["phase_rank"], r["timestamp"].hour, r["pollutant"]) for r in found.collect())
    # Means are 75.25 and 42.75: limits max(95, 101.6) and max(70, 57.7).
    assert got == [(0, 0, "NO2"), (1, 2, "NO2")]
    assert [r["phase_rank"] for r in forecast.last_anomalies(found, 1).collect()] == [1]


def test_history_of_a_site_without_rows(spark):
    df = spark.createDataFrame([("a", at(0), 1.0, 2.0)], POINTS)
    sites = spark.createDataFrame([("a",), ("none",)], "site_id string")
    got = {r["site_id"]: (r["count"], r["avg_o3"]) for r in forecast.history_stats(df, 24, sites=sites).collect()}
    assert got == {"a": (1, 1.0), "none": (0, None)}


LOCATIONS = "key string, name string, country string, catalog_rank int, o3 double, no2 double, us_aqi double, european_aqi double"


def places(spark):
    return spark.createDataFrame(
        [("x", "X", "N", 2, 5.0, 5.0, 90.0, None), ("y", "Y", "N", 1, 4.0, 6.0, None, 90.0), ("z", "Z", "N", 0, 1.0, 1.0, None, None)], LOCATIONS
    )


def test_hotspot_ties_keep_catalog_order(spark):
    assert [r["key"] for r in network.hotspots(places(spark)).collect()] == ["y", "x", "z"]


def test_hotspot_comparison(spark):
    rows = {r["key"]: r for r in network.hotspot_comparison(places(spark), places(spark)).collect()}
    assert rows["y"]["is_hotspot"] and rows["y"]["stronger_o3"] is None
    assert (rows["x"]["stronger_o3"], rows["x"]["stronger_no2"]) == ("X", "Y")


def test_station_against_selected_city(spark):
    stations = spark.createDataFrame([("a", 1.0, 2.0, None, "x"), ("b", 5.0, 5.0, 1.0, "nowhere")], "site_id string, o3 double, no2 double, us_aqi double, selected_key string")
    rows = {r["site_id"]: r for r in network.station_city_comparison(stations, places(spark)).collect()}
    assert (rows["a"]["o3_delta"], rows["a"]["aqi_delta"], rows["a"]["separator"]) == (4.0, 90.0, "O3")
    assert rows["b"]["city_key"] is None
    # Equal distances: nitrogen dioxide is named.
    even = spark.createDataFrame([("c", 3.0, 5.0, None)], "site_id string, o3 double, no2 double, us_aqi double")
    assert network.station_city_comparison(even, places(spark)).first()["separator"] == "NO2"


def test_scope_and_catalog(spark):
    catalog = network.place_catalog(spark)
    assert network.network_scope(catalog, "india").count() == 10
    world = network.network_scope(catalog, "global").orderBy("scope_rank").collect()
    assert [r["key"] for r in world][:4] == ["delhi", "mumbai", "bengaluru", "london"] and len(world) == 11


def test_fallback_tiers(spark):
    def tier(*rows):
        return spark.createDataFrame(list(rows), POINTS)

    live = network.live_with_fallback(
        {"external": tier(("a", at(1), 1.0, 1.0)), "cached": tier(("a", at(2), 2.0, 2.0), ("b", at(1), 3.0, 3.0)), "fallback": tier(("b", at(3), 4.0, 4.0), ("c", at(0), 5.0, 5.0))}
    )
    got = {r["site_id"]: (r["provider"], r["fallback_used"], r["o3"]) for r in live.collect()}
    assert got == {"a": ("openmeteo", False, 1.0), "b": ("openmeteo_cache", True, 3.0), "c": ("simulation", True, 5.0)}


QUERIES = [("q1", "red fox jumps", "quick"), ("q2", "blue sky", "standard"), ("q3", "", "deep"), ("q4", "the the fox", "deep")]
SOURCES = [(i, t, c) for i, (t, c) in enumerate([("the red fox", 0.7), ("blue BLUE sky", 0.9), ("", 0.95), ("fox sky the", 0.7), ("unrelated words here", 0.9)] * 6)]


def brute_force():
    sizes = {"quick": 6, "standard": 10, "deep": 14}
    expected = set()
    for qid, q, depth in QUERIES:
        a = set(q.lower().split())
        scored = []
        for sid, t, c in SOURCES:
            b = set(t.lower().split())
            s = len(a & b) / (len(a) ** 0.5 * len(b) ** 0.5) if a and b else 0.0
            scored.append((-(s + c * 0.25), sid))
        expected |= {(qid, sid, i + 1) for i, (_, sid) in enumerate(sorted(scored)[: sizes[depth]])}
    return expected


def test_ranking_equals_brute_force(spark):
    asked = spark.createDataFrame(QUERIES, "query_id string, text string, depth string")
    corpus = spark.createDataFrame(SOURCES, "source_id long, text string, credibility double").repartition(3)
    ranked = retrieval.rank_evidence(asked, corpus)
    assert {(r["query_id"], r["source_id"], r["rank"]) for r in ranked.collect()} == brute_force()


@pytest.mark.parametrize("probed", [0, 5, 200])
def test_ranking_with_a_word_in_every_source(spark, monkeypatch, probed):
    """The bound changes the work only; one word is in all sources, sizes and credibilities vary."""
    import random

    monkeypatch.setattr(retrieval, "PROBED_SOURCES", probed)
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    corpus = [(i, " ".join(["the", *r.choices(words, k=r.choice([1, 3, 9, 40]))]), r.choice([0.5, 0.7, 0.9])) for i in range(300)]
    asked = [(f"q{i}", " ".join(["the", *r.sample(words, r.choice([1, 4, 12]))]), r.choice(["quick", "standard", "deep"])) for i in range(12)]
    asked += [("common", "the", "deep"), ("none", "absent words", "quick"), ("empty", "", "quick")]
    expected = set()
    for name, text, depth in asked:
        q = set(text.split())
        scores = []
        for i, t, c in corpus:
            t = set(t.split())
            scores.append((-(len(q & t) / (len(q) ** 0.5 * len(t) ** 0.5) if q else 0.0) - 0.25 * c, i))
        keep = retrieval.RANKED_BY_DEPTH[depth]
        expected |= {(name, i) for _, i in sorted((round(s, 9), i) for s, i in scores)[:keep]}
    ranked = retrieval.rank_evidence(
        spark.createDataFrame(asked, "query_id string, text string, depth string"),
        spark.createDataFrame(corpus, "source_id long, text string, credibility double"),
    )
    assert {(x["query_id"], x["source_id"]) for x in ranked.collect()} == expected


def test_pairs_scored_do_not_grow_with_the_corpus(spark, monkeypatch):
    """Words as uneven as in prose: four times the sources, about as many pairs that need all their words."""
    import random

    r = random.Random(2)
    words, weights = [f"w{i}" for i in range(3000)], [1 / (i + 1) for i in range(3000)]
    texts = lambda n, sizes: [(i, " ".join(r.choices(words, weights, k=r.choice(sizes)))) for i in range(n)]
    asked = spark.createDataFrame([(i, t, "deep") for i, t in texts(12, [30, 60])], "query_id int, text string, depth string")
    sources, likely, counts = texts(3200, [5, 40, 120, 300]), retrieval._likely_pairs, []
    monkeypatch.setattr(retrieval, "_likely_pairs", lambda *args: counts.append(likely(*args)) or counts[-1])
    for n in (800, 3200):
        corpus = spark.createDataFrame([(i, t, 0.7 + 0.2 * (i % 2)) for i, t in sources[:n]], "source_id int, text string, credibility double")
        assert retrieval.rank_evidence(asked, corpus).count() == 12 * 14
    small, large = (df.count() / 12 for df in counts)
    assert large <= 2 * max(small, 14) and large < 0.05 * 3200, (small, large)


def test_pinned_source(spark):
    asked = spark.createDataFrame([("q", "quick"), ("p", "quick")], "query_id string, depth string")
    ranked = spark.createDataFrame([(q, i, i) for q in "pq" for i in range(1, 7)], "query_id string, source_id int, rank int")
    pins = spark.createDataFrame([("q", 6), ("p", 2)], "query_id string, source_id int")
    got = retrieval.shortlist(ranked, asked, pins).orderBy("query_id", "place").collect()
    assert [r["source_id"] for r in got if r["query_id"] == "q"] == [6, 1, 2, 3]
    assert [r["source_id"] for r in got if r["query_id"] == "p"] == [1, 2, 3, 4]


def test_place_mention(spark):
    catalog = spark.createDataFrame(
        [("Delhi", "India", 0), ("New Delhi", "India", 1), ("Rome", None, 2), ("Ro", "X", 3), ("Pune", "India", 4), ("Oslo", "Norway", 5)],
        "name string, country string, catalog_rank int",
    )
    texts = spark.createDataFrame([(1, "in NEW DELHI and delhi"), (2, "aerodrome"), (3, "to ro or not"), (4, "nothing"), (5, "oslo and pune"), (6, "")], "id int, text string")
    got = {r["id"]: r["place"] for r in retrieval.mentioned_place(texts, catalog).collect()}
    assert got == {1: "New Delhi, India", 2: "Rome", 3: "Ro, X", 4: None, 5: "Pune, India", 6: None}


def conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Message {i}") for i in range(7)] + [(2, 0, "system", "setup")]
    return spark.createDataFrame(rows, "session_id int, created_at int, role string, content string")


def test_session_detail_in_pages(spark):
    said = conversation(spark)
    told = said.where("role = 'assistant'").selectExpr("session_id", "created_at", "content AS payload", "concat('r', created_at) AS report_id")
    detail = sessions.session_detail(sessions.sessions_from_messages(said), said, told, told, page_rows=3)
    rows = detail.where("session_id = 1").orderBy("page").collect()
    assert [len(r["messages"]) for r in rows] == [3, 3, 1]
    assert [p["created_at"] for p in rows[1]["reports"]] == [5, 3]
    assert detail.where("session_id = 2").first()["reports"] is None


def test_sessions_are_removed_by_their_own_user_only(spark):
    said = conversation(spark).withColumn("user_id", F.concat(F.lit("u"), F.col("session_id")))
    told = said.where("role = 'assistant'").selectExpr("session_id", "created_at", "content AS payload", "concat('r', created_at) AS report_id")
    listed = sessions.sessions_from_messages(said)
    assert {r["user_id"] for r in listed.collect()} == {"u1", "u2"} and sessions.of_user(listed, "u1").count() == 1
    asked = spark.createDataFrame([(1, "u2"), (2, "u2"), (2, "u2")], "session_id int, user_id string")
    kept = sessions.remove_sessions(asked, listed, said, told, told, told.select("report_id"))
    assert [r["session_id"] for r in kept["sessions"].collect()] == [1] and kept["messages"].count() == 7 and kept["reports"].count() == 3
    nodes = {(r["user_id"], r["node_id"]) for r in sessions.graph_nodes(listed).collect()}
    assert ("u2", "session:2") in nodes and ("u1", "session:2") not in nodes


def test_search_and_order(spark):
    listed = sessions.sessions_from_messages(conversation(spark))
    assert sessions.search_sessions(listed, "   ").count() == 2
    assert [r["session_id"] for r in sessions.search_sessions(listed, "SYSTEM").collect()] == [2]
    assert [r["session_id"] for r in sessions.session_list(listed).collect()] == [2, 1]
    assert listed.where("session_id = 2").first()["title"] == "New research session"


def test_graph_keeps_edges_and_merges_nodes(spark):
    listed = spark.createDataFrame([(1, "A", "brief", ["t", "t"]), (2, "B", "brief", ["t"])], "session_id int, title string, mode string, tags array<string>")
    assert sessions.graph_edges(listed).count() == 5
    assert sorted(r["node_id"] for r in sessions.graph_nodes(listed).collect()) == ["mode:brief", "session:1", "session:2", "tag:t"]


def test_payloads(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("broken",), (None,)], "payload_json string")
    assert [r["p"] and r["p"]["a"] for r in sessions.parse_payload(df, "payload_json", "a INT", "p").collect()] == [1, None, None]


def test_removal(spark):
    said = conversation(spark)
    reports = spark.createDataFrame([("r1", 1), ("r2", 2)], "report_id string, session_id int")
    steps = spark.createDataFrame([("s1", "r1"), ("s2", "r2")], "step_id string, report_id string")
    kept = sessions.remove_sessions(said.where("session_id = 1"), sessions.sessions_from_messages(said), said, reports, steps, steps)
    assert {name: df.count() for name, df in kept.items()} == {"sessions": 1, "messages": 1, "reports": 1, "steps": 1, "feedback": 1}


def test_texts_for_nothing(spark):
    sites = spark.createDataFrame([("a",)], "site_id string")
    none = alerts.first_alerts(alerts.threshold_alerts(spark.createDataFrame([("a", at(0), 0.0, 0.0)], POINTS)), 10)
    assert brief.alerts_text(none, sites).first()["alerts_text"] == "No current threshold exceedance alerts were generated."
    empty = places(spark).where("false")
    assert brief.network_text(network.hotspots(empty), "india").first()[0] == "No live network locations are currently available."
    stats = forecast.history_stats(spark.createDataFrame([], POINTS), 24, sites=sites)
    assert brief.history_text(stats).first()["history_text"] == "No historical trend points are available."


def test_live_and_visible_text(spark):
    snapshot = spark.createDataFrame([("a", at(5), 2.25, 3.0, "openmeteo", "Feed", False)], POINTS + ", provider string, source_label string, fallback_used boolean")
    assert brief.live_text(snapshot).first()["live_text"] == (
        "Live station feed provider is openmeteo. Current O3 is 2.2 ug/m3 and current NO2 is 3.0 ug/m3. "
        "Source label: Feed. Fallback used: False. Last updated: 2024-01-01T05:00:00."
    )
    visible = spark.createDataFrame([("a", "Site 1", 5.5)], "site_id string, station_label string, visible_o3 double")
    told = brief.visible_text(visible).first()["visible_text"]
    assert "Station Site 1; selected timestamp sync pending" in told and "visible O3 5.5 ug/m3; visible NO2 n/a ug/m3" in told

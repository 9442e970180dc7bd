"""Column expressions on the registered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog.joins import BRIEF, PLACES, places
from hazegrid.catalog.projections import CLEAN, INTENT, TITLE, _with
from hazegrid.catalog.rankings import ANOMALIES, CORPUS, RANKED, TOKENS, anomalies, evidence_corpus, evidence_queries
from hazegrid.catalog.registry import query
from hazegrid.catalog.tables import documents as text_table
from hazegrid.catalog.tables import EV, HOURLY, coordinates, hourly, observations, stored_hours, table
from hazegrid.catalog.windows import FORECAST_TAIL
from hazegrid.functions import risk, text, vectors
from hazegrid.operators import alerts, brief, evidence, forecast, joins, network, quality, retrieval, series
from hazegrid.session import materialize


@query(
    "h1_risk_label",
    f"""WITH {EV} SELECT event_id, CASE WHEN o3 >= 140 OR no2 >= 110 THEN 'High risk' WHEN o3 >= 95 OR no2 >= 70 THEN 'Elevated'
      ELSE 'Stable' END AS risk FROM ev""",
)
def h1_risk_label(spark, folder):
    return observations(spark, folder).select("event_id", risk.risk_label(F.col("o3"), F.col("no2")).alias("risk"))


THRESHOLD_ALERTS = f"""WITH {EV} SELECT site_id, "timestamp", 'O3' AS pollutant, 'Projected O3 spike exceeds configured threshold.' AS message,
      o3 AS value, 100.0::DOUBLE AS threshold, CASE WHEN o3 >= 100.0::DOUBLE * 1.2::DOUBLE THEN 'critical' ELSE 'warning' END AS severity FROM ev WHERE o3 >= 100
    UNION ALL SELECT site_id, "timestamp", 'NO2', 'Projected NO2 spike exceeds configured threshold.', no2, 80.0::DOUBLE,
      CASE WHEN no2 >= 80.0::DOUBLE * 1.2::DOUBLE THEN 'critical' ELSE 'warning' END FROM ev WHERE no2 >= 80"""


@query("h2_threshold_alerts", THRESHOLD_ALERTS)
def h2_threshold_alerts(spark, folder):
    return alerts.threshold_alerts(observations(spark, folder)).drop("pollutant_rank")


@query(
    "h3_confidence_band",
    f"""WITH {EV}, s AS (SELECT site_id, round(stddev_pop(o3), 6) AS sigma FROM ev GROUP BY 1)
      SELECT event_id, round(o3 - 1.96::DOUBLE * sigma, 6) AS lower, round(o3 + 1.96::DOUBLE * sigma, 6) AS upper
      FROM ev JOIN s ON ev.site_id = s.site_id""",
)
def h3_confidence_band(spark, folder):
    df = observations(spark, folder)
    sigmas = materialize(df.groupBy("site_id").agg(F.round(F.stddev_pop("o3"), 6).alias("sigma")), "sigmas")
    lower, upper = risk.band(F.col("o3"), F.col("sigma"))
    return df.join(sigmas, "site_id").select(
        "event_id", F.round(lower, 6).alias("lower"), F.round(upper, 6).alias("upper")
    )


@query(
    "h4_aqi_pressure",
    f"""WITH {EV}, a AS (SELECT event_id, CASE WHEN o3 >= 20 THEN o3 END AS us, nullif(no2, 0) AS eu FROM ev),
      p AS (SELECT *, greatest(coalesce(us, 0), coalesce(eu, 0)) AS pressure FROM a)
      SELECT event_id, pressure, coalesce(us, eu) AS shown,
        CASE WHEN pressure >= 160 THEN 'severe' WHEN pressure >= 120 THEN 'high' WHEN pressure >= 80 THEN 'moderate' ELSE 'low' END AS tone FROM p""",
)
def h4_aqi_pressure(spark, folder):
    us, eu = F.when(F.col("o3") >= 20, F.col("o3")), F.nullif("no2", F.lit(0.0))
    pressure = risk.aqi_pressure(us, eu)
    return observations(spark, folder).select(
        "event_id", pressure.alias("pressure"), risk.shown_aqi(us, eu).alias("shown"), risk.pressure_tone(pressure).alias("tone")
    )


def with_baseline(spark, folder):
    """Readings with the mean of their site; one site has none."""
    df = observations(spark, folder)
    means = forecast.baseline_averages(df, order=("timestamp", "event_id")).where("site_id <> 'error'")
    means = means.withColumns({name: F.round(name, 6) for name in ("o3_avg", "no2_avg")})
    # Written, so that the join sees how small it is and leaves the readings where they are.
    return df.join(materialize(means, "means"), "site_id", "left")


BASED = f"""{EV}, means AS (SELECT site_id AS s, round(avg(o3), 6) AS o3_avg, round(avg(no2), 6) AS no2_avg FROM (
    SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC, event_id DESC) <= 72)
  WHERE site_id <> 'error' GROUP BY 1), based AS (SELECT * FROM ev LEFT JOIN means ON site_id = s)"""


@query(
    "h5_trend_direction",
    f"""WITH {BASED} SELECT event_id, CASE WHEN o3_avg IS NULL THEN 'unknown' WHEN abs(o3 - o3_avg) < 5 THEN 'stable'
      WHEN o3 > o3_avg THEN 'rising' ELSE 'falling' END AS direction FROM based""",
)
def h5_trend_direction(spark, folder):
    direction = risk.trend_direction(F.col("o3"), F.col("o3_avg"))
    return with_baseline(spark, folder).select("event_id", direction.alias("direction"))


@query(
    "h6_strongest_driver",
    f"""WITH {BASED} SELECT event_id, CASE WHEN abs(o3 - coalesce(o3_avg, 0)) >= abs(no2 - coalesce(no2_avg, 0)) THEN 'O3'
      ELSE 'NO2' END AS driver FROM based""",
)
def h6_strongest_driver(spark, folder):
    driver = risk.strongest_driver(F.col("o3"), F.col("no2"), F.col("o3_avg"), F.col("no2_avg"))
    return with_baseline(spark, folder).select("event_id", driver.alias("driver"))


@query(
    "h7_pulse_score",
    f"WITH {EV} SELECT event_id, round(o3 * 0.65::DOUBLE + no2 * 0.35::DOUBLE, 6) AS score FROM ev",
)
def h7_pulse_score(spark, folder):
    return observations(spark, folder).select("event_id", F.round(risk.pulse_score(F.col("o3"), F.col("no2")), 6).alias("score"))


@query(
    "h8_anomaly_flags",
    f"""{ANOMALIES} SELECT site_id, event_id, "timestamp", pollutant, value FROM found""",
)
def h8_anomaly_flags(spark, folder):
    return anomalies(spark, folder).select("site_id", "event_id", "timestamp", "pollutant", "value")


@query(
    "h9_watch_driver",
    f"""WITH {BASED} SELECT event_id, CASE
        WHEN abs(coalesce(no2 - no2_avg, 0)) > abs(coalesce(o3 - o3_avg, 0)) THEN 'NO2'
        WHEN greatest(60.0, o3) >= greatest(55.0, no2) THEN 'O3' ELSE 'NO2' END AS driver FROM based""",
)
def h9_watch_driver(spark, folder):
    driver = risk.watch_driver(
        F.col("o3"), F.col("no2"), F.col("o3_avg"), F.col("no2_avg"), F.lit(60.0), F.lit(55.0)
    )
    return with_baseline(spark, folder).select("event_id", driver.alias("driver"))


@query(
    "h10_leading_pollutant",
    f"""{FORECAST_TAIL} SELECT site_id, CASE WHEN max(o3) >= max(no2) THEN 'O3' ELSE 'NO2' END AS leading FROM forecast GROUP BY 1""",
)
def h10_leading_pollutant(spark, folder):
    found = forecast.peaks(forecast.lead_hours(series.latest_rows(hourly(spark, folder), 24)))
    leading = risk.leading_pollutant(F.col("peak_o3"), F.col("peak_no2"))
    return found.select("site_id", leading.alias("leading"))


@query(
    "h11_band_span",
    f"WITH {EV} SELECT event_id, round(greatest(o3 - no2, 0), 6) AS span FROM ev",
)
def h11_band_span(spark, folder):
    return observations(spark, folder).select("event_id", F.round(risk.band_span(F.col("no2"), F.col("o3")), 6).alias("span"))


@query(
    "h12_number_text",
    f"""WITH {BASED} SELECT event_id, printf('%.1f', o3) AS o3, coalesce(printf('%.1f', o3_avg), 'n/a') AS o3_avg,
      coalesce(CASE WHEN o3 - o3_avg >= 0 THEN '+' ELSE '' END || printf('%.1f', o3 - o3_avg), 'n/a') AS o3_delta FROM based""",
)
def h12_number_text(spark, folder):
    return with_baseline(spark, folder).select(
        "event_id",
        text.number_text(F.col("o3")).alias("o3"),
        text.number_text(F.col("o3_avg")).alias("o3_avg"),
        text.signed_text(F.col("o3") - F.col("o3_avg")).alias("o3_delta"),
    )


@query(
    "h13_safe_double",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events""",
)
def h13_safe_double(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        text.safe_double(F.get_json_object("props", "$.k")).alias("k"),
        text.safe_double(F.col("event_type")).alias("bad"),
    )


EVIDENCE_SENTENCE = (
    "Current O3 is {o3} ug/m3 and current NO2 at {no2} ug/m3. Average O3 is {no2} and average NO2 is {o3}. "
    "Peak O3 is {o3} ug/m3 at {at}. Peak NO2 is {no2} ug/m3 at {at}."
)


@query(
    "h14_extract_numbers",
    f"""WITH {EV}, t AS (SELECT event_id, 'Current O3 is ' || printf('%.1f', o3) || ' ug/m3 and current NO2 at ' || printf('%.1f', no2) ||
        ' ug/m3. Average O3 is ' || printf('%.1f', no2) || ' and average NO2 is ' || printf('%.1f', o3) || '. Peak O3 is ' ||
        printf('%.1f', o3) || ' ug/m3 at ' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '. Peak NO2 is ' || printf('%.1f', no2) ||
        ' ug/m3 at ' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '.' AS t FROM ev)
      SELECT event_id,
        CAST(regexp_extract(t, 'O3(?: is| at)?\\s+([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS o3,
        CAST(regexp_extract(t, 'NO2(?: is| at)?\\s+([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS no2,
        CAST(regexp_extract(t, 'Average O3 is\\s+([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS avg_o3,
        CAST(regexp_extract(t, '(?i)average NO2 is\\s+([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS avg_no2,
        CAST(regexp_extract(t, 'Peak O3 is\\s+([0-9]+(?:\\.[0-9]+)?)\\s+ug/m3 at\\s+([0-9T:\\-+.]+)', 1) AS DOUBLE) AS peak_o3,
        regexp_extract(t, 'Peak O3 is\\s+([0-9]+(?:\\.[0-9]+)?)\\s+ug/m3 at\\s+([0-9T:\\-+.]+)', 2) AS peak_o3_time,
        CAST(regexp_extract(t, 'Peak NO2 is\\s+([0-9]+(?:\\.[0-9]+)?)\\s+ug/m3 at\\s+([0-9T:\\-+.]+)', 1) AS DOUBLE) AS peak_no2,
        regexp_extract(t, 'Peak NO2 is\\s+([0-9]+(?:\\.[0-9]+)?)\\s+ug/m3 at\\s+([0-9T:\\-+.]+)', 2) AS peak_no2_time
      FROM t""",
)
def h14_extract_numbers(spark, folder):
    sentence = brief.sentence(
        EVIDENCE_SENTENCE,
        o3=text.fixed_text(F.col("o3")),
        no2=text.fixed_text(F.col("no2")),
        at=F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"),
    )
    told = observations(spark, folder).select("event_id", sentence.alias("t"))
    found = {**text.pollutant_values(F.col("t")), **text.forecast_peaks(F.col("t"))}
    return told.select("event_id", *[column.alias(name) for name, column in found.items()])


@query(
    "h15_lexical_similarity",
    f"""WITH w AS (SELECT conv_id, turn, {TOKENS} AS b FROM conversations),
      p AS (SELECT conv_id, turn, b, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM w)
      SELECT conv_id, turn, CASE WHEN len(a) > 0 AND len(b) > 0
        THEN round(len(list_intersect(a, b)) / (sqrt(len(a)) * sqrt(len(b))), 9) ELSE 0 END AS similarity FROM p WHERE a IS NOT NULL""",
)
def h15_lexical_similarity(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("words"))
    # Numbered by a range sort: the turn before is the one with the next smaller number, gaps or not.
    numbered = series.index_rows(turns, ["conv_id"], ["turn"])
    before = numbered.select("conv_id", (F.col(series.ROW) + 1).alias(series.ROW), F.col("words").alias("before"))
    similarity = text.lexical_similarity(F.col("before"), F.col("words"))
    return numbered.join(before, ["conv_id", series.ROW]).select("conv_id", "turn", F.round(similarity, 9).alias("similarity"))


@query(
    "h16_embedding_similarity",
    """WITH a AS (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY 1)
      SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(anchor AS DOUBLE[])), 6) AS similarity
      FROM embeddings e JOIN a ON e.label = a.label""",
)
def h16_embedding_similarity(spark, folder):
    """Every vector against the first vector of its label."""
    stored = table(spark, folder, "embeddings").withColumn("size", vectors.norm(F.col("embedding")))
    anchors = series.top_rows(stored, ["label"], [F.asc("vec_id")], 1, ["vec_id"]).select(
        "label", F.col("embedding").alias("anchor"), F.col("size").alias("anchor_size")
    )
    similarity = vectors.cosine(F.col("embedding"), F.col("anchor"), F.col("size"), F.col("anchor_size"))
    return stored.join(materialize(anchors, "anchors"), "label").select("vec_id", F.round(similarity, 6).alias("similarity"))


@query(
    "h17_source_description",
    f"""WITH {CORPUS} SELECT source_id, md5(substring(text, 1, 480)) AS snippet, source_type || '-' ||
      CASE WHEN credibility >= 0.9 THEN 'high' WHEN credibility >= 0.75 THEN 'medium' ELSE 'exploratory' END AS cluster FROM corpus""",
)
def h17_source_description(spark, folder):
    described = retrieval.describe_sources(evidence_corpus(spark, folder))
    return described.select("source_id", F.md5("snippet").alias("snippet"), "cluster")


@query(
    "h18_query_intent",
    f"""SELECT 'd' || doc_id AS id, {_with(INTENT, 'text')} AS intent FROM documents
      UNION ALL SELECT 'c' || conv_id || '-' || turn, {_with(INTENT, 'text')} FROM conversations""",
)
def h18_query_intent(spark, folder):
    documents = text_table(spark, folder).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text"
    )
    return documents.unionByName(turns).select("id", text.intent(F.col("text")).alias("intent"))


INTENT_CASES = {
    "title": {**text.INTENT_TITLES, "brief": "Standard Mode intelligence brief"},
    "sections": {name: ",".join(keys) for name, keys in text.INTENT_SECTIONS.items()},
    "follow_up": text.INTENT_FOLLOW_UPS,
}


@query(
    "h19_intent_report",
    f"WITH i AS (SELECT doc_id, {_with(INTENT, 'text')} AS intent FROM documents) SELECT doc_id, "
    + ", ".join(
        "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cases.items()) + f" END AS {name}"
        for name, cases in INTENT_CASES.items()
    )
    + " FROM i",
)
def h19_intent_report(spark, folder):
    intents = text_table(spark, folder).select("doc_id", text.intent(F.col("text")).alias("intent"))
    intent = F.col("intent")
    return intents.select(
        "doc_id",
        text.intent_title(intent, F.lit("standard mode")).alias("title"),
        F.array_join(text.intent_sections(intent), ",").alias("sections"),
        text.intent_follow_up(intent).alias("follow_up"),
    )


@query(
    "h20_query_cleaning",
    f"""WITH q AS (SELECT conv_id, turn, {_with(CLEAN, "(E' \\n' || text || E'\\n\\nContext:\\n- Site ' || turn)")} AS q FROM conversations)
      SELECT conv_id, turn, md5(q) AS cleaned, {_with(TITLE, 'q')} AS title FROM q""",
)
def h20_query_cleaning(spark, folder):
    asked = F.concat(F.lit(" \n"), "text", F.lit("\n\nContext:\n- Site "), "turn")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", text.clean_query(asked).alias("q"))
    return turns.select("conv_id", "turn", F.md5("q").alias("cleaned"), text.session_title(F.col("q")).alias("title"))


@query(
    "h21_place_mention",
    """WITH t AS (SELECT doc_id, text || ' seen near nation_' || n_chars % 60 AS t FROM documents)
      SELECT t.doc_id, m.label AS place FROM t LEFT JOIN (
        SELECT doc_id, n_name || ', ' || r_name AS label FROM t, nation JOIN region ON n_regionkey = r_regionkey
        WHERE contains(lower(t), lower(n_name))
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(n_name) DESC, n_nationkey) = 1) m ON t.doc_id = m.doc_id""",
)
def h21_place_mention(spark, folder):
    region = table(spark, folder, "region")
    nation = table(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    catalog = nation.select(
        F.col("n_name").alias("name"), F.col("r_name").alias("country"), F.col("n_nationkey").alias("catalog_rank")
    )
    said = F.concat("text", F.lit(" seen near nation_"), F.col("n_chars") % 60)
    texts = text_table(spark, folder).select("doc_id", said.alias("text"))
    return retrieval.mentioned_place(texts, catalog).select("doc_id", "place")


@query(
    "h22_json_columns",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        '{"tags":["' || event_type || '","u' || user_id || '"]}' AS payload, event_type AS first_tag FROM events""",
)
def h22_json_columns(spark, folder):
    events = table(spark, folder, "events")
    typed = events.withColumn("_p", F.from_json("props", "k BIGINT"))
    payload = F.to_json(F.struct(F.array("event_type", F.concat(F.lit("u"), "user_id")).alias("tags")))
    back = F.from_json("payload", "tags ARRAY<STRING>")
    return typed.withColumn("payload", payload).select(
        "event_id", F.col("_p.k").alias("k"), "payload", F.get(back["tags"], F.lit(0)).alias("first_tag")
    )


SITE_TEXTS = f"""{BRIEF}, hist AS (SELECT site_id, count(*) AS n, avg(o3) AS o, avg(no2) AS x, min("timestamp") AS a, max("timestamp") AS z
        FROM (SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC) <= 168) GROUP BY 1),
      cells10 AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY "timestamp", r) AS place FROM (
          SELECT site_id, "timestamp", 'O3' AS pollutant, 0 AS r, o3 AS value, 60.0 AS thr FROM back WHERE b <= 12 AND o3 >= 60
          UNION ALL SELECT site_id, "timestamp", 'NO2', 1, no2, 50.0 FROM back WHERE b <= 12 AND no2 >= 50) QUALIFY place <= 10),
      lines AS (SELECT site_id, string_agg(pollutant || ' ' || CASE WHEN value >= thr * 1.2 THEN 'critical' ELSE 'warning' END || ' at site ' || site_id ||
          ': Projected ' || pollutant || ' spike exceeds configured threshold. value ' || printf('%.1f', value) || ' threshold ' ||
          printf('%.1f', CAST(thr AS DOUBLE)), ' ' ORDER BY place) AS t FROM cells10 GROUP BY 1)
      SELECT w.site_id,
        'Recent history for site ' || w.site_id || ' spans ' || n || ' hours. Average O3 is ' || printf('%.1f', o) || ' and average NO2 is ' ||
          printf('%.1f', x) || '. First timestamp ' || strftime(a, '%Y-%m-%dT%H:%M:%S') || ', last timestamp ' || strftime(z, '%Y-%m-%dT%H:%M:%S') || '.' AS history_text,
        'Forecast model lstm generated 24 hourly points. Peak O3 is ' || printf('%.1f', o3_peak) || ' ug/m3 at forecast hour +' || peak_o3_hour ||
          '. Peak NO2 is ' || printf('%.1f', no2_peak) || ' ug/m3 at forecast hour +' || peak_no2_hour || '.' AS forecast_text,
        coalesce(l.t, 'No current threshold exceedance alerts were generated.') AS alerts_text,
        'Selected site ' || w.site_id || ' is located at ' || latitude || ', ' || longitude || '. The dataset contains ' ||
          (SELECT count(DISTINCT site_id) FROM ev) || ' sites, ' || (SELECT count(*) FROM ev WHERE dataset_split = 'train') || ' train rows, and ' ||
          (SELECT count(*) FROM ev WHERE dataset_split = 'unseen') || ' unseen rows. Features include no2. Targets are o3.' AS dataset_text
      FROM wide w JOIN hist h ON w.site_id = h.site_id LEFT JOIN lines l ON w.site_id = l.site_id"""


@query("h23_site_texts", SITE_TEXTS)
def h23_site_texts(spark, folder):
    hours = stored_hours(spark, folder)
    df = joins.with_coordinates(observations(spark, folder), coordinates(spark))
    summary = quality.site_summary(df)
    totals = quality.dataset_totals(df, ["no2"], ["o3"])
    stats = forecast.history_stats(hours, 168)
    peaks = forecast.peaks(forecast.lead_hours(series.latest_rows(hours, 24)))
    first = alerts.first_alerts(alerts.threshold_alerts(series.latest_rows(hours, 12), 60.0, 50.0), 10)
    return (
        brief.history_text(stats)
        .join(brief.forecast_text(peaks, "lstm", 24), "site_id")
        .join(brief.alerts_text(first, summary), "site_id")
        .join(brief.dataset_text(summary, totals), "site_id")
    )


NETWORK_TEXT = f"""WITH {PLACES}, top AS (SELECT *, greatest(coalesce(us_aqi, 0), coalesce(european_aqi, 0)) AS pressure FROM places
        ORDER BY pressure DESC, catalog_rank LIMIT 8)
      SELECT 'Live network scope is global. ' || string_agg(name || ' ' || country || ' O3 ' || printf('%.1f', o3) || ' NO2 ' || printf('%.1f', no2) ||
        ' modeled US AQI ' || printf('%.0f', coalesce(us_aqi, 0)), ' ' ORDER BY pressure DESC, catalog_rank) AS network_text FROM top"""


@query("h23_network_text", NETWORK_TEXT)
def h23_network_text(spark, folder):
    return brief.network_text(network.hotspots(places(spark, folder)), "global")


EVIDENCE = f"""st AS ({SITE_TEXTS}), nt AS ({NETWORK_TEXT}), lt AS (WITH {HOURLY}
    SELECT site_id, o3, no2, "timestamp" FROM hourly QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC) = 1),
  evidence AS (
    SELECT site_id, 'dataset_summary' AS chunk_id, 'Dataset summary' AS title, 'dataset' AS source_type, dataset_text AS text, 0.95::DOUBLE AS credibility, '' AS metadata FROM st
    UNION ALL SELECT site_id, 'live_station', 'Current station conditions', 'live',
      'Live station feed provider is station. Current O3 is ' || printf('%.1f', o3) || ' ug/m3 and current NO2 is ' || printf('%.1f', no2) ||
      ' ug/m3. Source label: Hourly mean. Fallback used: False. Last updated: ' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '.', 0.95, 'provider=station' FROM lt
    UNION ALL SELECT site_id, 'forecast_station', 'Forecast outlook', 'forecast', forecast_text, 0.92, 'horizon_hours=24;model_name=lstm' FROM st
    UNION ALL SELECT site_id, 'alerts', 'Alert state', 'alerts', alerts_text, 0.9, '' FROM st
    UNION ALL SELECT site_id, 'historical_recent', 'Recent historical behavior', 'historical', history_text, 0.88, '' FROM st
    UNION ALL SELECT site_id, 'live_network', 'Live network', 'network', network_text, 0.86, 'scope=global' FROM st, nt)"""


def site_evidence(spark, folder):
    texts = materialize(h23_site_texts(spark, folder), "site-texts")
    newest = series.latest_per_key(stored_hours(spark, folder), ["site_id"], ["timestamp"]).withColumns(
        {"provider": F.lit("station"), "source_label": F.lit("Hourly mean"), "fallback_used": F.lit(False)}
    )
    network = h23_network_text(spark, folder).select("network_text").scalar()
    return evidence.evidence_table(
        {
            "dataset_summary": texts.select("site_id", F.col("dataset_text").alias("text")),
            "live_station": brief.live_text(newest).select("site_id", F.col("live_text").alias("text"), F.lit("station").alias("provider")),
            "forecast_station": texts.select(
                "site_id", F.col("forecast_text").alias("text"), F.lit(24).alias("horizon_hours"), F.lit("lstm").alias("model_name")
            ),
            "alerts": texts.select("site_id", F.col("alerts_text").alias("text")),
            "historical_recent": texts.select("site_id", F.col("history_text").alias("text")),
            "live_network": texts.select("site_id", network.alias("text"), F.lit("global").alias("scope")),
        }
    )


@query("h23_evidence_table", f"""WITH {EVIDENCE} SELECT site_id, chunk_id, title, source_type, text, credibility, metadata FROM evidence""")
def h23_evidence_table(spark, folder):
    fact = lambda e: F.concat_ws("=", e["key"], e["value"])
    facts = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), fact)), ";")
    return site_evidence(spark, folder).withColumn("metadata", facts)


EVIDENCE_RANKED = RANKED.replace(
    CORPUS,
    f"""{EVIDENCE}, {CORPUS.replace("corpus AS", "written AS", 1)}, corpus AS (
      SELECT site_id || ':' || chunk_id AS source_id, text, source_type, credibility FROM evidence
      UNION ALL SELECT 'document:' || source_id, text, source_type, credibility FROM written)""",
)


@query(
    "h23_evidence_ranked",
    f"""WITH {EVIDENCE_RANKED} SELECT query_id, source_id, round(similarity, 9) AS similarity, round(score, 9) AS score, rank FROM ranked""",
)
def h23_evidence_ranked(spark, folder):
    written = evidence_corpus(spark, folder).withColumnRenamed("source_id", "doc_id")
    sources = materialize(evidence.as_sources(site_evidence(spark, folder), written), "evidence")
    ranked = retrieval.rank_evidence(evidence_queries(spark, folder), sources)
    return ranked.withColumns({"similarity": F.round("similarity", 9), "score": F.round("score", 9)})


@query(
    "h23_evidence_digest",
    f"""WITH {RANKED}, kept AS (SELECT r.query_id, r.source_id, rank, text FROM ranked r JOIN corpus c ON r.source_id = c.source_id
        WHERE rank <= CASE depth WHEN 'quick' THEN 4 WHEN 'standard' THEN 6 ELSE 9 END)
      SELECT query_id, md5(string_agg('[' || source_id || '] Document ' || source_id || ': ' || substring(text, 1, 480), E'\\n' ORDER BY rank)) AS digest
      FROM kept GROUP BY 1""",
)
def h23_evidence_digest(spark, folder):
    asked, corpus = evidence_queries(spark, folder), evidence_corpus(spark, folder)
    ranked = retrieval.rank_evidence(asked, corpus)
    nobody = ranked.where(F.lit(False)).select("query_id", "source_id")
    kept = retrieval.shortlist(ranked, asked, nobody).join(corpus, "source_id")
    titled = retrieval.describe_sources(kept).withColumn("title", F.concat_ws(" ", F.lit("Document"), "source_id"))
    return brief.evidence_digest(titled).withColumn("digest", F.md5("digest"))


@query(
    "h24_model_label",
    """SELECT p_partkey, coalesce(nullif(replace(p_type, '_', ' '), ''), 'standby') AS label,
        replace('model_' || p_name, '_', ' ') AS shown FROM part""",
)
def h24_model_label(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        text.model_label(F.col("p_type")).alias("label"),
        text.model_label(F.concat(F.lit("model_"), "p_name")).alias("shown"),
    )

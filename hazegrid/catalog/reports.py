"""Report sections of all sites, their order by intent, and comparisons of places, with their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazegrid.catalog.joins import BRIEF, PLACES, places, site_brief
from hazegrid.catalog.projections import INTENT, _with
from hazegrid.catalog.registry import query
from hazegrid.catalog.tables import documents as text_table
from hazegrid.catalog.tables import coordinates, observations, stored_hours
from hazegrid.functions import text
from hazegrid.operators import alerts, joins, network, quality, report, series


def sql_sentence(template: str, **values: str) -> str:
    """A sentence as a chain of SQL texts."""
    quoted = template.replace("'", "''")
    return "'" + re.sub(r"\{(\w+)\}", lambda place: f"' || {values[place[1]]} || '", quoted) + "'"


def number(x: str) -> str:
    return f"coalesce(printf('%.1f', CAST({x} AS DOUBLE)), 'n/a')"


def signed(x: str) -> str:
    return f"coalesce(CASE WHEN {x} >= 0 THEN '+' ELSE '' END || printf('%.1f', CAST({x} AS DOUBLE)), 'n/a')"


def hour(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 'lead hour +' || {x} ELSE 'n/a' END"


PEAKS = {"o3_peak": number("o3_peak"), "no2_peak": number("no2_peak"), "o3_hour": hour("peak_o3_hour"), "no2_hour": hour("peak_no2_hour")}
FARTHER = "abs(coalesce(no2_now - no2_avg, 0)) > abs(coalesce(o3_now - o3_avg, 0))"
STRONGER = "greatest(coalesce(o3_peak, 0), coalesce(o3_now, 0)) >= greatest(coalesce(no2_peak, 0), coalesce(no2_now, 0))"
REASON = (
    f"CASE WHEN {FARTHER} THEN {sql_sentence(report.NO2_FARTHER, no2_delta=signed('(no2_now - no2_avg)'), o3_delta=signed('(o3_now - o3_avg)'))} "
    f"WHEN {STRONGER} THEN {sql_sentence(report.O3_STRONGER, **PEAKS)} ELSE {sql_sentence(report.NO2_STRONGER, **PEAKS)} END"
)
ALERTED = sql_sentence(report.ALERT_DRIVER, pollutant="a.pollutant", value=number("a.value"), threshold=number("a.threshold"), severity="a.severity")
WATCHED = sql_sentence(
    report.WATCH_DRIVER, driver=f"CASE WHEN {FARTHER} THEN 'NO2' WHEN {STRONGER} THEN 'O3' ELSE 'NO2' END", reason=REASON, o3=number("o3_now"), no2=number("no2_now")
)
SECTION_SQL = {
    "situation": sql_sentence(
        report.SITUATION,
        o3=number("o3_now"),
        no2=number("no2_now"),
        o3_avg=number("o3_avg"),
        no2_avg=number("no2_avg"),
        o3_delta=signed("(o3_now - o3_avg)"),
        no2_delta=signed("(no2_now - no2_avg)"),
    ),
    "outlook": sql_sentence(report.OUTLOOK, horizon="24", o3=PEAKS["o3_peak"], no2=PEAKS["no2_peak"], o3_hour=PEAKS["o3_hour"], no2_hour=PEAKS["no2_hour"]),
    "network": sql_sentence(
        report.NETWORK,
        city="h.name || ', ' || h.country",
        o3=number("h.o3"),
        no2=number("h.no2"),
        aqi=number("h.us_aqi"),
        o3_delta=signed("(h.o3 - o3_now)"),
        no2_delta=signed("(h.no2 - no2_now)"),
    ),
    "actions": sql_sentence(report.ACTIONS, state=f"CASE WHEN alert_count > 0 THEN '{report.ACTIVE_ALERTS}' ELSE '{report.NO_ALERTS}' END"),
    "alert": f"CASE WHEN a.site_id IS NOT NULL THEN {ALERTED} ELSE {WATCHED} END",
    "dataset": sql_sentence(
        report.DATASET,
        rows="(SELECT format('{:,}', count(*)) FROM ev WHERE dataset_split = 'train')",
        sites="(SELECT count(DISTINCT site_id) FROM ev WHERE dataset_split = 'train')",
        targets="'o3, no2'",
    ),
    "unknowns": sql_sentence(report.UNKNOWNS, generator="'Groq'"),
}
SECTIONS = f"""{BRIEF}, alerted AS (SELECT *, CASE pollutant WHEN 'O3' THEN 100.0 ELSE 80.0 END AS threshold,
      CASE WHEN value >= CASE pollutant WHEN 'O3' THEN 100.0 ELSE 80.0 END * 1.2 THEN 'critical' ELSE 'warning' END AS severity
    FROM cells QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY value DESC, "timestamp", r) = 1),
  sections AS (SELECT w.site_id, {", ".join(f"{sql} AS {name}" for name, sql in SECTION_SQL.items())}
    FROM wide w CROSS JOIN hot h LEFT JOIN alerted a ON a.site_id = w.site_id)"""


def sections(spark, folder):
    coming = series.latest_rows(stored_hours(spark, folder), 12)
    df = joins.with_coordinates(observations(spark, folder), coordinates(spark))
    totals = quality.dataset_totals(df, ["no2"], ["o3", "no2"])
    return report.report_sections(site_brief(spark, folder), places(spark, folder), alerts.threshold_alerts(coming), totals)


@query("h19_report_sections", f"{SECTIONS} SELECT * FROM sections")
def h19_report_sections(spark, folder):
    return sections(spark, folder)


ORDERS = ", ".join(f"('{name}', {i}, '{key}', '{report.TITLES[key]}')" for name, keys in text.INTENT_SECTIONS.items() for i, key in enumerate(keys))


@query(
    "h19_ordered_reports",
    f"""{SECTIONS}, listed AS (SELECT *, row_number() OVER (ORDER BY site_id) - 1 AS i, count(*) OVER () AS n FROM sections),
      asked AS (SELECT doc_id, {_with(INTENT, 'text')} AS intent, doc_id % (SELECT max(n) FROM listed) AS i FROM documents),
      told AS (UNPIVOT (SELECT i, site_id, {", ".join(SECTION_SQL)} FROM listed) ON {", ".join(SECTION_SQL)} INTO NAME key VALUE content)
      SELECT doc_id, intent, site_id, md5(string_agg('## ' || title || E'\\n' || content, E'\\n' ORDER BY place)) AS report
      FROM asked JOIN told ON told.i = asked.i JOIN (VALUES {ORDERS}) o(name, place, section, title) ON o.name = intent AND section = key
      GROUP BY 1, 2, 3""",
)
def h19_ordered_reports(spark, folder):
    """Every document as a question about one of the sites: the sections its intent asks for, as one text."""
    listed = sections(spark, folder).withColumn("i", F.row_number().over(Window.orderBy("site_id")) - 1)
    count = listed.agg(F.count(F.lit(1))).scalar()
    asked = text_table(spark, folder).select("doc_id", text.intent(F.col("text")).alias("intent"), (F.col("doc_id") % count).alias("i"))
    told = report.ordered_sections(asked.join(listed, "i"), F.col("intent"))
    lines = F.transform("report", lambda part: F.concat(F.lit("## "), part["title"], F.lit("\n"), part["content"]))
    return told.select("doc_id", "intent", "site_id", F.md5(F.array_join(lines, "\n")).alias("report"))


LEADER = "CASE WHEN coalesce(h.{0}, 0) > coalesce(p.{0}, 0) THEN h.label ELSE p.label END"
COMPARED = sql_sentence(
    report.TWO_PLACES,
    named="p.label",
    hotspot="h.label",
    o3=number("p.o3"),
    no2=number("p.no2"),
    aqi=f"CASE WHEN p.us_aqi IS NULL THEN '' ELSE {sql_sentence(report.NAMED_AQI, aqi=number('p.us_aqi'))} END",
    hot_o3=number("h.o3"),
    hot_no2=number("h.no2"),
    hot_aqi=number("h.us_aqi"),
    o3_delta=signed("(h.o3 - p.o3)"),
    no2_delta=signed("(h.no2 - p.no2)"),
    o3_leader=LEADER.format("o3"),
    no2_leader=LEADER.format("no2"),
)


@query(
    "c10_comparison_sections",
    f"""WITH {PLACES}, named AS (SELECT *, name || ', ' || country AS label FROM places), top AS (SELECT *, name || ', ' || country AS label FROM hot)
      SELECT p.key, CASE WHEN p.label = h.label THEN '{report.SAME_TITLE}' ELSE p.label || ' vs ' || h.label END AS title,
        CASE WHEN p.label = h.label THEN {sql_sentence(report.SAME_PLACE, hotspot="h.label")} ELSE {COMPARED} END AS content
      FROM named p, top h""",
)
def c10_comparison_sections(spark, folder):
    known = places(spark, folder)
    pairs = known.withColumn("_hot", network.hotspot_struct(known)).select(
        "key",
        report.place_label(F.col("name"), F.col("country")).alias("named"),
        *[F.col(name).alias(f"named_{alias}") for name, alias in (("o3", "o3"), ("no2", "no2"), ("us_aqi", "aqi"))],
        report.place_label(F.col("_hot.name"), F.col("_hot.country")).alias("hotspot"),
        *[F.col(f"_hot.{name}").alias(f"hotspot_{alias}") for name, alias in (("o3", "o3"), ("no2", "no2"), ("us_aqi", "aqi"))],
    )
    return report.comparison_sections(pairs).select("key", "title", "content")

"""The sections of a site's report as columns, and their order by what was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid import schema as S
from hazegrid.functions.text import intent_sections, number_text, signed_text
from hazegrid.operators.brief import sentence
from hazegrid.operators.network import hotspot_struct
from hazegrid.session import materialize

# Titles and sentences of the report's sections.
TITLES = {
    "situation": "Station Reading vs SIH Baseline",
    "outlook": "Next-24h Forecast Window",
    "network": "Station vs Live City Network",
    "actions": "Operator Takeaway",
    "alert": "Alert Driver",
    "dataset": "Dataset and Training Grounding",
    "unknowns": "Reliability Notes",
}
SITUATION = (
    "The current station reading shows O3 at {o3} ug/m3 and NO2 at {no2} ug/m3. "
    "The recent SIH-derived station baseline is O3 {o3_avg} ug/m3 and NO2 {no2_avg} ug/m3. "
    "That puts O3 {o3_delta} ug/m3 versus baseline and NO2 {no2_delta} ug/m3 versus baseline."
)
OUTLOOK = (
    "The {horizon}-hour forecast peaks at O3 {o3} ug/m3 around {o3_hour} and NO2 {no2} ug/m3 around {no2_hour}. "
    "The displayed forecast should be read as a live-anchored horizon, not as the raw historical timestamp used "
    "inside the training/unseen files."
)
NETWORK = (
    "The top live-network comparison point is {city}, with O3 {o3} ug/m3, NO2 {no2} ug/m3, and modeled US AQI "
    "estimate {aqi}. Against the selected station, that is O3 {o3_delta} and NO2 {no2_delta}."
)
ACTIVE_ALERTS = "There are active threshold signals in the configured alert layer."
NO_ALERTS = "There are no active configured threshold exceedance alerts right now."
ACTIONS = (
    "{state} Watch the lead-hour window around the higher of the two pollutant peaks, and compare it with the "
    "live-network hotspot before calling the risk isolated."
)
ALERT_DRIVER = (
    "The active alert layer is being driven by {pollutant}. Its reported value is {value} ug/m3 against a threshold "
    "of {threshold} ug/m3, with severity {severity}. Use that pollutant as the lead signal, then check whether the "
    "forecast peak keeps rising in the next 24 hours."
)
WATCH_DRIVER = (
    "No configured threshold alert is active right now, so there is no formal alert driver. If this is treated as a "
    "watch question, {driver} is the pollutant to watch first. {reason}Current values are O3 {o3} ug/m3 and NO2 {no2} ug/m3."
)
NO2_FARTHER = "NO2 is farther from its recent SIH baseline: {no2_delta} ug/m3 versus O3 {o3_delta} ug/m3. "
O3_STRONGER = (
    "O3 has the stronger forecast pressure, peaking at {o3_peak} ug/m3 around {o3_hour}, while NO2 peaks at {no2_peak} "
    "ug/m3 around {no2_hour}. "
)
NO2_STRONGER = (
    "NO2 has the stronger current/forecast pressure, peaking at {no2_peak} ug/m3 around {no2_hour}, while O3 peaks at "
    "{o3_peak} ug/m3 around {o3_hour}. "
)
DATASET = (
    "The supervised model is grounded in {rows} SIH training rows across {sites} sites, with targets {targets}. Live "
    "API readings are used as current context and auxiliary evidence, while the trained target behavior comes from "
    "the SIH O3/NO2 labels."
)
UNKNOWNS = (
    "This run used local synthesis because the remote {generator} generation path was unavailable or not configured. "
    "The answer still uses project data, but contradiction handling and free-form reasoning are narrower than the "
    "{generator} path."
)
SAME_PLACE = (
    "The requested city and the current hotspot are the same location: {hotspot}. There is no second city to compare "
    "against until the hotspot ranking changes."
)
TWO_PLACES = (
    "{named} currently shows O3 {o3} ug/m3, NO2 {no2} ug/m3{aqi}. {hotspot} currently shows O3 {hot_o3} ug/m3, NO2 "
    "{hot_no2} ug/m3, and modeled US AQI estimate {hot_aqi}. Relative to {named}, {hotspot} is O3 {o3_delta} and NO2 "
    "{no2_delta}. That means O3 is currently stronger in {o3_leader}, while NO2 is stronger in {no2_leader}."
)
NAMED_AQI = ", and modeled US AQI estimate {aqi}"
SAME_TITLE = "Requested City vs Current Hotspot"


def _hour(lead: str) -> Column:
    return F.when(F.col(lead) > 0, F.concat(F.lit("lead hour +"), F.col(lead).cast("string"))).otherwise("n/a")


def highest_alerts(alerts: DataFrame, site: str = S.SITE) -> DataFrame:
    """The alert of largest value per site, the earliest of equal ones: ``pollutant, value, threshold, severity``."""
    early = (-F.unix_micros(F.col(S.TIMESTAMP).cast("timestamp"))).alias("t")
    order = F.struct("value", early, (-F.col("pollutant_rank")).alias("r"))
    kept = F.struct("pollutant", "value", "threshold", "severity")
    return alerts.groupBy(site).agg(F.max_by(kept, order).alias("_alert"))


def report_sections(
    brief: DataFrame,
    locations: DataFrame,
    alerts: DataFrame,
    totals: DataFrame,
    horizon: int = 24,
    generator: str = "Groq",
    site: str = S.SITE,
    rank: str = "catalog_rank",
) -> DataFrame:
    """``site`` and one column per section of its report, for all sites at once.

    ``brief`` is a line per site (``brief.site_brief``), ``alerts`` any number of alerts per site, ``totals`` the one
    line of ``quality.dataset_totals``, ``locations`` the network, read as its first hot spot. Unknown numbers read
    ``n/a``.
    """
    one = totals.select(F.struct(*totals.columns).alias("t")).scalar()
    rows = brief.join(highest_alerts(alerts, site), site, "left").withColumns({"_hot": hotspot_struct(locations, rank), "_t": one})
    plain = ["o3_now", "no2_now", "o3_avg", "no2_avg", "o3_peak", "no2_peak"]
    deltas = ["o3_delta", "no2_delta", "hotspot_o3_delta", "hotspot_no2_delta"]
    # Each number is written once and told several times.
    written = {f"_n_{name}": number_text(F.col(name)) for name in plain} | {f"_s_{name}": signed_text(F.col(name)) for name in deltas}
    rows = materialize(rows.withColumns({**written, "_h_o3": _hour("peak_o3_hour"), "_h_no2": _hour("peak_no2_hour")}), "report-numbers")
    numbers, signed = ({name: F.col(f"{mark}{name}") for name in names} for mark, names in (("_n_", plain), ("_s_", deltas)))
    hours = {"o3_hour": F.col("_h_o3"), "no2_hour": F.col("_h_no2")}
    peaks = {**hours, "o3_peak": numbers["o3_peak"], "no2_peak": numbers["no2_peak"]}
    zero = F.lit(0.0)
    farther = F.abs(F.coalesce("no2_delta", zero)) > F.abs(F.coalesce("o3_delta", zero))
    pressure = [F.greatest(F.coalesce(f"{name}_peak", zero), F.coalesce(f"{name}_now", zero)) for name in ("o3", "no2")]
    reason = (
        F.when(farther, sentence(NO2_FARTHER, no2_delta=signed["no2_delta"], o3_delta=signed["o3_delta"]))
        .when(pressure[0] >= pressure[1], sentence(O3_STRONGER, **peaks))
        .otherwise(sentence(NO2_STRONGER, **peaks))
    )
    driver = F.when(farther, "NO2").when(pressure[0] >= pressure[1], "O3").otherwise("NO2")
    watched = sentence(WATCH_DRIVER, driver=driver, reason=reason, o3=numbers["o3_now"], no2=numbers["no2_now"])
    alerted = sentence(
        ALERT_DRIVER,
        pollutant=F.col("_alert.pollutant"),
        value=number_text(F.col("_alert.value")),
        threshold=number_text(F.col("_alert.threshold").cast("double")),
        severity=F.col("_alert.severity"),
    )
    return rows.select(
        site,
        sentence(
            SITUATION, o3=numbers["o3_now"], no2=numbers["no2_now"], o3_avg=numbers["o3_avg"], no2_avg=numbers["no2_avg"], o3_delta=signed["o3_delta"], no2_delta=signed["no2_delta"]
        ).alias("situation"),
        sentence(OUTLOOK, horizon=F.lit(horizon), o3=numbers["o3_peak"], no2=numbers["no2_peak"], **hours).alias("outlook"),
        sentence(
            NETWORK,
            city=F.coalesce(place_label(F.col("_hot.name"), F.col("_hot.country")), F.lit("the live network")),
            o3=number_text(F.col("_hot.o3")),
            no2=number_text(F.col("_hot.no2")),
            aqi=number_text(F.col("_hot.us_aqi").cast("double")),
            o3_delta=signed["hotspot_o3_delta"],
            no2_delta=signed["hotspot_no2_delta"],
        ).alias("network"),
        sentence(ACTIONS, state=F.when(F.col("alert_count") > 0, ACTIVE_ALERTS).otherwise(NO_ALERTS)).alias("actions"),
        F.when(F.col("_alert").isNotNull(), alerted).otherwise(watched).alias("alert"),
        sentence(
            DATASET,
            rows=F.format_number(F.coalesce("_t.total_train_rows", F.lit(0)), 0),
            sites=F.coalesce("_t.total_sites", F.lit(0)),
            targets=F.array_join("_t.targets", ", "),
        ).alias("dataset"),
        sentence(UNKNOWNS, generator=F.lit(generator)).alias("unknowns"),
    )


def place_label(name: Column, country: Column) -> Column:
    """Name and country, parted by a comma if there is a country."""
    return F.when(name.isNotNull(), F.concat_ws(", ", name, F.nullif(country, F.lit(""))))


def ordered_sections(sections: DataFrame, intent: Column, site: str = S.SITE) -> DataFrame:
    """``sections`` with ``report``: the sections that an intent asks for, in its order, as (key, title, content)."""
    titles = F.create_map(*[F.lit(part) for pair in TITLES.items() for part in pair])
    contents = F.create_map(*[part for key in TITLES for part in (F.lit(key), F.col(key))])
    picked = F.transform(intent_sections(intent), lambda key: F.struct(key.alias("key"), titles[key].alias("title"), contents[key].alias("content")))
    return sections.withColumn("report", picked)


def comparison_sections(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``title`` and ``content`` of the section that compares a named place with the hot spot.

    ``pairs`` holds ``named, named_o3, named_no2, named_aqi`` (unknown for a station) and ``hotspot, hotspot_o3,
    hotspot_no2, hotspot_aqi``. A place with more of a pollutant leads in it; of equal ones the named place does.
    """
    zero = F.lit(0.0)
    leader = lambda name: F.when(F.coalesce(f"hotspot_{name}", zero) > F.coalesce(f"named_{name}", zero), F.col("hotspot")).otherwise(F.col("named"))
    aqi = F.when(F.col("named_aqi").isNull(), "").otherwise(sentence(NAMED_AQI, aqi=number_text(F.col("named_aqi").cast("double"))))
    two = sentence(
        TWO_PLACES,
        named=F.col("named"),
        hotspot=F.col("hotspot"),
        o3=number_text(F.col("named_o3")),
        no2=number_text(F.col("named_no2")),
        aqi=aqi,
        hot_o3=number_text(F.col("hotspot_o3")),
        hot_no2=number_text(F.col("hotspot_no2")),
        hot_aqi=number_text(F.col("hotspot_aqi").cast("double")),
        o3_delta=signed_text(F.col("hotspot_o3") - F.col("named_o3")),
        no2_delta=signed_text(F.col("hotspot_no2") - F.col("named_no2")),
        o3_leader=leader("o3"),
        no2_leader=leader("no2"),
    )
    same = F.col("named") == F.col("hotspot")
    title = F.when(same, SAME_TITLE).otherwise(F.concat_ws(" vs ", "named", "hotspot"))
    return pairs.withColumns({"title": title, "content": F.when(same, sentence(SAME_PLACE, hotspot=F.col("hotspot"))).otherwise(two)})

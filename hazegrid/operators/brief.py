"""One wide line per site, and the sentences written from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid import schema as S
from hazegrid.functions import risk
from hazegrid.functions.calendar import iso_text
from hazegrid.functions.text import fixed_text
from hazegrid.operators.network import hotspot_struct

ALERTS_IN_TEXT = 10
FEATURES_IN_TEXT = 12
# The sentences of the evidence texts.
HISTORY = (
    "Recent history for site {site} spans {count} hours. Average O3 is {o3} and average NO2 is {no2}. "
    "First timestamp {first}, last timestamp {last}."
)
NO_HISTORY = "No historical trend points are available."
FORECAST = (
    "Forecast model {model} generated {horizon} hourly points. "
    "Peak O3 is {o3} ug/m3 at forecast hour +{o3_hour}. Peak NO2 is {no2} ug/m3 at forecast hour +{no2_hour}."
)
ANCHORED = " The forecast window is anchored after live station sync {at}."
GENERATED = " Forecast generated at {at}."
NO_FORECAST = "No forecast points are available."
VISIBLE = (
    "The frontend attached the exact visible dashboard state for this investigation. Station {station}; "
    "selected timestamp {selected}; visible phase {phase}; visible O3 {o3} ug/m3; visible NO2 {no2} ug/m3; "
    "visible risk {risk}; forecast peak O3 {peak_o3} at {peak_o3_time}; forecast peak NO2 {peak_no2} at "
    "{peak_no2_time}; active city comparison {city}; active configured alert count {alerts}."
)
ALERT = "{pollutant} {severity} at site {site}: {message} value {value} threshold {threshold}"
NO_ALERTS = "No current threshold exceedance alerts were generated."
PLACE = "{name} {country} O3 {o3} NO2 {no2} modeled US AQI {aqi}"
NETWORK = "Live network scope is {scope}. "
NO_NETWORK = "No live network locations are currently available."
DATASET = (
    "Selected site {site} is located at {lat}, {lon}. The dataset contains {sites} sites, {train} train rows, "
    "and {unseen} unseen rows. Features include {features}. Targets are {targets}."
)
LIVE = (
    "Live station feed provider is {provider}. Current O3 is {o3} ug/m3 and current NO2 is {no2} ug/m3. "
    "Source label: {label}. Fallback used: {fallback}. Last updated: {updated}."
)


def site_brief(
    sites: DataFrame,
    current: DataFrame,
    baseline: DataFrame,
    peaks: DataFrame,
    alerts: DataFrame,
    locations: DataFrame,
    visible: DataFrame | None = None,
    site: str = S.SITE,
    rank: str = "catalog_rank",
) -> DataFrame:
    """Everything known about a site on one line. All inputs hold at most one line per site, except the
    alerts (counted and cut to the highest here) and the network (read as its first hot spot).

    ``visible`` holds what a user has on screen (``visible_o3``, ``visible_no2``, ``peak_o3``, ...); a value
    there wins unless it is null or zero.
    """
    counted = alerts.groupBy(site).agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.max_by(
            "pollutant", F.struct("value", (-F.unix_micros(F.col(S.TIMESTAMP).cast("timestamp"))).alias("t"), (-F.col("pollutant_rank")).alias("r"))
        ).alias("alert_pollutant"),
    )
    wide = sites
    for part in (
        current.select(site, F.col("o3").alias("_live_o3"), F.col("no2").alias("_live_no2")),
        baseline.select(site, "o3_avg", "no2_avg"),
        peaks.select(
            site,
            F.col("peak_o3").alias("_peak_o3"),
            F.col("peak_o3_hour"),
            F.col("peak_no2").alias("_peak_no2"),
            F.col("peak_no2_hour"),
        ),
        counted,
    ):
        wide = wide.join(part, site, "left")
    nothing = F.lit(None).cast("double")
    shown = {name: nothing for name in ("visible_o3", "visible_no2", "visible_peak_o3", "visible_peak_no2")}
    if visible is not None:
        wide = wide.join(visible, site, "left")
        shown = {name: F.col(name) if name in visible.columns else nothing for name in shown}
    wide = wide.withColumns(
        {
            "o3_now": risk.known_or(shown["visible_o3"], F.col("_live_o3")),
            "no2_now": risk.known_or(shown["visible_no2"], F.col("_live_no2")),
            "o3_peak": risk.known_or(shown["visible_peak_o3"], F.col("_peak_o3")),
            "no2_peak": risk.known_or(shown["visible_peak_no2"], F.col("_peak_no2")),
            "alert_count": F.coalesce("alert_count", F.lit(0)),
            "_hot": hotspot_struct(locations, rank),
        }
    )
    zero = F.lit(0.0)
    state = risk.risk_label(
        F.coalesce(risk.known_or(F.col("o3_peak"), F.col("o3_now")), zero),
        F.coalesce(risk.known_or(F.col("no2_peak"), F.col("no2_now")), zero),
    )
    names = ("o3_now", "no2_now", "o3_avg", "no2_avg", "o3_peak", "no2_peak")
    watched = risk.watch_driver(*[F.col(name) for name in names])
    driver = F.when(F.col("alert_count") > 0, F.col("alert_pollutant")).otherwise(watched)
    return wide.select(
        *sites.columns,
        *names,
        "peak_o3_hour",
        "peak_no2_hour",
        (F.col("o3_now") - F.col("o3_avg")).alias("o3_delta"),
        (F.col("no2_now") - F.col("no2_avg")).alias("no2_delta"),
        "alert_count",
        driver.alias("driver"),
        state.alias("risk"),
        F.col("_hot.name").alias("hotspot"),
        (F.col("_hot.o3") - F.col("o3_now")).alias("hotspot_o3_delta"),
        (F.col("_hot.no2") - F.col("no2_now")).alias("hotspot_no2_delta"),
        F.col("_hot.us_aqi").alias("hotspot_aqi"),
    )


def sentence(template: str, **values: Column) -> Column:
    """``template`` with ``{name}`` places filled by columns."""
    pieces: list[Column] = []
    rest = template
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            pieces.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        pieces.append(values[name].cast("string"))
    return F.concat(*pieces)


def history_text(stats: DataFrame, site: str = S.SITE) -> DataFrame:
    text = sentence(
        HISTORY,
        site=F.col(site),
        count=F.col("count"),
        o3=fixed_text(F.col("avg_o3")),
        no2=fixed_text(F.col("avg_no2")),
        first=iso_text(F.col("first_timestamp")),
        last=iso_text(F.col("last_timestamp")),
    )
    return stats.select(site, F.coalesce(text, F.lit(NO_HISTORY)).alias("history_text"))


def forecast_text(
    peaks: DataFrame,
    model: str,
    horizon: int,
    anchored: str | None = None,
    generated: str | None = None,
    site: str = S.SITE,
) -> DataFrame:
    """The peak sentences; ``anchored`` and ``generated`` name timestamp columns to be told as well."""
    text = sentence(
        FORECAST,
        model=F.lit(model),
        horizon=F.lit(horizon),
        o3=fixed_text(F.col("peak_o3")),
        o3_hour=F.col("peak_o3_hour"),
        no2=fixed_text(F.col("peak_no2")),
        no2_hour=F.col("peak_no2_hour"),
    )
    if anchored:
        at = iso_text(F.col(anchored))
        text = F.concat(text, sentence(ANCHORED, at=at))
    if generated:
        text = F.concat(text, sentence(GENERATED, at=iso_text(F.col(generated))))
    return peaks.select(site, F.coalesce(text, F.lit(NO_FORECAST)).alias("forecast_text"))


def visible_text(visible: DataFrame, site: str = S.SITE) -> DataFrame:
    """What a user had on screen; absent columns and nulls read as unknown."""

    def shown(name: str, missing: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(missing)) if name in visible.columns else F.lit(missing)

    text = sentence(
        VISIBLE,
        station=shown("station_label", "unknown"),
        selected=shown("selected_timestamp", "sync pending"),
        phase=shown("phase", "unknown"),
        o3=shown("visible_o3", "n/a"),
        no2=shown("visible_no2", "n/a"),
        risk=shown("risk", "unknown"),
        peak_o3=shown("visible_peak_o3", "n/a"),
        peak_o3_time=shown("visible_peak_o3_time", "n/a"),
        peak_no2=shown("visible_peak_no2", "n/a"),
        peak_no2_time=shown("visible_peak_no2_time", "n/a"),
        city=shown("selected_city", "no selected city"),
        alerts=shown("alert_count", "0"),
    )
    return visible.select(site, text.alias("visible_text"))


def alerts_text(first_alerts: DataFrame, sites: DataFrame, site: str = S.SITE) -> DataFrame:
    """Up to ten alerts per site (``first_alerts`` output, with ``place``) in one text."""
    text = sentence(
        ALERT,
        pollutant=F.col("pollutant"),
        severity=F.col("severity"),
        site=F.col(site),
        message=F.col("message"),
        value=fixed_text(F.col("value")),
        threshold=fixed_text(F.col("threshold")),
    )
    kept = first_alerts.where(F.col("place") <= ALERTS_IN_TEXT)
    lines = kept.groupBy(site).agg(F.sort_array(F.collect_list(F.struct("place", text.alias("line")))).alias("_lines"))
    joined = F.array_join("_lines.line", " ")
    none = F.lit(NO_ALERTS)
    return sites.select(site).join(lines, site, "left").select(site, F.coalesce(joined, none).alias("alerts_text"))


def network_text(hotspots: DataFrame, scope: str, rank: str = "catalog_rank") -> DataFrame:
    """One row: the hot spots of the network in one text."""
    text = sentence(
        PLACE,
        name=F.col("name"),
        country=F.col("country"),
        o3=fixed_text(F.col("o3")),
        no2=fixed_text(F.col("no2")),
        aqi=fixed_text(F.coalesce("us_aqi", F.lit(0.0)), 0),
    )
    place = F.struct((-F.col("pressure")).alias("p"), F.col(rank).alias("r"), text.alias("line"))
    listed = hotspots.agg(F.sort_array(F.collect_list(place)).alias("_lines"))
    some = F.concat(F.lit(NETWORK.format(scope=scope)), F.array_join("_lines.line", " "))
    none = F.lit(NO_NETWORK)
    return listed.select(F.when(F.size("_lines") > 0, some).otherwise(none).alias("network_text"))


def dataset_text(summary: DataFrame, totals: DataFrame, site: str = S.SITE) -> DataFrame:
    """Where a site is and what the data set holds."""
    one = totals.select(F.struct(*totals.columns).alias("t")).scalar()
    held = summary.withColumn("_t", one)
    text = sentence(
        DATASET,
        site=F.col(site),
        lat=F.col("latitude"),
        lon=F.col("longitude"),
        sites=F.col("_t.total_sites"),
        train=F.col("_t.total_train_rows"),
        unseen=F.col("_t.total_unseen_rows"),
        features=F.array_join(F.slice("_t.features", 1, FEATURES_IN_TEXT), ", "),
        targets=F.array_join("_t.targets", ", "),
    )
    return held.select(site, text.alias("dataset_text"))


def live_text(snapshot: DataFrame, site: str = S.SITE) -> DataFrame:
    text = sentence(
        LIVE,
        provider=F.col("provider"),
        o3=fixed_text(F.col("o3")),
        no2=fixed_text(F.col("no2")),
        label=F.col("source_label"),
        fallback=F.initcap(F.col("fallback_used").cast("string")),
        updated=iso_text(F.col(S.TIMESTAMP)),
    )
    return snapshot.select(site, text.alias("live_text"))


def evidence_digest(shortlisted: DataFrame) -> DataFrame:
    """Shortlisted sources (at most nine per query, with ``title`` and ``snippet``) as one text per query."""
    line = sentence(
        "[{id}] {title}: {snippet}", id=F.col("source_id"), title=F.col("title"), snippet=F.col("snippet")
    )
    lines = F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))
    return shortlisted.groupBy("query_id").agg(lines.alias("_lines")).select(
        "query_id", F.array_join("_lines.line", "\n").alias("digest")
    )

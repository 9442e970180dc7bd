"""Text expressions: number formats, extraction, tokens, similarity, query intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

# Number patterns in evidence sentences.
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
POLLUTANT_PATTERNS = {
    "o3": rf"O3(?: is| at)?\s+{NUMBER}",
    "no2": rf"NO2(?: is| at)?\s+{NUMBER}",
    "avg_o3": rf"Average O3 is\s+{NUMBER}",
    "avg_no2": rf"(?i)average NO2 is\s+{NUMBER}",
}
MOMENT = r"([0-9T:\-+.]+)"
PEAK_PATTERNS = {
    "o3": rf"Peak O3 is\s+{NUMBER}\s+ug/m3 at\s+{MOMENT}",
    "no2": rf"Peak NO2 is\s+{NUMBER}\s+ug/m3 at\s+{MOMENT}",
}

# Words that decide the intent of a query, in order of precedence.
INTENT_WORDS = {
    "alert": ["alert", "threshold", "warning", "critical", "risk", "drives the alert", "driving the alert"],
    "dataset": ["dataset", "training", "trained", "features", "columns", "data"],
    "comparison": ["compare", "city", "global", "india", "network", "hotspot"],
    "forecast": ["forecast", "future", "next", "24", "peak", "spike"],
    "diagnostic": ["why", "anomaly", "rise", "rising", "drop", "high", "low"],
}

# Report title, section order and follow-up per intent.
INTENT_TITLES = {
    "dataset": "Dataset grounding brief",
    "comparison": "Station and city-network comparison",
    "forecast": "Short-term forecast brief",
    "alert": "Alert and risk brief",
    "diagnostic": "Pollutant behavior diagnosis",
}
INTENT_SECTIONS = {
    "dataset": ["dataset", "situation", "outlook", "unknowns"],
    "comparison": ["network", "actions", "unknowns"],
    "forecast": ["outlook", "situation", "actions", "unknowns"],
    "alert": ["alert", "outlook", "actions", "situation"],
    "diagnostic": ["situation", "outlook", "network", "dataset", "unknowns"],
    "brief": ["situation", "outlook", "network", "actions", "unknowns"],
}
INTENT_FOLLOW_UPS = {
    "dataset": "Show which training features and targets are being used for the selected station.",
    "comparison": "Rank the selected station against the top three live-network cities.",
    "forecast": "Explain whether the forecast peak is ozone-led, NO2-led, or mixed.",
    "alert": "Check whether current alert thresholds are too strict or too loose for this forecast.",
    "diagnostic": "Explain the likely driver of the pollutant movement using weather and recent history.",
    "brief": "Summarize what an operator should watch in the next 6 to 12 hours.",
}


def squeeze(text: Column) -> Column:
    """Every run of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def fixed_text(value: Column, digits: int = 1) -> Column:
    """Decimal text of the exact binary value, ties to even; null stays null.

    The usual formatter rounds the shortest decimal form half up, which differs from the exact value in the
    last digit (2.15 is stored below 2.15). The fraction is split into two parts whose products with a small
    power of ten are exact, so the comparison with the half-way point is exact too. From 2^53 on a double has
    no fraction; what does not fit a 64-bit integer, and values that are not finite, get the formatter's text.
    """
    scale = 10**digits
    size = F.abs(value)
    whole = F.floor(size).cast("bigint")
    fraction = size - whole.cast("double")
    coarse = F.floor(fraction * 2.0**20) / F.lit(2.0**20)
    rest = fraction - coarse
    units = F.floor(fraction * float(scale))
    above = coarse * float(scale) - units.cast("double") - 0.5
    below = -(rest * float(scale))
    odd = (units if digits else whole + units) % 2 == 1
    up = (above > below) | ((above == below) & odd)
    rounded = (units + up.cast("int")).cast("bigint")
    sign = F.when((value < 0) | ((value == 0) & F.startswith(value.cast("string"), F.lit("-"))), "-").otherwise("")
    body = (whole + F.floor(rounded / scale).cast("bigint")).cast("string")
    if digits:
        body = F.concat(body, F.lit("."), F.lpad((rounded % scale).cast("string"), digits, "0"))
    beyond = F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value))
    return F.when(size < 2.0**62, F.concat(sign, body)).otherwise(beyond)


def number_text(value: Column) -> Column:
    """One decimal, or ``n/a``."""
    return F.coalesce(fixed_text(value), F.lit("n/a"))


def signed_text(value: Column) -> Column:
    """Like ``number_text`` with an explicit plus sign."""
    plus = F.when(value >= 0, "+").otherwise("")
    return F.coalesce(F.concat(plus, fixed_text(value)), F.lit("n/a"))


def safe_double(text: Column) -> Column:
    """Number of a text; null when it is none."""
    return text.try_cast("double")


def extract_number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double")


def extract_text(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def pollutant_values(text: Column) -> dict[str, Column]:
    return {name: extract_number(text, pattern) for name, pattern in POLLUTANT_PATTERNS.items()}


def forecast_peaks(text: Column) -> dict[str, Column]:
    found = {}
    for name, pattern in PEAK_PATTERNS.items():
        found[f"peak_{name}"] = extract_number(text, pattern)
        found[f"peak_{name}_time"] = extract_text(text, pattern, 2)
    return found


def tokens(text: Column) -> Column:
    """Distinct lower-cased words."""
    words = F.split(F.lower(text), f"{SPACE}+")
    return F.array_distinct(F.filter(words, lambda word: word != ""))


def overlap_similarity(shared: Column, left_size: Column, right_size: Column) -> Column:
    """Shared distinct words over the root of both counts; 0 when either side is empty."""
    norm = F.sqrt(left_size.cast("double")) * F.sqrt(right_size.cast("double"))
    return F.when((left_size > 0) & (right_size > 0), shared / norm).otherwise(F.lit(0.0))


def lexical_similarity(left: Column, right: Column) -> Column:
    """Similarity of two token arrays (see ``tokens``)."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    return overlap_similarity(shared, F.size(left), F.size(right))


def credibility_cluster(source_type: Column, credibility: Column) -> Column:
    band = F.when(credibility >= 0.9, "high").when(credibility >= 0.75, "medium").otherwise("exploratory")
    return F.concat_ws("-", source_type, band)


def snippet(text: Column, length: int = 480) -> Column:
    return F.substring(text, 1, length)


def intent(query: Column) -> Column:
    """First intent, in order of precedence, one of whose words occurs anywhere in the query."""
    lowered = F.lower(query)
    result = F.lit("brief")
    for name, words in reversed(INTENT_WORDS.items()):
        hit = F.lit(False)
        for word in words:
            hit |= F.contains(lowered, F.lit(word))
        result = F.when(hit, name).otherwise(result)
    return result


def _lookup(values: dict, key: Column) -> Column:
    pairs = []
    for name, value in values.items():
        pairs += [F.lit(name), F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)]
    return F.try_element_at(F.create_map(*pairs), key)


def intent_title(intent_name: Column, mode: Column) -> Column:
    return F.coalesce(_lookup(INTENT_TITLES, intent_name), F.concat_ws(" ", F.initcap(mode), F.lit("intelligence brief")))


def intent_sections(intent_name: Column) -> Column:
    return F.coalesce(_lookup(INTENT_SECTIONS, intent_name), _lookup(INTENT_SECTIONS, F.lit("brief")))


def intent_follow_up(intent_name: Column) -> Column:
    return F.coalesce(_lookup(INTENT_FOLLOW_UPS, intent_name), F.lit(INTENT_FOLLOW_UPS["brief"]))


def clean_query(query: Column) -> Column:
    """Text before an attached context block."""
    return strip(F.substring_index(query, "\n\nContext:", 1))


def session_title(query: Column, default: str = "New research session") -> Column:
    short = F.substring(squeeze(query), 1, 72)
    return F.when(short == "", default).otherwise(F.coalesce(short, F.lit(default)))


def model_label(model: Column) -> Column:
    return F.coalesce(F.nullif(F.replace(model, F.lit("_"), F.lit(" ")), F.lit("")), F.lit("standby"))

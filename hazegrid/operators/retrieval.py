"""Evidence ranking: every query of a table against a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions import text as X
from hazegrid.operators.series import top_rows
from hazegrid.session import materialize

CREDIBILITY_WEIGHT = 0.25
# Sources ranked and shortlisted per depth.
RANKED_BY_DEPTH = {"quick": 6, "standard": 10, "deep": 14}
SHORTLIST_BY_DEPTH = {"quick": 4, "standard": 6, "deep": 9}
# The next four change the work, never the result: sources looked at per query for a first bound, common words kept
# as the bits of one number, shared rare words beyond the first that are asked for before a pair is scored, and pairs
# per query that are scored early for a better bound.
PROBED_SOURCES = 200
COMMON_WORDS = 62
SPARE_WORDS = 8
SCORED_EARLY = 60
ROUNDING = 1e-9
# Place names are found through one piece of so many letters; texts looked at to tell rare pieces from common ones.
PIECE = 4
SAMPLED_TEXTS = 100


def _by_depth(limits: dict[str, int], depth):
    other = limits["deep"]
    return F.when(depth == "quick", limits["quick"]).when(depth == "standard", limits["standard"]).otherwise(other)


def rank_evidence(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Top sources per query by lexical similarity plus a quarter of the credibility.

    ``queries``: (query_id, text, depth); ``corpus``: (source_id, text, credibility), ids unique. Result:
    (query_id, source_id, similarity, score, rank), ties by source_id.

    Exact. The most common words of the queries are bits of one number per source, so how many of them a pair
    shares is one bit count; the other words are posting lists in which a source stands with its size, credibility
    and bits. Each query has a floor, the score of the last place reached so far, which rises in three rounds:

    1. the shortest posting lists, up to ``PROBED_SOURCES`` sources, and the most credible sources;
    2. sources that the common words alone lift to the floor: found through the rarest of the query's common
       words that they hold, in the stretches (sizes up to a power of two) whose best score reaches the floor; the
       best ``SCORED_EARLY`` pairs of each query so far are scored on all words;
    3. sources that need rare words as well. With the floor, a source of m words has to share k of them, so lists
       behind the rarest ones and stretches that cannot reach k are skipped, each source according to its own
       size, credibility and bits.

    Only pairs that no round could rule out are scored on all their words.
    """
    most = max(RANKED_BY_DEPTH.values())
    order = [F.desc("score"), F.asc("source_id")]
    limits = queries.select("query_id", _by_depth(RANKED_BY_DEPTH, F.col("depth")).alias("_limit"))
    sources = materialize(corpus.select("source_id", "credibility", X.tokens(F.col("text")).alias("_words")), "sources")
    asked = materialize(queries.select("query_id", X.tokens(F.col("text")).alias("_asked")), "asked")
    credible = sources.select("source_id", "credibility").orderBy(F.desc("credibility"), F.asc("source_id")).limit(most)
    tops = credible.agg(F.collect_list(F.struct("source_id", "credibility")).alias("c")).select("c")
    unmatched = asked.select("query_id", tops.scalar().alias("_listed")).select("query_id", F.inline("_listed")).select(
        "query_id",
        "source_id",
        F.lit(0.0).alias("similarity"),
        (F.col("credibility") * CREDIBILITY_WEIGHT).alias("score"),
    )
    matched = _scored(_likely_pairs(asked, sources, unmatched, most), asked, sources)
    best = top_rows(matched, ["query_id"], order, most, ["source_id"])
    ranked = _best_of_each(best.unionByName(unmatched)).withColumnRenamed("_place", "rank")
    return ranked.join(limits, "query_id").where(F.col("rank") <= F.col("_limit")).drop("_limit")


def _common_bits(words, common: list[str]):
    """The common words among ``words`` as bits, the rarest lowest."""
    if not common:
        return F.lit(0).cast("long")
    listed = F.array(*map(F.lit, common))
    values = F.array(*[F.lit(1 << i).cast("long") for i in range(len(common))])
    value = lambda word: F.element_at(values, F.array_position(listed, word).cast("int"))
    return F.aggregate(F.array_intersect(words, listed), F.lit(0).cast("long"), lambda bits, word: bits.bitwiseOR(value(word)))


def _needed(floor, credibility, n, m):
    """Words that a query of n and a source of m words must share to reach the floor, one at least."""
    similarity = floor - credibility * CREDIBILITY_WEIGHT - ROUNDING
    return F.greatest(F.ceil(similarity * F.sqrt(n.cast("double") * m) - ROUNDING), F.lit(1))


def _likely_pairs(asked: DataFrame, sources: DataFrame, unmatched: DataFrame, most: int) -> DataFrame:
    """``query_id, source_id`` of all pairs with a shared word that may reach the last place of their query."""
    vocabulary = asked.select(F.explode("_asked").alias("_word")).distinct()
    held = sources.select(F.explode("_words").alias("_word")).join(vocabulary, "_word", "left_semi")
    counts = materialize(held.groupBy("_word").agg(F.count(F.lit(1)).alias("_sources")), "word-counts")
    listed = counts.orderBy(F.desc("_sources"), "_word").limit(COMMON_WORDS).collect()
    common = [row["_word"] for row in reversed(listed)]
    rare = counts.where(~F.col("_word").isin(common)) if common else counts

    query = asked.select("query_id", F.size("_asked").alias("_n"), _common_bits(F.col("_asked"), common).alias("_qbits"), "_asked")
    query = materialize(query, "query-bits")
    # A window holds the words of one query.
    by_query = Window.partitionBy("query_id").orderBy("_sources", "_word")
    through = F.sum("_sources").over(by_query.rowsBetween(Window.unboundedPreceding, 0))
    words = query.select("query_id", "_n", "_qbits", F.explode("_asked").alias("_word")).join(rare, "_word")
    count = F.count(F.lit(1)).over(Window.partitionBy("query_id")).alias("_rare")
    words = materialize(words.select("*", F.row_number().over(by_query).alias("_at"), through.alias("_through"), count), "query-words")

    size = F.size("_words")
    stretch = F.floor(F.log2(F.greatest(size, F.lit(1)) + F.lit(0.5))).cast("int")
    entry = ["source_id", "credibility", size.alias("_m"), stretch.alias("_stretch"), _common_bits(F.col("_words"), common).alias("_bits")]
    entries = materialize(sources.select(*entry, "_words"), "entries")
    postings = entries.select("*", F.explode("_words").alias("_word")).drop("_words").join(rare.select("_word"), "_word", "left_semi")
    postings = materialize(postings, "postings")
    stretches = entries.where("_m > 0").groupBy("_stretch").agg(F.min("_m").alias("_least"), F.max("credibility").alias("_best"))
    stretches = materialize(stretches, "stretches")
    both = F.bit_count(F.col("_bits").bitwiseAND(F.col("_qbits")))
    reached = lambda shared: (shared / F.sqrt(F.col("_n").cast("double") * F.col("_m")) + F.col("credibility") * CREDIBILITY_WEIGHT).alias("score")

    def floors(scored: DataFrame) -> DataFrame:
        single = scored.groupBy("query_id", "source_id").agg(F.max("score").alias("score"))
        last = top_rows(single, ["query_id"], [F.desc("score"), F.asc("source_id")], most, ["source_id"], rank="_place")
        last = last.where(F.col("_place") == most).select("query_id", F.col("score").alias("_floor"))
        return materialize(asked.select("query_id").join(last, "query_id", "left").select("query_id", F.coalesce("_floor", F.lit(0.0)).alias("_floor")), "floors")

    probed = words.where(F.col("_through") <= PROBED_SOURCES).join(postings, "_word")
    found = probed.groupBy("query_id", "source_id").agg(
        F.count(F.lit(1)).alias("_shared"), *[F.first(c).alias(c) for c in ("_n", "_m", "_qbits", "_bits", "credibility")]
    )
    first = materialize(found.select("query_id", "source_id", reached(F.col("_shared") + both)).union(unmatched.select("query_id", "source_id", "score")), "probed")

    def by_stretch(floor: DataFrame) -> DataFrame:
        """Queries with each stretch and the words that its best source must share."""
        joined = floor.join(query.drop("_asked"), "query_id").select("*", F.explode(_rows_of(stretches)).alias("_s")).select("*", "_s.*")
        least = _needed(F.col("_floor"), F.col("_best"), F.col("_n"), F.col("_least"))
        return joined.select("query_id", "_n", "_qbits", "_floor", "_stretch", least.alias("_k"))

    floor = floors(first)
    at_stretch = by_stretch(floor).where(F.bit_count("_qbits") >= F.col("_k"))
    reachable = at_stretch.select("*", F.explode(_bit_numbers("_qbits")).alias("_bit"))
    below = F.expr("shiftleft(1L, _bit) - 1")
    rank = F.bit_count(F.col("_qbits").bitwiseAND(below)) + 1
    reachable = reachable.where(rank <= F.bit_count("_qbits") - F.col("_k") + 1).drop("_k")
    shapes = entries.drop("_words").select("*", F.explode(_bit_numbers("_bits")).alias("_bit"))
    # A source comes once per query: through the rarest common word that both hold.
    lowest = F.col("_bits").bitwiseAND(F.col("_qbits")).bitwiseAND(below) == 0
    enough = both >= _needed(F.col("_floor"), F.col("credibility"), F.col("_n"), F.col("_m"))
    lifted = shapes.join(reachable, ["_bit", "_stretch"]).where(lowest & enough).select("query_id", "source_id", reached(both))
    lifted = materialize(lifted, "lifted")

    # What looks best so far is scored on all words: that lifts the floor close to the last place.
    known = first.union(lifted).groupBy("query_id", "source_id").agg(F.max("score").alias("score"))
    early = top_rows(known, ["query_id"], [F.desc("score"), F.asc("source_id")], SCORED_EARLY, ["source_id"])
    early = _scored(early.select("query_id", "source_id"), asked, sources).select("query_id", "source_id", "score")
    floor = floors(known.union(early))
    rare_left = F.greatest(F.col("_k") - F.bit_count("_qbits"), F.lit(1))
    useful = words.drop("_through", "_sources", "_n", "_qbits").join(by_stretch(floor), "query_id")
    useful = useful.where(F.col("_at") <= F.col("_rare") - rare_left + 1 + SPARE_WORDS).drop("_k")
    # Rare words needed beside the common ones; without any, round two has the pair.
    short = _needed(F.col("_floor"), F.col("credibility"), F.col("_n"), F.col("_m")) - both
    inside = (short >= 1) & (short <= F.col("_rare")) & (F.col("_at") <= F.col("_rare") - short + 1 + SPARE_WORDS)
    partly = postings.join(useful, ["_word", "_stretch"]).where(inside).select("query_id", "source_id", short.alias("_short"))
    partly = partly.groupBy("query_id", "source_id").agg(F.count(F.lit(1)).alias("_shared"), F.first("_short").alias("_short"))
    partly = partly.where(F.col("_shared") >= F.least(F.col("_short"), F.lit(1 + SPARE_WORDS)))
    # What the common words no longer lift to the risen floor needs rare words, so the third round has it.
    still = lifted.join(floor, "query_id").where(F.col("score") >= F.col("_floor") - ROUNDING)
    pairs = still.select("query_id", "source_id").union(partly.select("query_id", "source_id"))
    return materialize(pairs.distinct(), "pairs")


def _rows_of(small: DataFrame):
    """A table of a few rows as one array value."""
    return small.agg(F.collect_list(F.struct(*small.columns)).alias("r")).select(F.coalesce("r", F.array()).alias("r")).scalar()


def _bit_numbers(column: str):
    """Numbers of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(COMMON_WORDS - 1)), lambda i: F.col(column).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)


def _scored(pairs: DataFrame, asked: DataFrame, sources: DataFrame) -> DataFrame:
    joined = pairs.join(asked, "query_id").join(sources, "source_id")
    similarity = X.lexical_similarity(F.col("_asked"), F.col("_words"))
    return joined.select("query_id", "source_id", similarity.alias("similarity"), "credibility").select(
        "query_id", "source_id", "similarity", (F.col("similarity") + F.col("credibility") * CREDIBILITY_WEIGHT).alias("score")
    )


def _best_of_each(scored: DataFrame) -> DataFrame:
    """One row per pair, with its place in its query; only places that a result may show are kept."""
    single = scored.groupBy("query_id", "source_id").agg(F.max("similarity").alias("similarity"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("source_id")))
    return single.withColumn("_place", place).where(F.col("_place") <= max(RANKED_BY_DEPTH.values()))


def shortlist(ranked: DataFrame, queries: DataFrame, pins: DataFrame) -> DataFrame:
    """First sources per query; a pinned source that was ranked but missed the cut moves to first place.

    ``pins``: (query_id, source_id), at most one per query.
    """
    limits = queries.select("query_id", _by_depth(SHORTLIST_BY_DEPTH, F.col("depth")).alias("_limit"))
    pinned = pins.select("query_id", F.col("source_id").alias("_pin"))
    joined = ranked.join(limits, "query_id").join(pinned, "query_id", "left")
    pulled = F.coalesce(F.col("source_id") == F.col("_pin"), F.lit(False)) & (F.col("rank") > F.col("_limit"))
    key = F.when(pulled, 0).otherwise(F.col("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(key))
    return joined.withColumn("place", place).where(F.col("place") <= F.col("_limit")).drop("_limit", "_pin")


def describe_sources(sources: DataFrame) -> DataFrame:
    """Cluster and snippet of each source: (source_id, source_type, credibility, text) in."""
    return sources.withColumns(
        {
            "cluster": X.credibility_cluster(F.col("source_type"), F.col("credibility")),
            "snippet": X.snippet(F.col("text")),
        }
    )


def _pieces(lowered, pattern: str):
    """The piece at every place of a text that a look-ahead pattern allows, in one pass."""
    return F.regexp_extract_all(lowered, F.lit(f"(?s)(?=({pattern}))"), F.lit(1))


def _rarest_pieces(places: DataFrame, lowered: DataFrame) -> DataFrame:
    """``places`` with the piece by which each name is found: the one that fewest sampled texts hold.

    A piece has ``PIECE`` letters, or all letters of a shorter name. The sample decides on work only.
    """
    size = F.least(F.length("needle"), F.lit(PIECE))
    starts = F.sequence(F.lit(1), F.length("needle") - size + 1)
    parts = places.select("*", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("needle", i, size)))).alias("_piece"))
    seen = lowered.limit(SAMPLED_TEXTS).select(F.explode(F.array_distinct(_pieces(F.col("_lowered"), f".{{{PIECE}}}"))).alias("_piece"))
    counted = seen.groupBy("_piece").agg(F.count(F.lit(1)).alias("_texts"))
    order = F.struct(F.coalesce("_texts", F.lit(0)), "_piece")
    chosen = parts.join(counted, "_piece", "left").groupBy("needle", "label", "size", "catalog_rank").agg(F.min_by("_piece", order).alias("_piece"))
    return materialize(chosen, "places")


def _letters_at(places: DataFrame) -> dict[int, str]:
    """Per length of piece a pattern of the letters that stand at each place of some piece.

    What reaches the driver are letters: at most the alphabet for each of ``PIECE`` places.
    """
    size = F.length("_piece")
    letters = places.select(size.alias("n"), F.posexplode(F.regexp_extract_all("_piece", F.lit("(?s)(.)"), F.lit(1))).alias("at", "letter"))
    sets: dict[int, dict[int, str]] = {}
    for row in letters.groupBy("n", "at").agg(F.sort_array(F.collect_set("letter")).alias("letters")).collect():
        codes = "".join(f"\\x{{{ord(letter):x}}}" for letter in row["letters"])
        sets.setdefault(row["n"], {})[row["at"]] = f"[{codes}]"
    return {n: "".join(found[at] for at in sorted(found)) for n, found in sets.items()}


def mentioned_place(texts: DataFrame, catalog: DataFrame, text: str = "text") -> DataFrame:
    """First catalog place named in each text, the longest name first, then catalog order.

    ``catalog``: (name, country, catalog_rank), of any size. A name is found through its rarest piece of a few
    letters, as an equality join. From a text come only pieces whose letters stand at the same places of some
    name's piece, so one pass over the text yields few; they move with a fingerprint of the text, not with it.
    """
    places = catalog.select(
        F.lower("name").alias("needle"),
        F.concat_ws(", ", "name", F.nullif("country", F.lit(""))).alias("label"),
        F.length("name").alias("size"),
        "catalog_rank",
    ).where(F.length("needle") > 0)
    places = _rarest_pieces(places, texts.select(F.lower(text).alias("_lowered")))
    patterns = _letters_at(places)
    identity = {"_id": F.xxhash64(text), "_id2": F.xxhash64(F.reverse(F.col(text)), F.length(text))}
    keyed = texts.withColumns({**identity, "_lowered": F.lower(text)})
    found = [_pieces(F.col("_lowered"), pattern) for _, pattern in sorted(patterns.items())]
    found = F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")
    candidates = keyed.select("_id", "_id2", F.explode(found).alias("_piece")).join(places, "_piece").drop("_piece").distinct()
    hits = (
        keyed.select("_id", "_id2", "_lowered")
        .join(candidates, ["_id", "_id2"])
        .where(F.contains("_lowered", "needle"))
        .groupBy("_id", "_id2")
        .agg(F.min(F.struct((-F.col("size")).alias("o"), "catalog_rank", "label")).alias("_best"))
    )
    named = keyed.join(hits, ["_id", "_id2"], "left").withColumn("place", F.col("_best.label"))
    return named.select(*texts.columns, "place")

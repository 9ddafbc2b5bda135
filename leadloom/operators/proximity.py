"""Nearest pairs of phrases in text: character offsets of two phrase lists, met by a bucketed band join.

Every match of a list becomes a row with its offsets. Rows of the two lists meet in buckets of the text as wide as the
band, so a pair is looked for only where both stand near each other, and one long text is spread over many keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .matching import phrase_pattern

#: The tier that each rule's items belong to.
TIER_OF_RULE = {"demand": "requirement_candidate", "opening": "awareness"}


def phrase_places(texts: DataFrame, key: str, text: str, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, kind, n, word, at, end) of every match of every list: n counts a list's matches from 0, leftmost first, without overlap.

    Offsets count characters from 0, end exclusive; words are in lower case with single spaces. `key` must tell rows apart.
    """
    parts = []
    for kind, phrases in lists.items():
        pattern = F.lit(phrase_pattern(list(phrases)))
        # A text's matches and the stretches before them alternate, so their lengths give the offsets.
        pieces = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"), F.split(text, pattern, -1).alias("before"))
        rows = texts.where(F.col(text).rlike(phrase_pattern(list(phrases)))).select(key, F.lit(kind).alias("kind"), F.posexplode(pieces).alias("n", "p"))
        parts.append(rows.select(key, "kind", "n", F.col("p.hit").alias("hit"), F.char_length("p.before").alias("skip")).where("hit IS NOT NULL"))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    size = F.char_length("hit")
    end = F.sum(F.col("skip") + size).over(Window.partitionBy(key, "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return every.withColumn("end", end).select(key, "kind", "n", F.lower(F.regexp_replace("hit", r"\s+", " ")).alias("word"), (F.col("end") - size).alias("at"), "end")


def nearest_pairs(places: DataFrame, key: str, first: str, second: str, gap: int) -> DataFrame:
    """(key, first_word, second_word, gap): the closest matches of kinds `first` and `second`, no more than `gap` characters apart.

    Overlapping matches are 0 apart and nearest of all. Of equally near pairs the first wins, by the place of the first
    kind's match, then of the second's; of overlapping ones the last. Texts without a near pair have no row.
    """
    width = 2 * gap + 64
    bucket = lambda since, to: F.explode(F.sequence(F.floor(since / width), F.floor(to / width)))
    own = lambda kind: places.where(F.col("kind") == kind)
    a = own(first).select(key, bucket(F.col("at") - gap, F.col("end") + gap).alias("bucket"), *(F.col(c).alias(f"a_{c}") for c in ("n", "word", "at", "end")))
    b = own(second).select(key, bucket(F.col("at"), F.col("end")).alias("bucket"), *(F.col(c).alias(f"b_{c}") for c in ("n", "word", "at", "end")))
    apart = F.when(F.col("a_at") <= F.col("b_at"), F.col("b_at") - F.col("a_end")).otherwise(F.col("a_at") - F.col("b_end"))
    near = a.join(b, [key, "bucket"]).withColumn("apart", apart).where(F.col("apart") <= gap)
    lap = F.col("apart") < 0
    order = F.struct(F.when(lap, -1).otherwise(F.col("apart")).alias("apart"), F.when(lap, -F.col("a_n")).otherwise(F.col("a_n")).alias("x"), F.when(lap, -F.col("b_n")).otherwise(F.col("b_n")).alias("y"), "a_word", "b_word")
    best = near.groupBy(key).agg(F.min(order).alias("o"))
    return best.select(key, F.col("o.a_word").alias("first_word"), F.col("o.b_word").alias("second_word"), F.greatest("o.apart", F.lit(0)).cast("long").alias("gap"))


def matched_items(items: DataFrame, key: str, text: str, profile) -> DataFrame:
    """(key, ok, rule, tier, keywords, gap, reason) of every item, by what its text says.

    demand: a produce phrase near a requirement phrase; else opening: an opening word near a venue. Items that name an
    excluded model of business match nothing and say so. Null and blank texts match nothing. `key` must tell rows apart.
    """
    given = items.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    excluded: Column = F.col("text").rlike("(?iu)" + "|".join(profile.exclude)) if profile.exclude else F.lit(False)
    lists = {"produce": profile.produce_words, "requirement": profile.requirement_words, "opening": profile.opening_words, "venue": profile.venue_words}
    places = materialize(phrase_places(given.where(~excluded), key, "text", lists), "places")
    told = lambda rule, pairs: pairs.select(key, F.struct(F.lit(rule).alias("rule"), F.array("first_word", "second_word").alias("keywords"), "gap").alias(rule))
    demand = told("demand", nearest_pairs(places, key, "produce", "requirement", profile.demand_gap))
    opening = told("opening", nearest_pairs(places, key, "opening", "venue", profile.opening_gap))
    met = given.select(key, excluded.alias("excluded")).join(demand, key, "left").join(opening, key, "left").withColumn("m", F.coalesce("demand", "opening"))
    tier = F.create_map(*[F.lit(x) for kv in TIER_OF_RULE.items() for x in kv])
    return met.select(key, F.col("m").isNotNull().alias("ok"), "m.rule", F.when(F.col("m").isNotNull(), tier[F.col("m.rule")]).alias("tier"), F.coalesce("m.keywords", F.array().cast("array<string>")).alias("keywords"), "m.gap", F.when(F.col("excluded"), "excluded operating model").alias("reason"))

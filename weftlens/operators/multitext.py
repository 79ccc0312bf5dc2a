"""Multi-text lookup: bigrams of every unit of a corpus, and the units that hold the feature pairs of a match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import pairs_of
from ..sources.scratch import sized, written


def bigrams(features: DataFrame) -> DataFrame:
    """features(text_id, unit, pos, inv, feature) to (text_id, unit, w1, w2, score), w1 < w2 or equal.

    Any two positions p1 < p2 of a unit count; of several for a pair the first (p1, p2) stays.
    score = ln((inv1 + inv2) / (p2 - p1)): adjacent words have distance 1 here. The first positions of two features that start apart are
    their first pair; of two at one position, or of a feature with itself, the next position of either follows. So two places of each
    feature are joined, each pair is made once, and no pair is shuffled or kept. The rows of a unit grow with the square of its distinct
    features; units are lines or phrases."""
    keys = ["text_id", "unit", "feature"]
    here = features.repartition("text_id", "unit").groupBy(*keys, "pos").agg(F.max(F.coalesce("inv", F.lit(0.0))).alias("inv"))
    order = Window.partitionBy(*keys).orderBy("pos")
    firsts = here.withColumns({"_nth": F.row_number().over(order), "next": F.lead("pos").over(order), "next_inv": F.lead("inv").over(order)}).filter("_nth = 1").drop("_nth")
    a, b = (firsts.select("text_id", "unit", *[F.col(c).alias(f"{c}{i}") for c in ("pos", "inv", "feature", "next", "next_inv")]) for i in (1, 2))
    both = a.join(b, ["text_id", "unit"]).filter("pos1 < pos2 or pos1 = pos2 and feature1 <= feature2 and (next1 is not null or next2 is not null)")
    near = F.col("next1") <= F.coalesce("next2", "next1")  # of two at one position: the first one's next place is not after the other's
    invs = F.when(F.col("pos1") < F.col("pos2"), F.col("inv1") + F.col("inv2")).when(near, F.col("next_inv1") + F.col("inv2")).otherwise(F.col("inv1") + F.col("next_inv2"))
    gap = F.when(F.col("pos1") < F.col("pos2"), F.col("pos2") - F.col("pos1")).otherwise(F.least("next1", "next2") - F.col("pos1"))
    return both.select("text_id", "unit", F.least("feature1", "feature2").alias("w1"), F.greatest("feature1", "feature2").alias("w2"), F.log(invs / gap).alias("score"))


def match_bigrams(matches: DataFrame) -> DataFrame:
    """matches(match_id, features) to (match_id, w1, w2): two-element combinations of the sorted features."""
    return matches.select("match_id", F.explode(pairs_of(F.array_sort("features"))).alias("x")).select("match_id", "x.w1", "x.w2")


def held(pairs: DataFrame, corpus_bigrams: DataFrame) -> DataFrame:
    """The corpus' bigrams (w1, w2, text_id, unit, score) that are among the pairs."""
    return corpus_bigrams.join(sized(written(pairs.select("w1", "w2").distinct())), ["w1", "w2"])


def lookup(pairs: DataFrame, corpus_bigrams: DataFrame, top: int | None = None) -> DataFrame:
    """(w1, w2, text_id, unit, score, place) of each distinct pair's units, best first; `top` keeps the first ones of a pair.

    Rows, not lists: a frequent pair is many rows, which the sort spills. With `top` the ranks are cut before the shuffle."""
    best = Window.partitionBy("w1", "w2").orderBy(F.desc("score"), "text_id", "unit")
    ranked = held(pairs, corpus_bigrams).withColumn("place", F.row_number().over(best))
    return ranked.filter(F.col("place") <= top) if top else ranked


def multitext(matches: DataFrame, corpus_bigrams: DataFrame, top: int | None = None) -> DataFrame:
    """(match_id, w1, w2, text_id, unit, score, place): the units of each pair of each match; a pair that no unit holds has
    one row without a unit."""
    pairs = match_bigrams(matches)
    return pairs.join(lookup(pairs, corpus_bigrams, top), ["w1", "w2"], "left").select("match_id", "w1", "w2", "text_id", "unit", "score", "place")


def of_unit_types(corpus_bigrams: DataFrame, texts: DataFrame, unit_type: str) -> DataFrame:
    """The bigrams of texts(text_id, is_prose): phrases of prose, else the asked unit type."""
    wanted = texts.select("text_id", F.when(F.col("is_prose"), "phrase").otherwise(unit_type).alias("unit_type"))
    return corpus_bigrams.join(F.broadcast(wanted.limit(100_000)) if wanted.count() <= 100_000 else wanted, ["text_id", "unit_type"], "left_semi")

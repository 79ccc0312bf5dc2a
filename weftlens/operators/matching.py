"""The core match: units of a source and a target that share at least two features, scored by rarity and proximity.

A target and a source position match if they share a feature outside the stoplist. A pair of units is a candidate if it has
two different matching position pairs. On each side the matched positions must have two distinct forms; the distance is
the sum of both sides', the score is ln(sum of inverse frequencies of the distinct positions) - ln(distance).

The plan: the stoplist goes first; then the target keeps the tokens whose feature the source has (a semi-join, broadcast up to
a checked size), so that the whole target is never shuffled on its most skewed column; inverse frequencies join what is left;
the tokens that are left are dealt out once, by target unit, and joined with the source there, so that the hits, which are many
more, are never shuffled; pairs of units with a single hit go before anything is collected. A source beyond a broadcast is
joined by feature, and the hits are dealt out by target unit. The hits of a feature are df_target * df_source, which the
stoplist keeps small; adaptive execution splits a skewed feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import fits, sized, written
from .frequency import least_shared, shared_sums

DISTANCES = ("frequency", "span")
PAIR = ["t_unit", "s_unit"]
#: Features with a common translation that one task pairs with all of them.
GROUP = 1000
#: Pairs of positions that a task sorts; a unit's stay together.
HITS = 1_000_000


def without_stopwords(features: DataFrame, stop: DataFrame | None) -> DataFrame:
    return features if stop is None else features.join(sized(stop.select("feature")), "feature", "left_anti")


def side(inv: str, pos: str, form: str) -> Column:
    """Distinct matched positions of a side, rarest first, ties by position."""
    return F.array_sort(F.collect_set(F.struct((-F.coalesce(F.col(inv), F.lit(0.0))).alias("k"), F.col(pos).alias("pos"), F.col(form).alias("form"))))


def trivial_distance(p: Column, q: Column) -> Column:
    """0 for the same position, else one more than the gap: adjacent is 2."""
    return F.when(p == q, 0).otherwise(F.abs(p - q) + 1)


def side_distance(s: Column, metric: str) -> Column:
    """0 unless two distinct forms match. frequency: rarest to next rarest position; span: first to last. Adjacent is 2."""
    forms = F.size(F.array_distinct(F.transform(s, lambda x: x["form"])))
    places = F.transform(s, lambda x: x["pos"])
    gap = F.array_max(places) - F.array_min(places) + 1 if metric == "span" else trivial_distance(F.get(s, F.lit(0))["pos"], F.get(s, F.lit(1))["pos"])
    return F.when(forms >= 2, gap).otherwise(0)


def span_of(places: Column) -> Column:
    """The older span distance of one side: last less first position, plus one."""
    return F.array_max(places) - F.array_min(places) + 1


def rarest_gap(places: Column) -> Column:
    """The older frequency distance of one side's array of (freq, pos): from the first position of the lowest frequency to the last
    one that has it, or to that of the next frequency if only one has it; plus one."""
    s = F.array_sort(F.transform(places, lambda x: F.struct(x["freq"].alias("freq"), x["pos"].alias("pos"))))
    low = F.size(F.filter(s, lambda x: x["freq"] == F.get(s, F.lit(0))["freq"]))
    return F.abs(F.get(s, F.greatest(low - 1, F.lit(1)))["pos"] - F.get(s, F.lit(0))["pos"]) + 1


def rarity(s: Column) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda a, x: a - x["k"])


def with_rarity(features: DataFrame, inv: DataFrame | None) -> DataFrame:
    """features with the column inv, from a table (form, inv) if one is given; null for a form that it lacks.

    Of a table beyond a broadcast only the forms of the features are kept, so that the features themselves are not shuffled."""
    if inv is None:
        return features if "inv" in features.columns else features.withColumn("inv", F.lit(None).cast("double"))
    inv = inv.select("form", "inv")
    if not fits(inv):
        inv = written(inv.join(features.select("form").distinct(), "form", "left_semi"))
    return features.drop("inv").join(sized(inv), "form", "left")


def dealt(near: DataFrame, far: DataFrame) -> DataFrame:
    """near by t_unit, in as many parts as their hits with far ask for: a task sorts about HITS of them, in memory."""
    df = near.groupBy("feature").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(far.groupBy("feature").agg(F.count(F.lit(1)).alias("_m"))), "feature")
    hits = df.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    parts = max(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hits // HITS))
    return near.repartition(min(parts, 100_000), "t_unit")


def position_pairs(target: DataFrame, source: DataFrame, t_inv: DataFrame | None = None, s_inv: DataFrame | None = None) -> DataFrame:
    """target, source (unit, pos, form, feature[, inv]) to position pairs with the shared feature, dealt out by t_unit."""
    shared = sized(source.select("feature").distinct())
    near = with_rarity(target.join(shared, "feature", "left_semi"), t_inv)
    far = with_rarity(source, s_inv)
    t, s = (x.select("feature", *[F.col(c).alias(f"{p}_{c}") for c in ("unit", "pos", "form", "inv")]) for x, p in ((near, "t"), (far, "s")))
    if fits(s):
        return dealt(t, s).join(F.broadcast(s), "feature")
    return t.join(s, "feature").repartition("t_unit")


def with_two_hits(pairs: DataFrame) -> DataFrame:
    """The pairs of positions of units that have two different ones. They stay where they are: t_unit decides the task."""
    unit = Window.partitionBy(*PAIR)
    both = F.shiftleft(F.col("t_pos").cast("long"), 32) + F.col("s_pos")
    return pairs.withColumn("_p", both).withColumns({"_a": F.min("_p").over(unit), "_b": F.max("_p").over(unit)}).filter("_a <> _b").drop("_p", "_a", "_b")


def scored(pairs: DataFrame, distance: str = "frequency", max_distance: int | None = 10, min_score: float | None = None) -> DataFrame:
    """position_pairs() to (t_unit, s_unit, features, distance, score, highlight)."""
    if distance not in DISTANCES:
        raise ValueError(f"unknown distance {distance!r}")
    hits = F.array_sort(F.collect_set(F.struct(F.col("s_pos"), F.col("t_pos"))))
    units = with_two_hits(pairs).groupBy(*PAIR).agg(
        hits.alias("highlight"), side("t_inv", "t_pos", "t_form").alias("_t"), side("s_inv", "s_pos", "s_form").alias("_s"), F.array_sort(F.collect_set("feature")).alias("features"))
    units = units.withColumns({"_dt": side_distance(F.col("_t"), distance), "_ds": side_distance(F.col("_s"), distance)})
    units = units.filter((F.col("_dt") > 0) & (F.col("_ds") > 0)).withColumn("distance", F.col("_dt") + F.col("_ds"))
    if max_distance is not None:
        units = units.filter(F.col("distance") <= max_distance)
    units = units.withColumn("score", F.log(rarity(F.col("_t")) + rarity(F.col("_s"))) - F.log("distance"))
    if min_score is not None:
        units = units.filter(F.col("score") >= min_score)
    return units.select("t_unit", "s_unit", "features", "distance", "score", "highlight")


def match(target: DataFrame, source: DataFrame, stop: DataFrame | None = None, t_inv: DataFrame | None = None, s_inv: DataFrame | None = None, **options) -> DataFrame:
    """target, source (unit, pos, form, feature), one row a token and feature; inverse frequencies from their column inv, or
    from tables (form, inv)."""
    return scored(position_pairs(without_stopwords(target, stop), without_stopwords(source, stop), t_inv, s_inv), **options)


def match_sound(target: DataFrame, source: DataFrame, stop: DataFrame | None = None, t_inv: DataFrame | None = None, s_inv: DataFrame | None = None,
                max_distance: int | None = 999, min_score: float | None = None) -> DataFrame:
    """Sound trigrams (unit, pos, idx, feature) with inverse frequencies (feature, inv): candidates and highlights as in match; then
    all shared trigrams count, the stoplist's too, with the index of their first occurrence in the unit and their multiplicities.
    Always the distance `frequency`. Trigrams are counted in the units of candidates only."""
    pairs = position_pairs(*(without_stopwords(x, stop).withColumn("form", F.col("feature")) for x in (target, source)))
    hits = F.array_sort(F.collect_set(F.struct(F.col("s_pos"), F.col("t_pos"))))
    found = written(with_two_hits(pairs).groupBy(*PAIR).agg(hits.alias("highlight"), F.array_sort(F.collect_set("feature")).alias("features")))

    def per(df: DataFrame, p: str, inv: DataFrame | None) -> DataFrame:
        units = sized(found.select(F.col(f"{p}_unit").alias("unit")).distinct())
        held = df.join(units, "unit", "left_semi").groupBy("unit", "feature").agg(F.min("idx").alias(f"{p}_idx"), F.count(F.lit(1)).alias(f"{p}_n"))
        table = held.select("feature").distinct().withColumn("inv", F.lit(None).cast("double")) if inv is None else inv.select("feature", "inv")
        return held.join(sized(table), "feature", "left").withColumnsRenamed({"unit": f"{p}_unit", "inv": f"{p}_inv"})

    both = found.select(*PAIR).join(per(target, "t", t_inv), "t_unit").join(sized(per(source, "s", s_inv)), ["s_unit", "feature"])
    weight = F.col("t_n") * F.col("s_n") * (F.coalesce("t_inv", F.lit(0.0)) + F.coalesce("s_inv", F.lit(0.0)))
    out = both.groupBy(*PAIR).agg(F.sum(weight).alias("_num"), side("t_inv", "t_idx", "feature").alias("_t"), side("s_inv", "s_idx", "feature").alias("_s"))
    out = out.withColumns({"_dt": side_distance(F.col("_t"), "frequency"), "_ds": side_distance(F.col("_s"), "frequency")}).filter((F.col("_dt") > 0) & (F.col("_ds") > 0))
    out = out.withColumn("distance", F.col("_dt") + F.col("_ds")).withColumn("score", F.log("_num") - F.log("distance"))
    if max_distance is not None:
        out = out.filter(F.col("distance") <= max_distance)
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    return out.join(found, PAIR).select("t_unit", "s_unit", "features", "distance", "score", "highlight")


def bridged(features: DataFrame, bridge: DataFrame, stop: DataFrame | None = None, far_stop: DataFrame | None = None) -> DataFrame:
    """Features carried over a translation table bridge(feature, other): those without a translation drop out."""
    near = without_stopwords(features, stop)
    return without_stopwords(near.join(sized(bridge), "feature").drop("feature").withColumnRenamed("other", "feature").distinct(), far_stop)


def match_bridge(near: DataFrame, far: DataFrame, bridge: DataFrame, stop: DataFrame | None = None, far_stop: DataFrame | None = None,
                 t_inv: DataFrame | None = None, s_inv: DataFrame | None = None, **options) -> DataFrame:
    """Cross-language match: the first side's features are translated, then matched with the second side's."""
    return scored(position_pairs(bridged(near, bridge, stop, far_stop), without_stopwords(far, far_stop), t_inv, s_inv), **options)


def bridge_closure(bridge: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(feature, sibling): features with a common translation, of a vocabulary (feature) if one is given.

    The rows are quadratic in the features that share a translation. They are made where two features meet at the least translation
    that they share, and never shuffled or kept; a translation that many share is dealt out in parts of GROUP features."""
    if vocabulary is not None:
        bridge = bridge.join(vocabulary.select("feature").distinct(), "feature", "left_semi")
    sets = bridge.groupBy("feature").agg(F.array_sort(F.collect_set("other")).alias("_set"))
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("_by")) / GROUP).cast("int")
    several = F.when(F.size("_set") > 1, F.col("_set"))  # one translation is shared or not: nothing to compare
    each = written(sets.select("feature", several.alias("_set"), F.explode("_set").alias("_by")).withColumn("_parts", parts))
    near = each.select("feature", F.col("_set").alias("_near"), "_by", F.pmod(F.xxhash64("feature"), F.col("_parts").cast("long")).cast("int").alias("_part"))
    far = each.select(F.col("feature").alias("sibling"), F.col("_set").alias("_far"), "_by", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    first = F.when(F.col("_near").isNull() | F.col("_far").isNull(), True).otherwise(least_shared("_near", "_far") == F.col("_by"))
    return near.join(far, ["_by", "_part"]).filter(first).select("feature", "sibling")


def bridge_inverse_frequencies(counts: DataFrame, total: int | Column, bridge: DataFrame) -> DataFrame:
    """(form, inv): total / (count of the form and of its distinct translation siblings). counts(form, n) are those of the
    tokens that share a lemma with the form; the bridge's features are looked up among the forms."""
    summed = shared_sums(bridge.select(F.col("feature").alias("form"), F.col("other").alias("feature")), counts)
    every = counts.filter(F.col("form").isNotNull()).select("form", "n").join(summed.withColumnRenamed("n", "_shared"), "form", "left").withColumn("n", F.coalesce("_shared", "n"))
    return every.select("form", F.try_divide(F.lit(total) if isinstance(total, int) else total, F.col("n")).alias("inv")).filter("inv is not null")

"""Frequencies: corpus, per text, inverse, averaged, and stoplists. All are aggregates with map-side partial sums."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written


def feature_counts(features: DataFrame, *keys: str) -> DataFrame:
    """Occurrences of each feature, in each group of keys: (*keys, feature, n)."""
    return features.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n"))


def counts_by_form(counts: DataFrame, featurizer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """counts(form, n) of tokens to (feature, n) of their features: a form's features are found once, not once a token."""
    each = featurizer(counts.select("form", "n")).select("n", F.explode("features").alias("feature"))
    return each.groupBy("feature").agg(F.sum("n").alias("n"))


def registered(occurrences: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """occurrences(language, feature, token, text_id, at) to new rows (language, feature, token, index) for the tokens that
    `known`, of the same columns, lacks: indexes go on from the count of each language and feature, by first occurrence.
    Whole numbers as text_id and at (not below 0) are cheaper.

    The numbers are needed by readers of a dense index only; the operators here join on the token itself."""
    first = F.min(F.struct("text_id", "at"))
    if {t for c, t in occurrences.dtypes if c in ("text_id", "at")} <= {"int", "bigint"}:  # one number in the same order: a hash aggregate, where a struct is sorted
        first = F.min(F.col("text_id").cast("decimal(19,0)") * F.lit(Decimal(10**19)) + F.col("at").cast("decimal(19,0)"))
    new = occurrences.groupBy("language", "feature", "token").agg(first.alias("_first"))
    group = Window.partitionBy("language", "feature").orderBy("_first", "token")  # distinct tokens of a vocabulary
    if known is None:
        return new.withColumn("index", F.row_number().over(group).cast("long") - 1).drop("_first")
    size = known.groupBy("language", "feature").agg(F.count(F.lit(1)).alias("_size"))
    new = new.join(known.select("language", "feature", "token"), ["language", "feature", "token"], "left_anti").join(F.broadcast(size), ["language", "feature"], "left")
    return new.withColumn("index", F.row_number().over(group) - 1 + F.coalesce("_size", F.lit(0))).drop("_first", "_size")


def text_counts(occurrences: DataFrame) -> DataFrame:
    """(language, feature, token, text_id, n): occurrences in each text."""
    return occurrences.groupBy("language", "feature", "token", "text_id").agg(F.count(F.lit(1)).alias("n"))


def corpus_frequencies(features: DataFrame) -> DataFrame:
    """(feature, n, freq): share of all occurrences."""
    n = feature_counts(features)
    total = n.agg(F.sum("n").alias("_all"))
    return n.join(F.broadcast(total)).withColumn("freq", F.col("n") / F.col("_all")).drop("_all")


def of_counts(counts: DataFrame, key: str = "form") -> DataFrame:
    """counts(key, n) to (key, inv): sum of all counts / the key's own. A null key counts in the sum only."""
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.filter(F.col(key).isNotNull()).join(F.broadcast(total)).select(key, (F.col("_all") / F.col("n")).alias("inv"))


def inverse_frequencies(tokens: DataFrame) -> DataFrame:
    """(form, inv): tokens of the text / occurrences of the form."""
    n = tokens.groupBy("form").agg(F.count(F.lit(1)).alias("_n"))
    total = tokens.agg(F.count(F.lit(1)).alias("_all"))  # digits count, as words without form
    return n.filter(F.col("form").isNotNull()).join(F.broadcast(total)).select("form", (F.col("_all") / F.col("_n")).alias("inv"))


def shared_sums(each: DataFrame, counts: DataFrame) -> DataFrame:
    """each(form, feature), counts(form, n) to (form, n): the sum over the forms that share a feature with it, each once, itself included.

    Forms with the same set of features are one class. Classes are joined, not forms, and two classes meet at the least feature that
    they share only, so that no pair is shuffled: each class's sum is added up where its pairs are made. The pairs are the sum over
    features of the square of the classes that have it; with one feature a form, there are as many as features."""
    sets = each.groupBy("form").agg(F.array_sort(F.collect_set("feature")).alias("_set"))
    forms = written(sets.join(counts.select("form", "n"), "form"))
    classes = written(forms.groupBy("_set").agg(F.sum("n").alias("_n")))
    near = classes.select(F.col("_set").alias("_near"), F.explode("_set").alias("_by"))
    far = classes.select(F.col("_set").alias("_far"), "_n", F.explode("_set").alias("_by"))
    sums = near.join(far, "_by").filter(least_shared("_near", "_far") == F.col("_by")).groupBy(F.col("_near").alias("_set")).agg(F.sum("_n").alias("n"))
    return forms.select("form", "_set").join(sums, "_set").select("form", "n")


def least_shared(a: str, b: str) -> Column:
    """The least element that two sorted arrays share."""
    return F.get(F.array_intersect(a, b), F.lit(0))


def _by_features(tokens: DataFrame) -> DataFrame:
    """tokens(form, features) to (form, features, n), written: the only pass over the text."""
    return written(tokens.groupBy("form", "features").agg(F.count(F.lit(1)).alias("n")))


def _cofeatures(per: DataFrame) -> DataFrame:
    per = per.filter(F.col("form").isNotNull())
    return shared_sums(per.select("form", F.explode("features").alias("feature")), per.groupBy("form").agg(F.sum("n").alias("n")))


def cofeature_counts(tokens: DataFrame) -> DataFrame:
    """tokens(form, features) to (form, n): tokens whose form shares a feature with it, itself included."""
    return _cofeatures(_by_features(tokens))


def inverse_cofeature_frequencies(tokens: DataFrame) -> DataFrame:
    """(form, inv): tokens of the text / cofeature_counts."""
    per = _by_features(tokens)
    total = per.agg(F.sum("n").alias("_all"))
    return _cofeatures(per).join(F.broadcast(total)).select("form", F.try_divide("_all", "n").alias("inv"))


def inverse_averaged_frequencies(tokens: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(form, inv): 1 / mean corpus frequency of the form's features."""
    each = tokens.filter(F.col("form").isNotNull()).select("form", F.explode("features").alias("feature")).distinct()
    return each.join(frequencies.select("feature", "freq"), "feature").groupBy("form").agg(F.try_divide(F.lit(1.0), F.avg("freq")).alias("inv"))


def summed_frequencies(counts: DataFrame, texts: list[str] | None = None) -> DataFrame:
    """(feature, n) over all texts of counts(text_id, feature, n), or some, most frequent first."""
    some = counts if texts is None else counts.filter(F.col("text_id").isin(texts))
    return some.groupBy("feature").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "feature")


def stoplist(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent features of counts(feature, n), ties by feature; a top-n, not a sort."""
    total = counts.groupBy("feature").agg(F.sum("n").alias("n")).filter("n > 0")
    return total.orderBy(F.desc("n"), "feature").limit(n)


def stoplist_of(spark, words: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "feature string")

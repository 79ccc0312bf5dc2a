"""Featurizers: form, sound trigrams, lemmata, semantic and semantic + lemmata from lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def form_features(tokens: DataFrame) -> DataFrame:
    """tokens(..., form) with `features` = [form]."""
    return tokens.withColumn("features", F.array("form"))


def sound_features(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("features", X.trigrams(F.col("form")))


def lemma_features(tokens: DataFrame, lemmata: DataFrame) -> DataFrame:
    """All lemmata(form, lemma) of each form; a form without one is its own lemma. Looked up once a distinct form."""
    per = lemmata.groupBy("form").agg(F.sort_array(F.collect_set("lemma")).alias("_l"))
    return _join(tokens, per, F.array("form"))


def semantic_features(tokens: DataFrame, lemmata: DataFrame, synonyms: DataFrame, with_lemmata: bool = False) -> DataFrame:
    """Synonyms(lemma, synonym) of the lemmata, else the lemma itself; with_lemmata adds the lemmata."""
    found = lemmata.select("form", "lemma").join(synonyms.select("lemma", "synonym"), "lemma", "left")
    each = F.when(F.col("synonym").isNull(), F.array("lemma")).otherwise(F.array("synonym", "lemma") if with_lemmata else F.array("synonym"))
    per = found.select("form", F.explode(each).alias("x")).groupBy("form").agg(F.sort_array(F.collect_set("x")).alias("_l"))
    return _join(tokens, per, F.array("form"))


def _join(tokens: DataFrame, per: DataFrame, otherwise) -> DataFrame:
    return tokens.join(per, "form", "left").withColumn("features", F.coalesce("_l", otherwise)).drop("_l").select(*tokens.columns, "features")


FEATURIZERS = {"form": form_features, "sound": sound_features, "test": sound_features, "lemmata": lemma_features, "semantic": semantic_features,
               "semantic + lemmata": lambda t, lem, syn: semantic_features(t, lem, syn, True)}


def featurize(tokens: DataFrame, feature: str, *tables: DataFrame) -> DataFrame:
    if feature not in FEATURIZERS:
        raise ValueError(f"unknown feature {feature!r}")
    return FEATURIZERS[feature](tokens, *tables)


def exploded(tokens: DataFrame) -> DataFrame:
    """One row a token and feature, `at` its place among the token's; tokens without a form or feature drop out."""
    rest = [c for c in tokens.columns if c != "features"]
    return tokens.filter(F.col("form").isNotNull()).select(*rest, F.posexplode("features").alias("at", "feature"))

"""Retrieval: ranks, pages, natural order, normalised scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import natural_key
from ..sources.scratch import written

NATURAL = ("source_tag", "target_tag", "matched_features")


def sort_key(by: str) -> Column:
    if by == "matched_features":
        return natural_key(F.array_join("matched_features", ", "))
    return natural_key(F.col(by)) if by in NATURAL else F.col(by)


def page(matches: DataFrame, sort_by: str | None = "score", order: str | None = "descending", per_page: int | None = None, number: int | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """A page (from 0) of the matches; all of them unsorted if an option is missing. A top-k, not a full sort."""
    if None in (sort_by, order, per_page, number):
        return matches
    key = sort_key(sort_by)
    return matches.orderBy(key.desc() if order.startswith("desc") else key.asc(), *tie).offset(per_page * number).limit(per_page)


def page_count(matches: DataFrame, per_page: int) -> int:
    return -(-matches.count() // per_page)


def trigram_places(features: DataFrame) -> DataFrame:
    """Exploded features of units with `idx`: the place of each among all of its unit, by position, then order in the word."""
    order = Window.partitionBy("unit").orderBy("pos", "at") if "at" in features.columns else Window.partitionBy("unit").orderBy("pos", "feature")
    return features.withColumn("idx", F.row_number().over(order) - 1)


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """A sorted table with the number of each row, from 1: one sort, then the counts of the partitions before.

    Rows get an id in the task that sorts them; the written ids and a few counts give the numbers, all on the JVM."""
    rows = written(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = rows.withColumn("_part", part).join(F.broadcast(before.select("_part", "_before")), "_part")  # a row a partition
    return out.withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1).drop("_at", "_part", "_before")


def ranked(matches: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """`result` from 1 by falling score, and `normal_score` = score * 10 / best."""
    matches = written(matches)  # else the sort's bounds, the sort and the best score would each make them anew
    best = matches.agg(F.max("score").alias("_best"))
    out = numbered(matches.orderBy(F.desc("score"), *tie), "result")
    return out.join(F.broadcast(best)).withColumn("normal_score", F.col("score") * 10 / F.col("_best")).drop("_best")


def pages(matches: DataFrame, per_page: int = 200, tie: tuple[str, ...] = ()) -> DataFrame:
    """Ranked matches with the number of their page, from 0."""
    return ranked(matches, tie).withColumn("page", F.floor((F.col("result") - 1) / per_page))


def summary(matches: DataFrame) -> DataFrame:
    """(n, max_score)."""
    return matches.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"))

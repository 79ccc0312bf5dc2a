"""Tagged text files: lines `<author. title. locus> text`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

EXTENSION = "tess"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, hash, content); hash is the MD5 of the file's bytes."""
    paths = [path] if isinstance(path, str) else path
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.md5("content").alias("hash"), F.decode("content", "UTF-8").alias("content"))


def all_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, line): every line, from 0, without the piece after a last newline."""
    body = F.regexp_replace("content", r"\r?\n\z", "")
    return read_files(spark, path).select("path", F.posexplode(F.split(body, "\r?\n")).alias("line_no", "line"))


def read_lines(spark: SparkSession, path: str | list[str], include_tag: bool = True) -> DataFrame:
    """(path, line_no, line, tag, body): tagged lines only, numbered from 0 as in the file."""
    lines = all_lines(spark, path).filter(X.is_tagged(F.col("line")))
    body = X.untagged(F.col("line"))
    return lines.select("path", "line_no", (F.col("line") if include_tag else body).alias("line"), X.tag_of(F.col("line")).alias("tag"), body.alias("body"))


def line_at(spark: SparkSession, path: str, number: int) -> str:
    """A single line by its number; IndexError beyond the end."""
    row = all_lines(spark, path).filter(F.col("line_no") == number).select("line").first()
    if row is None:
        raise IndexError(number)
    return row[0]


def line_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, lines): the length of each file."""
    return all_lines(spark, path).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


def read_tokens(spark: SparkSession, path: str | list[str], include_tag: bool = False) -> DataFrame:
    """(path, line_no, pos, token): blank-separated raw tokens."""
    lines = read_lines(spark, path)
    return lines.select("path", "line_no", F.posexplode(F.split(F.trim(F.col("line" if include_tag else "body")), r"\s+")).alias("pos", "token")).filter("token <> ''")


def violations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, line, problem): what a well-formed file has not.

    The name is `author.title[.part].tess`; each line of more than five characters has a tag whose author and title occur in
    the name, and a locus `major.minor` or `minor` that goes on by one, or starts a new major number at one. The first major
    number is the name's part."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "[.]")
    lines = all_lines(spark, path).filter(F.length(F.trim("line")) > 5).withColumns({"_name": name, "_parts": parts})
    inner = F.regexp_extract(F.trim("line"), r"^<([^>]*)>", 1)
    words = F.split(F.trim(inner), r"\s+")
    bare = lambda c: F.regexp_replace(c, "[.]$", "")
    locus = F.split(F.element_at(words, -1), "[.]")
    number = lambda i: F.regexp_extract(F.get(locus, F.lit(i)), r"^\d+", 0).try_cast("int")
    two = F.size(locus) >= 2
    part = F.when(F.size("_parts") > 2, F.element_at("_parts", -1).try_cast("int")).otherwise(1)
    w = Window.partitionBy("path").orderBy("line_no")
    at = lines.withColumns({"_tagged": inner != "", "_author": bare(F.get(words, F.lit(0))), "_title": bare(F.get(words, F.lit(1))), "_n": F.size(words),
                            "_major": F.when(two, number(0)).otherwise(F.coalesce(part, F.lit(1))), "_minor": F.when(two, number(1)).otherwise(number(0))})
    at = at.withColumns({"_pm": F.lag("_major").over(w), "_pn": F.lag("_minor").over(w), "_part": F.coalesce(part, F.lit(1))})
    has = lambda i, c: F.contains(F.coalesce(F.get("_parts", F.lit(i)), F.lit("")), F.col(c))
    first = F.col("_pm").isNull()
    problem = (F.when(~F.col("_tagged"), "no tag").when(F.col("_minor").isNull() | F.col("_major").isNull(), "no locus")
               .when((F.col("_n") >= 3) & ~(has(0, "_author") & has(1, "_title")), "author or title")
               .when(first & ~F.col("_major").isin(F.col("_part"), F.col("_part") + 1), "major locus").when(first & (F.col("_minor") != 1), "minor locus")
               .when(~first & ~F.col("_major").isin(F.col("_pm"), F.col("_pm") + 1), "major locus")
               .when(~first & (F.col("_major") == F.col("_pm")) & (F.col("_minor") != F.col("_pn") + 1), "minor locus")
               .when(~first & (F.col("_major") == F.col("_pm") + 1) & (F.col("_minor") != 1), "minor locus"))
    found = at.select("path", "line_no", "line", problem.alias("problem")).filter("problem is not null")
    named = read_files(spark, path).select("path").filter(~extension_ok(F.col("path")))
    return found.unionByName(named.select("path", F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit("extension").alias("problem")))


def extension_ok(path: Column) -> Column:
    return path.endswith(f".{EXTENSION}")

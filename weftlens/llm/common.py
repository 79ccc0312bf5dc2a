"""Helpers shared by the training-data operators: shared-folder tables, gapless ranks, word lookup."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

WORD = re.compile(r"\w+")
#: Cells of a small lookup table that may be broadcast; beyond it a shuffled join is planned.
BROADCAST_CELLS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session (tests) gets one of its own
    and a cluster gets an error, as its machines share no temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="weftlens-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    The files are removed when the driver exits. Those of a driver that died lie in a folder named after its application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner cleans it
        pass


#: Rows and characters of texts that a Python worker holds at once; a longer text is held alone.
PART_ROWS, PART_CHARS = 512, 1 << 22


def parts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most PART_ROWS rows and PART_CHARS characters of the column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > PART_CHARS or i - start >= PART_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def per_text(docs: DataFrame, keep: list[str], make: Callable[[], Callable], fields: str) -> DataFrame:
    """Rows that a Python function makes from `text`, with the columns `keep` of docs before them.

    make() is called once in a task and gives f(texts) -> (rows, columns): for each result its place in texts, or None for
    one result a text in order; and a list of values for each of `fields` (DDL). Texts may be None. The kept columns stay
    Arrow arrays of their own type, so that a large or null id comes back as it is. Spark bounds a batch by bytes."""
    kept = [docs.schema[c] for c in keep]
    made = StructType.fromDDL(fields)
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in parts_of(batch):
                rows, columns = f(part.column("text").to_pylist())
                held = [part.column(c) for c in keep]
                if rows is not None:
                    at = pa.array(rows, pa.int64())
                    held = [h.take(at) for h in held]
                values = [pa.array(v, x.type) for v, x in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(held + values, names=[*keep, *arrow.names])

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]).mapInArrow(run, StructType([*kept, *made.fields]))


def bounded_rows(rows: DataFrame, group: str, limit: int, chars: int) -> DataFrame:
    """A sample of rows(group, key, text) for a fit: of each group at most `limit` distinct keys and `chars` characters, lowest
    hashes first; texts longer than that are left out. Rows that repeat a key count once, so a repeated id can't fill it."""
    rows = rows.filter(F.length("text") <= chars).withColumn("_h", F.xxhash64("key", F.lit(11)))
    kinds = rows.groupBy(group).agg(F.approx_count_distinct("_h").alias("n")).collect()  # one row a group
    share = F.lit(0.0)
    for g, n in kinds:
        share = F.when(F.col(group).eqNullSafe(F.lit(g)), min(1.0, 2.0 * limit / max(n, 1))).otherwise(share)
    some = rows.filter(F.pmod("_h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share).groupBy(group, "_h", "key").agg(F.min("text").alias("text"))
    order = Window.partitionBy(group).orderBy(F.pmod("_h", F.lit(1 << 30)), "_h", "key")  # of about 2 * limit rows
    some = some.withColumns({"_n": F.row_number().over(order), "_c": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return some.filter((F.col("_n") <= limit) & (F.col("_c") <= chars)).select(group, "key", "text")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one column _doc, so that no column of theirs clashes with the operator's own; `_doc.*` unpacks it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *more)


def n_words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_slots(df: DataFrame, group: str, slot: str, per_cell: int = 100_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in an order that the rows' values decide.

    The group is cut into cells by a hash of the whole row; a cell's first slot is the count of the cells before it.
    Rows that are equal in all columns are counted before the shuffle and expanded after it, so neither a large group
    nor a much-repeated row meets in one task. df must be narrow: all its columns are shuffled."""
    cols = df.columns
    rows = df.count()
    cells = max(32, math.ceil(rows / per_cell))
    hashed = df.withColumn("_cell", F.pmod(F.xxhash64(*cols), F.lit(cells)).cast("int"))
    runs = hashed.groupBy(*cols, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(group, "_cell").orderBy(*cols)
    within = runs.withColumn("_from", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    sizes = hashed.groupBy(F.col(group).alias("_g"), F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    groups = df.select(group).distinct().count()
    if groups * cells <= BROADCAST_CELLS:
        offsets = F.broadcast(offsets)
    start = F.col("_from") + F.col("_before")
    return (within.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_c")))
            .withColumn(slot, F.explode(F.sequence(start, start + F.col("_n") - 1)))
            .select(*cols, slot))


def known_words(texts: list[str], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of the lower-cased texts in a row (0: not in vocab) and where each text starts."""
    get, ids, starts = vocab.get, [], [0]
    for t in texts:
        ids += [get(w, 0) for w in WORD.findall(t.lower())]
        starts.append(len(ids))
    return np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64)


def gram_codes(ids: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """A 64-bit hash of the ids at i + place for every i; -1 where an id is 0. Places start with 0 and ascend."""
    m = len(ids) - places[-1]
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    h, known = np.full(m, sum(1 << k for k in places), dtype=np.uint64), np.ones(m, dtype=bool)
    for k in places:
        part = ids[k:k + m]
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        known &= part != 0
    out = (h >> np.uint64(1)).astype(np.int64)
    out[~known] = -1
    return out


def member(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Indexes of codes that are in keys (sorted)."""
    if not len(keys) or not len(codes):
        return np.zeros(0, dtype=np.int64)
    maybe = np.nonzero(codes >= 0)[0]
    c = codes[maybe]
    return maybe[keys[np.minimum(np.searchsorted(keys, c), len(keys) - 1)] == c]


#: Rows that one key may bring to a task of a join before they are dealt out.
HUB_ROWS = 100_000


def hub_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = HUB_ROWS) -> DataFrame:
    """left.join(right, key, how) where right has one row a key, or few, and a key may hold a third of left.

    A key with more than max(least, rows / 1000) rows of left is a hub; there are less than 1000. The rows of a hub are
    dealt out by a salt, and its row of right is repeated for each salt."""
    rows = left.count()
    if rows <= least:
        return left.join(right, key, how)
    per = max(least, rows // 1000)
    hubs = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > per)
    hubs = F.broadcast(written(hubs.select(F.col(key).alias("_hub"), F.ceil(F.col("_n") / per).cast("int").alias("_s"))))  # under 1000 rows
    salts = lambda df: df.join(hubs, F.col(key) == F.col("_hub"), "left").withColumn("_s", F.coalesce("_s", F.lit(1)))
    a = salts(left).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.col("_s")).cast("int")).drop("_s", "_hub")
    b = salts(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s", "_hub")
    return a.join(b, [key, "_salt"], how).drop("_salt")

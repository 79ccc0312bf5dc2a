"""A store of Parquet tables with natural keys: insert without duplicates, upsert, delete, cascade, bootstrap.

A table is a folder of data files and a log. Each log entry lists the leaf folders that make the table from then on; a write adds
files and then an entry, so readers see all of it or nothing, and a DataFrame planned before goes on reading its own files.
`vacuum` removes files that the last entries don't name. Large tables are partitioned by what they are read and replaced by, so
an insert only adds files and a delete of a text or search only drops its folders."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.predicates import build_filter
from .scratch import sized, written

KEYS = {
    "texts": ["language", "title", "author"], "tokens": ["text_id", "index"], "units": ["text_id", "unit_type", "unit", "pos"],
    "features": ["language", "feature", "token"], "feature_freq": ["language", "feature", "token", "text_id"], "matches": ["search_id", "match_id"],
    "searches": ["results_id"], "multiresults": ["search_id", "match_id", "w1", "w2", "text_id", "unit"], "stopwords": ["name"], "dictionary": ["kind", "language", "key", "value"],
    "bigrams": ["text_id", "unit_type", "feature", "unit", "w1", "w2"],
}
#: What stands in for indexes: a lookup by these columns reads their folders only.
PARTITIONS = {"texts": ["text_id"], "stopwords": ["name"], "units": ["text_id", "unit_type"], "tokens": ["text_id"], "feature_freq": ["language", "feature", "text_id"], "bigrams": ["text_id", "unit_type", "feature"],
              "matches": ["search_id"], "multiresults": ["search_id"], "searches": ["results_id"], "dictionary": ["kind", "language"], "features": ["language", "feature"]}
#: And the order within files, so that row groups are skipped.
SORTED = {"bigrams": ["w1", "w2"], "matches": ["score"], "units": ["unit", "pos"]}


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows, one a natural key, whose key is not there yet."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def pipeline(table: DataFrame, stages: Iterable[dict]) -> DataFrame:
    """A chain of stages, each a dict of one entry: match (Column or keyword filters), project (names, or {name: Column}), set
    ({name: Column}), unwind (array column), sort ([(column, ascending)]), skip, limit, lookup ({from, on, as})."""
    for stage in stages:
        (kind, v), = stage.items()
        if kind == "match":
            table = table.filter(build_filter(**v) if isinstance(v, dict) else v)
        elif kind == "project":
            table = table.select(*([c.alias(k) for k, c in v.items()] if isinstance(v, dict) else v))
        elif kind == "set":
            table = table.withColumns(v)
        elif kind == "unwind":
            table = table.withColumn(v, F.explode(v))
        elif kind == "sort":
            table = table.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in v])
        elif kind == "skip":
            table = table.offset(v)
        elif kind == "limit":
            table = table.limit(v)
        elif kind == "lookup":
            table = lookup(table, v["from"], v["on"], v["as"])
        else:
            raise ValueError(f"unknown stage {kind!r}")
    return table


def lookup(left: DataFrame, right: DataFrame, on: list[str], name: str, order: list[str] | None = None) -> DataFrame:
    """left with an array column of the rows of right that agree on `on`; empty where none does."""
    rest = [c for c in right.columns if c not in on]
    each = F.struct(*(order or []), *[c for c in rest if c not in (order or [])])
    lists = right.groupBy(*on).agg(F.array_sort(F.collect_list(each)).alias(name))
    kind = lists.schema[name].dataType.simpleString()
    return left.join(lists, on, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def referring(rows: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Rows that name a row of gone(id) in one of the columns, scalars or arrays: a cascade's semi-join."""
    array = [c for c in columns if rows.schema[c].dataType.typeName() == "array"]
    named = F.array_distinct(F.array_compact(F.concat(F.array(*[F.col(c) for c in columns if c not in array]), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in array])))
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    hit = keyed.select("_row", F.explode(named).alias("id")).join(sized(gone.select("id").distinct()), "id", "left_semi").select("_row").distinct()
    return keyed.join(hit, "_row", "left_semi").drop("_row")


class Store:
    """Tables under one folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(self._path(self.root)).toString()  # as the file system names it in lists

    # the log

    def _list(self, path: str) -> list:
        p = self._path(path)
        return list(self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _entries(self, table: str) -> list[str]:
        return sorted(s.getPath().toString() for s in self._list(f"{self.root}/{table}/_log") if s.getPath().getName().endswith(".json"))

    def _entry(self, table: str) -> dict | None:
        paths = self._entries(table)
        if not paths:
            return None
        stream = self._fs.open(self._path(paths[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": len(paths) and int(paths[-1].rsplit("/", 1)[1][:-5])}
        finally:
            stream.close()

    def _commit(self, table: str, number: int, leaves: list[str], schema: StructType) -> None:
        """Fails if another writer has made this entry."""
        out = self._fs.create(self._path(f"{self.root}/{table}/_log/{number:010d}.json"), False)
        try:
            out.write(bytearray(json.dumps({"leaves": sorted(leaves), "schema": json.loads(schema.json())}).encode()))
        finally:
            out.close()

    def _leaves(self, folder: str) -> list[str]:
        found, todo = [], [folder]
        while todo:
            at = todo.pop()
            inner = [s for s in self._list(at) if s.isDirectory()]
            todo += [s.getPath().toString() for s in inner]
            if not inner and any(s.getPath().getName().endswith(".parquet") for s in self._list(at)):
                found.append(at)
        return found

    @staticmethod
    def _values(leaf: str) -> dict[str, str]:
        return {k: unquote(v) for k, v in (x.split("=", 1) for x in leaf.split("/") if "=" in x)}

    def _add(self, table: str, df: DataFrame, few: bool = False) -> list[str]:
        """Write rows; the leaf folders that hold them."""
        folder = f"{self.root}/{table}/_gen={uuid.uuid4().hex}"
        by, order = PARTITIONS.get(table, []), [c for c in SORTED.get(table, []) if c in df.columns]
        if few:
            df = df.coalesce(1)
        elif by:
            df = df.repartition(*by, *[F.pmod(F.xxhash64(*order), F.lit(16)) for _ in order[:1]]) if order else df.repartition(*by)
        if order:
            df = df.sortWithinPartitions(*by, *order)
        (df.write.partitionBy(*by) if by else df.write).parquet(folder)
        return self._leaves(folder)

    # reading

    def exists(self, table: str) -> bool:
        return self._entry(table) is not None

    def _of(self, entry: dict, leaves: list[str], table: str) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        if not leaves:
            return self.spark.createDataFrame([], schema)
        names = schema.fieldNames()
        return self.spark.read.schema(StructType([*schema.fields]).add("_gen", "string")).option("basePath", f"{self.root}/{table}").parquet(*leaves).select(*names)

    def read(self, table: str, **prune: str | list[str]) -> DataFrame:
        """The table; `prune` names partition columns and the values whose folders are read."""
        entry = self._entry(table)
        if entry is None:
            raise ValueError(f"no table {table!r}")
        wanted = {k: {str(x) for x in ([v] if isinstance(v, str) else v)} for k, v in prune.items() if k in PARTITIONS.get(table, []) and isinstance(v, (str, list, tuple, set))}
        return self._of(entry, [leaf for leaf in entry["leaves"] if all(self._values(leaf).get(k) in v for k, v in wanted.items())], table)

    def find(self, table: str, sort: list | None = None, **wanted) -> DataFrame:
        """Rows by keyword filters; those on partition columns choose folders, the others are pushed to the files."""
        out = self.read(table, **wanted).filter(build_filter(**wanted))
        return out.orderBy(*sort) if sort else out

    # writing

    def _change(self, table: str, df: DataFrame | None, drop: set[str] | None = None, few: bool = False) -> None:
        """Add rows and drop leaf folders in one entry."""
        entry = self._entry(table)
        old = entry["leaves"] if entry else []
        schema = StructType.fromJson(entry["schema"]) if entry else StructType()
        if df is not None:
            schema = StructType([*schema.fields, *[f for f in df.schema.fields if f.name not in schema.fieldNames()]])
        for f in schema.fields:
            f.nullable = True
        fresh = self._add(table, df, few) if df is not None else []
        self._commit(table, entry["number"] + 1 if entry else 0, [x for x in old if not drop or x not in drop] + fresh, schema)

    def write(self, table: str, df: DataFrame) -> None:
        """Replace the whole table."""
        entry = self._entry(table)
        self._change(table, df, set(entry["leaves"]) if entry else None)

    def insert(self, table: str, df: DataFrame, check: bool = True) -> int | None:
        """Append rows, without `check` all of them, else one for each natural key that is not there yet; then the number of rows."""
        if not check:
            self._change(table, df)
            return None
        keys = KEYS[table]
        df = written(new_rows(self.read(table), df, keys) if self.exists(table) else df.dropDuplicates(keys))
        n = df.count()
        if n or not self.exists(table):
            self._change(table, df)
        return n

    def _touched(self, table: str, rows: DataFrame) -> set[str]:
        """Leaf folders of the partitions that rows name."""
        by, leaves = PARTITIONS.get(table, []), self._entry(table)["leaves"]
        if not by:
            return set(leaves)
        named = {tuple(map(str, r)) for r in rows.select(*by).distinct().collect()}  # one row a partition that changes
        return {x for x in leaves if tuple(self._values(x).get(k) for k in by) in named}

    def update(self, table: str, df: DataFrame) -> None:
        """Replace rows by natural key; ValueError if one is not there. Only the partitions that hold them are written."""
        keys = KEYS[table]
        touched = self._touched(table, df)
        now = self._of(self._entry(table), sorted(touched), table)
        if not df.join(now.select(*keys), keys, "left_anti").isEmpty():
            raise ValueError("a row to update does not exist")
        self._change(table, written(upserted(now, df, keys)), touched)

    def put(self, table: str, rows: list[dict], schema: str) -> None:
        """Add a few rows of a partitioned table in the place of those of their partitions: nothing is read."""
        named = {tuple(str(r[k]) for k in PARTITIONS[table]) for r in rows}
        entry = self._entry(table)
        old = {x for x in (entry["leaves"] if entry else []) if tuple(self._values(x).get(k) for k in PARTITIONS[table]) in named}
        self._change(table, self.spark.createDataFrame(rows, schema), old, few=True)

    def upsert(self, table: str, df: DataFrame) -> None:
        if not self.exists(table):
            self.insert(table, df)
            return
        touched = self._touched(table, df)
        self._change(table, written(upserted(self._of(self._entry(table), sorted(touched), table), df, KEYS[table])), touched)

    def delete(self, table: str, **wanted) -> None:
        """Delete by keyword filters; a filter on partition columns alone only drops folders."""
        if not wanted:
            raise ValueError("nothing to delete")
        entry, by = self._entry(table), PARTITIONS.get(table, [])
        if entry is None:
            return
        values = {k: {str(x) for x in ([v] if isinstance(v, str) else v)} for k, v in wanted.items() if k in by and isinstance(v, (str, list, tuple, set))}
        hit = {x for x in entry["leaves"] if all(self._values(x).get(k) in v for k, v in values.items())}
        if len(values) == len(wanted):
            self._change(table, None, hit)
            return
        rows = self._of(entry, sorted(hit), table)
        gone = F.coalesce(build_filter(**wanted), F.lit(False))
        touched = hit & self._touched(table, rows.filter(gone))
        self._change(table, written(self._of(entry, sorted(touched), table).filter(~gone)), touched)

    def delete_rows(self, table: str, rows: DataFrame) -> None:
        """Delete by the natural keys of given rows; ValueError for none."""
        if rows.isEmpty():
            raise ValueError("nothing to delete")
        touched = self._touched(table, rows)
        now = self._of(self._entry(table), sorted(touched), table)
        self._change(table, written(now.join(rows.select(*KEYS[table]), KEYS[table], "left_anti")), touched)

    def vacuum(self, keep: int = 2) -> int:
        """Remove files that none of a table's last `keep` entries names, and older entries; the number of removed folders.

        To be run while no reader still uses an older plan."""
        removed = 0
        for table in [s.getPath().getName() for s in self._list(self.root) if s.isDirectory()]:
            entries = self._entries(table)
            named: set[str] = set()
            for path in entries[-keep:]:
                stream = self._fs.open(self._path(path))
                named |= set(json.loads(bytes(stream.readAllBytes()).decode())["leaves"])
                stream.close()
            for path in entries[:-keep]:
                self._fs.delete(self._path(path), False)
            for leaf in self._leaves(f"{self.root}/{table}"):
                if leaf not in named:
                    self._fs.delete(self._path(leaf), True)
                    removed += 1
        return removed

    # cascades

    def remove_text(self, text_id: str) -> None:
        """Delete a text with its tokens, units, frequencies, bigrams, and the searches that name it, with their results."""
        for table in ("tokens", "units", "feature_freq", "bigrams"):
            if self.exists(table):
                self.delete(table, text_id=text_id)
        if self.exists("texts"):
            self.delete("texts", text_id=text_id)
        if self.exists("searches"):
            gone = self.spark.createDataFrame([(text_id,)], "id string")
            self.remove_searches(referring(self.read("searches"), gone, "source_text", "target_text", "text_ids").select("results_id"))

    def remove_searches(self, ids: DataFrame | list[str]) -> None:
        """Delete searches(results_id), their matches, and the multi-text searches that start from them."""
        if isinstance(ids, list):
            ids = self.spark.createDataFrame([(x,) for x in ids], "results_id string")
        ids = written(ids.select("results_id").distinct())
        if not self.exists("searches") or ids.isEmpty():
            return
        now = self.read("searches")
        if "parallels_id" in now.columns:
            ids = written(ids.unionByName(now.join(ids.select(F.col("results_id").alias("parallels_id")), "parallels_id", "left_semi").select("results_id")).distinct())
        for table, key in (("searches", "results_id"), ("matches", "search_id"), ("multiresults", "search_id")):
            if self.exists(table):  # folders only
                self._change(table, None, self._touched(table, ids.select(F.col("results_id").alias(key))))


def searches_of(searches: DataFrame, text_id: str) -> DataFrame:
    return referring(searches, searches.sparkSession.createDataFrame([(text_id,)], "id string"), "source_text", "target_text", "text_ids")


def without_text(frequencies: DataFrame, text_id: str, column: str = "frequencies") -> DataFrame:
    """Drop one text's entry of a map column."""
    return frequencies.withColumn(column, F.map_filter(column, lambda k, v: k != text_id))

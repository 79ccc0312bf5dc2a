"""Rows as JSON and back, flat column names, and hashes of natural keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def encoded(df: DataFrame, exclude: tuple[str, ...] = (), name: str = "json") -> DataFrame:
    """One JSON object a row; nulls stay as null fields, ids are strings already."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in exclude]), {"ignoreNullFields": "false"}).alias(name))


def decoded(lines: DataFrame, schema: StructType | str, name: str = "json") -> DataFrame:
    """Rows of JSON objects; a field that the schema lacks goes, with its text, into the map `extras` if the schema has one."""
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    out = lines.select(F.from_json(name, fields).alias("_r"), F.from_json(name, "map<string,string>").alias("_m"))
    if "extras" not in fields.fieldNames():
        return out.select("_r.*")
    known = [f.name for f in fields.fields]
    rest = F.map_filter("_m", lambda k, v: ~k.isin(known))
    return out.select(*[F.map_concat(F.coalesce("_r.extras", F.create_map().cast("map<string,string>")), rest).alias("extras") if c == "extras" else F.col(f"_r.{c}") for c in known])


def flattened(df: DataFrame) -> DataFrame:
    """Struct columns as columns with dotted names."""
    def leaves(at: str, schema: StructType) -> list[Column]:
        out = []
        for f in schema.fields:
            path = f"{at}.`{f.name}`" if at else f"`{f.name}`"
            out += leaves(path, f.dataType) if isinstance(f.dataType, StructType) else [F.col(path).alias(path.replace("`", ""))]
        return out

    return df.select(*leaves("", df.schema))


def key_hash(keys: list[str]) -> Column:
    """Equal for rows with equal natural keys."""
    return F.xxhash64(*keys)

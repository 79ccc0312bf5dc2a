"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A key goes down the tree: at each level it draws once for every child of the node where it is, and goes on in the child
with the least draw. A draw is exponential, from a hash of (key, child), with the child's summed weight as its rate, so
regions, racks and shards are picked in proportion to their weights, and the work is that of the children on one path, not of
all shards. A change of weight moves keys only into or out of the subtrees whose sums it changes; in every other subtree each
key that stays keeps its place. One more shard opens a region of its own, so that it takes rows only into itself: the law of
the result is `key`, as doc_id and the shard count decide.

Slots number the rows of a shard without gaps, in an order that doc_id, size and checksum decide.

Defined results: a null doc_id is a key of its own; null text has size 1 and the checksum of the empty string; repeated
rows share a shard and get slots of their own; equal draws go to the lower number; a subtree without weight is never
entered, and a tree without weight is an error; an empty table gives no rows; columns of docs other than doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_slots, written

RACK, REGION = 2, 4


@dataclass(frozen=True)
class Shard:
    number: int
    rack: int
    region: int
    weight: float = 1.0


def layout(shards: int, weights: dict[int, float] | None = None) -> list[Shard]:
    """Shards in racks of two and regions of two racks."""
    return [Shard(i, i // RACK, i // REGION, (weights or {}).get(i, 1.0)) for i in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a rack and region of its own."""
    new = [1 + max((getattr(s, f) for s in tree), default=-1) for f in ("number", "rack", "region")]
    return [*tree, Shard(*new, weight)]


def children(tree: list[Shard]) -> list[dict[str, list[tuple[str, float]]]]:
    """Level by level, from the root: node -> its children with a weight, each with the sum of its shards' weights."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for s in tree:
        if s.weight > 0:
            path = ("root", f"region{s.region}", f"rack{s.region}.{s.rack}", f"shard{s.number}")
            for level, up, down in zip(levels, path[:-1], path[1:], strict=True):
                at = level.setdefault(up, {})
                at[down] = at.get(down, 0.0) + s.weight
    if not levels[0]:
        raise ValueError("no shard has a weight")
    return [{up: list(at.items()) for up, at in level.items()} for level in levels]


def place(key: Column, tree: list[Shard]) -> Column:
    """The number of the shard where the descent of a key ends."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    node, levels = F.lit("root"), children(tree)

    def draw(child: Column) -> Column:
        uniform = (F.conv(F.substring(F.md5(F.concat_ws(":", key, child["name"])), 1, 12), 16, 10).cast("double") + 1) / F.lit(float((1 << 48) + 1))
        return F.struct((-F.log(uniform) / child["weight"]).alias("draw"), child["order"].alias("order"), child["name"].alias("name"))

    for level in levels:
        lists = [F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("order")) for i, (name, w) in enumerate(at)]) for at in level.values()]
        below = F.element_at(F.create_map(*[x for up, kids in zip(level, lists, strict=True) for x in (F.lit(up), kids)]), node)
        node = F.array_min(F.transform(below, draw))["name"]
    return F.substring(node, 6, 9).cast("int")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """docs(doc_id, text) to (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        place(F.col("doc_id"), layout(shards)).alias("shard"), place(F.col("doc_id"), grown(layout(shards))).alias("grown_shard"))
    slotted = with_slots(written(rows), "shard", "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))

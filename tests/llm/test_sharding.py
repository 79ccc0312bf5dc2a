"""Sharding: shares, movement, gapless slots."""

import hashlib
import math
import zlib
from collections import Counter

import pytest

from weftlens.llm import sharding as H
from weftlens.llm.common import with_slots

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, f"text {i % 50} é") for i in range(8000)] + [(None, None), (5, "text 5 é"), (5, "text 5 é"), (6, "")] + [(77777, "hot")] * 3000
    return H.shard(spark.createDataFrame(rows, SCHEMA)).collect()


def test_sizes_and_checksums(got):
    assert len(got) == 11004
    for r in got:
        if r.doc_id is not None and r.doc_id < 8000 and r.size > 1:
            t = f"text {r.doc_id % 50} é".encode()
            assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t)
    none = next(r for r in got if r.doc_id is None)
    assert none.size == 1 and none.text_crc32 == 0


def test_one_more_shard_takes_rows_only_into_itself(got):
    assert {r.law for r in got} == {"key"} and {r.shard for r in got} == set(range(16))
    assert all(r.grown_shard in (r.shard, 16) for r in got) and any(r.grown_shard == 16 for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
    sizes = Counter(s for s, _ in by.values())
    assert max(sizes.values()) < 1.25 * len(by) / 16 and min(sizes.values()) > 0.75 * len(by) / 16


def test_slots_have_no_gaps(got):
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def descent(key, tree):
    """A plain tree: draws of the children of one node at a time."""
    path = []
    for field in ("region", "rack", "number"):
        sums = {}
        for s in tree:
            if all(getattr(s, f) == v for f, v in path) and s.weight > 0:
                sums[getattr(s, field)] = sums.get(getattr(s, field), 0) + s.weight
        region = dict(path).get("region")
        name = {"region": "region{}", "rack": f"rack{region}.{{}}", "number": "shard{}"}[field]

        def draw(v):
            u = (int(hashlib.md5(f"{key}:{name.format(v)}".encode()).hexdigest()[:12], 16) + 1) / ((1 << 48) + 1)
            return -math.log(u) / sums[v]

        path.append((field, min(sums, key=draw)))
    return tuple(v for _, v in path)


def placed(spark, tree, n):
    return {r.id: r.s for r in spark.range(n).select("id", H.place(H.F.col("id"), tree).alias("s")).collect()}


TREES = {"even": H.layout(16), "weighted": H.layout(9, {0: 0.5, 3: 4.0, 7: 0.0}), "one": H.layout(1), "lopsided": [H.Shard(4, 9, 2), H.Shard(11, 9, 2, 3.0), H.Shard(5, 9, 3, 0.25), H.Shard(7, 1, 3)]}


@pytest.mark.parametrize("name", TREES)
def test_places_are_those_of_a_plain_descent(spark, name):
    assert placed(spark, TREES[name], 1500) == {i: descent(i, TREES[name])[2] for i in range(1500)}


def test_rack_and_region_decide(spark):
    flat = [H.Shard(s.number, s.number, s.number) for s in H.layout(16)]
    swapped = [H.Shard(s.number, s.rack + 1, s.region) for s in H.layout(16)]
    even, a, b = placed(spark, H.layout(16), 3000), placed(spark, flat, 3000), placed(spark, swapped, 3000)
    assert 0.7 < sum(even[i] != a[i] for i in even) / 3000 and 0.3 < sum(even[i] != b[i] for i in even) / 3000


def test_a_change_of_weight_moves_rows_only_in_its_subtree(spark):
    n, tree = 20000, H.layout(16)
    before, after = placed(spark, tree, n), placed(spark, H.layout(16, {5: 3.0}), n)
    at = {s.number: s for s in tree}
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved and all(at[b].region == 1 for _, b in moved)  # into region 1, or within it
    assert all(at[b].rack == 2 for a, b in moved if at[a].region == 1)  # within region 1 only into rack 2
    assert all(b == 5 for a, b in moved if at[a].rack == 2)  # within rack 2 only into shard 5
    assert abs(sum(s == 5 for s in after.values()) / n - 3 / 18) < 0.02
    assert not any(s == 0 for s in placed(spark, H.layout(8, {0: 0.0}), 2000).values())
    with pytest.raises(ValueError):
        H.place(H.F.col("id"), H.layout(1, {0: 0.0}))


def test_growth_at_any_size_takes_rows_only_into_the_new_shard(spark):
    for shards in (1, 6, 16, 17):
        before, after = placed(spark, H.layout(shards), 3000), placed(spark, H.grown(H.layout(shards)), 3000)
        moved = {after[i] for i in before if before[i] != after[i]}
        assert moved == {shards}


def test_slots_of_many_cells(spark):
    df = spark.range(5000).selectExpr("id % 3 as g", "id % 40 as v")
    got = with_slots(df, "g", "slot", per_cell=50).toPandas()
    assert len(got) == 5000 and all(sorted(x) == list(range(len(x))) for _, x in got.groupby("g")["slot"])


def test_empty(spark):
    assert H.shard(spark.createDataFrame([], SCHEMA)).collect() == []

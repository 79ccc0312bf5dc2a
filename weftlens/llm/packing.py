"""Packing into optimal length buckets.

Dynamic programming over the exact global histogram of lengths chooses at most `buckets` upper bounds so that the padding,
the sum over texts of bound minus length, is least. In a bucket with bound b, batches of floor(budget / b) texts (one at
least) are formed, so a padded batch holds at most `budget` tokens unless a single text is longer.

The histogram has one row a distinct length; its size follows the longest text, not the table.

The tokens here are words `[^\\x20\\x09-\\x0D]+`; `length` names a column of docs with other counts, such as those of
tokencount. Defined results: null and empty texts, and null or negative lengths, have length 0; ties between bounds take the
fewest buckets and then the lowest bounds; repeated rows get slots of their own; a null doc_id comes back null; an empty table
gives no rows; other columns of docs are not read, whatever their names.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, with_slots, written

BUCKETS, BUDGET = 16, 16_384


def bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds with the least padding, exact. lengths are distinct and ascending.

    cost(i, j) = L[j-1] * (C[j] - C[i]) - (S[j] - S[i]) has lines of falling slope and rising queries, so that each layer
    takes linear time with a monotone hull."""
    n = len(lengths)
    if not n:
        return []
    c, s = [0], [0]
    for x, k in zip(lengths, counts, strict=True):
        c.append(c[-1] + k)
        s.append(s[-1] + x * k)
    before: list[float] = [0] + [float("inf")] * n
    choice, totals = [], []
    for _ in range(min(buckets, n)):
        now, back = [float("inf")] * (n + 1), [0] * (n + 1)
        hull: deque[tuple[int, int, int]] = deque()  # slope, intercept, index
        for j in range(1, n + 1):
            if before[j - 1] != float("inf"):
                line = (-c[j - 1], before[j - 1] + s[j - 1], j - 1)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            x = lengths[j - 1]
            while len(hull) >= 2 and hull[1][0] * x + hull[1][1] < hull[0][0] * x + hull[0][1]:
                hull.popleft()
            if hull:
                now[j], back[j] = hull[0][0] * x + hull[0][1] + x * c[j] - s[j], hull[0][2]
        choice.append(back)
        totals.append(now[n])
        before = now
    k, j, out = int(np.argmin(totals)), n, []
    while j:
        out.append(lengths[j - 1])
        j, k = choice[k][j], k - 1
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: str | None = None) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_words, bucket, bucket_len, batch, slot, padding); n_words is called `length` if given.

    batch numbers the batches of a bucket, slot the texts of a batch, both from 0."""
    name = length or "n_words"
    size = n_words(F.col("text")) if length is None else F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long")
    rows = written(docs.select("doc_id", size.alias(name)))
    histogram = sorted(map(tuple, rows.groupBy(name).agg(F.count(F.lit(1))).collect()))  # one row a distinct length
    tops = bounds([x for x, _ in histogram], [k for _, k in histogram], buckets) or [0]
    bucket = F.lit(0)
    for top in tops[:-1]:
        bucket = bucket + (F.col(name) > top).cast("int")
    slotted = with_slots(rows.withColumn("bucket", bucket), "bucket", "place")
    top = F.element_at(F.array(*[F.lit(x).cast("long") for x in tops]), F.col("bucket") + 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(top, F.lit(1).cast("long"))))
    return slotted.select("doc_id", name, "bucket", top.alias("bucket_len"),
                          F.floor(F.col("place") / room).alias("batch"), (F.col("place") % room).alias("slot"), (top - F.col(name)).alias("padding"))

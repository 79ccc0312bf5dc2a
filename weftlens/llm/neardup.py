"""Near-duplicate groups by BagMinHash on multisets of five-word shingles, similarity 0.8 or more.

1. Signature. Every text is a bag: shingle -> how often it occurs. Each of REGISTERS registers sees an independent unit-rate
   Poisson process over (weight axis of the shingle) x (time); the register keeps the earliest point under the bag's
   weight, so two bags agree in a register with probability equal to their weighted Jaccard similarity. The weight axis is
   discretised in dyadic intervals [0,1), [1,2), [2,4), ...: one process an interval serves all registers (rate times
   REGISTERS, a hash deals each point to a register), points of the interval that the weight only partly covers are
   thinned by their place in it, and a process stops once it is later than all registers of its text.
2. Bands. 28 bands of 6 registers: a pair at 0.8 shares one with probability 1 - 2e-4, a pair at 0.85 with 1 - 1e-6. Texts with the same words in the
   same order are one class and enter once.
3. Verification. A class is the more central the more classes share buckets with it. The most central class of a bucket is
   its pivot; each member is compared with it, on the exact multisets. A group of copies costs pairs in proportion to its
   size, not to its square.
4. The rest. Members of a bucket that are not all connected then are open. Two open classes can only be SIMILARITY alike if
   they share a shingle in their prefixes (the rarest shingles, with more than the rest that may differ), early enough for
   the shingles after it to suffice, and if parities of their bags differ in few bits. These are joined and verified too, so
   no link of a bucket is lost; the filters are exact.
5. Components of the verified links by alternating large-star and small-star steps, on tables.

Words are `\\w+` in lower case; a text with fewer than five words is a single shingle. Defined results: texts that are null
or have no word belong to no group (class_id is their doc_id, size 1); class_id is the least doc_id of the group and null
where no member has one; repeated rows share it; of equal ids the least text is kept; an empty table gives no rows; other
columns of docs are not read by near_duplicates and stay as they are in deduplicated, whatever their names.

A pair is missed with the probability that no band agrees: (1 - s^6)^28, thus 2e-4 at 0.8, 2e-6 at 0.85 and 1e-9 at 0.9.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, hub_join, packed, per_text, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 6
REGISTERS = BANDS * ROWS
#: Bits of a class's parity.
PARITY = 2048
#: Classes whose keys may be broadcast to fetch their texts: at most about 10 MB.
BROADCAST_KEYS = 100_000
CACHE = 300_000
#: Longest word whose hash a worker remembers: with CACHE words at most 30 MB of text.
LONG = 100
_words: dict[str, int] = {}
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _hashes(words: list[str]) -> np.ndarray:
    if len(_words) > CACHE:
        _words.clear()
    out, get = [], _words.get
    for w in words:
        h = get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= LONG:
                _words[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(words: list[str]) -> np.ndarray:
    """A hash for each shingle, in order."""
    h = _hashes(words)
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), dtype=np.uint64)
    for k in range(min(WORDS, len(h))):
        out = mix(out * _A + h[k:k + n])
    return out


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(WORD.findall(text.lower())), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """BagMinHash registers (docs x REGISTERS, 32-bit ids of the earliest points) of bags given as rows."""
    top = int(weight.max(initial=1))
    parts = [(doc, mix(shingle), weight, np.zeros(len(doc), np.float64), np.ones(len(doc)))]
    low = 1
    while low < top:
        m = weight > low
        parts.append((doc[m], mix(shingle[m] + (np.array([low], np.uint64) * _A)), weight[m], np.full(m.sum(), low, np.float64), np.full(m.sum(), low, np.float64)))
        low *= 2
    doc, seed, weight, low_, span = (np.concatenate(x) for x in zip(*parts, strict=True))
    registers = np.full((docs, REGISTERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat, time, step = registers.reshape(-1), np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        u = mix(seed + (np.array([step], np.uint64) * _A))
        time = time - np.log(uniform(u)) / (span * REGISTERS)
        v = mix(u ^ _C)
        at = doc * REGISTERS + (v % np.uint64(REGISTERS)).astype(np.int64)
        packed = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix(v) & np.uint64(0xFFFFFFFF))
        under = (span == 1) | (low_ + uniform(mix(v ^ _B)) * span < weight)
        np.minimum.at(flat, at[under], packed[under])
        latest = (registers.max(axis=1) >> np.uint64(32)).astype(np.uint32).view(np.float32)
        latest[np.isnan(latest)] = np.inf
        m = time <= latest[doc]
        doc, seed, weight, low_, span, time = doc[m], seed[m], weight[m], low_[m], span[m], time[m]
    return registers & np.uint64(0xFFFFFFFF)


def bands(registers: np.ndarray) -> np.ndarray:
    """docs x BANDS keys."""
    r = registers.reshape(len(registers), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), r.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * _A + r[:, :, k])
    return out.view(np.int64)


def sketch(texts: list[str]) -> tuple[list[bytes | None], np.ndarray, list[np.ndarray]]:
    """Class key (None: no word), number of shingles and band keys of each text."""
    keys, sizes, held = [], np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        ws = WORD.findall(t.lower())
        keys.append(xxhash.xxh3_128_digest(" ".join(ws)) if ws else None)
        if ws:
            s = shingles(ws)
            sizes[i] = len(s)
            held.append((np.uint64(i) << np.uint64(52)) | (s >> np.uint64(12)))
    out = np.zeros((len(texts), BANDS), np.int64)
    if held:
        rows, weight = np.unique(np.concatenate(held), return_counts=True)
        doc = (rows >> np.uint64(52)).astype(np.int64)
        out = bands(signatures(doc, rows & np.uint64((1 << 52) - 1), weight, len(texts)))
    return keys, sizes, list(out)


def sketched(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, tkey, wkey, n, bands); written."""
    def run(texts: list[str | None]):
        return None, sketch([t or "" for t in texts])

    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("tkey"), "text")
    return written(per_text(rows, ["doc_id", "tkey"], lambda: run, "wkey binary, n long, bands array<long>"))


def _union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) of a partition, some hundred thousand at once, to edges from each node to the least node it reaches there."""
    held: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := held.get(x, x)) != x:
            held[x] = held.get(y, y)
            x = y
        return x

    def forest() -> pd.DataFrame:
        rows = [(x, root(x)) for x in list(held)]
        held.clear()
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"])

    for pdf in batches:
        for u, v in zip(pdf["u"], pdf["v"], strict=True):
            u, v = root(u), root(v)
            held[max(u, v)] = held[min(u, v)] = min(u, v)
        if len(held) >= CACHE:
            yield forest()
    yield forest()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), a < b, to (node, comp): comp is the least node that can be reached.

    The edges of a partition are contracted first; then large-star and small-star steps until nothing changes."""
    now = written(edges.select(F.col("b").alias("u"), F.col("a").alias("v")).mapInPandas(_union, "u binary, v binary"))
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    mark = sign(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = hub_join(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = written(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        new = sign(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def texts_of(members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, text) of the classes that share a bucket; written, as each is compared more than once."""
    keys = members.select("key").distinct().withColumn("wkey", F.expr("substring(key, 9)"))
    need = written(keys.join(classes.select("wkey", "rep"), "wkey").select("key", F.col("rep.doc_id").alias("_id"), F.col("rep.tkey").alias("_t")))
    if need.count() <= BROADCAST_KEYS:
        need = F.broadcast(need)
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("tkey"), "text")
    found = rows.join(need, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_t")))
    return written(found.groupBy("key").agg(F.first("text").alias("text")))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) of classes whose bags are at least SIMILARITY alike."""
    both = (hub_join(pairs, texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict[bytes, tuple] = OrderedDict()

        def of(key: bytes, text: str) -> tuple:
            if key not in held:
                if len(held) >= 64:
                    held.popitem(last=False)
                held[key] = bag(text)
            held.move_to_end(key)
            return held[key]

        for pdf in batches:
            ok = [similarity(of(a, x), of(b, y)) >= SIMILARITY for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True)]
            yield pdf.loc[ok, ["a", "b"]]

    return both.mapInPandas(run, "a binary, b binary")


def parity(shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """PARITY bits as longs: a bag's shingles, each counted, dealt to bits that flip. Two bags differ in at least as many shingles
    as their parities do in bits."""
    kth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    at = mix(np.repeat(shingle, weight) + (kth.astype(np.uint64) * _A)) % np.uint64(PARITY)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def prefix_pairs(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """open_(key, n, comp) to pairs (a, b) of different components that may be SIMILARITY alike; an exact filter.

    Shingles are ordered by the number of open classes that hold them. r is what a class has from a shingle on: two classes
    whose first common shingle has r and r2 share at most the lesser of them, and must share s / (1 + s) of both sizes. So
    r is at least s * n, and for the smaller class 2s / (1 + s) * n. Shingles of one class only can't be common.

    In a hot group, such as edited copies of a long template, most classes have common prefixes and yet are not alike. There the
    join's own condition compares parities: more differing bits than (n + n2) * (1 - s) / (1 + s) shingles may differ rule a pair
    out before it is a row. Up to about 3000 words a text the parity tells pairs at 0.66 from those at 0.8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, n, text in zip(pdf["key"], pdf["n"], pdf["text"], strict=True):
                shingle, weight = bag(text)
                bits = [None] * len(shingle)
                bits[0] = parity(shingle, weight)
                yield pd.DataFrame({"key": key, "n": n, "shingle": shingle.view(np.int64), "c": weight, "bits": bits})

    s, slack, words = SIMILARITY, 1e-6, range(PARITY // 64)
    rows = written(open_.select("key", "n").join(texts, "key").mapInPandas(run, "key binary, n long, shingle long, c long, bits array<long>"))
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    order = Window.partitionBy("key").orderBy(F.desc("df"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    prefix = hub_join(rows.drop("bits"), common, "shingle").withColumn("r", F.sum("c").over(order)).filter(F.col("r") >= s * F.col("n") - slack)
    named = open_.select("key", "comp").join(rows.filter("bits is not null").select("key", *[F.get("bits", F.lit(i)).alias(f"p{i}") for i in words]), "key")
    prefix = written(prefix.select("key", "n", "shingle", "r").join(named, "key"))
    less = prefix.filter(F.col("r") >= 2 * s / (1 + s) * F.col("n") - slack)
    less = less.select(F.col("key").alias("k2"), F.col("n").alias("n2"), "shingle", F.col("r").alias("r2"), F.col("comp").alias("c2"), *[F.col(f"p{i}").alias(f"q{i}") for i in words])
    ahead = (F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("key") > F.col("k2")))
    enough = (F.col("n2") >= s * F.col("n") - slack) & (F.least("r", "r2") >= s / (1 + s) * (F.col("n") + F.col("n2")) - slack)
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in words])
    close = differ <= (1 - s) / (1 + s) * (F.col("n") + F.col("n2")) + slack
    both = prefix.join(less, (prefix["shingle"] == less["shingle"]) & (F.col("comp") != F.col("c2")) & ahead & enough & close)
    return both.select(F.least("key", "k2").alias("a"), F.greatest("key", "k2").alias("b")).distinct()


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(key, n, band) of classes that are not alone in a band's bucket; written. A key sorts the more central class first:
    eight bytes fall as the number of classes in its buckets grows, the class's own key follows."""
    members = classes.select("wkey", "n", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = written(members.join(shared, "band"))
    central = members.groupBy("wkey").agg((F.lit((1 << 62) - 1) - F.sum("m")).alias("d"))
    key = F.concat(F.unhex(F.lpad(F.hex("d"), 16, "0")), F.col("wkey")).alias("key")
    return written(members.join(central, "wkey").select(key, "n", "band"))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of sketched(docs), classes(wkey, comp, class_id, class_size, class_tkey))."""
    rows = sketched(docs)
    classes = written(rows.filter(F.col("wkey").isNotNull()).groupBy("wkey").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    members = shared_buckets(classes)
    texts = texts_of(members, classes, docs)
    pivots = members.groupBy("band").agg(F.min(F.struct("key", "n")).alias("p")).select("band", F.col("p.key").alias("a"), F.col("p.n").alias("pn"))
    alike = F.least("n", "pn") >= SIMILARITY * F.greatest("n", "pn")
    first = members.join(pivots, "band").filter((F.col("key") != F.col("a")) & alike).select("a", F.col("key").alias("b")).distinct()
    edges = written(verified(written(first), texts))
    comps = written(components(edges))
    named = members.join(comps, F.col("key") == F.col("node"), "left").select("band", "key", "n", F.coalesce("comp", "key").alias("comp"))
    mixed = named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band")
    open_ = written(named.join(mixed, "band", "left_semi").select("key", "n", "comp").distinct())
    if not open_.isEmpty():
        more = written(verified(written(prefix_pairs(open_, texts)), texts))
        if not more.isEmpty():
            comps = written(components(edges.unionByName(more)))
    comps = comps.select(F.expr("substring(node, 9)").alias("node"), "comp")
    named = classes.select("wkey", "rep", "rows").join(comps, F.col("wkey") == F.col("node"), "left").select("wkey", "rep", "rows", F.coalesce("comp", "wkey").alias("comp"))
    named = written(named)
    heads = named.groupBy("comp").agg(F.min("rep").alias("head"), F.sum("rows").alias("class_size"))
    out = hub_join(named, heads, "comp").select("wkey", F.col("head.doc_id").alias("class_id"), F.col("head.tkey").alias("class_tkey"), "class_size")
    return rows, out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, class_id, class_size, kept): a row a document; kept marks the least id of a group."""
    docs = docs.select("doc_id", "text")
    rows, classes = grouped(docs)
    lone = F.col("wkey").isNull()
    out = rows.select("doc_id", "tkey", "wkey").join(classes.withColumnRenamed("wkey", "_w"), F.col("wkey") == F.col("_w"), "left")
    return out.select(
        "doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(lone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (lone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tkey") == F.col("class_tkey")))).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, and all rows without words. What has a word is decided once, in sketch()."""
    rows, classes = grouped(docs.select("doc_id", "text"))
    heads = classes.select(F.col("class_id").alias("_id"), F.col("class_tkey").alias("_t"), F.lit(False).alias("_lone")).distinct()
    lone = rows.filter(F.col("wkey").isNull()).select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_t"), F.lit(True).alias("_lone")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("tkey").eqNullSafe(F.col("_t"))
    kept = packed(docs, F.col("doc_id"), F.unhex(F.md5("text")).alias("tkey")).join(heads.unionByName(lone), same)
    again = rows.filter(F.col("wkey").isNotNull()).select("doc_id", "tkey").join(heads, same, "left_semi")
    if not again.groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").isEmpty():
        kept = kept.filter("_lone").unionByName(kept.filter("not _lone").dropDuplicates(["doc_id", "tkey"]))
    return kept.select("_doc.*")

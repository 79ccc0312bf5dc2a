"""Quality rules with adaptive thresholds, by DataFrame operations only.

Per text: words `[^\\x20\\x09-\\x0D]+`, symbols, repeated lines and repeated three-word windows. Texts that fail the base
rules (n_words < 50, or more than half of the words in repeated windows) are not kept. For the others four rates are held
against thresholds of their language and source:

  symbols per 1000 words, repeated lines per 1000 lines, repeated words per 1000 words, and 100 x mean word length.

The first three have one added to both counts, (n + 1) / (all + 1): a short text without a symbol isn't cleaner than a long
one can be, so the rate has a spread in groups where most texts have none, and the thresholds follow it.

The thresholds come from quantile sketches: log-linear histograms (exact below 128, else seven significant bits, thus
within 1.6 %), which are merged by adding counts. Upper threshold: q75 + REACH * (q75 - q25); the word length has a lower one
too. No constant is added, and up to a quarter of a group may be bad without moving them. A group with fewer than MIN_ROWS
texts uses the merged sketches of its language, and a language with fewer those of the whole table.

Defined results: null text has no words and fails; null languages and sources are groups of their own; repeated rows are
judged alike; a rate equal to a threshold is kept; an empty table gives no rows; other columns of docs are not read by assess
and stay as they are in passing, whatever their names. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed, written

MIN_WORDS, MIN_ROWS, REACH = 50, 50, 10
RATES = ("symbols", "lines", "repeats", "length")
#: Groups of language and source whose thresholds may be broadcast.
BROADCAST_GROUPS = 50_000
BLANK = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _lines of its column text."""
    kept = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANK))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        *kept, F.split(trimmed, r"[\x20\x09-\x0D]+").alias("_w"), lines.alias("_l"), (trimmed == "").alias("_none"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    windows = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2))))
    second = first.select(
        *kept, "word_chars", "n_symbols", F.when(F.col("_none"), F.lit(0)).otherwise(F.size("_w")).cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), windows.alias("_h"))
    twice = F.size("_h") > F.size(F.array_distinct("_h"))
    third = second.select(*kept, *COUNTS[:4], "_lines", F.when(twice, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    again = F.filter("_s", lambda x, j: ((j > 0) & same(x, F.get("_s", F.greatest(j - 1, F.lit(0))))) | same(x, F.get("_s", j + 1)))
    places = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    # a row of one element: filters on the counts stay above it, so that no count is worked out again for each use
    one = F.array(F.struct(*COUNTS[:4], F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_repeat_words"), "_lines"))
    return third.select(*kept, F.explode(one).alias("_m")).select(*kept, "_m.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Integers, so that every engine has the same."""
    share = lambda a, b: F.expr(f"(({a} + 1) * 1000) div ({b} + 1)")
    return {"symbols": share("n_symbols", "n_words"), "lines": share("n_dup_lines", "_lines"), "repeats": share("n_repeat_words", "n_words"),
            "length": F.expr("(word_chars * 100) div greatest(n_words, 1)")}


def bin_of(v: Column) -> Column:
    """The lower edge of the sketch's bin."""
    shift = F.length(F.bin(v)) - 7
    return F.when(v < 128, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift))


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n): the quantile sketch of every group and rate."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), bin_of(v).alias("bin")) for k, v in rates().items()])).alias("x")
    return measures.filter(~base_failed()).select("lang", "source", each).groupBy("lang", "source", "x.rate", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Thresholds of each group: keys, `tag`_n and `tag`_hi_rate, `tag`_lo_rate."""
    group = Window.partitionBy(*keys, "rate")
    seen = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(group))
    q = seen.groupBy(*keys, "rate").agg(
        F.max("all").alias("all"), *[F.min(F.when(100 * F.col("upto") >= p * F.col("all"), F.col("bin"))).alias(f"q{p}") for p in (25, 75)])
    spread = REACH * (F.col("q75") - F.col("q25"))
    pick = lambda rate, v: F.max(F.when(F.col("rate") == rate, v))
    return q.groupBy(*keys).agg(
        F.max("all").alias(f"{tag}_n"), *[pick(k, F.col("q75") + spread).alias(f"{tag}_hi_{k}") for k in RATES],
        pick("length", F.col("q25") - spread).alias(f"{tag}_lo_length"))


def thresholds(measures: DataFrame) -> DataFrame:
    """(lang, source, hi_symbols, hi_lines, hi_repeats, hi_length, lo_length) of every group that has a text to judge."""
    fine = written(sketches(measures))
    every = limits(merged(fine.withColumn("one", F.lit(1)), "one"), ["one"], "c").first()  # one row
    own = limits(fine, ["lang", "source"], "a")
    lang = limits(merged(fine, "lang"), ["lang"], "b").withColumnRenamed("lang", "_lang")
    out = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    names = [*(f"hi_{k}" for k in RATES), "lo_length"]
    pick = lambda n: F.when(F.col("a_n") >= MIN_ROWS, F.col(f"a_{n}")).when(F.col("b_n") >= MIN_ROWS, F.col(f"b_{n}")).otherwise(F.lit(every[f"c_{n}"] if every else None).cast("long"))
    return written(out.select("lang", "source", *[pick(n).alias(n) for n in names]))


def judged(measures: DataFrame) -> DataFrame:
    """measures with base_failed and kept."""
    t = thresholds(measures)
    t = t.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    if t.count() <= BROADCAST_GROUPS:
        t = F.broadcast(t)
    out = measures.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    ok = F.lit(True)
    for k, v in rates().items():
        ok = ok & (v <= F.col(f"hi_{k}"))
    ok = ok & (rates()["length"] >= F.col("lo_length"))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(False)))


def assess(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source) to (doc_id, the five counts, base_failed, kept)."""
    measures = written(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judged(measures).select("doc_id", *COUNTS, "base_failed", "kept")


def passing(docs: DataFrame) -> DataFrame:
    """docs without the rows that are not kept. The texts are measured twice instead of being shuffled or written."""
    t = thresholds(written(measured(docs.select("doc_id", "text", "lang", "source")).drop("text")))
    t = t.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    if t.count() <= BROADCAST_GROUPS:
        t = F.broadcast(t)
    inner = measured(packed(docs, *map(F.col, ("text", "lang", "source"))))
    out = inner.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    ok = ~base_failed() & (rates()["length"] >= F.col("lo_length"))
    for k, v in rates().items():
        ok = ok & (v <= F.col(f"hi_{k}"))
    return out.filter(ok).select("_doc.*")


def oracle_sql() -> str:
    """DuckDB SQL for assess() of the table documents."""
    rates = {"symbols": "(n_symbols + 1) * 1000 // (n_words + 1)", "lines": "(n_dup_lines + 1) * 1000 // (n_lines + 1)",
             "repeats": "(n_repeat_words + 1) * 1000 // (n_words + 1)", "length": "word_chars * 100 // greatest(n_words, 1)"}
    each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, r_{k} AS v FROM judged WHERE NOT base_failed" for k in rates)

    def limits(name: str, keys: str) -> str:
        picks = ", ".join(f"max(CASE WHEN rate = '{k}' THEN q75 + {REACH} * (q75 - q25) END) AS hi_{k}" for k in RATES)
        return f"""{name} AS (SELECT {keys}max(n) AS n, {picks}, max(CASE WHEN rate = 'length' THEN q25 - {REACH} * (q75 - q25) END) AS lo_length FROM (
  SELECT {keys}rate, max(total) AS n, min(CASE WHEN 100 * upto >= 25 * total THEN b END) AS q25, min(CASE WHEN 100 * upto >= 75 * total THEN b END) AS q75 FROM (
    SELECT {keys}rate, b, sum(k) OVER (PARTITION BY {keys}rate ORDER BY b) AS upto, sum(k) OVER (PARTITION BY {keys}rate) AS total
    FROM (SELECT {keys}rate, b, count(*) AS k FROM bins GROUP BY {keys}rate, b)) GROUP BY {keys}rate) GROUP BY {keys or "()"})""".replace(", )", ")")

    names = [*(f"hi_{k}" for k in RATES), "lo_length"]
    pick = ", ".join(f"CASE WHEN a.n >= {MIN_ROWS} THEN a.{n} WHEN b.n >= {MIN_ROWS} THEN b.{n} ELSE c.{n} END AS {n}" for n in names)
    within = " AND ".join(f"r_{k} <= hi_{k}" for k in rates)
    fine, lang, all_ = (limits(*x) for x in (("fine", "lang, source, "), ("by_lang", "lang, "), ("every", "")))
    return rf"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM docs),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)),
twice AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM grams) WHERE k > 1),
again AS (SELECT rid, count(DISTINCT p) AS n FROM twice GROUP BY rid),
counts AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words FROM split LEFT JOIN again USING (rid)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{v} AS r_{k}" for k, v in rates.items())} FROM counts),
bins AS (SELECT lang, source, rate, CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) END AS b FROM ({each})),
{fine}, {lang}, {all_},
limits AS (SELECT a.lang, a.source, {pick} FROM fine a JOIN by_lang b ON a.lang IS NOT DISTINCT FROM b.lang CROSS JOIN every c)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND coalesce({within} AND r_length >= lo_length, false) AS kept
FROM judged j LEFT JOIN limits t ON j.lang IS NOT DISTINCT FROM t.lang AND j.source IS NOT DISTINCT FROM t.source"""

"""Quality rules against the SQL form and plain Python."""

import random
import re

import duckdb
import pandas as pd
import pytest

from weftlens.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["stone", "river", "#tag", "a", "élan", "und", "<b>", "wort"]
    out = []
    for i in range(700):
        n = rng.choice([0, 3, 49, 50, 80, 120, 300])
        text = "".join(rng.choice(words) + str(rng.randrange(400)) + rng.choice([" ", " ", "\n", "\t", "\r\n", "  "]) for _ in range(n))
        if rng.random() < 0.2:
            text = (text[: len(text) // 3] + "\n") * 3
        if rng.random() < 0.05:
            text = text.replace(" ", " $$ ## ")
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "cold", None])))
    return out + [(None, None, None, None), (7, "", "en", "hot"), (8, " \n\t", None, "lone"), (9, "a b a b a b " * 5000, "en", "hot"), (9, "a b a b a b " * 5000, "en", "hot"), (10, "x\x00y   z  w " * 30, "xx", "yy")]


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = {}
    for g in grams:
        n[g] = n.get(g, 0) + 1
    places = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def test_counts_are_those_of_plain_python(spark, rows):
    got = Q.measured(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in Q.COUNTS) == plain(r.text)


def test_verdicts_are_those_of_the_sql(spark, rows):
    got = Q.assess(spark.createDataFrame(rows, SCHEMA)).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    want = con.execute(Q.oracle_sql()).df()
    key = list(got.columns)
    show = lambda d: sorted(map(str, d[key].astype(object).where(d[key].notna(), None).itertuples(index=False, name=None)))
    norm = lambda d: show(d.assign(doc_id=d["doc_id"].map(lambda x: None if pd.isna(x) else int(x))))
    assert norm(got) == norm(want)
    assert 0 < got["kept"].sum() < (~got["base_failed"]).sum()


def test_passing_keeps_the_rows_that_are_kept(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", n_words int, _lines string")
    kept = Q.assess(docs).filter("kept").count()
    out = Q.passing(docs)
    assert out.columns == docs.columns and out.count() == kept and out.filter("n_words <> 1").count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.assess(empty).collect() == [] and Q.passing(empty).collect() == []


def test_thresholds_follow_their_group_and_tell_bad_from_good(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    limits = Q.thresholds(Q.measured(docs.select("doc_id", "text", "lang", "source")).drop("text")).toPandas()
    assert sum(limits[f"hi_{k}"].nunique() > 5 for k in Q.RATES) == 4
    got = Q.assess(docs).filter("not base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (~got["kept"])[got["quality"] == 0].mean() > 0.98 and (~got["kept"])[got["quality"] == 1].mean() < 0.03


def test_plan_is_native(spark, rows):
    plan = Q.assess(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sketch_bins_are_near_their_values(spark):
    got = spark.range(0, 200000, 37).select("id", Q.bin_of(Q.F.col("id")).alias("b")).toPandas()
    assert ((got["b"] <= got["id"]) & (got["id"] - got["b"] <= got["id"] / 64)).all()
    assert (got["b"] == got["id"])[got["id"] < 128].all()

"""Steps whose cost must grow with the input: results against brute force, and plans without the shuffles that made them fail."""

import pytest
from pyspark.sql import functions as F

from weftlens.operators import frequency as Q
from weftlens.operators import matching as M


def above_join(df) -> str:
    """The executed plan above its first join."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    return plan[:plan.index("Join")]


SETS = {"a": "x", "b": "xy", "c": "y", "d": "xyz", "e": "z", "f": "q", "g": "xy", "h": "w"}


def test_shared_sums_take_each_form_once(spark):
    n = {f: i + 1 for i, f in enumerate(SETS)}
    each = spark.createDataFrame([(f, x) for f, s in SETS.items() for x in s] * 2, "form string, feature string")
    got = {r.form: r.n for r in Q.shared_sums(each, spark.createDataFrame(list(n.items()), "form string, n long")).collect()}
    assert got == {f: sum(n[g] for g in SETS if set(s) & set(SETS[g])) for f, s in SETS.items()}


def test_cofeature_counts_join_classes_not_forms(spark):
    """Before: 6000 forms of one lemma were 36 million pairs, shuffled twice. Now no join has more rows than there are forms."""
    t = spark.range(6000).select(F.concat(F.lit("w"), "id").alias("form"), F.array(F.lit("lemma")).alias("features"))
    got = Q.inverse_cofeature_frequencies(t)
    assert got.agg(F.count(F.lit(1)), F.min("inv"), F.max("inv")).first()[:] == (6000, 1.0, 1.0)
    assert "_set" in got._jdf.queryExecution().analyzed().toString()


def test_closure_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 2)
    bridge = spark.createDataFrame([(f, x) for f, s in SETS.items() for x in s] * 2, "feature string, other string")
    got = M.bridge_closure(bridge)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted((f, g) for f, s in SETS.items() for g, u in SETS.items() if set(s) & set(u))
    assert "Exchange" not in above_join(got) and "Aggregate" not in above_join(got)


def test_bridge_frequencies_keep_forms_without_a_translation(spark):
    n = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4), ("lone", 8), (None, 5)], "form string, n long")
    bridge = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("unknown", "y")], "feature string, other string")
    got = {r.form: r.inv for r in M.bridge_inverse_frequencies(n, 30, bridge).collect()}
    assert got == pytest.approx({"a": 10.0, "b": 30 / 7, "c": 5.0, "lone": 3.75})


def test_bigrams_make_each_pair_once(spark):
    """Against all positions; before, every pair of positions went into an aggregate by pair."""
    from math import log
    from random import Random

    from weftlens.operators import multitext as U

    draw = Random(3)
    rows = [("t", u, p, inv, w) for u in range(20) for p in range(12) for w, inv in draw.sample([("a", 1.0), ("b", 2.5), ("c", 4.0), ("d", 7.0), ("e", None)], draw.choice((1, 1, 2)))]
    want = {}
    for _, u, p, i, f in rows:
        for _, v, q, j, g in rows:
            if u == v and p < q:
                k, at = (u, min(f, g), max(f, g)), (p, q)
                if k not in want or at < want[k][0]:
                    want[k] = at, log(((i or 0) + (j or 0)) / (q - p)) if i or j else None
    got = U.bigrams(spark.createDataFrame(rows, "text_id string, unit int, pos int, inv double, feature string"))
    found = {(r.unit, r.w1, r.w2): r.score for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[k] == (None if want[k][1] is None else pytest.approx(want[k][1])) for k in want)
    assert "Exchange" not in above_join(got) and "Aggregate" not in above_join(got)


def test_trigrams_of_the_vocabulary(spark):
    from weftlens.operators import features as E

    t = spark.createDataFrame([("banana",), ("banana",), ("ban",), ("an",)], "form string")
    n = t.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    got = {r.feature: r.n for r in Q.counts_by_form(n, E.sound_features).collect()}
    assert got == {"ban": 3, "ana": 4, "nan": 2}


def test_plain_units_are_nested_without_a_shuffle(spark):
    from weftlens.operators import units as N

    got = N.plain_nested_units(N.plain_units(spark.createDataFrame([(7, "One two\n12\n\nthree one"), (8, None)], "id long, text string"), "id", "text"), "id")
    assert [(r.id, r.unit, r.forms, [(t.pos, t.form) for t in r.tokens]) for r in got.collect()] == [(7, 0, ["one", "two"], [(0, "one"), (1, "two")]), (7, 3, ["three", "one"], [(0, "three"), (1, "one")])]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_matches_are_dealt_out_by_their_hits(spark, monkeypatch):
    """Before, the parts did not follow the hits, and tasks spilled."""
    monkeypatch.setattr(M, "HITS", 50)
    schema = "unit string, pos int, form string, feature string, inv double"
    t = spark.createDataFrame([(f"t{u}", p, w, w, 2.0) for u in range(100) for p, w in enumerate("ab")], schema)
    s = spark.createDataFrame([(f"s{u}", p, w, w, 2.0) for u in range(5) for p, w in enumerate("ab")], schema)
    assert M.dealt(t.withColumnRenamed("unit", "t_unit"), s).rdd.getNumPartitions() == 20
    assert M.match(t, s, max_distance=None).count() == 500


def test_large_frequency_tables_are_cut_to_the_forms(spark, monkeypatch):
    monkeypatch.setattr(M, "fits", lambda df, rows=0: False)
    t = spark.createDataFrame([("t", 0, "a", "x"), ("t", 1, "lone", "x")], "unit string, pos int, form string, feature string")
    got = M.with_rarity(t, spark.createDataFrame([("a", 2.0), ("b", 3.0)], "form string, inv double"))
    assert sorted((r.form, r.inv) for r in got.collect()) == [("a", 2.0), ("lone", None)]
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_ranks_read_their_matches_once(spark):
    from weftlens.operators import results as R

    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    m = spark.range(50).select("id", F.udf(count, "double")(F.col("id").cast("double")).alias("score"))
    got = R.ranked(m, ("id",)).collect()
    assert sorted((r.result, r.id) for r in got) == [(i + 1, 49 - i) for i in range(50)] and max(r.normal_score for r in got) == 10
    assert seen.value == 50


def test_registered_numbers_order_as_the_structs(spark):
    rows = [("l", "form", w, i, at) for w, i, at in [("a", 12, 7), ("a", 3, 100000), ("b", 3, 99999), ("c", 3, 200001), ("d", 100, 0), ("e", -4, 5)]]
    df = spark.createDataFrame(rows, "language string, feature string, token string, text_id long, at long")
    got = Q.registered(df)
    assert {r.token: r["index"] for r in got.collect()} == {"e": 0, "b": 1, "a": 2, "c": 3, "d": 4}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def _sound_rows(df):
    return sorted((r.t_unit, r.s_unit, tuple(r.features), r.distance, round(r.score, 9), tuple(map(tuple, r.highlight))) for r in df.collect())


def test_sound_matches_of_rows_are_those_of_the_joins(spark, monkeypatch):
    """Also with names that have several rows, other alphabets, small parts, and a source beyond the bound."""
    from random import Random

    import pyarrow as pa

    from weftlens.operators import sound as S

    draw = Random(3)
    word = lambda: "".join(draw.choice("abcé語") for _ in range(draw.randint(1, 6)))
    unit = lambda rows: [" ".join(word() for _ in range(draw.randint(0, 12))) for _ in range(rows)]
    t, s = ([(f"{p}{i}", unit(draw.choice((1, 1, most)))) for i in range(n)] for p, n, most in (("t", 60, 3), ("s", 12, 1)))
    td, sd = (spark.createDataFrame(x, "unit string, forms array<string>") for x in (t, s))
    tn, sn = S.counts(td), S.counts(sd)
    assert {tuple(r) for r in tn.collect()} == {tuple(r) for r in S.positions(td).groupBy("feature").count().collect()}
    ask = (Q.stoplist(tn, 8), Q.of_counts(tn, "feature"), Q.of_counts(sn, "feature"))
    got = S.match(td, sd, *ask, max_distance=None)
    want = M.match_sound(S.positions(td), S.positions(sd), *ask, max_distance=None)
    rows = _sound_rows(got)
    assert len(rows) > 50 and rows == _sound_rows(want) and got.dtypes == want.dtypes
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()

    forms = pa.array([f for _, f in t], pa.list_(pa.string()))
    features = sorted(r.feature for r in sn.collect())
    source = lambda: S.Source([u for u, _ in s], pa.array([f for _, f in s], pa.list_(pa.string())), features, [False] * len(features), [1.0] * len(features), [1.0] * len(features))
    seen = lambda: sorted((int(u), int(v), int(d), round(float(x), 9)) for a in source().match(forms, None, None) for u, v, d, x in zip(a[0], a[1], a[4], a[5], strict=True))
    whole = seen()
    for name, small in (("PART_CELLS", 30), ("CELLS", 8), ("DENSE", 0)):
        monkeypatch.setattr(S, name, small)
    assert len(whole) > 50 and seen() == whole
    monkeypatch.setattr(S, "BROADCAST_ROWS", 10)
    assert _sound_rows(S.match(td, sd, *ask, max_distance=None)) == rows


def test_match_sound_shuffles_no_unit(spark, tmp_path):
    """Before, the trigrams of all candidates were shuffled; and units of repeated or null ids were not those of the SQL."""
    import duckdb

    from weftlens.plans import catalogue

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    con.execute(f"""CREATE TABLE documents AS SELECT * FROM '{sf}/documents.parquet' UNION ALL SELECT * FROM '{sf}/documents.parquet' WHERE doc_id % 2 = 0
      UNION ALL SELECT NULL, text, lang, source, n_chars FROM '{sf}/documents.parquet' WHERE doc_id % 3 = 0""")
    for t in ("benchmark", "documents"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = catalogue.queries()["match_sound"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    want = con.execute(catalogue.oracle_sql()["match_sound"]).fetchall()
    near = lambda rows: sorted((*r[:4], round(r[4], 5)) for r in rows)
    assert len(want) > 20 and near(want) == near(tuple(r) for r in got.collect())

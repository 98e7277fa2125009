"""Null rules, per-key picks, samples and skewed keys."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortry.functions import expr as E
from cohortry.operators import relational as R
from cohortry.sources import tables as S


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_drop_where_keeps_null(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    assert {r["x"] for r in R.drop_where(df, F.col("x") > 3).collect()} == {1, None}


@pytest.mark.parametrize("limit", [0, 1_000])
def test_in_and_not_in_lists(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "IN_LIST_LIMIT", limit)
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x long")
    assert rows(R.filter_in(df, "x", [1, 3, 3]), "x") == [(1,), (3,)]
    assert rows(R.filter_not_in(df, "x", [1, 3]), "x") == [(2,)]


def test_not_in_with_null_and_with_nothing(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    ids = spark.createDataFrame([(1,), (None,)], "y long")
    assert R.exclude_ids(df, ids, "x").count() == 0
    assert rows(R.exclude_ids(df, ids.dropna(), "x"), "x") == [(2,)]
    assert R.exclude_ids(df, ids.where("false"), "x").count() == 3
    assert R.exclude_ids(df, ids, "x", null_aware=False).count() == 2


def test_lookup_misses_and_repeats(spark):
    df = spark.createDataFrame([(1, 7), (2, None), (3, 9)], "id int, code int")
    dim = spark.createDataFrame([(7, "seven"), (8, "eight")], "c int, name string")
    got = {r["id"]: r["label"] for r in R.lookup(df, {"code": "label"}, dim, "c", "name").collect()}
    assert got == {1: "seven", 2: None, 3: None}
    twice = dim.union(spark.createDataFrame([(7, "again")], dim.schema))
    with pytest.raises(PySparkException):
        R.lookup(df, {"code": "label"}, twice, "c", "name").collect()


def test_checked_falls_back_to_no_hint(spark, monkeypatch):
    monkeypatch.setattr(R, "LITERAL_ROWS", 10)
    big = spark.range(1_000).withColumn("v", F.lit(1))
    kept, fits = R.checked(big, max_rows=100)
    assert not fits and kept.count() == 1_000
    kept, fits = R.checked(big, max_rows=5_000)
    assert fits and kept.count() == 1_000
    joined = spark.range(10).join(R.sized_broadcast(big, 100), "id")
    assert joined.count() == 10


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_splits_hot_keys_and_keeps_rows(spark, how):
    fact = spark.range(9_000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1_000 == 1, None).otherwise(F.col("id") % 500 + 100).alias("k")
    )
    dim = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert R.hot_keys(fact, "k", min_rows=100) == [7] and R.hot_keys(fact, "k") == []
    split = R.skew_join(fact, dim, "k", "id", how, min_rows=100)
    plain = fact.join(dim, "k", how)
    assert split.columns == plain.columns
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, None, "a"), (2, 5, "b")], "k int, s int, x string")
    b = spark.createDataFrame([(1, None, "c"), (2, 6, "d")], "k int, s int, y string")
    assert rows(R.join_null_safe(a, b, ["k", "s"]), "k", "x", "y") == [(1, "a", "c")]


def test_first_last_and_flags(spark):
    t = datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, 1, t), (1, 2, None), (1, 3, t), (2, 4, None)], "p int, v int, at timestamp_ntz")
    assert rows(R.last_per_key(df, ["p"], ["at", "v"]), "p", "v") == [(1, 2), (2, 4)]
    assert rows(R.last_per_key(df, ["p"], ["at", "v"], nulls_last=False), "p", "v") == [(1, 3), (2, 4)]
    assert rows(R.first_per_key(df, ["p"], ["at", "v"]), "p", "v") == [(1, 2), (2, 4)]
    assert rows(R.first_per_key(df, ["p"], ["at", "v"], nulls_first=False), "p", "v") == [(1, 1), (2, 4)]
    marked = R.flag_first(df, ["p"], ["at"], "v")
    assert rows(marked.where("first"), "v") == [(1,), (4,)]
    # Idempotent.
    last = R.last_per_key(df, ["p"], ["at", "v"])
    assert rows(R.last_per_key(last, ["p"], ["at", "v"]), "v") == rows(last, "v")


def test_picks_are_aggregates_not_windows(spark):
    df = spark.range(100).withColumn("k", F.lit(1))
    plan = R.last_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


def test_sample_is_bounded_seeded_and_whole_for_small_groups(spark):
    df = spark.range(5_000).withColumn("g", F.when(F.col("id") < 4_900, "hot").otherwise("cold"))
    got = R.bounded_sample(df, 150, "id", ["g"])
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"hot": 150, "cold": 100}
    again = R.bounded_sample(df.repartition(7), 150, "id", ["g"])
    assert rows(got, "id") == rows(again, "id")
    assert R.bounded_sample(df, 40, "id").count() == 40
    assert rows(R.bounded_sample(df, 40, "id", seed=1), "id") != rows(R.bounded_sample(df, 40, "id"), "id")


def test_count_distinct_with_one_hot_group(spark):
    df = spark.range(3_000).select(F.when(F.col("id") < 2_900, "a").otherwise("b").alias("g"), (F.col("id") % 700).alias("v"))
    assert rows(R.count_distinct_by(df, ["g"], "v"), "g", "n") == [("a", 700), ("b", 100)]


def test_margins_add_up(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 4)], "r string, s string, n int")
    found = R.margins(df, [["r"], ["s"], []], ["n"])
    assert {r["margin"] for r in found.collect()} == {"r", "s", "all"}
    assert {r["n"] for r in found.groupBy("margin").agg(F.sum("n").alias("n")).collect()} == {7}


def test_best_takes_first_on_ties(spark):
    df = spark.createDataFrame([(2, 0.5), (3, 0.5), (4, None)], "k int, s double")
    assert R.best(df, "s", ["k"]).first()["k"] == 2


def test_flags_absent_forms(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "k int, c string")
    wanted = {"fa": "a", "fb": "b"}
    assert rows(R.pivot_flags(df, ["k"], "c", wanted, absent=0), "k", "fa", "fb") == [(1, 1, 1), (2, 0, 0)]
    assert R.pivot_flags(df, ["k"], "c", wanted).where("k = 2").first()["fa"] is None


def test_grid_and_max_cell(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "b")], "x int, y string")
    assert rows(R.count_grid(df, "x", "y"), "x", "y", "n") == [(1, "a", 2), (1, "b", 0), (2, "a", 0), (2, "b", 1)]
    assert R.max_cell(df, [], ["x", "y"]).first()[0] == 2


def test_union_all_of_nothing(spark):
    schema = spark.range(1).schema
    assert R.union_all([], spark, schema).count() == 0


def test_expressions(spark):
    df = spark.createDataFrame(
        [(datetime(2000, 2, 29), datetime(2020, 2, 28, 23), datetime(2020, 2, 27))], "b timestamp_ntz, s timestamp_ntz, e timestamp_ntz"
    )
    row = df.select(
        E.age_completed("s", "b").alias("full"),
        E.age_year_diff("s", F.year("b")).alias("year"),
        E.los_days_trunc("s", "e").alias("days"),
        E.day_diff("e", "s").alias("midnights"),
        E.los_hours("s", "e").alias("hours"),
    ).first()
    assert tuple(row) == (19, 20, -1, -1, -47.0)


def test_recodes(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    out = df.select(
        E.recode("x", {"a": "A"}).alias("strict"),
        E.recode("x", {"a": "A"}, F.col("x")).alias("keep"),
        E.lump_other("x", ["a"]).alias("lump"),
        E.lump_other("x", ["a"], null_as_other=True).alias("lump_all"),
        E.age_band(F.lit(None).cast("int")).alias("band"),
        E.level_of("x", ["b", "a"]).alias("level"),
    )
    assert [tuple(r) for r in out.collect()] == [
        ("A", "A", "a", "a", "<65", 2),
        (None, "z", "Other", "Other", "<65", None),
        (None, None, None, "Other", "<65", None),
    ]


def test_mixed_dates(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05",), ("02/01/2020",), ("no",)], "t string")
    got = [r[0] for r in df.select(E.parse_mixed_ts("t", ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy"]).cast("string")).collect()]
    assert got == ["2020-01-02 03:04:05", "2020-01-02 00:00:00", None]


def test_materialize_keeps_types_and_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, datetime(2020, 1, 1))], "a int, t timestamp_ntz")

    path = str(tmp_path / "kept")
    first = S.materialize(spark, build, path)
    assert S.materialize(spark, build, path).schema == first.schema and len(calls) == 1


def test_sql_file_and_named_frames(spark, tmp_path):
    path = tmp_path / "q.sql"
    path.write_text("SELECT id FROM range(5) WHERE id > :low;\n")
    assert S.run_sql_file(spark, str(path), {"low": 2}).count() == 2
    assert S.sql_over(spark, "SELECT SUM(id) AS s FROM {x}", x=spark.range(4)).first()["s"] == 6


def test_seed_lists_and_concept_sets(spark):
    assert S.seed_relation(spark, {"s": [1, 2, 1]}).count() == 2
    mapping = spark.createDataFrame([(1, "ECMO"), (2, "dialysis"), (3, None), (4, "other")], "concept_id long, mapping string")
    assert rows(S.concept_sets(mapping, "mapping", wanted={"ecmo": "ECMO"}), "label", "concept_id") == [("ecmo", 1)]
    assert S.concept_sets(mapping, "mapping").count() == 3


@pytest.mark.parametrize("size", [2, 1_102])
def test_not_in_with_a_null_leaves_nothing(spark, size):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int")
    values = [1, *range(100, 98 + size)]
    assert sorted(r["x"] for r in R.filter_not_in(df, "x", values).collect()) == [2, 3]
    assert R.filter_not_in(df, "x", [*values, None]).count() == 0


def test_rates_of_fractions(spark):
    df = spark.createDataFrame([("a", 0.25, True), ("a", 0.75, False)], "g string, share double, flag boolean")
    assert R.rate_by(df, ["g"], ["share", "flag"]).first()[1:] == (0.5, 0.5)


def test_long_axes_without_keys(spark, monkeypatch):
    cells = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, "c", 4)], "x int, y string, n long")
    want = {(r["x"], r["y"]): r["n"] for r in R.complete_grid(cells, "x", "y").collect()}
    monkeypatch.setattr(R, "AXIS_VALUES", 1)
    grid = R.complete_grid(cells, "x", "y")
    assert {(r["x"], r["y"]): r["n"] for r in grid.collect()} == want and len(want) == 9
    assert "NestedLoop" not in grid._jdf.queryExecution().toString()


def test_codes_of_many_levels(spark):
    from cohortry.operators.features import label_encode, one_hot_long

    df = spark.range(3_000).selectExpr("id", "if(id % 7 = 0, null, concat('v', lpad(id % 2500, 5, '0'))) AS c")
    rows = label_encode(df, ["c"]).collect()
    order = {v: i for i, v in enumerate(sorted({r["c"] for r in rows if r["c"] is not None}))}
    assert len(order) > 1_000 and all(r["c_encoded"] == (None if r["c"] is None else order[r["c"]]) for r in rows)
    assert one_hot_long(df, "id", ["c"]).count() == sum(r["c"] is not None for r in rows)

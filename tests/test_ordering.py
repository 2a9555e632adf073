import random

import pytest
from pyspark.sql import functions as F

from examples import profile, profiles
from vitalgrid.codebook import TARGET
from vitalgrid.operators import numbering, ordering, split
from vitalgrid.plans.derived import survey


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_numbering_closes_gaps_over_ranges(spark, buckets):
    rng = random.Random(1)
    # two dense blocks far apart and negative ids: nothing evenly spread
    ids = rng.sample(range(-500, 500), 700) + rng.sample(range(10**12, 10**12 + 900), 800)
    df = spark.createDataFrame([(i,) for i in ids], "rid bigint")
    got = {r["rid"]: r["patient_number"] for r in numbering.number_respondents(df, buckets=buckets).collect()}
    assert got == {rid: n for n, rid in enumerate(sorted(ids), 1)}


def test_numbering_works_its_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ids = spark.range(1000).withColumnRenamed("id", "rid")
    rows = numbering.number_respondents(ids.mapInArrow(count, "rid bigint"), bounds_from=ids)
    assert rows.filter("patient_number = rid + 1").count() == 1000 and seen.value == 1000


def test_running_totals_with_one_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randrange(10)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k bigint, x bigint").withColumn("_bucket", (F.col("k") / 100).cast("int"))
    got = ordering.running_totals(df, [F.col("k")], {"s": "x"}, ["g"]).collect()
    seen, want = {}, {}
    for g, k, x in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + x
        want[(g, k)] = seen[g]
    assert {(r["g"], r["k"]): r["s"] for r in got} == want


@pytest.mark.parametrize("size", [0, 1, 37, 999, 1000, 5000])
def test_hash_sample_takes_exactly_the_smallest_digests(spark, size):
    import hashlib

    df = spark.range(1000).withColumnRenamed("id", "rid")
    got = sorted(r["rid"] for r in split.hash_sample(df, size).collect())
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"42:sample:{i}".encode()).hexdigest())
    assert got == sorted(order[:size])


def test_neighbours_are_clamped(spark):
    rows = profiles(spark, [profile(20.0 + i) for i in range(12)]).withColumn(TARGET, F.lit(None).cast("double"))
    asked = spark.createDataFrame([(1,), (6,), (12,), (13,), (0,)], "patient_number bigint")
    got = {}
    for r in numbering.neighbour_windows(rows, asked).collect():
        got.setdefault(r["requested"], []).append(r["patient_number"])
        assert r["actual_label"] == "Not supplied" and r["sex"] == "Female"
    assert {k: sorted(v) for k, v in got.items()} == {
        1: list(range(1, 10)), 6: list(range(2, 11)), 12: list(range(4, 13)),
    }
    few = rows.filter("patient_number <= 3")
    near = numbering.neighbour_windows(few, asked).filter("requested = 1").collect()
    assert sorted(r["patient_number"] for r in near) == [1, 2, 3]
    assert sorted(r[0] for r in numbering.out_of_range(rows, asked).collect()) == [0, 13]
    assert numbering.lookup(rows, asked).count() == 3


@pytest.mark.parametrize(("span", "size"), [(9, 9), (10, 3), (4096, 9), (16, 1)])
def test_neighbours_over_borders_of_ranges(spark, monkeypatch, span, size):
    monkeypatch.setattr(numbering, "SPAN", span)
    rows = profiles(spark, [profile(20.0 + i % 50) for i in range(100)])
    asked = spark.createDataFrame([(i,) for i in (*range(1, 101, 3), 4, 4, 100, 101, -3, None)], "patient_number bigint")
    got = {}
    for r in numbering.neighbour_windows(rows, asked, size).collect():
        got.setdefault(r["requested"], []).append(r["patient_number"])
    first = {i: max(0, min(i - 1 - size // 2, 100 - size)) for i in {*range(1, 101, 3), 4, 100}}
    assert {k: sorted(v) for k, v in got.items()} == {i: list(range(a + 1, a + size + 1)) for i, a in first.items()}


def test_neighbours_move_each_row_about_once(spark):
    rows = spark.range(50_000).selectExpr("id + 1 AS patient_number", "20D AS BMI", "5D AS Age", "1D AS Sex", "0D AS Diabetes_012")
    windows = numbering.neighbour_windows(rows, rows)
    assert "Join" not in windows._jdf.queryExecution().executedPlan().toString()
    assert windows.count() == 9 * 50_000
    assert numbering.bordered(rows, 9).count() == 50_000 + 2 * 8 * (50_000 // numbering.SPAN) + 8


def test_published_split_quotas(spark):
    counts = {0.0: 213703, 1.0: 4631, 2.0: 35346}
    parts = [spark.range(n).select(F.lit(c).alias(TARGET)) for c, n in counts.items()]
    df = parts[0].unionAll(parts[1]).unionAll(parts[2])
    got = {r[TARGET]: r["quota"] for r in split.split_quotas(df).collect()}
    assert got == {0.0: 42741, 1.0: 926, 2.0: 7069}


def test_split_is_exact_repeatable_and_seeded(spark, tiny):
    rows = survey(spark, tiny)
    first = {r["rid"] for r in split.stratified_split(rows).filter("is_test").collect()}
    again = {r["rid"] for r in split.stratified_split(rows.repartition(13)).filter("is_test").collect()}
    other = {r["rid"] for r in split.stratified_split(rows, seed=7).filter("is_test").collect()}
    assert first == again and first != other and len(first) == len(other) == 300


def test_class_weights_balance(spark, tiny):
    rows = split.with_weights(survey(spark, tiny))
    sums = {r[TARGET]: r["w"] for r in rows.groupBy(TARGET).agg(F.sum("weight").alias("w")).collect()}
    assert all(abs(w - 500.0) < 1e-6 for w in sums.values()) and len(sums) == 3

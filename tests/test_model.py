import itertools
import random
from collections import Counter
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from examples import profile, profiles
from vitalgrid.codebook import FEATURES, TARGET
from vitalgrid.functions import risk
from vitalgrid.operators import contributions, forest, importance, scenario, shapley, shapley_blocks, split
from vitalgrid.plans import model_queries
from vitalgrid.plans.derived import demo_forest, demo_score, scored, survey
from vitalgrid.session import run_folder
from vitalgrid.sources.artifacts import load_model, save_model


def descend(node, row):
    while not node.is_leaf:
        node = node.left if row[node.feature] <= node.threshold else node.right
    return node


def conditional_value(node, row, known, c):
    """Expected leaf share when only the ``known`` features are followed."""
    if node.is_leaf:
        return node.weights[c] / sum(node.weights)
    if node.feature in known:
        child = node.left if row[node.feature] <= node.threshold else node.right
        return conditional_value(child, row, known, c)
    return sum(
        child.cover / node.cover * conditional_value(child, row, known, c) for child in (node.left, node.right)
    )


def brute_force(model, row, c, used):
    """Shapley values straight from the definition, over all subsets."""
    value = {}
    for k in range(len(used) + 1):
        for s in itertools.combinations(used, k):
            value[frozenset(s)] = sum(conditional_value(t, row, set(s), c) for t in model.trees) / len(model.trees)
    m = len(used)
    out = {}
    for f in used:
        rest = [u for u in used if u != f]
        out[f] = sum(
            factorial(k) * factorial(m - k - 1) / factorial(m) * (value[frozenset(s) | {f}] - value[frozenset(s)])
            for k in range(m)
            for s in map(frozenset, itertools.combinations(rest, k))
        )
    return out


def random_forest(seed, trees=3, depth=4):
    """Random trees over six features that may repeat on a path."""
    rng = random.Random(seed)
    names = FEATURES[:6]

    def grow(level, cover, low, high):
        if level == depth or rng.random() < 0.15:
            return forest.Node(cover, tuple(rng.randint(1, 20) for _ in range(3)))
        name = rng.choice(names)
        lo, hi = low.get(name, 0.0), high.get(name, 10.0)
        cut = rng.uniform(lo, hi)
        part = rng.uniform(0.1, 0.9)
        return forest.Node(
            cover, (), name, cut,
            grow(level + 1, cover * part, low, {**high, name: cut}),
            grow(level + 1, cover * (1 - part), {**low, name: cut}, high),
        )

    return forest.Forest(tuple(grow(0, 64.0, {}, {}) for _ in range(trees)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contributions_equal_brute_force(seed):
    model = random_forest(seed)
    arrays = shapley.LeafArrays(model)
    rng = random.Random(seed)
    rows = [{f: rng.uniform(-1, 11) for f in FEATURES} for _ in range(25)]
    classes = np.array([i % 3 for i in range(len(rows))])
    positions = arrays.positions([np.array([r[f] for r in rows]) for f in arrays.used])
    phi = shapley.contributions(arrays, positions, classes)
    base = model.base_values()
    for row, c, got in zip(rows, classes, phi):
        want = brute_force(model, row, c, arrays.used)
        assert got == pytest.approx([want[f] for f in arrays.used], abs=1e-12)
        share = sum(leaf.weights[c] / sum(leaf.weights) for leaf in (descend(t, row) for t in model.trees)) / 3
        assert base[c] + got.sum() == pytest.approx(share, abs=1e-12)


def node_rows(model):
    """Node table rows of a forest; inner nodes get their cover as a single weight."""
    rows = []
    for tree, root in enumerate(model.trees):
        number = itertools.count()

        def add(node):
            own = next(number)
            place = len(rows)
            rows.append(None)
            if node.is_leaf:
                whole = sum(node.weights)
                rows[place] = (tree, own, -1, -1, None, None, [node.cover * w / whole for w in node.weights])
            else:
                left, right = add(node.left), add(node.right)
                rows[place] = (tree, own, left, right, FEATURES.index(node.feature), node.threshold, [node.cover, 0.0, 0.0])
            return own

        add(root)
    return rows


NODES = "tree bigint, node bigint, left_node bigint, right_node bigint, feature_index int, threshold double, weights array<double>"


@pytest.mark.parametrize(("seed", "bits", "block"), [(1, 11, 7), (2, 3, 1000), (3, 1, 1000)])
def test_block_contributions_equal_brute_force(spark, monkeypatch, seed, bits, block):
    """Tabulated and direct codes, one and several blocks of rows and trees, equal profiles, a row without class."""
    monkeypatch.setattr(shapley_blocks, "TABLE_BITS", bits)
    monkeypatch.setattr(shapley_blocks, "ROW_BLOCK", block)
    model = random_forest(seed, trees=3, depth=5)
    rng = random.Random(seed)
    rows = [{f: rng.uniform(-1, 11) for f in FEATURES} for _ in range(12)]
    data = [(i, *[r[f] for f in FEATURES], i % 3 if i < 11 else None) for i, r in enumerate(rows)]
    data.append((12, *data[0][1:]))
    schema = "rid bigint, " + ", ".join(f"{f} double" for f in FEATURES) + ", predicted_class int"
    nodes = spark.createDataFrame(node_rows(model), NODES)
    got = {r["rid"]: r["shap"] for r in shapley_blocks.with_shap(spark.createDataFrame(data, schema), nodes).collect()}
    assert len(got) == 13 and got[11] is None and got[12] == got[0]
    used = sorted({f for leaf in model.leaves() for f in leaf.share}, key=FEATURES.index)
    for i in range(11):
        want = brute_force(model, rows[i], i % 3, used)
        assert got[i] == pytest.approx([want.get(f, 0.0) for f in FEATURES], abs=1e-12)
    base = {r["class_index"]: r["base"] for r in shapley_blocks.base_values(nodes).collect()}
    assert [base[c] for c in range(3)] == pytest.approx(model.base_values(), abs=1e-12)


def test_block_counts_are_bounded_and_use_all_cores(spark):
    rows, trees = shapley_blocks._counts(spark, 10_000, 400, 800_000)
    assert rows == 1 and trees >= 8
    rows, trees = shapley_blocks._counts(spark, 10**9, 400, 800_000)
    assert rows == -(-(10**9) // shapley_blocks.ROW_BLOCK) and trees == 1
    assert shapley_blocks._counts(spark, 10, 400, 50_000_000)[1] == 50
    assert shapley_blocks._counts(spark, 0, 0, 0) == (1, 1)


def test_contributions_of_nothing_and_of_leaves(spark, tiny):
    nodes = spark.createDataFrame([(0, 0, -1, -1, None, None, [1.0, 2.0, 1.0])], NODES)
    rows = scored(spark, tiny)
    assert shapley_blocks.with_shap(rows.limit(0), nodes).count() == 0
    assert shapley_blocks.with_shap(rows.limit(3), nodes).select("shap").distinct().collect()[0][0] == [0.0] * 21


def test_value_on_a_split_point_goes_left():
    node = forest.Node
    model = forest.Forest((node(4.0, (), "BMI", 30.0, node(1.0, (1, 0, 0)), node(3.0, (0, 0, 1))),))
    arrays = shapley.LeafArrays(model)
    positions = arrays.positions([np.array([30.0, 30.000001])])
    phi = shapley.contributions(arrays, positions, np.array([0, 0]))
    assert phi[:, 0] == pytest.approx([0.75, -0.25])


def test_spark_contributions_add_up(spark, tiny):
    model = demo_forest()
    base = F.array(*[F.lit(b) for b in model.base_values()])
    rows = shapley.with_shap(scored(spark, tiny), model)
    total = F.aggregate("shap", F.lit(0.0), lambda a, x: a + x)
    gap = F.get(base, F.col("predicted_class")) + total - F.array_max("probabilities")
    assert rows.select(F.max(F.abs(gap))).first()[0] < 1e-12
    assert rows.select(F.size("shap")).distinct().collect()[0][0] == 21


def test_trained_forest_saved_read_as_table_and_explained(spark, tiny):
    rows = survey(spark, tiny)
    model = forest.train(rows, trees=5, depth=4)
    path = run_folder(spark)
    save_model(model, path)
    structure = forest.forest_from_nodes(forest.saved_nodes(spark, path))
    assert len(structure.trees) == 5
    both = forest.score_with_model(rows, load_model(path)).withColumn("own", structure.probabilities())
    gap = F.array_max(F.zip_with("probabilities", "own", lambda a, b: F.abs(a - b)))
    assert both.select(F.max(gap)).first()[0] < 1e-9
    # balanced weights start every class near one third
    assert structure.base_values() == pytest.approx([1 / 3] * 3, abs=0.08)
    base = F.array(*[F.lit(b) for b in structure.base_values()])
    total = F.aggregate("shap", F.lit(0.0), lambda a, x: a + x)
    explained = shapley.with_shap(both, structure)
    gap = F.get(base, F.col("predicted_class")) + total - F.get("probabilities", F.col("predicted_class"))
    assert explained.select(F.max(F.abs(gap))).first()[0] < 1e-9
    labels = rows.select(TARGET).distinct().count()
    assert labels == 3


def test_large_forests_are_walked_as_arrays(spark, tiny, monkeypatch):
    """Beyond the size of an expression, the same forest gives the same scores."""
    model = random_forest(3, trees=4, depth=5)
    rows = survey(spark, tiny).filter("rid < 200")
    small = forest.score(rows, model).select("rid", "probabilities", "predicted_class").orderBy("rid").collect()
    monkeypatch.setattr(forest, "EXPRESSION_LEAVES", 3)
    large = forest.score(rows, model).select("rid", "probabilities", "predicted_class").orderBy("rid").collect()
    for x, y in zip(small, large, strict=True):
        assert x["probabilities"] == pytest.approx(y["probabilities"], abs=1e-12)
        assert x["predicted_class"] == y["predicted_class"]


def test_prediction_struct_and_ties(spark):
    df = spark.createDataFrame([([0.4, 0.2, 0.4],), ([0.1, 0.45, 0.45],), ([0.5, 0.5],)], "p array<double>")
    got = [r[0] for r in df.select(risk.prediction(F.col("p"))).collect()]
    assert [g["predicted_class"] for g in got] == [0, 1, 0]
    assert [g["high_risk_probability"] for g in got] == [0.4, 0.45, 0.0]
    assert [p["label"] for p in got[0]["probabilities"]] == ["Low", "Medium (prediabetes)", "High (diabetes)"]


def test_bands_and_descriptor_values(spark):
    df = spark.createDataFrame([(70.0,), (70.01,), (40.0,), (39.99,)], "p double")
    got = [(r["b"], r["c"]) for r in df.select(risk.risk_band(F.col("p")).alias("b"), risk.risk_colour(F.col("p")).alias("c")).collect()]
    assert got == [("Moderate", "#FFA500"), ("High", "#FF4D4D"), ("Moderate", "#FFA500"), ("Low", "#2ECC71")]
    bmi = spark.createDataFrame([(41.0,), (36.0,)], "b double").select(risk.shape_coefficient(F.col("b"))).collect()
    assert [r[0] for r in bmi] == [9.5, 7.0]


def test_scenario_edits_and_limits(spark):
    rows = profiles(spark, [profile(41.0), profile(14.0)]).withColumn("PhysActivity", F.lit(0.0))
    got = scenario.simulate(rows, [scenario.default_scenario()], demo_score).orderBy("rid").collect()
    assert [[tuple(c) for c in r["changes"]] for r in got] == [
        [("PhysActivity", 0.0, 1.0), ("BMI", 41.0, 36.0)] if FEATURES.index("PhysActivity") < FEATURES.index("BMI")
        else [("BMI", 41.0, 36.0), ("PhysActivity", 0.0, 1.0)],
        [("BMI", 14.0, 12.0), ("PhysActivity", 0.0, 1.0)],
    ]
    assert all(r["high_risk_change"] == r["high_risk_probability"] - r["baseline"]["high_risk_probability"] for r in got)
    with pytest.raises(ValueError, match="Age"):
        scenario.Scenario("bad", {"Age": F.lit(1.0)})
    record = scenario.case_records(scenario.simulate(rows, [scenario.default_scenario()], demo_score)).first()
    assert record["current"]["smpl_beta_0"] == 9.5 and record["scenario"]["bmi"] == 36.0
    pair = scenario.prediction_pair(scenario.simulate(rows, [scenario.default_scenario()], demo_score), ["rid"])
    assert pair.first()["baseline"]["label"] in ("Low", "High (diabetes)")


def test_overrides_only_replace_editable_features(spark):
    rows = profiles(spark, [profile(), profile()])
    edits = spark.createDataFrame([(1, 40.0, None)], "patient_number bigint, BMI double, HighBP double")
    got = {r["patient_number"]: (r["BMI"], r["HighBP"]) for r in scenario.apply_overrides(rows, edits).collect()}
    assert got == {1: (40.0, 0.0), 2: (33.5, 0.0)}
    with pytest.raises(ValueError, match="Sex"):
        scenario.apply_overrides(rows, edits.withColumnRenamed("BMI", "Sex"))


def test_refresh_tolerance(spark):
    schema = "patient_number bigint, bmi double, gender string, risk_percent double"
    old = spark.createDataFrame([(1, 30.0, "male", 50.0), (2, 30.0, "male", 50.0), (3, 30.0, "male", 50.0)], schema)
    new = spark.createDataFrame(
        [(1, 30.0, "male", 50.00009), (2, 30.0, "male", 50.00011), (3, 30.0, "female", 50.0), (4, 1.0, "male", 1.0)], schema
    )
    assert sorted(r[0] for r in scenario.needs_refresh(new, old).collect()) == [2, 3, 4]
    assert sorted(r[0] for r in scenario.needs_refresh(new, old, with_gender=False).collect()) == [2, 4]
    assert sorted(r[0] for r in scenario.up_to_date(new, old).collect()) == [1]


def test_permutation_keeps_values_and_finds_used_features(spark, tiny):
    rows = survey(spark, tiny)
    moved = importance.permuted_rows(rows, TARGET, repeats=2)
    assert moved.count() == 1500 * 21 * 2
    before = sorted(r[0] for r in rows.select("BMI").collect())
    after = moved.filter("feature = 'BMI' AND repeat = 1")
    assert sorted(r[0] for r in after.select("BMI").collect()) == before
    # other columns stay with their row
    same = after.select("rid", "Age").join(rows.select("rid", F.col("Age").alias("own")), "rid")
    assert same.filter("Age <> own").count() == 0
    scores = {r["feature"]: r for r in importance.permutation_importance(rows, demo_score, TARGET, 800).collect()}
    assert len(scores) == 21
    assert scores["BMI"]["importance_mean"] > 0.01
    assert scores["Smoker"]["importance_mean"] == 0.0 and scores["Smoker"]["importance_std"] == 0.0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_donors_are_a_bijection(spark, n):
    keys = F.array(*[F.lit(k).cast("bigint") for k in importance.round_keys(42, 1)])
    got = spark.range(n).select(importance.shuffled(F.col("id"), F.lit(n).cast("bigint"), keys).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


def test_donors_are_uniform(spark):
    """Over many keys all orders of four positions come up about as often, and every pair of places of more."""
    rows = [(seed, importance.round_keys(seed, 0)) for seed in range(4800)]
    df = spark.createDataFrame(rows, "seed bigint, keys array<bigint>")

    def images(n):
        each = [importance.shuffled(F.lit(i), F.lit(n).cast("bigint"), F.col("keys")) for i in range(n)]
        return [tuple(r[0]) for r in df.select(F.array(*each)).collect()]

    counts = Counter(images(4))
    assert len(counts) == 24 and sum((c - 200) ** 2 / 200 for c in counts.values()) < 60
    pairs = Counter((i, p) for order in images(11) for i, p in enumerate(order))
    assert len(pairs) == 121 and sum((c - 4800 / 11) ** 2 / (4800 / 11) for c in pairs.values()) < 190


def test_ranking_ties_follow_feature_order(spark):
    rows = profiles(spark, [profile()])
    shap = [0.2, -0.1, 0.0] + [0.01] * 18
    df = rows.withColumn("shap", F.array(*[F.lit(v) for v in shap]))
    top = contributions.top_factors(df, ["rid"], 5).orderBy("factor_rank").collect()
    assert [r["feature"] for r in top] == ["HighBP", "HighChol", "BMI", "Smoker", "Stroke"]
    assert contributions.top_factors(df, ["rid"], None).count() == 21
    sides = df.select(contributions.supporting(F.col("shap")).alias("s"), contributions.opposing(F.col("shap")).alias("o")).first()
    assert [FEATURES[e["idx"]] for e in sides["s"]] == ["HighBP", "BMI", "Smoker"]
    assert [FEATURES[e["idx"]] for e in sides["o"]] == ["HighChol"]
    even = df.withColumn("shap", F.array(*[F.lit(-0.5)] * 21))
    last = even.select(contributions.opposing(F.col("shap"))).first()[0]
    assert [FEATURES[e["idx"]] for e in last] == ["Income", "Education"]


def test_pack_and_missing(spark):
    rows = profiles(spark, [profile(), profile()]).withColumn("shap", F.array(*[F.lit(i / 8) for i in range(21)]))
    long = contributions.to_long(rows, ["rid"])
    assert [list(r["shap"]) for r in contributions.pack(long, "rid").collect()] == [[i / 8 for i in range(21)]] * 2
    partial = long.filter("rid = 0 AND feature <> 'Age'")
    got = contributions.missing_contributions(rows, partial, "rid").collect()
    assert [(r["rid"], r["feature"]) for r in got if r["rid"] == 0] == [(0, "Age")]
    assert sum(r["rid"] == 1 for r in got) == 21


def test_first_row_of_class_is_in_test_part(spark, tiny):
    held = split.stratified_split(survey(spark, tiny)).filter("is_test")
    assert held.filter(f"{TARGET} = 2").count() == 16


def test_forest_report_trains_the_whole_forest(spark, tiny, monkeypatch):
    asked, fit = [], forest.RandomForestClassifier.fit

    def spy(self, rows, *more):
        asked.append((self.getNumTrees(), self.getMaxDepth()))
        return fit(self.setNumTrees(2), rows, *more)

    monkeypatch.setattr(forest.RandomForestClassifier, "fit", spy)
    assert model_queries.forest_report(spark, tiny).count() > 0
    assert asked == [(400, 10)]


def test_attributes_move_no_long_table(spark, tiny):
    plan = model_queries.profile_attributes(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "feature#" in plan and "(rid#" not in "".join(line for line in plan.splitlines() if "Join Inner" in line)

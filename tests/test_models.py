from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from salesloom.operators import additive, asof, baskets, models, recommend, segments, summaries, trends
from salesloom.plans import star
from salesloom.plans.queries import CHURN_CUT, CHURN_LEARNT_CUT
from salesloom.plans.queries import registry
from salesloom.session import cut_lineage
from tests.conftest import SF


def test_saved_model_scores_the_same(spark, tmp_path):
    labels = segments.churn_labels(star.order_totals(spark, SF), CHURN_CUT)
    model = models.fit_churn(labels)
    models.save_model(model, str(tmp_path), "churn")
    table = labels.select("customer_id", "churned", *[F.col(c).cast("double") for c in models.CHURN])
    loaded = models.predict(table, str(tmp_path), "churn").select("customer_id", "prediction").collect()
    score = models.LinearScore.of(model)
    direct = models.churn_scores(score, labels)
    assert {r[0]: int(r[1]) for r in loaded} == {r.customer_id: r.predicted for r in direct.collect()}
    score.save(spark, str(tmp_path / "plain"))
    again = models.LinearScore.load(spark, str(tmp_path / "plain"))
    want = {r.customer_id: r.churn_probability for r in direct.collect()}
    got = {r.customer_id: r.churn_probability for r in models.churn_scores(again, labels).collect()}
    assert got == pytest.approx(want, rel=1e-12)
    vectors = models.predict(table, str(tmp_path), "churn").select("customer_id", vector_to_array("probability")[1]).collect()
    assert want == pytest.approx({r[0]: r[1] for r in vectors}, rel=1e-9)


def test_churn_is_scored_out_of_time(spark):
    """Outcomes learnt from end before the scored cut's begin, and the scoring plan has neither vectors nor Python."""
    assert CHURN_LEARNT_CUT + dt.timedelta(days=180) <= CHURN_CUT
    scored = registry()["churn_scores"](spark, SF)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Python" not in plan and "DeserializeToObject" not in plan
    assert scored.filter("churn_probability <= 0 OR churn_probability >= 1").count() == 0
    status = {r.model: r for r in registry()["model_status"](spark, SF).collect()}
    assert set(status) == {"seasonal_naive", "additive", "boosted_trees", "churn"}
    assert 0.0 <= status["churn"].auc <= 1.0 and status["churn"].periods == scored.count()
    assert all(status[m].rmse >= status[m].mae > 0 for m in status if m != "churn")


def test_auc_by_ranks(spark):
    rng = random.Random(3)
    data = [(rng.randint(0, 1), rng.randint(0, 8) / 8) for _ in range(200)]
    ones, zeros = ([s for y, s in data if y == v] for v in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    frame = spark.createDataFrame(data, "y int, s double")
    assert models.auc(frame, "y", "s") == pytest.approx(want, rel=1e-12)
    assert models.auc(frame.where("y = 1"), "y", "s") is None  # nothing to rank against


def test_folds_never_learn_from_their_future(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-03-31')) AS d")
    got = models.rolling_folds(days, "d", dt.date(2024, 2, 1), 10, 3, 20)
    found = {(r.fold, r.role): (r.a, r.b, r.n) for r in got.groupBy("fold", "role").agg(
        F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("n")).collect()}
    for k in range(3):
        origin = dt.date(2024, 2, 1) + dt.timedelta(days=10 * k)
        assert found[k, "train"] == (dt.date(2024, 1, 1), origin - dt.timedelta(days=1), 31 + 10 * k)
        assert found[k, "test"] == (origin, origin + dt.timedelta(days=19), 20)


def test_parameters_are_chosen_by_fold_error(spark):
    """A day's level decides: deep trees see it, stumps don't."""
    rows = [("c", dt.date(2023, 1, 1) + dt.timedelta(days=k), float(k % 7), 0.0, 0.0, float(k % 7), 1.0, 100.0 * (k % 7 in (2, 5))) for k in range(400)]
    frame = spark.createDataFrame(rows, "category string, date date, lag_1 double, lag_7 double, lag_28 double, day_of_week double, month double, actual double")
    grid = ({"maxDepth": 1, "maxIter": 1}, {"maxDepth": 4, "maxIter": 1})
    chosen, errors = models.choose_parameters(frame, dt.date(2024, 1, 20), grid, folds=2, horizon_days=28)
    assert chosen == grid[1] and errors.count() == 4


def test_additive_forecast_finds_the_shape(spark):
    """Trend, year and week are found again, also without noise on most days left out of the fit."""
    import math

    first = dt.date(2000, 1, 1)

    def value(k):
        return 500 + 0.3 * k + 40 * math.sin(2 * math.pi * k / 365.25) + 15 * math.cos(2 * math.pi * 2 * k / 7)

    rows = [(c, first + dt.timedelta(days=k), round(value(k) * f, 2)) for c, f in (("a", 1.0), ("b", 2.0)) for k in range(900)]
    frame = spark.createDataFrame(rows, "category string, date date, revenue double").withColumn("revenue", F.col("revenue").cast("decimal(20,2)"))
    got = additive.forecast_additive(frame, first, 30).collect()
    assert len(got) == 60
    for r in got:
        k = (r.date - first).days
        assert float(r.forecast) == pytest.approx(value(k) * (1 if r.category == "a" else 2), abs=0.1)
    short = additive.forecast_additive(frame.where("date < DATE '2000-01-04'"), first, 2).collect()
    assert len(short) == 4 and all(r.forecast is None or abs(r.forecast) < 10**9 for r in short)


def test_elimination_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 4, 9):
        a = rng.normal(size=(n + 3, n))
        m, b = a.T @ a, rng.normal(size=n)
        frame = spark.createDataFrame([([[*map(float, row), float(v)] for row, v in zip(m, b)],)], "m array<array<double>>")
        got = frame.select(additive.solved(F.col("m"), n).alias("w")).first().w
        assert np.allclose(got, np.linalg.solve(m, b), rtol=1e-8)


def test_frequent_pairs_equal_brute_force(spark):
    from itertools import combinations

    rng = random.Random(9)
    data = [(o, rng.randint(0, 12)) for o in range(60) for _ in range(rng.randint(1, 6))]
    lines = spark.createDataFrame(data, "order_id long, product_id long")
    held = {o: {p for x, p in data if x == o} for o, _ in data}
    single = Counter(p for ps in held.values() for p in ps)
    pairs = Counter(c for ps in held.values() for c in combinations(sorted(ps), 2))
    itemsets, orders = baskets.frequent_itemsets(lines, 0.1)
    assert orders == 60
    want = {k: n for k, n in pairs.items() if n >= 6}
    assert {(r.product_id, r.other_id): r.orders for r in baskets.frequent_pairs(itemsets).collect()} == want
    rules = {(r.antecedent, r.consequent): r for r in baskets.association_rules(itemsets, orders, 0.3).collect()}
    both = {(a, b): n for (a, b), n in want.items()} | {(b, a): n for (a, b), n in want.items()}
    assert set(rules) == {k for k, n in both.items() if n / single[k[0]] >= 0.3}
    for (a, b), r in rules.items():
        assert r.lift == pytest.approx(r.support * 60 * 60 / (single[a] * single[b]))
    nothing, none = baskets.frequent_itemsets(lines.limit(0), 0.1)
    assert none == 0 and baskets.association_rules(nothing, none).collect() == []
    with pytest.raises(ValueError):
        baskets.frequent_itemsets(lines, 0)


def test_as_of_against_brute_force(spark):
    """A hot entity over many chunks, states at the example's own time, examples before any state."""
    rng = random.Random(11)
    states = [(0 if rng.random() < 0.6 else rng.randint(1, 5), rng.randint(0, 200), rng.randint(0, 99)) for _ in range(300)]
    examples = [(rng.randint(0, 7), rng.randint(0, 220), n) for n in range(150)]
    got = asof.as_of(
        spark.createDataFrame(examples, "e long, t int, n int"), spark.createDataFrame(states, "e long, k int, v int"),
        "e", "t", "k", ["v"], F.floor(F.col("t") / 10), F.floor(F.col("k") / 10),
    )
    rows = {r.n: (r.k, r.v) for r in got.collect()}
    assert len(rows) == 150 and got.columns == ["e", "t", "n", "k", "v"]
    for e, t, n in examples:
        known = [(k, v) for x, k, v in states if x == e and k < t]
        assert rows[n] == (max(known) if known else (None, None))


def test_sketches_of_days_union_to_a_range(spark):
    sales = spark.createDataFrame(
        [(p % 3, c, dt.date(2024, 1, 1 + d)) for d in range(9) for c in range(400 * d, 400 * d + 900) for p in (1,)],
        "product_id long, customer_id long, order_day date",
    )
    goods = spark.createDataFrame([(1, "a")], "product_id long, category string")
    sketches = summaries.customer_sketches(sales, goods)
    assert sketches.count() == 9
    found = summaries.customers_from_sketches(sketches.where("date >= DATE '2024-01-03'"), "category").first().estimate
    assert found == pytest.approx(400 * 6 + 900, rel=0.05)


def test_churn_features_end_before_the_cut(spark):
    labels = segments.churn_labels(star.order_totals(spark, SF), CHURN_CUT)
    assert labels.filter("recency_days <= 0 OR tenure_days < recency_days").count() == 0


def test_companions_equal_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.randint(0, 30), rng.randint(0, 9)) for _ in range(300)]
    lines = spark.createDataFrame([(o, p, 100) for o, p in data], "order_id long, product_id long, total_cents long")
    anchors = recommend.best_sellers(lines, 3)
    got = {(r.anchor_id, r.product_id): r.orders_together for r in recommend.copurchases(recommend.baskets(lines), anchors).collect()}
    sold = Counter(p for _, p in data)
    best = sorted(sold, key=lambda p: (-sold[p], p))[:3]
    held = {o: {p for x, p in data if x == o} for o, _ in data}
    want = Counter((a, p) for ps in held.values() for a in best if a in ps for p in ps if p != a)
    assert got == dict(want)
    assert recommend.best_sellers(lines, 1000).count() == len(sold)


def test_recommendations_are_ranked(spark):
    out = registry()["recommend_als"](spark, SF)
    per = out.groupBy("customer_id").agg(F.count("*").alias("n"), F.max("rank").alias("top"))
    assert per.filter("n > 5 OR n <> top").count() == 0


def test_every_bought_pair_is_scored(spark):
    """Of any category and however seldom sold, with the product of the factors as its score."""
    rng = random.Random(6)
    data = [(rng.randint(0, 20), rng.randint(0, 60)) for _ in range(500)]
    lines = spark.createDataFrame(data, "customer_id long, product_id long")
    got = recommend.recommend_als(lines, limit=100).collect()
    assert {(r.customer_id, r.product_id) for r in got} == set(data) and len(got) == len(set(data))
    model = recommend.fit_als(recommend.purchase_counts(lines))
    users = {r.id: r.features for r in model.userFactors.collect()}
    items = {r.id: r.features for r in model.itemFactors.collect()}
    pairs = lines.select("customer_id", "product_id").distinct()
    for r in recommend.score_pairs(model, pairs).collect():
        assert abs(r.score - sum(a * b for a, b in zip(users[r.customer_id], items[r.product_id]))) < 1e-5


def test_same_distribution_has_no_drift(spark):
    df = spark.range(1000).selectExpr("id % 10 AS x", "id < 500 AS old")
    psi = models.stability_index(df, "x", F.col("old"), [3, 6]).selectExpr("sum(psi)").first()[0]
    assert abs(float(psi)) < 0.01


def test_clusters(spark):
    out = registry()["behavior_clusters"](spark, SF)
    assert 1 < out.select("cluster").distinct().count() <= 5


def test_forecast_quality_row(spark):
    scored = spark.sql("SELECT 10.0D actual, 12.0D forecast UNION ALL SELECT 10.0D, 8.0D")
    row = models.evaluate(scored, "m").first()
    assert (row.model, row.periods, float(row.rmse), float(row.mae), float(row.mape), row.auc) == ("m", 2, 2.0, 2.0, 20.0, None)


def test_outliers_need_enough_orders(spark):
    data = [(i, 1, 10.0) for i in range(20)] + [(99, 1, 500.0), (100, 2, 1.0), (101, 2, 900.0)]
    orders = spark.createDataFrame(data, "order_id long, customer_id long, total_amount double")
    assert [r.order_id for r in trends.order_outliers(orders).collect()] == [99]


def test_new_products_are_nearly_the_best_of_all(spark):
    """Recall of the exact five best unbought products of every customer, over all customers of sf0.01."""
    import numpy as np

    lines = star.sales(spark, "/root/testdata/sf0.01").select("order_id", "customer_id", "product_id", "total_cents")
    got = recommend.recommend_new(lines).collect()
    ratings = recommend.purchase_counts(lines)
    model = recommend.fit_als(ratings)
    users = {r.id: np.array(r.features) for r in model.userFactors.collect()}
    items = model.itemFactors.collect()
    ids, matrix = np.array([r.id for r in items]), np.array([r.features for r in items])
    at = {p: n for n, p in enumerate(ids.tolist())}
    bought = {}
    for r in ratings.collect():
        bought.setdefault(r.customer_id, []).append(at[r.product_id])
    found = {}
    for r in got:
        assert at[r.product_id] not in bought[r.customer_id]
        assert r.score == pytest.approx(float(users[r.customer_id] @ matrix[at[r.product_id]]), abs=1e-5)
        found.setdefault(r.customer_id, set()).add(r.product_id)
    assert set(found) == set(users) and all(len(f) == 5 for f in found.values())
    hits = 0
    for u, vector in users.items():
        scores = matrix @ vector
        scores[bought[u]] = -np.inf
        hits += len(found[u] & set(ids[np.argsort(-scores)[:5]].tolist()))
    recall = hits / (5 * len(users))
    print("recall", recall)
    assert recall >= 0.9


def test_blocks_of_the_factor_model_grow_in_number_with_the_ratings(spark):
    """A block is held in a task's memory as a whole."""
    ratings = recommend.purchase_counts(star.sales(spark, SF)).localCheckpoint()
    n = ratings.count()
    for size, blocks in ((recommend.BLOCK_RATINGS, 10), (-(-n // 15), 17)):
        model = recommend.fit_als(ratings, block_ratings=size)
        assert {f.rdd.getNumPartitions() for f in (model.userFactors, model.itemFactors)} == {blocks}
        assert model.userFactors.count() == ratings.select("customer_id").distinct().count()
    assert recommend.BLOCK_RATINGS < 216_000_000 / 10  # at which a heap of 1.5 GB a task didn't do


def test_new_products_of_a_tiny_shop(spark):
    lines = spark.createDataFrame([(1, 1, 1, 5), (2, 1, 2, 5), (3, 2, 2, 5)], "order_id long, customer_id long, product_id long, total_cents long")
    assert {(r.customer_id, r.product_id) for r in recommend.recommend_new(lines).collect()} == {(2, 1)}


def test_stored_items_come_in_one_order(spark):
    """Also where files have one size, whose names are new each time."""
    rows = spark.range(0, 64, 1, 8).select("id", F.lit("x").alias("name"))
    orders = {tuple(r.id for r in recommend._listed_by_name(cut_lineage(rows, "a b")).collect()) for _ in range(4)}
    assert len(orders) == 1 and sorted(orders.pop()) == list(range(64))


def test_new_products_do_not_depend_on_how_cells_are_cut(spark):
    """Slices and parts of a few rows give what whole cells give; each customer gets its five."""
    lines = star.sales(spark, SF).select("order_id", "customer_id", "product_id", "total_cents")
    whole = sorted(map(tuple, recommend.recommend_new(lines).collect()))
    assert whole and len(whole) == 5 * len({r[0] for r in whole})
    assert sorted(map(tuple, recommend.recommend_new(lines, part_rows=30, slice_rows=3).collect())) == whole


def test_leaders_keep_ties_by_column_and_leave_out_what_is_held():
    import numpy as np

    scores = np.array([[1.0, 3.0, 3.0, 3.0, 2.0], [-np.inf, 0.0, -np.inf, -1.0, -np.inf]])
    row, column = recommend._leaders(scores, 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 1), (1, 3)]
    assert recommend._leaders(scores[:, :1], 2)[1].tolist() == [0]


def test_cells_learnt_from_a_sample_hold_every_item(spark):
    items = spark.range(3000).select(
        F.col("id").cast("int").alias("product_id"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("vector")
    )
    index = recommend.CandidateIndex.fit(items, probes=4, of_cell=5)
    assert len(index.centres) <= 110
    placed = index.cell_of_items(items).collect()
    assert sorted(r.product_id for r in placed) == list(range(3000))
    for r in placed[:50]:
        lifted = [x / index.longest for x in r.vector]
        lifted.append(max(0.0, 1 - sum(x * x for x in lifted)) ** 0.5)
        far = [sum((a - b) ** 2 for a, b in zip(lifted, c, strict=True)) for c in index.centres]
        assert far[r.cell] == pytest.approx(min(far), abs=1e-12)


def test_als_reads_pairs_without_storing_lines(spark, monkeypatch):
    from salesloom.plans import queries

    stored = []
    true = queries.cut_lineage
    monkeypatch.setattr(queries, "cut_lineage", lambda df, name="stage": stored.append(name) or true(df, name))
    registry()["recommend_als"](spark, SF)
    assert stored == []

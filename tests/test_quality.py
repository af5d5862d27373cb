from __future__ import annotations

from salesloom.operators import alerts, quality
from salesloom.plans.queries import registry
from salesloom.session import cut_lineage
from tests.conftest import SF, rows


def test_ratings_outside_the_range(spark):
    df = spark.sql("SELECT * FROM VALUES (0), (6), (CAST(NULL AS INT)), (3) AS t(rating)")
    assert rows(quality.check_rules(df, quality.review_rules()), "rule") == [("reviews.rating_in_range", 4, 2)]


def test_orphans_and_null_keys(spark):
    child = spark.sql("SELECT * FROM VALUES (1), (1), (2), (NULL) AS t(k)")
    parent = spark.sql("SELECT * FROM VALUES (1), (1) AS t(id)")
    out = quality.orphans([quality.Reference("c.p", child, "k", parent, "id")])
    assert rows(out, "relation") == [("c.p", 3, 1)]
    dup = quality.duplicate_keys({"c": (child, "k")})
    assert rows(dup, "table_name") == [("c", "k", 4, 1, 1, 1)]


def test_empty_tables(spark):
    empty = spark.sql("SELECT 1 k WHERE false")
    assert rows(quality.duplicate_keys({"c": (empty, "k")}), "table_name") == [("c", "k", 0, 0, 0, 0)]
    assert rows(quality.completeness({"c": empty}), "table_name") == [("c", "k", 0, 0, 0.0)]


def test_overview_counts_products_from_lines(spark):
    orders = spark.sql("SELECT * FROM VALUES (1, 5), (2, 5), (3, NULL) AS t(order_id, customer_id)")
    items = spark.sql("SELECT * FROM VALUES (7), (8), (7) AS t(product_id)")
    assert tuple(quality.overview(orders, items).first()) == ("Data Quality Check", 3, 1, 2, 3)


def test_text_lengths(spark):
    df = spark.sql("SELECT 'abc' name UNION ALL SELECT 'abcdef'")
    assert rows(quality.check_rules(df, quality.text_length_rules("c", {"name": 3})), "rule") == [("c.name_fits", 2, 1)]


def test_report_passes_and_fails(spark):
    child = spark.sql("SELECT * FROM VALUES (1), (2) AS t(k)")
    rules = quality.check_rules(child, {"c.small": child.k < 2, **quality.not_null_rules("c", child)})
    import datetime as dt

    dated = spark.sql("SELECT DATE '2024-01-01' d")
    out = quality.report(
        quality.duplicate_keys({"c": (child, "k")}),
        quality.orphans([quality.Reference("c.c", child, "k", child, "k")]),
        rules,
        quality.freshness({"c": (dated, "d")}, dt.date(2024, 3, 1), 7),
    )
    assert {r.rule: r.passed for r in out.collect()} == {
        "unique.c.k": True, "parent.c.c": True, "c.small": False, "not_null.c.k": True, "fresh.c": False,
    }


def test_report_reads_the_lines_three_times(spark, monkeypatch):
    """Each stage table and the report's own plan are looked through for scans of the line file."""
    plans = []

    def counted(df, name="stage"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut_lineage(df, name)

    monkeypatch.setattr(quality, "cut_lineage", counted)
    report = registry()["dq_report"](spark, SF)
    plans.append(report._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("l_orderkey#") > 0 or "l_partkey#" in p for p in plans) == 3
    rules = {r.rule: r for r in report.collect()}
    assert rules["overview.total_records"].checked == 1500 and rules["overview.unique_products"].passed


def test_alerts_on_data_and_models(spark):
    report = spark.createDataFrame([("a", 10, 2), ("b", 10, 0), ("c", 0, 0)], "rule string, checked long, failed long")
    assert [tuple(r) for r in alerts.data_alerts(report).collect()] == [("data_quality", "a", 0.2, 0.0)]
    assert alerts.data_alerts(report, 0.5).collect() == []
    status = spark.createDataFrame([("m", 12.0, None), ("n", 3.0, None), ("o", None, 0.4), ("p", None, 0.9)], "model string, mape double, auc double")
    got = {tuple(r) for r in alerts.accuracy_alerts(status, 10.0, 0.5).collect()}
    assert got == {("model_error", "m", 12.0, 10.0), ("model_ranking", "o", 0.4, 0.5)}

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal
from functools import partial

import pytest

from salesloom import schemas
from salesloom.functions.text import to_json_rows
from salesloom.operators import facts
from salesloom.plans import daily_load
from salesloom.sources import jdbc, staging
from salesloom.sources.events import decode_messages
from salesloom.sources.ingest import Feed, conform, ingest, load_replace
from salesloom.sources.layout import Layout
from salesloom.sources.staging import parse_events
from tests.conftest import SF, rows

DailyLoad = partial(daily_load.DailyLoad, buckets=3)


def test_feeds_of_three_formats(spark, tmp_path):
    spark.sql("SELECT 1 order_id, 2 customer_id, '10.005' total_amount").write.csv(str(tmp_path / "c"), header=True)
    spark.sql("SELECT 2 order_id, 'EUR' currency").write.json(str(tmp_path / "j"))
    spark.sql("SELECT 3 order_id, 7.5D total_amount").write.parquet(str(tmp_path / "p"))
    feeds = [
        Feed("csv", str(tmp_path / "c"), {"header": "true"}),
        Feed("json", str(tmp_path / "j")),
        Feed("parquet", str(tmp_path / "p")),
    ]
    out = ingest(spark, feeds, schemas.ORDERS)
    assert out.schema == conform(out, schemas.ORDERS).schema
    got = rows(out.select("order_id", "total_amount", "currency"), "order_id")
    assert got == [(1, Decimal("10.01"), "USD"), (2, None, "EUR"), (3, Decimal("7.50"), "USD")]


def test_replace_is_typed_and_repeatable(spark, tmp_path):
    df = spark.sql("SELECT 1 review_id, 9 product_id, 4 rating")
    for _ in range(2):
        back = load_replace(df, str(tmp_path / "r"), schemas.REVIEWS)
    assert [f.dataType for f in back.schema] == [f.dataType for f in schemas.REVIEWS]
    assert back.count() == 1 and back.first().is_verified is False


def test_jdbc_options():
    assert jdbc.partitioned("id", "1", "100", 4) == {
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "100", "numPartitions": "4",
    }
    with pytest.raises(ValueError):
        jdbc.partitioned("id", "1", "100", 0)


def test_broker_messages_use_the_same_parser(spark):
    body = json.dumps({"event_id": 5, "ts": "2024-01-01T00:00:00", "user_id": 1, "event_type": "view", "value": 1.25, "props": '{"k": 6}'})
    msgs = spark.createDataFrame([(bytearray(body, "utf8"),)], "value binary")
    e = parse_events(decode_messages(msgs)).first()
    assert (e.event_id, e.event_type, e.value, e.source) == (5, "view", Decimal("1.25"), "src2")


def test_json_rows(spark):
    out = to_json_rows(spark.sql("SELECT 1 a, 'x' b")).first().json
    assert json.loads(out) == {"a": 1, "b": "x"}


def test_layers(tmp_path):
    layout = Layout(str(tmp_path))
    assert layout.path("analytics", "t", "7").endswith("/analytics/t/load_id=7")
    with pytest.raises(ValueError):
        layout.path("elsewhere", "t", "7")


def test_daily_load_in_two_steps_equals_one(spark, tmp_path):
    raw = staging.load_raw(spark, SF)
    cut = "order_date < TIMESTAMP_NTZ '1998-06-15'"
    part = staging.Staging(
        raw.customers.filter("customer_id < 120"), raw.products, raw.orders.filter(cut), raw.order_items, raw.events, raw.order_tax
    )
    whole = DailyLoad(Layout(str(tmp_path / "one")), "20240101", dt.date(2024, 1, 1))
    whole.run(spark, raw)
    first = DailyLoad(Layout(str(tmp_path / "two")), "20240101", dt.date(2024, 1, 1))
    first.run(spark, staging.Staging(raw.customers, raw.products, part.orders, raw.order_items, raw.events, raw.order_tax))
    second = DailyLoad(Layout(str(tmp_path / "two")), "20240102", dt.date(2024, 1, 2), previous="20240101")
    for _ in range(2):  # the rerun changes nothing
        counts = {r.pipeline_stage: r.records for r in second.run(spark, raw).collect()}
        assert second.fact(spark).count() == whole.fact(spark).count()
    assert counts["fact_sales"] < whole.fact(spark).count()
    assert counts["dim_customers"] == raw.customers.count()
    for layer, table, key in (
        ("analytics", "daily_sales_summary", ["date"]),
        ("analytics", "product_performance", ["product_id"]),
        ("ml_features", "customer_features", ["customer_id", "feature_name"]),
        ("ml_features", "product_features", ["product_id", "feature_name"]),
        ("processed_data", "dim_customers", ["customer_key"]),
    ):
        one = whole.layout.read(spark, layer, table, "20240101")
        two = second.layout.read(spark, layer, table, "20240102").select(*one.columns)
        assert rows(one, *key) == rows(two, *key), table
    assert set(facts.FACT_COLUMNS) <= set(whole.fact(spark).columns)


@pytest.mark.parametrize("ids", [("0001", "0002", "0003"), ("9", "10", "11")])
def test_loads_of_any_ids_add_up(spark, tmp_path, ids):
    """Ids that look like numbers; the third load brings new orders only, the second is run twice."""
    raw = staging.load_raw(spark, SF)
    cuts = ("order_date < '1997-01-01'", "order_date < '1999-01-01'", "order_date >= '1999-01-01'")
    layout, previous = Layout(str(tmp_path)), None
    for load_id, cut in zip(ids, cuts):
        part = staging.Staging(raw.customers, raw.products, raw.orders.filter(cut), raw.order_items, raw.events, raw.order_tax)
        load = DailyLoad(layout, load_id, dt.date(2024, 1, 1), previous)
        for _ in range(2 if load_id == ids[1] else 1):
            load.run(spark, part)
        previous = load_id
    whole = DailyLoad(Layout(str(tmp_path / "one")), "1", dt.date(2024, 1, 1))
    whole.run(spark, raw)
    assert load.fact(spark).count() == whole.fact(spark).count()
    for layer, table, key in (
        ("analytics", "daily_sales_summary", ["date"]),
        ("analytics", "product_performance", ["product_id"]),
        ("processed_data", "dim_date", ["full_date"]),
    ):
        one, last = whole.layout.read(spark, layer, table, "1"), layout.read(spark, layer, table, ids[2])
        assert rows(last.select(*one.columns), *key) == rows(one, *key), table


def test_load_ids_are_refused(tmp_path):
    for load_id, previous in (("a/b", None), ("", None), ("1", "1"), ("2", "x=1")):
        with pytest.raises(ValueError):
            DailyLoad(Layout(str(tmp_path)), load_id, dt.date(2024, 1, 1), previous)


def test_new_customers_get_the_next_keys(spark, tmp_path):
    raw = staging.load_raw(spark, SF)
    some = staging.Staging(raw.customers.filter("registration_date < DATE '1996-01-01'"), raw.products, raw.orders, raw.order_items, raw.events, raw.order_tax)
    layout = Layout(str(tmp_path))
    DailyLoad(layout, "1", dt.date(2024, 1, 1)).run(spark, some)
    DailyLoad(layout, "2", dt.date(2024, 1, 2), previous="1").run(spark, raw)
    old = {r.customer_id: r.customer_key for r in layout.read(spark, "processed_data", "dim_customers", "1").collect()}
    new = {r.customer_id: r.customer_key for r in layout.read(spark, "processed_data", "dim_customers", "2").collect()}
    assert all(new[c] == k for c, k in old.items())
    assert sorted(new.values()) == list(range(1, len(new) + 1))


def test_endpoints_over_the_stored_star(spark, tmp_path):
    from salesloom.operators import metrics
    from salesloom.plans.endpoints import Endpoints
    from salesloom.plans.queries import AS_OF, registry

    raw = staging.load_raw(spark, SF)
    load = DailyLoad(Layout(str(tmp_path)), "1", dt.date(2024, 1, 1))
    stages = load.run(spark, raw)
    api = Endpoints.of_load(spark, load, raw.events)
    for name, got, key in (
        ("sales_summary", api.sales_summary(), "total_orders"),
        ("sales_summary_completed", api.sales_summary(statuses=["Completed"]), "total_orders"),
        ("sales_trend_monthly", api.sales_trends("monthly"), "period"),
        ("top10_products", api.top_products(), "product_id"),
        ("customer_segment_summary", api.customer_segments(AS_OF), "segment"),
        ("realtime_metrics", api.realtime_metrics(), "total_events"),
        ("recent_events", api.recent_events(), "event_id"),
    ):
        want = registry()[name](spark, SF)
        from salesloom.functions.text import present

        assert rows(present(got).select(*want.columns), key) == rows(want, key), name
    january = api.sales_trends("daily", dt.date(1997, 1, 1), dt.date(1997, 1, 31))
    assert january.count() <= 31
    now = stages.selectExpr("max(ts)").scalar()
    rate = metrics.pipeline_throughput(stages, now).filter("pipeline_stage = 'dim_customers'").first()
    assert rate.records == raw.customers.count() and rate.rate == rate.records / 300


def test_a_load_reads_only_what_it_touches(spark, tmp_path):
    """A later load with new orders of one month: fact, state and summary files of other months are left alone."""
    raw = staging.load_raw(spark, SF)
    layout = Layout(str(tmp_path))
    early = raw.orders.filter("order_date < '2001-06-01'")
    feed = staging.Staging(raw.customers, raw.products, early, raw.order_items, raw.events, raw.order_tax)
    DailyLoad(layout, "1", dt.date(2024, 1, 1)).run(spark, feed)
    june = raw.orders.filter("order_date >= '2001-06-05' AND order_date < '2001-07-01'")
    feed = staging.Staging(raw.customers, raw.products, june, raw.order_items, raw.events, raw.order_tax)
    load = DailyLoad(layout, "2", dt.date(2024, 1, 2), previous="1")
    load.run(spark, feed)
    held = load.earlier_orders(spark, feed, ["1"])
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "= 2001-06)" in plan.split("PartitionFilters: ")[1].split("]")[0]
    for layer, table in (("processed_data", "customer_days"), ("analytics", "daily_sales_summary")):
        owners = {r.part: r.load_id for r in spark.read.parquet(layout.path(layer, f"{table}_parts", "2")).collect()}
        assert {p for p, owner in owners.items() if owner == "2"} == {"2001-06"} and len(owners) > 70
    state = layout.read_parts(spark, "processed_data", "customer_days", "2", ["2001-06"])
    assert {f.split("order_month=")[1].split("/")[0] for f in state.inputFiles()} == {"2001-06"}
    both = spark.createDataFrame([], early.schema).unionByName(early).unionByName(june)
    whole = DailyLoad(Layout(str(tmp_path / "one")), "1", dt.date(2024, 1, 1))
    whole.run(spark, staging.Staging(raw.customers, raw.products, both, raw.order_items, raw.events, raw.order_tax))
    for layer, table, key in (
        ("analytics", "daily_sales_summary", ["date"]),
        ("ml_features", "customer_features", ["customer_id", "feature_name"]),
        ("ml_features", "product_features", ["product_id", "feature_name"]),
    ):
        one, two = whole.layout.read(spark, layer, table, "1"), layout.read(spark, layer, table, "2")
        assert rows(two.select(*one.columns), *key) == rows(one, *key), table
    old = layout.read(spark, "analytics", "daily_sales_summary", "1")  # the first version stays readable
    assert old.agg({"date": "max"}).first()[0] < dt.date(2001, 6, 1)


def test_a_load_without_new_orders_changes_nothing(spark, tmp_path):
    raw = staging.load_raw(spark, SF)
    layout = Layout(str(tmp_path))
    DailyLoad(layout, "1", dt.date(2024, 1, 1)).run(spark, raw)
    DailyLoad(layout, "2", dt.date(2024, 1, 2), previous="1").run(spark, raw)
    one, two = (layout.read(spark, "analytics", "daily_sales_summary", i) for i in "12")
    assert rows(one, "date") == rows(two, "date")


def test_a_load_sums_its_orders_once(spark, tmp_path, monkeypatch):
    """Days and customers come from one sum over the lines, and tables whose rows are replaced whole aren't joined."""
    people = [(i, f"c{i}", "s", "x", "A", dt.date(2020, 1, i)) for i in (1, 2)]
    goods = [(i, f"p{i}", "k", "b", Decimal(10), Decimal(6), True, None) for i in (1, 2)]
    placed = [(1, 1, "2020-01-05"), (2, 1, "2020-01-05"), (2, 1, "2020-01-05"), (3, 2, "2020-02-01"), (4, 2, "2020-01-31")]
    items = [(1, 1, 1), (1, 1, 2), (1, 2, 1), (2, 1, 1), (3, 2, 4), (4, 2, 1), (4, 9, 1)]
    orders = spark.createDataFrame(placed, "order_id long, customer_id long, day string").selectExpr(
        "order_id", "customer_id", "CAST(day AS timestamp_ntz) order_date", "'F' order_status", "'x' payment_method",
        "0.00BD total_amount", "1.00BD tax_amount", "2.00BD shipping_cost", "'USD' currency",
    )
    raw = staging.Staging(
        spark.createDataFrame(people, "customer_id long, name string, state string, country string, customer_segment string, registration_date date"),
        spark.createDataFrame(goods, "product_id long, product_name string, category string, brand string, price decimal(10,2), cost decimal(10,2), is_active boolean, created_at timestamp_ntz"),
        orders,
        spark.createDataFrame(items, "order_id long, product_id long, quantity int").selectExpr(
            "*", "10.00BD unit_price", "CAST(quantity * 10 AS decimal(12,2)) total_price", "0.00BD discount_percentage"
        ),
        spark.createDataFrame([], "event_id long"),
    )
    calls = []
    for module, name in ((daily_load.partials, "order_totals"), (daily_load, "upsert")):
        true = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, true=true, name=name: calls.append(name) or true(*a))
    layout = Layout(str(tmp_path))
    DailyLoad(layout, "1", dt.date(2024, 1, 1)).run(spark, staging.Staging(raw.customers, raw.products, orders.filter("order_id < 3"), raw.order_items, raw.events))
    assert calls == ["order_totals"]
    DailyLoad(layout, "2", dt.date(2024, 1, 2), previous="1").run(spark, raw)
    assert calls == ["order_totals", "order_totals", "upsert"]
    summary = layout.read(spark, "analytics", "daily_sales_summary", "2").select("date", "total_orders", "total_revenue", "repeat_customers")
    assert rows(summary, "date") == [
        (dt.date(2020, 1, 5), 2, Decimal(60), 1), (dt.date(2020, 1, 31), 1, Decimal(10), 1), (dt.date(2020, 2, 1), 1, Decimal(40), 1),
    ]
    sold = layout.read(spark, "analytics", "product_performance", "2").select("product_id", "total_sales", "total_orders")
    assert rows(sold, "product_id") == [(1, Decimal(50), 2), (2, Decimal(60), 3)]
    spent = layout.read(spark, "ml_features", "customer_features", "2").filter("feature_name <> 'avg_order_value'")
    assert rows(spent.select("customer_id", "feature_name", "feature_value"), "customer_id", "feature_name") == [
        (1, "total_orders", 2), (1, "total_spent", 60), (2, "total_orders", 2), (2, "total_spent", 50),
    ]

"""Calendar, dimensions, fact and the rules that follow from them, on hand-made rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesloom.functions import text
from salesloom.functions.money import from_cents, hundredths, margin_percentage, scaled
from salesloom.operators import dimensions, facts, products, segments, summaries
from salesloom.operators.calendar import dim_date
from tests.conftest import rows

D = dt.date
T = dt.datetime


@pytest.fixture(scope="module")
def star(spark):
    customers = spark.createDataFrame(
        [(1, "a", D(2024, 1, 5)), (2, "b", D(2024, 1, 1)), (3, "c", D(2024, 2, 1)), (4, "idle", D(2024, 1, 1))],
        "customer_id long, name string, registration_date date",
    )
    goods = spark.createDataFrame(
        [
            (10, "p", "X", "B", Decimal("10.00"), Decimal("4.00")),
            (11, "free", "X", "B", Decimal("0.00"), Decimal("1.00")),
            (12, "dear", "Y", "B", Decimal("10.00"), Decimal("490.00")),
            (13, "unsold", "Y", "B", Decimal("3.00"), Decimal("1.00")),
        ],
        "product_id long, product_name string, category string, brand string, price decimal(10,2), cost decimal(10,2)",
    )
    orders = spark.createDataFrame(
        [
            (100, 1, T(2024, 1, 5, 9), "Completed"),  # on registration day: new
            (101, 2, T(2024, 1, 5, 10), "Pending"),  # registered before: repeat
            (102, 3, T(2024, 1, 5, 11), "Cancelled"),  # registered later: neither
            (103, 1, T(2024, 1, 6, 1), "Completed"),
            (104, 9, T(2024, 1, 6, 2), "Completed"),  # no such customer
            (105, 1, T(2024, 1, 6, 3), "Completed"),  # no lines
        ],
        "order_id long, customer_id long, order_date timestamp_ntz, order_status string",
    ).withColumns({"tax_amount": F.lit("1.50").cast("decimal(12,2)"), "shipping_cost": F.lit("2.00").cast("decimal(10,2)")})
    items = spark.createDataFrame(
        [
            (100, 10, 2, "12.50", "25.00", "10.00"),
            (100, 12, 1, "1.00", "1.00", "0.00"),
            (101, 10, 1, "0.33", "0.33", "50.00"),
            (102, 11, 1, "5.00", "5.00", "0.00"),
            (103, 10, 3, "10.00", "30.00", "0.00"),
            (104, 10, 1, "9.00", "9.00", "0.00"),
            (103, 99, 1, "9.00", "9.00", "0.00"),  # no such product
            (999, 10, 1, "9.00", "9.00", "0.00"),  # no such order
        ],
        "order_id long, product_id long, quantity int, unit_price string, total_price string, discount_percentage string",
    ).selectExpr(
        "order_id", "product_id", "quantity", "cast(unit_price as decimal(12,2)) unit_price",
        "cast(total_price as decimal(12,2)) total_price", "cast(discount_percentage as decimal(9,2)) discount_percentage",
    )
    return items, orders, customers, goods


def test_calendar_days(spark):
    cal = {r.full_date: r for r in dim_date(spark, D(2020, 1, 1), D(2030, 12, 31)).collect()}
    assert len(cal) == 4018
    assert cal[D(2021, 1, 1)].week_of_year == 53
    assert cal[D(2021, 1, 2)].is_weekend and not cal[D(2021, 1, 1)].is_weekend
    assert cal[D(2024, 2, 29)].day == 29
    assert cal[D(2024, 2, 29)].month_name == "February" and cal[D(2024, 2, 29)].day_name == "Thursday"
    assert cal[D(2024, 2, 29)].date_key == 1709164800
    assert not cal[D(2024, 12, 25)].is_holiday


def test_calendar_holidays(spark):
    named = spark.createDataFrame([(D(2024, 1, 1), "New Year")], "full_date date, holiday_name string")
    cal = dim_date(spark, D(2024, 1, 1), D(2024, 1, 2), named)
    assert rows(cal.select("full_date", "is_holiday", "holiday_name"), "full_date") == [
        (D(2024, 1, 1), True, "New Year"),
        (D(2024, 1, 2), False, None),
    ]


def test_margin_of_zero_price_and_huge_cost(spark):
    df = spark.sql("SELECT 0.00 p, 1.00 c UNION ALL SELECT NULL, 1.00 UNION ALL SELECT 10.00, 490.00")
    got = {r[0] for r in df.select(margin_percentage("p", "c")).collect()}
    assert got == {None, Decimal("-4800.00")}


def test_integer_rounding_is_half_away_from_zero(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (5L, 1L, 2L), (-5L, 1L, 2L), (7L, 3L, 10L), (1L, 1L, 0L), "
        "(9000000000000L, 3000000000L, 7000000000L) AS t(a, n, d)"
    )
    got = [r[0] for r in df.select(scaled("a", "n", "d")).collect()]
    assert got == [3, -3, 2, None, 3857142857143]


def test_hundredths_of_doubles_and_decimals(spark):
    df = spark.sql("SELECT * FROM VALUES (0.29D, 0.29BD), (-1.10D, -1.10BD), (123456.78D, 123456.78BD) AS t(d, x)")
    got = [tuple(r) for r in df.select(hundredths(df, "d"), hundredths(df, "x")).collect()]
    assert got == [(29, 29), (-110, -110), (12345678, 12345678)]
    assert df.select(from_cents(hundredths(df, "d"))).first()[0] == Decimal("0.29")


def test_fact_amounts_and_dropped_rows(star):
    lines = facts.with_amounts(facts.sales_lines(*star))
    got = {(r.order_id, r.product_id): r for r in lines.collect()}
    assert set(got) == {(100, 10), (100, 12), (101, 10), (102, 11), (103, 10)}
    first = got[(100, 10)]
    assert (first.cost_amount, first.profit_amount, first.discount_amount) == (
        Decimal("10.00"), Decimal("15.00"), Decimal("2.50"),
    )
    assert got[(101, 10)].cost_amount == Decimal("0.13") and got[(101, 10)].profit_amount == Decimal("0.20")
    assert got[(101, 10)].discount_amount == Decimal("0.17")
    assert got[(100, 12)].profit_amount == Decimal("-48.00")
    assert got[(102, 11)].cost_amount is None and got[(102, 11)].margin_percentage is None


def test_fact_round_trip_to_cents(star):
    lines = facts.sales_lines(*star)
    back = facts.with_cents(facts.with_amounts(lines))
    assert rows(back.select(*lines.columns), "order_id", "product_id") == rows(lines, "order_id", "product_id")


def test_calendar_range_drops_other_days(star):
    lines = facts.sales_lines(*star, start=D(2024, 1, 6), end=D(2024, 1, 6))
    assert [r.order_id for r in lines.collect()] == [103]


def test_daily_summary_new_repeat_and_neither(star):
    lines = facts.sales_lines(*star)
    day = summaries.daily_sales_summary(summaries.order_totals(lines)).filter("date = DATE '2024-01-05'").first()
    assert (day.total_orders, day.total_customers, day.new_customers, day.repeat_customers) == (3, 3, 1, 1)
    assert day.total_revenue == Decimal("31.33")
    assert day.avg_line_value == 31.33 / 4 and day.avg_order_value == 31.33 / 3


def test_both_roads_to_order_totals(star):
    items, orders, customers, goods = star
    early = summaries.order_totals_of(
        facts.priced_lines(items, goods), facts.dated_orders(orders), facts.buyers(customers)
    )
    late = summaries.order_totals(facts.sales_lines(*star))
    assert rows(early.select(*late.columns), "order_id") == rows(late, "order_id")


def test_summary_statuses_range_and_empty(star):
    totals = summaries.order_totals(facts.sales_lines(*star))
    done = summaries.sales_summary(totals, statuses=["Completed"]).first()
    assert (done.total_orders, done.total_customers, done.customer_days) == (2, 1, 2)
    none = summaries.sales_summary(totals, start=D(2030, 1, 1)).first()
    assert (none.total_orders, none.avg_order_value, none.total_revenue) == (0, 0.0, Decimal("0.00"))


def test_range_without_rows(star):
    trend = summaries.sales_trend(summaries.order_totals(facts.sales_lines(*star)))
    early = (D(1990, 1, 1), D(1990, 1, 2))
    assert summaries.in_range(trend, "period", *early).count() == 0
    assert summaries.in_range(trend, "period", *early, on_empty="all").count() == 2


def test_slow_movers_include_the_unsold(star):
    got = products.slow_movers(facts.sales_lines(*star), star[3], 2).collect()
    assert [(r.product_id, r.revenue) for r in got] == [(13, Decimal("0.00")), (12, Decimal("1.00"))]


def test_ties_go_to_the_lower_id(spark):
    lines = spark.createDataFrame(
        [(1, 7, 100), (2, 5, 100), (3, 6, 100)], "order_id long, product_id long, total_cents long"
    ).withColumns({"profit_cents": F.lit(1), "quantity": F.lit(1), "margin_points": F.lit(1), "order_day": F.lit(D(2024, 1, 1))})
    goods = spark.createDataFrame([(p, "n", "c", "b") for p in (5, 6, 7)], "product_id long, product_name string, category string, brand string")
    assert sorted(r.product_id for r in products.top_products(lines, goods, "revenue", 2).collect()) == [5, 6]


def test_category_top_n_is_optional(star):
    lines = facts.sales_lines(*star)
    all_of = {r.category: r.revenue for r in products.revenue_by_category(lines, star[3]).collect()}
    assert all_of == {"X": Decimal("60.33"), "Y": Decimal("1.00")}
    top = products.revenue_by_category(lines, star[3], top_n=1).collect()
    assert [(r.category, r.share) for r in top] == [("X", 1.0)]


def test_reviews_fill_rating_columns(star, spark):
    reviews = spark.createDataFrame([(10, 5), (10, 4), (10, None)], "product_id long, rating int")
    got = {r.product_id: (r.avg_rating, r.total_reviews) for r in products.product_performance(facts.sales_lines(*star), star[3], reviews).collect()}
    assert got == {10: (Decimal("4.50"), 2), 11: (None, 0), 12: (None, 0)}


def test_append_facts_twice_adds_nothing(star):
    lines = facts.sales_lines(*star)
    once = facts.append_facts(lines.filter("order_id < 102"), lines)
    assert once.count() == lines.count() == facts.append_facts(once, lines).count()


def test_versions_open_only_on_change(spark):
    snaps = spark.createDataFrame(
        [(1, D(2024, 1, 1), "a"), (1, D(2024, 2, 1), "a"), (1, D(2024, 3, 1), None), (1, D(2024, 4, 1), None), (2, D(2024, 2, 1), "z")],
        "id long, day date, v string",
    )
    got = rows(dimensions.scd2(snaps, "id", "day", ["v"]), "id", "effective_date")
    assert got == [
        (1, "a", D(2024, 1, 1), D(2024, 3, 1), False),
        (1, None, D(2024, 3, 1), None, True),
        (2, "z", D(2024, 2, 1), None, True),
    ]
    sales = spark.createDataFrame([(1, D(2024, 2, 29)), (1, D(2024, 3, 1)), (1, D(2023, 1, 1))], "id long, order_day date")
    hit = facts.point_in_time(sales, dimensions.scd2(snaps, "id", "day", ["v"]), "id")
    assert rows(hit.select("order_day", "v"), "order_day") == [(D(2024, 2, 29), "a"), (D(2024, 3, 1), None)]


def test_dimension_keys_stay_and_new_ones_follow(spark):
    def feed(*ids):
        return spark.createDataFrame(
            [(i, f"n{i}", "S", "C", "seg", D(2024, 1, i)) for i in ids],
            "customer_id long, name string, state string, country string, customer_segment string, registration_date date",
        )

    dim = dimensions.dim_customers(feed(3, 1, 1))
    more = dimensions.extend_dimension(dim, dimensions.customer_rows(feed(2, 3, 9)), "customer_id", "customer_key", ["name"])
    assert rows(more.select("customer_key", "customer_id"), "customer_key") == [(1, 1), (2, 3), (3, 2), (4, 9)]


def test_product_without_creation_time_starts_on_load(spark):
    df = spark.sql(
        "SELECT 1L product_id, 'n' product_name, 'c' category, 'b' brand, 10.00 price, 4.00 cost, true is_active, "
        "CAST(NULL AS TIMESTAMP_NTZ) created_at"
    )
    assert dimensions.product_rows(df, D(2024, 5, 1)).first().effective_date == D(2024, 5, 1)


def test_order_cost_follows_line_share(star):
    got = facts.allocate_order_cost(facts.sales_lines(*star), "tax_amount", "part").filter("order_id = 100")
    assert {r.product_id: r.part for r in got.collect()} == {10: Decimal("1.44"), 12: Decimal("0.06")}


def test_tiles_with_fewer_customers_than_quintiles(spark):
    values = spark.createDataFrame([(1, 5, 1, 10), (2, 3, 2, 20), (3, 1, 3, 30)], "customer_id long, recency_days int, frequency long, monetary int")
    got = rows(segments.rfm_scores(values).select("customer_id", "r_score", "f_score", "m_score"), "customer_id")
    assert got == [(1, 1, 1, 1), (2, 2, 2, 2), (3, 3, 3, 3)]


def test_ids_and_formats(spark):
    one = spark.range(1).select(
        text.padded_id(text.CUSTOMER_ID, F.lit(7)),
        text.padded_id(text.ORDER_ID, F.lit(12)),
        text.money_text(F.lit(1234.5)),
        text.percent_text(F.lit(3.14159)),
        text.count_text(F.lit(1234567)),
    )
    assert tuple(one.first()) == ("CUST_000007", "ORDER_00000012", "$1,234.50", "3.1%", "1,234,567")

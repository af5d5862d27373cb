"""The registered queries: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.functions import bands, text
from salesloom.functions.money import from_cents
from salesloom.functions.text import present
from salesloom.operators import (
    additive,
    alerts,
    asof,
    baskets,
    calendar,
    dimensions,
    facts,
    features,
    load,
    metrics,
    models,
    partials,
    products,
    quality,
    recommend,
    segments,
    summaries,
    trends,
)
from salesloom.plans import star
from salesloom.plans.daily_load import DailyLoad
from salesloom.session import cut_lineage, scratch_path, small_tasks, tune
from salesloom.sources import staging
from salesloom.sources.buckets import store_bucketed
from salesloom.sources.events import event_stream
from salesloom.sources.layout import Layout
from salesloom.streaming import live, progress, sinks, users

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.date(2001, 8, 2)
LATE_FEED = (dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 20))
CHURN_CUT = dt.date(2001, 2, 3)
CHURN_LEARNT_CUT = dt.date(2000, 8, 7)  # its 180 days of outcomes end where those of CHURN_CUT begin
FOLDS = {"first": dt.date(2000, 1, 1), "step_days": 90, "folds": 4, "horizon_days": 90}
LEAST_SUPPORT = 0.0001
FORECAST_ORIGIN = dt.date(1995, 1, 1)
MODEL_CUT = dt.date(2001, 1, 1)
SECOND_LOAD = dt.date(1998, 6, 15)
RANGE = (dt.date(1997, 1, 1), dt.date(1997, 12, 31))
CORRECTED = (dt.date(1998, 4, 10), dt.date(1998, 6, 20))
BUCKETS = 16
FEED_BATCHES = 4
KNOWN_UNTIL = dt.date(1997, 1, 1)
STATUS_BANDS = {
    "revenue": bands.REVENUE_BANDS,
    "orders": bands.ORDER_BANDS,
    "customers": bands.CUSTOMER_BANDS,
}
PRICE_EDGES = tuple(1_000_000 * i for i in range(1, 10))  # cents
SERIES = ("event_type", "source")
WINDOW = ("window_start", "window_end")

_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Registers a query under its function name; consumers get ISO dates and doubles."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return present(fn(small_tasks(tune(spark)), folder))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    _REGISTRY[fn.__name__] = run
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- star ---------------------------------------------------------------------------------------------


@query
def dim_date(spark, folder):
    return calendar.dim_date_of(staging.orders(spark, folder), "order_date")


@query
def dim_customers(spark, folder):
    return dimensions.dim_customers(staging.customers(spark, folder))


@query
def dim_products(spark, folder):
    return dimensions.dim_products(staging.products(spark, folder), AS_OF)


@query
def fact_sales(spark, folder):
    """Dimensions are tables by the time the fact loads, so the joins are planned with their true sizes."""
    return facts.fact_sales(
        staging.order_items(spark, folder),
        staging.orders(spark, folder),
        cut_lineage(dimensions.dim_customers(staging.customers(spark, folder)), "dim_customers"),
        cut_lineage(dimensions.dim_products(staging.products(spark, folder), AS_OF), "dim_products"),
        tax=staging.order_tax(spark, folder),
    ).select(*facts.FACT_COLUMNS)


@query
def fact_sales_bucketed(spark, folder):
    """The fact from lines and orders stored in buckets of the order: their join, and what follows by order, shuffles
    nothing."""
    return facts.fact_of(_bucketed_sales(spark, folder)).select(*facts.FACT_COLUMNS)


def _bucketed_sales(spark, folder):
    people = cut_lineage(dimensions.dim_customers(staging.customers(spark, folder)), "dim_customers")
    goods = cut_lineage(dimensions.dim_products(staging.products(spark, folder), AS_OF), "dim_products")
    lines = facts.priced_lines(staging.order_items(spark, folder), dimensions.current(goods))
    placed = facts.placed_orders(staging.orders(spark, folder), dimensions.current(people), tax=staging.order_tax(spark, folder))
    stored = [store_bucketed(df, "order_id", BUCKETS, name) for df, name in ((lines, "lines"), (placed, "orders"))]
    return stored[0].join(stored[1], "order_id")


@query
def insert_ignore_customers(spark, folder):
    """Known customers keep their row; the full feed adds the others."""
    rows = dimensions.customer_rows(staging.customers(spark, folder))
    known = star.registered_before(rows, KNOWN_UNTIL).withColumn("customer_segment", F.lit("KNOWN"))
    return load.insert_ignore(known, rows, ["customer_id"], ["registration_date"]).select(
        "customer_id", "customer_segment", "registration_date"
    )


@query
def upsert_daily_sales(spark, folder):
    """The summary as of one status correction (completed orders only), then every order of every day."""
    totals = cut_lineage(star.order_totals(spark, folder), "orders")
    before = summaries.daily_sales_summary(summaries.with_statuses(totals, ["Completed"])).withColumn(
        "first_total_orders", F.col("total_orders")
    )
    fresh = summaries.daily_sales_summary(totals)
    return load.upsert(before, fresh, ["date"], ["total_orders", "total_revenue"])


@query
def upsert_partitioned_daily(spark, folder):
    """The same correction for the days of one quarter, into a table stored by month: other months keep their files."""
    totals = cut_lineage(star.order_totals(spark, folder), "orders")
    month = partials.month_of("date").alias("order_month")
    before = summaries.daily_sales_summary(summaries.with_statuses(totals, ["Completed"]))
    before = before.select("*", F.col("total_orders").alias("first_total_orders"), month)
    path = scratch_path(spark, "daily-by-month")
    load.write_partitioned(before, path, "order_month")
    fresh = summaries.daily_sales_summary(summaries.in_range(totals, "order_day", *CORRECTED)).select("*", month)
    figures = ["total_orders", "total_revenue"]
    load.upsert_partitioned(spark, path, before.schema, fresh, ["date"], figures, "order_month")
    return spark.read.schema(before.schema).parquet(path).drop("order_month")


@query
def scd2_products(spark, folder):
    return dimensions.scd2(star.product_snapshots(spark, folder), "product_id", "snapshot_date", ["price_band"])


@query
def fact_point_in_time(spark, folder):
    lines = star.sales(spark, folder).select(
        "order_id", "product_id", "order_day", from_cents("total_cents").alias("total_amount")
    )
    return facts.point_in_time(lines, scd2_products(spark, folder), "product_id").drop("expiry_date", "current_flag")


@query
def allocated_tax(spark, folder):
    lines = star.sales(spark, folder, with_tax=True).select("order_id", "product_id", "total_cents", "tax_amount")
    lines = cut_lineage(lines, "lines")
    return facts.allocate_order_cost(lines, "tax_amount", "allocated_tax").select(
        "order_id", "product_id", from_cents("total_cents").alias("total_amount"), "tax_amount", "allocated_tax"
    )


@query
def allocated_shipping(spark, folder):
    lines = star.sales(spark, folder).select("order_id", "product_id", "total_cents", "shipping_cost")
    lines = cut_lineage(lines, "lines")
    return facts.allocate_order_cost(lines, "shipping_cost", "allocated_shipping").select(
        "order_id", "product_id", from_cents("total_cents").alias("total_amount"), "shipping_cost", "allocated_shipping"
    )


@query
def allocated_tax_by_order(spark, folder):
    """What the lines of an order were given, beside its tax."""
    lines = star.sales(spark, folder, with_tax=True).select("order_id", "product_id", "total_cents", "tax_amount")
    shares = facts.allocate_order_cost(lines, "tax_amount", "part")
    return shares.groupBy("order_id").agg(F.max("tax_amount").alias("tax_amount"), F.sum("part").alias("allocated"))


# --- summaries ----------------------------------------------------------------------------------------


@query
def daily_sales_summary(spark, folder):
    return summaries.daily_sales_summary(star.order_totals(spark, folder))


def _loaded(spark, folder, layer, table):
    """A stored table after two daily loads: the orders before a day, then all."""
    raw = staging.load_raw(spark, folder)
    layout = Layout(scratch_path(spark, "loads"))
    early = replace(raw, orders=raw.orders.filter(F.to_date("order_date") < F.lit(SECOND_LOAD)))
    DailyLoad(layout, "0009", SECOND_LOAD, buckets=4).run(spark, early)
    DailyLoad(layout, "0010", SECOND_LOAD, "0009", buckets=4).run(spark, raw)
    return layout.read(spark, layer, table, "0010")


@query
def daily_load_summary(spark, folder):
    return _loaded(spark, folder, "analytics", "daily_sales_summary")


@query
def daily_load_product_performance(spark, folder):
    return _loaded(spark, folder, "analytics", "product_performance")


@query
def daily_load_customer_features(spark, folder):
    return _loaded(spark, folder, "ml_features", "customer_features")


@query
def daily_load_product_features(spark, folder):
    return _loaded(spark, folder, "ml_features", "product_features")


@query
def monthly_sales_trend(spark, folder):
    days = calendar.dim_date_of(staging.orders(spark, folder), "order_date")
    return summaries.monthly_sales_trend(star.order_totals(spark, folder), days)


def _trend(granularity: str) -> Query:
    def sales_trend(spark, folder):
        return summaries.sales_trend(star.order_totals(spark, folder), granularity)

    sales_trend.__name__ = f"sales_trend_{granularity}"
    return sales_trend


for _g in ("daily", "weekly", "monthly", "quarterly", "yearly"):
    query(_trend(_g))


@query
def first_30_days(spark, folder):
    return trends.first_periods(summaries.sales_trend(star.order_totals(spark, folder), "daily"), 30)


@query
def sales_in_range(spark, folder):
    daily = summaries.sales_trend(star.order_totals(spark, folder), "daily")
    return summaries.in_range(daily, "period", *RANGE)


@query
def sales_summary(spark, folder):
    return summaries.sales_summary(star.order_totals(spark, folder))


@query
def sales_summary_completed(spark, folder):
    return summaries.sales_summary(star.order_totals(spark, folder), statuses=["Completed"])


@query
def kpi_status_bands(spark, folder):
    return metrics.kpi_status(summaries.sales_kpis(star.order_totals(spark, folder)), STATUS_BANDS)


@query
def formatted_kpis(spark, folder):
    s = summaries.sales_summary(star.order_totals(spark, folder))
    return s.select(
        text.money_text(F.col("total_revenue")).alias("revenue"),
        text.count_text(F.col("total_orders")).alias("orders"),
        text.count_text(F.col("total_customers")).alias("customers"),
        text.money_text(F.col("avg_order_value")).alias("avg_order_value"),
    )


@query
def orders_by_status(spark, folder):
    return summaries.orders_by_status(staging.orders(spark, folder))


@query
def sales_by_geography(spark, folder):
    return summaries.sales_by_geography(star.order_totals(spark, folder), staging.customers(spark, folder))


@query
def approx_customers(spark, folder):
    return summaries.approx_customers(star.order_totals(spark, folder))


def _customer_sketches(spark, folder):
    sales = star.sales(spark, folder)
    return cut_lineage(summaries.customer_sketches(sales, staging.products(spark, folder)), "sketches")


@query
def customers_by_range_estimate(spark, folder):
    """Distinct customers per quarter and category from the days' sketches alone."""
    quarter = F.trunc("date", "quarter").alias("quarter")
    return summaries.customers_from_sketches(_customer_sketches(spark, folder), quarter, "category")


@query
def customers_by_range_sketch(spark, folder):
    """The same counted exactly, and whether the sketches' error stays within three standard errors."""
    estimates = summaries.customers_from_sketches(
        _customer_sketches(spark, folder), F.trunc("date", "quarter").alias("quarter"), "category"
    )
    lines = star.sales(spark, folder).join(staging.products(spark, folder).select("product_id", "category"), "product_id")
    exact = (
        lines.select(F.trunc("order_day", "quarter").alias("quarter"), "category", "customer_id")
        .distinct()
        .groupBy("quarter", "category")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    off = F.abs(F.col("estimate") - F.col("customers"))
    return exact.join(estimates, ["quarter", "category"], "left").select(
        "quarter", "category", "customers", F.coalesce(off <= 0.05 * F.col("customers"), F.lit(False)).alias("within_bound")
    )


@query
def basket_size_distribution(spark, folder):
    return summaries.basket_size_distribution(star.order_totals(spark, folder))


# --- products -----------------------------------------------------------------------------------------


def _goods(spark, folder):
    return staging.products(spark, folder)


@query
def product_performance(spark, folder):
    return products.product_performance(star.sales(spark, folder), _goods(spark, folder))


@query
def top_products(spark, folder):
    return products.product_sales(star.sales(spark, folder), _goods(spark, folder))


@query
def top10_products(spark, folder):
    return products.top_products(star.sales(spark, folder), _goods(spark, folder), "revenue", 10)


@query
def json_top_products(spark, folder):
    return text.to_json_rows(top10_products(spark, folder))


@query
def top_products_per_category(spark, folder):
    return products.top_products_per_category(star.sales(spark, folder), _goods(spark, folder), "profit", 3)


@query
def slow_movers(spark, folder):
    return products.slow_movers(star.sales(spark, folder), _goods(spark, folder), 20)


@query
def revenue_by_category(spark, folder):
    return products.revenue_by_category(star.sales(spark, folder), _goods(spark, folder))


@query
def sales_by_selected_categories(spark, folder):
    return products.revenue_by_category(
        star.sales(spark, folder), _goods(spark, folder), categories=["ECONOMY", "SMALL"]
    )


@query
def abc_products(spark, folder):
    return products.abc_products(star.sales(spark, folder), _goods(spark, folder))


def _slim_lines(spark, folder):
    """What the recommenders read several times, joined once."""
    return cut_lineage(
        star.sales(spark, folder).select("order_id", "customer_id", "product_id", "total_cents"), "lines"
    )


@query
def best_seller_companions(spark, folder):
    """Re-aimed: companions of the 20 best sellers rather than all pairs of every basket."""
    lines = _slim_lines(spark, folder)
    return recommend.copurchases(recommend.baskets(lines), recommend.best_sellers(lines, 20))


@query
def best_seller_recommendations(spark, folder):
    lines = _slim_lines(spark, folder)
    return recommend.recommend_copurchase(recommend.baskets(lines), recommend.best_sellers(lines, 20), 5)


@query
def frequent_pairs(spark, folder):
    """Every pair of products that one order in ten thousand holds."""
    itemsets, _ = baskets.frequent_itemsets(_slim_lines(spark, folder), LEAST_SUPPORT)
    return baskets.frequent_pairs(itemsets)


@query
def association_rules(spark, folder):
    return baskets.association_rules(*baskets.frequent_itemsets(_slim_lines(spark, folder), LEAST_SUPPORT), 0.05)


@query
def recommend_als(spark, folder):
    """Lines are read once, for their pairs, so they aren't stored and carry no amounts."""
    return recommend.recommend_als(star.sales(spark, folder).select("customer_id", "product_id"))


@query
def recommend_new(spark, folder):
    """Five products for every customer that it has not bought yet."""
    return recommend.recommend_new(_slim_lines(spark, folder))


@query
def recommend_new_checked(spark, folder):
    """How many products each customer was given, and how many of them it had bought."""
    lines = _slim_lines(spark, folder)
    given = cut_lineage(recommend.recommend_new(lines), "given")
    held = lines.select("customer_id", "product_id", F.lit(1).alias("held")).distinct()
    return given.join(held, ["customer_id", "product_id"], "left").groupBy(F.col("customer_id").cast("long").alias("customer_id")).agg(
        F.count(F.lit(1)).alias("recommended"), F.count("held").alias("bought_before")
    )


# --- trends and forecasts -----------------------------------------------------------------------------


def _daily(spark, folder, totals=None):
    days = calendar.dim_date_of(staging.orders(spark, folder), "order_date")
    return trends.daily_revenue(star.order_totals(spark, folder) if totals is None else totals, days)


@query
def monthly_growth(spark, folder):
    return summaries.revenue_growth(trends.monthly_revenue(star.order_totals(spark, folder)))


@query
def moving_average_revenue(spark, folder):
    return trends.moving_average_revenue(_daily(spark, folder))


@query
def running_revenue(spark, folder):
    return trends.running_revenue(_daily(spark, folder))


@query
def forecast_seasonal_naive(spark, folder):
    return trends.forecast_seasonal_naive(trends.monthly_revenue(star.order_totals(spark, folder)))


@query
def forecast_linear(spark, folder):
    return trends.forecast_linear(trends.monthly_revenue(star.order_totals(spark, folder)))


@query
def forecast_error(spark, folder):
    return trends.forecast_error(forecast_seasonal_naive(spark, folder), "seasonal_naive")


def _every_category_day(spark, folder):
    sold = cut_lineage(trends.category_days(star.sales(spark, folder), _goods(spark, folder)))
    return trends.every_category_day(sold)


def _sales_features(spark, folder):
    return models.sales_features(_every_category_day(spark, folder))


@query
def forecast_additive(spark, folder):
    """The four weeks after the last day, by trend, yearly and weekly shape."""
    return additive.forecast_additive(_every_category_day(spark, folder), FORECAST_ORIGIN)


@query
def forecast_folds(spark, folder):
    """What each rolling origin trains and tests on."""
    members = models.rolling_folds(_sales_features(spark, folder), "date", **FOLDS)
    return members.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.sum(F.col("actual").cast("decimal(18,2)")).alias("revenue"),
    )


@query
def forecast_fold_errors(spark, folder):
    """Errors of the naive forecasts at each origin."""
    members = models.rolling_folds(_sales_features(spark, folder), "date", **FOLDS)
    return models.fold_errors(members.where("role = 'test'"), {f"lag_{n}": f"lag_{n}" for n in (1, 7, 28)})


@query
def model_status(spark, folder):
    """A row per model: errors over months or days after the cut, and the churn model's ranking after its own."""
    days = cut_lineage(_every_category_day(spark, folder), "days")
    ahead = (AS_OF - MODEL_CUT).days
    later = additive.forecast_additive(days, FORECAST_ORIGIN, ahead, until=MODEL_CUT)
    shaped = later.join(days.withColumnRenamed("revenue", "actual"), ["category", "date"])
    trees = models.forecast_gbt(models.sales_features(days), MODEL_CUT)
    churn = cut_lineage(churn_scores(spark, folder), "churn-scores")
    return reduce(
        DataFrame.unionByName,
        [
            models.evaluate(forecast_seasonal_naive(spark, folder), "seasonal_naive"),
            models.evaluate(shaped, "additive"),
            models.evaluate(trees, "boosted_trees"),
            models.evaluate_scores(churn, "churn", "churned", "churn_probability"),
        ],
    )


@query
def forecast_features(spark, folder):
    """What ``forecast_gbt`` learns from."""
    return _sales_features(spark, folder).select(
        "category", "date", "actual", "lag_1", "lag_7", "lag_28", "day_of_week", "month"
    )


@query
def forecast_gbt(spark, folder):
    return models.forecast_gbt(_sales_features(spark, folder), MODEL_CUT)


@query
def revenue_anomalies(spark, folder):
    return trends.revenue_anomalies(trends.category_days(star.sales(spark, folder), _goods(spark, folder)))


@query
def order_outliers(spark, folder):
    return trends.order_outliers(staging.orders(spark, folder), sigmas=2.0)


# --- customers ----------------------------------------------------------------------------------------


@query
def customer_features(spark, folder):
    return features.customer_features(star.order_totals(spark, folder))


@query
def product_features(spark, folder):
    return features.product_features(star.sales(spark, folder))


@query
def customer_features_wide(spark, folder):
    long = features.customer_features(star.order_totals(spark, folder))
    return features.to_wide(long, "customer_id", features.CUSTOMER_FEATURES)


@query
def rfm_values(spark, folder):
    return segments.rfm_values(star.order_totals(spark, folder), AS_OF)


@query
def rfm_scores(spark, folder):
    return segments.rfm_scores(segments.rfm_values(star.order_totals(spark, folder), AS_OF))


@query
def customer_segments(spark, folder):
    return segments.customer_segments(star.order_totals(spark, folder), AS_OF)


@query
def customer_segment_summary(spark, folder):
    return segments.customer_segment_summary(segments.customer_segments(star.order_totals(spark, folder), AS_OF))


@query
def customer_ltv(spark, folder):
    return segments.customer_ltv(star.order_totals(spark, folder), AS_OF)


@query
def behavior_clusters(spark, folder):
    return models.behavior_clusters(segments.rfm_values(star.order_totals(spark, folder), AS_OF))


@query
def churn_labels(spark, folder):
    return segments.churn_labels(star.order_totals(spark, folder), CHURN_CUT)


@query
def churn_labels_learnt(spark, folder):
    """What the churn model learns from: the cut before, whose outcomes are known at ``CHURN_CUT``."""
    return segments.churn_labels(star.order_totals(spark, folder), CHURN_LEARNT_CUT)


@query
def churn_scores(spark, folder):
    """Learnt at the earlier cut, scored at the later one: no customer is scored by its own outcome."""
    totals = cut_lineage(star.order_totals(spark, folder), "orders")
    learnt = models.LinearScore.of(models.fit_churn(segments.churn_labels(totals, CHURN_LEARNT_CUT)))
    return models.churn_scores(learnt, segments.churn_labels(totals, CHURN_CUT))


@query
def features_as_of(spark, folder):
    """Each customer's state before the first day of every quarter, for training sets that cannot see ahead."""
    totals = star.order_totals(spark, folder)
    starts = F.sequence(F.lit(dt.date(1996, 1, 1)), F.lit(dt.date(2001, 7, 1)), F.expr("INTERVAL 3 MONTHS"))
    examples = staging.buyers(spark, folder).select("customer_id", F.explode(starts).alias("cut"))
    return asof.as_of(
        examples, asof.running_features(totals), "customer_id", "cut", "known_on",
        ["frequency", "monetary", "first_day"], F.year("cut"), F.year("known_on"),
    )


@query
def cohort_retention(spark, folder):
    return segments.cohort_retention(star.order_totals(spark, folder))


@query
def feature_drift_psi(spark, folder):
    lines = star.sales(spark, folder)
    return models.stability_index(lines, "total_cents", F.col("order_day") < F.lit(MODEL_CUT), PRICE_EDGES)


@query
def drift_index(spark, folder):
    """The population stability index of line amounts as one figure."""
    return feature_drift_psi(spark, folder).agg(F.sum("psi").cast("decimal(18,8)").alias("psi"))


# --- events -------------------------------------------------------------------------------------------


@query
def recent_events(spark, folder):
    return metrics.recent_events(staging.events(spark, folder))


@query
def event_props_extract(spark, folder):
    return staging.events(spark, folder).groupBy("source", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")
    )


@query
def metric_sum_by_label(spark, folder):
    return metrics.sum_by_label(staging.events(spark, folder), SERIES, ["event_type"])


@query
def latest_event_per_user(spark, folder):
    return metrics.latest_event_per_user(staging.events(spark, folder))


@query
def event_rate_5m(spark, folder):
    return metrics.rolling_rate(staging.events(spark, folder), ["event_type"])


@query
def counter_increase_5m(spark, folder):
    return metrics.counter_increase(staging.events(spark, folder), ["event_type"])


@query
def last_hour_events(spark, folder):
    rows = staging.events(spark, folder)
    return metrics.last_hours(rows, rows.agg(F.max("ts")).scalar())


@query
def conversion_funnel(spark, folder):
    return metrics.conversion_funnel(staging.events(spark, folder))


@query
def business_alerts(spark, folder):
    totals = cut_lineage(star.order_totals(spark, folder), "orders")
    return alerts.business_alerts(
        _daily(spark, folder, totals),
        metrics.conversion_funnel(staging.events(spark, folder)),
        segments.customer_segments(totals, AS_OF),
        conversion_floor=0.8,
    )


# --- streams ------------------------------------------------------------------------------------------


@query
def stream_events_count(spark, folder):
    return sinks.drain_updates(live.event_counts(event_stream(spark, folder)), "event_counts", ["event_type"])


@query
def stream_tumbling_counts(spark, folder):
    counts = live.tumbling_counts(event_stream(spark, folder))
    return sinks.drain_updates(counts, "tumbling_counts", [*WINDOW, "event_type"])


@query
def stream_rate_5m(spark, folder):
    rates = live.sliding_rate(event_stream(spark, folder))
    return sinks.drain_updates(rates, "sliding_rate", [*WINDOW, "event_type"])


@query
def realtime_metrics(spark, folder):
    return sinks.drain_updates(live.realtime_metrics(event_stream(spark, folder)), "realtime_metrics", [])


@query
def latest_gauge(spark, folder):
    return sinks.drain_updates(live.latest_gauge(event_stream(spark, folder), SERIES), "latest_gauge", SERIES)


@query
def stream_dedup_events(spark, folder):
    """Every event delivered twice comes out once."""
    twice = event_stream(spark, folder).unionByName(event_stream(spark, folder))
    return sinks.drain_append(live.deduplicated(twice), "dedup_events")


@query
def stream_sessions(spark, folder):
    return sinks.drain_sessions(event_stream(spark, folder), staging.events(spark, folder), live.sessions)


@query
def stream_alerts(spark, folder):
    """Rules over the last revision of each hour: what an earlier one broke doesn't count."""
    hourly = live.windowed_metrics(event_stream(spark, folder))
    return live.alerts(sinks.drain_updates(hourly, "hourly_metrics", WINDOW))


@query
def stream_user_state(spark, folder):
    return sinks.drain_updates(live.user_state(event_stream(spark, folder)), "user_state", ["user_id"])


@query
def stream_daily_summary(spark, folder):
    """The daily summary kept by a stream of sales lines, in four batches that split orders and days.

    Products go to four sorts of files, a sort in as many files as its size asks for, and a quarter of the files to a batch.
    """
    lines = star.sales(spark, folder).select(*summaries.ORDER_COLUMNS, "product_id", "quantity", "total_cents", "profit_cents")
    feed = scratch_path(spark, "lines")
    sort = F.pmod(F.xxhash64("product_id"), F.lit(FEED_BATCHES)).alias("sort")
    dealt = lines.select("*", sort).hint("rebalance", "sort")
    dealt.write.partitionBy("sort").parquet(feed)
    files = len(spark.read.schema(lines.schema).option("recursiveFileLookup", "true").parquet(feed).inputFiles())
    arriving = spark.readStream.schema(lines.schema).options(
        maxFilesPerTrigger=max(1, -(-files // FEED_BATCHES)), recursiveFileLookup="true"
    )
    return sinks.drain_daily_summary(arriving.parquet(feed))


@query
def stream_user_state_live(spark, folder):
    """Each user's last span of activity, and whether it had ended (a day without events) when the input did."""
    return sinks.drain_updates(users.user_activity(event_stream(spark, folder)), "user_activity", ["user_id"])


@query
def stream_progress(spark, folder):
    """What a deduplicating stream reports when the first half of the events comes last, two batches late: rows are late
    by the watermark that the batch before went by."""
    events = staging.scan(spark, folder, "events")
    feed = scratch_path(spark, "late-events")
    early, middle = (F.lit(day).cast("timestamp_ntz") for day in LATE_FEED)
    ts = F.col("ts")
    for n, due in enumerate((ts.between(early, middle), ts > middle, ts < early)):
        events.where(due).coalesce(1).write.parquet(f"{feed}/events.parquet/{n}")
    stream = event_stream(spark, feed, maxFilesPerTrigger="1", recursiveFileLookup="true")
    log = progress.ProgressLog(spark, scratch_path(spark, "progress"), frozenset({"dedup"}))
    with log:
        once = stream.withWatermark("ts", live.DELAY).dropDuplicatesWithinWatermark(["event_id"])
        sinks.append_table(
            once, scratch_path(spark, "dedup"), scratch_path(spark, "dedup-state"), sinks.until_done(), "dedup"
        ).awaitTermination()
        log.wait()
    return progress.totals(log.table()).drop("most_state_rows")


@query
def stream_events_by_segment(spark, folder):
    joined = live.events_by_segment(event_stream(spark, folder), staging.buyers(spark, folder))
    return sinks.drain_updates(joined, "events_by_segment", [*WINDOW, "customer_segment"])


# --- data quality -------------------------------------------------------------------------------------


@query
def dq_overview(spark, folder):
    return quality.overview(staging.orders(spark, folder), staging.order_items(spark, folder))


@query
def dq_duplicate_keys(spark, folder):
    raw = staging.load_raw(spark, folder)
    return quality.duplicate_keys(
        {
            "customers": (raw.customers, "customer_id"),
            "products": (raw.products, "product_id"),
            "orders": (raw.orders, "order_id"),
            "events": (raw.events, "event_id"),
        }
    )


@query
def dq_orphans(spark, folder):
    raw = staging.load_raw(spark, folder)
    return quality.orphans(
        [
            quality.Reference("orders.customer", raw.orders, "customer_id", raw.customers, "customer_id"),
            quality.Reference("order_items.order", raw.order_items, "order_id", raw.orders, "order_id"),
            quality.Reference("order_items.product", raw.order_items, "product_id", raw.products, "product_id"),
            quality.Reference("orders.has_items", raw.orders, "order_id", raw.order_items, "order_id"),
            quality.Reference("events.user", raw.events, "user_id", raw.customers, "customer_id"),
        ]
    )


def _rules(raw, complete=False):
    """Rules per table; with ``complete`` the NULL checks of its columns run in the same pass."""
    tables = {
        "customers": (raw.customers, {}),
        "products": (raw.products, quality.product_rules()),
        "orders": (raw.orders.drop("tax_amount"), quality.order_rules()),
        "order_items": (raw.order_items, quality.item_rules()),
    }
    return [
        (df, {**rules, **(quality.not_null_rules(name, df) if complete else {})})
        for name, (df, rules) in tables.items()
        if rules or complete
    ]


@query
def dq_domain(spark, folder):
    return quality.domain(_rules(staging.load_raw(spark, folder)))


@query
def dq_completeness(spark, folder):
    raw = staging.load_raw(spark, folder)
    return quality.completeness(
        {
            "customers": raw.customers,
            "products": raw.products,
            "orders": raw.orders.drop("tax_amount"),
            "order_items": raw.order_items,
        }
    )


@query
def dq_consistency(spark, folder):
    raw = staging.load_raw(spark, folder)
    return quality.consistency(raw.orders, raw.order_items, raw.customers)


@query
def dq_freshness(spark, folder):
    raw = staging.load_raw(spark, folder)
    tables = {
        "orders": (raw.orders, "order_date"),
        "order_items": (raw.order_items, "ship_date"),
        "customers": (raw.customers, "registration_date"),
    }
    return quality.freshness(tables, AS_OF, max_age_days=7)


@query
def dq_report(spark, folder):
    raw = staging.load_raw(spark, folder)
    return quality.full_report(raw, quality.domain(_rules(raw, complete=True)), AS_OF, max_age_days=7)


@query
def data_alerts(spark, folder):
    """Rules of the report that fail, and forecasts that are off by more than a twentieth."""
    status = models.evaluate(forecast_seasonal_naive(spark, folder), "seasonal_naive")
    return alerts.data_alerts(dq_report(spark, folder)).unionByName(alerts.accuracy_alerts(status, 5.0, 0.6))

"""Check SQL for DuckDB: each registered query again, from the raw tables, with money as integer cents.

Written apart from the operators, in plain SQL over whole tables. Aliases and types equal the queries':
dates as ISO text, sums and averages as doubles, counts as BIGINT.
"""

from __future__ import annotations

import math

# Rounding half up on integers: (2a + b) // 2b. All amounts in the tables are positive.
STAR = """
WITH items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS tc,
         CAST(round(l_discount * 100) AS BIGINT) AS dc,
         CAST(round(l_tax * 100) AS BIGINT) AS xc,
         l_shipdate AS ship_date
  FROM lineitem),
prod0 AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS brand,
         CAST(round(p_retailprice * 100) AS BIGINT) AS pc, p_size, p_partkey % 10 <> 0 AS is_active
  FROM part),
prod1 AS (SELECT *, (pc * (40 + p_size) + 50) // 100 AS cc FROM prod0),
prod AS (SELECT *, (20000 * (pc - cc) + pc) // (2 * pc) AS mc FROM prod1),
cust AS (
  SELECT c_custkey AS customer_id, c_name AS name, n_name AS state, r_name AS country,
         c_mktsegment AS customer_segment,
         DATE '1994-07-01' + CAST((c_custkey * 37) % 1500 AS INT) AS reg
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ord AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS d,
         o_orderdate AS order_date,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Cancelled'
              ELSE o_orderstatus END AS order_status,
         o_orderpriority AS payment_method, CAST(round(o_totalprice * 100) AS BIGINT) AS oc
  FROM orders),
tax AS (SELECT order_id, (2 * sum(tc * xc) + 100) // 200 AS xt FROM items GROUP BY order_id),
sales AS (
  SELECT i.*, ord.customer_id, ord.d, ord.order_date, ord.order_status, cust.reg,
         prod.pc, prod.cc, prod.mc, prod.category,
         (2 * i.tc * cc + pc) // (2 * pc) AS cost,
         (2 * i.tc * (pc - cc) + pc) // (2 * pc) AS profit,
         (2 * i.tc * i.dc + 100) // 200 AS discount
  FROM items i JOIN ord USING (order_id) JOIN cust USING (customer_id) JOIN prod USING (product_id)),
per_customer AS (
  SELECT customer_id, count(DISTINCT order_id) AS orders, count(*) AS lines, sum(tc) AS tc,
         sum(profit) AS profit, min(d) AS first_day, max(d) AS last_day
  FROM sales GROUP BY customer_id),
per_product AS (
  SELECT product_id, sum(tc) AS tc, sum(profit) AS profit, sum(quantity) AS quantity,
         count(DISTINCT order_id) AS orders, sum(mc) AS mc, count(*) AS lines, max(d) AS last_day
  FROM sales GROUP BY product_id),
calendar AS (
  SELECT CAST(unnest(generate_series((SELECT min(d) FROM ord), (SELECT max(d) FROM ord), INTERVAL 1 DAY)) AS DATE) AS d)
"""


def _iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def _ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def _usd(cents: str) -> str:
    return f"(CAST({cents} AS DOUBLE) / 100)"


def _int(c: str) -> str:
    return f"CAST({c} AS BIGINT)"


_DAILY = f"""
  SELECT d, count(DISTINCT order_id) AS o, sum(tc) AS tc, sum(profit) AS profit, count(*) AS n,
         count(DISTINCT customer_id) AS c,
         count(DISTINCT CASE WHEN reg = d THEN customer_id END) AS new_c,
         count(DISTINCT CASE WHEN reg < d THEN customer_id END) AS rep_c
  FROM sales GROUP BY d"""

_DAILY_OUT = f"""
  SELECT {_iso('d')} AS date, o AS total_orders, {_usd('tc')} AS total_revenue, {_usd('profit')} AS total_profit,
         {_usd('tc')} / n AS avg_line_value, {_usd('tc')} / o AS avg_order_value,
         c AS total_customers, new_c AS new_customers, rep_c AS repeat_customers"""


def _trend(unit: str) -> str:
    return STAR + f""", t AS (
  SELECT CAST(date_trunc('{unit}', d) AS DATE) AS p, count(DISTINCT order_id) AS o,
         count(DISTINCT customer_id) AS c, sum(tc) AS tc FROM sales GROUP BY p)
SELECT {_iso('p')} AS period, {_usd('tc')} AS revenue, o AS orders, c AS customers,
       {_usd('tc')} / o AS avg_order_value FROM t"""


def _summary(where: str) -> str:
    return STAR + f""", t AS (SELECT * FROM sales {where}),
days AS (SELECT d, count(DISTINCT customer_id) AS c FROM t GROUP BY d)
SELECT {_usd('sum(tc)')} AS total_revenue, count(DISTINCT order_id) AS total_orders,
       count(DISTINCT customer_id) AS total_customers,
       (SELECT {_int('sum(c)')} FROM days) AS customer_days,
       {_usd('sum(tc)')} / count(DISTINCT order_id) AS avg_order_value FROM t"""


_RFM = STAR + """, rfm AS (
  SELECT *, DATE '2001-08-02' - last_day AS recency FROM per_customer),
scored AS (
  SELECT *, ntile(5) OVER (ORDER BY recency DESC, customer_id) AS r,
         ntile(5) OVER (ORDER BY orders, customer_id) AS f,
         ntile(5) OVER (ORDER BY tc, customer_id) AS m,
         CAST(profit AS DOUBLE) / 100 / greatest(DATE '2001-08-02' - first_day, 30) * 365.0::DOUBLE AS ltv
  FROM rfm),
seg AS (
  SELECT *, CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champions'
                 WHEN r <= 2 AND f >= 4 AND m >= 4 THEN 'Cannot Lose Them'
                 WHEN f >= 4 THEN 'Loyal Customers'
                 WHEN r >= 4 AND f <= 2 THEN 'New Customers'
                 WHEN r <= 2 THEN 'At Risk' ELSE 'Regular' END AS segment
  FROM scored)
"""

_SNAPSHOTS = STAR + """, snap AS (
  SELECT product_id, CAST(date_trunc('quarter', d) AS DATE) AS q,
         max((2 * tc + quantity) // (2 * quantity)) AS u
  FROM items JOIN ord USING (order_id) GROUP BY ALL),
banded AS (SELECT product_id, q, CASE WHEN u < 500000 THEN 'low' WHEN u < 2000000 THEN 'middle' ELSE 'high' END AS band
  FROM snap),
marked AS (SELECT *, lag(band) OVER (PARTITION BY product_id ORDER BY q) AS before FROM banded),
versions AS (
  SELECT product_id, band, q, lead(q) OVER (PARTITION BY product_id ORDER BY q) AS until
  FROM marked WHERE before IS DISTINCT FROM band)
"""

_DAYS = STAR + """, daily AS (
  SELECT d, coalesce(tc, 0) AS tc FROM calendar LEFT JOIN (SELECT d, sum(tc) AS tc FROM sales GROUP BY d) USING (d))
"""

_MONTHS = STAR + """, monthly AS (SELECT CAST(date_trunc('month', d) AS DATE) AS p, sum(tc) AS tc FROM sales GROUP BY p)
"""

_NAIVE = _MONTHS + """, ahead AS (
  SELECT CAST(unnest(generate_series((SELECT min(p) FROM monthly),
    (SELECT max(p) FROM monthly) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS DATE) AS p),
naive AS (
  SELECT ahead.p, a.tc AS actual, f.tc AS forecast FROM ahead LEFT JOIN monthly a ON a.p = ahead.p
  JOIN monthly f ON f.p + INTERVAL 12 MONTH = ahead.p)
"""

_EVENTS = """
WITH ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS vc, value,
         'src' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 4 AS VARCHAR) AS source
  FROM events)
"""

_FUNNEL = _EVENTS + """, funnel AS (
  SELECT CAST(ts AS DATE) AS d,
    count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c,
    count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS p,
    count(DISTINCT user_id) FILTER (event_type = 'view') AS vu, count(DISTINCT user_id) FILTER (event_type = 'click') AS cu,
    count(DISTINCT user_id) FILTER (event_type = 'signup') AS su, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS pu
  FROM ev GROUP BY d)
"""

_BASKET = STAR + """, anchors AS (SELECT product_id AS anchor_id FROM per_product ORDER BY tc DESC, product_id LIMIT 20),
basket AS (SELECT DISTINCT order_id, product_id FROM sales),
pairs AS (
  SELECT h.product_id AS anchor_id, b.product_id, count(*) AS n
  FROM basket h JOIN anchors ON h.product_id = anchor_id JOIN basket b ON b.order_id = h.order_id AND b.product_id <> h.product_id
  GROUP BY ALL)
"""

_SESSIONS = _EVENTS + """, marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ev),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked),
visits AS (
  SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n, sum(vc) AS vc
  FROM numbered GROUP BY user_id, s)
"""

_HOURLY = _EVENTS + """, hourly AS (
  SELECT date_trunc('hour', ts) AS a, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS p,
         count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'error') AS e,
         coalesce(sum(vc) FILTER (event_type = 'purchase'), 0) AS pv
  FROM ev GROUP BY a),
done AS (SELECT *, a + INTERVAL 1 HOUR AS b FROM hourly)
"""


def _dup(table: str, sql_table: str, key: str, name: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{name}' AS key_name, {_int('coalesce(sum(n), 0)')} AS checked,
  {_int('coalesce(sum(n) FILTER (k IS NULL), 0)')} AS null_keys,
  count(*) FILTER (k IS NOT NULL AND n > 1) AS duplicate_keys,
  {_int('coalesce(sum(n - 1) FILTER (k IS NOT NULL), 0)')} AS surplus_rows
  FROM (SELECT {key} AS k, count(*) AS n FROM {sql_table} GROUP BY k)"""


def _orphan(name: str, child: str, ck: str, parent: str, pk: str) -> str:
    return f"""SELECT '{name}' AS relation, count(*) AS checked,
  count(*) FILTER ({ck} NOT IN (SELECT {pk} FROM {parent})) AS orphans FROM {child} WHERE {ck} IS NOT NULL"""


def _rule(name: str, table: str, broken: str) -> str:
    return f"SELECT '{name}' AS rule, count(*) AS checked, count(*) FILTER ({broken}) AS failed FROM {table}"


def _nulls(table: str, source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{name}' AS column_name, count(*) AS checked,
  count(*) FILTER (({expr}) IS NULL) AS nulls,
  CAST(count(*) FILTER (({expr}) IS NULL) AS DOUBLE) / count(*) AS null_ratio FROM {source}"""
        for name, expr in columns.items()
    )


_PAIRS = STAR + """, basket AS (SELECT DISTINCT order_id, product_id FROM sales),
total AS (SELECT count(DISTINCT order_id) AS n FROM basket),
pairs AS (
  SELECT x.product_id AS a, y.product_id AS b, count(*) AS c
  FROM basket x JOIN basket y ON x.order_id = y.order_id AND x.product_id < y.product_id
  GROUP BY ALL HAVING count(*) >= (SELECT ceil(0.0001::DOUBLE * n) FROM total))
"""

_CATEGORY_DAYS = STAR + """, c AS (SELECT category, d, sum(tc) AS tc FROM sales GROUP BY ALL),
every AS (
  SELECT k.category, CAST(t.d AS DATE) AS d FROM (SELECT DISTINCT category FROM c) k,
    (SELECT unnest(generate_series((SELECT min(d) FROM c), (SELECT max(d) FROM c), INTERVAL 1 DAY)) AS d) t),
series AS (SELECT e.category, e.d, coalesce(c.tc, 0) AS tc FROM every e LEFT JOIN c ON c.category = e.category AND c.d = e.d)
"""

_LAGS = _CATEGORY_DAYS + """, l AS (
  SELECT category, d, CAST(tc AS DOUBLE) / 100 AS x, CAST(lag(tc, 1) OVER w AS DOUBLE) / 100 AS lag_1,
    CAST(lag(tc, 7) OVER w AS DOUBLE) / 100 AS lag_7, CAST(lag(tc, 28) OVER w AS DOUBLE) / 100 AS lag_28
  FROM series WINDOW w AS (PARTITION BY category ORDER BY d)),
folds AS (SELECT CAST(k AS INT) AS k, DATE '2000-01-01' + CAST(90 * k AS INT) AS origin FROM range(0, 4) AS r(k))
"""


def _churn(cut: str) -> str:
    return STAR + f""", c AS (
  SELECT customer_id, count(DISTINCT order_id) AS f, sum(tc) AS tc, max(d) AS l, min(d) AS e
  FROM sales WHERE d < DATE '{cut}' GROUP BY customer_id),
later AS (SELECT DISTINCT customer_id FROM sales WHERE d >= DATE '{cut}' AND d < DATE '{cut}' + 180)
SELECT customer_id, f AS frequency, {_usd('tc')} AS monetary, CAST(DATE '{cut}' - l AS INT) AS recency_days,
  CAST(DATE '{cut}' - e AS INT) AS tenure_days,
  CASE WHEN customer_id IN (SELECT customer_id FROM later) THEN 0 ELSE 1 END AS churned FROM c"""


def _additive() -> str:
    """Least squares again: whole-number sums, then the elimination as a fold over the diagonal."""

    def basis(day: str) -> list[str]:
        t = f"({day} - DATE '1995-01-01')"
        waves = [(365.25, k) for k in (1, 2)] + [(7.0, k) for k in (1, 2, 3)]
        out = ["CAST(1000000 AS BIGINT)", f"CAST({t} * 1000 AS BIGINT)"]
        for period, k in waves:
            turn = f"CAST({t} AS DOUBLE) * {2 * math.pi * k / period!r}::DOUBLE"
            out += [f"CAST(round({fn}({turn}) * 1000000) AS BIGINT)" for fn in ("sin", "cos")]
        return out

    n = len(basis("d"))
    x = ", ".join(f"{b} AS x{i}" for i, b in enumerate(basis("d")))
    rows = ", ".join(
        "[" + ", ".join(f"CAST(sum(CAST(x{min(i, j)} AS HUGEINT) * x{max(i, j)}) AS DOUBLE) / 1e12::DOUBLE" for j in range(n))
        + f", CAST(sum(CAST(x{i} AS HUGEINT) * tc) AS DOUBLE) / 1e6::DOUBLE]"
        for i in range(n)
    )
    terms = " + ".join(f"w[{i + 1}] * CAST({b} AS DOUBLE) / 1e6::DOUBLE" for i, b in enumerate(basis("day")))
    return _CATEGORY_DAYS + f""", based AS (SELECT category, d, tc, {x} FROM series),
equations AS (SELECT category, max(d) AS last, [{rows}] AS m FROM based GROUP BY category),
reduced AS (
  SELECT category, last, list_reduce(
    list_concat([{{'m': m, 'k': CAST(0 AS BIGINT)}}], list_transform(range(1, {n + 1}), lambda k: {{'m': m, 'k': k}})),
    lambda a, b: {{'m': list_transform(a.m, lambda r, i: CASE WHEN i = b.k
        THEN list_transform(r, lambda v: v * (1::DOUBLE / a.m[b.k][b.k]))
        ELSE list_transform(r, lambda v, j: v - r[b.k] * (1::DOUBLE / a.m[b.k][b.k]) * a.m[b.k][j]) END), 'k': b.k}}).m AS m
  FROM equations),
weights AS (SELECT category, last, list_transform(m, lambda r: r[{n + 1}]) AS w FROM reduced),
ahead AS (SELECT category, w, last + CAST(s AS INT) AS day FROM weights, range(1, 29) AS r(s))
SELECT category, {_iso('day')} AS date, CAST(CAST(({terms}) / 100 AS DECIMAL(18,2)) AS DOUBLE) AS forecast FROM ahead"""


def _union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


_DUPLICATES = _union(
    _dup("customers", "customer", "c_custkey", "customer_id"),
    _dup("products", "part", "p_partkey", "product_id"),
    _dup("orders", "orders", "o_orderkey", "order_id"),
    _dup("events", "events", "event_id", "event_id"),
)
_ORPHANS = _union(
    _orphan("orders.customer", "orders", "o_custkey", "customer", "c_custkey"),
    _orphan("order_items.order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    _orphan("order_items.product", "lineitem", "l_partkey", "part", "p_partkey"),
    _orphan("orders.has_items", "orders", "o_orderkey", "lineitem", "l_orderkey"),
    _orphan("events.user", "events", "user_id", "customer", "c_custkey"),
)
_DOMAIN = _union(
    _rule("orders.status_known", "orders", "o_orderstatus NOT IN ('F', 'O', 'P')"),
    _rule("orders.total_not_negative", "orders", "o_totalprice < 0"),
    _rule("orders.shipping_not_negative", "orders", "5 + o_orderkey % 20 < 0"),
    _rule("orders.currency_three_letters", "orders", "length('USD') <> 3"),
    _rule("order_items.quantity_positive", "lineitem", "l_quantity <= 0"),
    _rule("order_items.total_not_negative", "lineitem", "l_extendedprice < 0"),
    _rule("order_items.discount_in_percent", "lineitem", "l_discount < 0 OR l_discount > 1"),
    _rule("products.price_positive", "part", "p_retailprice <= 0"),
    _rule("products.margin_fits", "part", "abs(60.0 - p_size) >= 1000"),
)
_COMPLETENESS = _union(
    _nulls(
        "customers",
        "customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
        {
            "customer_id": "c_custkey",
            "name": "c_name",
            "state": "n_name",
            "country": "r_name",
            "customer_segment": "c_mktsegment",
            "registration_date": "c_custkey",
        },
    ),
    _nulls(
        "products",
        "part",
        {
            "product_id": "p_partkey",
            "product_name": "p_name",
            "category": "p_type",
            "brand": "p_brand",
            "price": "p_retailprice",
            "cost": "p_retailprice * p_size",
            "is_active": "p_partkey",
            "created_at": "NULL",
        },
    ),
    _nulls(
        "orders",
        "orders",
        {
            "order_id": "o_orderkey",
            "customer_id": "o_custkey",
            "order_date": "o_orderdate",
            "order_status": "o_orderstatus",
            "payment_method": "o_orderpriority",
            "total_amount": "o_totalprice",
            "shipping_cost": "o_orderkey",
            "currency": "'USD'",
        },
    ),
    _nulls(
        "order_items",
        "lineitem",
        {
            "order_id": "l_orderkey",
            "product_id": "l_partkey",
            "quantity": "l_quantity",
            "unit_price": "l_extendedprice / nullif(l_quantity, 0)",
            "total_price": "l_extendedprice",
            "discount_percentage": "l_discount",
            "ship_date": "l_shipdate",
        },
    ),
)
_CONSISTENCY = _union(
    _rule(
        "order_items.shipped_after_order",
        "lineitem JOIN orders ON l_orderkey = o_orderkey",
        "l_shipdate < o_orderdate",
    ),
    _rule(
        "orders.total_is_sum_of_items",
        """(SELECT o_orderkey, any_value(CAST(round(o_totalprice * 100) AS BIGINT)) AS oc,
            sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS tc
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey)""",
        "oc <> tc",
    ),
    _rule(
        "orders.customer_registered_before",
        "orders JOIN customer ON o_custkey = c_custkey",
        "CAST(o_orderdate AS DATE) < DATE '1994-07-01' + CAST((c_custkey * 37) % 1500 AS INT)",
    ),
)


def _fresh(table: str, source: str, expr: str) -> str:
    return f"""SELECT '{table}' AS table_name, {_iso('x')} AS newest, CAST(DATE '2001-08-02' - x AS INT) AS age_days,
  DATE '2001-08-02' - x <= 7 AS fresh FROM (SELECT CAST(max({expr}) AS DATE) AS x FROM {source})"""


_FRESHNESS = _union(
    _fresh("orders", "orders", "o_orderdate"),
    _fresh("order_items", "lineitem", "l_shipdate"),
    _fresh("customers", "customer", "DATE '1994-07-01' + CAST((c_custkey * 37) % 1500 AS INT)"),
)

_REPORT = f"""SELECT rule, checked, failed, failed = 0 AS passed FROM (
SELECT 'overview.' || what AS rule, checked, CASE WHEN checked = 0 THEN 1 ELSE 0 END AS failed FROM (
  UNPIVOT (SELECT count(*) AS total_records, count(DISTINCT o_custkey) AS unique_customers,
    (SELECT count(DISTINCT l_partkey) FROM lineitem) AS unique_products, count(DISTINCT o_orderkey) AS unique_orders FROM orders)
  ON total_records, unique_customers, unique_products, unique_orders INTO NAME what VALUE checked)
UNION ALL SELECT 'unique.' || table_name || '.' || key_name AS rule, checked, null_keys + surplus_rows AS failed FROM ({_DUPLICATES})
UNION ALL SELECT 'parent.' || relation, checked, orphans FROM ({_ORPHANS})
UNION ALL SELECT rule, checked, failed FROM ({_DOMAIN})
UNION ALL SELECT rule, checked, failed FROM ({_CONSISTENCY})
UNION ALL SELECT 'not_null.' || table_name || '.' || column_name, checked, nulls FROM ({_COMPLETENESS})
UNION ALL SELECT 'fresh.' || table_name, CAST(1 AS BIGINT), CASE WHEN fresh THEN 0 ELSE 1 END FROM ({_FRESHNESS}))"""

_SQL = {
    # star
    "dim_date": STAR + f"""SELECT CAST(epoch(d) AS INT) AS date_key, {_iso('d')} AS full_date,
  CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month,
  monthname(d) AS month_name, CAST(day(d) AS INT) AS day, dayname(d) AS day_name,
  CAST(week(d) AS INT) AS week_of_year, dayofweek(d) IN (0, 6) AS is_weekend, FALSE AS is_holiday,
  CAST(NULL AS VARCHAR) AS holiday_name FROM calendar""",
    "dim_customers": STAR + f"""SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id, name,
  state, country, customer_segment, {_iso('reg')} AS registration_date, TRUE AS is_active,
  {_iso('reg')} AS effective_date, CAST(NULL AS VARCHAR) AS expiry_date, TRUE AS current_flag FROM cust""",
    "dim_products": STAR + f"""SELECT row_number() OVER (ORDER BY product_id) AS product_key, product_id, product_name,
  category, brand, {_usd('pc')} AS price, {_usd('cc')} AS cost, {_usd('mc')} AS margin_percentage, is_active,
  '2001-08-02' AS effective_date, CAST(NULL AS VARCHAR) AS expiry_date, TRUE AS current_flag FROM prod""",
    "fact_sales": STAR + f""", ck AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) AS customer_key FROM cust),
pk AS (SELECT product_id, row_number() OVER (ORDER BY product_id) AS product_key FROM prod)
SELECT order_id, customer_key, product_key, CAST(epoch(d) AS INT) AS date_key, quantity,
  {_usd('(2 * tc + quantity) // (2 * quantity)')} AS unit_price, {_usd('tc')} AS total_amount,
  {_usd('cost')} AS cost_amount, {_usd('profit')} AS profit_amount, {_usd('mc')} AS margin_percentage,
  {_usd('discount')} AS discount_amount, {_usd('xt')} AS tax_amount,
  CAST(5 + order_id % 20 AS DOUBLE) AS shipping_cost, {_ts('order_date')} AS order_date
FROM sales JOIN ck USING (customer_id) JOIN pk USING (product_id) JOIN tax USING (order_id)""",
    "insert_ignore_customers": STAR + f"""SELECT customer_id,
  CASE WHEN reg < DATE '1997-01-01' THEN 'KNOWN' ELSE customer_segment END AS customer_segment,
  {_iso('reg')} AS registration_date FROM cust""",
    "upsert_daily_sales": STAR + f""", old AS ({_DAILY.replace('FROM sales', "FROM sales WHERE order_status = 'Completed'")}),
new AS ({_DAILY}),
j AS (SELECT new.d, new.o, new.tc, new.n, old.o AS old_o,
  CASE WHEN old.d IS NULL THEN new.profit ELSE old.profit END AS profit,
  CASE WHEN old.d IS NULL THEN {_usd('new.tc')} / new.n ELSE {_usd('old.tc')} / old.n END AS avg_line_value,
  CASE WHEN old.d IS NULL THEN {_usd('new.tc')} / new.o ELSE {_usd('old.tc')} / old.o END AS avg_order_value,
  CASE WHEN old.d IS NULL THEN new.c ELSE old.c END AS c,
  CASE WHEN old.d IS NULL THEN new.new_c ELSE old.new_c END AS new_c,
  CASE WHEN old.d IS NULL THEN new.rep_c ELSE old.rep_c END AS rep_c
  FROM new LEFT JOIN old ON old.d = new.d)
SELECT {_iso('d')} AS date, o AS total_orders, {_usd('tc')} AS total_revenue, {_usd('profit')} AS total_profit,
  avg_line_value, avg_order_value, c AS total_customers, new_c AS new_customers, rep_c AS repeat_customers,
  old_o AS first_total_orders FROM j""",
    "upsert_partitioned_daily": STAR + f""", old AS ({_DAILY.replace('FROM sales', "FROM sales WHERE order_status = 'Completed'")}),
new AS (SELECT * FROM ({_DAILY}) WHERE d BETWEEN DATE '1998-04-10' AND DATE '1998-06-20'),
j AS (SELECT coalesce(old.d, new.d) AS d, coalesce(new.o, old.o) AS o, coalesce(new.tc, old.tc) AS tc, old.o AS old_o,
  CASE WHEN old.d IS NULL THEN new.profit ELSE old.profit END AS profit,
  CASE WHEN old.d IS NULL THEN {_usd('new.tc')} / new.n ELSE {_usd('old.tc')} / old.n END AS avg_line_value,
  CASE WHEN old.d IS NULL THEN {_usd('new.tc')} / new.o ELSE {_usd('old.tc')} / old.o END AS avg_order_value,
  CASE WHEN old.d IS NULL THEN new.c ELSE old.c END AS c,
  CASE WHEN old.d IS NULL THEN new.new_c ELSE old.new_c END AS new_c,
  CASE WHEN old.d IS NULL THEN new.rep_c ELSE old.rep_c END AS rep_c
  FROM old FULL JOIN new ON old.d = new.d)
SELECT {_iso('d')} AS date, o AS total_orders, {_usd('tc')} AS total_revenue, {_usd('profit')} AS total_profit,
  avg_line_value, avg_order_value, c AS total_customers, new_c AS new_customers, rep_c AS repeat_customers,
  old_o AS first_total_orders FROM j""",
    "scd2_products": _SNAPSHOTS + f"""SELECT product_id, band AS price_band, {_iso('q')} AS effective_date,
  {_iso('until')} AS expiry_date, until IS NULL AS current_flag FROM versions""",
    "fact_point_in_time": _SNAPSHOTS + f"""SELECT s.order_id, s.product_id, {_iso('s.d')} AS order_day, {_usd('s.tc')} AS total_amount,
  v.band AS price_band, {_iso('v.q')} AS effective_date
FROM sales s JOIN versions v ON s.product_id = v.product_id AND s.d >= v.q AND (v.until IS NULL OR s.d < v.until)""",
    "allocated_tax": STAR + f""", run AS (
  SELECT order_id, product_id, tc, xt, sum(tc) OVER (PARTITION BY order_id) AS ot,
    sum(tc) OVER (PARTITION BY order_id ORDER BY product_id, tc ROWS UNBOUNDED PRECEDING) AS upto
  FROM sales JOIN tax USING (order_id))
SELECT order_id, product_id, {_usd('tc')} AS total_amount, {_usd('xt')} AS tax_amount,
  {_usd('(2 * xt * upto + ot) // (2 * ot) - (2 * xt * (upto - tc) + ot) // (2 * ot)')} AS allocated_tax FROM run""",
    "allocated_shipping": STAR + f""", run AS (
  SELECT order_id, product_id, tc, 100 * (5 + order_id % 20) AS sc, sum(tc) OVER (PARTITION BY order_id) AS ot,
    sum(tc) OVER (PARTITION BY order_id ORDER BY product_id, tc ROWS UNBOUNDED PRECEDING) AS upto FROM sales)
SELECT order_id, product_id, {_usd('tc')} AS total_amount, {_usd('sc')} AS shipping_cost,
  {_usd('(2 * sc * upto + ot) // (2 * ot) - (2 * sc * (upto - tc) + ot) // (2 * ot)')} AS allocated_shipping FROM run""",
    "allocated_tax_by_order": STAR + f"""SELECT order_id, {_usd('any_value(xt)')} AS tax_amount, {_usd('any_value(xt)')} AS allocated
FROM sales JOIN tax USING (order_id) GROUP BY order_id""",
    # summaries
    "daily_sales_summary": STAR + f", t AS ({_DAILY}) {_DAILY_OUT} FROM t",
    "monthly_sales_trend": STAR + f"""SELECT CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, monthname(d) AS month_name,
  count(DISTINCT order_id) AS total_orders, {_usd('sum(tc)')} AS total_revenue, {_usd('sum(profit)')} AS total_profit,
  {_usd('sum(tc)')} / count(*) AS avg_line_value FROM sales GROUP BY ALL""",
    "sales_trend_daily": _trend("day"),
    "sales_trend_weekly": _trend("week"),
    "sales_trend_monthly": _trend("month"),
    "sales_trend_quarterly": _trend("quarter"),
    "sales_trend_yearly": _trend("year"),
    "first_30_days": _trend("day") + " ORDER BY p LIMIT 30",
    "sales_in_range": _trend("day") + " WHERE p BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'",
    "sales_summary": _summary(""),
    "sales_summary_completed": _summary("WHERE order_status = 'Completed'"),
    "kpi_status_bands": STAR + f""", k AS (
  SELECT 'revenue' AS kpi, {_usd('sum(tc)')} AS value, 10000 AS lo, 50000 AS hi FROM sales
  UNION ALL SELECT 'orders', CAST(count(DISTINCT order_id) AS DOUBLE), 100, 500 FROM sales
  UNION ALL SELECT 'customers', CAST(count(DISTINCT customer_id) AS DOUBLE), 50, 200 FROM sales)
SELECT kpi, value, CASE WHEN value >= hi THEN 'green' WHEN value >= lo THEN 'yellow' ELSE 'red' END AS status FROM k""",
    "formatted_kpis": STAR + f"""SELECT '$' || format('{{:,.2f}}', {_usd('sum(tc)')}) AS revenue,
  format('{{:,}}', count(DISTINCT order_id)) AS orders, format('{{:,}}', count(DISTINCT customer_id)) AS customers,
  '$' || format('{{:,.2f}}', {_usd('sum(tc)')} / count(DISTINCT order_id)) AS avg_order_value FROM sales""",
    "orders_by_status": STAR + f"""SELECT order_status, payment_method, count(*) AS orders, {_usd('sum(oc)')} AS amount
FROM ord GROUP BY ALL""",
    "sales_by_geography": STAR + f"""SELECT CASE WHEN grouping(country) = 1 THEN 'ALL' ELSE country END AS country,
  CASE WHEN grouping(state) = 1 THEN 'ALL' ELSE state END AS state, {_usd('sum(tc)')} AS revenue,
  count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers
FROM sales JOIN cust USING (customer_id) GROUP BY ROLLUP (country, state)""",
    "basket_size_distribution": STAR + f""", b AS (SELECT order_id, count(*) AS items, sum(quantity) AS q FROM sales GROUP BY order_id)
SELECT items, count(*) AS orders, {_int('sum(q)')} AS total_quantity, CAST(sum(q) AS DOUBLE) / count(*) AS avg_quantity
FROM b GROUP BY items""",
    # products
    "product_performance": STAR + f"""SELECT product_id, product_name, category, {_usd('tc')} AS total_sales,
  {_int('quantity')} AS total_quantity, orders AS total_orders, {_usd('p.mc')} / lines AS profit_margin,
  {_iso('last_day')} AS last_sale_date FROM per_product p JOIN prod USING (product_id)""",
    "top_products": STAR + f"""SELECT product_id, product_name, category, brand, {_usd('tc')} AS total_revenue,
  {_int('quantity')} AS total_quantity, orders AS total_orders, {_usd('p.mc')} / lines AS avg_margin
FROM per_product p JOIN prod USING (product_id)""",
    "top10_products": STAR + f"""SELECT product_id, product_name, category, brand, {_usd('tc')} AS revenue,
  {_int('quantity')} AS quantity, orders, {_usd('profit')} AS profit
FROM per_product JOIN prod USING (product_id) ORDER BY tc DESC, product_id LIMIT 10""",
    "json_top_products": STAR + """, t AS (SELECT * FROM per_product JOIN prod USING (product_id) ORDER BY tc DESC, product_id LIMIT 10)
SELECT '{"product_id":' || product_id || ',"product_name":"' || product_name || '","category":"' || category
  || '","brand":"' || brand || '","revenue":' || printf('%d.%02d', CAST(tc // 100 AS BIGINT), CAST(tc % 100 AS BIGINT))
  || ',"quantity":' || quantity || ',"orders":' || orders
  || ',"profit":' || printf('%d.%02d', CAST(profit // 100 AS BIGINT), CAST(profit % 100 AS BIGINT)) || '}' AS json FROM t""",
    "top_products_per_category": STAR + f""", r AS (
  SELECT category, product_id, product_name, profit,
    row_number() OVER (PARTITION BY category ORDER BY profit DESC, product_id) AS n
  FROM per_product JOIN prod USING (product_id))
SELECT category, CAST(n AS INT) AS rank, product_id, product_name, {_usd('profit')} AS metric_value FROM r WHERE n <= 3""",
    "slow_movers": STAR + f"""SELECT product_id, product_name, category, {_usd('coalesce(tc, 0)')} AS revenue,
  {_int('coalesce(quantity, 0)')} AS quantity
FROM prod LEFT JOIN per_product USING (product_id) ORDER BY coalesce(tc, 0), product_id LIMIT 20""",
    "revenue_by_category": STAR + f""", c AS (SELECT category, sum(tc) AS tc FROM sales GROUP BY category)
SELECT category, {_usd('tc')} AS revenue, {_usd('tc')} / {_usd('sum(tc) OVER ()')} AS share FROM c""",
    "sales_by_selected_categories": STAR + f""", c AS (
  SELECT category, sum(tc) AS tc FROM sales WHERE category IN ('ECONOMY', 'SMALL') GROUP BY category)
SELECT category, {_usd('tc')} AS revenue, {_usd('tc')} / {_usd('sum(tc) OVER ()')} AS share FROM c""",
    "abc_products": STAR + f""", c AS (
  SELECT *, sum(tc) OVER (ORDER BY tc DESC, product_id ROWS UNBOUNDED PRECEDING) AS cum, sum(tc) OVER () AS t FROM per_product)
SELECT product_id, {_usd('tc')} AS revenue, {_usd('cum')} / {_usd('t')} AS cumulative_share,
  CASE WHEN cum * 100 <= t * 80 THEN 'A' WHEN cum * 100 <= t * 95 THEN 'B' ELSE 'C' END AS abc_class, category
FROM c JOIN prod USING (product_id)""",
    "best_seller_companions": _BASKET + "SELECT anchor_id, product_id, n AS orders_together FROM pairs",
    "best_seller_recommendations": _BASKET + """, single AS (SELECT product_id, count(*) AS n FROM basket GROUP BY product_id),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY n DESC, product_id) AS rank FROM pairs),
t AS (SELECT CAST(count(DISTINCT order_id) AS DOUBLE) AS t FROM basket)
SELECT r.anchor_id, CAST(rank AS INT) AS rank, r.product_id, r.n AS orders_together, r.n / t AS support,
  CAST(r.n AS DOUBLE) / a.n AS confidence,
  CAST(r.n AS DOUBLE) * t / (CAST(a.n AS DOUBLE) * CAST(p.n AS DOUBLE)) AS lift
FROM r JOIN single a ON a.product_id = r.anchor_id JOIN single p ON p.product_id = r.product_id, t WHERE rank <= 5""",
    # trends
    "monthly_growth": _MONTHS + f""", g AS (SELECT p, tc, lag(tc) OVER (ORDER BY p) AS b FROM monthly)
SELECT {_iso('p')} AS period, {_usd('tc')} AS revenue, {_usd('b')} AS previous_revenue,
  ({_usd('tc')} - {_usd('b')}) / {_usd('b')} AS growth FROM g""",
    "moving_average_revenue": _DAYS + f"""SELECT {_iso('d')} AS date, {_usd('tc')} AS revenue,
  {_usd('sum(tc) OVER s')} / count(*) OVER s AS avg_7d, {_usd('sum(tc) OVER l')} / count(*) OVER l AS avg_28d
FROM daily WINDOW s AS (ORDER BY d ROWS 6 PRECEDING), l AS (ORDER BY d ROWS 27 PRECEDING)""",
    "running_revenue": _DAYS + f"""SELECT {_iso('d')} AS date, {_usd('tc')} AS revenue,
  {_usd('sum(tc) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)')} AS running_revenue FROM daily""",
    "forecast_seasonal_naive": _NAIVE + f"""SELECT {_iso('p')} AS period, {_usd('actual')} AS actual,
  {_usd('forecast')} AS forecast FROM naive""",
    "forecast_linear": _MONTHS + f""", x AS (SELECT p, CAST(tc AS DOUBLE) / 100 AS y, CAST(year(p) * 12 + month(p) AS DOUBLE) AS x FROM monthly),
f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i, max(p) AS last FROM x),
a AS (SELECT s, i, CAST(last + to_months(CAST(k AS INT)) AS DATE) AS p FROM f, range(1, 7) AS r(k))
SELECT {_iso('p')} AS period, CAST(CAST(s AS DECIMAL(18,2)) AS DOUBLE) AS monthly_change,
  CAST(CAST(i + s * (year(p) * 12 + month(p)) AS DECIMAL(18,2)) AS DOUBLE) AS forecast FROM a""",
    "forecast_error": _NAIVE + f"""SELECT 'seasonal_naive' AS model, count(*) AS periods,
  CAST(CAST(sqrt(CAST(sum(CAST(actual - forecast AS HUGEINT) * (actual - forecast)) AS DOUBLE) / 10000 / count(*)) AS DECIMAL(18,2)) AS DOUBLE) AS rmse,
  CAST(CAST({_usd('sum(abs(actual - forecast))')} / count(*) AS DECIMAL(18,2)) AS DOUBLE) AS mae,
  CAST(CAST(avg(CAST(abs(actual - forecast) AS DOUBLE) / actual) * 100 AS DECIMAL(18,4)) AS DOUBLE) AS mape
FROM naive WHERE actual IS NOT NULL""",
    "revenue_anomalies": STAR + f""", c AS (SELECT category, d, CAST(sum(tc) AS DOUBLE) / 100 AS x FROM sales GROUP BY ALL),
w AS (SELECT *, avg(x) OVER b AS m, stddev_samp(x) OVER b AS s, count(*) OVER b AS n FROM c
  WINDOW b AS (PARTITION BY category ORDER BY d RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT category, {_iso('d')} AS date, x AS revenue, n AS days_seen, coalesce(abs(x - m) > 3 * s, FALSE) AS is_anomaly FROM w""",
    "order_outliers": STAR + f""", h AS (
  SELECT customer_id, avg(CAST(oc AS DOUBLE) / 100) AS m, stddev_samp(CAST(oc AS DOUBLE) / 100) AS s, count(*) AS n
  FROM ord GROUP BY customer_id HAVING count(*) >= 5)
SELECT order_id, customer_id, {_usd('oc')} AS total_amount, n AS customer_orders
FROM ord JOIN h USING (customer_id) WHERE {_usd('oc')} > m + 2 * s""",
    # customers
    "customer_features": STAR + f"""SELECT customer_id, 'total_spent' AS feature_name, {_usd('tc')} AS feature_value FROM per_customer
UNION ALL SELECT customer_id, 'total_orders', CAST(orders AS DOUBLE) FROM per_customer
UNION ALL SELECT customer_id, 'avg_order_value', CAST(CAST({_usd('tc')} / lines AS DECIMAL(18,6)) AS DOUBLE) FROM per_customer""",
    "product_features": STAR + f"""SELECT product_id, 'total_sales' AS feature_name, {_usd('tc')} AS feature_value FROM per_product
UNION ALL SELECT product_id, 'total_quantity_sold', CAST(quantity AS DOUBLE) FROM per_product""",
    "customer_features_wide": STAR + f"""SELECT customer_id, {_usd('tc')} AS total_spent, CAST(orders AS DOUBLE) AS total_orders,
  CAST(CAST({_usd('tc')} / lines AS DECIMAL(18,6)) AS DOUBLE) AS avg_order_value FROM per_customer""",
    "rfm_values": _RFM + f"""SELECT customer_id, CAST(recency AS INT) AS recency_days, orders AS frequency, {_usd('tc')} AS monetary FROM rfm""",
    "rfm_scores": _RFM + f"""SELECT customer_id, CAST(recency AS INT) AS recency_days, orders AS frequency, {_usd('tc')} AS monetary,
  CAST(r AS INT) AS r_score, CAST(f AS INT) AS f_score, CAST(m AS INT) AS m_score FROM scored""",
    "customer_segments": _RFM + f"""SELECT customer_id, segment, {_usd('tc')} AS total_spent, orders AS total_orders,
  {_usd('tc')} / orders AS avg_order_value, {_iso('last_day')} AS last_order_date,
  CAST(recency AS INT) AS days_since_last_order, ltv AS lifetime_value FROM seg""",
    "customer_segment_summary": _RFM + f"""SELECT segment, count(*) AS count, {_usd('sum(tc)')} / count(*) AS avg_spent,
  CAST(sum(orders) AS DOUBLE) / count(*) AS avg_orders, {_usd('sum(tc)')} AS total_value FROM seg GROUP BY segment""",
    "customer_ltv": STAR + f"""SELECT customer_id, {_usd('profit')} AS profit_to_date,
  CAST(greatest(DATE '2001-08-02' - first_day, 30) AS INT) AS tenure_days,
  {_usd('profit')} / greatest(DATE '2001-08-02' - first_day, 30) * CAST(365 AS DOUBLE) AS lifetime_value FROM per_customer""",
    "recommend_new_checked": STAR + """SELECT customer_id,
  least(5, (SELECT count(DISTINCT product_id) FROM sales) - count(DISTINCT product_id)) AS recommended, CAST(0 AS BIGINT) AS bought_before
FROM sales GROUP BY customer_id""",
    "frequent_pairs": _PAIRS + "SELECT a AS product_id, b AS other_id, c AS orders FROM pairs",
    "association_rules": _PAIRS + """, both_ways AS (SELECT a, b, c FROM pairs UNION ALL SELECT b, a, c FROM pairs),
held AS (SELECT product_id, count(*) AS k FROM basket GROUP BY product_id)
SELECT a AS antecedent, b AS consequent, c AS orders, CAST(c AS DOUBLE) / n AS support,
  CAST(c AS DOUBLE) / x.k AS confidence, CAST(c AS DOUBLE) / x.k / (CAST(y.k AS DOUBLE) / n) AS lift
FROM both_ways JOIN held x ON x.product_id = a JOIN held y ON y.product_id = b, total
WHERE CAST(c AS DOUBLE) / x.k >= 0.05::DOUBLE""",
    "customers_by_range_sketch": STAR + f"""SELECT {_iso("date_trunc('quarter', d)")} AS quarter, category,
  count(DISTINCT customer_id) AS customers, TRUE AS within_bound FROM sales GROUP BY ALL""",
    "features_as_of": STAR + f""", per_day AS (SELECT customer_id, d, count(DISTINCT order_id) AS o, sum(tc) AS tc FROM sales GROUP BY ALL),
states AS (SELECT customer_id, d, sum(o) OVER w AS o, sum(tc) OVER w AS tc, min(d) OVER w AS f FROM per_day
  WINDOW w AS (PARTITION BY customer_id ORDER BY d)),
asked AS (SELECT customer_id, CAST(cut AS DATE) AS cut
  FROM cust, (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2001-07-01', INTERVAL 3 MONTH)) AS cut) q)
SELECT a.customer_id, {_iso('a.cut')} AS cut, {_iso('s.d')} AS known_on, {_int('s.o')} AS frequency, {_usd('s.tc')} AS monetary,
  {_iso('s.f')} AS first_day
FROM asked a ASOF LEFT JOIN states s ON a.customer_id = s.customer_id AND a.cut > s.d""",
    "forecast_folds": _LAGS + f""", members AS (
  SELECT f.k, CASE WHEN l.d < f.origin THEN 'train' ELSE 'test' END AS role, l.* FROM l, folds f
  WHERE l.lag_28 IS NOT NULL AND l.d < f.origin + 90)
SELECT k AS fold, role, count(*) AS rows, {_iso('min(d)')} AS first_day, {_iso('max(d)')} AS last_day,
  CAST(sum(CAST(x AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM members GROUP BY ALL""",
    "forecast_fold_errors": _LAGS + """, tested AS (
  SELECT f.k, l.* FROM l, folds f WHERE l.lag_28 IS NOT NULL AND l.d >= f.origin AND l.d < f.origin + 90),
long AS (
  SELECT k, 'lag_1' AS model, x, lag_1 AS y FROM tested UNION ALL SELECT k, 'lag_7', x, lag_7 FROM tested
  UNION ALL SELECT k, 'lag_28', x, lag_28 FROM tested),
m AS (SELECT k, model, CAST(round(x * 100) AS BIGINT) AS a, CAST(round((x - y) * 100) AS BIGINT) AS e FROM long)
SELECT k AS fold, model, count(*) AS periods,
  CAST(CAST(sqrt(CAST(sum(CAST(e AS HUGEINT) * e) AS DOUBLE) / 10000 / count(*)) AS DECIMAL(18,2)) AS DOUBLE) AS rmse,
  CAST(CAST(CAST(sum(abs(e)) AS DOUBLE) / 100 / count(*) AS DECIMAL(18,2)) AS DOUBLE) AS mae,
  CAST(CAST(CAST(sum(CAST(CAST(abs(e) AS DOUBLE) / 100 / (CAST(nullif(a, 0) AS DOUBLE) / 100) AS DECIMAL(18,8))) AS DOUBLE)
    / count(*) FILTER (a <> 0) * 100 AS DECIMAL(18,4)) AS DOUBLE) AS mape
FROM m GROUP BY k, model""",
    "forecast_additive": _additive(),
    "churn_labels_learnt": _churn("2000-08-07"),
    "churn_labels": _churn("2001-02-03"),
    "cohort_retention": STAR + f""", a AS (SELECT customer_id, CAST(date_trunc('month', d) AS DATE) AS m, sum(tc) AS tc FROM sales GROUP BY ALL),
f AS (SELECT customer_id, min(m) AS c FROM a GROUP BY customer_id)
SELECT {_iso('c')} AS cohort, CAST(date_diff('month', c, m) AS INT) AS months_since, count(*) AS customers,
  {_usd('sum(tc)')} AS revenue FROM a JOIN f USING (customer_id) GROUP BY c, m""",
    "feature_drift_psi": STAR + """, b AS (
  SELECT CAST(least(greatest(tc // 1000000, 0), 9) AS INT) AS bin, count(*) FILTER (d < DATE '2001-01-01') AS r,
    count(*) FILTER (d >= DATE '2001-01-01') AS c FROM sales GROUP BY bin),
s AS (SELECT *, greatest(CAST(r AS DOUBLE) / CAST(sum(r) OVER () AS DOUBLE), 1e-6) AS rs,
  greatest(CAST(c AS DOUBLE) / CAST(sum(c) OVER () AS DOUBLE), 1e-6) AS cs FROM b)
SELECT bin, r AS reference_rows, c AS current_rows,
  CAST(CAST((cs - rs) * ln(cs / rs) AS DECIMAL(18,8)) AS DOUBLE) AS psi FROM s""",
    "forecast_features": STAR + f""", c AS (SELECT category, d, sum(tc) AS tc FROM sales GROUP BY ALL),
every AS (
  SELECT k.category, CAST(t.d AS DATE) AS d FROM (SELECT DISTINCT category FROM c) k,
    (SELECT unnest(generate_series((SELECT min(d) FROM c), (SELECT max(d) FROM c), INTERVAL 1 DAY)) AS d) t),
f AS (SELECT e.category, e.d, {_usd('coalesce(c.tc, 0)')} AS x FROM every e LEFT JOIN c ON c.category = e.category AND c.d = e.d),
l AS (
  SELECT *, lag(x, 1) OVER w AS lag_1, lag(x, 7) OVER w AS lag_7, lag(x, 28) OVER w AS lag_28 FROM f
  WINDOW w AS (PARTITION BY category ORDER BY d))
SELECT category, {_iso('d')} AS date, x AS actual, lag_1, lag_7, lag_28, CAST(dayofweek(d) + 1 AS DOUBLE) AS day_of_week,
  CAST(month(d) AS DOUBLE) AS month FROM l WHERE lag_28 IS NOT NULL""",
    "drift_index": STAR + """, b AS (
  SELECT CAST(least(greatest(tc // 1000000, 0), 9) AS INT) AS bin, count(*) FILTER (d < DATE '2001-01-01') AS r,
    count(*) FILTER (d >= DATE '2001-01-01') AS c FROM sales GROUP BY bin),
s AS (SELECT greatest(CAST(r AS DOUBLE) / CAST(sum(r) OVER () AS DOUBLE), 1e-6) AS rs,
  greatest(CAST(c AS DOUBLE) / CAST(sum(c) OVER () AS DOUBLE), 1e-6) AS cs FROM b)
SELECT CAST(sum(CAST((cs - rs) * ln(cs / rs) AS DECIMAL(18,8))) AS DOUBLE) AS psi FROM s""",
    # events
    "recent_events": _EVENTS + f"""SELECT event_id, {_ts('ts')} AS ts, user_id, event_type, {_usd('vc')} AS value, source
FROM ev ORDER BY ev.ts DESC, event_id DESC LIMIT 100""",
    "event_props_extract": _EVENTS + f"""SELECT source, event_type, count(*) AS events, {_usd('sum(vc)')} AS value FROM ev GROUP BY source, event_type""",
    "metric_sum_by_label": _EVENTS + f""", l AS (
  SELECT event_type, source, vc FROM ev QUALIFY row_number() OVER (PARTITION BY event_type, source ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_type, {_usd('sum(vc)')} AS value, count(*) AS series FROM l GROUP BY event_type""",
    "latest_event_per_user": _EVENTS + f"""SELECT user_id, event_id, {_ts('ts')} AS ts, event_type, {_usd('vc')} AS value FROM ev
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ev.ts DESC, event_id DESC) = 1""",
    "event_rate_5m": _EVENTS + f""", w AS (
  SELECT event_type, ts, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)
    RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS n FROM ev)
SELECT DISTINCT event_type, {_ts('ts')} AS ts, n AS events, CAST(n AS DOUBLE) / 300 AS rate FROM w""",
    "counter_increase_5m": _EVENTS + f""", one AS (
  SELECT event_type, ts, epoch_us(ts) AS us, arg_max(vc, event_id) AS vc FROM ev GROUP BY event_type, ts),
l AS (SELECT *, lag(vc) OVER s AS b, lag(us) OVER s AS bus FROM one WINDOW s AS (PARTITION BY event_type ORDER BY us)),
step AS (SELECT *, CASE WHEN vc >= b THEN vc - b ELSE vc END AS st FROM l)
SELECT t.event_type, {_ts('t.ts')} AS ts, {_usd('t.vc')} AS value,
  {_usd('coalesce(sum(x.st) FILTER (x.bus > t.us - 300000000), 0)')} AS increase
FROM step t JOIN step x ON x.event_type = t.event_type AND x.us <= t.us AND x.us > t.us - 300000000
GROUP BY t.event_type, t.ts, t.vc""",
    "last_hour_events": _EVENTS + f"""SELECT event_id, {_ts('ts')} AS ts, user_id, event_type, {_usd('vc')} AS value, source
FROM ev WHERE ev.ts > (SELECT max(ev.ts) FROM ev) - INTERVAL 1 HOUR""",
    "conversion_funnel": _FUNNEL + f"""SELECT {_iso('d')} AS date, v AS view_events, c AS click_events, s AS signup_events,
  p AS purchase_events, vu AS view_users, cu AS click_users, su AS signup_users, pu AS purchase_users,
  CAST(c AS DOUBLE) / nullif(v, 0) AS click_rate, CAST(s AS DOUBLE) / nullif(c, 0) AS signup_rate,
  CAST(p AS DOUBLE) / nullif(s, 0) AS purchase_rate FROM funnel""",
    "business_alerts": _RFM.rstrip() + _DAYS[len(STAR):] + _FUNNEL.replace("\nWITH ev", ", ev", 1) + f""", m AS (
  SELECT d, {_usd('tc')} AS x, {_usd('sum(tc) OVER w')} / count(*) OVER w * CAST(0.5 AS DOUBLE) AS f, count(*) OVER w AS n
  FROM daily WINDOW w AS (ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT 'revenue_drop' AS rule, {_iso('d')} AS subject, x AS observed, f AS threshold FROM m WHERE n = 7 AND x < f
UNION ALL SELECT 'low_conversion', {_iso('d')}, CAST(p AS DOUBLE) / v, CAST(0.8 AS DOUBLE) FROM funnel
  WHERE v > 0 AND CAST(p AS DOUBLE) / v < CAST(0.8 AS DOUBLE)
UNION ALL SELECT 'lapsed_top_customer', CAST(customer_id AS VARCHAR), CAST(recency AS DOUBLE), CAST(180 AS DOUBLE)
  FROM seg WHERE segment = 'Cannot Lose Them' AND recency > 180""",
    # streams
    "stream_events_count": _EVENTS + "SELECT event_type, count(*) AS events FROM ev GROUP BY event_type",
    "stream_tumbling_counts": _EVENTS + f""", t AS (SELECT date_trunc('hour', ts) AS a, event_type, count(*) AS n FROM ev GROUP BY ALL)
SELECT {_ts('a')} AS window_start, {_ts('a + INTERVAL 1 HOUR')} AS window_end, event_type, n AS events FROM t""",
    "stream_rate_5m": _EVENTS + f""", t AS (
  SELECT date_trunc('minute', ts) - to_minutes(CAST(k AS INT)) AS a, event_type, count(*) AS n FROM ev, range(0, 5) AS r(k) GROUP BY ALL)
SELECT {_ts('a')} AS window_start, {_ts('a + INTERVAL 5 MINUTE')} AS window_end, event_type, n AS events,
  CAST(n AS DOUBLE) / 300 AS rate FROM t""",
    "realtime_metrics": _EVENTS + f""", t AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'purchase') AS p,
  count(*) FILTER (event_type = 'view') AS v, sum(vc) FILTER (event_type = 'purchase') AS pv FROM ev)
SELECT n AS total_events, {_usd('pv')} AS total_revenue, CAST(p AS DOUBLE) / v * CAST(100 AS DOUBLE) AS conversion_rate,
  {_usd('pv')} / p AS avg_order_value FROM t""",
    "latest_gauge": _EVENTS + f"""SELECT event_type, source, {_ts('ts')} AS ts, {_usd('vc')} AS value FROM ev
QUALIFY row_number() OVER (PARTITION BY event_type, source ORDER BY ev.ts DESC, event_id DESC) = 1""",
    "stream_dedup_events": _EVENTS + f"""SELECT event_id, {_ts('ts')} AS ts, user_id, event_type, {_usd('vc')} AS value, source FROM ev""",
    "stream_user_state_live": _EVENTS + f""", marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM ev),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked),
spans AS (
  SELECT user_id, s, date_trunc('millisecond', min(ts)) AS a, date_trunc('millisecond', max(ts)) AS b, count(*) AS n,
    coalesce(sum(vc) FILTER (event_type = 'purchase'), 0) AS pv
  FROM numbered GROUP BY user_id, s)
SELECT user_id, {_ts('a')} AS first_seen, {_ts('b')} AS last_seen, n AS events, {_usd('pv')} AS spend,
  b + INTERVAL 1 DAY >= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE AS active
FROM spans QUALIFY s = max(s) OVER (PARTITION BY user_id)""",
    "stream_progress": """SELECT 'dedup' AS query, count(*) AS input_rows,
  count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS dropped_rows FROM events""",
    "stream_sessions": _SESSIONS + f"""SELECT {_ts('a')} AS window_start, {_ts('b')} AS window_end, user_id, n AS events,
  {_usd('vc')} AS value FROM visits""",
    "stream_alerts": _HOURLY + f""", k AS (
  SELECT a, b, 'revenue_low' AS rule, {_usd('pv')} AS observed, CAST(50 AS DOUBLE) AS threshold, {_usd('pv')} < 50 AS hit FROM done
  UNION ALL SELECT a, b, 'errors_high', CAST(e AS DOUBLE) / n, CAST(0.4 AS DOUBLE), CAST(e AS DOUBLE) / n > CAST(0.4 AS DOUBLE) FROM done
  UNION ALL SELECT a, b, 'conversion_low', coalesce(CAST(p AS DOUBLE) / nullif(v, 0), 0) * 100, CAST(20 AS DOUBLE),
    coalesce(CAST(p AS DOUBLE) / nullif(v, 0), 0) * 100 < 20 FROM done)
SELECT {_ts('a')} AS window_start, {_ts('b')} AS window_end, rule, observed, threshold FROM k WHERE hit""",
    "stream_user_state": _EVENTS + f"""SELECT user_id, count(*) AS events, {_ts('max(ev.ts)')} AS last_seen,
  {_usd("coalesce(sum(vc) FILTER (event_type = 'purchase'), 0)")} AS spend FROM ev GROUP BY user_id""",
    "stream_events_by_segment": _EVENTS + f""", t AS (
  SELECT date_trunc('day', ts) AS a, c_mktsegment AS customer_segment, count(*) AS n
  FROM ev JOIN customer ON user_id = c_custkey GROUP BY ALL)
SELECT {_ts('CAST(a AS TIMESTAMP)')} AS window_start, {_ts('CAST(a AS TIMESTAMP) + INTERVAL 1 DAY')} AS window_end, customer_segment, n AS events
FROM t""",
    # data quality
    "dq_overview": """SELECT 'Data Quality Check' AS check_type, count(*) AS total_records,
  count(DISTINCT o_custkey) AS unique_customers, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS unique_products,
  count(DISTINCT o_orderkey) AS unique_orders FROM orders""",
    "dq_duplicate_keys": _DUPLICATES,
    "dq_orphans": _ORPHANS,
    "dq_domain": _DOMAIN,
    "dq_completeness": _COMPLETENESS,
    "dq_consistency": _CONSISTENCY,
    "dq_freshness": _FRESHNESS,
    "dq_report": _REPORT,
    "data_alerts": f"""WITH status AS ({_NAIVE.strip()} SELECT CAST(CAST(avg(CAST(abs(actual - forecast) AS DOUBLE) / actual) * 100
  AS DECIMAL(18,4)) AS DOUBLE) AS mape FROM naive WHERE actual IS NOT NULL)
SELECT 'data_quality' AS rule, rule AS subject, CAST(failed AS DOUBLE) / checked AS observed, 0::DOUBLE AS threshold
FROM ({_REPORT}) WHERE failed > 0
UNION ALL SELECT 'model_error', 'seasonal_naive', mape, 5::DOUBLE FROM status WHERE mape > 5""",
}


#: The stored tables after two loads or several batches are those of one look at everything.
_LOADED = {
    "stream_daily_summary": "daily_sales_summary",
    "fact_sales_bucketed": "fact_sales",
    "daily_load_summary": "daily_sales_summary",
    "daily_load_product_performance": "product_performance",
    "daily_load_customer_features": "customer_features",
    "daily_load_product_features": "product_features",
}


def sql_by_query() -> dict[str, str]:
    return _SQL | {name: _SQL[same] for name, same in _LOADED.items()}

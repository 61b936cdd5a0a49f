"""The same queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

from collections.abc import Sequence

from tallyline.plans.ridge_twin import mean_effects, ridge, slope_sizes

BASE_COLUMNS = (
    "unique_identifier_for_this_line",
    "order_number",
    "order_date",
    "customer_name",
    "customer_agreement",
    "order_channel",
    "order_region",
    "category_1",
    "category_2",
    "category_3",
    "item_number",
)
MONEY = ("line_product_revenue", "line_product_cost", "line_freight_revenue", "line_freight_cost")
MEASURES = ("line_quantity", "line_volume_cbm", *MONEY)
KEY = "unique_identifier_for_this_line"

OL = """base AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)) AS unique_identifier_for_this_line,
         CAST(l_orderkey AS VARCHAR) AS order_number,
         CAST(o_orderdate AS DATE) AS order_date,
         c_name AS customer_name,
         concat(c_mktsegment, '-', n_name) AS customer_agreement,
         o_orderpriority AS order_channel,
         n_name AS order_region,
         p_type AS category_1, p_brand AS category_2, p_name AS category_3,
         CAST(l_partkey AS VARCHAR) AS item_number,
         l_quantity AS line_quantity,
         p_size * l_quantity * CAST(0.001 AS DOUBLE) AS line_volume_cbm,
         l_extendedprice * (1 - l_discount) AS line_product_revenue,
         CAST(0.6 AS DOUBLE) * p_retailprice * l_quantity AS line_product_cost,
         l_tax * l_extendedprice AS line_freight_revenue,
         50 + 2500 * (p_size * l_quantity * CAST(0.001 AS DOUBLE)) + CAST(0.005 AS DOUBLE) * l_extendedprice
           AS line_freight_cost
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
),
ol AS (
  SELECT *,
         CASE WHEN line_product_revenue = 0 THEN 0
              ELSE (line_product_revenue - line_product_cost) / line_product_revenue * 100 END AS product_margin,
         CASE WHEN line_freight_revenue = 0 THEN 0
              ELSE (line_freight_revenue - line_freight_cost) / line_freight_revenue * 100 END AS freight_margin,
         CASE WHEN line_product_revenue + line_freight_revenue = 0 THEN 0
              ELSE (line_product_revenue + line_freight_revenue - (line_product_cost + line_freight_cost))
                   / (line_product_revenue + line_freight_revenue) * 100 END AS delivered_margin,
         line_product_revenue + line_freight_revenue AS total_revenue,
         line_product_cost + line_freight_cost AS total_cost,
         line_product_revenue + line_freight_revenue - (line_product_cost + line_freight_cost) AS total_profit,
         line_product_revenue / nullif(line_quantity, 0) AS avg_price,
         CAST(date_trunc('month', order_date) AS DATE) AS month,
         CASE WHEN month(order_date) IN (12, 1, 2) THEN 'Winter'
              WHEN month(order_date) IN (3, 4, 5) THEN 'Spring'
              WHEN month(order_date) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season
  FROM base
  WHERE line_quantity <> 0
)"""


def es(expression: str) -> str:
    return f"CAST(sum(CAST({expression} AS DECIMAL(38,12))) AS DOUBLE)"


def sums(*names: str) -> str:
    return ", ".join(f"{es(n)} AS {n}" for n in names)


def q(body: str, keys: Sequence[str], doubles: Sequence[str], digits: int | None = 6, ctes: str = "", tail: str = "") -> str:
    """Wrap a query: shared tables first, doubles rounded last (after the same nudge as in Spark)."""
    shown = "{0} + 0.0 AS {0}" if digits is None else f"round({{0}} + CAST(1e-9 AS DOUBLE), {digits}) + 0.0 AS {{0}}"
    columns = [*keys, *(shown.format(d) for d in doubles)]
    extra = f",\n{ctes}" if ctes else ""
    return f"WITH {OL}{extra}\nSELECT {', '.join(columns)}\nFROM (\n{body}\n) AS result{tail}"


MARGIN_MEANS = (
    "avg(product_margin) AS avg_product_margin, avg(freight_margin) AS avg_freight_margin, "
    "avg(delivered_margin) AS avg_delivered_margin"
)
AVG3 = ("avg_product_margin", "avg_freight_margin", "avg_delivered_margin")
VALUE_AND_MARGIN = (
    "count(*) AS order_count, avg(total_revenue) AS avg_order_value, avg(delivered_margin) AS avg_delivered_margin"
)
CATEGORIES = ("category_1", "category_2", "category_3")
CODED = (*CATEGORIES, "item_number", "order_channel", "order_region", "customer_agreement")
DIMENSIONS = (*CATEGORIES, "order_channel", "order_region", "item_number", "customer_name", "customer_agreement")


def histogram(source: str, column: str, bins: int, ctes: str = "") -> str:
    return q(
        f"""SELECT bin, low + (high - low) * ((bin - 1) / CAST({bins} AS DOUBLE)) AS bin_start,
       low + (high - low) * (bin / CAST({bins} AS DOUBLE)) AS bin_end, coalesce(rows, 0) AS rows
FROM (SELECT min({column}) AS low, max({column}) AS high, CAST(unnest(range(1, {bins + 1})) AS INTEGER) AS bin FROM {source})
LEFT JOIN (
  SELECT CAST(least(floor({bins} * (({column} - low) / (high - low))) + 1, {bins}) AS INTEGER) AS bin, count(*) AS rows
  FROM {source}, (SELECT min({column}) AS low, max({column}) AS high FROM {source}) GROUP BY 1) USING (bin)""",
        ["bin", "rows"],
        ["bin_start", "bin_end"],
        ctes=ctes,
    )


def by_category(columns: str, source: str = "ol") -> str:
    """Lines once per category column."""
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS category_column, {c} AS category_value, {columns} FROM {source}" for c in CATEGORIES
    )


def describe(source: str, metrics: Sequence[str], digits: int = 6, ctes: str = "") -> str:
    body = "\nUNION ALL\n".join(
        f"SELECT '{m}' AS metric, count({m}) AS count, avg({m}) AS mean, stddev_samp({m}) AS std, min({m}) AS min, "
        f"quantile_cont({m}, 0.25) AS p25, quantile_cont({m}, 0.5) AS p50, quantile_cont({m}, 0.75) AS p75, "
        f"max({m}) AS max FROM {source}"
        for m in metrics
    )
    return q(body, ["metric", "count"], ["mean", "std", "min", "p25", "p50", "p75", "max"], digits, ctes)


DAILY = f"""daily AS (
  SELECT order_date,
         {sums('line_volume_cbm', 'line_product_revenue', 'line_freight_revenue', 'line_product_cost',
               'line_freight_cost', 'total_revenue', 'total_cost')},
         {MARGIN_MEANS}
  FROM ol GROUP BY order_date)"""

PRODUCT_TABLE = f"""SELECT *,
       line_product_revenue - line_product_cost AS product_profit,
       line_freight_revenue - line_freight_cost AS freight_profit,
       line_product_revenue - line_product_cost + (line_freight_revenue - line_freight_cost) AS total_profit,
       CASE WHEN line_product_revenue = 0 THEN 0
            ELSE (line_product_revenue - line_product_cost) / line_product_revenue * 100 END AS product_margin,
       CASE WHEN line_freight_revenue = 0 THEN 0
            ELSE (line_freight_revenue - line_freight_cost) / line_freight_revenue * 100 END AS freight_margin,
       CASE WHEN line_product_revenue + line_freight_revenue = 0 THEN 0
            ELSE (line_product_revenue + line_freight_revenue - (line_product_cost + line_freight_cost))
                 / (line_product_revenue + line_freight_revenue) * 100 END AS delivered_margin,
       CASE WHEN line_quantity = 0 THEN 0 ELSE line_product_revenue / line_quantity END AS avg_price
FROM (SELECT item_number, {sums('line_quantity', *MONEY, 'line_volume_cbm')},
             count(DISTINCT order_number) AS order_count
      FROM ol GROUP BY item_number)"""
PRODUCT_KEYS = ["item_number", "order_count"]
PRODUCT_DOUBLES = [
    "line_quantity", *MONEY, "line_volume_cbm", "product_profit", "freight_profit", "total_profit",
    "product_margin", "freight_margin", "delivered_margin", "avg_price",
]


def profit_table(keys: str, where: str = "") -> str:
    return f"""SELECT *, total_profit / nullif(line_product_revenue + line_freight_revenue, 0) * 100 AS delivered_margin
FROM (SELECT *, line_product_revenue - line_product_cost + (line_freight_revenue - line_freight_cost) AS total_profit
      FROM (SELECT {keys}, {sums('line_quantity', *MONEY)} FROM ol {where} GROUP BY {keys}))"""


PROFIT_DOUBLES = ["line_quantity", *MONEY, "total_profit", "delivered_margin"]


def elasticity_ctes(numerator: str, alias: str) -> str:
    return f"""ladder AS (
  SELECT item_number, CASE WHEN line_quantity <> 0 THEN {numerator} / line_quantity ELSE 0 END AS price,
         {es('line_quantity')} AS quantity
  FROM ol GROUP BY 1, 2),
steps AS (
  SELECT item_number,
         price / nullif(lag(price) OVER w, 0) - 1 AS price_change,
         quantity / nullif(lag(quantity) OVER w, 0) - 1 AS quantity_change
  FROM ladder WINDOW w AS (PARTITION BY item_number ORDER BY price)),
elasticities AS (
  SELECT item_number, median(-quantity_change / price_change) AS {alias}
  FROM steps WHERE price_change <> 0 AND quantity_change <> 0 GROUP BY item_number),
with_margin AS (
  SELECT e.*, m.avg_delivered_margin
  FROM elasticities e JOIN (SELECT item_number, avg(delivered_margin) AS avg_delivered_margin
                            FROM ol GROUP BY item_number) m USING (item_number))"""


PRICE_STEPS = elasticity_ctes("line_product_revenue", "price_elasticity")
FREIGHT_STEPS = elasticity_ctes("line_freight_revenue", "freight_revenue_elasticity")

CUSTOMER_TOTALS = f"""customer_totals AS (
  SELECT customer_name, {es('total_revenue')} AS customer_total_value, count(*) AS order_lines
  FROM ol GROUP BY customer_name),
edges AS (
  SELECT quantile_cont(customer_total_value, 1.0/3) AS e1, quantile_cont(customer_total_value, 2.0/3) AS e2
  FROM ol JOIN customer_totals USING (customer_name)),
tertiles AS (
  SELECT customer_totals.*, CASE WHEN customer_total_value <= e1 THEN 'Low Value'
                                 WHEN customer_total_value <= e2 THEN 'Medium Value'
                                 ELSE 'High Value' END AS customer_group
  FROM customer_totals, edges)"""

AGREEMENTS = f"""agreements AS (
  SELECT customer_agreement, count(DISTINCT customer_name) AS customer_count, count(*) AS order_count,
         {sums('total_revenue')}, {MARGIN_MEANS}
  FROM ol GROUP BY customer_agreement)"""

CHANNELS = f"""channels AS (
  SELECT *, line_product_revenue + line_freight_revenue AS total_revenue,
         line_product_revenue - line_product_cost + (line_freight_revenue - line_freight_cost) AS total_profit,
         (line_product_revenue + line_freight_revenue) / order_count AS avg_order_value
  FROM (SELECT order_channel, count(*) AS order_count, {sums(*MONEY)}, {MARGIN_MEANS},
               count(DISTINCT customer_name) AS customer_count
        FROM ol GROUP BY order_channel))"""

FREIGHT = f"""order_totals AS (
  SELECT *, CASE WHEN line_volume_cbm > 0 THEN line_freight_cost / line_volume_cbm ELSE 0 END AS freight_cost_per_cbm
  FROM (SELECT order_number, {sums('line_volume_cbm', 'line_freight_cost', 'line_freight_revenue')},
               arg_min(order_region, {KEY}) AS order_region
        FROM ol GROUP BY order_number)),
regions AS (
  SELECT order_region, avg(line_volume_cbm) AS avg_line_volume_cbm, avg(line_freight_cost) AS avg_line_freight_cost,
         avg(freight_cost_per_cbm) AS avg_freight_cost_per_cbm
  FROM order_totals GROUP BY order_region),
consolidated AS (
  SELECT *, CASE WHEN line_volume_cbm > 0 THEN line_freight_cost / line_volume_cbm ELSE 0 END AS freight_cost_per_cbm
  FROM (SELECT order_date AS order_day, order_region, count(*) AS order_count,
               {sums('line_volume_cbm', 'line_freight_cost')}
        FROM ol GROUP BY order_date, order_region)),
by_region AS (
  SELECT c.*, avg_freight_cost_per_cbm AS freight_cost_per_cbm_original,
         CASE WHEN avg_freight_cost_per_cbm > 0
              THEN (1 - freight_cost_per_cbm_consolidated / avg_freight_cost_per_cbm) * 100 ELSE 0 END
           AS savings_percentage
  FROM (SELECT order_region, avg(freight_cost_per_cbm) AS freight_cost_per_cbm_consolidated,
               avg(order_count) AS avg_daily_lines
        FROM consolidated GROUP BY order_region) c
  JOIN regions USING (order_region))"""
BY_REGION = ["freight_cost_per_cbm_consolidated", "avg_daily_lines", "freight_cost_per_cbm_original", "savings_percentage"]

ITEM_SALES = f"""item_sales AS (
  SELECT item_number, avg(line_quantity) AS avg_monthly_sales, stddev_samp(line_quantity) AS std_monthly_sales,
         {es('line_quantity')} AS total_sales, {es('total_profit')} AS total_profit,
         stddev_samp(line_quantity) / nullif(avg(line_quantity), 0) AS cv_sales
  FROM (SELECT month, item_number, {sums('line_quantity', 'total_profit')} FROM ol GROUP BY month, item_number)
  GROUP BY item_number)"""
ITEM_SALES_DOUBLES = ["avg_monthly_sales", "std_monthly_sales", "total_sales", "total_profit", "cv_sales"]


def profitability(dim: str) -> str:
    volume = (
        f"{es('line_quantity')} AS line_quantity"
        if dim in ("item_number", "category_1")
        else "count(*) AS order_count"
    )
    return f"""SELECT *, total_profit / nullif(line_product_revenue, 0) * 100 AS profit_margin
FROM (SELECT {dim}, {volume}, {sums('line_product_revenue', 'line_product_cost', 'total_profit')}
      FROM ol GROUP BY {dim})"""


PROFITABILITY = ["line_product_revenue", "line_product_cost", "total_profit", "profit_margin"]


def swings(dim: str, revenue: str, cost: str) -> str:
    return q(
        f"""SELECT {dim}, max(m) - min(m) AS margin_swing
FROM (SELECT {dim}, month, ({es(revenue)} - {es(cost)}) / nullif({es(revenue)}, 0) * 100 AS m
      FROM ol GROUP BY {dim}, month)
GROUP BY {dim}""",
        [dim],
        ["margin_swing"],
    )


def negatives(dim: str, margin: str, revenue: str, cost: str) -> str:
    return q(
        f"""SELECT *, CASE WHEN avg_{margin} < 0 THEN {cost} - {revenue} ELSE 0 END AS total_loss
FROM (SELECT {dim}, avg({margin}) AS avg_{margin}, {sums(revenue, cost)} FROM ol GROUP BY {dim})""",
        [dim],
        [f"avg_{margin}", revenue, cost, "total_loss"],
    )


def text_list(column: str) -> str:
    return f"string_agg(DISTINCT {column}, ', ' ORDER BY {column}) AS {column}"


ITEM_LISTS = ("order_region", "customer_agreement", "customer_name")
ITEM_DRILLDOWN = f"""drill AS (
  SELECT category_column, category_value, item_number, avg(delivered_margin) AS delivered_margin,
         avg(line_volume_cbm) AS line_volume_cbm, {sums(*MONEY)}, {', '.join(text_list(c) for c in ITEM_LISTS)}
  FROM ({by_category('item_number, delivered_margin, line_volume_cbm, ' + ', '.join(MONEY + ITEM_LISTS))})
  GROUP BY category_column, category_value, item_number)"""
DRILL_KEYS = ["category_column", "category_value", "item_number"]
DRILL_DOUBLES = ["delivered_margin", "line_volume_cbm", *MONEY]


def drilldown(key: str, members: Sequence[str]) -> str:
    """A row of totals a group, and a row a distinct member."""
    source = by_category(f"{key}, delivered_margin, line_volume_cbm, {', '.join((*MONEY, *members))}")
    group = f"category_column, category_value, {key}"
    rows = "\nUNION ALL\n".join(
        f"SELECT DISTINCT {group}, '{m}' AS member_column, {m} AS member, {', '.join('NULL::DOUBLE' for _ in DRILL_DOUBLES)}\n"
        f"FROM lines WHERE {m} IS NOT NULL"
        for m in members
    )
    return q(
        f"""SELECT {group}, NULL AS member_column, NULL AS member, avg(delivered_margin) AS delivered_margin,
       avg(line_volume_cbm) AS line_volume_cbm, {sums(*MONEY)}
FROM lines GROUP BY ALL
UNION ALL
{rows}""",
        ["category_column", "category_value", key, "member_column", "member"],
        DRILL_DOUBLES,
        ctes=f"lines AS (SELECT * FROM ({source}) WHERE {key} IS NOT NULL AND category_value IS NOT NULL)",
    )


LOSS_ORDERS = q(
    f"""SELECT order_number, NULL AS member_column, NULL AS member, {sums('line_quantity', 'line_volume_cbm', *MONEY)},
       avg(delivered_margin) AS avg_delivered_margin
FROM loss GROUP BY order_number
"""
    + "".join(
        f"""UNION ALL
SELECT DISTINCT order_number, '{c}', {c}, {', '.join(['NULL::DOUBLE'] * 7)} FROM loss WHERE {c} IS NOT NULL
"""
        for c in (*CATEGORIES, "item_number")
    ),
    ["order_number", "member_column", "member"],
    ["line_quantity", "line_volume_cbm", *MONEY, "avg_delivered_margin"],
    ctes="loss AS (SELECT * FROM ol WHERE order_number IN (SELECT order_number FROM ol WHERE delivered_margin < 0))",
)

# Rules by which values are missing; the totals of a group without any value are 0.
GAPS = """gaps AS (
  SELECT * REPLACE (
    CASE WHEN CAST(item_number AS BIGINT) % 7 = 1 THEN NULL ELSE customer_name END AS customer_name,
    CASE WHEN (CAST(item_number AS BIGINT) + CAST(order_number AS BIGINT)) % 11 = 2 THEN NULL ELSE customer_agreement END
      AS customer_agreement,
    CASE WHEN CAST(order_number AS BIGINT) % 13 = 3 THEN NULL ELSE order_region END AS order_region,
    CASE WHEN CAST(item_number AS BIGINT) % 17 = 4 THEN NULL ELSE category_2 END AS category_2,
    CASE WHEN (CAST(item_number AS BIGINT) + 2 * CAST(order_number AS BIGINT)) % 19 = 5 THEN NULL ELSE item_number END
      AS item_number,
    CASE WHEN CAST(order_number AS BIGINT) % 23 = 6 THEN NULL ELSE order_channel END AS order_channel,
    CASE WHEN (CAST(item_number AS BIGINT) + 3 * CAST(order_number AS BIGINT)) % 9 = 7 THEN NULL ELSE line_freight_cost END
      AS line_freight_cost,
    CASE WHEN (CAST(item_number AS BIGINT) + 5 * CAST(order_number AS BIGINT)) % 29 = 8 THEN NULL
         ELSE line_product_revenue END AS line_product_revenue)
  FROM base
),
ol AS ("""


def gapped(sql: str, *keys: str) -> str:
    """A twin over the lines with missing values; groups without a key are left out."""
    over = sql.replace("ol AS (", GAPS, 1).replace("FROM base\n  WHERE line_quantity <> 0", "FROM gaps", 1)
    for m in (*MEASURES, "total_revenue", "total_cost"):
        over = over.replace(f"{es(m)} AS {m}", f"coalesce({es(m)}, 0) AS {m}")
    return f"SELECT * FROM ({over}) WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)}"


def lowest(member: str) -> str:
    members = by_category(f"item_number, {member}, delivered_margin")
    return q(
        f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY category_column, category_value
                               ORDER BY round(avg_delivered_margin, 9), {member}) AS k
  FROM (SELECT category_column, category_value, {member}, avg(item_margin) AS avg_delivered_margin
        FROM (SELECT DISTINCT category_column, category_value, item_number, {member},
                     avg(delivered_margin) OVER (PARTITION BY category_column, category_value, item_number)
                       AS item_margin
              FROM ({members}))
        GROUP BY category_column, category_value, {member}))
WHERE k <= 10""",
        ["category_column", "category_value", member],
        ["avg_delivered_margin"],
    )


def anova(dim: str) -> str:
    return q(
        f"""SELECT '{dim}' AS grouping, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows,
       (sum(n * (m - grand) * (m - grand)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_value
FROM (SELECT count(*) AS n, avg(delivered_margin) AS m, var_pop(delivered_margin) AS v FROM ol GROUP BY {dim}),
     (SELECT avg(delivered_margin) AS grand FROM ol)""",
        ["grouping", "groups", "rows"],
        ["f_value"],
    )


def linear_fit(source: str, x: str, y: str, key: str, digits: int, ctes: str = "") -> str:
    extra = f"{ctes}, " if ctes else ""
    return q(
        """SELECT min(slope) AS slope, min(intercept) AS intercept, min(train_rows) AS train_rows,
       count(*) AS test_rows, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae,
       1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0) AS r2
FROM (SELECT flagged.*, slope, intercept, train_rows, intercept + slope * x AS p FROM flagged, fit WHERE NOT train)""",
        ["train_rows", "test_rows"],
        ["slope", "intercept", "mse", "mae", "r2"],
        digits,
        f"""{extra}flagged AS (
  SELECT {x} AS x, {y} AS y, CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 6) AS BIGINT) % 100 < 80 AS train
  FROM {source}),
fit AS (
  SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, count(*) AS train_rows
  FROM flagged WHERE train)""",
    )


DECOMPOSED = ("line_volume_cbm", "total_revenue", "product_margin", "freight_margin", "delivered_margin")
SERIES = "series AS (" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS series_key, order_date, {'avg_' + m if m.endswith('_margin') else m} AS value FROM daily"
    for m in DECOMPOSED
) + ")"

MONTHLY = f"""monthly AS (SELECT month, {sums('total_revenue')} FROM ol GROUP BY month),
lagged AS (
  SELECT * FROM (SELECT month, total_revenue, lag(total_revenue) OVER (ORDER BY month) AS prev_month_revenue
                 FROM monthly)
  WHERE prev_month_revenue IS NOT NULL)"""

PRICED = """priced AS (
  SELECT *, freight_revenue / nullif(line_quantity, 0) AS price, line_freight_cost / nullif(line_quantity, 0) AS unit_cost
  FROM (SELECT *, CASE WHEN line_freight_cost <> 0 THEN line_freight_revenue
                       ELSE line_product_revenue * CAST(0.15 AS DOUBLE) END AS freight_revenue
        FROM ol))"""
CELLS = f"""{PRICED},
cells AS (
  SELECT *, ln(avg_price + CAST(0.01 AS DOUBLE)) AS log_price, ln(avg_quantity + CAST(0.01 AS DOUBLE)) AS log_quantity
  FROM (SELECT CAST(month(order_date) AS INTEGER) AS month, CAST(isodow(order_date) - 1 AS INTEGER) AS day_of_week,
               order_channel, order_region, avg(price) AS avg_price, avg(line_quantity) AS avg_quantity
        FROM priced GROUP BY 1, 2, 3, 4))"""
MARKET = f"""{CELLS},
market AS (
  SELECT avg(price) AS mean_price, avg(unit_cost) AS mean_cost, quantile_cont(price, 0.05) AS lower_price,
         quantile_cont(price, 0.95) AS upper_price, (SELECT regr_slope(log_quantity, log_price) FROM cells) AS slope
  FROM priced)"""
GRID = f"""{MARKET},
grid AS (
  SELECT size, step, price, demand, (price - mean_cost) * demand AS profit
  FROM (SELECT *, pow(greatest(price, CAST(0.01 AS DOUBLE)) / mean_price, slope) AS demand
        FROM (SELECT market.*, CAST(size AS INTEGER) AS size, CAST(step AS INTEGER) AS step,
                     lower_price + CAST(step AS DOUBLE) / CAST(size - 1 AS DOUBLE) * (upper_price - lower_price) AS price
              FROM market, (VALUES (50), (100), (200), (500)) sizes(size), range(0, 500) steps(step)
              WHERE step < size)))"""
SCENARIOS = f"""{MARKET},
offers AS (
  SELECT {KEY} AS line, line_quantity AS q, line_freight_cost AS c, price AS ref, slope,
         CAST(step AS INTEGER) AS step,
         greatest((lower_price + CAST(step AS DOUBLE) / 99 * (upper_price - lower_price)) * line_quantity,
                  CAST(0.01 AS DOUBLE)) AS new_price
  FROM priced, market, range(0, 100) steps(step)),
scenario_rows AS (
  SELECT *, (new_price - c) / q * new_quantity AS profit, (new_price - c) / new_price AS margin_rate
  FROM (SELECT *, greatest(floor(q * CASE WHEN q > 0 AND ref > 0 THEN pow(new_price / q / ref, slope) ELSE 1 END), 1)
                    AS new_quantity
        FROM offers)),
best AS (
  SELECT line AS {KEY}, step, new_price, new_quantity, margin_rate, profit
  FROM scenario_rows
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY profit DESC, step) = 1)"""

RECOMMENDED = f"""halved AS (
  WITH RECURSIVE search AS (
    SELECT {KEY} AS line, line_product_cost AS k, line_freight_cost AS c,
           line_product_cost / (1 - CAST(0.492 AS DOUBLE)) AS p, 0 AS i,
           least(greatest(line_freight_cost / (1 - CAST(-0.1501 AS DOUBLE)), CAST(0.01 AS DOUBLE)),
                 greatest((line_product_cost + line_freight_cost) / (1 - CAST(0.4541 AS DOUBLE))
                          - line_product_cost / (1 - CAST(0.492 AS DOUBLE)), CAST(0.01 AS DOUBLE))) AS low,
           greatest(greatest(line_freight_cost / (1 - CAST(-0.1501 AS DOUBLE)), CAST(0.01 AS DOUBLE)),
                    greatest((line_product_cost + line_freight_cost) / (1 - CAST(0.4541 AS DOUBLE))
                             - line_product_cost / (1 - CAST(0.492 AS DOUBLE)), CAST(0.01 AS DOUBLE))) AS high
    FROM ol
    UNION ALL
    SELECT line, k, c, p, i + 1, CASE WHEN slope < 0 THEN x ELSE low END, CASE WHEN slope < 0 THEN high ELSE x END
    FROM (SELECT *, (1 - CAST(-0.1501 AS DOUBLE) - c / x) * c / (x * x)
                    + (1 - CAST(0.4541 AS DOUBLE) - (k + c) / (p + x)) * (k + c) / ((p + x) * (p + x)) AS slope
          FROM (SELECT *, (low + high) / 2 AS x FROM search WHERE i < 48))
  )
  SELECT line AS {KEY}, k AS line_product_cost, p AS product_revenue, c AS predicted_freight_cost,
         (low + high) / 2 AS freight_revenue
  FROM search WHERE i = 48)"""

SEGMENTS = f"""{CUSTOMER_TOTALS},
segment_margins AS (
  SELECT customer_group AS customer_segment, avg(delivered_margin) AS segment_multiplier
  FROM ol JOIN tertiles USING (customer_name) GROUP BY customer_group),
month_margins AS (
  SELECT CAST(month(order_date) AS INTEGER) AS month,
         avg(delivered_margin) / nullif((SELECT avg(delivered_margin) FROM ol), 0) AS month_multiplier
  FROM ol GROUP BY 1)"""

CUSTOMERS = f"""SELECT *, greatest(avg_order_value * purchase_frequency * customer_lifetime_days, 0) AS clv
FROM (SELECT *, (total_product_revenue + total_freight_revenue) / order_count AS avg_order_value,
             order_count / CAST(customer_lifetime_days AS DOUBLE) AS purchase_frequency
      FROM (SELECT customer_name, count(*) AS order_count, {es('line_product_revenue')} AS total_product_revenue,
                   {es('line_freight_revenue')} AS total_freight_revenue, {es('line_volume_cbm')} AS total_volume,
                   CAST(date_diff('day', min(order_date), max(order_date)) + 1 AS INTEGER) AS customer_lifetime_days
            FROM ol GROUP BY customer_name))"""

FACTORS = f"""SELECT item_number, {sums('line_quantity', 'line_product_revenue', 'line_product_cost', 'line_freight_revenue',
                                           'line_freight_cost', 'total_profit')},
       avg(total_profit / nullif(line_product_revenue, 0) * 100) AS avg_profit_margin FROM ol GROUP BY item_number"""

SEGMENT_ROWS = f"""SELECT customer_name, {sums('total_revenue', 'line_quantity')}, avg(delivered_margin) AS avg_delivered_margin,
       avg(product_margin) AS avg_predicted_margin FROM ol GROUP BY customer_name"""


def clusters(rows: str, key: str, features: Sequence[str], k: int) -> str:
    """Tables up to ``clustered``: the rows with their cluster, by at most 100 moves of the centres."""
    numbered = list(enumerate(features))
    known = " AND ".join(f"{f} IS NOT NULL" for f in features)
    means = ", ".join(f"CAST(floor(CAST(sum(z{i}) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS c{i}" for i, _ in numbered)
    away = " + ".join(f"(CAST(z{i} AS DOUBLE) - c{i}) * (CAST(z{i} AS DOUBLE) - c{i})" for i, _ in numbered)
    nearest = f"min({{'d': {away}, 'c': cluster}}).c"
    moments = ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}" for i, f in numbered)
    places = ", ".join(
        f"CAST(floor(coalesce(({f} - m{i}) / nullif(s{i}, 0), 0) * 1000000.0 + 0.5) AS BIGINT) AS z{i}" for i, f in numbered
    )
    kept = ", ".join(f"any_value(z{i}) AS z{i}" for i, _ in numbered)
    cuts = ", ".join(f"{i / k}" for i in range(1, k))
    score = " + ".join(f"z{i}" for i, _ in numbered)
    part = " + ".join(f"CAST({score} > cuts[{i}] AS INTEGER)" for i in range(1, k))
    return f"""cluster_rows AS MATERIALIZED (SELECT * FROM ({rows}) WHERE {known}),
cluster_points AS MATERIALIZED (
  SELECT {key}, {places} FROM cluster_rows, (SELECT {moments} FROM cluster_rows)),
cluster_parts AS (
  SELECT p.*, CAST({part} AS INTEGER) AS part
  FROM cluster_points p, (SELECT quantile_cont(CAST({score} AS DOUBLE), [{cuts}]) AS cuts FROM cluster_points)),
centres AS MATERIALIZED (
  WITH RECURSIVE moves AS (
    SELECT 0 AS step, part AS cluster, {means} FROM cluster_parts GROUP BY part
    UNION ALL
    SELECT step + 1 AS step, cluster, {means}
    FROM (SELECT {key}, step, {nearest} AS cluster, {kept} FROM cluster_points, moves WHERE step < 100 GROUP BY {key}, step)
    GROUP BY step, cluster)
  SELECT * FROM moves WHERE step = (SELECT max(step) FROM moves)),
clustered AS MATERIALIZED (
  SELECT * FROM cluster_rows
  JOIN (SELECT {key}, {nearest} AS cluster FROM cluster_points, centres GROUP BY {key}) USING ({key}))"""


CUSTOMER_FEATURES = (
    "order_count", "total_product_revenue", "total_freight_revenue", "total_volume", "avg_order_value",
    "purchase_frequency", "clv",
)
REGION_FEATURES = ("avg_line_volume_cbm", "avg_freight_cost_per_cbm")
FACTOR_FEATURES = (
    "line_quantity", "line_product_revenue", "line_product_cost", "line_freight_revenue", "line_freight_cost",
    "total_profit", "avg_profit_margin",
)
SEGMENT_FEATURES = ("total_revenue", "line_quantity", "avg_delivered_margin", "avg_predicted_margin")


def cluster_profile(features: Sequence[str], more: str = "") -> str:
    means = ", ".join(f"round_even(avg({f}), 2) AS avg_{f}" for f in features)
    return f"""SELECT cluster, {means}, count(*) AS members,
       round_even(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage{more} FROM clustered GROUP BY cluster"""


def clusters_sql() -> dict[str, str]:
    customers = clusters(CUSTOMERS, "customer_name", CUSTOMER_FEATURES, 5)
    regions = f"{FREIGHT},\n" + clusters("SELECT * FROM regions", "order_region", REGION_FEATURES, 3)
    factors = clusters(FACTORS, "item_number", FACTOR_FEATURES, 3)
    segments = clusters(SEGMENT_ROWS, "customer_name", SEGMENT_FEATURES, 3)
    long = " UNION ALL ".join(
        f"SELECT cluster, '{f}' AS metric, CAST({f} AS DOUBLE) AS value FROM clustered" for f in CUSTOMER_FEATURES
    )
    outlying = ", ".join(
        f"CASE WHEN abs(({f} - avg({f}) OVER c) / nullif(stddev_pop({f}) OVER c, 0)) > 3 THEN {f} END AS {f}"
        for f in CUSTOMER_FEATURES
    )
    importance = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, abs(avg(CAST(c{i} AS DOUBLE)) / 1000000.0) AS importance FROM centres"
        for i, f in enumerate(CUSTOMER_FEATURES)
    )
    return {
        "customer_clusters": q(
            "SELECT * FROM clustered",
            ["customer_name", "order_count", "customer_lifetime_days", "cluster"],
            CUSTOMER_FEATURES[1:],
            ctes=customers,
        ),
        "customer_cluster_profile": q(
            cluster_profile(CUSTOMER_FEATURES, ", quantile_cont(clv, 0.5) AS median_clv"),
            ["cluster", "members"],
            [*(f"avg_{f}" for f in CUSTOMER_FEATURES), "percentage", "median_clv"],
            ctes=customers,
        ),
        "best_and_worst_cluster": q(
            """SELECT arg_max(cluster, avg_clv) AS high_value_cluster, arg_min(cluster, avg_clv) AS low_value_cluster
FROM (SELECT cluster, round_even(avg(clv), 2) AS avg_clv FROM clustered GROUP BY cluster)""",
            ["high_value_cluster", "low_value_cluster"],
            [],
            ctes=customers,
        ),
        "cluster_feature_importance": q(importance, ["feature"], ["importance"], ctes=customers),
        "cluster_outliers": q(
            f"""SELECT * FROM (SELECT customer_name, cluster, {outlying} FROM clustered WINDOW c AS (PARTITION BY cluster))
WHERE {" OR ".join(f"{f} IS NOT NULL" for f in CUSTOMER_FEATURES)}""",
            ["customer_name", "cluster", "order_count"],
            CUSTOMER_FEATURES[1:],
            ctes=customers,
        ),
        "customer_cluster_describe": q(
            f"""SELECT cluster, metric, count(value) AS rows, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS least,
       max(value) AS most, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
       quantile_cont(value, 0.75) AS p75 FROM ({long}) GROUP BY cluster, metric""",
            ["cluster", "metric", "rows"],
            ["mean", "std", "least", "most", "p25", "p50", "p75"],
            4,
            ctes=customers,
        ),
        "region_clusters": q(
            "SELECT * FROM clustered",
            ["order_region", "cluster"],
            ["avg_line_volume_cbm", "avg_line_freight_cost", "avg_freight_cost_per_cbm"],
            ctes=regions,
        ),
        "region_cluster_profile": q(
            cluster_profile(REGION_FEATURES),
            ["cluster", "members"],
            [*(f"avg_{f}" for f in REGION_FEATURES), "percentage"],
            ctes=regions,
        ),
        "profitability_factors": q(FACTORS, ["item_number"], FACTOR_FEATURES),
        "profitability_clusters": q(
            "SELECT * FROM clustered", ["item_number", "cluster"], FACTOR_FEATURES, ctes=factors
        ),
        "profitability_cluster_profile": q(
            cluster_profile(FACTOR_FEATURES),
            ["cluster", "members"],
            [*(f"avg_{f}" for f in FACTOR_FEATURES), "percentage"],
            ctes=factors,
        ),
        "customer_segments_observed": q(
            "SELECT * EXCLUDE (cluster), cluster AS customer_segment FROM clustered",
            ["customer_name", "customer_segment"],
            SEGMENT_FEATURES,
            ctes=segments,
        ),
        "line_segments": q(
            f"""SELECT ol.{KEY}, customer_name, cluster AS customer_segment, avg_predicted_margin
FROM ol LEFT JOIN clustered USING (customer_name)""",
            [KEY, "customer_name", "customer_segment"],
            ["avg_predicted_margin"],
            ctes=segments,
        ),
    }


CORRELATED = (
    "line_volume_cbm", "line_quantity", "line_product_revenue", "line_product_cost", "line_freight_revenue",
    "line_freight_cost", "total_revenue", "product_margin", "freight_margin", "delivered_margin",
)


def whole_lines_sql() -> dict[str, str]:
    top_items = f"SELECT item_number FROM ol GROUP BY item_number ORDER BY {es('total_profit')} DESC, item_number LIMIT 5"
    top_agreements = (
        f"SELECT customer_agreement FROM ol GROUP BY customer_agreement "
        f"ORDER BY {es('total_revenue')} DESC, customer_agreement LIMIT 5"
    )
    top_regions = "SELECT order_region FROM ol GROUP BY order_region ORDER BY count(*) DESC, order_region LIMIT 5"
    region_channel = f"SELECT order_region, order_channel, {VALUE_AND_MARGIN} FROM ol GROUP BY 1, 2"
    monthly_channel = f"SELECT month, order_channel, {VALUE_AND_MARGIN} FROM ol GROUP BY 1, 2"
    monthly_agreement = (
        f"SELECT month, customer_agreement, {sums('total_revenue')}, avg(delivered_margin) AS avg_delivered_margin FROM ol"
    )
    value_margin = ["avg_order_value", "avg_delivered_margin"]
    item_profit = profitability("item_number")
    price_points = (
        f"SELECT item_number, {sums('line_quantity', 'line_product_revenue', 'total_profit')}, "
        "var_samp(line_product_revenue / nullif(line_quantity, 0)) AS v, "
        "avg(line_product_revenue / nullif(line_quantity, 0)) AS m, count(*) AS n FROM ol GROUP BY item_number"
    )
    pairs = [(a, b) for a in CORRELATED for b in CORRELATED]
    correlations = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, "
        + ("CAST(max(1) AS DOUBLE)" if a == b else f"corr({min(a, b)}, {max(a, b)})")
        + " AS r FROM ol"
        for a, b in pairs
    )
    flags = f"""items AS ({item_profit}),
cut AS (SELECT median(profit_margin) AS pm, quantile_cont(line_quantity, 0.25) AS q25,
               quantile_cont(line_quantity, 0.75) AS q75 FROM items)"""
    stock_cut = f"""{ITEM_SALES},
cut AS (SELECT median(avg_monthly_sales) AS med, quantile_cont(total_sales, 0.25) AS q25,
               quantile_cont(total_sales, 0.75) AS q75, quantile_cont(avg_monthly_sales, 0.25) AS slow FROM item_sales)"""
    stock = "SELECT item_sales.* FROM item_sales, cut WHERE "
    market_best = ["new_price", "new_quantity", "margin_rate", "profit"]

    return {
        "order_lines": q("SELECT * FROM base", BASE_COLUMNS, MEASURES, None),
        "line_margins": q("SELECT * FROM ol", [KEY], ["product_margin", "freight_margin", "delivered_margin"], None),
        "line_totals": q(
            "SELECT *, total_revenue AS order_value, total_profit AS profit FROM ol",
            [KEY],
            ["total_revenue", "total_cost", "total_profit", "order_value", "profit", "avg_price"],
            None,
        ),
        "line_margins_fraction": q(
            f"SELECT {KEY}, "
            + ", ".join(
                f"coalesce(greatest(-1, least(1, CASE WHEN {r} = 0 THEN CAST(sign({r} - ({c})) AS DOUBLE) "
                f"ELSE ({r} - ({c})) / ({r}) END)), 0) AS {name}"
                for name, r, c in (
                    ("product_margin", "line_product_revenue", "line_product_cost"),
                    ("freight_margin", "line_freight_revenue", "line_freight_cost"),
                    ("delivered_margin", "total_revenue", "total_cost"),
                )
            )
            + " FROM ol",
            [KEY],
            ["product_margin", "freight_margin", "delivered_margin"],
            None,
        ),
        "line_calendar": q(
            f"""SELECT {KEY}, CAST(month(order_date) AS INTEGER) AS month_no,
       CAST(isodow(order_date) - 1 AS INTEGER) AS day_of_week,
       CAST(isodow(order_date) >= 6 AS INTEGER) AS is_weekend, season, month AS month_start,
       last_day(order_date) AS month_end FROM ol""",
            [KEY, "month_no AS month", "day_of_week", "is_weekend", "season", "month_start", "month_end"],
            [],
        ),
        "line_ratios": q(
            f"""SELECT {KEY},
       CASE WHEN line_product_cost = 0 THEN 0
            ELSE least(greatest(line_product_revenue / line_product_cost, 0), 10) END AS revenue_to_cost_ratio,
       CASE WHEN line_product_cost = 0 THEN 0
            ELSE least(greatest(line_freight_cost / line_product_cost, 0), 10) END AS freight_to_product_cost_ratio,
       CASE WHEN delivered_margin = 0 THEN 0 ELSE line_volume_cbm / delivered_margin END AS volume_to_margin_ratio
FROM ol""",
            [KEY],
            ["revenue_to_cost_ratio", "freight_to_product_cost_ratio", "volume_to_margin_ratio"],
            None,
        ),
        "line_freight_price": q("SELECT * FROM priced", [KEY], ["freight_revenue", "price"], None, PRICED),
        "model_inputs": q(
            "SELECT * FROM ol",
            [KEY, *BASE_COLUMNS[5:]],
            [*MEASURES, "product_margin", "freight_margin", "delivered_margin", "total_revenue", "total_cost",
             "total_profit", "avg_price"],
            None,
        ),
        "key_metric_summary": describe("ol", [*CORRELATED[:6], *CORRELATED[7:]]),
        "daily_summary": describe("daily", ["line_volume_cbm", *MONEY, "total_revenue", "total_cost", *AVG3], 4, DAILY),
        "order_line_counts": q(
            f"""SELECT *, row_number() OVER (PARTITION BY category_column ORDER BY order_lines DESC, category_value) AS k
FROM (SELECT category_column, category_value, count(*) AS order_lines FROM ({by_category('1')}) GROUP BY 1, 2)""",
            ["category_column", "category_value", "order_lines"],
            [],
            tail=" WHERE k <= 10",
        ),
        "channel_region_counts": q(
            """SELECT 'order_channel' AS dimension, order_channel AS value, count(*) AS order_lines FROM ol GROUP BY 2
UNION ALL
SELECT * FROM (SELECT 'order_region', order_region, count(*) AS n FROM ol GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)""",
            ["dimension", "value", "order_lines"],
            [],
        ),
        "daily_totals": q(
            "SELECT * FROM daily",
            ["order_date"],
            ["line_volume_cbm", "line_product_revenue", "line_freight_revenue", "line_product_cost",
             "line_freight_cost", "total_revenue", "total_cost", *AVG3],
            ctes=DAILY,
        ),
        "histogram": histogram("ol", "line_volume_cbm", 50),
        "customer_features": q(
            CUSTOMERS,
            ["customer_name", "order_count", "customer_lifetime_days"],
            ["total_product_revenue", "total_freight_revenue", "total_volume", "avg_order_value",
             "purchase_frequency", "clv"],
        ),
        "customer_total_value": q(
            f"SELECT {KEY}, customer_name, customer_total_value FROM ol JOIN customer_totals USING (customer_name)",
            [KEY, "customer_name"],
            ["customer_total_value"],
            ctes=CUSTOMER_TOTALS,
        ),
        "value_tertiles": q(
            "SELECT * FROM tertiles",
            ["customer_name", "order_lines", "customer_group"],
            ["customer_total_value"],
            ctes=CUSTOMER_TOTALS,
        ),
        "customer_group_channel": q(
            f"SELECT customer_group, order_channel, {VALUE_AND_MARGIN} FROM ol JOIN tertiles USING (customer_name) GROUP BY 1, 2",
            ["customer_group", "order_channel", "order_count"],
            value_margin,
            ctes=CUSTOMER_TOTALS,
        ),
        "rolling_7": q(
            f"""SELECT {KEY}, customer_name, order_date,
       avg(line_product_revenue) OVER w AS avg_line_product_revenue_7d,
       avg(line_freight_cost) OVER w AS avg_line_freight_cost_7d
FROM ol WINDOW w AS (PARTITION BY customer_name ORDER BY order_date, {KEY} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
            [KEY, "customer_name", "order_date"],
            ["avg_line_product_revenue_7d", "avg_line_freight_cost_7d"],
        ),
        "product_performance": q(PRODUCT_TABLE, PRODUCT_KEYS, PRODUCT_DOUBLES),
        "top_products": q(
            f"SELECT * FROM ({PRODUCT_TABLE}) ORDER BY total_profit DESC, item_number LIMIT 10", PRODUCT_KEYS, PRODUCT_DOUBLES
        ),
        "bottom_products": q(
            f"SELECT * FROM ({PRODUCT_TABLE}) ORDER BY total_profit, item_number LIMIT 10", PRODUCT_KEYS, PRODUCT_DOUBLES
        ),
        "product_contributions": q(
            f"""SELECT i.*, i.total_profit / nullif(t.total_profit, 0) * 100 AS profit_contribution,
       i.total_revenue / nullif(t.total_revenue, 0) * 100 AS revenue_contribution
FROM (SELECT item_number, {sums('total_profit', 'total_revenue')} FROM ol GROUP BY item_number) i,
     (SELECT {sums('total_profit', 'total_revenue')} FROM ol) t""",
            ["item_number"],
            ["total_profit", "total_revenue", "profit_contribution", "revenue_contribution"],
        ),
        "margin_sum_by_category": q(
            f"""SELECT category_column, category_value, sum(delivered_margin) AS delivered_margin_sum
FROM ({by_category('delivered_margin')}) GROUP BY 1, 2""",
            ["category_column", "category_value"],
            ["delivered_margin_sum"],
            4,
        ),
        "price_variance": q(
            f"""SELECT item_number, line_product_revenue / line_quantity AS avg_price, price_variance, line_quantity,
       price_variance * line_quantity AS volume_price_score, total_profit
FROM (SELECT *, CASE WHEN n > 1 AND m <> 0 THEN v / m ELSE 0 END AS price_variance FROM ({price_points}))
ORDER BY volume_price_score DESC, item_number LIMIT 10""",
            ["item_number"],
            ["avg_price", "price_variance", "line_quantity", "volume_price_score", "total_profit"],
        ),
        "monthly_product": q(profit_table("month, item_number"), ["month", "item_number"], PROFIT_DOUBLES),
        "monthly_top_products": q(
            profit_table("month, item_number", f"WHERE item_number IN ({top_items})"),
            ["month", "item_number"],
            PROFIT_DOUBLES,
        ),
        "seasonal_performance": q(
            f"""SELECT *, line_product_revenue + line_freight_revenue AS total_revenue,
       line_product_cost + line_freight_cost AS total_cost FROM ({profit_table('season')})""",
            ["season"],
            [*PROFIT_DOUBLES, "total_revenue", "total_cost"],
        ),
        "season_products": q(
            f"""SELECT *, row_number() OVER (PARTITION BY season ORDER BY total_profit DESC, item_number) AS k
FROM ({profit_table('season, item_number')})""",
            ["season", "item_number"],
            PROFIT_DOUBLES,
            tail=" WHERE k <= 3",
        ),
        "price_elasticity": q("SELECT * FROM elasticities", ["item_number"], ["price_elasticity"], ctes=PRICE_STEPS),
        "freight_elasticity": q(
            "SELECT * FROM elasticities", ["item_number"], ["freight_revenue_elasticity"], ctes=FREIGHT_STEPS
        ),
        "elasticity_with_margin": q(
            "SELECT * FROM with_margin", ["item_number"], ["price_elasticity", "avg_delivered_margin"], ctes=PRICE_STEPS
        ),
        "elasticity_extremes": q(
            """SELECT * FROM (SELECT *, 'top' AS "end" FROM with_margin ORDER BY avg_delivered_margin DESC, item_number LIMIT 10)
UNION ALL
SELECT * FROM (SELECT *, 'bottom' FROM with_margin ORDER BY avg_delivered_margin, item_number LIMIT 10)""",
            ["item_number", '"end"'],
            ["price_elasticity", "avg_delivered_margin"],
            ctes=PRICE_STEPS,
        ),
        "freight_elasticity_bottom": q(
            "SELECT * FROM with_margin ORDER BY avg_delivered_margin, item_number LIMIT 10",
            ["item_number"],
            ["freight_revenue_elasticity", "avg_delivered_margin"],
            ctes=FREIGHT_STEPS,
        ),
        "top_revenue_elasticity": q(
            f"""SELECT b.*, price_elasticity
FROM (SELECT item_number, {sums('line_product_revenue')} FROM ol GROUP BY item_number
      ORDER BY line_product_revenue DESC, item_number LIMIT 10) b LEFT JOIN elasticities USING (item_number)""",
            ["item_number"],
            ["line_product_revenue", "price_elasticity"],
            ctes=PRICE_STEPS,
        ),
        "channel_performance": q(
            "SELECT * FROM channels",
            ["order_channel", "order_count", "customer_count"],
            [*MONEY, *AVG3, "total_revenue", "total_profit", "avg_order_value"],
            ctes=CHANNELS,
        ),
        "region_channel": q(region_channel, ["order_region", "order_channel", "order_count"], value_margin),
        "region_channel_top": q(
            f"{region_channel} ORDER BY order_count DESC, order_region, order_channel LIMIT 5",
            ["order_region", "order_channel", "order_count"],
            value_margin,
        ),
        "region_channel_top_regions": q(
            f"SELECT * FROM ({region_channel}) WHERE order_region IN ({top_regions})",
            ["order_region", "order_channel", "order_count"],
            value_margin,
        ),
        "category_channel": q(
            f"""SELECT category_1, order_channel, count(*) AS order_count, avg(total_revenue) AS avg_order_value, {MARGIN_MEANS}
FROM ol GROUP BY 1, 2""",
            ["category_1", "order_channel", "order_count"],
            ["avg_order_value", *AVG3],
        ),
        "monthly_channel": q(monthly_channel, ["month", "order_channel", "order_count"], value_margin),
        "monthly_channel_latest": q(
            f"{monthly_channel} ORDER BY month DESC, order_channel LIMIT 12",
            ["month", "order_channel", "order_count"],
            value_margin,
        ),
        "channel_efficiency": q(
            """SELECT *, order_count / nullif(avg_volume_cbm, 0) AS orders_per_volume
FROM (SELECT order_channel, count(*) AS order_count, avg(line_quantity) AS avg_quantity,
             avg(line_volume_cbm) AS avg_volume_cbm, avg(delivered_margin) AS avg_delivered_margin
      FROM ol GROUP BY order_channel)""",
            ["order_channel", "order_count"],
            ["avg_quantity", "avg_volume_cbm", "avg_delivered_margin", "orders_per_volume"],
        ),
        "improvement_areas": q(
            """SELECT order_channel, 'delivered_margin' AS area, avg_delivered_margin AS channel_value,
       format('Below average delivered margin ({:.2f}%)', avg_delivered_margin) AS finding
FROM channels WHERE avg_delivered_margin < (SELECT avg(avg_delivered_margin) FROM channels)
UNION ALL
SELECT order_channel, 'order_value', avg_order_value, format('Below average order value (${:.2f})', avg_order_value)
FROM channels WHERE avg_order_value < (SELECT avg(avg_order_value) FROM channels)""",
            ["order_channel", "area", "finding"],
            ["channel_value"],
            ctes=CHANNELS,
        ),
        "agreement_analysis": q(
            """SELECT *, total_revenue / order_count AS avg_order_value, total_revenue / customer_count AS revenue_per_customer
FROM agreements""",
            ["customer_agreement", "customer_count", "order_count"],
            ["total_revenue", *AVG3, "avg_order_value", "revenue_per_customer"],
            ctes=AGREEMENTS,
        ),
        "agreement_pricing": q(
            f"""SELECT *, line_product_revenue / nullif(line_quantity, 0) AS avg_price
FROM (SELECT customer_agreement, {sums('line_product_revenue', 'line_quantity')} FROM ol GROUP BY 1)""",
            ["customer_agreement"],
            ["line_product_revenue", "line_quantity", "avg_price"],
        ),
        "agreement_profitability": q(
            "SELECT *, total_revenue * avg_delivered_margin / 100 AS profit FROM agreements",
            ["customer_agreement"],
            ["total_revenue", "avg_delivered_margin", "profit"],
            4,
            AGREEMENTS,
        ),
        "monthly_agreement": q(
            f"{monthly_agreement} GROUP BY 1, 2", ["month", "customer_agreement"], ["total_revenue", "avg_delivered_margin"]
        ),
        "monthly_agreement_latest": q(
            f"{monthly_agreement} GROUP BY 1, 2 ORDER BY month DESC, customer_agreement LIMIT 30",
            ["month", "customer_agreement"],
            ["total_revenue", "avg_delivered_margin"],
        ),
        "monthly_agreement_top": q(
            f"{monthly_agreement} WHERE customer_agreement IN ({top_agreements}) GROUP BY 1, 2",
            ["month", "customer_agreement"],
            ["total_revenue", "avg_delivered_margin"],
        ),
        "low_freight_margin_agreements": q(
            "SELECT * FROM agreements WHERE avg_freight_margin < (SELECT median(avg_freight_margin) FROM agreements)",
            ["customer_agreement"],
            ["avg_freight_margin", "total_revenue"],
            ctes=AGREEMENTS,
        ),
        "pricing_variation": q(
            """SELECT *, price_std / mean_price AS coefficient_of_variation
FROM (SELECT customer_agreement, avg(avg_price) AS mean_price, stddev_samp(avg_price) AS price_std FROM ol GROUP BY 1)
ORDER BY coefficient_of_variation DESC, customer_agreement LIMIT 10""",
            ["customer_agreement"],
            ["mean_price", "price_std", "coefficient_of_variation"],
        ),
        "renegotiation_candidates": q(
            """SELECT *, revenue_rank - margin_rank AS renegotiation_score
FROM (SELECT customer_agreement, total_revenue, avg_delivered_margin,
             rank() OVER (ORDER BY total_revenue DESC)
               + (count(*) OVER (PARTITION BY total_revenue) - 1) / CAST(2 AS DOUBLE) AS revenue_rank,
             rank() OVER (ORDER BY avg_delivered_margin DESC)
               + (count(*) OVER (PARTITION BY avg_delivered_margin) - 1) / CAST(2 AS DOUBLE) AS margin_rank
      FROM agreements)
ORDER BY renegotiation_score, customer_agreement LIMIT 10""",
            ["customer_agreement"],
            ["total_revenue", "avg_delivered_margin", "revenue_rank", "margin_rank", "renegotiation_score"],
            ctes=AGREEMENTS,
        ),
        "order_summary": q(
            "SELECT * FROM order_totals",
            ["order_number", "order_region"],
            ["line_volume_cbm", "line_freight_cost", "line_freight_revenue", "freight_cost_per_cbm"],
            ctes=FREIGHT,
        ),
        "region_freight": q(
            "SELECT * FROM regions",
            ["order_region"],
            ["avg_line_volume_cbm", "avg_line_freight_cost", "avg_freight_cost_per_cbm"],
            ctes=FREIGHT,
        ),
        "region_freight_top": q(
            "SELECT * FROM regions ORDER BY avg_freight_cost_per_cbm DESC, order_region LIMIT 5",
            ["order_region"],
            ["avg_line_volume_cbm", "avg_line_freight_cost", "avg_freight_cost_per_cbm"],
            ctes=FREIGHT,
        ),
        "consolidated_orders": q(
            "SELECT * FROM consolidated",
            ["order_day", "order_region", "order_count"],
            ["line_volume_cbm", "line_freight_cost", "freight_cost_per_cbm"],
            ctes=FREIGHT,
        ),
        "consolidation_savings": q(
            """SELECT *, (1 - avg_cost_consolidated / avg_cost_unconsolidated) * 100 AS savings_percentage
FROM (SELECT (SELECT avg(freight_cost_per_cbm) FROM order_totals) AS avg_cost_unconsolidated,
             (SELECT avg(freight_cost_per_cbm) FROM consolidated) AS avg_cost_consolidated)""",
            [],
            ["avg_cost_unconsolidated", "avg_cost_consolidated", "savings_percentage"],
            ctes=FREIGHT,
        ),
        "consolidation_by_region": q("SELECT * FROM by_region", ["order_region"], BY_REGION, ctes=FREIGHT),
        "consolidation_top_regions": q(
            "SELECT * FROM by_region ORDER BY savings_percentage DESC, order_region LIMIT 5",
            ["order_region"],
            BY_REGION,
            ctes=FREIGHT,
        ),
        "item_sales_stats": q("SELECT * FROM item_sales", ["item_number"], ITEM_SALES_DOUBLES, ctes=ITEM_SALES),
        "slow_moving": q(stock + "avg_monthly_sales < slow", ["item_number"], ITEM_SALES_DOUBLES, ctes=stock_cut),
        "slow_moving_report": q(
            stock + "avg_monthly_sales < slow ORDER BY avg_monthly_sales, item_number LIMIT 5",
            ["item_number"],
            ITEM_SALES_DOUBLES,
            ctes=stock_cut,
        ),
        "overstocked": q(
            stock + "avg_monthly_sales < med AND total_sales > q75", ["item_number"], ITEM_SALES_DOUBLES, ctes=stock_cut
        ),
        "understocked": q(
            stock + "avg_monthly_sales > med AND total_sales < q25", ["item_number"], ITEM_SALES_DOUBLES, ctes=stock_cut
        ),
        "profitability_by_item": q(item_profit, ["item_number"], ["line_quantity", *PROFITABILITY]),
        "profitability_by_category": q(profitability("category_1"), ["category_1"], ["line_quantity", *PROFITABILITY]),
        "profitability_by_customer": q(profitability("customer_name"), ["customer_name", "order_count"], PROFITABILITY),
        "profitability_by_region": q(profitability("order_region"), ["order_region", "order_count"], PROFITABILITY),
        "profitability_extremes": q(
            f"""SELECT * FROM (SELECT *, 'top' AS "end" FROM ({item_profit}) ORDER BY total_profit DESC, item_number LIMIT 10)
UNION ALL
SELECT * FROM (SELECT *, 'bottom' FROM ({item_profit}) ORDER BY total_profit, item_number LIMIT 10)""",
            ["item_number", '"end"'],
            ["line_quantity", *PROFITABILITY],
        ),
        "margin_volume_flags": q(
            """SELECT *, CASE WHEN profit_margin < pm AND line_quantity > q75 THEN 'low_margin_high_volume'
               WHEN profit_margin > pm AND line_quantity < q25 THEN 'high_margin_low_volume' END AS flag
FROM items, cut""",
            ["item_number", "flag"],
            ["line_quantity", *PROFITABILITY],
            ctes=flags,
            tail=" WHERE flag IS NOT NULL",
        ),
        "monthly_margin": q(
            """SELECT category_1, last_day(order_date) AS month_end, avg(delivered_margin) AS avg_delivered_margin
FROM ol GROUP BY 1, 2""",
            ["category_1", "month_end"],
            ["avg_delivered_margin"],
        ),
        "monthly_margin_selected": q(
            """SELECT last_day(order_date) AS month_end,
       avg(CASE WHEN order_channel = '1-URGENT' THEN freight_margin END) AS urgent,
       avg(CASE WHEN order_channel = '2-HIGH' THEN freight_margin END) AS high
FROM ol WHERE order_channel IN ('1-URGENT', '2-HIGH') GROUP BY 1""",
            ["month_end"],
            ["urgent", "high"],
        ),
        "overall_monthly_margin": q(
            """SELECT category_2, avg(m) AS overall_average
FROM (SELECT category_2, month, avg(product_margin) AS m FROM ol GROUP BY 1, 2) GROUP BY 1""",
            ["category_2"],
            ["overall_average"],
        ),
        "margin_swings": swings("category_1", "total_revenue", "total_cost"),
        "margin_swings_product": swings("category_2", "line_product_revenue", "line_product_cost"),
        "margin_swings_freight": swings("item_number", "line_freight_revenue", "line_freight_cost"),
        "negative_margins": negatives("item_number", "delivered_margin", "total_revenue", "total_cost"),
        "negative_margins_product": negatives(
            "category_3", "product_margin", "line_product_revenue", "line_product_cost"
        ),
        "negative_margins_freight": negatives(
            "order_region", "freight_margin", "line_freight_revenue", "line_freight_cost"
        ),
        "dimension_values": q(
            "\nUNION\n".join(f"SELECT '{d}' AS dimension, {d} AS value FROM ol" for d in DIMENSIONS),
            ["dimension", "value"],
            [],
        ),
        "feature_f_scores": q(
            """SELECT customer_agreement AS feature, r2 / (1 - r2) * (n - 2) AS importance
FROM (SELECT customer_agreement, n, k * (m - mean) * (m - mean) / ((n - k) * var) AS r2
      FROM (SELECT customer_agreement, count(*) AS k, avg(delivered_margin) AS m FROM ol GROUP BY 1),
           (SELECT count(*) AS n, avg(delivered_margin) AS mean, var_pop(delivered_margin) AS var FROM ol))""",
            ["feature"],
            ["importance"],
        ),
        "numeric_f_score": q(
            """SELECT 'line_volume_cbm' AS feature, r * r / (1 - r * r) * (n - 2) AS importance
FROM (SELECT corr(line_volume_cbm, delivered_margin) AS r, count(*) AS n FROM ol)""",
            ["feature"],
            ["importance"],
        ),
        "negative_margin_lines": q(
            "SELECT * FROM ol WHERE order_number IN (SELECT order_number FROM ol WHERE delivered_margin < 0)",
            [KEY, "order_number"],
            [],
        ),
        "loss_orders": LOSS_ORDERS,
        "loss_order_count": q(
            "SELECT count(DISTINCT order_number) AS order_count FROM ol WHERE delivered_margin < 0", ["order_count"], []
        ),
        "mean_margin_by_agreement": q(
            "SELECT customer_agreement, avg(delivered_margin) AS avg_delivered_margin FROM ol GROUP BY 1",
            ["customer_agreement"],
            ["avg_delivered_margin"],
        ),
        "bottom_categories": q(
            f"""SELECT *, row_number() OVER (PARTITION BY category_column ORDER BY avg_delivered_margin, category_value) AS k
FROM (SELECT category_column, category_value, avg(delivered_margin) AS avg_delivered_margin
      FROM ({by_category('delivered_margin')}) GROUP BY 1, 2)""",
            ["category_column", "category_value"],
            ["avg_delivered_margin"],
            tail=" WHERE k <= 5",
        ),
        "item_drilldown": drilldown("item_number", ITEM_LISTS),
        "item_drilldown_members": q(
            "\nUNION\n".join(
                f"SELECT category_column, category_value, item_number, '{m}' AS member_column, {m} AS member "
                f"FROM ({by_category('item_number, ' + m)})"
                for m in ITEM_LISTS
            ),
            [*DRILL_KEYS, "member_column", "member"],
            [],
        ),
        "agreement_drilldown": drilldown("customer_agreement", ["item_number"]),
        "category_overall_margin": q(
            f"""SELECT *, format('Overall delivered margin: {{:.2f}}%', avg_delivered_margin) AS overall_margin
FROM (SELECT category_column, category_value, avg(delivered_margin) AS avg_delivered_margin
      FROM ({by_category('delivered_margin')}) GROUP BY 1, 2)""",
            ["category_column", "category_value", "overall_margin"],
            ["avg_delivered_margin"],
        ),
        "drilldown_catalog": q(
            f"SELECT DISTINCT category_column, category_value FROM ({by_category('1')})",
            ["category_column", "category_value"],
            [],
        ),
        "read_drilldown": q(
            "SELECT * FROM drill WHERE category_column = 'category_1'",
            [*DRILL_KEYS, *ITEM_LISTS],
            DRILL_DOUBLES,
            ctes=ITEM_DRILLDOWN,
        ),
        "lowest_items": q(
            """SELECT *, row_number() OVER (PARTITION BY category_column, category_value
                                     ORDER BY delivered_margin, item_number) AS k FROM drill""",
            DRILL_KEYS,
            ["delivered_margin"],
            ctes=ITEM_DRILLDOWN,
            tail=" WHERE k <= 10",
        ),
        "lowest_agreements": lowest("customer_agreement"),
        "lowest_regions": lowest("order_region"),
        "correlation_matrix": q(correlations, ["metric_a", "metric_b"], ["r"]),
        "anova_channel": anova("order_channel"),
        "anova_agreement": anova("customer_agreement"),
        "linear_fit": linear_fit("ol", "line_volume_cbm", "line_freight_cost", KEY, 4),
        "seasonal_decompose": q(
            """SELECT series_key, position, order_date, value, trend, seasonal, value - trend - seasonal AS residual
FROM placed JOIN (SELECT series_key, position, a - avg(a) OVER (PARTITION BY series_key) AS seasonal
                  FROM (SELECT series_key, position, avg(value - trend) AS a FROM placed GROUP BY 1, 2))
     USING (series_key, position)""",
            ["series_key", "position", "order_date"],
            ["value", "trend", "seasonal", "residual"],
            ctes=f"""{DAILY},
{SERIES},
placed AS (
  SELECT series_key, order_date, value,
         CAST((row_number() OVER (PARTITION BY series_key ORDER BY order_date) - 1) % 7 AS INTEGER) AS position,
         CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS trend
  FROM series
  WINDOW w AS (PARTITION BY series_key ORDER BY order_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))""",
        ),
        "monthly_revenue": q("SELECT * FROM monthly", ["month"], ["total_revenue"], ctes=MONTHLY),
        "revenue_lag": q("SELECT * FROM lagged", ["month"], ["total_revenue", "prev_month_revenue"], ctes=MONTHLY),
        "next_month_model": linear_fit("lagged", "prev_month_revenue", "total_revenue", "month", 2, MONTHLY),
        "demand_cells": q(
            "SELECT * FROM cells",
            ["month", "day_of_week", "order_channel", "order_region"],
            ["avg_price", "avg_quantity", "log_price", "log_quantity"],
            ctes=CELLS,
        ),
        "log_log_elasticity": q(
            "SELECT regr_slope(log_quantity, log_price) AS slope FROM cells", [], ["slope"], ctes=CELLS
        ),
        "price_grid": q("SELECT * FROM grid", ["size", "step"], ["price", "demand", "profit"], ctes=GRID),
        "price_range": q(
            """SELECT min(l) AS lower_price, max(u) AS upper_price, arg_min(size, s) AS best_size, min(s) AS profit_std
FROM (SELECT size, min(price) AS l, max(price) AS u, stddev_samp(profit) AS s FROM grid GROUP BY size)""",
            ["best_size"],
            ["lower_price", "upper_price", "profit_std"],
            ctes=GRID,
        ),
        "recommend_freight_price": q(
            "SELECT * FROM halved",
            [KEY],
            ["line_product_cost", "product_revenue", "predicted_freight_cost", "freight_revenue"],
            ctes=RECOMMENDED,
        ),
        "target_gap": q(
            f"""SELECT {KEY},
       CASE WHEN product_revenue = 0 THEN 0 ELSE (product_revenue - line_product_cost) / product_revenue END
         - CAST(0.492 AS DOUBLE) AS product_margin_gap,
       (freight_revenue - predicted_freight_cost) / freight_revenue + CAST(0.1501 AS DOUBLE) AS freight_margin_gap,
       (product_revenue + freight_revenue - (line_product_cost + predicted_freight_cost))
         / (product_revenue + freight_revenue) - CAST(0.4541 AS DOUBLE) AS delivered_margin_gap
FROM halved""",
            [KEY],
            ["product_margin_gap", "freight_margin_gap", "delivered_margin_gap"],
            ctes=RECOMMENDED,
        ),
        "price_scenarios": q("SELECT * FROM best", [KEY, "step"], market_best, ctes=SCENARIOS),
        "scenario_summary": q(
            """SELECT step, avg(margin_rate) AS avg_margin_rate, sum(new_quantity) AS total_quantity, avg(profit) AS avg_profit
FROM scenario_rows GROUP BY step""",
            ["step"],
            ["avg_margin_rate", "total_quantity", "avg_profit"],
            4,
            SCENARIOS,
        ),
        "dataset_stats": q(
            """SELECT avg(total_profit) AS avg_profit, stddev_samp(total_profit) AS std_profit,
       avg(line_quantity) AS avg_quantity, avg(line_freight_cost) AS avg_freight_price FROM ol""",
            [],
            ["avg_profit", "std_profit", "avg_quantity", "avg_freight_price"],
        ),
        "segment_multipliers": q(
            "SELECT * FROM segment_margins", ["customer_segment"], ["segment_multiplier"], ctes=SEGMENTS
        ),
        "month_multipliers": q("SELECT * FROM month_margins", ["month"], ["month_multiplier"], ctes=SEGMENTS),
        "scenario_score": q(
            f"""SELECT ol.{KEY},
       greatest(-10, least(10, total_profit / avg_profit * (new_quantity / avg_quantity)
         * (1 + (delivered_margin - new_price) / new_price) * segment_multiplier * month_multiplier)) AS score
FROM ol JOIN best ON ol.{KEY} = best.{KEY} JOIN tertiles USING (customer_name)
     JOIN segment_margins ON customer_group = customer_segment
     JOIN month_margins ON month(order_date) = month_margins.month,
     (SELECT avg(total_profit) AS avg_profit, avg(line_quantity) AS avg_quantity FROM ol)""",
            [KEY],
            ["score"],
            ctes=f"{SCENARIOS},\n{SEGMENTS}",
        ),
        "train_test_split": q(
            f"""SELECT {KEY}, CAST(CAST('0x' || substr(md5({KEY}), 1, 6) AS BIGINT) % 100 < 80 AS INTEGER) AS is_train
FROM ol""",
            [KEY, "is_train"],
            [],
        ),
        "category_codes": q(
            f"SELECT {KEY}, "
            + ", ".join(
                f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_code"
                for c in CODED
            )
            + " FROM ol",
            [KEY, *(f"{c}_code" for c in CODED)],
            [],
        ),
        "target_encode": q(
            f"SELECT {KEY}, "
            + ", ".join(
                f"avg(delivered_margin) OVER (PARTITION BY {c}) AS {c}_encoded" for c in ("customer_agreement", *CATEGORIES)
            )
            + " FROM ol",
            [KEY],
            [f"{c}_encoded" for c in ("customer_agreement", *CATEGORIES)],
        ),
        "segment_features": q(
            f"""SELECT customer_name, {sums('total_revenue', 'line_quantity')}, avg(delivered_margin) AS avg_delivered_margin,
       avg(product_margin) AS avg_predicted_margin FROM ol GROUP BY customer_name""",
            ["customer_name"],
            ["total_revenue", "line_quantity", "avg_delivered_margin", "avg_predicted_margin"],
        ),
        "histogram_clv": histogram(
            "clvs",
            "clv",
            20,
            f"""clvs AS (
  SELECT greatest(r / n * (n / CAST(d AS DOUBLE)) * d, 0) AS clv
  FROM (SELECT {es('line_product_revenue')} + {es('line_freight_revenue')} AS r, count(*) AS n,
               date_diff('day', min(order_date), max(order_date)) + 1 AS d
        FROM ol GROUP BY customer_name))""",
        ),
        "histogram_freight_cost": histogram("order_totals", "freight_cost_per_cbm", 30, FREIGHT),
        "regression_metrics": q(
            """SELECT avg(e * e) AS mse, avg(abs(e)) AS mae, 1 - avg(e * e) / nullif(var_pop(line_freight_cost), 0) AS r2
FROM (SELECT line_freight_cost, line_freight_cost - (50 + 2500 * line_volume_cbm) AS e FROM ol)""",
            [],
            ["mse", "mae", "r2"],
        ),
        "order_describe": describe(
            "order_totals", ["line_volume_cbm", "line_freight_cost", "line_freight_revenue", "freight_cost_per_cbm"], ctes=FREIGHT
        ),
    }


TRAIN = f"CAST('0x' || substr(md5({KEY}), 1, 6) AS BIGINT) % 100 < 80"
FOLD = f"CAST('0x' || substr(md5({KEY}), 7, 6) AS BIGINT) % 5"
# By model: what it learns, and from which numbers.
LINE_MODELS = {
    "line_freight_cost": ("line_freight_cost", ("line_volume_cbm", "line_quantity", "line_product_cost")),
    "delivered_margin": (
        "greatest(least(delivered_margin, 1), -1)", ("line_volume_cbm", "line_quantity", "line_product_cost", "line_freight_revenue"),
    ),
    "total_profit": ("total_profit", MEASURES),
    "line_quantity": ("line_quantity", tuple(m for m in MEASURES if m != "line_quantity")),
}
SCORES = "avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, 1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0) AS r2"


def line_model(name: str, learn: str) -> str:
    label, numbers = LINE_MODELS[name]
    rows = f"{name}_model_rows AS (SELECT *, '{name}' AS target, CAST({label} AS DOUBLE) AS y, {learn} AS learn FROM ol)"
    return f"{rows},\n{ridge(f'{name}_model', numbers, CODED)}"


def line_model_scores(*names: str) -> str:
    ctes = ",\n".join(line_model(n, TRAIN) for n in names)
    scores = " UNION ALL ".join(f"SELECT '{n}' AS label, {SCORES} FROM {n}_model_scored WHERE NOT learn" for n in names)
    return q(scores, ["label"], ["mse", "mae", "r2"], 4, ctes)


def regressions_sql() -> dict[str, str]:
    categories = (*CATEGORIES, "item_number", "order_channel", "order_region")
    folds = f"""cv_rows AS MATERIALIZED (
  SELECT *, CASE WHEN t = 0 THEN 'whole' ELSE 'fold' || (t - 1) END AS target, delivered_margin AS y, is_train AND (t = 0 OR fold <> t - 1) AS learn
  FROM (SELECT *, {TRAIN} AS is_train, {FOLD} AS fold FROM ol), range(6) AS targets(t)),
"""
    fitted = folds + ridge("cv", MEASURES, categories)
    predicted = [f"predicted_{n}" for n in LINE_MODELS]
    joined = " ".join(f"JOIN (SELECT {KEY}, p AS predicted_{n} FROM {n}_model_scored) USING ({KEY})" for n in LINE_MODELS)
    return {
        "margin_regressor_cv": q(
            f"""SELECT avg(CASE WHEN fold IS NOT NULL THEN r2 END) AS cv_r2_mean, stddev_pop(CASE WHEN fold IS NOT NULL THEN r2 END) AS cv_r2_std,
       max(CASE WHEN fold IS NULL THEN mse END) AS mse, max(CASE WHEN fold IS NULL THEN mae END) AS mae, max(CASE WHEN fold IS NULL THEN r2 END) AS r2
FROM (SELECT CASE WHEN is_train THEN fold END AS fold, {SCORES} FROM cv_scored
      WHERE CASE WHEN is_train THEN t = fold + 1 ELSE t = 0 END GROUP BY 1)""",
            [],
            ["cv_r2_mean", "cv_r2_std", "mse", "mae", "r2"],
            ctes=fitted,
        ),
        "margin_regressor_importance": q(
            f"{slope_sizes('cv', MEASURES, 'whole')} UNION ALL {mean_effects('cv', categories, 'whole')}",
            ["feature"],
            ["importance"],
            ctes=fitted,
        ),
        "profit_and_quantity_models": line_model_scores("total_profit", "line_quantity"),
        "freight_and_margin_models": line_model_scores("line_freight_cost", "delivered_margin"),
        "line_predictions": q(
            f"SELECT {KEY}, {', '.join(predicted)} FROM (SELECT {KEY} FROM ol) {joined}",
            [KEY],
            predicted,
            4,
            ",\n".join(line_model(n, "true") for n in LINE_MODELS),
        ),
    }


def oracle_sql() -> dict[str, str]:
    plain = whole_lines_sql() | clusters_sql() | regressions_sql()
    categories = ("category_column", "category_value")
    gaps = {
        "monthly_margin_gaps": gapped(
            q(
                """SELECT category_2, last_day(order_date) AS month_end, avg(delivered_margin) AS avg_delivered_margin
FROM ol GROUP BY 1, 2""",
                ["category_2", "month_end"],
                ["avg_delivered_margin"],
            ),
            "category_2",
        ),
        "margin_swings_gaps": gapped(plain["margin_swings_product"], "category_2"),
        "negative_margins_gaps": gapped(plain["negative_margins"], "item_number"),
        "negative_margin_lines_gaps": gapped(plain["negative_margin_lines"], "order_number"),
        "loss_orders_gaps": gapped(LOSS_ORDERS, "order_number"),
        "mean_margin_by_agreement_gaps": gapped(plain["mean_margin_by_agreement"], "customer_agreement"),
        "bottom_categories_gaps": gapped(
            plain["bottom_categories"].replace("GROUP BY 1, 2", "WHERE category_value IS NOT NULL GROUP BY 1, 2"), *categories
        ),
        "item_drilldown_gaps": gapped(plain["item_drilldown"], *categories),
        "agreement_drilldown_gaps": gapped(plain["agreement_drilldown"], *categories),
    }
    return plain | gaps

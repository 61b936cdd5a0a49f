"""Hand-made order lines: every row starts from the same plain line."""

from __future__ import annotations

import datetime as dt

from tallyline.schema import LINE_KEY, ORDER_LINES

PLAIN = {
    "order_number": "o1",
    "order_date": dt.date(2024, 1, 1),
    "customer_name": "c1",
    "customer_agreement": "a1",
    "order_channel": "web",
    "order_region": "north",
    "category_1": "x",
    "category_2": "y",
    "category_3": "z",
    "item_number": "i1",
    "line_quantity": 2.0,
    "line_volume_cbm": 0.5,
    "line_product_revenue": 100.0,
    "line_product_cost": 60.0,
    "line_freight_revenue": 20.0,
    "line_freight_cost": 10.0,
}


def lines(spark, *rows: dict):
    """Order lines from the plain line with some columns replaced."""
    data = []
    for i, changes in enumerate(rows):
        row = {LINE_KEY: f"k{i:05d}", **PLAIN, **changes}
        data.append(tuple(row[f.name] for f in ORDER_LINES))
    return spark.createDataFrame(data, ORDER_LINES)


def by(df, key: str) -> dict:
    return {r[key]: r for r in df.collect()}

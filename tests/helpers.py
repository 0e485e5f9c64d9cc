"""Small bar tables from plain lists."""

from __future__ import annotations

from datetime import datetime, timedelta

from tidegauge.operators.features import numbered


def bars(spark, close, high=None, low=None, start=datetime(2024, 1, 1), symbol="X", **columns):
    rows = []
    for i, c in enumerate(close):
        row = [symbol, start + timedelta(days=i), c, (high or close)[i], (low or close)[i], c, 1.0]
        rows.append((*row, *(v[i] for v in columns.values())))
    kinds = {float: "double", int: "double", str: "string", bool: "boolean"}
    extra = "".join(f", {n} {kinds[type(next((x for x in v if x is not None), 0.0))]}" for n, v in columns.items())
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double" + extra
    return numbered(spark.createDataFrame([tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in rows], schema))


def column(df, name):
    return [r[0] for r in df.orderBy("symbol", "ts").select(name).collect()]

"""Comparing tables without regard to order and number types."""

import pandas as pd

TINY = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "isoformat"):
        return str(value).replace("T", " ")[:19]
    return value


def table(df) -> list:
    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in row) for row in df[cols].itertuples(index=False)), key=repr)

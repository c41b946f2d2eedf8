"""Rows of two results in one form, to be compared without order."""

import math

import pandas as pd


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if type(x).__name__ == "Decimal":
        x = float(x)
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.9g}"
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False, name=None))

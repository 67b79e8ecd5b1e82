"""Small bars for tests."""

import datetime

import numpy as np
import pandas as pd

SCHEMA = "symbol string, session date, open double, high double, low double, close double, volume double"


def series(symbol, n, seed, start="2020-01-01", nulls=0, flat=0.2):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range(start, periods=n)
    c = 100 * np.exp(np.cumsum(rng.standard_t(4, n) * 0.013))
    o = c * (1 + rng.normal(0, 0.004, n))
    h, l = np.maximum(o, c) * 1.008, np.minimum(o, c) * 0.992
    still = rng.random(n) < flat  # bars without any range
    o[still] = h[still] = l[still] = c[still]
    v = np.round(rng.lognormal(8, 0.85, n))
    df = pd.DataFrame({"symbol": symbol, "session": [d.date() for d in days], "open": o, "high": h, "low": l, "close": c, "volume": v})
    for k in rng.choice(n, nulls, replace=False):
        df.loc[k, "volume"] = None
    return df


def bars(spark, frames):
    df = pd.concat(frames, ignore_index=True)
    rows = [tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in df.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, SCHEMA)


def day(text):
    return datetime.date.fromisoformat(text)

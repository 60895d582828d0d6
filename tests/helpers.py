"""Small rasters and catalogs as DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd


def pixels(spark, grid, raster_id=1):
    """A pixel table from a 2-D array; NaN is unknown."""
    grid = np.asarray(grid, float)
    h, w = grid.shape
    frame = pd.DataFrame(
        {
            "raster_id": raster_id,
            "row": np.repeat(np.arange(h, dtype="int32"), w),
            "col": np.tile(np.arange(w, dtype="int32"), h),
        }
    )
    frame["v"] = [None if np.isnan(x) else float(x) for x in grid.reshape(-1)]
    schema = "raster_id bigint, row int, col int, v double"
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in frame.itertuples(index=False)]
    rows = [(int(a), int(b), int(c), v) for a, b, c, v in rows]
    return spark.createDataFrame(rows, schema)


def catalog(spark, w, h, x0=0.0, y0=0.0, pixel=1.0, raster_id=1, b=0.0, d=0.0, a=None, e=None):
    return spark.createDataFrame(
        [(raster_id, a if a is not None else pixel, b, x0, d, e if e is not None else -pixel, y0, w, h)],
        "raster_id bigint, a double, b double, c double, d double, e double, f double, width int, height int",
    )


def as_grid(df, name, h, w):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["row"], r["col"]] = r[name]
    return out


def filled(df):
    """A raster without gaps as its own filled form."""
    return df.selectExpr("*", "v AS filled")

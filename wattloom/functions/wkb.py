"""Points from hexadecimal well-known binary, decoded in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bit of a geometry type that says that a reference system stands before the coordinates.
_SRID = 0x20000000


def points(raw: pd.Series) -> np.ndarray:
    """(x, y) of 2D, Z or SRID points in either byte order; NaN when it is anything else. Points of one length and byte
    order are decoded together."""
    out = np.full((len(raw), 2), np.nan)
    size = raw.str.len().fillna(0).astype(int).to_numpy()
    for n in np.unique(size[size >= 21]):
        at = np.flatnonzero(size == n)
        b = np.frombuffer(b"".join(raw.iloc[at]), np.uint8).reshape(len(at), n)
        for order in "<>":
            own = b[:, 0] == 1 if order == "<" else b[:, 0] != 1
            rows, kept = at[own], b[own]
            kind = np.ascontiguousarray(kept[:, 1:5]).view(order + "u4").ravel()
            for srid in (False, True):
                first = 9 if srid else 5
                some = (kind & 0xFF == 1) & ((kind & _SRID != 0) == srid) & (n >= first + 16)
                out[rows[some]] = np.ascontiguousarray(kept[some, first : first + 16]).view(order + "f8") if some.any() else np.empty((0, 2))
    return out


def points_from_wkb(df: DataFrame, col: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with lon and lat of the points in col; nulls where the text is malformed."""

    @F.pandas_udf("lon double, lat double")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raw in parts:
            yield pd.DataFrame(points(raw), columns=["lon", "lat"])

    point = lambda c: F.nanvl(F.col(f"_point.{c}"), F.lit(None).cast("double"))
    return df.withColumn("_point", decoded(F.unhex(col))).withColumns({lon: point("lon"), lat: point("lat")}).drop("_point")

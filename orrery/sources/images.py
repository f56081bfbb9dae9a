"""Image files, decoded by Spark's own image source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, pixels) of the PNG, JPEG, BMP and GIF files at ``path``.

    ``pixels`` is height x width x 3 bytes, red first, as ``functions.image`` takes
    them; transparency is dropped and grey becomes three equal channels. A file that
    cannot be decoded has NULL height, width and pixels.
    """

    @F.pandas_udf("binary")
    def red_first(data: pd.Series, channels: pd.Series) -> pd.Series:
        out: list = []
        for d, n in zip(data, channels):
            if d is None or n not in (1, 3, 4):
                out.append(None)
                continue
            x = np.frombuffer(d, np.uint8).reshape(-1, int(n))
            out.append((np.repeat(x, 3, 1) if n == 1 else x[:, 2::-1]).tobytes())
        return pd.Series(out, dtype=object)

    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    fine = F.col("height") > 0
    return rows.select("origin", F.when(fine, F.col("height")).alias("height"), F.when(fine, F.col("width")).alias("width"), F.when(fine, red_first("data", "nChannels")).alias("pixels"))

"""Small telemetry fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 5, 1)
STEP = 300


def frame(spark, n=None, device="D1", site="S", family="pump", start=0, step=STEP, **cols):
    n = n if n is not None else len(next(iter(cols.values())))
    pdf = pd.DataFrame({"site": site, "device_id": device, "equipment_type": family, "grp": family, "ts": [T0 + dt.timedelta(seconds=start + step * i) for i in range(n)]})
    for k, v in cols.items():
        pdf[k] = np.broadcast_to(np.asarray(v, dtype=float), n)
    df = spark.createDataFrame(pdf)
    for k in cols:  # NaN stands for missing here
        df = df.withColumn(k, F.when(~F.isnan(k), F.col(k)))
    return df


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]

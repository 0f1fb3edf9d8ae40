"""Small frames for the tests."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from heliodrift.schemas import COMBINED_SCHEMA, ORDER

START = datetime(2020, 5, 15)


def combined_rows(rows, seed=0, gaps=0.3):
    """Rows in a frame of the combined schema, with gaps, sorted in total order.

    Source A holds most rows; one timestamp holds a third of them.
    """
    rng = np.random.default_rng(seed)
    source = np.where(rng.random(rows) < 0.6, "A", rng.choice(list("BCD"), rows))
    step = rng.integers(0, rows, rows)
    step[rng.random(rows) < 0.33] = rows // 2
    frame = pd.DataFrame(
        {
            "DATE_TIME": [START + timedelta(minutes=15 * int(s)) for s in step],
            "PLANT_ID": np.where(source == "A", 1, 2).astype("int32"),
            "SOURCE_KEY": source,
        }
    )
    for column in COMBINED_SCHEMA.fieldNames()[3:]:
        values = rng.integers(0, 400, rows) * 0.25
        frame[column] = np.where(rng.random(rows) < gaps, np.nan, values)
    # An own value per row settles ties the same way on both sides.
    frame["DAILY_YIELD"] = np.arange(rows, dtype=float)
    return frame.sort_values([*ORDER, "DAILY_YIELD"]).reset_index(drop=True)


def to_spark(spark, frame, schema=None):
    columns = [
        [t.to_pydatetime() for t in frame[c]]
        if c == "DATE_TIME"
        else [None if pd.isna(v) else v for v in frame[c].tolist()]
        for c in frame.columns
    ]
    rows = list(zip(*columns, strict=True))
    return spark.createDataFrame(rows, schema or COMBINED_SCHEMA)


def readings(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def collected(df, *keys):
    """Rows as tuples, sorted by the keys (all columns if none)."""
    return [tuple(r) for r in df.orderBy(*(keys or df.columns)).collect()]


def sunny_rows(days=4, seed=0):
    """Two plants with a sun that rises and sets, every 15 minutes."""
    rng = np.random.default_rng(seed)
    rows = []
    for step in range(days * 96):
        time = START + timedelta(minutes=15 * step)
        sun = max(0.0, float(np.sin(2 * np.pi * (time.hour + time.minute / 60 - 6) / 24)))
        for plant, source in ((1, "A"), (2, "B")):
            ambient = 20 + 5 * sun + rng.normal() * 0.1
            dc = 1000 * plant * sun
            rows.append(
                (time, plant, source, dc, dc * 0.96, float(step % 96), 1e5 + step, ambient, ambient + 20 * sun, sun)
            )
    return rows

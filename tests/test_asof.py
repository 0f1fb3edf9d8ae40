"""The as-of join for any wanted times against a search of all pairs."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from heliodrift.operators.asof import nearest_rows

START = datetime(2020, 5, 15)
WANTED = "id int, DATE_TIME timestamp_ntz, k string"
READINGS = "rid int, DATE_TIME timestamp_ntz, k string, v double"


def tables(seed=0, wanted=150, readings=120):
    rng = np.random.default_rng(seed)

    def time(step):
        return START + timedelta(minutes=7 * int(step), microseconds=int(step) % 3)

    keys = ["a", "a", "a", "b", None]
    asked = [(n, time(rng.integers(0, 400)), str(x) if (x := rng.choice(keys)) else None) for n in range(wanted)]
    asked += [(900, None, "a"), (901, START - timedelta(days=9), "a"), (902, START + timedelta(days=90), "b"), (903, START, "none")]
    given = [(n, time(rng.integers(0, 400) // 5 * 5), str(x) if (x := rng.choice(keys)) else None, float(n)) for n in range(readings)]
    return asked, [*given, (990, None, "a", -1.0)]


def search(asked, given, direction, tolerance):
    out = []
    for name, time, key in asked:
        found = None
        if time is not None:
            mine = [r for r in given if r[1] is not None and r[2] == key]
            after = min((r for r in mine if r[1] >= time), key=lambda r: (r[1], r[0]), default=None)
            strict = direction == "nearest"
            before = max((r for r in mine if r[1] < time or (not strict and r[1] == time)), key=lambda r: (r[1], r[0]), default=None)
            if direction != "nearest":
                found = after if direction == "forward" else before
            elif after and (not before or after[1] - time <= time - before[1]):
                found = after
            else:
                found = before
            if found and tolerance is not None and abs((found[1] - time).total_seconds()) > tolerance:
                found = None
        out.append((name, time, key, *((found[1], found[0], found[3]) if found else (None, None, None))))
    return sorted(out)


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
@pytest.mark.parametrize("layout", [{}, {"cell": "DAY"}, {"cell": "HOUR"}, {"max_rows": 30, "cell": "RANGE"}, {"max_rows": 1}])
def test_nearest_rows_equal_a_full_search(spark, direction, layout):
    asked, given = tables()
    for tolerance in (None, 900):
        found = nearest_rows(
            spark.createDataFrame(asked, WANTED).repartition(4), spark.createDataFrame(given, READINGS).repartition(3),
            ("rid", "v"), ("k",), order=("rid",), tolerance=tolerance, direction=direction, **layout,
        )
        assert found.columns == ["id", "DATE_TIME", "k", "DATE_TIME_found", "rid", "v"]
        assert sorted(map(tuple, found.collect())) == search(asked, given, direction, tolerance)


def test_one_series_over_all(spark):
    asked, given = tables(1)
    found = nearest_rows(spark.createDataFrame(asked, WANTED).drop("k"), spark.createDataFrame(given, READINGS).drop("k"), ("rid",), order=("rid",))
    wanted = search([(*r[:2], "x") for r in asked], [(*r[:2], "x", r[3]) for r in given], "nearest", None)
    assert sorted((r[0], r[3]) for r in found.collect()) == [(r[0], r[4]) for r in wanted]


def test_empty_tables_and_clashing_columns(spark):
    asked, given = tables()
    none = spark.createDataFrame([], READINGS)
    found = nearest_rows(spark.createDataFrame(asked, WANTED), none, ("v",), ("k",)).collect()
    assert len(found) == len(asked) and {r["v"] for r in found} == {None}
    assert nearest_rows(spark.createDataFrame([], WANTED), spark.createDataFrame(given, READINGS), ("v",), ("k",)).collect() == []
    with pytest.raises(ValueError, match="columns of both tables: id"):
        nearest_rows(spark.createDataFrame(asked, WANTED), none.withColumnRenamed("rid", "id"), ("id",), ("k",))
    with pytest.raises(ValueError, match="direction"):
        nearest_rows(spark.createDataFrame(asked, WANTED), none, ("v",), ("k",), direction="sideways")

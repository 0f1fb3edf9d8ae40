"""Rejected cells, the history by day, counted stages and rolling evaluation."""

import datetime
import hashlib
from collections import Counter
from pathlib import Path

import pytest
from helpers import START, combined_rows, sunny_rows, to_spark

from heliodrift.operators.profile import StageCounts, stage_counts
from heliodrift.plans.clean import clean, with_parsed_time
from heliodrift.plans.evaluation import fold_scores, rolling_persistence
from heliodrift.operators.combine import drop_duplicates
from heliodrift.schemas import COMBINED_SCHEMA, GENERATION_SCHEMA, POWER, TIME
from heliodrift.sources.history_store import read_days, read_last_days, stored_days, write_days
from heliodrift.sources.rejects import read_with_rejects, reject_counts, write_rejects

HEADER = "DATE_TIME,PLANT_ID,SOURCE_KEY,DC_POWER,AC_POWER,DAILY_YIELD,TOTAL_YIELD,note\n"
LINES = [
    "2020-05-15 00:00:00,4135001,A,1,2,3,4,fine",
    "15-05-2020 00:15,4135001.0,A,1e3, 2 ,nan,,fine too",
    "yesterday,4135001,A,1,2,3,4,",
    "2020-05-15 00:30:00,one,A,1d,--,3,4,",
    "2020-05-15 00:45:00,4135001.5,,1,2,3,4,",
    "2020-05-15 01:00:00,4135001,A,1,2,3,4,x,y",
    "2020-05-15 01:15:00,4135001",
    ",,,,,,,",
]


def test_what_is_not_read_is_kept_with_a_reason(spark, tmp_path):
    Path(tmp_path, "a.csv").write_text(HEADER + "\n".join(LINES) + "\n")
    Path(tmp_path, "b.csv").write_text(HEADER + LINES[0] + "\n")
    parsed = read_with_rejects(spark, str(tmp_path), GENERATION_SCHEMA)
    assert parsed.frame.schema.fieldNames() == GENERATION_SCHEMA.fieldNames()
    assert parsed.frame.count() == 7 and parsed.frame.where("AC_POWER = 2").count() == 5
    none = (None, None, None)
    wanted = [
        ("yesterday", "4135001", "A", TIME, "yesterday", "unreadable time"),
        ("2020-05-15 00:30:00", "one", "A", "PLANT_ID", "one", "not a number"),
        ("2020-05-15 00:30:00", "one", "A", "DC_POWER", "1d", "not a number"),
        ("2020-05-15 00:30:00", "one", "A", "AC_POWER", "--", "not a number"),
        ("2020-05-15 00:45:00", "4135001.5", None, "PLANT_ID", "4135001.5", "not a whole number"),
        ("2020-05-15 00:45:00", "4135001.5", None, "SOURCE_KEY", None, "missing key"),
        (*none, None, LINES[5], "wrong number of fields"),
        (*none, None, LINES[6], "wrong number of fields"),
        *((*none, c, None, "missing key") for c in (TIME, "PLANT_ID", "SOURCE_KEY")),
    ]
    assert Counter(map(tuple, parsed.rejects.collect())) == Counter(wanted)
    for _ in range(2):  # a side table grows with every run
        write_rejects(parsed.rejects, f"{tmp_path}/rejects")
    kept = spark.read.parquet(f"{tmp_path}/rejects")
    assert {(r["column"], r["reason"]): r["rows"] for r in reject_counts(kept).collect()} == {
        k: 2 * n for k, n in Counter((w[3], w[5]) for w in wanted).items()
    }


def test_files_with_other_headers_are_refused(spark, tmp_path):
    Path(tmp_path, "a.csv").write_text(HEADER + LINES[0] + "\n")
    Path(tmp_path, "b.csv").write_text("PLANT_ID,DATE_TIME\n1,2020-05-15\n")
    with pytest.raises(Exception, match="header|missing columns"):
        read_with_rejects(spark, str(tmp_path), GENERATION_SCHEMA).frame.collect()


def digests(folder):
    return {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.parquet")}


@pytest.fixture
def days(spark):
    rows = [r[:7] for r in sunny_rows(5)]
    return spark.createDataFrame([*rows, (None, *rows[0][1:])], GENERATION_SCHEMA)


def test_reloading_a_day_leaves_the_others_alone(spark, tmp_path, days):
    path = f"{tmp_path}/h"
    write_days(days, path)
    before = digests(path)
    day = datetime.date(2020, 5, 17)
    reloaded = days.where("to_date(DATE_TIME) = '2020-05-17'").limit(7)
    write_days(reloaded, path)
    after = digests(path)
    assert {p: d for p, d in before.items() if "05-17" not in p} == {p: d for p, d in after.items() if "05-17" not in p}
    assert not {p for p in before if "05-17" in p} & set(after)
    counts = {r["DATE"]: r["rows"] for r in stored_days(spark, path, GENERATION_SCHEMA).collect()}
    assert counts == {None: 1, day: 7} | {datetime.date(2020, 5, d): 192 for d in (15, 16, 18, 19)}
    assert sorted(map(tuple, read_days(spark, path, GENERATION_SCHEMA, day, day).collect())) == sorted(map(tuple, reloaded.collect()))
    assert read_days(spark, path, GENERATION_SCHEMA).count() == 4 * 192 + 7 + 1


def test_only_the_wanted_days_are_opened(spark, tmp_path, days):
    path = f"{tmp_path}/h"
    write_days(days, path)
    found = read_last_days(spark, path, GENERATION_SCHEMA, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(DATE" in plan and "DATE" in plan.split("PartitionFilters")[1]
    whole = stored_days(spark, path, GENERATION_SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in whole
    for file in Path(path).glob("DATE=2020-05-15/*"):
        file.write_bytes(b"no table")  # would fail if it were opened
    assert sorted({r[TIME].day for r in found.collect()}) == [17, 18, 19]


def test_a_large_day_has_many_files_and_no_day_has_none(spark, tmp_path, days):
    write_days(days, f"{tmp_path}/h", file_rows=50)
    assert len([p for p in digests(tmp_path) if "DATE=2020-05-15" in p]) >= 4
    empty = spark.createDataFrame([], GENERATION_SCHEMA)
    write_days(days.where(f"{TIME} is null"), f"{tmp_path}/n")
    assert read_last_days(spark, f"{tmp_path}/n", GENERATION_SCHEMA, 3).collect() == []
    write_days(empty, f"{tmp_path}/h")
    assert read_days(spark, f"{tmp_path}/h", GENERATION_SCHEMA).count() == days.count()


def test_stages_are_counted_by_the_job_itself(spark, tmp_path):
    raw = to_spark(spark, combined_rows(120)).unionByName(to_spark(spark, combined_rows(120)).limit(40))
    raw.write.parquet(f"{tmp_path}/raw")
    raw = spark.read.schema(raw.schema).parquet(f"{tmp_path}/raw")
    stages = StageCounts()
    cleaned = clean(raw, cell="WHOLE", stages=stages)
    assert cleaned._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    cleaned.write.format("noop").mode("overwrite").save()
    parsed = with_parsed_time(raw)
    wanted = stage_counts({"loaded": raw, "parsed": parsed, "distinct": drop_duplicates(parsed), "filled": clean(raw, cell="WHOLE")})
    assert sorted(map(tuple, stages.table(spark).collect())) == sorted(map(tuple, wanted.collect()))


def plain_folds(rows, columns, hours, folds):
    """Forecasts by a search of all readings that a fold may know."""
    latest = max(r[0] for r in rows)
    names = COMBINED_SCHEMA.fieldNames()
    hour = datetime.timedelta(hours=1)
    out = []
    for row in rows:
        fold = int((latest - row[0]) / hour // hours)
        if folds is not None and fold >= folds:
            continue
        cutoff = latest - (fold + 1) * hours * hour
        wanted = row[0]
        while wanted > cutoff:
            wanted -= 24 * hour
        known = [r for r in rows if r[1:3] == row[1:3] and cutoff - hours * hour < r[0] <= cutoff]
        best = min(known, key=lambda r: (abs(r[0] - wanted), wanted - r[0]), default=None)
        out.append((fold, *((row[names.index(c)], best and best[names.index(c)]) for c in columns)))
    return out


@pytest.mark.parametrize(("hours", "folds"), [(48, None), (48, 2), (24, 3)])
def test_rolling_forecasts_equal_a_search(spark, hours, folds):
    rows = [r for k, r in enumerate(sunny_rows(7, seed=2)) if k % 5 and not 300 < k < 420]
    rows = [(r[0] + datetime.timedelta(minutes=k % 4), *r[1:]) for k, r in enumerate(rows)]
    history = spark.createDataFrame(rows, COMBINED_SCHEMA).repartition(3)
    columns = ("AC_POWER", "IRRADIATION")
    found = rolling_persistence(history, columns, hours=hours, folds=folds)
    mine = sorted((r["fold"], *((r[f"{c}_truth"], r[c]) for c in columns)) for r in found.na.fill(-1.0).collect())
    plain = plain_folds(rows, columns, hours, folds)
    assert mine == sorted((f, *((t, -1.0 if g is None else g) for t, g in x)) for f, *x in plain)
    scores = {(r["column"], r["fold"]): r for r in fold_scores(found, columns).collect()}
    for k, c in enumerate(columns):
        for fold in (None, 0, 1):
            pairs = [x[k] for f, *x in plain if fold in (None, f)]
            kept = [(t, g) for t, g in pairs if g is not None]
            row = scores[c, fold]
            assert (row["rows"], row["unscored"]) == (len(kept), len(pairs) - len(kept))
            off = [g - t for t, g in kept]
            mean = sum(t for t, _ in kept) / len(kept)
            assert row["mae"] == pytest.approx(sum(map(abs, off)) / len(off))
            assert row["mse"] == pytest.approx(sum(o * o for o in off) / len(off))
            assert row["r2"] == pytest.approx(1 - sum(o * o for o in off) / sum((t - mean) ** 2 for t, _ in kept))


def test_scores_without_spread_or_forecast_are_null(spark):
    rows = [(START, 1, "A", 5.0, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    found = fold_scores(rolling_persistence(spark.createDataFrame(rows, COMBINED_SCHEMA), POWER), POWER).collect()
    assert {(r["rows"], r["unscored"], r["mae"], r["r2"]) for r in found} == {(0, 1, None, None)}

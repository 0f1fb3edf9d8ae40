"""Summary statistics with exact, interpolated quartiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodrift.functions.parsing import nan_to_null
from heliodrift.operators.columns import check_columns
from heliodrift.schemas import MEASURES
from heliodrift.session import shared_folder

QUARTILES = (0.25, 0.5, 0.75)
STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")

# Values of a column that one task may hold to rank them.
MAX_RANKED_VALUES = 200_000
_SKETCH_ACCURACY = 10_000


def describe(
    df: DataFrame,
    columns: Sequence[str] = MEASURES,
    max_ranked: int = MAX_RANKED_VALUES,
) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, one row per column.

    The built-in exact percentile keeps every distinct value of a column in one
    task. That is used up to ``max_ranked`` rows; above, the quartiles are found by
    narrowing (see :func:`exact_quantiles`) and set into the one-pass aggregates.
    The columns are written once, so no pass computes what ``df`` is made of again.
    """
    columns = check_columns(df, columns, strict=False)
    # One type on both ways to the quartiles; NaN is a missing value.
    df = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    shared_folder(df.sparkSession)
    df = df.checkpoint()
    if df.count() <= max_ranked:
        quartiles = {
            c: F.percentile(c, F.array(*map(F.lit, QUARTILES))) for c in columns
        }
    else:
        found = exact_quantiles(df, columns, QUARTILES, max_ranked)
        quartiles = {
            c: F.array(*[F.lit(q).cast("double") for q in found[c]]) for c in columns
        }
    return _long_form(df, columns, quartiles)


def _long_form(df, columns, quartiles: dict[str, Column]) -> DataFrame:
    aggregates = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"),
            quartiles[c][0].alias("p25"),
            quartiles[c][1].alias("p50"),
            quartiles[c][2].alias("p75"),
            F.max(c).alias("max"),
        ).alias(c)
        for c in columns
    ]
    row = df.agg(*aggregates)
    return row.select(F.inline(F.array(*columns)))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    quantiles: Sequence[float],
    max_ranked: int = MAX_RANKED_VALUES,
) -> dict[str, list[float | None]]:
    """Exact quantiles, linear between neighbouring ranks, at any table size.

    Each needed rank is kept between two known values. A pass sketches the values
    between them and takes two around the rank; a second pass counts exactly, which
    proves where the rank lies. A round leaves about 1/2500 of the values, so a few
    rounds reach ``max_ranked``; a value that repeats endlessly becomes a bound and
    ends the search. The driver only sees bounds and counts.
    """
    totals = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    ranks, wanted = {}, {}
    for c in columns:
        for q in quantiles:
            place = q * (totals[c] - 1)
            if totals[c]:
                low = math.floor(place)
                ranks[c, q] = (low, min(low + 1, totals[c] - 1), place - low)
                wanted.update({(c, low): None, (c, ranks[c, q][1]): None})
    values = _select_ranks(df, list(wanted), totals, max_ranked)
    result = {}
    for c in columns:
        result[c] = []
        for q in quantiles:
            if (c, q) not in ranks:
                result[c].append(None)
                continue
            low, high, part = ranks[c, q]
            a, b = values[c, low], values[c, high]
            # As the built-in percentile does it, infinite neighbours included.
            result[c].append(a if a == b or not part else a * (1 - part) + b * part)
    return result


def _select_ranks(df, wanted, totals, max_ranked) -> dict[tuple[str, int], float]:
    # (column, rank) -> exclusive bounds (None is open), values at or below the
    # lower bound, values strictly inside.
    states = {(c, rank): (None, None, 0, totals[c]) for c, rank in wanted}
    found = {}
    while states:
        small = {k: s for k, s in states.items() if s[3] <= max_ranked}
        found.update(_rank_directly(df, small))
        states = _narrow(df, {k: s for k, s in states.items() if k not in small}, found)
    return found


def _is_inside(column: str, low: float | None, high: float | None) -> Column:
    value, test = F.col(column), F.lit(True)
    if low is not None:
        test = test & (value > F.lit(low))
    if high is not None:
        test = test & (value < F.lit(high))
    return test


def _inside(column: str, low: float | None, high: float | None) -> Column:
    return F.when(_is_inside(column, low, high), F.col(column))


def _rank_directly(df, states) -> dict[tuple[str, int], float]:
    if not states:
        return {}
    # Ranks of one column share their interval, and the list of its values.
    spans = list(dict.fromkeys((c, s[0], s[1]) for (c, _), s in states.items()))
    number = {span: i for i, span in enumerate(spans)}
    # Few rows are inside any interval; the others must not reach the lists.
    wanted = reduce(or_, [_is_inside(*span) for span in spans])
    row = df.where(wanted).agg(
        *[
            F.sort_array(F.collect_list(_inside(*span))).alias(f"v{i}")
            for span, i in number.items()
        ]
    ).select(
        *[
            F.col(f"v{number[c, s[0], s[1]]}")[rank - s[2]].alias(f"r{i}")
            for i, ((c, rank), s) in enumerate(states.items())
        ]
    ).first()
    return {key: row[f"r{i}"] for i, key in enumerate(states)}


def _narrow(df, states, found) -> dict:
    """Cut every search to one side of, or between, two sketched values.

    Each outcome leaves out at least the sketched values, so the search ends even
    where the sketch is off.
    """
    if not states:
        return {}
    bounds = _sketched_bounds(df, states)
    pairs = list(dict.fromkeys((key[0], *bounds[key]) for key in states))
    counts = []
    for i, (c, a, b) in enumerate(pairs):
        counts += [
            F.count_if(F.col(c) < F.lit(a)).alias(f"below{i}"),
            F.count_if(F.col(c) == F.lit(a)).alias(f"low{i}"),
            F.count(_inside(c, a, b)).alias(f"inside{i}"),
            F.count_if((F.col(c) == F.lit(b)) & F.lit(a != b)).alias(f"high{i}"),
        ]
    counted = df.agg(*counts).first()
    remaining = {}
    for key, (low, high, below, inside) in states.items():
        c, rank = key
        a, b = bounds[key]
        i = pairs.index((c, a, b))
        to_a = counted[f"below{i}"]
        past_a = to_a + counted[f"low{i}"]
        to_b = past_a + counted[f"inside{i}"]
        past_b = to_b + counted[f"high{i}"]
        if rank < to_a:
            remaining[key] = (low, a, below, to_a - below)
        elif rank < past_a:
            found[key] = a
        elif rank < to_b:
            remaining[key] = (a, b, past_a, to_b - past_a)
        elif rank < past_b:
            found[key] = b
        else:
            remaining[key] = (b, high, past_b, below + inside - past_b)
    return remaining


def _sketched_bounds(df, states) -> dict[tuple[str, int], tuple[float, float]]:
    """Two values around each rank, from one sketch per column and interval."""
    slack = 2.0 / _SKETCH_ACCURACY
    spans = {}
    for (c, rank), (low, high, below, inside) in states.items():
        share = (rank - below) / max(inside - 1, 1)
        spans.setdefault((c, low, high), {})[c, rank] = (
            max(0.0, share - slack),
            min(1.0, share + slack),
        )
    row = df.agg(
        *[
            F.percentile_approx(
                _inside(*span),
                [share for pair in around.values() for share in pair],
                _SKETCH_ACCURACY,
            ).alias(f"b{i}")
            for i, (span, around) in enumerate(spans.items())
        ]
    ).first()
    bounds = {}
    for i, around in enumerate(spans.values()):
        values = row[f"b{i}"]
        for j, key in enumerate(around):
            bounds[key] = (values[2 * j], values[2 * j + 1])
    return bounds

"""The same results in DuckDB SQL, over the same Parquet tables."""

from __future__ import annotations

from heliodrift.schemas import MEASURES, POWER, WEATHER, YIELDS

_KEYS = "DATE_TIME, PLANT_ID, SOURCE_KEY"
_BIN = "time_bucket(INTERVAL '15 minutes', ts)"
_PLANT = "4135001 + CAST(user_id % 2 AS INTEGER)"
_SOURCE = "concat('INV', lpad(CAST(user_id % 22 AS VARCHAR), 2, '0'))"
_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"

_RAW = f"""raw AS (
  SELECT {_BIN} AS DATE_TIME, CAST({_PLANT} AS INTEGER) AS PLANT_ID, {_SOURCE} AS SOURCE_KEY,
         event_type, value AS DC_POWER, {_K} AS AC_POWER
  FROM events WHERE event_type <> 'error')"""
_GEN = f"""{_RAW}, gen AS (
  SELECT *,
    1000000 + sum(AC_POWER * 0.25) OVER (PARTITION BY SOURCE_KEY ORDER BY DATE_TIME) AS TOTAL_YIELD,
    sum(AC_POWER * 0.25) OVER (PARTITION BY SOURCE_KEY, CAST(DATE_TIME AS DATE) ORDER BY DATE_TIME) AS DAILY_YIELD
  FROM (SELECT {_KEYS}, max(DC_POWER) AS DC_POWER, max(AC_POWER) AS AC_POWER
        FROM raw GROUP BY ALL))"""
_WX = f"""wx AS (
  SELECT {_BIN} AS DATE_TIME, CAST({_PLANT} AS INTEGER) AS PLANT_ID,
         max({_K}) / 4 AS AMBIENT_TEMPERATURE, max({_K}) / 2 AS MODULE_TEMPERATURE,
         max(value) AS IRRADIATION
  FROM events WHERE event_type = 'error' GROUP BY ALL)"""
_COMB = f"""{_GEN}, {_WX}, comb AS (
  SELECT gen.*, {', '.join(WEATHER)} FROM gen
  LEFT JOIN wx ON gen.DATE_TIME IS NOT DISTINCT FROM wx.DATE_TIME
              AND gen.PLANT_ID IS NOT DISTINCT FROM wx.PLANT_ID)"""


def _filled(partition: str) -> str:
    over = f"{partition} ORDER BY {_KEYS}"
    columns = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}"
        for c in MEASURES
    )
    return f"{_COMB}, filled AS (SELECT {_KEYS}, {columns} FROM comb)"


_BY_SOURCE = "PARTITION BY PLANT_ID, SOURCE_KEY"
_FILLED = _filled(_BY_SOURCE)


def _raw_lags(table: str, name: str, columns, partition: str) -> str:
    over = f"{partition} ORDER BY {_KEYS}"
    made = ", ".join(
        f"lag({c}, 4) OVER ({over}) AS {c}_lag_4, lag({c}, 96) OVER ({over}) AS {c}_lag_96, "
        f"avg({c}) OVER ({over} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS {c}_roll_mean_12"
        for c in columns
    )
    return f"{name} AS (SELECT *, {made} FROM {table})"


def _lag_columns(columns, partition: str) -> str:
    over = f"{partition} ORDER BY {_KEYS}"
    made = []
    for c in columns:
        for suffix in ("lag_4", "lag_96", "roll_mean_12"):
            n = f"{c}_{suffix}"
            value = (
                f"coalesce(first_value({n} IGNORE NULLS) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
                f"last_value({n} IGNORE NULLS) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"
            )
            if suffix == "roll_mean_12":
                value = f"round({value}, 6)"
            made.append(f"{value} AS {n}")
    return ", ".join(made)


_CALENDAR = """CAST(hour(DATE_TIME) AS INTEGER) AS hour, CAST(minute(DATE_TIME) AS INTEGER) AS minute,
  CAST(isodow(DATE_TIME) - 1 AS INTEGER) AS dayofweek, CAST(dayofyear(DATE_TIME) AS INTEGER) AS dayofyear,
  CAST(month(DATE_TIME) AS INTEGER) AS month"""
_MINUTE_ANGLE = "2 * pi() * (hour(DATE_TIME) * 60 + minute(DATE_TIME)) / 1440"
_DAY_ANGLE = "2 * pi() * dayofyear(DATE_TIME) / 365.0"
_CYCLICAL = f"""round(sin({_MINUTE_ANGLE}), 9) AS timeofday_sin, round(cos({_MINUTE_ANGLE}), 9) AS timeofday_cos,
  round(sin({_DAY_ANGLE}), 9) AS dayofyear_sin, round(cos({_DAY_ANGLE}), 9) AS dayofyear_cos"""


def _spine(table: str) -> str:
    return f"""spine AS (
  SELECT CAST(i AS INTEGER) AS step,
         (SELECT max(DATE_TIME) FROM {table}) + INTERVAL 15 MINUTE * (i + 1) AS DATE_TIME
  FROM range(96) t(i))"""


def _last(table: str, keys: str) -> str:
    partition = f"PARTITION BY {keys}" if keys else ""
    order = "DATE_TIME DESC, PLANT_ID DESC" + (
        "" if table == "wx" else ", SOURCE_KEY DESC"
    )
    return f"""lasts AS (
  SELECT * FROM {table}
  QUALIFY row_number() OVER ({partition} ORDER BY {order}) = 1)"""


def _nearest(table: str, keys: str, columns, shared: bool = False) -> str:
    """``near``: one row per series of ``lasts`` and step of ``spine``."""
    names = keys.split(", ")
    order = "DATE_TIME, PLANT_ID" + ("" if table == "wx" else ", SOURCE_KEY")
    match = "true" if shared else " AND ".join(f"h.{k} = l.{k}" for k in names)
    picked = ", ".join(f"h.{c}" for c in columns)
    return f"""near AS (
  SELECT s.step, s.DATE_TIME, {', '.join(f'l.{k}' for k in names)}, {picked}
  FROM lasts l CROSS JOIN spine s
  JOIN (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM {table}) h ON {match}
  QUALIFY row_number() OVER (
    PARTITION BY s.step, {', '.join(f'l.{k}' for k in names)}
    ORDER BY abs(epoch_us(h.DATE_TIME) - epoch_us(s.DATE_TIME - INTERVAL 1 DAY)), h.DATE_TIME DESC,
             CASE WHEN h.DATE_TIME >= s.DATE_TIME - INTERVAL 1 DAY THEN h.place ELSE -h.place END) = 1)"""


def _yields(daily_seed: str = "l.DAILY_YIELD", power: str = "n") -> str:
    """``fc``: the forecast columns, from ``near`` and ``lasts``."""
    powers = ", ".join(
        f"n.{c} AS {c}" if power == "n" else f"CAST(0 AS DOUBLE) AS {c}" for c in POWER
    )
    return f"""fc AS (
  SELECT DATE_TIME, PLANT_ID, SOURCE_KEY, {', '.join(WEATHER)}, {', '.join(POWER)},
    total_seed + sum(AC_POWER * 0.25) OVER (PARTITION BY PLANT_ID, SOURCE_KEY ORDER BY DATE_TIME) AS TOTAL_YIELD_forecasted,
    CASE WHEN CAST(DATE_TIME AS DATE) = first_day AND last_day = first_day THEN daily_seed ELSE 0 END
      + sum(AC_POWER * 0.25) OVER (PARTITION BY PLANT_ID, SOURCE_KEY, CAST(DATE_TIME AS DATE) ORDER BY DATE_TIME)
      AS DAILY_YIELD_forecasted
  FROM (SELECT n.DATE_TIME, n.PLANT_ID, n.SOURCE_KEY, {', '.join('n.' + c for c in WEATHER)}, {powers},
               l.TOTAL_YIELD AS total_seed, {daily_seed} AS daily_seed,
               CAST(l.DATE_TIME AS DATE) AS last_day,
               (SELECT CAST(min(DATE_TIME) AS DATE) FROM spine) AS first_day
        FROM near n JOIN lasts l ON n.PLANT_ID = l.PLANT_ID AND n.SOURCE_KEY = l.SOURCE_KEY))"""


_ENTITY = "PLANT_ID, SOURCE_KEY"
_FORECAST = ", ".join(
    [_FILLED, _spine("filled"), _last("filled", _ENTITY), _nearest("filled", _ENTITY, WEATHER + POWER), _yields()]
)
_FIRST_AT_LATEST = f"""(SELECT DAILY_YIELD FROM filled
  WHERE DATE_TIME = (SELECT max(DATE_TIME) FROM filled) ORDER BY {_KEYS} LIMIT 1)"""
_FORECAST_LAST = ", ".join(
    [
        _FILLED,
        _spine("filled"),
        _last("filled", ""),
        _nearest("filled", _ENTITY, WEATHER + POWER, shared=True),
        _yields(_FIRST_AT_LATEST),
    ]
)
_FORECAST_ZERO = ", ".join(
    [_FILLED, _spine("filled"), _last("filled", _ENTITY), _nearest("filled", _ENTITY, WEATHER), _yields(power="0")]
)


def _unpivoted(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT {_KEYS}, '{shown}' AS series, {c} AS value, {label} AS label FROM {table}"
        for c, shown, label in columns
    )


def _long(rows: int, label_of, partition: str = "") -> str:
    shown = [*WEATHER, *POWER, "DAILY_YIELD_forecasted", "TOTAL_YIELD_forecasted"]
    past = [(c.replace("_forecasted", ""),) * 2 + ("'Historical'",) for c in shown]
    ahead = [(c, c.replace("_forecasted", ""), f"'{label_of(c)}'") for c in shown]
    return f""", recent AS (
  SELECT * FROM filled
  QUALIFY row_number() OVER ({partition} ORDER BY DATE_TIME DESC, PLANT_ID DESC, SOURCE_KEY DESC) <= {rows})
{_unpivoted('recent', past)} UNION ALL {_unpivoted('fc', ahead)}"""


def _provided_label(column: str) -> str:
    if column in WEATHER:
        return "User-Provided"
    return "Derived" if column.endswith("_forecasted") else "Forecasted"


def _sums(measures) -> str:
    return ", ".join(
        f"round(coalesce(sum({c}), 0), 6) AS {c}" if c == "DC_POWER" else f"coalesce(sum({c}), 0) AS {c}"
        for c in measures
    )


_SUMMED = POWER + YIELDS
_FEATURE_SERIES = f", near_weather AS (SELECT {_KEYS}, {', '.join(WEATHER)} FROM near)"


def _future_features(lag_table: str, where: str = "") -> str:
    return f"""SELECT {_KEYS}, {', '.join(WEATHER)}, {_CALENDAR}, {_CYCLICAL},
  round(MODULE_TEMPERATURE * IRRADIATION, 6) AS TEMP_X_IRRADIATION,
  {', '.join(f'{c}_lag_4, {c}_lag_96, {c}_roll_mean_12' for c in WEATHER)} FROM {lag_table} {where}"""


_WEATHER_SERIES = ", ".join(
    [_FILLED, _spine("filled"), _last("filled", _ENTITY), _nearest("filled", _ENTITY, WEATHER)]
)

_ALL_MEASURES = ("PLANT_ID", *MEASURES)
_SHAPE = "event_id % 5"
_MINUTE = "strftime(ts, '%d-%m-%Y %H:%M')"

ORACLE_SQL: dict[str, str] = {
    "combine_generation_weather": f"WITH {_COMB} SELECT * FROM comb",
    "preview_nine_columns": f"""WITH {_COMB} SELECT {_KEYS}, {', '.join(_SUMMED)},
      AMBIENT_TEMPERATURE, MODULE_TEMPERATURE FROM comb ORDER BY {_KEYS} LIMIT 20""",
    "csv_round_trip": f"WITH {_GEN} SELECT * FROM gen",
    "sum_per_timestamp": f"WITH {_GEN} SELECT DATE_TIME, {_sums(_SUMMED)} FROM gen GROUP BY DATE_TIME",
    "daily_totals": f"""WITH {_GEN} SELECT CAST(DATE_TIME AS DATE) AS DATE, {_sums(_SUMMED)}
      FROM gen GROUP BY 1 ORDER BY 1""",
    "power_by_time_of_day": f"""WITH {_GEN} SELECT strftime(DATE_TIME, '%H:%M:%S') AS time, AC_POWER, DC_POWER
      FROM (SELECT DATE_TIME, {_sums(POWER)} FROM gen GROUP BY DATE_TIME)""",
    "yield_over_time": f"WITH {_GEN} SELECT DATE_TIME, sum(DAILY_YIELD) AS DAILY_YIELD FROM gen GROUP BY 1",
    "describe_measures": f"WITH {_COMB} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
        round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM comb"""
        for c in MEASURES
    ),
    "null_profile": f"WITH {_COMB} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS null_count,
        count(*) > count({c}) AS any_null FROM comb"""
        for c in MEASURES
    ),
    "stage_counts": f"""WITH {_RAW}, kept AS (SELECT * EXCLUDE (event_type) FROM raw)
      SELECT CAST(1 AS INTEGER) AS stage_no, 'loaded' AS stage, count(*) AS rows, CAST(5 AS BIGINT) AS columns FROM kept
      UNION ALL SELECT 2, 'parsed', count(*), 5 FROM kept WHERE DATE_TIME IS NOT NULL
      UNION ALL SELECT 3, 'distinct', count(*), 5 FROM (SELECT DISTINCT * FROM kept)
      UNION ALL SELECT 4, 'distinct without time', count(*), 5
        FROM (SELECT DISTINCT PLANT_ID, SOURCE_KEY, DC_POWER, AC_POWER FROM kept)""",
    "distinct_over_two": f"WITH {_COMB} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values,
        count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_with_null,
        count(DISTINCT {c}) > 2 AS over_two,
        count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 2 AS over_two_with_null FROM comb"""
        for c in _ALL_MEASURES
    ),
    "latest_per_entity": f"WITH {_GEN}, {_last('gen', _ENTITY)} SELECT * FROM lasts",
    "first_at_latest": f"""WITH {_GEN} SELECT * FROM gen
      WHERE DATE_TIME = (SELECT max(DATE_TIME) FROM gen) ORDER BY {_KEYS} LIMIT 1""",
    "union_plants": f"""WITH {_GEN} SELECT * FROM gen WHERE PLANT_ID % 2 = 1
      UNION ALL BY NAME SELECT * EXCLUDE (TOTAL_YIELD) FROM gen WHERE PLANT_ID % 2 = 0""",
    "dedup_ignoring_time": f"""WITH {_RAW} SELECT {_KEYS}, event_type, AC_POWER FROM raw
      QUALIFY row_number() OVER (PARTITION BY PLANT_ID, SOURCE_KEY, event_type, AC_POWER ORDER BY DATE_TIME) = 1""",
    "dedup_all": f"WITH {_RAW} SELECT DISTINCT {_KEYS}, event_type FROM raw",
    "fill_global": f"WITH {_filled('')} SELECT * FROM filled WHERE PLANT_ID IS NOT NULL AND SOURCE_KEY IS NOT NULL",
    "fill_by_source": f"WITH {_FILLED} SELECT * FROM filled WHERE PLANT_ID IS NOT NULL AND SOURCE_KEY IS NOT NULL",
    "lenient_parse": f"""SELECT event_id,
      CASE {_SHAPE} WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN strptime({_MINUTE}, '%d-%m-%Y %H:%M')
        WHEN 2 THEN date_trunc('day', ts) END AS DATE_TIME,
      strptime({_MINUTE}, '%d-%m-%Y %H:%M') AS minute_time,
      CASE {_SHAPE} WHEN 0 THEN value WHEN 1 THEN {_K} WHEN 2 THEN {_K} * 100 END AS number,
      CASE {_SHAPE} WHEN 0 THEN value WHEN 1 THEN {_K} WHEN 2 THEN {_K} * 100 ELSE 0 END AS number_or_zero
      FROM events""",
    "calendar_features": f"""WITH {_COMB} SELECT {_KEYS}, {_CALENDAR},
      strftime(DATE_TIME, '%H:%M:%S') AS time, CAST(DATE_TIME AS DATE) AS DATE FROM comb""",
    "cyclical_features": f"""WITH {_COMB} SELECT {_KEYS}, {_CYCLICAL},
      MODULE_TEMPERATURE * IRRADIATION AS TEMP_X_IRRADIATION FROM comb""",
    "lag_roll_global": f"""WITH {_filled('')}, {_raw_lags('filled', 'lagged', WEATHER + POWER, '')}
      SELECT {_KEYS}, {_lag_columns(WEATHER + POWER, '')} FROM lagged""",
    "lag_roll_by_source": f"""WITH {_FILLED}, {_raw_lags('filled', 'lagged', WEATHER + POWER, _BY_SOURCE)}
      SELECT {_KEYS}, {_lag_columns(WEATHER + POWER, _BY_SOURCE)} FROM lagged""",
    "lag_roll_with_gaps": f"""WITH {_COMB}, {_raw_lags('comb', 'lagged', WEATHER, _BY_SOURCE)}
      SELECT {_KEYS}, {_lag_columns(WEATHER, _BY_SOURCE)} FROM lagged""",
    "one_hot": f"WITH {_GEN} SELECT {_KEYS}, "
    + ", ".join(
        [f"CAST(PLANT_ID = {p} AS DOUBLE) AS PLANT_{p}" for p in (4135001, 4135002)]
        + [f"CAST(SOURCE_KEY = 'INV{n:02d}' AS DOUBLE) AS SOURCE_INV{n:02d}" for n in range(22)]
    )
    + " FROM gen",
    "standard_scale": f"WITH {_FILLED}, cal AS (SELECT *, {_CALENDAR} FROM filled) SELECT {_KEYS}, "
    + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}"
        # month has one value in the data, so it is not scaled and not shown
        for c in ("hour", "minute", "dayofweek", "dayofyear", *MEASURES)
    )
    + " FROM cal",
    "future_spine": f"WITH {_GEN}, {_spine('gen')} SELECT * FROM spine",
    "spine_entities": f"""WITH {_GEN}, {_spine('gen')}, {_last('gen', _ENTITY)}
      SELECT s.step, s.DATE_TIME, l.PLANT_ID, l.SOURCE_KEY, l.DATE_TIME AS last_DATE_TIME,
        {', '.join(f'l.{c} AS last_{c}' for c in _SUMMED)} FROM lasts l CROSS JOIN spine s""",
    "align_future_weather": f"""WITH {_GEN}, {_WX}, {_spine('gen')}, shifted AS (
        SELECT DATE_TIME + INTERVAL 1 DAY AS DATE_TIME, {', '.join(f'max({c}) AS {c}' for c in WEATHER)}
        FROM wx GROUP BY 1),
      aligned AS (SELECT spine.*, {', '.join(WEATHER)} FROM spine LEFT JOIN shifted USING (DATE_TIME))
      SELECT step, DATE_TIME, """
    + ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in WEATHER
    )
    + " FROM aligned",
    "persistence_nearest": f"""WITH {_WX}, {_spine('wx')}, {_last('wx', 'PLANT_ID')}, {_nearest('wx', 'PLANT_ID', WEATHER)}
      SELECT * EXCLUDE (step) FROM near""",
    "persistence_last": f"""WITH {_WX}, {_spine('wx')}, {_last('wx', 'PLANT_ID')}
      SELECT spine.DATE_TIME, PLANT_ID, {', '.join(WEATHER)} FROM lasts CROSS JOIN spine""",
    "persistence_shared": f"""WITH {_WX}, {_spine('wx')}, {_last('wx', '')}, {_nearest('wx', 'PLANT_ID', WEATHER, shared=True)}
      SELECT * EXCLUDE (step) FROM near""",
    "future_features": f"""WITH {_WEATHER_SERIES}{_FEATURE_SERIES},
      {_raw_lags('near_weather', 'lagged', WEATHER, _BY_SOURCE)},
      featured AS (SELECT {_KEYS}, {', '.join(WEATHER)}, {_lag_columns(WEATHER, _BY_SOURCE)} FROM lagged)
      {_future_features('featured')}""",
    "future_features_with_history": f"""WITH {_WEATHER_SERIES}{_FEATURE_SERIES}, series AS (
        SELECT {_KEYS}, {', '.join(WEATHER)}, false AS ahead FROM filled
        QUALIFY row_number() OVER ({_BY_SOURCE} ORDER BY DATE_TIME DESC) <= 96
        UNION ALL SELECT *, true FROM near_weather),
      {_raw_lags('series', 'lagged', WEATHER, _BY_SOURCE)},
      featured AS (SELECT {_KEYS}, {', '.join(WEATHER)}, ahead, {_lag_columns(WEATHER, _BY_SOURCE)} FROM lagged)
      {_future_features('featured', 'WHERE ahead')}""",
    "forecast_yields": f"WITH {_FORECAST} SELECT * FROM fc",
    "forecast_yields_last": f"WITH {_FORECAST_LAST} SELECT * FROM fc",
    "forecast_zero_power": f"WITH {_FORECAST_ZERO} SELECT * FROM fc",
    "forecast_long_frame": f"WITH {_FORECAST}{_long(288, lambda c: 'Forecasted')}",
    "forecast_long_frame_provided": f"WITH {_FORECAST_LAST}{_long(192, _provided_label)}",
    "head_forecast": f"WITH {_FORECAST} SELECT * FROM fc ORDER BY {_KEYS} LIMIT 5",
    "full_forecast_output": f"""WITH {_FORECAST} SELECT {_KEYS}, {', '.join(POWER)},
      DAILY_YIELD_forecasted, TOTAL_YIELD_forecasted FROM fc ORDER BY {_KEYS}""",
    "tail_history": f"""WITH {_GEN}, recent AS (
        SELECT * FROM gen ORDER BY DATE_TIME DESC, PLANT_ID DESC, SOURCE_KEY DESC LIMIT 288)
      SELECT * FROM recent ORDER BY {_KEYS}""",
    "clamped_energy": f"""WITH {_GEN} SELECT {_KEYS}, greatest(0, AC_POWER - 50) AS above_50,
      greatest(0, AC_POWER - 50) * 0.25 AS energy FROM gen""",
    "running_total_by_day": f"""WITH {_GEN} SELECT {_KEYS},
      10 + coalesce(sum(CASE WHEN AC_POWER >= 20 THEN AC_POWER * 0.25 END) OVER ({_BY_SOURCE} ORDER BY {_KEYS}), 0) AS used FROM gen""",
    "fill_by_source_range": f"WITH {_FILLED} SELECT * FROM filled WHERE PLANT_ID IS NOT NULL AND SOURCE_KEY IS NOT NULL",
    "clean_unreadable": f"""WITH {_COMB}, t AS (SELECT {_KEYS}, CASE WHEN AC_POWER % 7 = 3 THEN 'n/a'
        WHEN AC_POWER % 7 = 4 THEN NULL ELSE CAST(AC_POWER AS VARCHAR) END AS p FROM comb),
      f AS (SELECT {_KEYS}, coalesce(last_value(p IGNORE NULLS) OVER (
          {_BY_SOURCE} ORDER BY {_KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(p IGNORE NULLS) OVER (
          {_BY_SOURCE} ORDER BY {_KEYS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p FROM t)
      SELECT {_KEYS}, coalesce(TRY_CAST(p AS DOUBLE), 0) AS AC_POWER FROM f""",
    "clean_parity": f"""WITH {_COMB}, once AS (SELECT * FROM comb
        QUALIFY row_number() OVER (PARTITION BY PLANT_ID, SOURCE_KEY, {', '.join(MEASURES)} ORDER BY DATE_TIME) = 1)
      SELECT {_KEYS}, """
    + ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY {_KEYS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (ORDER BY {_KEYS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}"
        for c in MEASURES
    )
    + " FROM once",
    "mixed_headers": f"WITH {_GEN} SELECT * FROM gen",
    "inferred_preview": f"""WITH {_COMB} SELECT * FROM comb ORDER BY {_KEYS} LIMIT 20""",
    "describe_forecast": f"WITH {_FORECAST} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
        round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM fc"""
        for c in (*WEATHER, *POWER, "DAILY_YIELD_forecasted", "TOTAL_YIELD_forecasted")
    ),
    "forecast_no_power_column": f"""WITH {_WEATHER_SERIES} SELECT {_KEYS}, {', '.join(WEATHER)},
      CAST(0 AS DOUBLE) AS DAILY_YIELD_forecasted, CAST(0 AS DOUBLE) AS TOTAL_YIELD_forecasted FROM near""",
    "forecast_long_frame_per_source": f"WITH {_FORECAST}{_long(288, lambda c: 'Forecasted', _BY_SOURCE)}",
    "weather_fallback": f"WITH {_WEATHER_SERIES} SELECT {_KEYS}, {', '.join(WEATHER)} FROM near",
    "forest_group_means": f"""WITH {_FILLED} SELECT PLANT_ID, CAST(hour(DATE_TIME) AS INTEGER) AS hour,
      count(*) AS rows, round(avg(AC_POWER), 6) AS AC_POWER FROM filled GROUP BY 1, 2""",
}
# What every forecast has, whatever the trees say; and weather read back from a file.
_PROPERTIES = f"""WITH {_GEN} SELECT PLANT_ID, SOURCE_KEY, CAST(96 AS BIGINT) AS rows, CAST(96 AS BIGINT) AS times,
  (SELECT max(DATE_TIME) FROM gen) + INTERVAL 15 MINUTE AS first_time,
  (SELECT max(DATE_TIME) FROM gen) + INTERVAL 1 DAY AS last_time, CAST(0 AS BIGINT) AS nulls,
  CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS falls_of_total FROM gen GROUP BY 1, 2"""
ORACLE_SQL |= {
    "forest_chain_properties": _PROPERTIES,
    "forest_lag_properties": _PROPERTIES,
    "forecast_too_few_rows": ORACLE_SQL["forecast_zero_power"],
    "weather_from_file": ORACLE_SQL["align_future_weather"],
}


def _steps_of(name: str, table: str, feature: str, target: str) -> str:
    """``name``: the mean target of each value of a feature, and the inputs that a tree sends there.

    Its thresholds lie half-way between neighbouring values; an input on one goes to the lower side.
    """
    return f"""{name} AS (
  SELECT avg_target, coalesce((lag(v) OVER o + v) / 2, '-inf'::DOUBLE) AS lo,
         coalesce((v + lead(v) OVER o) / 2, 'inf'::DOUBLE) AS hi
  FROM (SELECT {feature} AS v, avg({target}) AS avg_target FROM {table} GROUP BY 1) WINDOW o AS (ORDER BY v))"""


_CHAIN_OF_MEANS = f"""WITH {_FILLED},
  cells AS (SELECT PLANT_ID, CAST(hour(DATE_TIME) AS INTEGER) AS hour, count(*) AS rows,
            avg(AMBIENT_TEMPERATURE) AS ambient FROM filled GROUP BY 1, 2),
  {_steps_of('module', 'filled', 'AMBIENT_TEMPERATURE', 'MODULE_TEMPERATURE')},
  {_steps_of('power', 'filled', 'MODULE_TEMPERATURE', 'AC_POWER')}
SELECT PLANT_ID, hour, rows, round(ambient, 6) AS AMBIENT_TEMPERATURE,
  round(module.avg_target, 6) AS MODULE_TEMPERATURE, round(power.avg_target, 6) AS AC_POWER
FROM cells JOIN module ON ambient > module.lo AND ambient <= module.hi
JOIN power ON module.avg_target > power.lo AND module.avg_target <= power.hi"""

_RECURSIVE_POWER = f"""WITH RECURSIVE {_FILLED}, {_raw_lags('filled', 'lagged', ('AC_POWER',), _BY_SOURCE)},
  trained AS (SELECT {_KEYS}, AC_POWER, {_lag_columns(('AC_POWER',), _BY_SOURCE)} FROM lagged),
  {_steps_of('tree', 'trained', 'AC_POWER_lag_4', 'AC_POWER')},
  ends AS (
    SELECT PLANT_ID, SOURCE_KEY, AC_POWER,
      row_number() OVER ({_BY_SOURCE} ORDER BY DATE_TIME DESC) AS back FROM filled QUALIFY back <= 4),
  blocks AS (
    SELECT PLANT_ID, SOURCE_KEY, CAST(4 - back AS INTEGER) AS step, AC_POWER AS lag_4, avg_target AS power
    FROM ends JOIN tree ON AC_POWER > lo AND AC_POWER <= hi
    UNION ALL
    SELECT PLANT_ID, SOURCE_KEY, CAST(step + 4 AS INTEGER), power, avg_target
    FROM blocks JOIN tree ON power > lo AND power <= hi WHERE step + 4 < 96)
SELECT (SELECT max(DATE_TIME) FROM filled) + INTERVAL 15 MINUTE * (step + 1) AS DATE_TIME, PLANT_ID, SOURCE_KEY, step,
  round(lag_4, 6) AS AC_POWER_lag_4, round(power, 6) AS AC_POWER FROM blocks"""


def _nearest_event(match: str, order: str) -> str:
    return f"""WITH w AS (SELECT event_id, ts AS DATE_TIME, CAST({_PLANT} AS INTEGER) AS PLANT_ID, {_SOURCE} AS SOURCE_KEY
    FROM events WHERE event_type <> 'error'),
  r AS (SELECT event_id AS reading_id, ts, CAST({_PLANT} AS INTEGER) AS plant, {_K} / 4 AS AMBIENT_TEMPERATURE,
    value AS IRRADIATION FROM events WHERE event_type = 'error')
SELECT w.*, r.ts AS DATE_TIME_found, reading_id, AMBIENT_TEMPERATURE, IRRADIATION
FROM w LEFT JOIN r ON w.PLANT_ID = r.plant AND {match}
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY {order}) = 1"""


_OFF = "abs(epoch_us(r.ts) - epoch_us(w.DATE_TIME))"
_NEARER = f"{_OFF}, r.ts DESC, CASE WHEN r.ts >= w.DATE_TIME THEN reading_id ELSE -reading_id END"

_LINE_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_LINE_K = "coalesce(json_extract_string(props, '$.k'), '')"
_LINES = f"""WITH e AS (
  SELECT event_id % 7 AS shape, event_id, CASE event_id % 7 WHEN 4 THEN 't' || event_id ELSE {_LINE_TIME} END AS t,
    CASE event_id % 7 WHEN 5 THEN '4135001.5' ELSE '4135001' END AS p,
    CASE event_id % 7 WHEN 1 THEN NULL ELSE 'INV' || event_id END AS s, {_LINE_K} AS k FROM events),
lost AS (
  SELECT t AS DATE_TIME, p AS PLANT_ID, s AS SOURCE_KEY, 'AC_POWER' AS "column", 'bad' || event_id AS value, 'not a number' AS reason
    FROM e WHERE shape = 3
  UNION ALL SELECT t, p, s, 'DATE_TIME', t, 'unreadable time' FROM e WHERE shape = 4
  UNION ALL SELECT t, p, s, 'PLANT_ID', p, 'not a whole number' FROM e WHERE shape = 5
  UNION ALL SELECT t, p, s, 'SOURCE_KEY', NULL, 'missing key' FROM e WHERE shape = 1
  UNION ALL SELECT NULL, NULL, NULL, NULL, concat_ws(',', t, p, s, k, k, 'more'), 'wrong number of fields' FROM e WHERE shape = 6)"""

_FOLDS = f"""{_FILLED}, aged AS (
    SELECT *, epoch_us((SELECT max(DATE_TIME) FROM filled)) - epoch_us(DATE_TIME) AS age FROM filled),
  placed AS (SELECT *, CAST(floor(age / 172800000000) AS INTEGER) AS fold FROM aged),
  wanted AS (
    SELECT *, DATE_TIME - INTERVAL 1 DAY * CAST(ceil(((fold + 1) * 172800000000 - age) / 86400000000) AS INTEGER) AS wanted_time
    FROM placed),
  guessed AS (
    SELECT w.fold, {', '.join(f'w.{c} AS {c}_truth, k.{c} AS {c}' for c in WEATHER + POWER)}
    FROM wanted w LEFT JOIN placed k
      ON w.PLANT_ID = k.PLANT_ID AND w.SOURCE_KEY = k.SOURCE_KEY AND k.fold = w.fold + 1
    QUALIFY row_number() OVER (PARTITION BY w.PLANT_ID, w.SOURCE_KEY, w.DATE_TIME
      ORDER BY abs(epoch_us(k.DATE_TIME) - epoch_us(w.wanted_time)), k.DATE_TIME DESC) = 1),
  pairs AS ({' UNION ALL '.join(f"""SELECT fold, '{c}' AS "column", CASE WHEN {c} IS NOT NULL THEN {c}_truth END AS truth,
    {c} - {c}_truth AS off FROM guessed""" for c in WEATHER + POWER)})"""


def _digest_bits(tree: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {tree}, {_KEYS})), 1, 8) AS BIGINT)"


# Fixed value: the share of the draws that are of no copy, of 2**32.
_UNSEEN = 1580030168
ORACLE_SQL |= {
    "saved_chain_of_means": _CHAIN_OF_MEANS,
    "recursive_power": _RECURSIVE_POWER,
    "nearest_weather": _nearest_event(f"{_OFF} <= 1800000000", _NEARER),
    "nearest_weather_by_hour": _nearest_event("true", _NEARER),
    "weather_before": _nearest_event("r.ts <= w.DATE_TIME", "r.ts DESC, reading_id DESC"),
    "rejected_cells": f"{_LINES} SELECT * FROM lost",
    "rejected_counts": f"""{_LINES} SELECT "column", reason, count(*) AS rows FROM lost GROUP BY 1, 2
      UNION ALL SELECT '(readings)', CASE shape WHEN 4 THEN 'without time' ELSE 'with time' END, count(*)
      FROM e WHERE shape <> 6 GROUP BY 2""",
    "stage_counts_observed": f"""WITH {_RAW}, kept AS (SELECT * EXCLUDE (event_type) FROM raw),
      once AS (SELECT DISTINCT * FROM kept)
      SELECT CAST(1 AS INTEGER) AS stage_no, 'loaded' AS stage, count(*) AS rows, CAST(5 AS BIGINT) AS columns FROM kept
      UNION ALL SELECT 2, 'parsed', count(*), 5 FROM kept WHERE DATE_TIME IS NOT NULL
      UNION ALL SELECT 3, 'distinct', count(*), 5 FROM once
      UNION ALL SELECT 4, 'filled', count(*), 5 FROM once WHERE PLANT_ID IS NOT NULL AND SOURCE_KEY IS NOT NULL""",
    "rolling_origin_scores": f"""WITH {_FOLDS}
      SELECT "column", fold, count(off) AS rows, count(*) - count(off) AS unscored, round(avg(abs(off)), 6) AS mae,
        round(avg(off * off), 6) AS mse,
        round(CASE WHEN var_pop(truth) > 0 THEN 1 - sum(off * off) / (var_pop(truth) * count(truth)) END, 6) AS r2
      FROM pairs GROUP BY GROUPING SETS (("column", fold), ("column"))""",
    "history_store_reload": f"""WITH {_GEN}, latest AS (SELECT CAST(max(DATE_TIME) AS DATE) AS day FROM gen)
      SELECT {_KEYS}, DC_POWER, CASE WHEN CAST(DATE_TIME AS DATE) = day THEN AC_POWER + 1 ELSE AC_POWER END AS AC_POWER,
        DAILY_YIELD, TOTAL_YIELD FROM gen, latest WHERE CAST(DATE_TIME AS DATE) >= day - 2""",
    "out_of_bag_rows": f"""WITH {_FILLED} SELECT {_KEYS},
      CAST(list_sum([CASE WHEN {_digest_bits('t')} < {_UNSEEN} THEN 1 ELSE 0 END FOR t IN range(150)]) AS INTEGER) AS oob_trees,
      true AS predicted FROM filled""",
}

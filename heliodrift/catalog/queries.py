"""Every registered query: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliodrift.catalog import views
from heliodrift.functions.calendar import (
    CALENDAR_COLUMNS,
    CYCLICAL_COLUMNS,
    calendar_parts,
    cyclical_parts,
    shift_minutes,
    time_of_day,
)
from heliodrift.functions.measures import INTERACTION, clamp_at_zero, energy
from heliodrift.functions.parsing import lenient_number, parse_time, parse_time_format
from heliodrift.operators.asof import nearest_rows
from heliodrift.operators.columns import containing
from heliodrift.operators.combine import drop_duplicates, union_plants
from heliodrift.operators.describe import describe
from heliodrift.operators.encode import (
    Scaler,
    category_map,
    fit_entity_encoder,
    fit_scaler,
    one_hot,
    scalable_columns,
)
from heliodrift.operators.layout import MAX_SEGMENT_ROWS, choose_cell
from heliodrift.operators.nearest import persist_last, persist_nearest
from heliodrift.operators.profile import (
    StageCounts,
    at_latest,
    daily_totals,
    distinct_counts,
    first_rows,
    head,
    last_rows,
    null_profile,
    over_two_values,
    power_by_time_of_day,
    stage_counts,
    sum_per_timestamp,
    tail,
    yield_over_time,
)
from heliodrift.operators.sequences import lag_mean_names, lags_and_means, running_total
from heliodrift.operators.spine import STEP, entity_spine, future_spine
from heliodrift.plans.clean import clean, fill_measures, with_parsed_time
from heliodrift.plans import registry
from heliodrift.plans.evaluation import fold_scores, rolling_persistence
from heliodrift.plans.features import future_features, history_features, time_features
from heliodrift.plans.forests import (
    CHAIN_PROFILE,
    LAG_PROFILE,
    ModelSet,
    chain_forecast,
    holdout_r2,
    lag_features,
    lag_forecast,
    out_of_bag_scores,
    predict_chain,
    train_target,
    training_frame,
)
from heliodrift.plans.persistence import (
    continue_yields,
    persistence_forecast,
    persistence_weather,
)
from heliodrift.plans.recursive import last_values, predict_blocks
from heliodrift.plans.reports import (
    CHAIN_CONTEXT_ROWS,
    LAG_CONTEXT_ROWS,
    forecast_output,
    long_frame,
)
from heliodrift.schemas import (
    COMBINED_SCHEMA,
    DAILY_FORECAST,
    ENTITY,
    GENERATION_SCHEMA,
    MEASURES,
    ORDER,
    PLANT,
    POWER,
    SOURCE,
    TIME,
    TOTAL_FORECAST,
    WEATHER,
)
from heliodrift.session import scratch_path, shared_folder
from heliodrift.sources.csv_files import (
    preview_columns,
    read_generation,
    read_inferred,
    read_readings,
    write_csv,
    write_parquet,
)
from heliodrift.sources.future_weather import align_weather, load_future_weather
from heliodrift.sources.history_store import read_last_days, write_days
from heliodrift.sources.rejects import read_with_rejects, reject_counts

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Sums of two-decimal values differ in the last bits between summing orders."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _filled_by_source(spark, sf_dir) -> DataFrame:
    return fill_measures(views.combined(spark, sf_dir), cell=views.BY_SOURCE)


def _filled_over_all(spark, sf_dir, number=None) -> tuple[DataFrame, str]:
    """Filled over one global order, and the split it was filled with.

    The weather view has one row per key, so the join adds no rows and the split can
    be chosen on the generation readings alone.
    """
    cell = choose_cell(views.generation(spark, sf_dir), (), ORDER, MAX_SEGMENT_ROWS)
    combined = views.combined(spark, sf_dir)
    return fill_measures(combined, by=(), number=number, cell=cell), cell


def combine_generation_weather(spark, sf_dir):
    return views.combined(spark, sf_dir)


def preview_nine_columns(spark, sf_dir):
    return head(preview_columns(views.combined(spark, sf_dir)), 20)


def csv_round_trip(spark, sf_dir):
    """Write the generation readings as CSV and read them back."""
    path = scratch_path(spark, "generation")
    write_csv(views.generation(spark, sf_dir), path)
    return read_generation(spark, path, times="strict")


def timestamp_sums(spark, sf_dir):
    return _rounded(sum_per_timestamp(views.generation(spark, sf_dir)), 6, "DC_POWER")


def day_sums(spark, sf_dir):
    totals = daily_totals(views.generation(spark, sf_dir))
    return _rounded(totals, 6, "DC_POWER").orderBy("DATE")


def time_of_day_power(spark, sf_dir):
    return _rounded(power_by_time_of_day(views.generation(spark, sf_dir)), 6, "DC_POWER")


def yields_over_time(spark, sf_dir):
    return yield_over_time(views.generation(spark, sf_dir))


def describe_measures(spark, sf_dir):
    table = describe(views.combined(spark, sf_dir))
    return _rounded(_rounded(table, 4, "mean", "std"), 6, "p25", "p50", "p75")


def nulls_per_column(spark, sf_dir):
    return null_profile(views.combined(spark, sf_dir))


def rows_per_stage(spark, sf_dir):
    raw = views.raw_generation(spark, sf_dir).drop("event_type")
    parsed = with_parsed_time(raw)
    return stage_counts(
        {
            "loaded": raw,
            "parsed": parsed,
            "distinct": drop_duplicates(parsed),
            "distinct without time": drop_duplicates(parsed, include_time=False),
        }
    )


def distinct_over_two(spark, sf_dir):
    table = views.combined(spark, sf_dir).withColumns(
        {PLANT: F.col(PLANT).cast("double")}
    )
    columns = (PLANT, *MEASURES)
    flags = over_two_values(table, columns)
    return distinct_counts(table, columns).withColumns(
        {
            "over_two": F.col("column").isin([c for c in columns if flags[c][0]]),
            "over_two_with_null": F.col("column").isin([c for c in columns if flags[c][1]]),
        }
    )


def latest_per_entity(spark, sf_dir):
    return last_rows(views.generation(spark, sf_dir))


def first_at_latest(spark, sf_dir):
    return first_rows(at_latest(views.generation(spark, sf_dir)), ())


def united_plants(spark, sf_dir):
    gen = views.generation(spark, sf_dir)
    first = gen.where(F.col(PLANT) % 2 == 1)
    second = gen.where(F.col(PLANT) % 2 == 0).drop("TOTAL_YIELD")
    return union_plants(first, second)


def dedup_ignoring_time(spark, sf_dir):
    raw = views.raw_generation(spark, sf_dir).select(*ORDER, "event_type", "AC_POWER")
    return drop_duplicates(raw, include_time=False)


def dedup_all(spark, sf_dir):
    return drop_duplicates(views.raw_generation(spark, sf_dir).select(*ORDER, "event_type"))


def fill_global(spark, sf_dir):
    return _filled_over_all(spark, sf_dir)[0]


def fill_by_source(spark, sf_dir):
    return _filled_by_source(spark, sf_dir)


def lenient_parse(spark, sf_dir):
    """Event times and values as text of several shapes, read back leniently."""
    shape = F.col("event_id") % 5
    second = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    minute = F.date_format("ts", "dd-MM-yyyy HH:mm")
    text = views.events(spark, sf_dir).select(
        "event_id",
        F.when(shape == 0, second)
        .when(shape == 1, minute)
        .when(shape == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(shape == 3, F.date_format("ts", "yyyy"))
        .otherwise(F.col("event_type"))
        .alias("time_text"),
        F.when(shape == 0, F.col("value").cast("string"))
        .when(shape == 1, F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit(" ")))
        .when(shape == 2, F.concat(F.get_json_object("props", "$.k"), F.lit("e2")))
        .when(shape == 3, F.concat(F.get_json_object("props", "$.k"), F.lit("d")))
        .otherwise(F.lit(""))
        .alias("number_text"),
        minute.alias("minute_text"),
    )
    return text.select(
        "event_id",
        parse_time("time_text").alias(TIME),
        parse_time_format("minute_text", "dd-MM-yyyy HH:mm").alias("minute_time"),
        lenient_number("number_text").alias("number"),
        F.coalesce(lenient_number("number_text"), F.lit(0.0)).alias("number_or_zero"),
    )


def calendar_features(spark, sf_dir):
    return (
        views.combined(spark, sf_dir)
        .withColumns(calendar_parts())
        .select(*ORDER, *CALENDAR_COLUMNS, time_of_day().alias("time"), F.to_date(TIME).alias("DATE"))
    )


def cyclical_features(spark, sf_dir):
    table = time_features(views.combined(spark, sf_dir)).select(
        *ORDER, *CYCLICAL_COLUMNS, INTERACTION
    )
    return _rounded(table, 9, *CYCLICAL_COLUMNS)


def _lagged(filled: DataFrame, by, cell: str, number=None) -> DataFrame:
    columns = WEATHER + POWER
    table = lags_and_means(
        filled, columns, by, null_free=True, cell=cell, number=number
    )
    shown = table.select(*ORDER, *lag_mean_names(columns))
    return _rounded(shown, 6, *containing(shown, "_roll_mean_"))


def lag_roll_global(spark, sf_dir):
    filled, cell = _filled_over_all(spark, sf_dir, number="row_number")
    return _lagged(filled, (), cell, number="row_number")


def lag_roll_by_source(spark, sf_dir):
    return _lagged(_filled_by_source(spark, sf_dir), ENTITY, views.BY_SOURCE)


def lag_roll_with_gaps(spark, sf_dir):
    """Lags of columns with nulls: the fill after the lag has real work to do."""
    table = lags_and_means(
        views.combined(spark, sf_dir), WEATHER, cell=views.BY_SOURCE
    )
    shown = table.select(*ORDER, *lag_mean_names(WEATHER))
    return _rounded(shown, 6, *containing(shown, "_roll_mean_"))


def one_hot_keys(spark, sf_dir):
    gen = views.generation(spark, sf_dir).select(*ORDER)
    return one_hot(gen, category_map(gen))


def standard_scale(spark, sf_dir):
    table = _filled_by_source(spark, sf_dir).withColumns(calendar_parts())
    # Three passes follow: written once instead of joined and filled three times.
    shared_folder(spark)
    table = table.checkpoint()
    columns = scalable_columns(table, [*CALENDAR_COLUMNS, *MEASURES])
    scaled = fit_scaler(table, columns).transform(table)
    return _rounded(scaled.select(*ORDER, *columns), 6, *columns)


def spine_times(spark, sf_dir):
    return future_spine(views.generation(spark, sf_dir))


def spine_entities(spark, sf_dir):
    return entity_spine(views.generation(spark, sf_dir))


def align_future_weather(spark, sf_dir):
    """Weather of both plants, one day on, put on the future grid."""
    spine = future_spine(views.generation(spark, sf_dir))
    return align_weather(spine, _shifted_weather(spark, sf_dir))


def _shifted_weather(spark, sf_dir) -> DataFrame:
    return (
        views.weather(spark, sf_dir)
        .groupBy(shift_minutes(TIME, 24 * 60).alias(TIME))
        .agg(*[F.max(c).alias(c) for c in WEATHER])
    )


def persistence_nearest(spark, sf_dir):
    wx = views.weather(spark, sf_dir)
    return persist_nearest(wx, WEATHER, (PLANT,)).select(TIME, PLANT, *WEATHER)


def persistence_last(spark, sf_dir):
    wx = views.weather(spark, sf_dir)
    return persist_last(wx, WEATHER, (PLANT,)).select(TIME, PLANT, *WEATHER)


def persistence_shared(spark, sf_dir):
    """One series of future weather, searched in the readings of both plants."""
    wx = views.weather(spark, sf_dir)
    future = persist_nearest(wx, WEATHER, (PLANT,), entities="last")
    return future.select(TIME, PLANT, *WEATHER)


def _history(spark, sf_dir) -> DataFrame:
    return clean(views.combined(spark, sf_dir), cell=views.BY_SOURCE)


def future_feature_frame(spark, sf_dir):
    """Features of the future grid alone, on persisted weather."""
    history = _filled_by_source(spark, sf_dir)
    weather = persistence_weather(history).select(*ORDER, *WEATHER)
    return _future_columns(future_features(weather))


def future_features_with_history(spark, sf_dir):
    """The same with lags that reach into each series' last readings."""
    history = _filled_by_source(spark, sf_dir)
    weather = persistence_weather(history).select(*ORDER, *WEATHER)
    return _future_columns(future_features(weather, history=history))


def _future_columns(df: DataFrame) -> DataFrame:
    lagged = lag_mean_names(WEATHER)
    table = df.select(*ORDER, *WEATHER, *CALENDAR_COLUMNS, *CYCLICAL_COLUMNS, INTERACTION, *lagged)
    return _rounded(_rounded(table, 9, *CYCLICAL_COLUMNS), 6, INTERACTION, *containing(table, "_roll_mean_"))


def forecast_yields(spark, sf_dir):
    """The next day of weather, power and energy of every inverter."""
    return persistence_forecast(_history(spark, sf_dir))


def forecast_yields_last(spark, sf_dir):
    """The same for the very last row's inverter, searched in all readings."""
    return persistence_forecast(_history(spark, sf_dir), entities="last")


def forecast_zero_power(spark, sf_dir):
    return persistence_forecast(_history(spark, sf_dir), persist_power=False)


def _written_history(spark, sf_dir) -> DataFrame:
    """The history written once, for plans that read it several times."""
    shared_folder(spark)
    return _history(spark, sf_dir).checkpoint()


def forecast_long_frame(spark, sf_dir):
    history = _written_history(spark, sf_dir)
    return long_frame(history, persistence_forecast(history), CHAIN_CONTEXT_ROWS, by=())


def forecast_long_frame_provided(spark, sf_dir):
    history = _written_history(spark, sf_dir)
    forecast = persistence_forecast(history, entities="last")
    return long_frame(history, forecast, LAG_CONTEXT_ROWS, provided=WEATHER, by=())


def forecast_long_frame_per_source(spark, sf_dir):
    """Three days of context of every source."""
    history = _written_history(spark, sf_dir)
    return long_frame(history, persistence_forecast(history), CHAIN_CONTEXT_ROWS)


def head_forecast(spark, sf_dir):
    return head(forecast_yields(spark, sf_dir))


def full_forecast_output(spark, sf_dir):
    wanted = (*POWER, "DAILY_YIELD_forecasted", "TOTAL_YIELD_forecasted", "absent")
    return forecast_output(forecast_yields(spark, sf_dir), wanted)


def tail_history(spark, sf_dir):
    return tail(views.generation(spark, sf_dir), CHAIN_CONTEXT_ROWS).orderBy(*ORDER)


def clamped_energy(spark, sf_dir):
    """Power below its series' level clamped to 0, and its energy."""
    gen = views.generation(spark, sf_dir)
    above = clamp_at_zero(F.col("AC_POWER") - 50)
    return gen.select(*ORDER, above.alias("above_50"), energy(above).alias("energy"))


def running_total_by_day(spark, sf_dir):
    """Energy of each source since its first reading, over segments of a day."""
    gen = views.generation(spark, sf_dir)
    missing = F.when(F.col("AC_POWER") >= 20, F.col("AC_POWER"))
    return running_total(gen, energy(missing), "used", seed=10.0, cell="DAY").select(*ORDER, "used")


def fill_by_source_range(spark, sf_dir):
    """The fill over segments of bounded row counts, on the full order."""
    return fill_measures(views.combined(spark, sf_dir), max_rows=1_000, cell="RANGE")


def clean_unreadable(spark, sf_dir):
    """Measures as text, some of it no number: 0 after the fill, not the neighbour's value."""
    value = F.col("AC_POWER").cast("string")
    text = F.when(F.col("AC_POWER") % 7 == 3, "n/a").when(F.col("AC_POWER") % 7 == 4, None).otherwise(value)
    table = views.combined(spark, sf_dir).withColumn("AC_POWER", text)
    return clean(table, cell=views.BY_SOURCE).select(*ORDER, "AC_POWER")


def clean_parity(spark, sf_dir):
    """Rows that repeat but for their time go, then fills over all series at once."""
    combined = views.combined(spark, sf_dir)
    return clean(combined, by=(), include_time=False, guard=True)


def mixed_headers(spark, sf_dir):
    """Files of two column orders in one folder, read by name."""
    path = scratch_path(spark, "mixed")
    gen = views.generation(spark, sf_dir)
    odd = F.col(PLANT) % 2 == 1
    write_csv(gen.where(odd), f"{path}/order=1")
    write_csv(gen.where(~odd).select(*reversed(gen.columns)), f"{path}/order=2")
    return read_readings(spark, [f"{path}/order=1", f"{path}/order=2"], GENERATION_SCHEMA, "strict").select(*gen.columns)


def inferred_preview(spark, sf_dir):
    """The combined readings from a file with inferred types, before the projection."""
    path = scratch_path(spark, "combined")
    write_csv(views.combined(spark, sf_dir), path)
    table = read_inferred(spark, path)
    typed = table.withColumn(TIME, F.col(TIME).cast("timestamp_ntz"))
    return head(typed.select(*COMBINED_SCHEMA.fieldNames()), 20)


def describe_forecast(spark, sf_dir):
    columns = (*WEATHER, *POWER, DAILY_FORECAST, TOTAL_FORECAST)
    table = describe(forecast_yields(spark, sf_dir), columns)
    return _rounded(_rounded(table, 4, "mean", "std"), 6, "p25", "p50", "p75")


def forecast_no_power_column(spark, sf_dir):
    """Yields of a forecast without a power column are 0."""
    history = _history(spark, sf_dir)
    future = persistence_weather(history)
    table = continue_yields(future, history)
    return table.select(*ORDER, *WEATHER, "DAILY_YIELD_forecasted", "TOTAL_YIELD_forecasted")


def weather_from_file(spark, sf_dir):
    """Future weather that a file gives, on the grid."""
    path = scratch_path(spark, "future")
    write_csv(_shifted_weather(spark, sf_dir), path)
    return load_future_weather(spark, future_spine(views.generation(spark, sf_dir)), path).frame


def weather_fallback(spark, sf_dir):
    """Without a usable file the weather is persisted."""
    history = _history(spark, sf_dir)
    found = load_future_weather(spark, future_spine(history), f"{sf_dir}/no-such-file.csv")
    if found.frame is not None:
        raise AssertionError(found.reason)
    return persistence_weather(history).select(*ORDER, *WEATHER)


def forest_group_means(spark, sf_dir):
    """One unbounded tree on plant and hour, without bootstrap: it predicts each cell's mean."""
    timed = time_features(_filled_by_source(spark, sf_dir), cyclical=False)
    frame = training_frame(timed.select(*ORDER, "hour", "AC_POWER"))
    tree = replace(CHAIN_PROFILE, trees=1, depth=12, min_leaf=1, bootstrap=False)
    model = train_target(frame, "AC_POWER", (PLANT, "hour"), tree)
    cells = frame.groupBy(PLANT, "hour").agg(F.count("*").alias("rows"))
    return _rounded(model.predict(cells).select(PLANT, "hour", "rows", "AC_POWER"), 6, "AC_POWER")


def _forecast_properties(forecast: DataFrame) -> DataFrame:
    """What any forecast must be, whatever its trees say."""
    before = F.lag("TOTAL_YIELD_forecasted").over(Window.partitionBy(*ENTITY).orderBy(TIME))
    fallen = F.coalesce(F.col("TOTAL_YIELD_forecasted") < before, F.lit(False))
    columns = (*WEATHER, *POWER, "DAILY_YIELD_forecasted", "TOTAL_YIELD_forecasted")
    nulls = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))
    negative = sum((F.coalesce(F.col(c) < 0, F.lit(False)).cast("long") for c in ("IRRADIATION", *POWER)), F.lit(0))
    return (
        forecast.withColumn("fallen", fallen)
        .groupBy(*ENTITY)
        .agg(
            F.count("*").alias("rows"),
            F.countDistinct(TIME).alias("times"),
            F.min(TIME).alias("first_time"),
            F.max(TIME).alias("last_time"),
            F.sum(nulls).alias("nulls"),
            F.sum(negative).alias("negative"),
            F.count_if("fallen").alias("falls_of_total"),
        )
    )


def forest_chain_properties(spark, sf_dir):
    return _forecast_properties(forest_chain_forecast(spark, sf_dir))


def forest_lag_properties(spark, sf_dir):
    return _forecast_properties(forest_lag_forecast(spark, sf_dir))


def forest_chain_forecast(spark, sf_dir):
    return chain_forecast(_history(spark, sf_dir), CHAIN_PROFILE)


def forest_lag_forecast(spark, sf_dir):
    return lag_forecast(_history(spark, sf_dir), profile=LAG_PROFILE, cell=views.BY_SOURCE)


def forecast_too_few_rows(spark, sf_dir):
    """With fewer rows than a profile asks for there is no model: persisted weather, no power."""
    return chain_forecast(_history(spark, sf_dir), replace(CHAIN_PROFILE, min_rows=2_000_000_000))


def forest_holdout_r2(spark, sf_dir):
    return holdout_r2(_history(spark, sf_dir), CHAIN_PROFILE)


# One unbounded tree, which predicts the mean of the rows that agree in its feature.
_MEANS = replace(CHAIN_PROFILE, trees=1, depth=30, min_leaf=1, bootstrap=False)
_UNSCALED = Scaler({}, {})


def saved_chain_of_means(spark, sf_dir):
    """A chain of three such trees, saved and loaded; each prediction feeds the next one.

    The month, a feature without a split, is absent from the cells and counts as 0.
    """
    chain = {
        "AMBIENT_TEMPERATURE": (PLANT, "hour", "month"),
        "MODULE_TEMPERATURE": ("AMBIENT_TEMPERATURE", "month"),
        "AC_POWER": ("MODULE_TEMPERATURE",),
    }
    timed = time_features(_filled_by_source(spark, sf_dir), cyclical=False)
    frame = training_frame(timed.select(*ORDER, "hour", "month", *chain))
    models = {t: train_target(frame, t, names, _MEANS, _UNSCALED) for t, names in chain.items()}
    folder = scratch_path(spark, "models")
    registry.save(spark, ModelSet("means", models, fit_entity_encoder(frame)), folder)
    loaded = registry.load(spark, folder)
    cells = frame.groupBy(PLANT, "hour").agg(F.count("*").alias("rows"))
    return _rounded(predict_chain(cells, loaded.models, tuple(chain)), 6, *chain)


def recursive_power(spark, sf_dir):
    """A day of power by such a tree on the lag of four steps, which is its own forecast."""
    history = _written_history(spark, sf_dir)
    lagged = lags_and_means(history, ("AC_POWER",), null_free=True, cell=views.BY_SOURCE)
    frame = training_frame(lagged.select(*ORDER, "AC_POWER", "AC_POWER_lag_4"))
    model = train_target(frame, "AC_POWER", ("AC_POWER_lag_4",), _MEANS, _UNSCALED)
    grid = entity_spine(history).select(*ORDER, STEP)
    past = last_values(history, ("AC_POWER",))
    forecast = predict_blocks(grid, past, {"AC_POWER": model}, ("AC_POWER",))
    return _rounded(forecast.select(*ORDER, STEP, "AC_POWER_lag_4", "AC_POWER"), 6, "AC_POWER_lag_4", "AC_POWER")


def _nearest_weather(spark, sf_dir, **how):
    return nearest_rows(
        views.generation_events(spark, sf_dir),
        views.weather_events(spark, sf_dir),
        ("reading_id", "AMBIENT_TEMPERATURE", "IRRADIATION"),
        (PLANT,),
        order=("reading_id",),
        **how,
    )


def nearest_weather(spark, sf_dir):
    """The weather reading nearest to every generation event, half an hour off at most."""
    return _nearest_weather(spark, sf_dir, tolerance=1_800)


def nearest_weather_by_hour(spark, sf_dir):
    """The same without a bound, over segments of an hour."""
    return _nearest_weather(spark, sf_dir, cell="HOUR")


def weather_before(spark, sf_dir):
    """The last weather reading up to every generation event."""
    return _nearest_weather(spark, sf_dir, direction="backward")


_REJECT_SCHEMA = T.StructType([GENERATION_SCHEMA[c] for c in (*ORDER, *POWER)])


def _faulty_lines(spark, sf_dir):
    """Events as lines of a CSV file, six of seven with something that can't be read as it should."""
    shape, name = F.col("event_id") % 7, F.col("event_id").cast("string")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    fields = [
        F.when(shape == 4, F.concat(F.lit("t"), name)).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        F.when(shape == 5, "4135001.5").otherwise("4135001"),
        F.when(shape == 1, "").otherwise(F.concat(F.lit("INV"), name)),
        F.when(shape == 2, "nan").otherwise(k),
        F.when(shape == 3, F.concat(F.lit("bad"), name)).when(shape == 6, F.concat(k, F.lit(",more"))).otherwise(k),
    ]
    return views.events(spark, sf_dir).select(F.concat_ws(",", *fields).alias(",".join(_REJECT_SCHEMA.fieldNames())))


def _parsed_lines(spark, sf_dir):
    path = scratch_path(spark, "faulty")
    # A separator that the lines don't hold leaves their commas alone.
    _faulty_lines(spark, sf_dir).write.option("header", True).option("sep", "\x01").csv(path)
    return read_with_rejects(spark, path, _REJECT_SCHEMA)


def rejected_cells(spark, sf_dir):
    """Each cell and record that was not read, with its text and the reason."""
    return _parsed_lines(spark, sf_dir).rejects


def rejected_counts(spark, sf_dir):
    """The same counted, beside the readings that are left."""
    parsed = _parsed_lines(spark, sf_dir)
    read = parsed.frame.select(
        F.lit("(readings)").alias("column"),
        F.when(F.col(TIME).isNull(), "without time").otherwise("with time").alias("reason"),
    )
    return reject_counts(parsed.rejects).unionByName(reject_counts(read))


def stage_counts_observed(spark, sf_dir):
    """Rows after each step of cleaning, counted by the job that writes the result."""
    stages = StageCounts()
    raw = views.raw_generation(spark, sf_dir).drop("event_type")
    cleaned = clean(raw, cell=views.BY_SOURCE, stages=stages)
    write_parquet(cleaned, scratch_path(spark, "cleaned"))
    return stages.table(spark)


def rolling_origin_scores(spark, sf_dir):
    """Persistence scored over every 48 hours of the history, forecast from what was known before."""
    forecasts = rolling_persistence(_filled_by_source(spark, sf_dir), cell=views.BY_SOURCE)
    return _rounded(fold_scores(forecasts), 6, "mae", "mse", "r2")


def history_store_reload(spark, sf_dir):
    """All readings stored by day, the last day loaded again with other values, three days read."""
    path = scratch_path(spark, "history")
    gen = views.generation(spark, sf_dir)
    write_days(gen, path)
    last_day = F.to_date(TIME) == gen.select(F.to_date(F.max(TIME))).scalar()
    write_days(gen.where(last_day).withColumn("AC_POWER", F.col("AC_POWER") + 1), path)
    return read_last_days(spark, path, GENERATION_SCHEMA, 3)


def _power_frame(spark, sf_dir):
    frame = training_frame(history_features(_filled_by_source(spark, sf_dir), cell=views.BY_SOURCE))
    encoder = fit_entity_encoder(frame)
    return encoder.transform(frame), lag_features(encoder.names)


def out_of_bag_rows(spark, sf_dir):
    """Every row with the number of trees, of the 150 for DC power, that have not seen it."""
    frame, features = _power_frame(spark, sf_dir)
    _, scored = out_of_bag_scores(frame, {"DC_POWER": features["DC_POWER"]})
    return scored["DC_POWER"].select(
        *ORDER, "oob_trees", F.col("__prediction").isNotNull().alias("predicted")
    )


def out_of_bag_r2(spark, sf_dir):
    """R2 of both powers, each row predicted by the trees that have not seen it."""
    return out_of_bag_scores(*_power_frame(spark, sf_dir))[0]


QUERIES: dict[str, Query] = {
    "combine_generation_weather": combine_generation_weather,
    "preview_nine_columns": preview_nine_columns,
    "csv_round_trip": csv_round_trip,
    "sum_per_timestamp": timestamp_sums,
    "daily_totals": day_sums,
    "power_by_time_of_day": time_of_day_power,
    "yield_over_time": yields_over_time,
    "describe_measures": describe_measures,
    "null_profile": nulls_per_column,
    "stage_counts": rows_per_stage,
    "distinct_over_two": distinct_over_two,
    "latest_per_entity": latest_per_entity,
    "first_at_latest": first_at_latest,
    "union_plants": united_plants,
    "dedup_ignoring_time": dedup_ignoring_time,
    "dedup_all": dedup_all,
    "fill_global": fill_global,
    "fill_by_source": fill_by_source,
    "lenient_parse": lenient_parse,
    "calendar_features": calendar_features,
    "cyclical_features": cyclical_features,
    "lag_roll_global": lag_roll_global,
    "lag_roll_by_source": lag_roll_by_source,
    "lag_roll_with_gaps": lag_roll_with_gaps,
    "one_hot": one_hot_keys,
    "standard_scale": standard_scale,
    "future_spine": spine_times,
    "spine_entities": spine_entities,
    "align_future_weather": align_future_weather,
    "persistence_nearest": persistence_nearest,
    "persistence_last": persistence_last,
    "persistence_shared": persistence_shared,
    "future_features": future_feature_frame,
    "future_features_with_history": future_features_with_history,
    "forecast_yields": forecast_yields,
    "forecast_yields_last": forecast_yields_last,
    "forecast_zero_power": forecast_zero_power,
    "forecast_long_frame": forecast_long_frame,
    "forecast_long_frame_provided": forecast_long_frame_provided,
    "head_forecast": head_forecast,
    "full_forecast_output": full_forecast_output,
    "tail_history": tail_history,
    "clamped_energy": clamped_energy,
    "forest_chain_forecast": forest_chain_forecast,
    "forest_lag_forecast": forest_lag_forecast,
    "holdout_r2": forest_holdout_r2,
    "running_total_by_day": running_total_by_day,
    "fill_by_source_range": fill_by_source_range,
    "clean_unreadable": clean_unreadable,
    "clean_parity": clean_parity,
    "mixed_headers": mixed_headers,
    "inferred_preview": inferred_preview,
    "describe_forecast": describe_forecast,
    "forecast_no_power_column": forecast_no_power_column,
    "forecast_long_frame_per_source": forecast_long_frame_per_source,
    "weather_from_file": weather_from_file,
    "weather_fallback": weather_fallback,
    "forest_group_means": forest_group_means,
    "forest_chain_properties": forest_chain_properties,
    "forest_lag_properties": forest_lag_properties,
    "forecast_too_few_rows": forecast_too_few_rows,
    "saved_chain_of_means": saved_chain_of_means,
    "recursive_power": recursive_power,
    "nearest_weather": nearest_weather,
    "nearest_weather_by_hour": nearest_weather_by_hour,
    "weather_before": weather_before,
    "rejected_cells": rejected_cells,
    "rejected_counts": rejected_counts,
    "stage_counts_observed": stage_counts_observed,
    "rolling_origin_scores": rolling_origin_scores,
    "history_store_reload": history_store_reload,
    "out_of_bag_rows": out_of_bag_rows,
    "out_of_bag_r2": out_of_bag_r2,
}

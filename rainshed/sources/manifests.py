"""Which files a request should bring, as tables.

A request table holds one row per request; requests are exploded on the executors, so thousands of
them with years of hours each are one narrow stage. ``*_request`` build a checked one-row table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.times import wrf_time_text


def check_dates(start: str, end: str, frequency: str = "daily") -> None:
    """ISO dates (or year-month, or year) in order."""
    form = {"daily": "%Y-%m-%d", "hourly": "%Y-%m-%d", "monthly": "%Y-%m", "annual": "%Y"}[frequency]
    try:
        first, last = dt.datetime.strptime(str(start), form), dt.datetime.strptime(str(end), form)
    except ValueError as error:
        raise ValueError(f"dates must look like {form}: {error}") from None
    if first > last:
        raise ValueError(f"start {start} must not be after end {end}")


def check_choice(name: str, value, allowed: Sequence) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}, not {value!r}")


def _choice(value: Column, names: dict, what: str) -> Column:
    """Lookup in a fixed table; an unknown key stops the job."""
    pick = None
    for key, name in names.items():
        pick = (F if pick is None else pick).when(value == F.lit(key), F.lit(name))
    return pick.otherwise(F.raise_error(F.concat(F.lit(f"unknown {what} "), value.cast("string"))))


def _hours(start: str, end: str) -> Column:
    """Hours from midnight of the first day to midnight of the last, both included."""
    day = lambda c: F.to_date(F.col(c)).cast("timestamp_ntz")
    return F.explode(F.sequence(day(start), day(end), F.expr("interval 1 hour")))


def wrf_request(
    spark: SparkSession, model: str, start: str, end: str, data_tier: int = 2, domain: int = 2,
    historical: bool = False, bias_corrected: bool = False,
) -> DataFrame:
    check_dates(start, end)
    check_choice("data_tier", data_tier, list(schema.WRF_TIER_PREFIX))
    check_choice("domain", domain, schema.WRF_DOMAINS)
    return spark.createDataFrame(
        [(model, data_tier, domain, bool(historical), bool(bias_corrected), start, end)],
        "model string, data_tier int, domain int, historical boolean, bias_corrected boolean, start_date string, end_date string",
    )


def wrf_files(requests: DataFrame, include_end: bool = True) -> DataFrame:
    """Hourly files (time, path). The run folder is the year from October on, else the year before.

    ``include_end=False`` leaves out the last midnight.
    """
    hours = requests.withColumn("time", _hours("start_date", "end_date"))
    if not include_end:
        hours = hours.filter(F.col("time") < F.to_date("end_date").cast("timestamp_ntz"))
    t = F.col("time")
    return hours.withColumn(
        "path",
        F.concat(
            F.lit("downscaled_products/"),
            F.when(F.startswith(F.col("model"), F.lit("era5")), F.lit("reanalysis")).otherwise(F.lit("gcm")),
            F.lit("/"), F.col("model"),
            F.when(F.col("historical"), F.lit("_historical")).otherwise(F.lit("")),
            F.when(F.col("bias_corrected"), F.lit("_bc")).otherwise(F.lit("")),
            F.lit("/hourly/"),
            (F.year(t) - F.when(F.month(t) > 9, 0).otherwise(1)).cast("string"),
            F.lit("/d0"), F.col("domain").cast("string"), F.lit("/"),
            _choice(F.col("data_tier"), schema.WRF_TIER_PREFIX, "data tier"),
            F.lit("_d01_"), wrf_time_text(t),
        ),
    )


def local_wrf_name(path: str | Column) -> Column:
    """Name of the fetched copy: model folder and file name, without colons."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.concat(parts[2], F.lit("_"), F.replace(F.element_at(parts, -1), F.lit(":"), F.lit("-")), F.lit(".nc"))


def ornl_request(
    spark: SparkSession, variables: Sequence[str], start_year: int, end_year: int, reference: str = "DaymetV4",
    gcm: str | None = None, climate_scenario: str | None = None, downscaling: str | None = None, hydro_model: str = "VIC4",
) -> DataFrame:
    check_dates(str(start_year), str(end_year), "annual")
    check_choice("reference", reference, schema.ORNL_REFERENCES)
    check_choice("hydro_model", hydro_model, schema.ORNL_HYDRO_MODELS)
    check_choice("climate_scenario", climate_scenario, [None, *schema.ORNL_SCENARIOS])
    check_choice("downscaling", downscaling, [None, *schema.ORNL_DOWNSCALING])
    return spark.createDataFrame(
        [(reference, hydro_model, list(variables), int(start_year), int(end_year), gcm, climate_scenario, downscaling)],
        "reference string, hydro_model string, variables array<string>, start_year int, end_year int, "
        "gcm string, climate_scenario string, downscaling string",
    )


def ornl_files(requests: DataFrame, split_year: int | None = None, root: str = schema.ORNL_ROOT) -> DataFrame:
    """One file per variable and year (variable, year, url).

    Without a complete climate-model choice the reference archive is used (1950-2018), otherwise the
    model archive (1980-2099); years outside are left out, and an unknown model gives no files.
    ``split_year`` instead takes years before it from the reference and the others from the model.
    """
    ensemble = F.element_at(
        F.create_map(*[F.lit(s) for pair in schema.ORNL_ENSEMBLES.items() for s in pair]), F.col("gcm")
    )
    driven = F.col("gcm").isNotNull() & F.col("climate_scenario").isNotNull() & F.col("downscaling").isNotNull()
    year = F.col("year")
    files = requests.withColumn("year", F.explode(F.sequence("start_year", "end_year"))).withColumn(
        "variable", F.explode("variables")
    )
    if split_year is None:
        from_model = driven
        low, high = schema.ORNL_REFERENCE_YEARS
        first, last = schema.ORNL_GCM_YEARS
        files = files.filter(
            F.when(driven, year.between(first, last) & ensemble.isNotNull()).otherwise(year.between(low, high))
        )
    else:
        from_model = year >= split_year
        files = files.filter((year < split_year) | (driven & ensemble.isNotNull()))
    reference = F.when(F.col("reference") == "DaymetV4", F.lit("Daymet")).otherwise(F.col("reference"))
    run = F.when(
        from_model, F.concat_ws("_", F.col("gcm"), F.col("climate_scenario"), ensemble, F.col("downscaling"), reference)
    ).otherwise(F.col("reference"))
    return files.withColumn(
        "url",
        F.concat(
            F.lit(root), F.lit("/"), run, F.lit("/"), F.col("variable"), F.lit("/"),
            F.concat_ws("_", run, F.col("hydro_model"), F.col("variable"), year.cast("string")), F.lit(".nc"),
        ),
    ).drop("variables")


def ornl_name_to_url(name: str | Column, root: str = schema.ORNL_ROOT) -> Column:
    """Address of a local reference file, from the four parts of its name."""
    base = F.element_at(F.split(F.col(name) if isinstance(name, str) else name, "/"), -1)
    parts = F.split(base, "_")
    return F.concat_ws("/", F.lit(root), parts[0], parts[2], base)


def prism_request(
    spark: SparkSession, variables: Sequence[str], start: str, end: str, frequency: str = "daily",
    region: str = "us", resolution: str = "4km", file_format: str = "nc",
) -> DataFrame:
    check_choice("frequency", frequency, schema.FREQUENCIES)
    check_dates(start, end, frequency)
    check_choice("region", region, schema.PRISM_REGIONS)
    check_choice("resolution", resolution, schema.PRISM_RESOLUTIONS)
    check_choice("file_format", file_format, schema.PRISM_FORMATS)
    return spark.createDataFrame(
        [(list(variables), start, end, frequency, region, resolution, file_format)],
        "variables array<string>, start_date string, end_date string, frequency string, region string, "
        "resolution string, file_format string",
    )


def prism_files(
    requests: DataFrame, frequency: str = "daily", legacy_end: bool = False, include_start: bool = True
) -> DataFrame:
    """Variables x dates of the requests of one frequency (variable, date_key, path).

    Both ends are included. ``legacy_end`` leaves out the last month or year, as period-end steps
    do; ``include_start=False`` leaves out the first date.
    """
    check_choice("frequency", frequency, schema.FREQUENCIES)
    pad = {"daily": "", "monthly": "-01", "annual": "-01-01"}[frequency]
    unit = {"daily": "day", "monthly": "month", "annual": "year"}[frequency]
    day = lambda c: F.to_date(F.concat(F.col(c), F.lit(pad)))
    dates = (
        requests.filter(F.col("frequency") == frequency)
        .withColumn("date", F.explode(F.sequence(day("start_date"), day("end_date"), F.expr(f"interval 1 {unit}"))))
    )
    if legacy_end and frequency != "daily":
        dates = dates.filter(F.col("date") < day("end_date"))
    if not include_start:
        dates = dates.filter(F.col("date") > day("start_date"))
    return (
        dates.withColumn("variable", F.explode("variables"))
        .withColumn("date_key", F.date_format("date", schema.PRISM_DATE_FORMAT[frequency]))
        .withColumn(
            "path",
            F.concat(
                F.lit("/"), F.col("region"), F.lit("/"), F.col("resolution"), F.lit("/"), F.col("variable"),
                F.lit("/"), F.col("date_key"), F.lit("?format="), F.col("file_format"),
            ),
        )
        .drop("variables")
    )


def hrrr_request(spark: SparkSession, start: str, end: str, model: str = "hrrr", product: str = "sfc") -> DataFrame:
    check_dates(start, end)
    return spark.createDataFrame(
        [(model, product, start, end)], "model string, product string, start_date string, end_date string"
    )


def hrrr_runs(requests: DataFrame, steps: Sequence[int] = (0, 1)) -> DataFrame:
    """Hourly run times, each with its forecast steps (time, step_h)."""
    return requests.withColumn("time", _hours("start_date", "end_date")).withColumn(
        "step_h", F.explode(F.array(*[F.lit(int(s)) for s in steps]))
    )

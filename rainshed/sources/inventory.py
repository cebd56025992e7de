"""Index search, arrival accounting and metadata out of file names."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def search_pattern(parameters: Sequence[str] | Mapping[str, str]) -> str:
    """Lines that begin with ``:NAME`` or ``:NAME:level``. Given text is used as a pattern, unescaped."""
    names = [f"{p}:{level}" for p, level in parameters.items()] if isinstance(parameters, Mapping) else list(parameters)
    return "^(?:" + "|".join(f":{n}" for n in names) + ")"


def search(index: DataFrame, parameters: Sequence[str] | Mapping[str, str], line: str = "line") -> DataFrame:
    return index.filter(F.col(line).rlike(search_pattern(parameters)))


def missing_files(expected: DataFrame, arrived: DataFrame, key: str = "path") -> DataFrame:
    return expected.join(arrived.select(key), [key], "left_anti")


def arrival_report(expected: DataFrame, arrived: DataFrame, by: Sequence[str] = (), key: str = "path") -> DataFrame:
    """Expected, fetched and failed files per group; a file that arrived twice counts once.

    Files asked for by many requests are counted before the join, so copies do not meet in one task.
    """
    seen = arrived.select(key).distinct().withColumn("__seen", F.lit(True))
    asked = expected.groupBy(*by, key).agg(F.count("*").alias("__n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return asked.join(seen, [key], "left").groupBy(*by).agg(
        total(F.col("__n")).alias("expected"),
        total(F.when(F.col("__seen"), F.col("__n"))).alias("fetched"),
        total(F.when(F.col("__seen").isNull(), F.col("__n"))).alias("failed"),
    )


def last_part(path: Column) -> Column:
    """The name at the end of a path. It tells files apart only where no folder of another model or domain repeats it."""
    return F.element_at(F.split(path, "/"), -1)


def _named(files: DataFrame, key: str, name: str, local: Callable[[Column], Column] | None) -> DataFrame:
    return files.select((F.col(key) if local is None else local(F.col(key))).alias(name)).distinct()


def arrived_rows(
    raw: DataFrame, expected: DataFrame, arrived: DataFrame, key: str = "path", name: str = "file_path",
    local: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Rows of ``raw`` whose file was asked for and has arrived.

    Rows carry the whole path of their file (``with_file_path``), as the manifest has it; paths of other models, scenarios or
    domains end in the same name. ``local`` maps a path of the manifest to what the rows carry instead, such as the name of
    the fetched copy.
    """
    files = _named(expected, key, name, local).join(_named(arrived, key, name, local), [name], "left_semi")
    return raw.join(files, [name], "left_semi")


def files_without_rows(
    raw: DataFrame, arrived: DataFrame, key: str = "path", name: str = "file_path", local: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Arrived files from which no row was read: empty or unreadable ones, to be reported."""
    own = F.col(key) if local is None else local(F.col(key))
    return arrived.withColumn(name, own).join(raw.select(name).distinct(), [name], "left_anti").select(*arrived.columns)


def read_arrived(spark: SparkSession, root: str, paths: Sequence[str], schema: StructType | str) -> DataFrame:
    """Rows of Parquet files below ``root``, with ``file_path``; files that cannot be read are passed over, not the job's end.

    ``files_without_rows`` names them. The schema is given, as no footer may be needed for it. A file is a unit: with a part
    of it unreadable, the rows before that part are read, so rewrite a reported or doubtful file whole.
    """
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return with_file_path(reader.parquet(*[f"{root.rstrip('/')}/{p.lstrip('/')}" for p in paths]), root)


def download_plan(
    index: DataFrame, parameters: Sequence[str] | Mapping[str, str], file: str = "file", offset: str = "offset", line: str = "line"
) -> DataFrame:
    """The byte ranges to fetch of each file: file, first_byte, last_byte, messages, lines.

    ``index`` holds the inventory lines of files with the byte where their message begins. A message ends before the next one
    of its file, whatever that holds; the last runs to the end of the file (last_byte is missing). Messages that follow each
    other join into one range. Lines of one message (same offset) are fetched if one of them is asked for; ``lines`` are those
    asked for, in order. A file's inventory is small, so its lines are one window.
    """
    wanted = F.coalesce(F.col(line).rlike(search_pattern(parameters)), F.lit(False))
    asked = F.array_sort(F.collect_list(F.when(wanted, F.col(line))))
    messages = index.groupBy(file, offset).agg(asked.alias("lines")).withColumn("__hit", F.size("lines") > 0)
    by = Window.partitionBy(file).orderBy(offset)
    fresh = F.col("__hit") & ~F.lag("__hit", 1, False).over(by)
    placed = messages.withColumns({"__next": F.lead(offset).over(by), "__range": F.sum(fresh.cast("int")).over(by)})
    inside = F.transform(F.array_sort(F.collect_list(F.struct(offset, "lines"))), lambda m: m["lines"])
    # the next message of the last one tells the end; without one the range is open
    return placed.filter("__hit").groupBy(file, "__range").agg(
        F.min(offset).alias("first_byte"), (F.max_by("__next", offset) - 1).alias("last_byte"),
        F.count("*").alias("messages"), F.flatten(inside).alias("lines"),
    ).drop("__range")


def require_arrivals(arrived: DataFrame) -> DataFrame:
    """Stop before any work when nothing came."""
    if arrived.isEmpty():
        raise ValueError("no files arrived")
    return arrived


def prism_name_parts(df: DataFrame, name: str = "file_name", frequency: str = "daily") -> DataFrame:
    """Variable (second part) and date (fifth part, up to the dot) of a PRISM file name.

    A name without a date stops the job: rows of files without a time would meet as one.
    ``bad_prism_names`` lists such names beforehand.
    """
    variable, date = _prism_parts(name, frequency)
    wrong = F.raise_error(F.concat(F.lit("no date in the file name "), F.coalesce(F.col(name), F.lit("NULL"))))
    return df.withColumns({"variable": variable, "date": F.coalesce(date, wrong.cast("date"))})


def bad_prism_names(df: DataFrame, name: str = "file_name", frequency: str = "daily") -> DataFrame:
    """The distinct file names that hold no date."""
    return df.select(name).distinct().filter(_prism_parts(name, frequency)[1].isNull())


def _prism_parts(name: str, frequency: str) -> tuple[Column, Column]:
    parts = F.split(F.element_at(F.split(F.col(name), "/"), -1), "_")
    key = F.split(F.get(parts, F.lit(4)), r"\.")[0]
    pad = {"daily": "", "monthly": "01", "annual": "0101"}[frequency]
    digits = F.concat(key, F.lit(pad))
    good = F.length(digits) == 8
    date = F.when(
        good,
        F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date"),
    )
    return F.get(parts, F.lit(1)), date


def with_file_name(df: DataFrame) -> DataFrame:
    """The name of the file each row was read from."""
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def with_file_path(df: DataFrame, root: str) -> DataFrame:
    """The path of the file each row was read from, below ``root``, unescaped as a manifest has it."""
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return df.withColumn("file_path", F.replace(path, F.lit(base), F.lit("")))

"""Text grids for hydrology models: per time step one line per grid row, then an empty line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import two_decimals


def text_grid(
    df: DataFrame, value: str, steps: Sequence[str] = ("time",), y: str = "y", x: str = "x", cells: DataFrame | None = None
) -> DataFrame:
    """Lines (steps..., line_no, line) of the grid, from at most one row per step and cell.

    A line gathers the cells of one grid row; lines without cells are made between the others, in their order, so no
    row holds a step. Absent cells print as ``nan``; every step has all grid rows and the empty line. The limits of the
    grid come from ``cells``, a table of its cells, or else from a pass over the data. A cell without ``y`` is an error.
    """
    steps = list(steps)
    ends = (df if cells is None else cells).agg(F.struct(*[f(c).alias(n) for n, f, c in (
        ("x0", F.min, x), ("x1", F.max, x), ("y0", F.min, y), ("y1", F.max, y))])).scalar()
    x0, x1, row = F.col("__e.x0"), F.col("__e.x1"), F.col("__r")
    gap = lambda n: F.repeat(F.lit("nan "), n)
    before = lambda i: F.when(i == 0, x0 - 1).otherwise(F.get(row, i - 1)["x"])
    known = F.array_join(F.transform(row, lambda c, i: F.concat(gap(c["x"] - before(i) - 1), c["t"])), " ")
    row_of = F.coalesce(F.col(y), F.raise_error(F.lit("a cell without a grid row cannot be written")).cast(df.schema[y].dataType))
    written = (
        df.select(*steps, row_of.alias(y), F.struct(F.col(x).alias("x"), two_decimals(value).alias("t")).alias("__c"))
        .groupBy(*steps, y).agg(F.sort_array(F.collect_list("__c")).alias("__r"))
        .withColumn("__e", ends)
        .select(*steps, y, F.concat(known, F.repeat(F.lit(" nan"), x1 - F.element_at(row, -1)["x"])).alias("line"))
    )
    # each known line writes the blank ones up to the next known line of its step, the first also those before it
    order = Window.partitionBy(*steps).orderBy(y)
    low = F.when(F.row_number().over(order) == 1, F.col("__e.y0")).otherwise(F.col(y))
    high = F.coalesce(F.lead(y).over(order) - 1, F.col("__e.y1") + 1)
    whole = written.withColumn("__e", ends).select("*", low.alias("__low"), high.alias("__high"))
    whole = whole.select(*steps, "__e", y, "line", F.explode(F.sequence("__low", "__high")).alias("__y"))
    blank = F.when(F.col("__y") > F.col("__e.y1"), F.lit("")).otherwise(F.rtrim(gap(x1 - x0 + 1)))
    line = F.when(F.col(y) == F.col("__y"), F.coalesce("line", blank)).otherwise(blank)
    return whole.select(*steps, (F.col("__y") - F.col("__e.y0")).cast("int").alias("line_no"), line.alias("line"))


def write_text_grid(lines: DataFrame, path: str, steps: Sequence[str] = ("time",), mode: str = "errorifexists", time: str | None = None) -> str:
    """The lines of all steps in order: files sorted by name follow each other in time.

    One folder per year of ``time`` (the last of ``steps``) and further ones for the other steps, such
    as product or scenario. Tasks hold ranges of steps, so no folder is one task's.
    """
    steps = list(steps)
    time = time or steps[-1]
    folders = [s for s in steps if s != time]
    (
        lines.withColumn("year", F.year(time))
        .repartitionByRange(*folders, time, "line_no")
        .sortWithinPartitions(*folders, "year", time, "line_no")
        .select(*folders, "year", "line")
        .write.mode(mode).partitionBy(*folders, "year").text(path)
    )
    return path


def read_text_grid(spark: SparkSession, path: str) -> DataFrame:
    """Lines of written grids: the folders' columns, the file and the place of the line in it, both in order.

    A file is read as a whole, so it should be the size of a task.
    """
    rows = spark.read.option("wholetext", True).text(path).withColumn("file", F.col("_metadata.file_name"))
    names = [c for c in rows.columns if c not in ("value", "file")]
    each = F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("place", "line")
    return rows.select(*names, "file", each)

"""Changing a cube store in place: replacing products, and merging late or corrected files.

A store is Parquet partitioned as ``catalog.write_cube`` does. Both changes write to a staging folder that Spark's commit
moves over the partitions it has rows for, so a job that fails leaves the old files, and partitions without new rows keep theirs.
Only names of folders and files come to the driver, never rows.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small
from ..session import stored
from . import catalog

LOAD, DIGEST = "load", "load_digest"


def partition_files(spark: SparkSession, path: str) -> dict[str, frozenset[str]]:
    """The partition folders of a store, relative to it, and the names of their files; hidden folders are left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    base = files.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    found: dict[str, set[str]] = {}
    every = files.listFiles(root, True)
    while every.hasNext():
        name = every.next().getPath().toUri().getPath().removeprefix(base)
        folder, _, file = name.rpartition("/")
        if not any(part[:1] in "._" for part in name.split("/")):
            found.setdefault(folder, set()).add(file)
    return {folder: frozenset(names) for folder, names in found.items()}


def drop_partitions(spark: SparkSession, path: str, folders: Sequence[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in folders:
        files.delete(hadoop.Path(f"{path.rstrip('/')}/{folder}"), True)


def _write(df: DataFrame, path: str, parts: Sequence[str], time: str) -> None:
    """Partitions that get rows are replaced when the whole job is done."""
    order = [*parts, time, *[c for c in ("y", "x", "site") if c in df.columns]]
    rows = df.hint("rebalance", *parts).sortWithinPartitions(*order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def replace(
    df: DataFrame, path: str, partitions: Sequence[str] = catalog.PARTITIONS, time: str = "time", product: str = "product"
) -> list[str]:
    """Put a cube in the place of what the store holds of its products; other products stay as they are.

    Partitions of these products that the new cube has no rows for go, after the new ones are in place. An empty cube changes
    nothing. Returns the folders written. Interrupted between the two steps, the same call finishes the work.
    """
    spark = df.sparkSession
    df, parts = catalog.prepared(df, partitions, time)
    if product not in parts:
        raise ValueError(f"a store that is not partitioned by {product} cannot be replaced by product")
    before = partition_files(spark, path)
    _write(df, path, parts, time)
    after = partition_files(spark, path)
    # a commit gives its files new names, so folders that look as before were not written
    written = [folder for folder, names in after.items() if before.get(folder) != names]
    products = {_value(folder, product) for folder in written}
    stale = [folder for folder in after if folder not in set(written) and _value(folder, product) in products]
    drop_partitions(spark, path, stale)
    return written


def _value(folder: str, column: str) -> str | None:
    return next((part.partition("=")[2] for part in folder.split("/") if part.startswith(f"{column}=")), None)


def with_digests(df: DataFrame, parts: Sequence[str], load: str = LOAD) -> DataFrame:
    """Rows with a digest of all rows of their file in their partition: the count and the sum of the rows' hashes.

    The column is constant within a file and partition, so it takes no room and can be read without the values.
    """
    values = sorted(c for c in df.columns if c not in (DIGEST, load, *parts))
    row = F.xxhash64(*[F.col(c).cast("string") for c in values], *[F.col(c).isNull() for c in values])
    total = F.sum(row.cast("decimal(20,0)")).cast("string")
    digests = df.groupBy(*parts, load).agg(F.concat_ws(":", F.count("*").cast("string"), total).alias(DIGEST))
    keys = [*parts, load]
    same = functools.reduce(operator.and_, [F.col(f"rows.{k}").eqNullSafe(F.col(f"digests.{k}")) for k in keys])
    both = df.drop(DIGEST).alias("rows").join(broadcast_if_small(digests).alias("digests"), same)
    return both.select("rows.*", f"digests.{DIGEST}")


def _loads(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The files of a table by partition, with the digests of their rows."""
    text = [F.coalesce(F.col(p).cast("string"), F.lit("")).alias(p) for p in parts]
    return df.select(*text, LOAD, DIGEST).distinct()


def changed_partitions(store: DataFrame, late: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Partitions in which a file of ``late`` has other rows than the store holds of it: new, corrected, or moved away."""
    files = broadcast_if_small(late.select(LOAD).distinct())
    held = _loads(store, parts).join(files, LOAD, "left_semi")
    keys = [*parts, LOAD]
    new = _loads(late, parts)
    differing = new.join(held, [*keys, DIGEST], "left_anti").select(*parts)
    gone = held.join(new, [*keys, DIGEST], "left_anti").select(*parts)
    return differing.unionByName(gone).distinct()


def merge(
    df: DataFrame, path: str, load: str = "file_name", partitions: Sequence[str] = catalog.PARTITIONS, time: str = "time"
) -> list[str]:
    """Add the rows of files to a store once: a file that is there already is replaced, the last one given wins.

    ``load`` names the file a row came from (kept as the column ``load``). Only partitions in which a file's rows differ from
    those stored are written anew; the same files given twice write nothing. Rows of files not in ``df`` stay, also rows
    without a file name (they are never replaced; new ones without a name are refused). The store's other columns are kept,
    missing ones are filled with NULL. Returns the partitions written. ``df`` is computed once, into the scratch folder.
    Two merges into one store must not run at the same time.
    """
    spark = df.sparkSession
    if load != LOAD:
        df = df.drop(LOAD).withColumnRenamed(load, LOAD)
    named = F.coalesce(LOAD, F.raise_error(F.lit("a row without a file name cannot be merged")).cast("string"))
    df, parts = catalog.prepared(df.withColumn(LOAD, named), partitions, time)
    late = with_digests(stored(df, "late"), parts)
    store = _opened(spark, path)
    if store is None:
        _write(late, path, parts, time)
        return sorted(partition_files(spark, path))
    if missing := {LOAD, DIGEST, *parts} - set(store.columns):
        raise ValueError(f"the store was not written by merge: it has no {', '.join(sorted(missing))}")
    late = _filled(late, store)
    store = _filled(store, late)
    # partitions are products and years: names, not data
    changed = [tuple(r) for r in changed_partitions(store, late, parts).collect()]
    if not changed:
        return []
    here = functools.reduce(operator.or_, [_is(parts, values) for values in changed])
    files = broadcast_if_small(late.select(LOAD).distinct())
    kept = store.filter(here).join(files, LOAD, "left_anti")
    before = partition_files(spark, path)
    _write(kept.unionByName(late.filter(here)), path, parts, time)
    after = partition_files(spark, path)
    written = sorted(folder for folder, names in after.items() if before.get(folder) != names)
    # a partition all of whose rows moved away got no rows, so the commit left it
    empty = {_folder(parts, values) for values in changed} - set(written)
    drop_partitions(spark, path, sorted(empty & set(after)))
    return written


def _opened(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return catalog.read_cube(spark, path) if partition_files(spark, path) else None
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _filled(df: DataFrame, like: DataFrame) -> DataFrame:
    absent = {f.name: F.lit(None).cast(f.dataType) for f in like.schema if f.name not in df.columns}
    return df.withColumns(absent) if absent else df


def _is(parts: Sequence[str], values: Sequence[str]) -> Column:
    return functools.reduce(operator.and_, [F.coalesce(F.col(p).cast("string"), F.lit("")) == v for p, v in zip(parts, values, strict=True)])


def _folder(parts: Sequence[str], values: Sequence[str]) -> str:
    return "/".join(f"{p}={v or '__HIVE_DEFAULT_PARTITION__'}" for p, v in zip(parts, values, strict=True))

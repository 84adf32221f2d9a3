"""What the operators share: the cluster's shared folder, written intermediate tables, tables by name."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import checkpoint_dir, ship_package

#: A key is hot if it holds over one in HOT of all rows, so there are at most HOT hot keys.
HOT = 1_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_python(spark: SparkSession, rows: int = 2_000) -> None:
    """Prepares a session for Python functions over texts: the package goes to the workers, batches become smaller.

    Texts are long: Arrow batches of Spark's default of 10,000 rows hold too much, on both sides of the worker. The
    setting is read when a plan runs, so it stays on the session; one that the user has chosen is left alone.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else what the context was given.

    Without either, a local master gets a temporary folder; on a cluster, whose executors could not see it, that is an
    error.
    """
    return checkpoint_dir(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffle_files_end_with_the_job(spark: SparkSession):
    """Jobs run inside drop their shuffle files when they end: what they wrote is a table by then."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back.

    A lost executor then costs a re-read, not a re-run, and the optimizer knows the table's true size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffle_files_end_with_the_job(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more: neither a result nor a table still to be written."""
    for table in tables:
        if path := getattr(table, "_written_to", None):
            remove(table.sparkSession, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once and hands it to body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(rows: DataFrame, table: DataFrame, on: dict[str, str], weight: str, how: str = "inner") -> DataFrame:
    """rows.join(table) on unique keys of table, without hot keys meeting in one task; how: inner, left or left_semi.

    weight says how many rows a key has. Keys with over one in HOT of all weight are at most HOT; their rows of table
    are broadcast, and the rows that have such a key stay where they are; a table of at most HOT rows is broadcast whole.
    The rest is joined by shuffle. rows is read twice, so it should be a table that is cheap to read again. Columns of table other than the keys come along
    (left_semi: none).
    """
    total, most, many = table.agg(F.sum(weight), F.max(weight), F.count(F.lit(1))).first()
    match = reduce(lambda a, b: a & b, (F.col(a) == F.col(b) for a, b in on.items()))
    if many <= HOT:
        return rows.join(F.broadcast(table), match, how)
    if most * HOT <= total:
        return rows.join(table, match, how)
    heavy = F.col(weight) * HOT > total
    hot, cold = table.filter(heavy), table.filter(~heavy)
    near = rows.join(F.broadcast(hot), match, "left_semi" if how == "left_semi" else "inner")
    rest = rows.join(F.broadcast(hot.select(*on.values())), match, "left_anti").join(cold, match, how)
    return near.unionByName(rest)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh_path() named, through Hadoop's file system layer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)

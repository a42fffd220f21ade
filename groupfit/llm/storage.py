"""Tables that several jobs share, written where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="groupfit-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The session's folder of tables within the shared one."""
    return f"{shared_dir(spark)}/groupfit-{spark.sparkContext.applicationId}"


#: Rows of short columns that are written as one file.
FILE = 25_000


def keep(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends there, losing an executor doesn't matter.

    Results read such tables when they are used, so they stay until `clear`; what an operator no longer needs itself it discards.
    `most`, a bound on the rows of a table of short columns, bounds its files as well: each file costs its task some processes
    on a local disk and a request in a store, and with many partitions that is more than the rows cost.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if most is None else df.coalesce(max(1, -(-most // FILE)))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `keep` wrote and no frame reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._kept)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this session has kept, once its results have been used."""
    _delete(spark, own_dir(spark))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(columns: list[str], wanted: str) -> str:
    """`wanted`, or with underscores in front where a column has that name already (case aside)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A key is hot from 1 / HOT of all rows on.
HOT = 2000


def by_key(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, how: str = "inner", count: str = "n") -> DataFrame:
    """`rows` (`total` of them) joined to `table`: one row for each key, and how many of `rows` have it in the column `count`.

    Hot keys, no more than HOT by their counts, are broadcast, so their rows stay where they are. `table` should be a written one.
    """
    key = [key] if isinstance(key, str) else key
    least = max(1000, total // HOT)
    hot, all_ = table.where(F.col(count) > least).drop(count), table.drop(count)
    if hot.isEmpty():
        return rows.join(all_, key, how)
    cold = table.where(F.col(count) <= least).drop(count)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key, how))

"""Session helpers: shared folder, staged tables, size-checked joins, keys.

Everything that cuts lineage goes through :func:`stage`, which writes a
Parquet table into the folder the cluster names in ``spark.checkpoint.dir``.
Such a table outlives the executors that wrote it, so a job that loses one
recomputes only the tasks that were running.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine serves a session in local mode
    (tests); on a cluster, whose executors could not reach it, that is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="veilwork-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def _remove(path: str) -> None:
    spark = _staged.pop(path, None)
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def drop(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in staged:
        _remove(df._staged_path)


def drop_staged(keep: set[str] | None = None) -> None:
    """Remove all staged tables of this process, but for those in ``keep``; results that read them must be finished."""
    for path in [p for p in _staged if p not in (keep or ())]:
        _remove(path)


@contextmanager
def staging():
    """``with staging(): df = query(...); df.write...`` frees what the query staged when the block is left."""
    before = set(_staged)
    try:
        yield
    finally:
        drop_staged(before)


atexit.register(drop_staged)


def _bytes(df: DataFrame) -> Column:
    """Estimate of a row's size in memory."""
    out = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            out = out + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, T.ArrayType):
            out = out + 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) + 24
        else:
            out = out + 8
    return out


def join_sized(big: DataFrame, small: DataFrame, on, how: str = "inner", limit_bytes: int = 48 << 20) -> DataFrame:
    """Join with ``small``, a staged table.

    It is broadcast only when its rows come to at most ``limit_bytes``, as
    measured over all of them; beyond that Spark shuffles both sides.
    """
    size = small.agg(F.sum(_bytes(small).cast("long"))).first()[0] or 0
    return big.join(F.broadcast(small) if size <= limit_bytes else small, on, how)


def clean_key(col: Column) -> Column:
    """One spelling for a key: outer blanks, case, ``urn:`` and ``_`` for ``-`` do not count.

    Null, empty and blank keys become null.
    """
    bare = F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
    bare = F.translate(F.regexp_replace(bare, r"^urn:", ""), "_", "-")
    return F.when(F.length(bare) > 0, bare)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its source is too small to be split among them.

    The size is the optimizer's estimate; nothing is run.  A source that fills
    a partition per core is left as it is read.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if size < cores * split else df

"""Work tables: intermediate results written once to storage that the whole cluster shares.

Several operators use one expensive intermediate result more than once, or iterate.
Writing it to the folder that ``spark.checkpoint.dir`` names cuts the lineage, so a lost
executor costs the re-read of a file and never the recomputation of the corpus.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared folder.

    ``spark.checkpoint.dir`` decides. Only a local master, where driver and executors are
    one process, may fall back to a temporary folder; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = context.get() if context.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="mosslight-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
        base = "file://" + base
    return f"{base.rstrip('/')}/mosslight-{uuid.uuid4().hex}"


_written: list[str] = []
_generation = 0


def clear(spark: SparkSession, since: int = 0) -> int:
    """Delete the work tables that this process has written, or those after its first ``since``.

    Call it once results that read them are stored.
    """
    global _generation
    n, _generation = 0, _generation + 1
    while len(_written) > since:
        n += _delete(spark, _written.pop())
    return n


def generation() -> int:
    """Changes whenever work tables were cleared, so that what was remembered of them can be dropped."""
    return _generation


def written() -> int:
    """How many work tables there are; a mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int, keep: int = 1) -> int:
    """Delete the work tables written after the mark ``since``, but for the last ``keep``, whose readers have been stored.

    Shuffle files of plans that nothing refers to any more go with them.
    """
    last = len(_written) - keep
    gone, _written[since:] = _written[since:last], _written[last:]
    n = sum(_delete(spark, path) for path in gone)
    gc.collect()
    spark._jvm.System.gc()
    return n


def _delete(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet work table and return the table as a new DataFrame."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def modified(spark: SparkSession, path: str) -> int | None:
    """When a file or folder was last modified; None if it is gone."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(target).getModificationTime() if system.exists(target) else None


def placed(df: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns), ``place_file, place_row``: two longs that mean the same row whenever this is read.

    A scan of Parquet files, filtered or projected, has them already: a hash of the file's path
    and the row's index in it. Anything else is written to a work table first, and that is scanned.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    if "_metadata" in map(str.lower, df.columns) or not _is_scan(df):
        rows = stage(rows, "rows")
    return rows.select("row", F.xxhash64("_metadata.file_path").alias("place_file"), F.col("_metadata.row_index").alias("place_row"))


def _is_scan(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().toString() == "parquet"

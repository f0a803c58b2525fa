"""Written intermediate tables and session settings."""

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL, _SENT = {}, set()
#: Bytes of files, at most, of a table that is sent whole to every executor. Files say little of the rows in them: ids and paths of
#: stored nodes took 80 times their files' bytes in memory.
SENT_BYTES = 256 << 10


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="corpusgraph-")
    return _LOCAL["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/corpusgraph/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "cut", **options) -> DataFrame:
    """Write ``df`` once and read it back: the lineage ends here, lost executors do
    not re-run it, and the file sizes let the planner judge later joins. ``options`` are those of the writer."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _SENT:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), os.path.basename(package)), "zip", os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive)
        _SENT.add(application)


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on: re-planning and splitting of skewed joins,
    also where the split costs one more exchange; and no fused stage method that is too
    large for the JIT compiler (the rule projections are long). Python code is sent along.

    A table is broadcast by its files' size up to ``SENT_BYTES``; the session's own threshold holds for sizes of rows,
    which are measured while a query runs."""
    ship(spark)
    by_files, by_rows = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if spark.conf.get(by_rows, None) is None:
        spark.conf.set(by_rows, str(threshold))
    spark.conf.set(by_files, str(min(threshold, SENT_BYTES)))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark

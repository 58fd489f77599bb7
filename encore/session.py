"""Session defaults, the package on executors, and tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution plans joins by measured size, splits skewed ones and merges small parts.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "encore", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=DEFAULTS | conf).getOrCreate()


#: Rows of a narrow table that one task writes.
ROWS_IN_A_FILE = 1_000_000

_shipped: set[str] = set()
_folders: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of this application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="encore-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive.resolve()))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder, below the one that the cluster names for checkpoints.

    Where none is named a temporary folder does for a local master. On a cluster each
    executor would write to a disk of its own, so there it is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base and (named := context._jsc.sc().getCheckpointDir()).isDefined():
        base = named.get()
    if not base:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='encore-')}"
        context.setCheckpointDir(base)
    path = context._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base.removeprefix("file:")
    folder = f"{base.rstrip('/')}/encore-{context.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(clean, spark)
    return folder


def new_folder(spark: SparkSession) -> str:
    """The URI of a folder that does not exist yet, for one table."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder. Results read from it end, too."""
    context = spark.sparkContext
    if context._jsc is None or context._jvm is None:
        return
    for folder in [f for f in _folders if f.endswith(context.applicationId)]:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _folders.discard(folder)


def materialized(df: DataFrame, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    """``df`` written as a table to the shared folder and read again, which ends its lineage.

    rows: a bound of its rows, where it is known and small beside the work of making them;
    the table then has a file for every ``ROWS_IN_A_FILE`` of them, not one for every task.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    out = df if rows is None else df.repartition(max(1, -(-rows // ROWS_IN_A_FILE)))
    out.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

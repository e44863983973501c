"""Session helpers: where lineage is cut, and how intermediate tables are written."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, ``local[...]``) is a folder of our own made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jsc.get() if jsc.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        named = "file://" + own
    return named.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver's Python ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/lexiloom/{context.applicationId}"
    if not getattr(context, "_lexiloom_own", None):
        context._lexiloom_own = path
        atexit.register(forget, spark)
    return path


def forget(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. DataFrames that read them are void then."""
    path = getattr(spark.sparkContext, "_lexiloom_own", None)
    if path:
        _delete(spark, path)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside go when the block ends; take or write results before that.

    Without it they go when the driver's Python ends, so that a session of many queries should use it.
    """
    context = spark.sparkContext
    before = getattr(context, "_lexiloom_made", None)
    context._lexiloom_made = []
    try:
        yield
    finally:
        for path in context._lexiloom_made:
            _delete(spark, path)
        context._lexiloom_made = before


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the session may be gone already
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage and survives the loss of any executor; unlike
    ``checkpoint()`` it is columnar and compressed, so later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if getattr(spark.sparkContext, "_lexiloom_made", None) is not None:
        spark.sparkContext._lexiloom_made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, so that their Python finds it wherever it is run."""
    context = spark.sparkContext
    if getattr(context, "_lexiloom_sent", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lexiloom-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = f"{folder}/lexiloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(target)
    context._lexiloom_sent = True

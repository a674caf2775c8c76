"""Session helpers: shipping the package to executors and finding shared storage."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of `spark`, once per application.

    Reading, generating and scoring do so by themselves; a metric called as a column needs
    it unless the package is installed on every node. The archive is the driver's own copy,
    from which Spark hands the package to every worker.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if not package.is_dir():  # already running from a shipped archive
        return
    archive = Path(tempfile.mkdtemp(prefix="scoreframe-")) / "scoreframe.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all nodes share, as `spark.checkpoint.dir` names it.

    Without that setting a local session gets a temporary folder; a cluster has no
    machine-local folder that would survive a lost executor, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all nodes share")
        root = _local_root()
    return f"{root.rstrip('/')}/scoreframe/{name}-{uuid.uuid4().hex}"


def store(frame: DataFrame, name: str) -> DataFrame:
    """Write `frame` once to the shared folder and read it back, for use more than once.

    Unlike a cache the result survives a lost executor, and its lineage ends here.
    """
    return store_sized(frame, name)[0]


def store_sized(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`store`, and the path it wrote to, for `stored_bytes`."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    stored = frame.sparkSession.read.schema(frame.schema).parquet(path)
    _PLACES[stored] = path
    return stored, path


def store_bucketed(frame: DataFrame, key: str, name: str) -> DataFrame:
    """`store`, dealt into buckets by `key`: later joins on it do not shuffle this side.

    There are as many buckets as shuffle partitions. The table's entry in the catalogue is
    needed for writing alone and goes again; its files are those of a stored table.
    """
    spark = frame.sparkSession
    path = shared_path(spark, name)
    table = f"stored_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartition(buckets, key).write.format("parquet").option("path", path)
    dealt.bucketBy(buckets, key).saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    _PLACES[stored] = path
    return stored


def discard(*frames: DataFrame) -> None:
    """Delete tables of `store` or `store_bucketed` that nothing reads any more."""
    for frame in frames:
        path = _PLACES.pop(frame, None)
        if path is not None:
            remove(frame.sparkSession, path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of each job are deleted at its end.

    Else they stay until the driver happens to collect its garbage, those of all jobs of a
    long chain at worst. For chains whose tables are stored, which read no shuffle twice.
    """
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at `path`; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="scoreframe-")


def remove_stored(spark: SparkSession) -> None:
    """Delete all that this package has written below `spark.checkpoint.dir`.

    For the end of an application: tables that still read from there are lost.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = _local_root()
    if root:
        remove(spark, f"{root.rstrip('/')}/scoreframe")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(frame: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Shuffle rows by `keys`, so that costly per-row work uses all cores.

    Rows of few files, or of files too small to be split, leave most cores idle; whole
    texts are shuffled, so it is left to the caller. `partitions` defaults to four per
    core, or to `spark.sql.shuffle.partitions` if that is more.
    """
    spark = frame.sparkSession
    if partitions is None:
        planned = int(spark.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(4 * spark.sparkContext.defaultParallelism, planned)
    return frame.repartition(partitions, *keys)

"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lettermill")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_stand_in: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and driver and executors are one process (a
    ``local`` master, as in tests) a temporary folder stands in; a cluster
    without the setting is refused.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = context.applicationId
        found = _stand_in[app] = _stand_in.get(app) or tempfile.mkdtemp(prefix="lettermill-")
    return found.rstrip("/")


_scope: ContextVar[str] = ContextVar("scope", default="all")
#: Tables in the catalogue that are ours: application, scope and full name.
_made: list[tuple[str, str, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lettermill/{_scope.get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables that are made inside are removed at the end, and no
    others: results must have been written by then."""
    scope = uuid.uuid4().hex
    token = _scope.set(scope)
    try:
        yield f"{shared_dir(spark)}/lettermill/{scope}"
    finally:
        _scope.reset(token)
        remove_tables(spark, scope)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and
    the rows outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``durable``, but dealt by ``key`` into as many buckets as a shuffle
    has partitions, so that several joins on ``key`` move the other side only.
    The table is an external one of the session's catalogue."""
    spark = df.sparkSession
    n, table = shuffle_partitions(spark), f"lettermill_{_scope.get()}_{uuid.uuid4().hex}"
    _made.append((spark.sparkContext.applicationId, _scope.get(), f"`{spark.catalog.currentDatabase()}`.`{table}`"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Where the session has Spark's default of 10,000 rows, Arrow batches are
    held to ``BATCH_ROWS``: whole documents in batches of that many would fill
    an executor.
    """
    import shutil
    from pathlib import Path

    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    app, here = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _shipped or not here.is_dir():
        return
    folder = Path(tempfile.mkdtemp(prefix="lettermill-ship-"))
    shutil.copytree(here, folder / "code" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / here.name), "zip", folder / "code"))
    _shipped.add(app)


def remove_tables(spark: SparkSession, scope: str = "") -> None:
    """Delete what ``durable`` and ``new_path`` have put in the shared folder
    (of one ``scratch``, or all), and the tables that ``durable_buckets`` has
    made in this application's catalogue, whatever their database, once no
    DataFrame that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lettermill/{scope}".rstrip("/"))
    mine = [m for m in _made if m[0] == spark.sparkContext.applicationId and (not scope or m[1] == scope)]
    for made in mine:
        spark.sql(f"DROP TABLE IF EXISTS {made[2]}")
        _made.remove(made)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

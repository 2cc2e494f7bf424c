"""Session helpers: sessions for local work, and the shared scratch folder.

On a cluster the folder is the one named by ``spark.checkpoint.dir``; every
executor can read it, so a written table there survives the loss of executors.
Only where that setting is missing and Spark runs in one process (tests, a laptop) a
local folder is chosen; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def local_session(cores: int = 8, name: str = "evidlake", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Makes this package known to the Python workers, wherever the driver was started."""
    context = spark.sparkContext
    if not getattr(context, "_evidlake_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="evidlake-")  # the driver's copy; executors fetch it from there
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.addPyFile(shutil.make_archive(os.path.join(folder, "evidlake"), "zip", root, "evidlake"))
        context._evidlake_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.sparkContext.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="evidlake-")
        atexit.register(shutil.rmtree, root[len("file://") :], ignore_errors=True)
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/evidlake-{os.getpid()}/{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


_OPEN: list[tuple[SparkSession, str]] = []


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    if not _OPEN:
        atexit.register(release_all)
    _OPEN.append((spark, path))


def release(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_all() -> None:
    while _OPEN:
        spark, path = _OPEN.pop()
        try:
            release(spark, path)
        except Exception:  # one that cannot be deleted does not keep the others; the session may be gone already
            continue


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back; with ``by``, a folder for each of its values.

    Cuts the lineage where a result feeds several branches, without executor
    storage: a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class scratch:  # noqa: N801 - used as a context
    """``with scratch(): ...``: tables written inside are deleted at its end, so that a long session does not fill the folder.

    Results that are read later must be collected or stored inside.
    """

    def __enter__(self) -> scratch:
        self.before = len(_OPEN)
        return self

    def __exit__(self, *error: object) -> None:
        while len(_OPEN) > self.before:
            release(*_OPEN.pop())

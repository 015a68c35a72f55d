"""Session defaults, shared scratch space and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Defaults for sessions that this package opens itself; a cluster's own settings win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}

_SHIPPED: dict[str, str] = {}
_OWN_DIR = "siltstone-scratch"


def open_session(master: str = "local[*]", app: str = "siltstone", **conf: str) -> SparkSession:
    """A session with this package's defaults; keyword settings override them."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable by Python workers.

    Executors have no copy of the repository: the package is zipped once per application and
    handed to Spark, which serves it to every executor, late ones included.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(target))
    _SHIPPED[context.applicationId] = str(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/checkpoints/{_OWN_DIR}"
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """A fresh folder below the shared one, for tables that cut lineage.

    ``table`` writes and rereads; ``drop`` removes one table as soon as nothing reads it; what
    is left goes when the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def local_path(self, name: str) -> str | None:
        """The folder as a path that open() takes, where the shared folder is a mounted one."""
        if self.root.startswith("file:"):
            return "/" + self.root.removeprefix("file:").lstrip("/") + f"/{name}"
        return f"{self.root}/{name}" if self.root.startswith("/") else None

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone at exit
            if path.startswith("file:"):
                import shutil

                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def close(self) -> None:
        self._delete(self.root)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes: texts may be long."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}", str(2**31 - 1)))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

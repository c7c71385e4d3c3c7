"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session the cluster gives you."""
    builder = (
        SparkSession.builder.master(master)
        .appName("auditlake")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    ship(session)
    return session


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, once per application; tasks import it by name.

    Not needed where every machine has it on its Python path. The zip is made on the driver and handed out by Spark.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="auditlake-ship-")) / "auditlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(application)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares through ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is absent and the session is local, because
    other machines could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="auditlake-")
    return f"{base.rstrip('/')}/auditlake-{uuid.uuid4().hex}"


def written(df: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """The rows written below the shared folder and read again, by ``session`` if given, so that they are worked out once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    back = (session or df.sparkSession).read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def remove(*steps: DataFrame) -> None:
    """Delete the files of ``written`` rows that nothing reads any more."""
    for df in steps:
        if path := getattr(df, "written_at", None):
            there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)

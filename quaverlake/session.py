"""Session helpers shared by operators, queries, tests and the benchmark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quaverlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``; only where none is named
    (a local run, where driver and executors are one process) make a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quaverlake-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(f"file://{folder}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there. Used where a
    result is read several times, or where row ids given to it must survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _delete(sc, path: str) -> None:
    try:
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed columnar table in the same shared folder: later reads take only the
    columns they name, and Spark knows its size. The order of rows isn't kept. Deleted when Python ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    folder = f"{sc._jsc.sc().getCheckpointDir().get()}/stored"
    if not getattr(sc, "_quaverlake_stored", False):
        atexit.register(_delete, sc, folder)
        sc._quaverlake_stored = True
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, once nothing that is still to run reads it."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession.sparkContext, file)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context: their workers may lack it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_quaverlake_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="quaverlake-package-")) / "quaverlake.zip"
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, Path("quaverlake") / file.relative_to(package))
    sc.addPyFile(str(archive))
    sc._quaverlake_shipped = True


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where a small or unsplittable file would leave most of them idle."""
    cores = parallelism(df.sparkSession)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

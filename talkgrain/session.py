"""Session settings that results depend on."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "talkgrain", **conf) -> SparkSession:
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where the session names none a local master gets a folder of its own; on a cluster that is an error, as no other machine would see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="talkgrain-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, so that lineage ends there and a lost executor costs a re-read only. It goes when the program ends."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    atexit.register(_gone, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a Spark application, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_talkgrain_shipped", None) == sc.applicationId:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="talkgrain-")) / "talkgrain.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(Path(package.name) / f.relative_to(package)))
    sc.addPyFile(str(archive))
    sc._talkgrain_shipped = sc.applicationId


def _gone(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended already
        pass


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _file(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    p, fs = _file(spark, path)
    if not fs.rename(p, _file(spark, to)[0]):
        raise OSError(f"{path} could not be moved to {to}")


def kept_table(spark: SparkSession, sf_dir: str, table_: str, name: str, build) -> str:
    """The folder that build(path) fills once a session and state of a table: it is built in a folder of its own and then moved, so that no reader sees half of it.
    It goes when the program ends."""
    files = spark.read.parquet(f"{sf_dir}/{table_}.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.selectExpr("bit_xor(xxhash64(file_path, file_size, file_modification_time)) AS s").first()["s"] or 0
    path = f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{state & (2**64 - 1):016x}"
    if not exists(spark, path):
        own = f"{path}.{uuid.uuid4().hex}"
        atexit.register(_gone, spark, path)
        build(own)
        rename(spark, own, path)
    return path

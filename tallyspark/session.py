"""Session helpers: shared folder, written and cached tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import functools
import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows and bytes (of its file) is sent to every executor; beyond it both sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20


def build_session(app: str = "tallyspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; anything already configured by the cluster wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is the session's spark.checkpoint.dir; where that is unset and all runs in one
    process (tests), a temporary folder is made and set. On a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tallyspark/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(drop)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and an executor's loss does not lose it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(written_df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table may be sent to every executor, by its rows and the bytes of its files."""
    size = int(str(written_df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= BROADCAST_BYTES and written_df.limit(max_rows + 1).count() <= max_rows


def small_or_shuffled(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it is shown to be small; otherwise return it unmarked, and joins with it shuffle. df is written first, so that counting
    and joining do not compute it twice."""
    df = written(df, "small")
    return F.broadcast(df) if is_small(df, max_rows) else df


def file_marks(spark: SparkSession, path: str) -> list[str]:
    """Name, length and time of change of every file under a path; what a cached result of it depends on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return sorted(out)


@functools.cache
def code_mark() -> str:
    """Of the code that makes results: what is kept beyond a session must not outlive a change of it."""
    here = Path(__file__).parent
    files = sorted([here / "config.py", *(here / "functions").glob("*.py"), *(here / "operators").glob("*.py")])
    return hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]


def cached(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame], version: str = "1") -> DataFrame:
    """The table that make() gives, kept in the shared folder under a fingerprint of the input files and the code: computed once as long as these stay as they are. Only a complete table is
    read; of two sessions that make it at once, one's copy is kept. Tables of the same name and inputs with another fingerprint are removed after an hour."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    digest = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()[:24]
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tallyspark/cache/{name}-{digest(*inputs)}")
    to = jvm.org.apache.hadoop.fs.Path(folder, digest(version, code_mark(), *(m for i in inputs for m in file_marks(spark, i))))
    fs = to.getFileSystem(conf)
    if not fs.exists(to):
        df = make()
        path = new_path(spark, name)
        df.write.mode("errorifexists").parquet(path)
        fs.mkdirs(folder)
        for old in fs.listStatus(folder):
            if old.getModificationTime() < (time.time() - 3600) * 1000:
                fs.delete(old.getPath(), True)
        if not fs.exists(to) and not fs.rename(jvm.org.apache.hadoop.fs.Path(path), to):
            return spark.read.schema(df.schema).parquet(path)
    return spark.read.parquet(to.toString())


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files make fewer tasks than there are (a small file is one task, whatever is computed of its rows). Select the columns first."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > n else df.repartition(n)


def at_once(*makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """Call functions that build frames side by side, so that the small jobs which some of them run overlap."""
    with ThreadPoolExecutor(min(8, len(makers))) as pool:
        return list(pool.map(lambda f: f(), makers))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

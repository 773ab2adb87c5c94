"""Session helpers: a local session for tests and bench, and tables written to
the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "vecprobe") -> SparkSession:
    """Local session used by tests and bench.py. On a cluster, build the
    session from the cluster config instead; operators never rely on this."""
    if shuffle_partitions is None:
        # 4 x cores: big aggregations get small per-task hash maps; AQE
        # coalesces the many tiny partitions of small shuffles back down
        shuffle_partitions = 4 * int(cpus) if str(cpus).isdigit() else 32
    parts = shuffle_partitions
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session, else the folder the caller
    set on the context. Only a ``local`` master, where both sides are one
    process, may fall back to a temporary folder; a cluster without a shared
    folder is an error, as each node has its own ``/tmp``."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    sc = spark.sparkContext
    chosen = sc._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    d = tempfile.mkdtemp(prefix="vecprobe-shared-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table, in this application's own folder of
    the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/vecprobe-{spark.sparkContext.applicationId}/{name}"


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back:
    later stages prune columns, push filters and know sizes, and a lost
    executor costs a reread, not a rebuild."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_folder(path: str) -> pa.Table | None:
    """The Parquet rows of one folder below ``scratch_path``, inside a task;
    None where there is none."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    files = [f.path for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.ParquetFile(system.open_input_file(f)).read() for f in sorted(files)]
    return pa.concat_tables(tables) if sum(map(len, tables)) else None


def clear_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it once the
    results have been written."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, ""))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

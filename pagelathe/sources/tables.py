"""Reading the driver's tables, and sessions for tests and benches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`; Spark's reader alone touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: str = "8", app: str = "pagelathe", memory: str = "12g", **conf) -> SparkSession:
    """A local session with UTC time and adaptive execution."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset in a local session, as in tests, one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = _OWN.setdefault(context.applicationId, f"file://{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again, for plans that use it more than once: it is computed once, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt to all cores where it comes in fewer files than there are cores; tables of many files stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df

"""Session settings and the shared folder for checkpoints and written intermediates."""

from __future__ import annotations

import contextvars
import io
import pathlib
import re
import uuid
import zipfile

from pyspark.sql import SparkSession

# Sizes are left to AQE: shuffle partitions are coalesced or split at run time, joins are
# broadcast only when the measured size of a side is below the threshold, and skewed join
# partitions are split.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "provisor", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which driver and executors must share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in any file system that Spark can read."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(context._jsc.hadoopConfiguration())
    return system.exists(where) and system.getFileStatus(where).isDirectory()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application, through the shared folder.

    Call it before a Python function of the package goes into a plan; it works for sessions that
    others have built and from any working directory.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, f"{package.name}/{file.relative_to(package)}")
    target = f"{shared_dir(spark, 'package')}/{package.name}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


#: Bytes of a batch of rows that goes to a Python worker; a longer row goes alone.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let batches for Python workers hold ``BATCH_BYTES`` at most; the session's own limit stays if it is smaller."""
    if not 0 < int(str(spark.conf.get(_BATCH)).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


#: Shuffled bytes that one task reads, and partitions that a shuffle starts with.
TASK_BYTES, TASKS = 4 << 20, 512
_ADVISED, _INITIAL = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_SKEWED = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def bound_tasks(spark: SparkSession) -> None:
    """Let adaptive execution merge partitions only up to ``TASK_BYTES``, out of ``TASKS`` at least.

    A joined partition counts as skewed from four times that on. Both go by compressed bytes. Label texts and rows of ids compress well and become many tokens, each with
    a row in the hash tables and sorts of the task, so 64 MB of them need gigabytes. Smaller settings of
    the session stay.
    """
    _bound(spark, TASK_BYTES)


def _bound(spark: SparkSession, task_bytes: int) -> None:
    for name, most in ((_ADVISED, task_bytes), (_SKEWED, 4 * task_bytes)):
        number, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", str(spark.conf.get(name)).strip().lower()).groups()
        if int(number) * _UNITS[unit] > most:
            spark.conf.set(name, str(most))
    begun = int(spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(_INITIAL, str(max(begun, TASKS)))


_BLOCK: contextvars.ContextVar[scratch | None] = contextvars.ContextVar("_BLOCK", default=None)
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class scratch:
    """A block whose intermediates leave the disk when it ends.

    Tables that ``cut_lineage`` writes inside are deleted with the block; ``keep`` writes one that
    stays for the enclosing block or, without one, for good. Shuffle files go when their query ends,
    not when the driver happens to collect its garbage. After the block use only frames from
    ``keep``, or from before it. With ``task_bytes`` adaptive execution merges the partitions of its
    queries up to that size only (see ``bound_tasks``).
    """

    def __init__(self, spark: SparkSession, task_bytes: int | None = None):
        self._spark, self._paths, self._task_bytes = spark, [], task_bytes

    def __enter__(self) -> scratch:
        self._outer = _BLOCK.get()
        self._token = _BLOCK.set(self)
        self._before = {name: self._spark.conf.get(name, None) for name in (_CLEANED, _ADVISED, _SKEWED, _INITIAL)}
        self._spark.conf.set(_CLEANED, "true")
        if self._task_bytes:
            _bound(self._spark, self._task_bytes)
        return self

    def __exit__(self, *_) -> None:
        _BLOCK.reset(self._token)
        for name, value in self._before.items():
            if value is None:
                self._spark.conf.unset(name)
            else:
                self._spark.conf.set(name, value)
        context = self._spark.sparkContext
        for path in self._paths:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

    def keep(self, df, purpose: str):
        """``cut_lineage`` for a table that outlives the block."""
        return _written(df, purpose, self._outer)


def _written(df, purpose: str, block: scratch | None):
    path = shared_dir(df.sparkSession, purpose)
    if block is not None:
        block._paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df, purpose: str):
    """Write a frame once to the shared folder and read it back; survives lost executors.

    Inside a ``scratch`` block the table goes with the block.
    """
    return _written(df, purpose, _BLOCK.get())

"""Session helper for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class _Table(NamedTuple):
    """A written table: its label, the scope it belongs to and the Hadoop path that removes it."""

    label: str
    owner: object
    remove: Callable[[], None]


#: Tables written by `written_table` and not yet removed, by path.
_WRITTEN: dict[str, _Table] = {}
#: The scope that written tables go to, and the scopes that lazy results need.
_SCOPE: ContextVar[object] = ContextVar("scope", default=None)
_NEEDED: weakref.WeakKeyDictionary[DataFrame, object] = weakref.WeakKeyDictionary()


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    """A single-JVM session for tests and the bench, with a scratch folder of its own.

    A folder that the machine's Spark defaults name is kept.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("resrisk")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    spark = builder.getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        use_folder(spark, tempfile.mkdtemp(prefix="resrisk-"))
    return spark


#: Folders given by `use_folder`, by application.
_FOLDERS: dict[str, str] = {}


def use_folder(spark: SparkSession, folder: str) -> None:
    """Name the shared scratch folder of a session whose settings name none."""
    _FOLDERS[spark.sparkContext.applicationId] = folder


def shared_folder(spark: SparkSession) -> str:
    """The scratch folder that driver and executors share.

    It is the session's `spark.checkpoint.dir`, or the folder given to `use_folder`. There is
    no default: a folder of one machine would lose the parts that other executors write.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _FOLDERS.get(
        spark.sparkContext.applicationId)
    if not folder:
        raise ValueError(
            "no shared scratch folder: set spark.checkpoint.dir or call resrisk.session.use_folder")
    return folder.rstrip("/")


@contextmanager
def lean_actions(spark: SparkSession, batch_bytes: int = 8 << 20):
    """Inside, an action drops its shuffle files when it ends, and Python gets small batches."""
    wanted = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(batch_bytes),
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _remover(spark: SparkSession, path: str) -> Callable[[], None]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return lambda: where.getFileSystem(conf).delete(where, True)


def _remove(paths: list[str]) -> None:
    for path in paths:
        _WRITTEN.pop(path).remove()


@atexit.register
def _remove_all() -> None:
    for path in list(_WRITTEN):
        try:
            _remove([path])
        except Exception:  # the JVM has ended before
            return


def written_table(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading the table back.

    Unlike a cached frame the table outlives any executor. It belongs to the scope at work (see
    `scratch` and `owning`) and goes with it; without one, when the process ends. With `files` its
    rows are gathered in so many files after all work on them; they must be functions of their input.
    """
    path = scratch_path(df.sparkSession, label)
    if files:
        df = df.repartition(files)
    with lean_actions(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there belongs to the scope at work."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = _Table(label, _SCOPE.get(), _remover(spark, path))
    return path


@contextmanager
def scratch():
    """Tables written inside are removed at the end; results must have been stored by then."""
    owner = object()
    token = _SCOPE.set(owner)
    try:
        yield owner
    finally:
        _SCOPE.reset(token)
        _remove([p for p, t in _WRITTEN.items() if t.owner is owner])


def owning(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`fn` with tables of its own, which its lazy result needs until `release(result)`.

    Inside `scratch` they belong to that scope besides and go with it.
    """
    @functools.wraps(fn)
    def run(*args, **kwargs) -> DataFrame:
        if _SCOPE.get() is not None:
            return fn(*args, **kwargs)
        owner = object()
        token = _SCOPE.set(owner)
        try:
            result = fn(*args, **kwargs)
        finally:
            _SCOPE.reset(token)
        _NEEDED[result] = owner
        return result
    return run


def lasting(fn: Callable) -> Callable:
    """`fn` with tables that outlive the scope at work: what several queries share."""
    @functools.wraps(fn)
    def run(*args, **kwargs):
        token = _SCOPE.set(None)
        try:
            return fn(*args, **kwargs)
        finally:
            _SCOPE.reset(token)
    return run


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def input_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of the last change under a path: what is kept for it is stale once they differ."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = files.listStatus(place)
    return sum(p.getLen() for p in parts), max((p.getModificationTime() for p in parts), default=0)


def release(result: DataFrame) -> None:
    """Remove the tables behind the result of an `owning` function, once it has been stored."""
    owner = _NEEDED.pop(result, None)
    if owner is not None:
        _remove([p for p, t in _WRITTEN.items() if t.owner is owner])


def drop_written(spark: SparkSession, *tables: DataFrame, prefix: str | None = None) -> None:
    """Remove written tables of the scope at work: those given, or all whose label starts with `prefix`."""
    own = {p: t.label for p, t in _WRITTEN.items() if t.owner is _SCOPE.get()}
    paths = [p for t in tables for p in own if any(p in f for f in t.inputFiles()[:1])]
    if prefix is not None:
        paths += [p for p, label in own.items() if label.startswith(prefix)]
    _remove(list(dict.fromkeys(paths)))

"""Session settings and the shared folder for lineage cuts and stored tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def create_session(app_name: str = "tagweave", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` adds or overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a skewed join even where the plan above it then needs another exchange.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **{key: str(value) for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_fallbacks: dict[str, str] = {}
#: Folders that a job has named for everything it stores while it runs.
_scratch: dict[str, str] = {}


def configured_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or else the one that the application has set for its checkpoints.

    Where there is neither: a temporary one, on a local master only, since executors of a cluster could not read it.
    """
    application = spark.sparkContext.applicationId
    if application in _scratch:
        return _scratch[application]
    configured = configured_folder(spark)
    if configured:
        return configured.rstrip("/")
    if application not in _fallbacks:
        given = spark.sparkContext.getCheckpointDir()
        if given:
            return given.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        _fallbacks[application] = tempfile.mkdtemp(prefix="tagweave-")
    return _fallbacks[application]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other job uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, path: str) -> Iterator[None]:
    """All tables that this application stores go below ``path`` while the context is open."""
    application = spark.sparkContext.applicationId
    _scratch[application] = path
    try:
        yield
    finally:
        del _scratch[application]


@contextmanager
def small_shuffle_reads(spark: SparkSession, most: int = 16 << 20) -> Iterator[None]:
    """Shuffled data is merged or split to ``most`` bytes a task while the context is open, where the session asks for more."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= most:
        yield
        return
    spark.conf.set(key, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def file_marks(spark: SparkSession, path: str) -> list[str]:
    """Name, size and time of change of each file of an input, a file or a folder; a changed input has other marks."""
    files, place = _file_system(spark, path)
    return sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files.globStatus(place) or []) + (
        sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files.listStatus(place)) if files.exists(place) else []
    )


def leave_note(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file as a whole: under another name first, which is then changed."""
    files, place = _file_system(spark, path)
    _, draft = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    files.rename(draft, place)


def read_note(spark: SparkSession, path: str) -> str | None:
    files, place = _file_system(spark, path)
    if not files.exists(place):
        return None
    size = files.getFileStatus(place).getLen()
    source = files.open(place)
    try:
        return bytes(source.readNBytes(size)).decode()
    finally:
        source.close()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a stored table, on whatever file system it is."""
    files, place = _file_system(spark, path)
    files.delete(place, True)

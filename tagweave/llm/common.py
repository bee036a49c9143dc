"""What the operators share: Arrow mapping over texts and stored tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.session import new_folder

#: Spark type names, as used in the operators' schemas, and their Arrow types.
ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
    "array<binary>": pa.list_(pa.binary()),
}


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the library from where the driver has it.

    On a cluster the library is installed, or given with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *known]))


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


def record_batch(fields: dict[str, str], columns: list) -> pa.RecordBatch:
    arrays = [
        column if isinstance(column, pa.Array) else pa.array(column, ARROW[kind])
        for column, kind in zip(columns, fields.values(), strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, the id as a long and the text as its UTF-8 bytes; other columns go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))


def map_texts(
    docs: DataFrame,
    prepare: Callable[[], Callable[[bytes | None], tuple]],
    fields: dict[str, str],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row ``(doc_id, *work(bytes of the text))`` for each document.

    ``prepare`` runs once per task and returns ``work``. One text is held at a time
    besides the Arrow batch, which Spark bounds in rows and bytes.
    """
    out = {"doc_id": "long", **fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for batch in batches:
            if batch.num_rows:
                done = [work(value.as_py()) for value in batch.column(1)]
                yield record_batch(out, [batch.column(0), *(list(column) for column in zip(*done, strict=True))])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ddl(out))


def extend(
    docs: DataFrame, prepare: Callable[[], Callable[[bytes | None], tuple]], fields: dict[str, str], text_col: str = "text"
) -> DataFrame:
    """``docs`` with all its columns and those that ``work`` makes of each text, as in ``map_texts``.

    The names of ``fields`` must be new.
    """
    names, at = [*docs.columns, *fields], docs.columns.index(text_col)
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for batch in batches:
            if batch.num_rows:
                done = [work(value.as_py()) for value in batch.column(at).cast(pa.binary())]
                made = record_batch(fields, [list(column) for column in zip(*done, strict=True)])
                yield pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=names)

    return docs.mapInArrow(run, f"{given}, {ddl(fields)}")


def fresh_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, upper and lower case being one."""
    taken = {column.lower() for column in docs.columns}
    name = f"own_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: the lineage ends there. ``options`` are the writer's."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

"""The batch job: two data files and two query files in, match lines out."""

from __future__ import annotations

import hashlib
import json
import logging
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tagweave.graph import TaggedGraph, build_graph, load_graph
from tagweave.pattern import Pattern
from tagweave.plans.match import match
from tagweave.report import match_summary
from tagweave.session import configured_folder, create_session, exists, file_marks, leave_note, read_note, remove_folder, scratch
from tagweave.sources.text import read_edges, read_pattern, read_vertices, write_matches

USAGE = (
    "arguments: <data vertices> <data edges> <query vertices> <query edges> <output> <work folder>"
)
log = logging.getLogger("tagweave.job")


@dataclass(frozen=True)
class Progress:
    """Finished stages of a job, each a note in the job's folder with what was measured of it."""

    spark: SparkSession
    folder: str

    def measured(self, stage: str) -> dict | None:
        """What a finished stage has left; None if it has not finished."""
        note = read_note(self.spark, f"{self.folder}/done-{stage}")
        return None if note is None else json.loads(note)

    def finish(self, stage: str, **measured: float) -> dict:
        leave_note(self.spark, f"{self.folder}/done-{stage}", json.dumps(measured))
        log.info("%s: %s", stage, measured)
        return measured


def run(
    spark: SparkSession,
    data_vertices: str,
    data_edges: str,
    query_vertices: str,
    query_edges: str,
    output: str,
    work_folder: str,
    metrics: dict | None = None,
) -> DataFrame:
    """Match, write the result lines, and return the summary (one row per star).

    All that is stored on the way goes to a folder of the job's own in ``spark.checkpoint.dir``, or in ``work_folder`` where that
    is unset; executors must reach it. Its name follows from the arguments and the marks of the input files. A job that
    has failed leaves it behind, and the same job goes on after the last stage that has finished: a tagged graph is not tagged
    again, and half an output of its own is written anew. The folder is removed when the job has succeeded. An output that
    was there before is refused.

    ``metrics``, where given, receives ``tag_seconds``, ``match_seconds`` and ``rows``; the rows are counted while they are written.
    """
    pattern = read_pattern(spark, query_vertices, query_edges)
    inputs = file_marks(spark, data_vertices) + file_marks(spark, data_edges)
    key = hashlib.sha256(repr((pattern.vertices, pattern.edges, inputs, output)).encode()).hexdigest()[:32]
    base = configured_folder(spark) or work_folder
    progress = Progress(spark, f"{base.rstrip('/')}/job-{key}")
    with scratch(spark, progress.folder):
        graph, tagged = _tagged(progress, data_vertices, data_edges)
        written = _written(progress, graph, pattern, output)
        summary = match_summary(graph, pattern, written["rows"])
    remove_folder(spark, progress.folder)
    if metrics is not None:
        metrics |= {"tag_seconds": tagged["seconds"], "match_seconds": written["seconds"], "rows": written["rows"]}
    return summary


def _tagged(progress: Progress, data_vertices: str, data_edges: str) -> tuple[TaggedGraph, dict]:
    spark, store = progress.spark, f"{progress.folder}/graph"
    if (measured := progress.measured("tagging")) is not None:
        return load_graph(spark, store), measured
    remove_folder(spark, store)
    started = time.monotonic()
    graph = build_graph(read_vertices(spark, data_vertices), read_edges(spark, data_edges), store=store)
    return graph, progress.finish("tagging", seconds=round(time.monotonic() - started, 3))


def _written(progress: Progress, graph: TaggedGraph, pattern: Pattern, output: str) -> dict:
    if (measured := progress.measured("matching")) is not None:
        return measured
    if progress.measured("output") is not None:
        remove_folder(progress.spark, output)
    elif exists(progress.spark, output):
        raise FileExistsError(f"the output already exists: {output}")
    progress.finish("output")
    started = time.monotonic()
    rows = write_matches(match(graph, pattern), output)
    return progress.finish("matching", seconds=round(time.monotonic() - started, 3), rows=rows)


def main(arguments: list[str]) -> int:
    if len(arguments) != 6:
        print(USAGE, file=sys.stderr)
        return 2
    logging.basicConfig(level=logging.INFO)
    spark = create_session("tagweave")
    metrics: dict = {}
    try:
        run(spark, *arguments, metrics=metrics).orderBy("star_id").show(truncate=False)
        print(json.dumps(metrics))
    finally:
        spark.stop()
    return 0

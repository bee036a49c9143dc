from pathlib import Path

import pytest
from conftest import rows

import tagweave as tw
from tagweave import job
from tagweave.session import remove_folder
from tagweave.sources import text


@pytest.fixture
def lines(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_text(content)
        return str(path)

    return write


def test_reads_tokens_and_skips_empty_lines(spark, lines):
    assert rows(tw.read_vertices(spark, lines("v", "1 7\n\n2 8 ignored\n-3 -9\n"))) == [(-3, -9), (1, 7), (2, 8)]
    big = 2**62
    assert rows(tw.read_edges(spark, lines("e", f"1 2\n{big} 3\n"))) == [(1, 2), (big, 3)]


@pytest.mark.parametrize("content", ["1\n", "x 2\n", "1 3000000000\n", "1  2\n"])
def test_bad_lines_stop_the_job(spark, lines, content):
    with pytest.raises(Exception, match="not a graph line"):
        tw.read_vertices(spark, lines("v", content)).collect()


def test_pattern_keeps_file_order(spark, lines):
    pattern = tw.read_pattern(spark, lines("v", "9 1\n2 2\n5 1\n"), lines("e", "2 9\n9 5\n2 9\n"))
    assert pattern.vertices == ((9, 1), (2, 2), (5, 1))
    assert pattern.edges == ((2, 9), (9, 5))


def test_matches_are_written_as_lines_and_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, 4), (2, 4)], "v1 long, v2 long")
    path = str(tmp_path / "out")
    tw.write_matches(df, path)
    assert rows(text.read_match_lines(spark, path)) == [("1,4",), ("2,4",)]
    with pytest.raises(Exception, match="(?i)already exists"):
        tw.write_matches(df, path)
    tw.write_matches(df, path + "-parquet", "parquet")
    assert rows(spark.read.parquet(path + "-parquet")) == [(1, 4), (2, 4)]
    with pytest.raises(ValueError):
        tw.write_matches(df, path + "-x", "xml")


@pytest.fixture
def golden(lines, tmp_path, monkeypatch):
    """The arguments of a job with two result rows, and its work folder."""
    inputs = [
        lines("dv", "1 1\n2 1\n3 4\n4 2\n5 3\n6 2\n"),
        lines("de", "1 3\n3 1\n1 4\n4 1\n1 5\n5 1\n2 4\n2 5\n5 2\n2 6\n4 3\n4 5\n5 4\n"),
        lines("qv", "1 1\n2 2\n3 4\n4 3\n"),
        lines("qe", "1 4\n1 2\n2 3\n4 2\n"),
    ]
    work = tmp_path / "work"
    work.mkdir()
    monkeypatch.setattr(job, "configured_folder", lambda spark: None)
    return [*inputs, str(tmp_path / "result"), str(work)], work


SUMMARY = [(0, 1, 1, "2,4", 2, 0.5, 0, 2), (1, 2, 2, "3", 1, 1.0, 2, 2), (2, 4, 3, "2", 1, 1.0, 1, 2)]


def test_job_runs_from_files(spark, golden):
    arguments, work = golden
    metrics = {}
    summary = job.run(spark, *arguments, metrics=metrics)
    assert rows(text.read_match_lines(spark, arguments[4])) == [("1,4,3,5",), ("2,4,3,5",)]
    assert rows(summary) == SUMMARY
    assert metrics["rows"] == 2 and metrics["tag_seconds"] > 0 and metrics["match_seconds"] > 0
    assert list(work.iterdir()) == []
    with pytest.raises(FileExistsError):
        job.run(spark, *arguments)
    assert job.main(["too", "few"]) == 2


def test_a_failed_job_goes_on_after_tagging(spark, golden, monkeypatch):
    arguments, work = golden

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(job, "match", fail)
        with pytest.raises(RuntimeError, match="lost"):
            job.run(spark, *arguments)
    assert len(list(work.iterdir())) == 1
    # Half an output of the failed job.
    text.write_vertices(spark.createDataFrame([(1, 1)], "id long, tag int"), arguments[4])
    monkeypatch.setattr(job, "build_graph", fail)
    assert rows(job.run(spark, *arguments)) == SUMMARY
    assert rows(text.read_match_lines(spark, arguments[4])) == [("1,4,3,5",), ("2,4,3,5",)]
    assert list(work.iterdir()) == []


def test_a_changed_input_is_tagged_anew(spark, golden, monkeypatch):
    arguments, work = golden

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(job, "match", fail)
        with pytest.raises(RuntimeError):
            job.run(spark, *arguments)
    Path(arguments[1]).write_text("1 4\n1 2\n")
    remove_folder(spark, arguments[4])
    assert job.run(spark, *arguments).first()["result_count"] == 0


def test_matches_are_counted_while_they_are_written(spark, tmp_path):
    df = spark.range(7).selectExpr("id AS v1", "id AS v2")
    assert tw.write_matches(df, str(tmp_path / "a")) == 7
    assert tw.write_matches(df.where("v1 < 0"), str(tmp_path / "b"), "parquet") == 0

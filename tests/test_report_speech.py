"""Report sink and reader; speech-to-text flattening and audio screening."""

import json
import os

import pytest
from pyspark.errors import AnalysisException

from tablescope.operators import speech
from tablescope.plans import report
from tablescope.sources import files

from .conftest import SF001


def test_report_written_and_read_back(spark, tmpdir_path):
    src = files.open_source(spark, f"{SF001}/orders.parquet")
    path = report.write_report(src, os.path.join(tmpdir_path, "rep"), order_by=["o_orderkey"])
    got = report.read_report(spark, path).orderBy("seq").collect()
    assert [r.type for r in got] == report.SECTION_ORDER
    ov = got[0].overview
    assert ov.row_count == src.df.count() and ov.file_type == "parquet"
    assert [c.name for c in got[1].schema.columns] == src.df.columns
    sample = got[2].sample
    assert len(sample.rows) == 10 and sample.columns == src.df.columns
    stats = got[3].statistics.columns
    assert [c.column_name for c in stats] == src.df.columns
    assert got[4].nulls.total_cells == ov.row_count * 6
    assert got[5].message == report.COMPLETE_MESSAGE


def test_report_reader_skips_broken_lines(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "lines")
    os.makedirs(d)
    good = [
        {"seq": 1, "type": "overview", "data": json.dumps({"row_count": 2, "column_count": 1, "file_name": "x.csv", "file_size_bytes": 5, "file_type": "csv"})},
        {"seq": 6, "type": "complete", "message": "Analysis complete"},
    ]
    with open(os.path.join(d, "part.json"), "w") as fh:
        fh.write(json.dumps(good[0]) + "\n{broken\n" + json.dumps(good[1]) + "\n")
    got = report.read_report(spark, d).orderBy("seq").collect()
    assert [r.type for r in got] == ["overview", "complete"]
    assert got[0].overview.row_count == 2


def test_error_report(spark, tmpdir_path):
    src = files.open_source(spark, f"{SF001}/orders.parquet")
    src.df = src.df.selectExpr("o_orderkey", "raise_error('boom') AS broken")
    path = report.write_report(src, os.path.join(tmpdir_path, "err"))
    got = report.read_report(spark, path).collect()
    got = sorted(got, key=lambda r: r.seq)
    assert [r.type for r in got] == ["overview", "schema", "error"] and "boom" in got[-1].message
    assert got[0].overview.row_count > 0


def test_a_report_is_not_overwritten(spark, tmpdir_path):
    src = files.open_source(spark, f"{SF001}/orders.parquet")
    path = report.write_report(src, os.path.join(tmpdir_path, "keep"), order_by=["o_orderkey"])
    with pytest.raises(AnalysisException):
        report.write_report(src, path)
    assert len(report.read_report(spark, path).collect()) == 6


def every_file(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def failing(spark, when=None):
    src = files.open_source(spark, f"{SF001}/orders.parquet")
    src.df = src.df.selectExpr("o_orderkey", "raise_error('boom') AS broken")
    return src


def test_a_failing_run_does_not_touch_a_good_report(spark, tmpdir_path):
    good = files.open_source(spark, f"{SF001}/orders.parquet")
    path = report.write_report(good, os.path.join(tmpdir_path, "good"), order_by=["o_orderkey"])
    before = every_file(path)
    with pytest.raises(AnalysisException):
        report.write_report(failing(spark), path)
    assert every_file(path) == before
    with pytest.warns(UserWarning, match="boom"), pytest.raises(RuntimeError):
        report.write_report(failing(spark), path, replace=True)
    assert every_file(path) == before and report.report_status(spark, path) == "complete"


def test_a_report_can_be_replaced(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "r")
    with pytest.warns(UserWarning, match="boom"):
        report.write_report(failing(spark), path)
    assert report.report_status(spark, path) == "error"
    report.write_report(files.open_source(spark, f"{SF001}/nation.parquet"), path, replace=True)
    assert report.report_status(spark, path) == "complete" and os.listdir(tmpdir_path) == ["r"]
    got = report.read_report(spark, path).orderBy("seq").collect()
    assert [r.type for r in got] == report.SECTION_ORDER and got[0].overview.row_count == 25


def test_sections_are_read_while_later_ones_run(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "grows")
    src = files.open_source(spark, f"{SF001}/orders.parquet")
    seen = []
    for seq, kind in report.stream_report(src, path, order_by=["o_orderkey"]):
        seen.append(kind)
        assert [r.type for r in report.read_report(spark, path).orderBy("seq").collect()] == seen
        assert report.report_status(spark, path) == "running"
    assert seen == report.SECTION_ORDER and report.report_status(spark, path) == "complete"
    assert not os.path.exists(os.path.join(path, "_staging"))
    apart = {r.type: r for r in report.read_report(spark, path).collect()}
    whole = {r.type: r for r in report.report_sections(src, order_by=["o_orderkey"]).collect()}
    assert json.loads(whole["nulls"].data) == json.loads(json.dumps(apart["nulls"].nulls.asDict(recursive=True)))


def test_flatten_stt_cases(spark):
    full = {
        "results": {"channels": [{"detected_language": "es", "alternatives": [{"transcript": "um show sales", "confidence": 0.9}]}]},
        "metadata": {"duration": 1.5},
    }
    no_lang = {"results": {"channels": [{"alternatives": [{"transcript": "hello", "confidence": 0.5}]}]}, "metadata": {"duration": 2.0}}
    empty = {"results": {"channels": [{"alternatives": [{"transcript": "", "confidence": 0.1}]}]}}
    rows = [(1, json.dumps(full)), (2, json.dumps(no_lang)), (3, json.dumps(empty)), (4, "{}"), (5, "not json")]
    df = spark.createDataFrame(rows, "id int, response string")
    got = {r.id: r for r in speech.flatten_stt(df).collect()}
    assert (got[1].transcript, got[1].curated_prompt, got[1].language, got[1].confidence, got[1].duration_seconds) == (
        "um show sales",
        "Show sales",
        "es",
        0.9,
        1.5,
    )
    assert got[2].language == "en" and got[2].status == "complete"
    for k in (3, 4, 5):
        assert got[k].status == "error" and got[k].error == speech.NO_TRANSCRIPT and got[k].curated_prompt is None


def test_screen_audio(spark):
    df = spark.createDataFrame([("a.wav", 0), ("b.wav", 99), ("c.wav", 100)], "path string, length bigint")
    got = {r.path: (r.status, r.error) for r in speech.screen_audio(df).collect()}
    assert got == {
        "a.wav": ("error", speech.EMPTY_AUDIO),
        "b.wav": ("error", speech.TOO_SHORT),
        "c.wav": ("pending", None),
    }


def test_audio_files_listing(spark, tmpdir_path):
    for name, size in (("x.wav", 10), ("y.wav", 300)):
        with open(os.path.join(tmpdir_path, name), "wb") as fh:
            fh.write(b"\0" * size)
    got = {r.file_name: r.status for r in speech.screen_audio(speech.audio_files(spark, tmpdir_path, "*.wav")).collect()}
    assert got == {"x.wav": "error", "y.wav": "pending"}


def test_statistics_for_all_tables(spark):
    tables = {n: files.open_source(spark, f"{SF001}/{n}.parquet") for n in ("region", "nation")}
    rows = report.statistics_for_tables(tables).collect()
    assert sorted((r.table_name, r.ordinal, r.column_name) for r in rows) == [
        ("nation", 1, "n_nationkey"),
        ("nation", 2, "n_name"),
        ("nation", 3, "n_regionkey"),
        ("region", 1, "r_regionkey"),
        ("region", 2, "r_name"),
    ]
    assert {r.column_name: r.unique_count for r in rows}["n_nationkey"] == 25

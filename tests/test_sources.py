"""CSV / JSON / Parquet inference, table sets and source checks."""

import json
import os

import pytest
from pyspark.sql import types as T

from tablescope import session
from tablescope.operators import overview
from tablescope.sources import files


def write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_csv_plain(spark, tmpdir_path):
    p = write(
        os.path.join(tmpdir_path, "plain.csv"),
        "id,amount,day,at,flag,note\n1,2.5,2024-01-02,2024-01-02 03:04:05,true,a\n2,,2024-01-03,2024-01-03 00:00:00,false,\n",
    )
    src = files.open_source(spark, p)
    types = {f.name: f.dataType for f in src.df.schema.fields}
    assert isinstance(types["id"], T.LongType)
    assert isinstance(types["amount"], T.DoubleType)
    assert isinstance(types["day"], T.DateType)
    assert isinstance(types["at"], T.TimestampNTZType)
    assert isinstance(types["flag"], T.BooleanType)
    rows = src.df.orderBy("id").collect()
    assert rows[1].amount is None and rows[1].note is None
    assert str(rows[0].at) == "2024-01-02 03:04:05"
    assert src.fmt == "csv" and src.file_name == "plain.csv"


def test_csv_semicolon(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "semi.CSV"), "id;amt\n1;2.5\n2;3.5\n")
    df = files.open_source(spark, p).df
    assert df.columns == ["id", "amt"]
    assert df.count() == 2


def test_csv_no_header(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "nohead.csv"), "1,2.5,x\n2,3.5,y\n")
    df = files.open_source(spark, p).df
    assert df.count() == 2
    assert isinstance(df.schema.fields[0].dataType, T.LongType)


def test_json_array_and_lines(spark, tmpdir_path):
    recs = [
        {"zeta": 1, "when": "2024-01-02", "nested": {"k": [1, 2]}, "at": "2024-01-02 03:04:05"},
        {"zeta": 2, "when": "2024-02-03", "at": "2024-02-03T00:00:00"},
    ]
    a = write(os.path.join(tmpdir_path, "arr.json"), json.dumps(recs))
    lines = write(os.path.join(tmpdir_path, "lines.json"), "\n".join(json.dumps(r) for r in recs))
    for p in (a, lines):
        df = files.open_source(spark, p).df
        assert df.columns == ["zeta", "when", "nested", "at"], p
        types = {f.name: f.dataType for f in df.schema.fields}
        assert isinstance(types["when"], T.DateType)
        assert isinstance(types["at"], T.TimestampNTZType)
        assert isinstance(types["nested"], T.StructType)
        assert df.count() == 2


def test_table_set_listing_and_sql(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "set")
    spark.range(5).selectExpr("id", "id * 2 AS v").write.parquet(os.path.join(base, "beta"))
    spark.range(3).selectExpr("id", "'x' AS s").write.parquet(os.path.join(base, "alpha.parquet"))
    tables = files.open_table_set(spark, base)
    assert sorted(tables) == ["alpha", "beta"]
    assert files.default_table(tables).name == "alpha"
    counts = {r.table_name: r.row_count for r in overview.table_counts(spark, {k: v.df for k, v in tables.items()}).collect()}
    assert counts == {"alpha": 3, "beta": 5}
    files.register_all(tables)
    joined = spark.sql("SELECT count(*) AS n FROM alpha a JOIN beta b ON a.id = b.id").first().n
    assert joined == 3


def test_missing_and_unknown(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        files.open_source(spark, os.path.join(tmpdir_path, "nope.csv"))
    p = write(os.path.join(tmpdir_path, "data.txt"), "x\n")
    with pytest.raises(ValueError):
        files.open_source(spark, p)
    with pytest.raises(ValueError):
        files.check_source(spark, os.path.join(tmpdir_path, "db.duckdb"))
    with pytest.raises(ValueError):
        files.open_source(spark, p, fmt="xml")


def test_overview_counts_and_size(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "o.csv"), "a,b\n1,2\n3,4\n")
    ov = overview.overview(files.open_source(spark, p)).first()
    assert (ov.row_count, ov.column_count, ov.file_name, ov.file_type) == (2, 2, "o.csv", "csv")
    assert ov.file_size_bytes == os.path.getsize(p)


def test_types_come_from_every_row(spark, tmpdir_path):
    body = "id,v\n" + "\n".join(f"{i},{i}" for i in range(5000)) + "\n5000,five\n"
    df = files.open_source(spark, write(os.path.join(tmpdir_path, "late.csv"), body)).df
    assert isinstance(df.schema["v"].dataType, T.StringType)
    assert df.filter("v IS NULL").count() == 0 and df.count() == 5001
    with pytest.raises(ValueError):
        files.open_source(spark, os.path.join(tmpdir_path, "late.csv"), sampling_ratio=0.1)


def test_csv_quoted_text(spark, tmpdir_path):
    body = 'id,note\n1,"line one\nline two"\n2,"said ""hi"", then left"\n3,"a;b;c"\n4,\n5,""\n'
    df = files.open_source(spark, write(os.path.join(tmpdir_path, "q.csv"), body)).df
    got = {r.id: r.note for r in df.collect()}
    assert got == {1: "line one\nline two", 2: 'said "hi", then left', 3: "a;b;c", 4: None, 5: ""}
    assert isinstance(df.schema["id"].dataType, T.LongType)


def test_csv_quoted_line_break_far_from_the_start(spark, tmpdir_path):
    body = "id,note\n" + "".join(f"{i},x\n" for i in range(300)) + '300,"late\nbreak"\n'
    df = files.open_source(spark, write(os.path.join(tmpdir_path, "far.csv"), body)).df
    assert df.count() == 301 and df.filter("id = 300").first().note == "late\nbreak"


def test_csv_delimiter_is_not_counted_inside_quotes(spark, tmpdir_path):
    body = 'k;t\n1;"a,b,c,d"\n2;"e,f,g,h"\n'
    df = files.open_source(spark, write(os.path.join(tmpdir_path, "d.csv"), body)).df
    assert df.columns == ["k", "t"] and df.first().t == "a,b,c,d"


def test_csv_rows_that_do_not_fit_are_refused(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "bad.csv"), "a,b\n" + "1,2\n" * 50 + "1,2,3,4\n")
    with pytest.raises(ValueError, match="does not fit"):
        files.open_source(spark, p)


def test_csv_explicit_options(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "e.csv"), "a:1\nb:2\n")
    df = files.open_source(spark, p, sep=":", header=False, multiline=False).df
    assert sorted(tuple(r) for r in df.collect()) == [("a", 1), ("b", 2)]


def test_json_object_over_many_lines(spark, tmpdir_path):
    one = {"zeta": {"inner": 1, "b": [1, 2]}, "alpha": "x\n{"}
    df = files.open_source(spark, write(os.path.join(tmpdir_path, "one.json"), json.dumps(one, indent=2))).df
    assert df.columns == ["zeta", "alpha"] and df.first().alpha == "x\n{" and df.count() == 1
    many = [one, {"zeta": None, "alpha": "y"}]
    df = files.open_source(spark, write(os.path.join(tmpdir_path, "many.json"), json.dumps(many, indent=2))).df
    assert df.columns == ["zeta", "alpha"] and df.count() == 2
    with pytest.raises(ValueError, match="JSON"):
        files.open_source(spark, write(os.path.join(tmpdir_path, "no.json"), '{"a": 1}\nnot json\n'))


def test_sniffing_brings_little_to_the_driver(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "wide.json"), json.dumps([{"k": "v" * 900} for _ in range(5000)]))
    assert sum(map(len, files._first_lines(spark, p))) <= files._SNIFF_CHARS
    df = files.open_source(spark, p).df
    assert df.columns == ["k"] and df.count() == 5000


def test_top_level_keys_of_cut_text():
    assert files.top_level_keys('[{"b": {"x": 1}, "a\\"q": "{", "c": [1, {"d"') == ["b", 'a"q', "c"]
    assert files.top_level_keys("") == [] and files.top_level_keys("[1, 2]") == []


def test_table_set_names(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "set", "set")
    spark.range(2).write.parquet(os.path.join(base, "set"))
    spark.range(3).write.parquet(os.path.join(base, "other.parquet"))
    found = files.table_entries(spark, base)
    assert [(n, p) for n, p, _ in found] == [("other", f"{base}/other.parquet"), ("set", f"{base}/set")]
    assert files.open_table_set(spark, base)["set"].df.count() == 2


def test_table_of_several_formats_is_refused(spark, tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "s", "t"))
    for n in ("a.csv", "b.json"):
        write(os.path.join(tmpdir_path, "s", "t", n), '{"a": 1}\n')
    with pytest.raises(ValueError, match="csv, json"):
        files.open_table_set(spark, os.path.join(tmpdir_path, "s"))


def test_listing_takes_no_job(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "deep")
    spark.range(4).selectExpr("id", "id % 2 AS p").write.partitionBy("p").parquet(os.path.join(base, "parted"))
    os.makedirs(os.path.join(base, "_hidden"))
    write(os.path.join(base, "_hidden", "x.csv"), "a\n1\n")
    write(os.path.join(base, "notes.txt"), "x")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        assert [(n, f) for n, _, f in files.table_entries(spark, base)] == [("parted", "parquet")]
        assert not tracker.getJobIdsForGroup("listing")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert files.open_table_set(spark, base)["parted"].df.count() == 4


def test_database_of_the_catalog(spark, tmpdir_path):
    spark.sql(f"CREATE DATABASE some_db LOCATION '{tmpdir_path}/db'")
    try:
        spark.range(3).selectExpr("id", "'x' AS s").write.saveAsTable("some_db.beta")
        spark.sql("CREATE VIEW some_db.alpha AS SELECT id FROM some_db.beta WHERE id > 0")
        tables = files.open_database(spark, "some_db")
        assert {n: s.df.count() for n, s in tables.items()} == {"alpha": 2, "beta": 3} and files.default_table(tables).name == "alpha"
        assert overview.overview(tables["beta"]).first().row_count == 3
    finally:
        spark.sql("DROP DATABASE some_db CASCADE")
    with pytest.raises(ValueError, match="no such database"):
        files.open_database(spark, "some_db")


def test_register(spark, tmpdir_path):
    files.open_source(spark, write(os.path.join(tmpdir_path, "r.csv"), "a\n1\n2\n")).register("registered_rows")
    assert spark.sql("SELECT sum(a) AS s FROM registered_rows").first().s == 3


def test_scratch_needs_a_shared_folder_beyond_one_process():
    assert session.runs_in_one_process("local") and session.runs_in_one_process("local[8]")
    assert not any(session.runs_in_one_process(m) for m in ("local-cluster[2,1,1024]", "spark://h:7077", "yarn", "k8s://x"))


def test_csv_timestamps_keep_wall_clock_in_dst_gap(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "dst.csv"), "id,at\n1,2024-03-10 02:30:00\n2,2024-01-02 03:04:05\n")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = files.open_source(spark, p).df
        assert isinstance(df.schema["at"].dataType, T.TimestampNTZType)
        got = [str(r.at) for r in df.orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == ["2024-03-10 02:30:00", "2024-01-02 03:04:05"]

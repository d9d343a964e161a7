"""Records that are cut by many tasks."""

import csv
import io
import json
import random

import pytest

from tablescope.sources import files, stitch


@pytest.fixture()
def small_ranges(spark):
    """Byte ranges of a few hundred bytes, so that small files are read by many tasks."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def some_text(rng):
    return "".join(rng.choice('ab,;"\n\\}{][\té: ') for _ in range(rng.randrange(0, 40)))


def same(df, want):
    key = lambda r: (r["id"], str(r))
    assert sorted([r.asDict(recursive=True) for r in df.collect()], key=key) == sorted(want, key=key)


def json_rows(n, rng):
    return [{"id": i, "t": some_text(rng), "o": {"x": [some_text(rng), None], "y": {"z": i}}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_by_many_tasks(spark, tmp_path, small_ranges, indent):
    rows = json_rows(60, random.Random(3))
    path = tmp_path / "one.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    assert stitch.pieces(spark, [str(path)], "}").rdd.getNumPartitions() > 5
    df = files.open_source(spark, str(path)).df
    assert df.columns == ["id", "t", "o"]
    same(df, rows)


def test_mixed_json_folder_is_complete(spark, tmp_path, small_ranges):
    rows = json_rows(50, random.Random(4))
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows[:10]) + "\n\n")
    (folder / "b.json").write_text(json.dumps(rows[10:25]))
    (folder / "c.json").write_text("\n\n".join(json.dumps(r, indent=1) for r in rows[25:40]))
    (folder / "d.json").write_text(" [ ] ")
    (folder / "e.json").write_text("".join(json.dumps(r) for r in rows[40:]))
    (folder / "f.json").write_text("\n \n")
    same(files.open_source(spark, str(folder)).df, rows)


def test_two_lines_beside_an_array(spark, tmp_path):
    folder = tmp_path / "probe.json"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": 1}\n{"id": 2}\n')
    (folder / "b.json").write_text('[{"id": 3}, {"id": 4}]')
    assert sorted(r.id for r in files.open_source(spark, str(folder)).df.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '[{"a": 1}] x', '{"a": 1}\n{"a":\n', '[{"a": 1} {"a"}]', "[1, 2]"])
def test_broken_json_is_refused(spark, tmp_path, text):
    (tmp_path / "broken.json").write_text(text)
    with pytest.raises(ValueError, match="JSON"):
        files.open_source(spark, str(tmp_path / "broken.json"))


def csv_text(rows, sep=",", end="\n"):
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(["id", "note", "last"])
    w.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("sep,end", [(",", "\n"), (";", "\r\n"), ("|", "\n")])
def test_quoted_csv_by_many_tasks(spark, tmp_path, small_ranges, sep, end):
    rng = random.Random(5)
    rows = [(i, f"{some_text(rng)}x\n\n{some_text(rng)}y\r\nz \x02n", f"t{i}") for i in range(60)]
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for k in (0, 1):
        (folder / f"{k}.csv").write_bytes(csv_text(rows[k::2], sep, end).encode())
    assert stitch.pieces(spark, [str(folder)], "\n").rdd.getNumPartitions() > 5
    df = files.open_source(spark, str(folder)).df
    assert df.columns == ["id", "note", "last"]
    same(df, [{"id": i, "note": n, "last": t} for i, n, t in rows])


def test_a_quote_inside_of_a_plain_field_opens_nothing(spark, tmp_path):
    body = 'id,note\n1,5" pipe\n2,"a\nb"\n3,6" pipe\n4,"say ""x"""\n5,""\n6,"\n"\n'
    (tmp_path / "inch.csv").write_text(body)
    got = {r.id: r.note for r in files.open_source(spark, str(tmp_path / "inch.csv")).df.collect()}
    assert got == {1: '5" pipe', 2: "a\nb", 3: '6" pipe', 4: 'say "x"', 5: "", 6: "\n"}


def test_a_record_longer_than_a_range(spark, tmp_path, small_ranges):
    long = "line\n" * 300
    (tmp_path / "long.csv").write_text(csv_text([(1, "a", "b"), (2, long, "c"), (3, "d", "e\nf")]))
    got = {r.id: (r.note, r.last) for r in files.open_source(spark, str(tmp_path / "long.csv")).df.collect()}
    assert got == {1: ("a", "b"), 2: (long, "c"), 3: ("d", "e\nf")}


def test_a_header_over_lines_without_a_record(spark, tmp_path):
    (tmp_path / "head.csv").write_text('id,"no\nte"\n')
    df = files.open_source(spark, str(tmp_path / "head.csv"), sep=",", header=True).df
    assert df.columns == ["id", "no\nte"] and df.count() == 0
    (tmp_path / "head2.csv").write_text('id,"no\nte"\n1,x\n')
    df = files.open_source(spark, str(tmp_path / "head2.csv"), sep=",", header=True).df
    assert df.columns == ["id", "no\nte"] and [tuple(r) for r in df.collect()] == [(1, "x")]

"""CSV read in byte ranges against the csv module."""

import csv
import io
import os
import random
import tempfile

import pytest

from propensia.session import importable
from propensia.sources import csv_ranges as CR
from propensia.sources.files import BAD_LINE, read_csv_raw


@pytest.fixture(scope="module", autouse=True)
def _workers(spark):
    importable(spark)


def folder():
    return tempfile.mkdtemp(prefix="csv-", dir="/tmp")


def written(rows, path, lineterminator="\n", header=("a", "b\nc", "d"), tail=""):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=lineterminator)
    w.writerow(header)
    w.writerows(rows)
    with open(path, "w", newline="") as f:
        f.write(out.getvalue() + tail)


def noisy(rng, n, longest):
    text = lambda: "".join(rng.choice(['a', '"', ",", "\n", "é", "x y"]) for _ in range(rng.choice([0, 3, 9, longest])))
    return [[str(i), text(), str(rng.random())] for i in range(n)]


def fields(df):
    return sorted(next(csv.reader(io.StringIO(r["record"], newline=""))) for r in df.collect())


@pytest.mark.parametrize("range_bytes", [64, 500, 1 << 20])
def test_records_equal_the_csv_module(spark, range_bytes):
    rng, path, want = random.Random(range_bytes), folder(), []
    for i, ends in enumerate(("\n", "\r\n", "\n")):
        rows = noisy(rng, 150, 300 if i else 40)        # records longer than whole ranges
        written(rows, f"{path}/{i}.csv", ends, tail="\n\n" if i == 2 else "")
        want += rows
    assert fields(CR.records(spark, path, range_bytes=range_bytes)) == sorted(want)


def test_one_file_is_read_by_many_tasks(spark):
    path = f"{folder()}/one.csv"
    written(noisy(random.Random(1), 3000, 30), path)
    df = CR.records(spark, path, range_bytes=4096)
    size = os.path.getsize(path)
    ranges = {r["start"] for r in CR.range_maps(CR._lines(spark, path, 4096)).collect()}
    assert len(ranges) >= 0.9 * size / 4096 > 10
    assert df.count() == 3000


def test_maps_hold_for_both_states(spark):
    path = f"{folder()}/m.csv"
    with open(path, "w") as f:
        f.write('h\n' + 'plain,line\n' * 30 + 'x,"open\n' + "text\n" * 60 + 'done",1\n' + "plain,line\n" * 30)
    lines = CR._lines(spark, path, 100)
    by = {}
    for r in lines.collect():
        by.setdefault(r["start"], []).append(r["line"])
    for m in CR.range_maps(lines).collect():
        for inside, after, starts in ((False, m["from_outside"], m["starts_outside"]), (True, m["from_inside"], m["starts_inside"])):
            state, seen = inside, False
            for line in by[m["start"]]:
                seen = seen or not state
                state = CR.inside_after(line, state)
            assert (state, seen) == (after, starts)
    composed = sorted(CR.compose(CR.range_maps(lines)).collect(), key=lambda r: r["start"])
    state, opened = False, None
    for r in composed:
        assert (r["inside"], r["opened"]) == (state, opened)
        for line in by[r["start"]]:
            if not state:
                opened = r["start"]
            state = CR.inside_after(line, state)
        assert r["next_inside"] == state
    assert any(r["inside"] and r["next_inside"] for r in composed)        # ranges wholly inside quotes


@pytest.mark.parametrize("line,inside,after", [
    ("a,b", False, False), ('a,"b', False, True), ('a,"b""', False, True), ('a,"b"""', False, False), ('b",c', True, False),
    ('b"",c', True, True), ('five" pipe,x', False, False), ('"a"b"c,"d', False, True), ("", True, True), ('"",""', False, False),
    ('","', False, False), ('x,"', False, True), ('"', True, False), ('","y', True, True)])
def test_quotes_count_where_a_field_starts(line, inside, after):
    assert CR.inside_after(line, inside) is after


def test_ragged_rows_on_range_borders(spark):
    path = f"{folder()}/r.csv"
    rows = ["student_id,note,n"]
    want = {}
    for i in range(400):
        kind = i % 5
        body = {0: '"two\nlines, ""q"""', 1: "plain", 2: "", 3: "short", 4: "x,1,2,3"}[kind]
        rows.append(f"{i},{body}" + ("" if kind in (3, 4) else f",{i}"))
        want[str(i)] = ({0: 'two\nlines, "q"', 1: "plain", 2: None, 3: "short", 4: "x"}[kind], kind in (3, 4))
    with open(path, "w") as f:
        f.write("\n".join(rows))                          # no line feed at the end
    for size in (80, 1000):
        got = {r["student_id"]: (r["note"], r[BAD_LINE] is not None) for r in read_csv_raw(spark, path, range_bytes=size).collect()}
        assert got == want


def test_empty_files_and_headers_alone(spark):
    path = folder()
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "x,y\n"), ("c.csv", "x,y"), ("d.csv", "")):
        with open(f"{path}/{name}", "w") as f:
            f.write(text)
    assert [(r["x"], r["y"]) for r in read_csv_raw(spark, path, ["x", "y"]).collect()] == [("1", "2")]

import csv
import gzip
import io
import random

import pytest

from hostelry.sources import readers, records


def expected(text):
    """Rows as the standard reader has them."""
    return [row for row in csv.reader(io.StringIO(text.lstrip("﻿"))) if row]


def written(rows, rng):
    out = []
    for row in rows:
        cells = ['"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') or rng.random() < 0.2 else c for c in row]
        out.append(",".join(cells))
    return "\n".join(out) + "\n"


def read(spark, path):
    return [list(r.f) for r in records.read_records(spark, str(path)).select(records.fields(records.F.col("value")).alias("f")).collect()]


@pytest.mark.parametrize("size", [1 << 27, 40, 300])
def test_records_equal_the_standard_reader_whatever_the_splits(spark, tmp_path, settings, size):
    settings(spark__sql__files__maxPartitionBytes=str(size), spark__sql__files__openCostInBytes="0")
    rng = random.Random(size)
    pieces = ["a", "b c", ",", '"', "\n", "\n\n", '""', "x\ny", ", z", "end"]
    want = []
    for k in range(3):
        rows = [[f"id{k}-{i}", *("".join(rng.choices(pieces, k=rng.randint(0, 5))).strip(" ") for _ in range(rng.randint(1, 3))), "last"] for i in range(60)]
        text = ("﻿" if k else "") + written(rows, rng)
        assert expected(text) == rows
        (tmp_path / f"{k}.csv").write_text(text, newline="")
        want += rows
    assert sorted(read(spark, tmp_path)) == sorted(want)


def test_stray_and_unclosed_quotes_and_other_line_ends(spark, tmp_path, settings):
    settings(spark__sql__files__maxPartitionBytes="24", spark__sql__files__openCostInBytes="0")
    (tmp_path / "a.csv").write_text('1,5" pipe,x\r\n2,"a\r\nb",y\r\n\r\n3,c "d" e,z\r4,"u""v" ,w\n', newline="")
    (tmp_path / "b.csv").write_text('5,"fine\nbreak"\n6,"never\n7,closed\n8,"" , \n', newline="")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write('9,"one\n\ntwo"\n')
    (tmp_path / "d.csv").write_text("")
    assert sorted(read(spark, tmp_path)) == [
        ["1", '5" pipe', "x"], ["2", "a\nb", "y"], ["3", 'c "d" e', "z"], ["4", 'u"v ', "w"], ["5", "fine\nbreak"],
        ["6", '"never'], ["7", "closed"], ["8", " ", ""], ["9", "one\n\ntwo"]]


def test_a_long_field_of_many_doubled_quotes(spark, tmp_path):
    text = '"q" ' * 200_000
    (tmp_path / "a.csv").write_text('1,"' + text.replace('"', '""') + '\nend",x\n')
    assert read(spark, tmp_path) == [["1", text + "\nend", "x"]]


def test_drifting_headers_over_quoted_breaks(spark, tmp_path, settings):
    settings(spark__sql__files__maxPartitionBytes="32", spark__sql__files__openCostInBytes="0")
    folder = tmp_path / "period=2020_3T"
    folder.mkdir()
    (folder / "a.csv").write_text('ID,NAME,LON,LAT\n1,"a\n""b"", c",5,2.0,41.0\n2,x,6,2.1,41.1\n3,"y\n",7,2.1,41.1,extra\n')
    got = readers.read_drifting(spark, str(tmp_path), r"period=([^/]+)", "ID", ["ID", "NAME", "UNNAMED_1", "LAT"])
    assert [tuple(r) for r in got.orderBy("ID").collect()] == [("2020_3T", "1", 'a\n"b", c', "5", "41.0"), ("2020_3T", "2", "x", "6", "41.1")]
    lost = readers.lost_rows(spark, str(tmp_path), r"period=([^/]+)", "ID").first()
    assert (lost["rows"], lost["lost"]) == (3, 1)

"""CSV as users write it."""

import random

import pytest

from semblance.operators.validate import TableError
from semblance.sources import quoted
from semblance.sources.csv import NA_TOKENS, scan_csv


def rows_of(spark, folder, files, **options):
    for name, text in files.items():
        (folder / name).write_text(text, newline="")
    df = scan_csv(spark, str(folder), **options)
    return df.columns, sorted(map(tuple, df.collect()), key=str)


def test_line_breaks_in_quotes(spark, tmp_path):
    assert rows_of(spark, tmp_path, {"a.csv": 'a,b\n1,"x\ny"\n2,z\n3,"say ""hi"", twice"\n'}) == (["a", "b"], [(1, "x\ny"), (2, "z"), (3, 'say "hi", twice')])


@pytest.mark.parametrize("row", ["4,5,,9", "4,5,6,7", '4,"5,5",,', "4,5,6,7,8"])
def test_long_rows_are_errors(spark, tmp_path, row):
    with pytest.raises(TableError):
        rows_of(spark, tmp_path, {"a.csv": f"a,b,c\n1,2,3\n{row}\n"})


def test_short_rows_are_filled(spark, tmp_path):
    assert rows_of(spark, tmp_path, {"a.csv": 'a,b,c\n1,2,3\n4,5\n"6,6"\n'})[1] == [("1", 2, 3), ("4", 5, None), ("6,6", None, None)]


def test_headers_in_another_order_are_errors(spark, tmp_path):
    with pytest.raises(TableError, match="same header"):
        rows_of(spark, tmp_path, {"a.csv": "a,b\n1,x\n", "b.csv": "b,a\ny,2\n"})


def test_equal_headers_are_one_table(spark, tmp_path):
    assert rows_of(spark, tmp_path, {"a.csv": "a,b\n1,x\n", "b.CSV": "a,b\n2,y\n", "notes.txt": "not a table"}) == (["a", "b"], [(1, "x"), (2, "y")])


def test_long_integers_keep_their_digits(spark, tmp_path):
    got = rows_of(spark, tmp_path, {"a.csv": "a,b\n1234567890123456789,99999999999999999999\n1234567890123456788,1\n"})[1]
    assert got == [(1234567890123456788, "1"), (1234567890123456789, "99999999999999999999")]


def test_upper_case_ending_alone(spark, tmp_path):
    assert rows_of(spark, tmp_path, {"A.CSV": "a\n1\n"}) == (["a"], [(1,)])


def test_goes_on():
    cases = [("a,b", False, False), ('a,"b', False, True), ('a,"b""', False, True), ('a,"b"', False, False), ('5" pipe,x', False, False), ('x",y', True, False), ('x""', True, True), ('x"",",y', True, False),
             ("", True, True), ('"', True, False), ('",""', True, False), ('","', True, True), ('"a"b"c,"', False, True)]
    for line, inside, want in cases:
        assert quoted.goes_on(line, inside, '"') == want, line


def test_one_file_in_many_splits(spark, tmp_path):
    """Fields with breaks, commas and quotes, of any length, wherever the splits fall."""
    rnd = random.Random(4)
    pieces = ["word", "a,b", 'say ""hi""', "line\nbreak", "\n\n", "x" * 90, "", "é日", "\r\nend"]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(6))), rnd.randrange(9)) for i in range(400)]
    rows[37] = (37, "\n".join(["many lines"] * 200), 1)  # over several splits
    rows[399] = (399, "ends\nhere", 1)
    text = "id,note,n\n" + "\n".join(f'{i},"{t}",{n}' for i, t, n in rows)
    want = sorted((i, None if t.replace('""', '"') in NA_TOKENS else t.replace('""', '"').replace("\r\n", "\n").strip() or None, n) for i, t, n in rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        (tmp_path / "a.csv").write_text(text, newline="")
        found = quoted.records(spark, str(tmp_path), "*.csv", '"')
        assert found.count() == 401 and found.where("first").count() == 1
        got = sorted(tuple(r) for r in scan_csv(spark, str(tmp_path)).collect())
        assert quoted._lines(spark, str(tmp_path), "*.csv").select("block").distinct().count() >= 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(i, (t or "").replace("\r\n", "\n").strip() or None, n) for i, t, n in got] == want


def test_quoted_files_with_other_headers_are_errors(spark, tmp_path):
    with pytest.raises(TableError, match="same header"):
        rows_of(spark, tmp_path, {"a.csv": 'a,b\n1,"x\ny"\n', "b.csv": "b,a\ny,2\n"})


def test_long_rows_beside_breaks_are_errors(spark, tmp_path):
    with pytest.raises(TableError):
        rows_of(spark, tmp_path, {"a.csv": 'a,b\n1,"x\ny"\n1,2,3\n'})


def test_windows_line_ends_and_quotes_inside_fields(spark, tmp_path):
    got = rows_of(spark, tmp_path, {"a.csv": 'a,b\r\n1,"x\r\ny"\r\n\r\n2,5" pipe\r\n3,z\r\n'})
    assert [(a, b.replace("\r\n", "\n")) for a, b in got[1]] == [(1, "x\ny"), (2, '5" pipe'), (3, "z")]

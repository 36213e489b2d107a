import glob

from fixtures import (FOO_MISSING_CSV, FOO_SCHEMA, FOOFILE_CSV, FOOFILE_CSV_OUT, FOOFILE_EXPECTED, FOOFILE_JSON,
                      FOOFILE_PIPE, rows_as_json, with_nulls, write)
from pyspark.sql import functions as F

from skein.functions import coerce
from skein.sinks.files import write_csv, write_json
from skein.sources.files import scan_csv, scan_json

COLS = ["Foo", "Bar", "Baz", "Fobe", "Dt Test", "enabled"]


def test_json_array_scan_applies_encoding(spark, tmp):
    p = write(tmp, "foofile.json", FOOFILE_JSON)
    df = scan_json(spark, p, engram=FOO_SCHEMA)
    assert df.columns == COLS
    assert with_nulls(rows_as_json(df), COLS) == FOOFILE_EXPECTED


def test_csv_scan_applies_encoding(spark, tmp):
    p = write(tmp, "foofile.csv", FOOFILE_CSV)
    df = scan_csv(spark, p, engram=FOO_SCHEMA)
    assert with_nulls(rows_as_json(df), COLS) == FOOFILE_EXPECTED


def test_pipe_text_scan(spark, tmp):
    p = write(tmp, "foofile.txt", FOOFILE_PIPE)
    df = scan_csv(spark, p, sep="|", engram=FOO_SCHEMA)
    assert with_nulls(rows_as_json(df), COLS) == FOOFILE_EXPECTED


def test_missing_value_token_whole_cell_only(spark, tmp):
    p = write(tmp, "foo_missing.csv", FOO_MISSING_CSV)
    df = scan_csv(spark, p, engram=FOO_SCHEMA, missing="*")
    rows = {r["Foo"]: r for r in rows_as_json(df)}
    assert rows["sixth"].get("Baz") is None and rows["sixth"].get("Bar") is None
    assert rows["seventh"]["Bar"] == "big data*"


def test_text_not_trimmed(spark, tmp):
    p = write(tmp, "foofile.csv", FOOFILE_CSV)
    df = scan_csv(spark, p)
    assert df.where(F.col("Foo") == "fourth").first()["Bar"] == " boat "


def test_csv_writer_golden(spark, tmp):
    p = write(tmp, "foofile.csv", FOOFILE_CSV)
    df = scan_csv(spark, p, engram=FOO_SCHEMA).coalesce(1)
    write_csv(df, tmp + "/out", header=True)
    text = open(glob.glob(tmp + "/out/part-*")[0]).read()
    assert text == FOOFILE_CSV_OUT


def test_csv_writer_without_header(spark, tmp):
    p = write(tmp, "foofile.csv", FOOFILE_CSV)
    df = scan_csv(spark, p, engram=FOO_SCHEMA).coalesce(1)
    write_csv(df, tmp + "/out")
    text = open(glob.glob(tmp + "/out/part-*")[0]).read()
    assert text == FOOFILE_CSV_OUT.split("\n", 1)[1]


def test_json_writer_explicit_nulls(spark, tmp):
    import json

    p = write(tmp, "foofile.json", FOOFILE_JSON)
    df = scan_json(spark, p, engram=FOO_SCHEMA).coalesce(1)
    write_json(df, tmp + "/out")
    rows = [json.loads(x) for x in open(glob.glob(tmp + "/out/part-*")[0])]
    assert rows == FOOFILE_EXPECTED
    assert list(rows[5].keys()) == COLS


def test_numbers_and_booleans(spark):
    df = spark.createDataFrame([(" 789", "Y"), ("+19", "n"), ("1,000,000", " true"), ("x", "maybe")], "s string, b string")
    got = df.select(coerce.to_integer(F.col("s")).alias("i"), coerce.to_boolean(F.col("b")).alias("b")).collect()
    assert [(r.i, r.b) for r in got] == [(789, True), (19, False), (1000000, True), (None, None)]


def test_month_first_short_dates(spark):
    df = spark.createDataFrame([("10-08-18",), ("10/08/18",)], "s string")
    got = [r[0] for r in df.select(coerce.iso_utc(coerce.to_timestamp(F.col("s")))).collect()]
    assert got == ["2018-10-08T05:00:00.000Z"] * 2


def test_two_digit_year_pivot(spark):
    df = spark.createDataFrame([("10/18/95",), ("01-JAN-49",), ("10-18-50",)], "s string")
    got = [r[0] for r in df.select(coerce.iso_utc(coerce.to_timestamp(F.col("s")))).collect()]
    assert got == ["1995-10-18T05:00:00.000Z", "2049-01-01T06:00:00.000Z", "1950-10-18T06:00:00.000Z"]


def test_headerless_names_keep_leading_zeros(spark, tmp):
    p = write(tmp, "foo_numbers.txt", "0001\n0020\n300\n")
    df = scan_csv(spark, p, header=False, engram={"fields": [{"name": "filenum", "type": "keyword"}]})
    assert [r.filenum for r in df.collect()] == ["0001", "0020", "300"]


def test_yes_no_booleans_under_declared_boolean(spark, tmp):
    p = write(tmp, "db_schema.csv", "COLUMN_NAME,NULLABLE\nID,N\nNAME,Y\nNOTE,\n")
    eng = {"fields": [{"name": "COLUMN_NAME", "type": "keyword"}, {"name": "NULLABLE", "type": "boolean"}]}
    assert [(r.COLUMN_NAME, r.NULLABLE) for r in scan_csv(spark, p, engram=eng).collect()] == \
        [("ID", False), ("NAME", True), ("NOTE", None)]

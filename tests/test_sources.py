import pytest
from pyspark.sql import types as T

from joinseek.operators.overlap import measure_overlap
from joinseek.operators.profile import profile
from joinseek.plans.registry import candidates
from joinseek.session import settle
from joinseek.sources.tables import has_open_quote, nan_to_null, read_csv, write_report


def written(path, text):
    path.write_text(text)
    return str(path)


def test_types_come_from_all_values(spark, tmp_path):
    text = "i,f,b,m,s,e,z\n1,1.5,True,true,x,,007\n-2,NA,false,,y,NaN,12\n 3,1e3,TRUE,false,N/A,null,3\n"
    df = read_csv(spark, written(tmp_path / "t.csv", text))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    assert kinds == {"i": "bigint", "f": "double", "b": "boolean", "m": "string", "s": "string", "e": "double", "z": "bigint"}
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, "true", "x", None, 7),
        (-2, None, False, None, "y", None, 12),
        (3, 1000.0, True, "false", None, None, 3),
    ]


def test_numbers_too_long_for_bigint_and_java_spellings(spark, tmp_path):
    text = "n,j\n123456789012345678901,1d\n2,2f\n"
    df = read_csv(spark, written(tmp_path / "t.csv", text))
    assert [f.dataType.simpleString() for f in df.schema] == ["double", "string"]


def test_quotes_blanks_and_line_breaks(spark, tmp_path):
    text = 'a,b\n" x","say ""hi"", twice"\n y,"two\nlines"\n'
    path = written(tmp_path / "t.csv", text)
    assert has_open_quote(spark, path)
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [(" x", 'say "hi", twice'), (" y", "two\nlines")]


def test_plain_files_can_be_split(spark, tmp_path):
    path = written(tmp_path / "t.csv", 'a,b\n1,"x, ""y"""\n2,z\n')
    assert not has_open_quote(spark, path)
    assert [tuple(r) for r in read_csv(spark, path).collect()] == [(1, 'x, "y"'), (2, "z")]


def test_given_schema_and_nan(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType())])
    df = read_csv(spark, written(tmp_path / "t.csv", "a,b\nNaN,x\n2,y\n"), schema=schema)
    assert [tuple(r) for r in df.collect()] == [(None, "x"), (2.0, "y")]
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1)], "a double, b int"))
    assert tuple(df.first()) == (None, 1)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "text"])
def test_reports_can_be_written(spark, tmp_path, fmt):
    tables = {"a": spark.range(4), "b": spark.range(5)}
    report = measure_overlap(tables, candidates(spark, [("a", "b", ["id"], ["id"])]), settle(profile(tables)))
    path = str(tmp_path / "report")
    write_report(report, path, fmt)
    options = {"header": True} if fmt == "csv" else {}
    assert spark.read.format(fmt).options(**options).load(path).count() == 1

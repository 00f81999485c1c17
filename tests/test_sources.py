"""CSV files and written times."""

import datetime

import pandas as pd
import pytest

from tablescout.analysis import MODULES, analyze, explore
from tablescout.sources.tables import read_table, read_time
from tests.conftest import rows

CSV = '''id,name,"size, cm",price,ok,mixed,empty
1,"says ""hi"", twice",10,1.5,True,7,
2,"two
lines",NA,nan,False,x,
3,N/A,12,2e3,true,-1,""
4,plain,null,.5,FALSE,None,NULL
'''


def test_csv_cells_as_pandas_reads_them(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV)
    df, want = read_table(spark, str(path)), pd.read_csv(path)
    assert df.columns == list(want.columns)
    assert [t for _, t in df.dtypes] == ["bigint", "string", "bigint", "double", "boolean", "string", "string"]
    for got, row in zip(rows(df, "id"), want.to_dict("records")):
        for c in want.columns:
            assert (got[c] is None) == bool(pd.isna(row[c]))
            if got[c] is not None:
                assert got[c] == row[c] or str(got[c]) == str(row[c])
    typed = read_table(spark, str(path), schema="id int, name string, size double, price double, ok boolean, mixed int, empty string")
    assert [r["mixed"] for r in rows(typed, "id")] == [7, None, -1, None]
    assert [r["size"] for r in rows(typed, "id")] == [10.0, None, 12.0, None]


TIMES = {
    "2024-03-05": (2024, 3, 5), "2024-03-05T07:08:09": (2024, 3, 5, 7, 8, 9), "2024-03-05 07:08": (2024, 3, 5, 7, 8),
    "2024-03-05T07:08:09.250": (2024, 3, 5, 7, 8, 9, 250_000), "2024-03-05T07:08:09Z": (2024, 3, 5, 7, 8, 9),
    "2024-03-05T07:08:09.123456+02:30": (2024, 3, 5, 4, 38, 9, 123_456), "2024-03-05 07:08:09-0500": (2024, 3, 5, 12, 8, 9),
    "2024/03/05": (2024, 3, 5), "2024-03": (2024, 3, 1), "3/5/2024": (2024, 3, 5), "3/5/2024 7:08": (2024, 3, 5, 7, 8),
    "3/5/2024 17:08:09": (2024, 3, 5, 17, 8, 9), "5-Mar-2024": (2024, 3, 5), "Mar 5, 2024": (2024, 3, 5), "March 5, 2024": (2024, 3, 5),
    "5 September 2024": (2024, 9, 5), " 2024-03-05 ": (2024, 3, 5), "soon": None, "2024-13-45": None, "": None, "20240305": None,
}


def test_written_times(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", read_time(df.t).alias("v")).collect()}
    assert got == {t: v and datetime.datetime(*v) for t, v in TIMES.items()}


@pytest.mark.parametrize("n", [0, 1, 3, 7, 10])
def test_modules_on_short_tables(spark, n):
    data = [(f"2024-01-{i + 1:02d}", float(i), float(i * i % 7), "ab"[i % 2]) for i in range(n)]
    out = analyze(spark.createDataFrame(data, "day string, x double, y double, g string"), MODULES)
    for frame in out.results.values():
        frame.collect()
    assert out.findings is None or out.findings.count() >= 0


@pytest.mark.parametrize("schema", ["g string, h string", "x double, y double", "t timestamp_ntz, u timestamp_ntz"])
def test_modules_on_tables_of_one_kind(spark, schema):
    make = {"g": lambda i: "pq"[i % 2], "h": lambda i: "rst"[i % 3], "x": float, "y": lambda i: float(i % 5)}
    time = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)
    data = [tuple(make.get(f.split()[0], time)(i) for f in schema.split(", ")) for i in range(24)]
    df = spark.createDataFrame(data, schema)
    out = analyze(df, MODULES)
    for frame in out.results.values():
        frame.collect()
    told = out.findings.collect() if out.findings is not None else []
    assert all(r["finding"] for r in told)
    labels = {r["label"] for r in explore(df).candidates.collect()}
    assert "Is there external context we should factor in?" in labels


def test_csv_without_breaks_in_cells_is_split(spark, tmp_path):
    path, broken = tmp_path / "t.csv", tmp_path / "b.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x, ""{i}"" y"\n' for i in range(20_000)))
    broken.write_text('a,b\n1,"two\nlines"\n2,x\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        df = read_table(spark, str(path))
        assert df.rdd.getNumPartitions() > 2 and df.count() == 20_000 and df.where("b = concat('x, \"', a, '\" y')").count() == 20_000
        whole = read_table(spark, str(broken))
        assert whole.count() == 2 and whole.where("a = 1").first()["b"] == "two\nlines"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

from pyspark.sql import functions as F

from foldwise.operators import features
from foldwise.sources import readers


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,when ,KWH \nx,2013-01-01 00:30:00.0000000, 0.5 \ny,2013-01-01 01:00:00.0000000,Null\n")
    df = readers.csv(spark, str(tmp_path / "a.csv"), "id string, `when ` string, `KWH ` string", {"KWH": "load"})
    assert df.columns == ["id", "when", "load"]
    assert [r[0] for r in df.select(features.to_number(F.col("load"))).collect()] == [0.5, None]
    (tmp_path / "b.csv").write_text("d;v\n10/03/2004;2,6\n11/03/2004;-200\n")
    df = readers.csv(spark, str(tmp_path / "b.csv"), "d string, v string", sep=";")
    assert [r[0] for r in df.select(readers.decimal_comma(F.col("v"))).collect()] == [2.6, -200.0]
    (tmp_path / "c.txt").write_text("1 1  0.5 x\n\n1 2 0.25 3  \n")
    assert [tuple(r) for r in readers.whitespace_table(spark, str(tmp_path / "c.txt"), ["a", "b", "c", "d"]).collect()] == [(1, 1, 0.5, None), (1, 2, 0.25, 3)]
    df = spark.createDataFrame([("13/08/2016",), ("13/08/16",), ("soon",)], "d string")
    got = [r[0] and r[0].date().isoformat() for r in df.select(readers.mixed_date(F.col("d"), ["dd/MM/yyyy", "dd/MM/yy"])).collect()]
    assert got == ["2016-08-13", "2016-08-13", None]
    (tmp_path / "p1.txt").write_text("Time,Parameter,Value\n00:07,HR,73\nbad row\n01:07,Temp,x\n")
    assert [tuple(r) for r in readers.long_records(spark, str(tmp_path / "p1.txt")).select("minute", "parameter", "value").collect()] == [(7, "HR", 73.0)]


def test_maturation_stream(spark, tmp_path):
    from foldwise.streaming.maturation import matured

    a = spark.sql("SELECT 'x' AS k, TIMESTAMP '2024-01-01 00:00:00' AS p, TIMESTAMP '2024-01-01 02:00:00' AS e, 1.0D AS prediction")
    b = spark.sql("SELECT 'x' AS k, TIMESTAMP '2024-01-01 01:00:00' AS at, 2.0D AS y UNION ALL SELECT 'x', TIMESTAMP '2024-01-01 02:00:00', 3.0D")
    a.write.parquet(str(tmp_path / "a")), b.write.parquet(str(tmp_path / "b"))
    sa, sb = (spark.readStream.schema(x.schema).parquet(str(tmp_path / n)) for x, n in ((a, "a"), (b, "b")))
    q = matured(sa, sb, "k").writeStream.format("memory").queryName("matured").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["y"] for r in spark.table("matured").collect()] == [2.0]

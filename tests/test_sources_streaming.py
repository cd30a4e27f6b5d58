import datetime as dt

import pytest
from pyspark.sql import types as T

from ledgerloom.sources.tables import read_csv_typed, read_documents, write_checked
from ledgerloom.streaming.lines import finding_counts_stream, stream_of


def test_typed_csv_keeps_the_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,d,n\n1,2024-6-8,5\n2,2025-02-30,x\n3,,\n"4 ""q""",2024-01-01,7\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("d", T.DateType()), T.StructField("n", T.LongType())])
    got = [tuple(r) for r in read_csv_typed(spark, str(tmp_path / "a.csv"), schema).orderBy("id").collect()]
    assert got == [("1", dt.date(2024, 6, 8), "2024-6-8", 5, "5"), ("2", None, "2025-02-30", None, "x"), ("3", None, None, None, None), ('4 "q"', dt.date(2024, 1, 1), "2024-01-01", 7, "7")]


def test_documents_are_whole(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ntwo")
    assert [r.text for r in read_documents(spark, str(tmp_path / "a.md")).collect()] == ["one\ntwo"]


def test_nothing_is_written_with_violations(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError, match="not written"):
        write_checked(df, df.where("id = 1"), str(tmp_path / "out"))
    write_checked(df, df.where("id > 9"), str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_stream_counts_each_line_once(spark, tmp_path):
    schema = "line_id string, contract_id string, service_date string, quantity long, unit_price_cents long, line_total_cents long, loaded_at timestamp"
    t = dt.datetime(2024, 1, 1, 12)
    rows = [("a", "c", "2024-01-01", 2, 5, 10, t), ("a", "c", "2024-01-01", 2, 5, 10, t), ("b", "c", "bad", 2, 5, 11, t), (None, "c", "x", 1, 1, 1, t), ("d", "c", "2024-01-02", 1, 1, 1, t + dt.timedelta(days=20)), ("e", "c", "2024-01-02", 1, 1, 1, t + dt.timedelta(days=40))]
    src = str(tmp_path / "in")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(src)
    s = stream_of(spark, src, spark.read.parquet(src).schema)
    q = finding_counts_stream(s).writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select n_lines, n_arithmetic, n_dates from counts order by window_start").collect()
    assert tuple(got[0]) == (2, 1, 1)

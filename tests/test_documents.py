import json

from pyspark.sql import functions as F

from ledgerloom.functions import loose, records
from ledgerloom.sources import documents as d


def test_text_is_preferred_to_a_scan(spark):
    files = spark.createDataFrame([("c/a.pdf",), ("c/a.md",), ("c/b.PDF",), ("d/x.png",), ("d/y.zip",)], "path string")
    got = {r.path: r.route for r in d.preferred_files(files).collect()}
    assert got == {"c/a.md": "text", "c/b.PDF": "pdf_text", "d/x.png": "ocr", "d/y.zip": "failed"}
    t = d.folder_trust(d.preferred_files(files).withColumn("f", F.substring("path", 1, 1)), "f").collect()
    assert {r.f: r.trust for r in t} == {"c": 1.0, "d": 0.5}


def test_headers_must_agree(spark):
    docs = spark.createDataFrame([("x", "No. 12 from May"), ("x", "No. 12"), ("y", "No. 1"), ("y", "No. 2"), ("z", None)], "k string, t string")
    got = {r.k: (r.number, r.month, r.agree) for r in d.header_fields(docs, "k", "t", {"number": r"No\. (\d+)", "month": r"from (\w+)"}).collect()}
    assert got == {"x": ("12", "May", True), "y": ("1", None, False), "z": (None, None, True)}


def test_recordings_of_both_kinds(spark):
    texts = [json.dumps({"0": "plain reply", "1": {"reply": "told", "usage": {"input_tokens": 3, "output_tokens": 4, "seconds": 1.5}}}), "not json", None]
    got = {r.chunk: (r.reply, r.usage and r.usage.input_tokens) for r in d.recordings(spark.createDataFrame([(t,) for t in texts], "t string"), "t", []).collect()}
    assert got == {"0": ("plain reply", None), "1": ("told", 3)}


def test_runs_are_tagged(spark, tmp_path):
    for n in ("qa_v4__m", "qa_v5__m"):
        (tmp_path / f"{n}.csv").write_text("a,b\n1,x\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert sorted(r.run for r in d.tagged_csv(spark, f"{tmp_path}/qa_*.csv", schema).collect()) == ["qa_v4__m", "qa_v5__m"]


def test_rates_in_three_forms(spark):
    rows = ['{"rates":[{"cents":5,"valid_from":"2024-01-01","valid_to":null}]}', '{"rate_cents":7,"rate_cents_after":"8","rate_change_date":"2025-01-01T00:00"}', '{"rate_cents":"9"}', '{"x":1}', '{"rates":[{"cents":0}],"rate_cents":4}', '{"rates":[],"rate_cents":4}', '{"rate_cents":true}', None]
    got = [[(x.cents, str(x.valid_from), str(x.valid_to)) for x in r.p] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s string").orderBy("i").select(records.rate_periods(F.try_parse_json("s")).alias("p")).collect()]
    assert got == [[(5, "2024-01-01", "None")], [(7, "None", "2024-12-31"), (8, "2025-01-01", "None")], [(9, "None", "None")], [], [], [(4, "None", "None")], [], []]


def test_odd_records_and_replies(spark):
    read = records.read_record(F.try_parse_json("s"), F.col("t")).alias("r")
    rows = [(None, "x"), ("{}", "x"), ('{"service": 7, "unit_basis": "hour", "rate_cents": 5}', "costs of 7"), ('{"service": "A", "unit_basis": "hour", "rate_cents": 5, "bundle": {"partner_service": "B", "this_rate_cents": "1", "partner_rate_cents": 2}, "volume_discounts": 3}', None)]
    got = [r.r for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, s string, t string").orderBy("i").select(read).collect()]
    assert [r.problems for r in got] == [["no_name"], ["no_name"], [], []] and got[2].service == "7" and got[3].bundle.partner_cents == 2 and got[3].quote_verbatim is None and got[3].discounts == []
    for text, tag, n in [("[]", "bare_list", 0), ('{"services": 5}', "ok", 0), ('{"rows": [1, 2]}', "key_rows", 2), ('{"data": 1}', "unrecognised", 0), ('{"service": "A"}', "single_object", 1), (None, "unrecognised", 0), ("3", "unrecognised", 0)]:
        r = spark.createDataFrame([(text,)], "s string").select(records.envelope_tag(F.try_parse_json("s")).alias("t"), F.size(records.payload_records(F.try_parse_json("s"))).alias("n")).first()
        assert (r.t, r.n) == (tag, n), text


def test_recordings_come_back(spark):
    df = spark.createDataFrame([("m", 1, 'say "x"\n', 3), ("m", 2, None, None), ("n", 1, "{y}", 0)], "m string, c int, r string, k long")
    out = d.recordings(d.record(df, ["m"], F.col("c").cast("string"), F.coalesce("r", F.lit("")), F.struct(F.col("k").alias("input_tokens"))), "recording", ["m"])
    assert sorted((r.m, r.chunk, r.reply, r.usage.input_tokens) for r in out.where("usage.input_tokens is not null").collect()) == [("m", "1", 'say "x"\n', 3), ("n", "1", "{y}", 0)]
    assert out.count() == 3


def test_money_forms(spark):
    df = spark.createDataFrame([(123456, "costs 1,234.56 a day"), (123456, "costs 91,234.567"), (5, "0.05"), (100, "nothing")], "c long, t string")
    got = df.select(loose.money_forms(F.col("c")).alias("f"), loose.states_any(F.col("t"), loose.money_forms(F.col("c"))).alias("s")).collect()
    assert got[0].f == ["123456", "123,456", "1234.56", "1,234.56"] and [r.s for r in got] == [True, False, True, False]

import math

from pyspark.sql import functions as F

from ledgerloom.functions import loose, markup
from ledgerloom.operators import similarity

TEXT = "intro\r\n\r\n## Base Rates\r\n\r\n| Service | Basis | Rate | Cap |\r\n|---|---|---|---|\r\n| Gait Study | per hour | GBP 1,301.25 | — |\r\n| Scar Care* | Per Night | GBP 7.50, later GBP 9.00 | 14 |\r\n\r\n### Notes on rates\nno table | here\n"


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_sections_and_tables(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "plain")], "id int, text string")
    s = markup.sections(df, ["id"], "text").orderBy("id", "seq").collect()
    assert [(r.id, r.title) for r in s] == [(1, None), (1, "Base Rates"), (1, "Notes on rates"), (4, None)]
    assert markup.section_with(markup.sections(df, ["id"], "text"), ["id"], ["RATES"]).first().title == "Base Rates"
    rows = markup.table_rows(df, ["id"], "text").select("line", markup.cell_under("item|service").alias("s"), markup.cell_under("rate").alias("r"), markup.cell_under("cap").alias("c")).orderBy("line").collect()
    assert [(r.s, r.r, r.c) for r in rows] == [("Gait Study", "GBP 1,301.25", None), ("Scar Care*", "GBP 7.50, later GBP 9.00", "14")]


def test_values(spark):
    assert [one(spark, markup.cents, x) for x in ("GBP 1,301.25", "4225", "—", None, "1.2.3")] == [130125, 422500, None, None, None]
    assert [str(one(spark, markup.fraction, x)) for x in ("+20%", "fifteen percent (15%)", "none")] == ["0.200000", "0.150000", "None"]
    assert [one(spark, markup.first_integer, x) for x in ("more than 10 items", "no")] == [10, None]
    assert one(spark, markup.repaired_amounts, "GBP 2S2.SO per hour, S patients, GBP l,OO5.00") == [25250, 100500]
    assert [one(spark, loose.lenient_integer, x) for x in ("1,301", "12.5", "12.0", "true", "", None)] == [1301, None, 12, None, None, None]
    assert [str(one(spark, loose.lenient_fraction, x)) for x in ("20", "0.2", "20%", "0.5%", "x")] == ["0.200000", "0.200000", "0.200000", "0.005000", "None"]
    assert [one(spark, loose.canonical_basis, x) for x in ("Per Hour", "hour", "per_unit_dispensed", "per-night", "weekly")] == ["per_hour", "per_hour", "per_unit_dispensed", "per_night", None]


def test_json_replies(spark):
    replies = {'{"a": 1}': "plain", 'Sure:\n```json\n{"a": 1}\n```': "fenced", 'It is {"a": 1}, I think': "chatty", "no braces": "none", "7": "none"}
    for text, kind in replies.items():
        assert one(spark, loose.payload_kind, text) == kind, text
        got = one(spark, lambda c: F.try_variant_get(loose.json_payload(c), "$.a", "int"), text)
        assert got == (None if kind == "none" else 1)


def test_character_ngrams_and_weights(spark):
    assert sorted(one(spark, similarity.char_ngrams, "Ab")) == sorted([" a", "ab", "b ", " ab", "ab ", " ab "])
    assert sorted(one(spark, similarity.char_ngrams, "a")) == sorted([" a", "a ", " a "])
    assert one(spark, similarity.char_ngrams, "  ") == []
    texts = ["gait study", "scar care", "gait care"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    w, _ = similarity.tfidf(df, ["id"], "t")

    def grams(s):
        out = []
        for word in s.split():
            p = f" {word} "
            for n in (2, 3, 4):
                out += [p[i : i + n] for i in range(max(1, len(p) - n + 1))]
                if len(p) <= n:
                    break
        return out

    for i, t in enumerate(texts):
        g = grams(t)
        raw = {x: g.count(x) * (math.log((1 + 3) / (1 + sum(x in grams(u) for u in texts))) + 1) for x in set(g)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        got = {r.gram: r.weight for r in w.where(F.col("id") == i).collect()}
        assert got.keys() == raw.keys() and all(abs(got[k] - raw[k] / norm) < 1e-9 for k in raw)


def test_zero_vectors_and_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 0.0])], "id int, v array<float>")
    got = similarity.cosine_top_k(df, df.where("id = 1"), "id", "v", 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 1.0), (4, 1.0)]


def test_clauses_are_whole(spark):
    long = "1.2 " + "word " * 1000 + "end"
    df = spark.createDataFrame([(1, f"# Terms\n\n{long}\n\nshort")], "id long, t string")
    got = markup.clauses(df, ["id"], "t").collect()
    assert [(r.heading, r.clause, r.entry) for r in got] == [("Terms", long, long[:1800])]


def test_tables_headings_and_odd_texts(spark):
    text = "| A | B |\n|---|---|\n| 1 | 2 |\n| 3 | - |\n| 5 | 6 |\ntext\n|X|\n|7|\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "|"), (5, "a | b"), (6, "## T\nx\n## T\ny")], "id int, text string")
    rows = [(r.id, r.line, r.header, r.cells) for r in markup.table_rows(df, ["id"], "text").orderBy("id", "line").collect()]
    assert rows == [(1, 2, ["A", "B"], ["1", "2"]), (1, 3, ["A", "B"], ["3", None]), (1, 4, ["A", "B"], ["5", "6"]), (1, 7, ["X"], ["7"])]
    lots = markup.table_batches(markup.table_rows(df, ["id"], "text"), ["id"], 2).orderBy("first").collect()
    assert [(r.first, r.last, r.text) for r in lots] == [(1, 2, "| A | B |\n| 1 | 2 |\n| 3 |  |"), (3, 3, "| A | B |\n| 5 | 6 |")]
    assert [(r.id, r.seq, r.body) for r in markup.last_sections(markup.sections(df, ["id"], "text"), ["id"]).collect()] == [(6, 1, "y")]
    assert markup.clauses(df, ["id"], "text", least=1).where("id in (2, 3)").count() == 0


def test_articles_by_heading_or_number(spark):
    df = spark.createDataFrame([(1, "## Rates\n1.1 In respect of A\n1.2 In respect of B\n## Other\n2.1 In respect of C"), (2, "1.1 In respect of A\nmore\n2.1 In respect of B\n1.2 In respect of C"), (3, "nothing"), (4, None)], "id int, text string")
    got = sorted((r.id, r.title, r.n_clauses, r.text) for r in markup.articles(df, ["id"], "text", "RATES", r"^\d+\.\d+ In respect of").collect())
    assert [g[:3] for g in got] == [(1, "Rates", 2), (2, "Article 1", 2), (2, "Article 2", 1)] and got[1][3] == "1.1 In respect of A\nmore\n\n1.2 In respect of C"


def test_forms_and_money(spark):
    assert one(spark, lambda c: loose.number_forms(c.cast("long")), "12") == ["12", "twelve"] and one(spark, lambda c: loose.number_forms(c.cast("long")), "21") == ["21"]
    assert one(spark, lambda c: loose.percent_forms(c.cast("decimal(6,4)")), "0.075") == ["7.5%", "7.5 %", "7.5 percent", "7.5 per cent"]
    assert [one(spark, loose.has_money, x) for x in ("GBP 5", "£7", "12.50", "500 cents", "5 cents", "none")] == [True, True, True, True, False, False]


def test_an_encoder_is_fitted_once_and_prefers_given_vectors(spark):
    names = spark.createDataFrame([("gait study",), ("scar care",)], "t string")
    texts = spark.createDataFrame([(1, "gait care"), (2, "zzz")], "id int, t string")
    e = similarity.Encoder.fit(names, "t", spark.createDataFrame([("zzz", "v0", 1.0)], "text string, gram string, weight double"))
    got = e.encode(texts, ["id"], "t").collect()
    assert [(r.gram, r.weight) for r in got if r.id == 2] == [("v0", 1.0)] and abs(sum(r.weight**2 for r in got if r.id == 1) - 1) < 1e-9

import random

import pytest

from ledgerloom.operators.packed import infer_delimiters, split_packed

CODES = ["unit_price", "late_claim", "daily_cap", "wrong_basis", "out_of_window"]
PHRASES = ["see note; line 3", "rate & basis check", "provider's own fix", 'marked "urgent" here', "stay | split", "tier-2 review"]
DELIMITERS = [",", ";", "|", "\t", "\r\n", " / ", "¦", ", ", "||"]


def quoted(v, rng):
    if rng.random() < 0.5 or "'" in v:
        return '"' + (v.replace('"', '""') if rng.random() < 0.5 else v.replace('"', '\\"')) + '"'
    return "'" + v.replace("'", "''") + "'"


def packed(rng):
    values = [rng.choice(CODES if rng.random() < 0.9 else PHRASES) for _ in range(rng.choice([1, 1, 2, 3, 5]))]
    d = rng.choice(DELIMITERS)
    parts = [quoted(v, rng) if v in PHRASES and any(c in v for c in ";|'\"/") or rng.random() < 0.2 else v for v in values]
    s = d.join(" " * rng.randrange(2) + p + " " * rng.randrange(2) for p in parts)
    if rng.random() < 0.2:
        s = "[" + d.join(quoted(v, rng) for v in values) + "]"
    elif rng.random() < 0.1:
        s += d
    return s, values


def test_round_trip_of_packed_fields(spark):
    rng = random.Random(4)
    cases = [packed(rng) for _ in range(3000)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "id long, v string")
    got = {}
    for r in split_packed(df, ["id"], "v").collect():
        got.setdefault(r.id, []).append((r.pos, r.value))
    for i, (s, values) in enumerate(cases):
        assert [v for _, v in sorted(got.get(i, []))] == values, s
        assert [p for p, _ in sorted(got.get(i, []))] == list(range(1, len(values) + 1))


def test_delimiters_differ_by_source(spark):
    rows = [("a", "x_1-y_2"), ("a", "y_2-z_3-x_1"), ("a", "z_3"), ("b", "x_1+y_2"), ("b", "y_2+z_3")]
    df = spark.createDataFrame(rows, "s string, v string")
    from pyspark.sql import functions as F

    got = {r.source: r.delimiters for r in infer_delimiters(df, "v", F.col("s")).collect()}
    assert "-" in got["a"] and "+" not in got["a"] and "+" in got["b"] and "-" not in got["b"]


def test_defined_results_of_odd_fields(spark):
    long = '"' + 'a""' * 50_000 + '"; "x"'
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "[]"), (5, '[""]'), (6, "a;;b; "), (7, long), (8, '"open; x'), (None, "a;b"), (9, "a;b"), (9, "a;b"), (10, "x (y)"), (11, "(a; b)")]
    df = spark.createDataFrame([(k, v, 7, "q", 1) for k, v in rows], "id long, v string, pos int, value string, __source int")
    got = {}
    for r in split_packed(df, ["id"], "v").collect():
        got.setdefault(r.id, []).append(r.value)
    assert not {1, 2, 3, 4, 5} & set(got)
    assert sorted(got[6]) == ["a", "b"] and len(got[9]) == 4 and sorted(got[None]) == ["a", "b"]
    assert sorted(map(len, got[7])) == [1, 100_000] and sorted(got[8]) == ['"open', "x"]
    assert got[10] == ["x (y)"] and sorted(got[11]) == ["a", "b"]


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, "id long, v string")
    assert split_packed(df, ["id"], "v").count() == 0

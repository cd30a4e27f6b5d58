import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerloom.operators import checks, matching, ordered, scores

D0 = dt.date(2024, 1, 1)


def rows_of(rng, n):
    return [(f"L{i:04d}", rng.choice(["a", "b", None]), rng.choice(["s", "t"]), None if rng.random() < 0.1 else D0 + dt.timedelta(rng.randrange(6)), rng.choice([None, -2, 0, 1, 3, 5])) for i in range(n)]


def ordering(r):
    return (r[3] is None, r[3] or D0, r[0])


def test_prior_total_and_allowance_equal_the_loops(spark):
    rng = random.Random(5)
    rows = rows_of(rng, 400)
    df = spark.createDataFrame(rows, "id string, g string, s string, day date, q long")
    prior, used, want_p, want_a = {}, {}, {}, {}
    for r in sorted(rows, key=ordering):
        k = (r[1], r[2])
        want_p[r[0]] = prior.get(k, 0)
        prior[k] = prior.get(k, 0) + (r[4] or 0)
        d = (*k, r[3])
        take = min(r[4] or 0, max(0, 4 - used.get(d, 0)))
        want_a[r[0]] = take
        used[d] = used.get(d, 0) + take
    got = ordered.prior_total(df, ["g", "s"], "day", [F.col("id")], F.col("q"), "p")
    assert {r.id: r.p for r in got.collect()} == want_p
    got = ordered.allowance(df, ["g", "s", "day"], [F.col("id")], F.coalesce("q", F.lit(0)), F.lit(4), "a")
    assert {r.id: r.a for r in got.collect()} == want_a


def test_mode_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y"), ("a", 4, "x"), ("b", 5, None)], "k string, o int, v string")
    got = {r.k: (r.v, r.n, r.share) for r in ordered.mode_of(df, ["k"], ["v"], [F.col("o")]).collect()}
    assert got == {"a": ("x", 2, 0.5), "b": (None, 1, 1.0)}


def test_tiers_are_strict(spark):
    df = spark.createDataFrame([(v,) for v in (None, 60, 61, 180, 181)], "v long")
    assert [r.t for r in df.select(ordered.tier_of(F.col("v"), [(60, 10), (180, 20)]).alias("t")).collect()] == [None, None, 10, 10, 20]


def test_interval_lookup_prefers_dated_periods(spark):
    e = spark.createDataFrame([(1, "x", dt.date(2024, 5, 1)), (2, "x", None), (3, "y", dt.date(2024, 5, 1)), (4, "x", dt.date(2030, 1, 1))], "id int, k string, d date")
    p = spark.createDataFrame([("x", 0, None, None, 7), ("x", 1, dt.date(2024, 1, 1), dt.date(2024, 12, 31), 8), ("x", 2, dt.date(2024, 1, 1), None, 9)], "k string, o int, a date, b date, v int")
    got = {r.id: r.v for r in matching.interval_lookup(e, p, ["k"], "d", "a", "b", "o", ["v"]).collect()}
    assert got == {1: 8, 2: 7, 3: None, 4: 9}


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(6)
    a = [(i, rng.choice(["p", "q", None]), None if rng.random() < 0.1 else D0 + dt.timedelta(rng.randrange(90))) for i in range(150)]
    b = [(i, rng.choice(["p", "q"]), D0 + dt.timedelta(rng.randrange(90))) for i in range(12)]
    df = lambda x: spark.createDataFrame(x, "id int, k string, day date")
    for n in (0, 1, 7):
        got = {r.id: r.near for r in matching.with_neighbour(df(a), df(b), ["k"], "day", n, "near").collect()}
        assert got == {i: bool(k and d and any(k == x and abs((d - y).days) <= n for _, x, y in b)) for i, k, d in a}


def test_full_difference(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "x", 1), (3, None, 1)], "k int, f string, g int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "z", 1)], "k int, f string, g int")
    got = {r.k: (r.state, r.changed) for r in matching.full_difference(a, b, ["k"], ["f", "g"]).collect()}
    assert got == {1: ("same", ""), 2: ("changed", "f|g"), 3: ("only_old", ""), 4: ("only_new", "")}


def test_scores_without_cases_are_zero(spark):
    df = spark.createDataFrame([("a", True, True), ("a", True, False), ("a", None, True), ("b", False, False)], "c string, p boolean, t boolean")
    got = {r.c: (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in scores.precision_recall(df, ["c"], F.col("p"), F.col("t")).collect()}
    assert got == {"a": (1, 1, 1, 0.5, 0.5, 0.5), "b": (0, 0, 0, 0.0, 0.0, 0.0)}


def test_grouping_agreement_bounds(spark):
    same = spark.createDataFrame([(i % 3, i % 3 + 7) for i in range(30)], "a int, b int")
    r = scores.grouping_agreement(same, "a", "b").first()
    assert (r.homogeneity, r.completeness, r.adjusted_rand) == (1.0, 1.0, 1.0)
    assert scores.grouping_agreement(same.limit(0), "a", "b").first().homogeneity == 1.0


def test_extremes_keep_ties(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 3), ("a", "z", None), ("b", "u", 1)], "k string, n string, v int")
    assert sorted(r.n for r in scores.extremes(df, ["k"], "v").collect()) == ["u", "x", "y"]


def test_checks_never_flag_nulls(spark):
    lines = spark.createDataFrame([("c", "i", "s", "l1", 2, 5, 10), ("c", "i", "s", "l2", 2, 5, 11), ("c", "i", "s", "l3", None, 5, 11)], "contract_id string, invoice_id string, source_seq string, line_id string, quantity long, unit_price_cents long, line_total_cents long")
    assert [r.detail for r in checks.line_arithmetic(lines).collect()] == ["l2"]


def test_exact_quantiles_and_best_two_with_hot_groups(spark):
    import random
    import statistics

    rng = random.Random(3)
    rows = [("hot", rng.choice([1.0, 2.5, rng.random() * 100]), f"n{i}") for i in range(900)] + [("one", 7.0, "a"), ("none", None, "b"), (None, 3.0, "c"), (None, 5.0, "d")]
    df = spark.createDataFrame(rows, "g string, v double, n string")
    got = {r.g: r for r in scores.spread(df, ["g"], "v").collect()}
    hot = sorted(v for g, v, _ in rows if g == "hot")
    at = lambda q: hot[int(q * (len(hot) - 1))] + (hot[min(len(hot) - 1, int(q * (len(hot) - 1)) + 1)] - hot[int(q * (len(hot) - 1))]) * (q * (len(hot) - 1) % 1)
    assert abs(got["hot"].median - statistics.median(hot)) < 1e-6 and abs(got["hot"].p95 - at(0.95)) < 1e-5
    assert (got["one"].median, got["none"].n, got["none"].median, got[None].median) == (7.0, 0, None, 4.0)
    assert scores.spread(df, [], "v").first().n == 903 and scores.spread(df.limit(0), ["g"], "v").count() == 0
    two = {r.g: (r.best, r.second) for r in ordered.best_two(df.where("v is not null"), ["g"], "n", "v").collect()}
    want = sorted([(-v, n) for g, v, n in rows if g == "hot"])[:2]
    assert two["hot"] == (want[0][1], want[1][1]) and two["one"] == ("a", None) and two[None] == ("d", "c")


def test_only_hot_keys_are_spread(spark):
    from ledgerloom.operators.bounded import hot_keys, salted_join

    big = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(400)] + [(None, 1)] * 99, "k string, x int")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), (None, 4)], "k string, y int")
    assert hot_keys(big, ["k"]) == [("hot",)]
    assert salted_join(big, small, ["k"]).count() == 1001 and salted_join(big, small, ["k"], "left").count() == 999 + 500
    assert salted_join(big, small, ["k"], "left_anti").count() == 399 + 99 and salted_join(big, small, ["k"], "left_semi").count() == 501
    assert salted_join(big, small, ["k"], "inner", None, F.col("x") < F.col("y")).count() == 3


def test_defects_of_rules(spark):
    gold = spark.createDataFrame([("c", "service", "A", ""), ("c", "cap", "A", "5"), ("c", "cap", "B", None)], "c string, f string, i string, v string")
    other = spark.createDataFrame([("c", "service", "Z", ""), ("c", "cap", "A", "6"), ("c", "cap", "B", None), ("c", "cap", "Q", "1")], "c string, f string, i string, v string")
    got = {(r.f, r.i): r.kind for r in scores.rule_defects(gold, other, ["c"], "f", "i", "v").collect()}
    assert got == {("service", "A"): "MISSED", ("service", "Z"): "HALLUCINATED", ("cap", "A"): "WRONG", ("cap", "Q"): "INVENTED"}
    r = {x.f: x for x in scores.family_scores(gold, other, ["c"], "f", "i", "v").collect()}
    assert (r["service"].f1, r["service"].invented_rate) == (0.0, 1.0)
    retrieved, relevant = spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "q int, i int"), spark.createDataFrame([(1, 1), (1, 3), (2, 8)], "q int, i int")
    assert tuple(scores.recall_at(retrieved, relevant, "q", "i").first()) == (2, 0.25)

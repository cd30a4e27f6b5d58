import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import tokens
from ledgerloom.llm.mixing import draw_mixture, mixture_report, nearest_sum, source_name, token_counts, water_fill, water_levels, with_shares
from ledgerloom.llm.splitting import split_oversized, split_text


@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0, 1), st.floats(0, 100)), min_size=1), st.floats(0, 500))
def test_water_filling(sources, total):
    shares, caps = {s: w for s, (w, _) in sources.items()}, {s: c for s, (_, c) in sources.items()}
    want = water_fill(shares, caps, total)
    assert all(-1e-9 <= want[s] <= caps[s] + 1e-9 for s in shares)
    open_ = [s for s in shares if shares[s] > 1e-9 and want[s] < caps[s] - 1e-6]
    if open_:  # what isn't clamped is in proportion, and the total is reached
        assert sum(want.values()) == pytest.approx(total, rel=1e-6, abs=1e-6)
        levels = [want[s] / shares[s] for s in open_]
        assert max(levels) == pytest.approx(min(levels), rel=1e-6, abs=1e-6)


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 2), ("d", 0.05, 2)]


def drawn(spark, rows, partitions=4, seed=17, targets=TARGETS, total=None):
    df = spark.createDataFrame(rows, "id long, s string, n long").withColumn("h", F.lit(1)).withColumn("bucket", F.lit(2)).repartition(partitions)
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    draws, plan = draw_mixture(df, "id", source_name(F.col("s")), "n", t, seed, total)
    return draws.collect(), {r.source: r for r in mixture_report(draws, plan).collect()}


def test_mixture(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a"] * 6 + ["B ", "b", " C", "other", None]), rng.choice([0, 5, 40, 300, None])) for i in range(3000)]
    draws, report = drawn(spark, rows)
    have = {s: sum(n or 0 for _, x, n in rows if x and x.strip().lower() == s) for s in "abcd"}
    caps = {s: have[s] * r for s, _, r in TARGETS}
    want = water_fill({s: w for s, w, _ in TARGETS}, caps, sum(have.values()))
    for s, w, most in TARGETS:
        got = [(r.n_tokens, r.times) for r in draws if r.source == s]
        assert all(1 <= k <= most for _, k in got)
        assert sum(n * k for n, k in got) == pytest.approx(want[s], abs=2.5) == report[s].drawn_tokens or want[s] == 0
        assert report[s].target_share == w and report[s].available_tokens == have[s]
    assert report["d"].drawn_tokens == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1, abs=1e-5)
    assert {r.source for r in draws} <= set("abcd") and len({r.doc_id for r in draws}) == len(draws)
    again, _ = drawn(spark, rows, 13)
    assert sorted(map(tuple, again)) == sorted(map(tuple, draws))
    other, _ = drawn(spark, rows, 4, seed=18)
    assert sorted(map(tuple, other)) != sorted(map(tuple, draws))


def test_mixture_of_odd_tables(spark):
    draws, report = drawn(spark, [], targets=TARGETS)
    assert draws == [] and all(r.drawn_tokens == 0 and r.actual_share == 0 for r in report.values())
    draws, report = drawn(spark, [(1, "a", 10)], targets=[])
    assert draws == [] and report == {}
    rows = [(1, "a", 10), (1, "a", 10), (None, "a", 10)]
    draws, _ = drawn(spark, rows, targets=[("a", 1.0, 2), ("b", None, None)], total=10**6)
    assert sorted((r.doc_id or 0, r.times, r.copies) for r in draws) == [(0, 2, 1), (1, 2, 2)]
    draws, report = drawn(spark, rows, targets=[("a", 0.4, 2), ("A ", 0.6, 1), ("b", None, None)], total=50)
    assert sum(r.times * r.copies for r in draws) == 5 and report["a"].drawn_tokens == 50 and report["a"].max_repeats == 2


def test_copies_of_one_document_are_drawn_by_number(spark):
    rows = [(7, "a", 10)] * 400 + [(i, "a", 7) for i in range(100, 900)]
    for total in (333, 4_004, 9_599):
        draws, report = drawn(spark, rows, targets=[("a", 1.0, 1)], total=total)
        assert report["a"].drawn_tokens == sum(r.n_tokens * r.times * r.copies for r in draws) and report["a"].apart_tokens <= 5
        assert all(r.copies <= (400 if r.doc_id == 7 else 1) for r in draws)


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 6)), max_size=6), st.integers(0, 200))
def test_nearest_sum(items, target):
    sizes, copies = [n for n, _ in items], [c for _, c in items]
    take, sums = nearest_sum(sizes, copies, target), {0}
    for n, c in items:
        sums = {x + n * k for x in sums for k in range(c + 1)}
    assert all(0 <= k <= c for k, c in zip(take, copies))
    assert abs(sum(n * k for n, k in zip(sizes, take)) - target) == min(abs(x - target) for x in sums)


def test_levels_are_the_same_over_a_table(spark):
    rng = random.Random(9)
    for total in (0.0, 50.0, 400.0, 1e6):
        rows = [(f"s{i}", rng.choice([0.0, 0.01, rng.random()]), rng.choice([0.0, 5.0, 100.0 * rng.random()])) for i in range(40)]
        want = water_fill({s: w for s, w, _ in rows}, {s: c for s, _, c in rows}, total)
        got = {r.source: r.want for r in water_levels(spark.createDataFrame(rows, "source string, share double, cap double"), total).collect()}
        assert got == pytest.approx(want, abs=1e-6)


def test_drawn_documents_carry_the_shares(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", 10) for i in range(300)], "id long, s string, n long")
    draws, plan = draw_mixture(df, "id", F.col("s"), "n", spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int"))
    out = with_shares(draws, mixture_report(draws, plan)).collect()
    assert {(r.source, r.actual_share) for r in out} == {("a", 0.666667), ("b", 0.333333)} and len(out) == 300


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 5), (3, "", 5), (4, "a" * 100_000, 5)], "id long, text string, n_tokens int")
    got = {r.id: r.n_tokens for r in token_counts(df, "text").collect()}
    assert got[1] == 2 and got[2] is None and got[3] == 0 and got[4] == len(tokens.encoding().encode_ordinary("a" * 100_000))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Sentence ends. ", "para\n\n", "line\r\n", "## Head\n", "日本。", "👩‍👩‍👧", "x" * 50, "under_scored_", "GBP 1,301.25; ", "é"]), max_size=150).map("".join), st.integers(1, 60), st.integers(0, 30))
def test_pieces_of_any_text(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(text[w:e] for _, w, e, _ in pieces) == text
    for k, (s, w, e, n) in enumerate(pieces):
        assert s <= w < e and n == tokens.count(text[s:e]) and (n <= limit or e - s == 1)
        if k:
            assert s >= pieces[k - 1][0] and w == pieces[k - 1][2]
            assert tokens.count(text[s:w]) <= min(overlap, limit - 1) if s < w else True


def test_counting_in_stretches():
    text = "The quick brown fox, 12 jumps.\n\n" * 3000 + "日本 word " * 2000
    assert tokens.count(text) == len(tokens.encoding().encode_ordinary(text))


def test_cuts_are_where_the_text_pauses():
    text = "\n\n".join("This is sentence one. Here is another one. " * 3 for _ in range(30)).strip()
    ends = [text[:e] for _, _, e, _ in split_text(text, 64, 8)][:-1]
    assert all(t.endswith("\n\n") for t in ends)
    one = "This is a sentence of the text. " * 60
    assert all(one[:e].endswith(".") for _, _, e, _ in split_text(one.strip(), 64, 8))


def test_split_oversized(spark):
    rows = [(1, "word " * 500, "a b"), (2, "short", "A-B"), (3, None, "a_b"), (4, "", "a_b"), (5, "word " * 500, "zz"), (6, "word " * 500, None), (7, "y" * 200_000, "a_b"), (1, "word " * 500, "a_b")]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, source string, piece int, `end` int")
    limits = spark.createDataFrame([("a_b", 100, 10), ("none", None, 1)], "source string, max_tokens int, overlap_tokens int")
    got = split_oversized(df, "doc_id", "text", source_name(F.col("source")), limits).collect()
    assert {r.doc_id for r in got} == {1, 7} and all(r.n_tokens <= 100 for r in got)
    for i in (1, 7):
        full = next(t for d, t, _ in rows if d == i)
        assert all(full[r.start : r.end] == r.text for r in got if r.doc_id == i)
    assert "".join(r.text[r.new_start - r.start :] for r in sorted(got, key=lambda r: r.piece) if r.doc_id == 7) == "y" * 200_000
    assert sum(r.piece == 1 for r in got if r.doc_id == 1) == 2
    assert split_oversized(df.limit(0), "doc_id", "text", source_name(F.col("source")), limits).count() == 0


def test_the_tokenizer_is_a_parameter(spark):
    other = tokens.DEFAULT.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    df = spark.createDataFrame([(1, "Überprüfung der Rechnung, 日本語の契約。")], "id long, text string")
    counts = [token_counts(df, "text", tokenizer=t).first().n_tokens for t in (tokens.DEFAULT, other)]
    assert counts == [tokens.count("Überprüfung der Rechnung, 日本語の契約。", t) for t in (tokens.DEFAULT, other)] and counts[0] != counts[1]

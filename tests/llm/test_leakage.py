import random
from itertools import combinations, product

import pytest

from ledgerloom.llm import leakage
from ledgerloom.llm.leakage import Passages, leaked_passages, words_of

WORDS = [f"w{i}" for i in range(400)]


def passage(rng, n=60):
    return [rng.choice(WORDS) for _ in range(n)]


def spoil(rng, words, edits):
    out = list(words)
    for p in sorted(rng.sample(range(1, len(words) - 1), edits), reverse=True):
        if rng.random() < 0.5:
            out[p] = f"other{rng.randrange(10**6)}"
        else:
            out.insert(p, f"more{rng.randrange(10**6)}")
    return out


@pytest.mark.parametrize("seed", range(40))
def test_every_stretch_within_the_tolerance_is_found(seed):
    rng = random.Random(seed)
    items = [passage(rng) for _ in range(20)]
    p = Passages([(i, " ".join(x)) for i, x in enumerate(items)])
    for _ in range(30):
        k, n = rng.randrange(20), rng.randrange(20, 45)
        at = rng.randrange(60 - n)
        text = [f"t{rng.randrange(9)}" for _ in range(rng.randrange(30))] + spoil(rng, items[k][at : at + n], rng.randrange(n // 10 + 1)) + ["end"] * 5
        assert k in p.found(" ".join(text))


def test_worst_places_of_two_edits():
    item = [f"a{i}" for i in range(20)]
    p = Passages([(1, " ".join(item))])
    for i in range(1, 19):
        for j in range(i + 1, 19):
            for a in ("replace", "add"):
                for b in ("replace", "add"):
                    t = list(item)
                    for place, kind in ((j, b), (i, a)):
                        if kind == "replace":
                            t[place] = "zz"
                        else:
                            t.insert(place, "zz")
                    assert p.found("x y " + " ".join(t) + " z") == {1: 20}, (i, j, a, b)


def test_short_quotations_and_chance_are_none():
    rng = random.Random(1)
    item = passage(rng)
    p = Passages([(1, " ".join(item))])
    assert not p.found(" ".join(["x"] * 9 + item[10:29] + ["y"] * 9))
    assert not p.found(" ".join(item[10:20] + ["y"] * 3 + item[20:30]))
    assert not p.found(" ".join(rng.choice(WORDS) for _ in range(3000)))
    assert p.found(" ".join(["x"] * 9 + item[10:30])) == {1: 20}


def test_layout_case_and_punctuation_do_not_matter(spark):
    rng = random.Random(2)
    item = passage(rng)
    s = " ".join(item[5:30])
    forms = [s.upper(), s.replace(" ", "\r\n"), s.replace(" ", ",  \t"), "* " + s.replace(" ", " — ") + "!", s.replace(" ", "_"), "“" + s.title() + "”"]
    docs = spark.createDataFrame([(i, f, 1, "z") for i, f in enumerate([*forms, None, "", " ", "a " * 300_000 + s, "nothing"])] + [(0, s, 1, "z")], "doc_id long, text string, item_id int, words string")
    items = spark.createDataFrame([(7, " ".join(item), 1), (8, None, 1), (9, "", 1), (10, " ".join(item), 1)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.words) for r in leaked_passages(docs, "doc_id", "text", items, "item_id", "text").collect())
    assert got == sorted([(i, k, 25) for i in (*range(len(forms)), len(forms) + 3, 0) for k in (7, 10)])
    in_blocks = sorted((r.doc_id, r.item_id, r.words) for r in leaked_passages(docs, "doc_id", "text", items, "item_id", "text", block_words=10).collect())
    assert in_blocks == got
    assert leaked_passages(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaked_passages(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_words():
    assert words_of("A b-c, (D) -- e_f GBP 1,347.20") == ["a", "bc", "d", "e", "f", "gbp", "134720"]
    assert all("0" in m and m[0] == m[-1] == "1" for m in leakage.MASKS)  # each ignores a position


def test_all_places_of_three_edits_in_30_to_33_words():
    # Each length has every place of three edits, replaced words and, for the shortest, added ones too.
    for n in range(30, 34):
        item = [f"a{i}" for i in range(n)]
        p = Passages([(1, " ".join(item))])
        for places in combinations(range(1, n - 1), 3):
            for kinds in product((True, False), repeat=3) if n == 30 else ((True,) * 3,):
                t = list(item)
                for at, replaced in zip(reversed(places), kinds):
                    t[at : at + replaced] = ["zz"]
                assert p.found("x " + " ".join(t) + " y") == {1: n}, (n, places, kinds)


@pytest.mark.parametrize("edits", (4, 5, 6, 7))
def test_edits_close_together_in_longer_stretches(edits):
    rng = random.Random(edits)
    for _ in range(500):
        n = edits * 10 + rng.randrange(10)
        item = [f"a{i}" for i in range(n)]
        p = Passages([(1, " ".join(item))])
        # Edits in one or two groups of neighbouring words, or in any places.
        groups = rng.randrange(3)
        starts = [rng.randrange(1, n - 2 * edits) for _ in range(groups)] or [1]
        pool = [x for x in {s + k for s in starts for k in range(2 * edits)} if 0 < x < n - 1] if groups else range(1, n - 1)
        t = list(item)
        for at in sorted(rng.sample(sorted(pool), edits), reverse=True):
            t[at : at + rng.randrange(2)] = ["zz"]
        assert p.found("x " + " ".join(t) + " y") == {1: n}, t


def test_a_hit_is_followed_as_if_none_were_left_out(monkeypatch):
    rng = random.Random(5)
    item = [f"a{i}" for i in range(90)]
    p = Passages([(1, " ".join(item))])
    texts = [" ".join(w if rng.random() > share else "zz" for w in item) for share in (0.05, 0.1, 0.15, 0.2, 0.25, 0.3) for _ in range(100)]
    got = [p.found(t) for t in texts]
    monkeypatch.setattr(leakage, "NEAR", 90)
    assert got == [p.found(t) for t in texts] and 100 < sum(map(bool, got)) < 590

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import canonical
from ledgerloom.llm.canonical import Vocabulary, choose, map_to_list, prefix_join, skeleton_sets, words_of

LIST = ["Rapid Allergy Nutrition Review", "Remote Sleep Cast Removal", "Remote Neonatal Cast Removal", "Urgent Spinal Laser Sitting", "Guided Dental Splint Fitting", "Complex Audiology Gait Assessment"]
READ = {
    "RAPID  ALLERGY\tNUTRITION REVIEW": 0,
    "Rápid Allergy Nutrition Review*": 0,
    "[48] Rapid Allergy Niitrition Review x5": 0,
    "Rpd Allrgy Ntrtn Rvw": 0,
    "Rapi Aller Nutri Rev": 0,
    "Nutrition Review - Allergy - Rapid": 0,
    "RapidAllergyNutritionReview": 0,
    "charge for Rapid Allergy Nutriton Reveiw (amended)": 0,
    "RAPIDALLERGY NUTRITION REVIEW": 0,
    "Allergy Review": 0,
    "rcmotc slccp cast rcmoval": 1,
    "Remote Neonatal Removal": 2,
    "Neoriatal Cast Removal / session 68": 2,
    "Urgent Spinal Laser Sitt": 3,
    "re Remote Sleep Cast Removal.": 1,
    "re Rem0te Sleep Cast Remo": 1,
    "re RAPID ALLERGY NUTRITION REVIEW, as agreed": 0,
    "Complex Audi Gait Ass": 5,
    "Cmplx Adlgy Gt Assssmnt": 5,
}
UNREAD = ["Remote Cast Removal", "Urgent Sleep Cast Removal", "urgent dental laser sitting", "Car park permit 16", "TBC", "???", "", " ", "key deposit", "x5", "do not use 99", "Remote"]


@pytest.fixture(scope="module")
def mapped(spark):
    values = [("h1", v) for v in [*READ, *UNREAD, None, LIST[0]]] + [("h2", "Rapid Allergy Review"), (None, "Rapid Allergy Review"), ("h1", "Rapid Allergy Nutrition Review " + "and more " * 20_000)] * 2
    v = spark.createDataFrame([(*x, 1, "z") for x in values], "c string, d string, vid int, toks string")
    e = spark.createDataFrame([("h1", s, 1) for s in LIST] + [("h1", LIST[0], 2), ("h1", None, 3), (None, "x", 4)], "c string, s string, eid int")
    return {(r.block, r.value): (r.match, r.confidence) for r in map_to_list(v, "c", "d", e, "c", "s").collect()}


@pytest.mark.parametrize("text", READ)
def test_wordings_are_read(mapped, text):
    assert mapped["h1", text][0] == LIST[READ[text]]


@pytest.mark.parametrize("text", UNREAD)
def test_others_are_unmatched(mapped, text):
    assert mapped["h1", text][0] is None


def test_keys_of_the_mapping(mapped):
    assert ("h1", LIST[0]) not in mapped and ("h1", None) not in mapped and all(b for b, _ in mapped)
    assert mapped["h2", "Rapid Allergy Review"][0] is None
    assert len(mapped) == len(READ) + len(UNREAD) + 2


def test_empty_tables(spark):
    v = spark.createDataFrame([("h", "a b")], "c string, d string")
    e = spark.createDataFrame([("h", "a b c")], "c string, s string")
    assert [r.match for r in map_to_list(v, "c", "d", e.limit(0), "c", "s").collect()] == [None]
    assert map_to_list(v.limit(0), "c", "d", e, "c", "s").count() == 0


@pytest.mark.parametrize("t", [0.25, 0.5, 0.8, 1.0])
def test_prefix_join_equals_all_pairs(spark, t):
    rng = random.Random(3)
    sets = lambda n, k: [(i, rng.choice("xy"), sorted({rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, k))})) for i in range(n)]
    vs, es = sets(200, 12), sets(60, 9)
    want = {}
    for i, b, x in vs:
        for j, c, y in es:
            if b == c and x and y and len({*x} & {*y}) / len({*x} | {*y}) >= t:
                want[i, j] = len({*x} & {*y}) / len({*x} | {*y})
    df = lambda rows, key: spark.createDataFrame([(b, i, x) for i, b, x in rows], f"block string, {key} long, toks array<string>")
    got = {(r.vid, r.eid): r.jaccard for r in prefix_join(df(vs, "vid"), df(es, "eid"), t).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_candidates_lose_no_reading(spark):
    """What is read among the candidates is what is read among all entries."""
    rng = random.Random(8)
    vocabulary = Vocabulary([w for s in LIST for w in words_of(s)])

    def spoil(s):
        words = s.split()
        if rng.random() < 0.3:
            words.pop(rng.randrange(len(words)))
        out = []
        for w in words:
            k = rng.randrange(5)
            i = rng.randrange(1, len(w) - 1)
            out.append([w, w[: max(3, len(w) - 3)], w[:i] + w[i + 1 :], w[0] + "".join(c for c in w[1:] if c not in "aeiou"), w[:i] + rng.choice("aeiorst") + w[i + 1 :]][k])
        return " ".join(out)

    values = sorted({spoil(rng.choice(LIST)) for _ in range(400)})
    df = spark.createDataFrame([("h", v) for v in values], "c string, d string")
    got = {r.value: r.match for r in map_to_list(df, "c", "d", spark.createDataFrame([("h", s) for s in LIST], "c string, s string"), "c", "s").collect()}
    everything = [(s, tuple(words_of(s)), 0.0) for s in LIST]
    want = {v: choose(v, everything, vocabulary)[0] for v in values if v not in LIST}
    assert got == want and sum(m is not None for m in want.values()) > 0.8 * len(want)


def test_skeletons(spark):
    got = spark.createDataFrame([("Gáit Study",), ("",), (None,)], "s string").select(skeleton_sets(F.col("s")).alias("t")).collect()
    assert got[0].t == sorted({"^g", "gt", "^s", "st", "td", "dy"}) and got[1].t == [] and got[2].t is None
    assert canonical.MIN_JACCARD == 0.25


def test_lists_of_any_length_are_read_in_blocks(spark, monkeypatch):
    from ledgerloom.llm import canonical

    rng = random.Random(11)
    names = [" ".join(rng.sample(["Rapid", "Spinal", "Gait", "Study", "Thermal", "Graft", "Removal", "Podiatric", "Swallow", "Review", "Biopsy", "Sampling"], 3)) for _ in range(40)]
    typed = [rng.choice(names) for _ in range(120)]
    typed = [t.lower() if i % 3 == 0 else t.replace("a", "", 1) if i % 3 == 1 else " ".join(t.split()[::-1]) for i, t in enumerate(typed)] + ["Xylophone", "", "12"]
    v = spark.createDataFrame([(rng.choice("ab"), t) for t in typed], "b string, v string")
    e = spark.createDataFrame([(b, n) for b in "ab" for n in names], "b string, e string")
    run = lambda: sorted(map(tuple, map_to_list(v, "b", "v", e, "b", "e").collect()), key=str)
    want = run()
    monkeypatch.setattr(canonical, "MAX_LIST_WORDS", 4)
    assert run() == want and sum(m is not None for _, _, m, _ in want) > 60


def test_a_single_word_names_an_entry_if_nothing_else_fits(spark):
    e = spark.createDataFrame([("a", "Planned Lactation Gait Assessment"), ("a", "Rapid Spinal Gait Study"), ("a", "Rapid Dental Cast Removal")], "b string, e string")
    v = spark.createDataFrame([("a", "lactation"), ("a", "gait"), ("a", "Lactatin"), ("a", "dental rapid"), ("a", "lactation dental")], "b string, v string")
    got = {r.value: r.match for r in map_to_list(v, "b", "v", e, "b", "e", 0.1).collect()}
    assert got == {"lactation": "Planned Lactation Gait Assessment", "gait": None, "Lactatin": None, "dental rapid": "Rapid Dental Cast Removal", "lactation dental": None}

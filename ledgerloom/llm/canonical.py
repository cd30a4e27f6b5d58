"""Mapping free-entered values to a canonical list.

Two stages. The first is a prefix-filter set-similarity join within blocks (here: contracts): a value's set holds the
letter pairs of the consonant skeletons of its words, which survive typing errors in vowels, dropped vowels, cut words
and changed order. Sets are ordered by global rarity; only the rare prefixes that any pair above the threshold must
share are joined, with length and positional filters, and Jaccard is then computed exactly on the candidates.

The second stage reads each value against its candidates word by word: every word of the value that resembles a word used
anywhere in the list must stand for a word of the entry (as it is, mistyped, misread, cut short, without vowels or run
together), else the entry is out; words that resemble nothing in the list are trimmings. Of the entries left the best by
the exact Jaccard similarity of the words so read is kept, then the one read at the least cost. An entry may have words
the value leaves out, if no other entry of the block fits as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.bounded import lookup_join
from ledgerloom.session import ship_package, written

#: Jaccard of skeleton pairs from which an entry is a candidate.
MIN_JACCARD = 0.25
#: Different words of the list that are sent to the executors at a time (about 60 bytes each); longer lists are read in blocks.
MAX_LIST_WORDS = 200_000

#: Marked letters and the plain letters they are read as.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"
#: Letters that look alike in print, as read by a scanner (first) and as meant (second).
LOOKALIKES = (("0", "o"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("ri", "n"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("l", "i"), ("c", "e"))


def skeleton_sets(value: Column) -> Column:
    """The sorted set of letter pairs of the consonant skeletons of a value's words, each word with a mark in front."""
    s = F.lower(value)
    s = F.translate(s, MARKED + "015698", PLAIN + "oisbgb")
    s = F.regexp_replace(s, "[^a-z]+", " ")
    s = F.regexp_replace(s, "(?<=[a-z])[aeiou]", "")
    s = F.regexp_replace(s, "([a-z])\\1+", "$1")
    words = F.filter(F.split(s, " "), lambda w: w != "")
    pairs = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("^"), w), i, F.lit(2)))))
    return F.array_sort(F.array_distinct(pairs))


def prefix_join(values: DataFrame, entries: DataFrame, min_jaccard: float) -> DataFrame:
    """(vid, eid, jaccard): the pairs of one block whose sets have at least that Jaccard similarity.

    values: (block, vid, toks), entries: (block, eid, toks); toks are sets, vid and eid unique numbers. Both sides are
    ordered by global rarity of the tokens in the list (tokens of values that the list lacks come first: they are rarest
    of all and match nothing), and joined on (block, token) of their prefixes. Empty sets match nothing. All steps on
    pairs are keyed by vid first, so the values are shuffled by it once.
    """
    t = min_jaccard
    df = entries.select(F.explode("toks").alias("tok")).groupBy("tok").count()

    def prefixes(d: DataFrame, key: str, n: str, pos: str) -> DataFrame:
        # (count, token) is a global order without a global sort.
        o = (
            d.select("block", key, F.explode("toks").alias("tok"))
            .transform(lambda x: lookup_join(x, df, ["tok"], "left", [key]))
            .groupBy(key)
            .agg(F.first("block").alias("block"), F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "tok"))).alias("o"))
        )
        size = F.size("o")
        return o.select("block", key, size.alias(n), F.posexplode(F.slice("o", F.lit(1), (size - F.ceil(size * t) + 1).cast("int"))).alias(pos, "x")).where("x.c > 0").select("block", key, n, pos, F.col("x.tok").alias("tok"))

    pairs = lookup_join(prefixes(values, "vid", "vn", "vpos"), prefixes(entries, "eid", "en", "epos"), ["block", "tok"], salt_of=["vid"])
    # Length filter, then positional filter: the tokens from this one on must still allow the overlap needed.
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("vn") + F.col("en")))
    pairs = pairs.where((F.col("en") >= F.col("vn") * t) & (F.col("vn") >= F.col("en") * t))
    # The first common token of a pair has the smallest position on both sides, so one row per pair decides.
    pairs = pairs.groupBy("vid", "eid").agg(F.first("vn").alias("vn"), F.first("en").alias("en"), F.min("vpos").alias("vpos"), F.min("epos").alias("epos"))
    pairs = pairs.where(1 + F.least(F.col("vn") - F.col("vpos") - 1, F.col("en") - F.col("epos") - 1) >= need)
    exact = pairs.join(values.select("vid", F.col("toks").alias("vtoks")), "vid")
    exact = lookup_join(exact, entries.select("eid", F.col("toks").alias("etoks")), ["eid"], salt_of=["vid"])
    common = F.size(F.array_intersect("vtoks", "etoks"))
    return exact.select("vid", "eid", (common / (F.col("vn") + F.col("en") - common)).alias("jaccard")).where(F.col("jaccard") >= t)


# ---------------------------------------------------------------------------------------------------------------------
# Reading a value against its candidates, in Python over Arrow batches.


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def words_of(value: str) -> list[str]:
    """The words of a value: lower case, without marks, split at blanks, punctuation and inner capitals; counts and codes go."""
    s = _plain(value)
    if not s.isupper() and re.search("[a-z][A-Z]", s) and not s.swapcase().istitle():
        s = re.sub("(?<=[a-z])(?=[A-Z][a-z])", " ", s)
    out = []
    for w in re.findall("[a-z0-9']+", s.lower()):
        w = w.replace("'", "")
        letters = sum(c.isalpha() for c in w)
        if letters >= 2 and letters >= len(w) - letters and not re.fullmatch(r"x\d+|\d+[a-z]{0,2}", w):
            out.append(w)
    return out


def _skeleton(w: str) -> str:
    s = w[:1] + re.sub("[aeiou]", "", w[1:])
    return re.sub(r"(.)\1+", r"\1", s)


def _lookalike(w: str) -> str:
    for a, b in LOOKALIKES:
        w = w.replace(a, b)
    return w


def _distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) from a to b, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _edits(n: int) -> int:
    """Edits allowed in a word of n letters."""
    return 0 if n < 4 else 1 if n < 6 else 2 if n < 10 else 3


def word_cost(w: str, target: str) -> float | None:
    """What it costs to read w as target: 0 as it is, under 1 cut short or without vowels, then by edits; None: it isn't."""
    if w == target:
        return 0.0
    if len(w) >= 2 and target.startswith(w):
        return 0.3
    sk, tk = _skeleton(w), _skeleton(target)
    bare = not re.search("[aeiou]", w[1:])
    if bare and len(sk) >= 2 and sk == tk:
        return 0.2
    a, b = _lookalike(w), _lookalike(target)
    if a == b:
        return 0.4
    most = _edits(min(len(w), len(target)))
    d = min(_distance(w, target, most), _distance(a, b, most) + 0.5) if most else 9
    if d <= most:
        return float(d)
    if len(w) >= 5 and len(w) < len(target) and _distance(w, target[: len(w)], 1) <= 1:
        return 1.3
    if len(w) >= 4 and len(w) < len(target) and b.startswith(a):
        return 0.7
    if bare and len(sk) >= 4 and _distance(sk, tk, 1) <= 1:
        return 1.4
    if bare and len(sk) >= 3 and len(tk) > len(sk) and tk.startswith(sk):
        return 0.8
    return None


class Vocabulary:
    """The words of the list, found through the letter pairs that they share with a word (rare pairs first)."""

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        self.by_pair: dict[str, list[str]] = {}
        for w in self.words:
            for p in {f"^{w[0]}", *(w[i : i + 2] for i in range(len(w) - 1)), *(f"~{x}" for x in self._pairs(_skeleton(w)))}:
                self.by_pair.setdefault(p, []).append(w)
        self.best = lru_cache(200_000)(self._best)

    @staticmethod
    def _pairs(s: str) -> set[str]:
        return {s[i : i + 2] for i in range(len(s) - 1)}

    def _best(self, w: str) -> tuple[tuple[str, float], ...]:
        """The list's words that w may stand for, with costs, cheapest first."""
        pairs = {f"^{w[0]}", *self._pairs(w), *self._pairs(_lookalike(w)), *(f"~{x}" for x in self._pairs(_skeleton(w)))}
        near = {x for p in pairs for x in self.by_pair.get(p, ())}
        found = [(x, c) for x in near if (c := word_cost(w, x)) is not None]
        return tuple(sorted(found, key=lambda f: (f[1], f[0])))


class Near:
    """The list's words that each of some words may stand for, worked out before."""

    def __init__(self, words: dict[str, tuple[tuple[str, float], ...]]):
        self.words = words

    def best(self, w: str) -> tuple[tuple[str, float], ...]:
        return self.words.get(w, ())


def _runs(entry: tuple[str, ...]) -> dict[str, tuple[int, ...]]:
    """The entry's neighbouring words written as one."""
    return {"".join(entry[i:j]): tuple(range(i, j)) for i in range(len(entry)) for j in range(i + 2, len(entry) + 1)}


def _sureness(x: tuple[tuple[tuple[str, float], ...], str]) -> tuple[int, float, int]:
    """Order of reading: words and mistyped words, then beginnings of words, the longest first, so that a stray "re"
    doesn't take the place of "removal"; what stands for nothing comes last."""
    best, w = x
    if not best:
        return 2, 0.0, 0
    return int(w != best[0][0] and best[0][0].startswith(w)), best[0][1], -len(w)


def fit(words: tuple[str, ...], entry: tuple[str, ...], vocabulary: Vocabulary | Near, slack: float = 0.0) -> tuple[int, float] | None:
    """(words of the entry that are named, cost), or None if some word of the value speaks against the entry."""
    free, cost, named = set(range(len(entry))), 0.0, 0
    runs = None
    for best, w in sorted(((vocabulary.best(w), w) for w in words), key=_sureness):
        own = [(c, i) for x, c in best for i in free if entry[i] == x]
        if own:
            c, i = min(own)
            if c > best[0][1] + slack:
                return None
            free.discard(i)
            cost, named = cost + c, named + 1
            continue
        if len(w) >= 7:
            runs = _runs(entry) if runs is None else runs
            glued = []
            for r, places in runs.items():
                if free.issuperset(places):
                    most = max(2, len(r) // 6)
                    d = _distance(w, r, most)
                    if d <= most:
                        glued.append((d, places))
                    elif r.startswith(w) and len(w) > len(entry[places[0]]) + 2 and len(places) == 2:
                        glued.append((0.3, places))
                    elif _skeleton(w) == _skeleton(r):
                        glued.append((0.2, places))
            if glued and (not best or min(glued)[0] < best[0][1] + 1):
                d, places = min(glued)
                free -= set(places)
                cost, named = cost + d * 0.5, named + len(places)
                continue
        if best and best[0][1] < 2 and len(w) > 3:
            return None  # it means another word of the list
        if best and best[0][1] == 0:
            return None
        cost += 0.05
    return (named, cost) if named else None


def choose(value: str, candidates: list[tuple[str, tuple[str, ...], float]], vocabulary: Vocabulary | Near) -> tuple[str | None, float]:
    """The candidate that the value stands for with a confidence, or (None, confidence that it is none)."""
    words = tuple(words_of(value))
    if not words:
        return None, 0.9
    scored = []
    for name, entry, jaccard in candidates:
        f = fit(words, entry, vocabulary)
        if f:
            # All words that count are read as words of the entry, so these are the union and the words named are what both have.
            scored.append((-f[0] / len(entry), f[1], -jaccard, name, len(entry), f[0]))
    if not scored:
        return None, 0.9
    scored.sort()
    best = scored[0]
    rivals = [s for s in scored[1:] if s[0] == best[0] and s[1] <= best[1] + 0.01]
    if rivals:
        return None, 0.4
    # Less than half of an entry's words name it only if nothing else fits and they are written as in the list.
    if best[5] * 2 < best[4] and (len(scored) > 1 or best[1] > 0.05 * len(words)):
        return None, 0.9
    left_out = best[4] - best[5]
    return best[3], round(max(0.5, 0.98 - 0.06 * left_out - 0.04 * min(best[1], 5.0)), 3)


def map_to_list(values: DataFrame, block: str, value: str, entries: DataFrame, entry_block: str, entry: str, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """(block, value, match, confidence): one row per different (block, value) that isn't exactly an entry of its block.

    `match` is null for values that stand for no entry, or for several equally well. Null values or blocks give no rows; blank
    values, values without letters and blocks without entries are unmatched. An empty list leaves every value unmatched.
    Other columns of the tables, whatever their names, are not touched. Sizes: the list's different words (not its rows)
    are sent to the executors, MAX_LIST_WORDS at a time; a longer list is read in as many blocks.
    """
    e = entries.select(F.col(entry_block).alias("block"), F.col(entry).alias("entry")).where("block is not null and entry is not null").distinct()
    v = values.select(F.col(block).alias("block"), F.col(value).alias("value")).where("block is not null and value is not null").distinct()
    v = lookup_join(v, e.withColumnRenamed("entry", "value"), ["block", "value"], "left_anti")
    # The different values are few beside the rows; written once, they keep their numbers and the rows are read once.
    number = F.monotonically_increasing_id()
    v = written(v.select("block", "value", number.alias("vid"), skeleton_sets(F.col("value")).alias("toks")), "values")
    e = written(e.select("block", "entry", number.alias("eid"), skeleton_sets(F.col("entry")).alias("toks")), "entries")
    pairs = prefix_join(v.select("block", "vid", "toks"), e.select("block", "eid", "toks"), min_jaccard)
    named = lookup_join(pairs, e.select("eid", "entry"), ["eid"], salt_of=["vid"])
    grouped = named.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("jaccard", "entry")), asc=False).alias("candidates"))
    read = v.select("block", "value", "vid").join(grouped, "vid", "left")

    plain = F.translate(F.lower("entry"), MARKED, PLAIN)
    listed = e.select(F.explode(F.split(plain, "[^a-z0-9]+")).alias("w")).where("length(w) >= 2").distinct()
    number = listed.count()
    blocks = max(1, -(-number // MAX_LIST_WORDS))
    sc = e.sparkSession.sparkContext
    ship_package(e.sparkSession)
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("value", T.StringType()), T.StructField("match", T.StringType()), T.StructField("confidence", T.DoubleType())])
    if blocks == 1:
        shared = sc.broadcast([r.w for r in listed.collect()])
    else:
        read, shared = read.join(_near_words(v, written(listed, "listed"), blocks), "vid", "left"), None

    def read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(shared.value) if shared is not None else None
        split = lru_cache(100_000)(lambda s: tuple(words_of(s)))
        for b in batches:
            near = b["near"] if "near" in b else [None] * len(b)
            out = [
                choose(x, [(c["entry"], split(c["entry"]), c["jaccard"]) for c in (cs if cs is not None else ())], vocabulary or Near({w["w"]: tuple((y["x"], y["cost"]) for y in w["best"]) for w in (ws if ws is not None else ())}))
                for x, cs, ws in zip(b["value"], b["candidates"], near)
            ]
            yield pd.DataFrame({"block": b["block"], "value": b["value"], "match": [m for m, _ in out], "confidence": [c for _, c in out]})

    return read.drop("vid").mapInPandas(read_batches, schema)


def _near_words(values: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """(vid, near): for each value its words that may stand for words of the list, with these and what it costs.

    The different words of the values are held against the list's words, one block of these after the other.
    """
    sc = values.sparkSession.sparkContext

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, w) for i, x in zip(b["vid"], b["value"]) for w in dict.fromkeys(words_of(x))]
            yield pd.DataFrame(rows, columns=["vid", "w"])

    words = written(values.select("vid", "value").mapInPandas(split, "vid long, w string"), "words")
    different, near = written(words.select("w").distinct(), "different"), None
    for k in range(blocks):
        shared = sc.broadcast([r.w for r in listed.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == k).collect()])

        def look(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            vocabulary = Vocabulary(shared.value)
            for b in batches:
                yield pd.DataFrame([(w, x, c) for w in b["w"] for x, c in vocabulary.best(w)], columns=["w", "x", "cost"])

        part = different.mapInPandas(look, "w string, x string, cost double")
        near = part if near is None else near.unionByName(part)
    best = near.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("cost", "x"))).alias("best"))
    found = lookup_join(words, written(best, "near"), ["w"], "inner", ["vid"])
    return found.groupBy("vid").agg(F.collect_list(F.struct("w", "best")).alias("near"))

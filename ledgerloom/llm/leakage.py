"""Held-out passages that got into a corpus, found by spaced-seed hashing.

A seed is a fixed mask over neighbouring words; a 0 in it is a word that is ignored. The mask hits every stretch of 20
words or more in which at most one word in ten is replaced or added: the edits leave seven neighbouring words as they are
somewhere, except two replaced words that leave six before, between and after them, and there the mask lies across a
replaced word. Seeds of the passages are joined with those of every word position of the corpus, and around each hit the
longest stretch within the tolerance is worked out exactly.

The corpus isn't shuffled: the seeds of the passages go to the executors in blocks of a checked size, and a corpus
is read once per block. Documents are handled one at a time, so a hot source or a long text changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import ship_package

#: The masks. Completeness as said above holds for at least MIN_WORDS words and one edit in PER_EDIT.
MASKS = ("1110111",)
MIN_WORDS, PER_EDIT = 20, 10
#: Every stretch within the tolerance holds one with at most so many edits. Cut at neighbouring edits, it leaves two
#: parts of which one is within the tolerance, and long enough if it has two edits. So a stretch that holds no smaller one
#: has no edits with two or more on either side, and less than MIN_WORDS words on either side of some: fewer than 50 in all.
NEAR = 4
#: Words of passages that go to the executors at a time (about 60 bytes each with their seeds).
MAX_BLOCK_WORDS = 1_000_000
#: Different words of documents whose numbers a worker remembers at a time; only speed depends on it.
MAX_KNOWN = 500_000


def words_of(text: str) -> list[str]:
    """The words between blanks or line ends, in one case and without punctuation; what has no letter or digit is none.

    Underscores count as blanks, as some texts are laid out with them.
    """
    return [w for raw in _pieces(text) if (w := _word(raw))]


def _pieces(text: str) -> list[str]:
    return (text.replace("_", " ") if "_" in text else text).split()


def _word(raw: str) -> str:
    return (raw if raw.isalnum() else "".join(c for c in raw if c.isalnum())).casefold()


class Passages:
    """Passages as word numbers, and their seeds sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...] = MASKS):
        self.ids: list[int] = []
        self.texts: list[list[int]] = []
        self.number: dict[str, int] = {}
        for item, text in items:
            self.ids.append(item)
            self.texts.append([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)])
        rng = np.random.default_rng(20)
        self.masks = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in masks]
        self.factors = [rng.integers(1, 2**63, len(m), dtype=np.uint64) | np.uint64(1) for m in self.masks]
        self.seeds = []
        for m, f in zip(self.masks, self.factors):
            parts = [(np.full(max(0, len(t) - m[-1]), k, np.int32), np.arange(max(0, len(t) - m[-1]), dtype=np.int32), self._hash(np.array(t, np.uint64), m, f)) for k, t in enumerate(self.texts)]
            which, at, h = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts)) if parts else (np.zeros(0, np.int32),) * 3
            order = np.argsort(h, kind="stable")
            self.seeds.append((h[order], which[order], at[order]))
        self.known: dict[str, int] = {}

    @staticmethod
    def _hash(t: np.ndarray, mask: np.ndarray, factors: np.ndarray) -> np.ndarray:
        n = max(0, len(t) - int(mask[-1]))
        h = np.zeros(n, np.uint64)
        for o, f in zip(mask, factors):
            h ^= (t[o : o + n] + np.uint64(0x9E3779B9)) * f
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return h

    def numbers(self, text: str) -> list[int]:
        """A document's words as numbers of the passages' words, 0 for others."""
        known, out = self.known, []
        for raw in _pieces(text):
            n = known.get(raw)
            if n is None:
                w = _word(raw)
                n = self.number.get(w, 0) if w else -1
                if len(known) > MAX_KNOWN:
                    known.clear()
                known[raw] = n
            if n >= 0:
                out.append(n)
        return out

    def hits(self, doc: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(passage, place in it, place in the document, length) of the seeds that both have."""
        found = set()
        for m, f, (h, which, at) in zip(self.masks, self.factors, self.seeds):
            n = len(doc) - int(m[-1])
            if n <= 0 or not len(h):
                continue
            full = np.ones(n, bool)
            for o in m:
                full &= doc[o : o + n] > 0
            places = np.flatnonzero(full)
            if not len(places):
                continue
            mine = self._hash(doc.astype(np.uint64), m, f)[places]
            lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            for i in np.flatnonzero(hi > lo):
                for j in range(lo[i], hi[i]):
                    found.add((int(which[j]), int(at[j]), int(places[i]), int(m[-1]) + 1))
        return found

    def found(self, text: str) -> dict[int, int]:
        """The passages that the text holds, with the length of the longest stretch in words."""
        doc = self.numbers(text)
        best: dict[int, int] = {}
        done: dict[tuple[int, int], int] = {}
        for k, j, i, _ in sorted(self.hits(np.array(doc, np.int64)), key=lambda x: (x[0], x[2] - x[1], x[1])):
            if j < done.get((k, i - j), -1):
                continue  # inside the last run of this diagonal
            length, end = longest(doc, self.texts[k], i, j)
            done[k, i - j] = end
            if length >= MIN_WORDS:
                best[self.ids[k]] = max(best.get(self.ids[k], 0), length)
        return best


def _reach(doc: list[int], item: list[int], i: int, j: int, step: int, most: int) -> list[int]:
    """reach[e]: how many words of the item from j on (in direction step) are covered with e edits, the last one as it is."""
    n, m = len(doc), len(item)
    reach, front = [0] * (most + 1), {0: 0}
    for e in range(most + 1):
        nxt: dict[int, int] = {}
        for d, c in front.items():
            start = c
            a, b = i + step * (c + d), j + step * c
            while 0 <= a < n and 0 <= b < m and doc[a] == item[b] and doc[a]:
                a, b, c = a + step, b + step, c + 1
            if c > start and c > reach[e]:
                reach[e] = c
            if 0 <= b < m and 0 <= a < n:
                if c + 1 > nxt.get(d, -1):
                    nxt[d] = c + 1  # a word replaced
                if c > nxt.get(d + 1, -1):
                    nxt[d + 1] = c  # a word added
        if e and reach[e - 1] > reach[e]:
            reach[e] = reach[e - 1]
        front = nxt
    return reach


def _most_words(right: list[int], left: list[int], most: int) -> int:
    """The words of the longest stretch within the tolerance that the reaches make up with `most` edits at most."""
    best = 0
    for a, x in enumerate(right):
        for b, y in enumerate(left[: most - a + 1]):
            if x + y > best and (a + b) * PER_EDIT <= x + y:
                best = x + y
    return best


def longest(doc: list[int], item: list[int], i: int, j: int) -> tuple[int, int]:
    """The longest stretch of the item around the hit (i, j) within the tolerance, and where the run at the hit ends in the item."""
    while i > 0 and j > 0 and doc[i - 1] == item[j - 1] and doc[i - 1]:
        i, j = i - 1, j - 1
    # Hits whose own NEAR edits hold no stretch needn't be followed further.
    right, left = _reach(doc, item, i, j, 1, NEAR), _reach(doc, item, i - 1, j - 1, -1, NEAR)
    if _most_words(right, left, NEAR) < MIN_WORDS:
        return 0, j + right[0]
    most = max(len(item), MIN_WORDS) // PER_EDIT
    if most > NEAR:
        right, left = _reach(doc, item, i, j, 1, most), _reach(doc, item, i - 1, j - 1, -1, most)
    best = _most_words(right, left, 2 * most)
    return best, j + right[0]


def leaked_passages(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, words): the passages that each document holds a stretch of, with the longest stretch's words.

    A stretch is MIN_WORDS or more neighbouring words of the item with at most one word in PER_EDIT replaced or added;
    it begins and ends with a word that is as it was. Null and empty texts hold nothing; repeated documents and items
    are reported each under its id, rows repeated with the same id once per row. Empty tables give no rows.
    """
    n_words = items.agg(F.sum(F.size(F.split(item_text, r"\s+"))).alias("n")).first().n or 0
    blocks = max(1, -(-int(n_words) // block_words))
    kinds = {f.name: f.dataType for f in items.schema.fields} | {f"d:{f.name}": f.dataType for f in documents.schema.fields}
    schema = T.StructType([T.StructField("doc_id", kinds[f"d:{doc_id}"]), T.StructField("item_id", kinds[item_id]), T.StructField("words", T.IntegerType())])
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    ship_package(documents.sparkSession)
    result = None
    for b in range(blocks):
        own = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        shared = items.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in own.toLocalIterator()])

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            passages = Passages(shared.value)
            for batch in batches:
                rows = [(d, k, n) for d, t in zip(batch["doc_id"], batch["text"]) for k, n in passages.found(t).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words"])

        part = docs.mapInPandas(search, schema)
        result = part if result is None else result.unionByName(part)
    return result

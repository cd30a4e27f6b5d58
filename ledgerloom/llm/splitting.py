"""Splitting oversized texts at natural boundaries.

A text is cut by a hierarchy of separators: sections, paragraphs, lines and sentences, words, characters. A part that is
too large at one level is cut at the next. The parts are then packed greedily into pieces up to the limit; each piece
but the first begins with the last `overlap` tokens of the one before. Nothing is dropped or changed: the pieces
without their overlaps are the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import tokens
from ledgerloom.llm.mixing import source_name
from ledgerloom.operators.bounded import lookup_join
from ledgerloom.session import ship_package

#: Where a text may be cut, per level; a cut is at the end of a match.
LEVELS = tuple(
    re.compile(p)
    for p in (
        r"(?:\r\n|\n|\r)(?=#{1,6} )|\f",
        r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))*",
        r"\r\n|\n|\r",
        r"[.!?][\"'”’)\]*]*(?=[\s_])|[。！？]",
        r"[;:,](?=[\s_])|[；，、]",
        r"\S(?=\s)|[^_](?=_)",
    )
)


class Offsets:
    """The tokens of a text, and where they begin in characters."""

    def __init__(self, text: str, tokenizer: str):
        e = tokens.encoding(tokenizer)
        self.tokens = [t for s in tokens.stretches(text) for t in e.encode_ordinary(s)]
        self.tokenizer, self.count, self.end = tokenizer, len(self.tokens), len(text)

    @cached_property
    def starts(self) -> list[int]:
        ends = np.cumsum(tokens.char_counts(self.tokenizer)[self.tokens]).tolist()
        return [0, *ends[:-1]] if ends else []

    def before(self, char: int) -> int:
        """Tokens that begin before a character."""
        return bisect_left(self.starts, char)

    def place(self, token: int) -> int:
        return self.starts[token] if token < len(self.starts) else self.end


def _parts(text: str, start: int, end: int, level: int, fits: int, offsets: Offsets) -> Iterator[tuple[int, int]]:
    """The parts of text[start:end] that have about `fits` tokens at most, cut at as high a level as will do."""
    stack = [(start, end, level)]
    while stack:
        a, b, at = stack.pop()
        if offsets.before(b) - offsets.before(a) <= fits:
            yield a, b
        elif at < len(LEVELS):
            cuts = [m.end() for m in LEVELS[at].finditer(text, a, b)]
            edges = [a, *(c for c in cuts if a < c < b), b]
            stack += [(x, y, at + 1) for x, y in reversed(list(zip(edges, edges[1:])))]
        else:
            i = a
            while i < b:
                j = min(b, max(i + 1, offsets.place(offsets.before(i + 1) - 1 + fits)))
                yield i, j
                i = j


def split_text(text: str, limit: int, overlap: int, tokenizer: str = tokens.DEFAULT, offsets: Offsets | None = None) -> list[tuple[int, int, int, int]]:
    """(start of the overlap, start of the new text, end, tokens) of each piece of a text.

    Every piece has at most `limit` tokens, counted on the piece by itself. The overlap is the end of the piece before,
    of exactly `overlap` tokens where some start gives that many, else the most below; it is cut to limit - 1, and by a
    character that alone has more tokens than are left. A single character over the limit is a piece of its own.
    """
    limit, overlap = max(1, limit), max(0, min(overlap, limit - 1))
    count = lambda a, b: tokens.count(text[a:b], tokenizer)
    offsets = offsets or Offsets(text, tokenizer)
    parts = list(_parts(text, 0, len(text), 0, max(1, limit - overlap), offsets))
    ends = [b for _, b in parts]
    out: list[tuple[int, int, int, int]] = []
    begin, new = 0, 0
    while new < len(text):
        # The last part that still fits by the offsets, then exactly.
        hi = offsets.before(begin + 1) - 1 + limit if begin < len(text) else 0
        k = bisect_right(ends, offsets.place(max(0, hi + 2))) - 1
        end = 0
        while k >= 0 and ends[k] > new:
            if (n := count(begin, ends[k])) <= limit:
                end = ends[k]
                break
            k -= 1
        if not end:  # no part fits beside the overlap: the longest run of words, else of characters, that does
            first = ends[bisect_right(ends, new)]
            words = [m.end() for m in LEVELS[-1].finditer(text, new, first) if new < m.end() < first]
            for places in (words, range(new + 1, first + 1)):
                lo, up = 0, len(places)
                while lo < up:
                    mid = (lo + up) // 2
                    if count(begin, places[mid]) <= limit:
                        lo = mid + 1
                    else:
                        up = mid
                while lo and count(begin, places[lo - 1]) > limit:
                    lo -= 1
                if lo:
                    end = places[lo - 1]
                    break
            if not end:
                if begin < new:
                    begin += 1  # the overlap leaves no room for a single character
                    continue
                end = new + 1
            n = count(begin, end)
        out.append((begin, new, end, n))
        new = end
        if new < len(text):
            begin = _overlap_start(text, out[-1][0], end, overlap, offsets, count)
    return out


def _overlap_start(text: str, start: int, end: int, overlap: int, offsets: Offsets, count) -> int:
    if overlap == 0:
        return end
    last = offsets.before(end)
    best, best_n = end, 0
    for t in sorted(range(last - overlap - 3, last - overlap + 4), key=lambda t: abs(t - (last - overlap))):
        p = offsets.place(t) if 0 <= t < len(offsets.starts) else end
        if start < p < end:
            n = count(p, end)
            if n == overlap:
                return p
            if best_n < n < overlap:
                best, best_n = p, n
    for p in range(best - 1, max(start, best - 40), -1):  # between tokens of the text as a whole
        n = count(p, end)
        if n == overlap:
            return p
        if n > overlap:
            break
        best, best_n = p, n
    return best


def split_oversized(documents: DataFrame, doc_id: str, text: str, source: Column, limits: DataFrame, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """(doc_id, piece, text, n_tokens, start, new_start, end): the pieces of every text over the limit of its source.

    limits: source, max_tokens, overlap_tokens. `piece` counts from 1; start, new_start and end are places in the text
    in characters: text = text[start:end], and start..new_start is shared with the piece before. Texts within the limit,
    null and empty texts and texts whose source has no limit give no rows. Rows repeated under one id are split each.
    """
    own = limits.select(source_name(F.col("source")).alias("__source"), F.col("max_tokens").cast("int").alias("__max"), F.coalesce(F.col("overlap_tokens").cast("int"), F.lit(0)).alias("__overlap")).where("__source is not null and __max > 0")
    d = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), source.alias("__source")).transform(lambda x: lookup_join(x, own, ["__source"], salt_of=["doc_id"])).drop("__source")
    # A token has at least one byte: texts of no more bytes than the limit can't exceed it.
    d = d.where(F.octet_length("text") > F.col("__max"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, most, over in zip(b["doc_id"], b["text"], b["__max"], b["__overlap"]):
                offsets = Offsets(t, tokenizer)
                if offsets.count > most:
                    rows += [(i, k, t[s:e], n, s, w, e) for k, (s, w, e, n) in enumerate(split_text(t, int(most), int(over), tokenizer, offsets), 1)]
                if len(rows) > 2000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    kind = documents.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("new_start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    names = schema.names
    ship_package(documents.sparkSession)
    tokens.ship_tokenizer(documents.sparkSession, tokenizer)
    return d.mapInPandas(run, schema)

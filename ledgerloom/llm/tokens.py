"""Counts and offsets in the tokens of a public tokenizer (byte-level BPE ranks in a tiktoken file)."""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Fixed value: how byte-level BPE vocabularies of this family split texts before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The vocabulary file; another one is given as a parameter, or in the environment variable LEDGERLOOM_TOKENIZER.
DEFAULT = os.environ.get("LEDGERLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def ship_tokenizer(spark: SparkSession, path: str) -> None:
    """Send the vocabulary file to executors that may lack it, once for an application."""
    sc = spark.sparkContext
    shipped = sc.__dict__.setdefault("_ledgerloom_files", set())
    if path not in shipped:
        shipped.add(path)
        sc.addFile(path)


@cache
def encoding(path: str = DEFAULT) -> tiktoken.Encoding:
    """The tokenizer of a file, or of the copy that was sent to the executor, loaded once in a process."""
    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def char_counts(path: str = DEFAULT) -> np.ndarray:
    """For each token how many characters begin in it (a character's further bytes count for nothing)."""
    e = encoding(path)
    return np.array([sum((x & 0xC0) != 0x80 for x in e.decode_single_token_bytes(i)) for i in range(e.n_vocab)], np.int32)


#: Characters that are encoded at a time; longer texts are cut at a blank before a word, where no token goes across.
STRETCH = 20_000


def stretches(text: str) -> list[str]:
    """The text in stretches that are encoded apart with the same tokens as together."""
    out, start = [], 0
    while len(text) - start > STRETCH:
        end = start + STRETCH
        # A blank between a letter and a letter begins a new piece of PATTERN whatever stands around it.
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        if end >= len(text):
            break
        out.append(text[start:end])
        start = end
    return [*out, text[start:]]


def count(text: str, path: str = DEFAULT) -> int:
    """The tokens of a text."""
    e = encoding(path)
    return sum(len(e.encode_ordinary(s)) for s in stretches(text))

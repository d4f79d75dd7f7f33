"""Byte-level BPE encoding of whole texts with a public vocabulary.

Texts are cut into short words by the vocabulary's pattern; each word is merged with a contiguous rank array: part
boundaries and the rank of each adjacent pair lie in one list, the minimum is found by a scan, its right boundary is
deleted and the ranks of its neighbours are refreshed. The scan is quadratic in the word, so words of more than
LONG_WORD bytes keep the same pairs in a heap over linked parts, which gives the same merges. Words repeat a lot, so
each Python worker keeps the ids of words it has seen.

Defined cases: null and empty texts give an empty list; strings that look like special tokens are plain text; white
space, combining signs, emoji and lone surrogates are bytes like any other; texts of any length are encoded whole;
repeated rows give repeated results; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_WORD = 256
#: Words kept by a worker; when full the store starts again. Bounds memory only.
WORD_STORE = 200_000
#: The pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = sys.maxsize


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return read_ranks(f.read())


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge with a contiguous array of [boundary, rank of the pair that starts there]."""
    n = len(word)
    parts = [[i, ranks.get(word[i : i + 2], _NONE)] for i in range(n - 1)] + [[n - 1, _NONE], [n, _NONE]]

    def rank_at(i: int) -> int:
        return ranks.get(word[parts[i][0] : parts[i + 3][0]], _NONE) if i + 3 < len(parts) else _NONE

    while True:
        low, at = _NONE, -1
        for i in range(len(parts) - 1):
            if parts[i][1] < low:
                low, at = parts[i][1], i
        if at < 0:
            break
        if at:
            parts[at - 1][1] = rank_at(at - 1)
        parts[at][1] = rank_at(at)
        del parts[at + 1]
    return [ranks[word[parts[i][0] : parts[i + 1][0]]] for i in range(len(parts) - 1)]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for words whose scans would be too long."""
    n = len(word)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        if (j := nxt[i]) >= 0 and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else -1
        if j < 0 or end[j] != stop:
            continue
        end[i], nxt[i], alive[j] = end[j], nxt[j], False
        if nxt[i] >= 0:
            prev[nxt[i]] = i
        if prev[i] >= 0:
            push(prev[i])
        push(i)
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.seen: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        ids = self.seen.get(w)
        if ids is None:
            raw = w.encode("utf-8", "replace")
            one = self.ranks.get(raw)
            ids = [one] if one is not None else (merge_short if len(raw) <= LONG_WORD else merge_long)(raw, self.ranks)
            if len(raw) <= LONG_WORD:
                if len(self.seen) >= WORD_STORE:
                    self.seen.clear()
                self.seen[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            seen, word, extend = self.seen, self.word, out.extend
            for w in self.words(text):
                extend(seen.get(w) or word(w))
        return out


def _shipped(path: str):
    """The vocabulary file (of the driver) goes to the executors by broadcast; each worker process keeps one encoder of it."""
    with open(path, "rb") as f:
        raw = f.read()
    name, sent = hashlib.sha256(raw).hexdigest(), SparkSession.active().sparkContext.broadcast(raw)

    def encoder() -> Encoder:
        kept = sys.__dict__.setdefault("_kept_encoders", {})
        if name not in kept:
            kept[name] = Encoder(read_ranks(sent.value))
        return kept[name]

    return encoder


def encode(text: Column, path: str = VOCABULARY) -> Column:
    encoder = _shipped(path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder()
        for texts in batches:
            yield pd.Series([e.encode(t) for t in texts], dtype=object)

    return ids(text)


def count_tokens(text: Column, path: str = VOCABULARY) -> Column:
    encoder = _shipped(path)

    @F.pandas_udf("long")
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder()
        for texts in batches:
            yield pd.Series([len(e.encode(t)) for t in texts], dtype="int64")

    return n(text)


def corpus_ids(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return documents.select("doc_id", encode(F.col("text"), path).alias("ids"))

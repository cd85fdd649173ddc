"""Token ids of whole texts under a public byte-level BPE vocabulary.

The vocabulary file (path given by the caller) is read once on the driver and sent to the executors as arrays; its size is
fixed by the vocabulary. Executors split texts with the vocabulary's own pattern and encode the distinct pieces of a batch
together: one flat array of symbols for all of them, and rounds that look every adjacent pair up by binary search over the
sorted pair keys, take the lowest rank of each piece, and merge all places of that pair at once.

Defined cases: a null text and an empty text both give an empty list; control characters and lone surrogates are encoded
as bytes of their UTF-8 form ("replacement" for what UTF-8 can't hold); repeated rows give repeated results; texts of any
length are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split of the byte-level vocabularies, as their description gives it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pieces remembered by a Python worker; only speed depends on it.
REMEMBERED = 200_000


def _bytes_of_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The vocabulary as arrays: byte_ids[256], sorted pair keys, their ranks and the ids they give."""

    def __init__(self, byte_ids: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, pattern: str = PATTERN):
        self.byte_ids, self.keys, self.ranks, self.made, self.pattern = byte_ids, keys, ranks, made, pattern
        self._split = None
        self._known: dict[str, np.ndarray] = {}

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Merges:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab = model["vocab"]
        byte_ids = np.zeros(256, np.int64)
        for letter, b in _bytes_of_letters().items():
            byte_ids[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(byte_ids, keys[order], order.astype(np.int64), made[order])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_split": None, "_known": {}}

    def pieces(self, text: str) -> list[str]:
        if self._split is None:
            self._split = regex.compile(self.pattern)
        return self._split.findall(text)

    def merge(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece, all pieces together."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), lengths)
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            valid = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(valid, self.ranks[at], np.iinfo(np.int64).max)
            rank = np.append(rank, np.iinfo(np.int64).max)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(owner)])
            done = low == np.iinfo(np.int64).max
            if done.any():
                for s, n in zip(starts[done].tolist(), sizes[done].tolist()):
                    out[owner[s]] = symbols[s : s + n]
                keep = np.repeat(~done, sizes)
                symbols, owner, rank, at = symbols[keep], owner[keep], rank[keep], np.append(at, 0)[keep]
                low, sizes = low[~done], sizes[~done]
                if not len(symbols):
                    break
            else:
                at = np.append(at, 0)
            hit = rank == np.repeat(low, sizes)
            # of overlapping places ("aaa") every second one counts, from the left
            where = np.flatnonzero(hit)
            run = np.r_[True, np.diff(where) > 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - first) % 2 == 0]
            symbols[where] = self.made[at[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return [x if x is not None else np.empty(0, np.int64) for x in out]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of the texts."""
        if len(self._known) > REMEMBERED:
            self._known = {}
        known = self._known
        split = [self.pieces(t) if t else [] for t in texts]
        new = list({p for ps in split for p in ps if p not in known})
        known.update(zip(new, self.merge(new)))
        rows = [np.concatenate([known[p] for p in ps]) if ps else np.empty(0, np.int64) for ps in split]
        offsets = np.r_[0, np.cumsum([len(r) for r in rows])]
        return (np.concatenate(rows) if rows else np.empty(0, np.int64)).astype(np.int32), offsets.astype(np.int32)


def slices(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` characters each, so that a batch of long texts needs no more memory than others."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 16
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids`` of every row. One pass over two columns, no shuffle."""
    merges = df.sparkSession.sparkContext.broadcast(Merges.read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                flat, offsets = merges.value.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The columns of df but `text`, and the number of tokens of each text."""
    merges = df.sparkSession.sparkContext.broadcast(Merges.read(vocabulary))
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            sizes = np.zeros(len(texts), np.int64)
            for a, b in slices(texts):
                sizes[a:b] = np.diff(merges.value.encode(texts[a:b])[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(sizes)], [*rest, name])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + f", `{name}` bigint"
    return df.select(*rest, F.col(text)).mapInArrow(run, schema)

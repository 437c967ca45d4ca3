"""Encoding of texts by a public byte-level BPE tokenizer."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.session import spread

NONE = np.int32(2**31 - 1)
#: Above this many bytes a piece of an ordered vocabulary merges all places of its lowest rank at once.
WIDE = 256


def default_vocabulary() -> str:
    """Path of byte_bpe_50k where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 letters stand for themselves, all others follow from 256 on.
    """
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


@dataclass
class Vocabulary:
    """Merges as a hash table of pairs; small, of fixed size, sent to each executor once."""

    bytes_to_id: np.ndarray  # 256
    slots: np.ndarray  # key of each slot of the hash table, -1 if empty
    ranks: np.ndarray
    merged: np.ndarray
    bits: int
    longest_probe: int
    ordered: bool  # each token's parts are made by merges of lower rank than any that uses it

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a tokenizer's JSON file, on the driver."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = (left << 32) | right
        bits = max(8, int(4 * len(keys)).bit_length())
        slots = np.full(1 << bits, -1, np.int64)
        ranks, to = np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
        at, todo, probes = cls._hash(keys, bits), np.arange(len(keys)), 0
        while len(todo):  # every key goes to the first free slot after its own
            probes += 1
            free = todo[slots[at[todo]] < 0]
            place, first = np.unique(at[free], return_index=True)
            won = free[first]
            slots[place], ranks[place], to[place] = keys[won], won, merged[won]
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
        made = np.full(max(ids.values()) + 1, -1, np.int64)  # the last merge that makes a token
        np.maximum.at(made, merged, np.arange(len(merged)))
        ordered = bool((np.maximum(made[left], made[right]) < np.arange(len(merged))).all())
        return cls(np.array([ids[c] for c in _byte_letters()], np.int32), slots, ranks, to, bits, probes, ordered)

    @staticmethod
    def _hash(keys: np.ndarray, bits: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs; that of a pair which never merges has no rank."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._hash(keys, self.bits)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.longest_probe + 1):
            held = self.slots[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (held >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.find(left.ravel(), right.ravel())
        return np.where(at >= 0, self.ranks[at], NONE).reshape(left.shape)


def merge_matrix(ids: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merges each row of a padded matrix to its end.

    Each round every row that still has a pair to merge merges the leftmost
    of its lowest rank; the columns behind move up. Ranks are kept beside the
    ids, so a round looks up only the two pairs that the merge has changed.
    Rows that are done leave the matrix.
    """
    n, width = ids.shape
    out, sizes = ids.copy(), lengths.copy()
    if width < 2:
        return out, sizes
    cols = np.arange(width - 1)
    ranks = np.full((n, width), NONE, np.int32)
    real = cols[None, :] < (lengths - 1)[:, None]
    a, b = ids[:, :-1], ids[:, 1:]
    ranks[:, :-1][real] = vocab.rank(a[real], b[real])
    rows = np.arange(n)
    cur, size = ids.copy(), lengths.copy()
    while len(rows):
        at = ranks.argmin(1)
        span = np.arange(len(rows))
        live = ranks[span, at] < NONE
        if not live.all():
            done = ~live
            out[rows[done]], sizes[rows[done]] = cur[done], size[done]
            rows, cur, size, ranks, at = rows[live], cur[live], size[live], ranks[live], at[live]
            span = np.arange(len(rows))
            if not len(rows):
                break
        cur[span, at] = vocab.merged[vocab.find(cur[span, at], cur[span, at + 1])]
        take = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
        take = np.minimum(take, width - 1)
        cur = np.take_along_axis(cur, take, 1)
        ranks = np.take_along_axis(ranks, take, 1)
        size = size - 1
        ranks[:, -1] = NONE
        right = at + 1 < size
        ranks[span, at] = NONE
        ranks[span[right], at[right]] = vocab.rank(cur[span[right], at[right]], cur[span[right], at[right] + 1])
        left = at > 0
        ranks[span[left], at[left] - 1] = vocab.rank(cur[span[left], at[left] - 1], cur[span[left], at[left]])
    return out, sizes


def merge_wide(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Merges one long row: all places of its lowest rank each round, from left to right.

    Equal to the leftmost rule for an ordered vocabulary (checked when it is
    read): a merge there makes only pairs of higher rank than its own, so no
    pair of a lower or the same rank comes up while the places of the lowest
    rank, one pair at all of them, are merged in turn.
    """
    if len(ids) < 2:
        return ids
    ids = ids.copy()
    ranks = vocab.rank(ids[:-1], ids[1:])
    while len(ranks):
        low = ranks.min()
        if low == NONE:
            break
        at = np.flatnonzero(ranks == low)  # one rank is one pair
        starts = np.concatenate([[True], np.diff(at) > 1])
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
        at = at[run % 2 == 0]  # of overlapping places every second
        ids[at] = vocab.merged[vocab.find(ids[at[:1]], ids[at[:1] + 1])]
        ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
        moved = at - np.arange(len(at))
        new = np.unique(np.concatenate([moved - 1, moved]))
        new = new[(new >= 0) & (new < len(ranks))]
        ranks[new] = vocab.rank(ids[new], ids[new + 1])
    return ids


def ascii_pattern(pattern: str) -> str | None:
    """The pattern for texts of ASCII letters alone, which the plain ``re`` module splits twice as fast; null if there is none."""
    out, inside, at = "", False, 0
    names = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}
    while at < len(pattern):
        if pattern[at : at + 5] in names:
            own = names[pattern[at : at + 5]]
            out += own if inside else f"[{own}]"
            at += 5
            continue
        if pattern[at] == "\\":
            if pattern[at + 1 : at + 2] not in ("s", "S", "r", "n"):
                return None
            out += pattern[at : at + 2]
            at += 2
            continue
        inside = pattern[at] == "[" or (inside and pattern[at] != "]")
        out += pattern[at]
        at += 1
    try:
        re.compile(out, re.ASCII)
    except re.error:
        return None
    return out


class Encoder:
    """Encodes batches of texts; pieces that were met before come from a bounded memory.

    The ids of all known pieces lie in one array; a batch's texts are gathered
    from it at once.
    """

    def __init__(self, vocab: Vocabulary, pattern: str, remember: int = 400_000) -> None:
        self.vocab, self.split, self.remember = vocab, regex.compile(pattern).findall, remember
        plain = ascii_pattern(pattern)
        self.split_ascii = re.compile(plain, re.ASCII).findall if plain else self.split
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        bytes_ = self.vocab.bytes_to_id[np.frombuffer(b"".join(raw), np.uint8)]
        begins = np.cumsum(lengths) - lengths
        sizes = np.zeros(len(raw), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # places of words, their ids one after the other
        buckets = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for bucket in np.unique(buckets):
            at = np.flatnonzero(buckets == bucket)
            if 1 << bucket > WIDE and self.vocab.ordered:
                for i in at:
                    ids = merge_wide(bytes_[begins[i] : begins[i] + lengths[i]], self.vocab)
                    sizes[i] = len(ids)
                    found.append((np.array([i]), ids))
                continue
            width = max(int(lengths[at].max()), 1)
            column = np.arange(width)[None, :]
            filled = column < lengths[at][:, None]
            matrix = np.where(filled, bytes_[np.minimum(begins[at][:, None] + column, max(len(bytes_) - 1, 0))], 0).astype(np.int32)
            merged, sizes[at] = merge_matrix(matrix, lengths[at], self.vocab)
            found.append((at, merged[column < sizes[at][:, None]]))
        flat = np.empty(int(sizes.sum()), np.int32)
        starts = np.cumsum(sizes) - sizes
        for at, ids in found:
            flat[_spans(starts[at], sizes[at])] = ids
        return flat, sizes

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        split = [(self.split_ascii if t.isascii() else self.split)(t) if t else [] for t in texts]
        if len(self.known) > self.remember:
            self._forget()
        known = self.known
        new = list(set().union(*split) - known.keys())
        if new:
            known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            flat, sizes = self.pieces(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
        counts = [len(words) for words in split]
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, sum(counts))
        sizes = self.sizes[at]
        ids = self.flat[_spans(self.starts[at], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *counts])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size - 1`` of each span, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def encode_texts(
    df: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    vocabulary: str | None = None,
    pattern: str | None = None,
    batch: int = 256,
) -> DataFrame:
    """Token ids of each text: the ``keep`` columns and ids array<int>.

    Texts are encoded whole, without special tokens; a marker that looks like
    one is plain text. An empty and a null text give an empty list. Columns
    of the input other than ``keep`` and ``text`` are dropped, so none can
    clash; each row gives one row, also repeated ones.

    ``vocabulary`` is the path of a byte-level BPE tokenizer's JSON file, read
    on the driver and broadcast (a table of fixed size, about 1 MB).

    Method: pieces of text by the vocabulary's pattern; distinct new pieces of
    a batch are bucketed by length into padded matrices, in which every row
    merges its leftmost pair of lowest rank each round, found in a hash table.
    Pieces over ``WIDE`` bytes, whose rounds would be too many, go through
    ``merge_wide`` if the vocabulary is ordered, which makes it the same; with
    another vocabulary they go through the matrices too.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.read(vocabulary or default_vocabulary()))
    how = pattern or default_pattern()
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<int>"

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value, how)
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                texts = [t if isinstance(t, str) else None for t in part[text].tolist()]
                yield part[list(keep)].assign(ids=pd.Series(encoder.encode(texts), index=part.index, dtype=object))

    return spread(df.select(*keep, F.col(text))).mapInPandas(body, schema)


def vocabulary_from_env() -> str | None:
    """The path that the setting TOKENIZER_JSON names, if it is set."""
    return os.environ.get("TOKENIZER_JSON")

"""Pairs of records from two tables, nearest in time for the same entity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class XFastTries:
    """x-fast tries of many groups at once: all prefixes of all keys in hash tables.

    ``group`` numbers the tries, ``key`` holds non-negative integers below
    ``2 ** bits``; pairs have to be sorted and distinct. The table of a prefix
    length maps (group, prefix) to the first and last leaf below it.
    """

    def __init__(self, group: np.ndarray, key: np.ndarray, bits: int) -> None:
        self.group, self.key, self.bits = group, key, bits
        self.tables: dict[int, tuple[pd.Index, np.ndarray, np.ndarray]] = {}

    def _code(self, group: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
        return (group << np.int64(length)) | (key >> np.int64(self.bits - length))

    def table(self, length: int) -> tuple[pd.Index, np.ndarray, np.ndarray]:
        if length not in self.tables:
            code = self._code(self.group, self.key, length)
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            last = np.concatenate([first[1:], [len(code)]]) - 1
            self.tables[length] = (pd.Index(code[first]), first, last)
        return self.tables[length]

    def around(self, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of the predecessor (<= key) and successor (>= key) in the key's group; -1 if none.

        A binary search over prefix lengths finds the deepest node on the
        key's path; its leaf at the side where the path breaks off is one
        neighbour, the leaf beside it the other.
        """
        n, leaves = len(key), len(self.key)
        lo = np.full(n, -1)  # deepest length known to be there
        hi = np.full(n, self.bits + 1)  # shallowest known to be missing
        node_first, node_last = np.full(n, -1), np.full(n, -1)
        while True:
            mid = np.where(hi - lo > 1, (lo + hi) // 2, -1)
            open_ = np.flatnonzero(mid >= 0)
            if not len(open_):
                break
            for length in np.unique(mid[open_]):
                at = open_[mid[open_] == length]
                index, first, last = self.table(int(length))
                pos = index.get_indexer(self._code(group[at], key[at], int(length)))
                there = pos >= 0
                lo[at[there]], hi[at[~there]] = length, length
                node_first[at[there]], node_last[at[there]] = first[pos[there]], last[pos[there]]
        pred, succ = np.full(n, -1), np.full(n, -1)
        exact = lo == self.bits
        pred[exact] = succ[exact] = node_first[exact]
        part = np.flatnonzero((lo >= 0) & ~exact)
        right = (key[part] >> (self.bits - lo[part] - 1)) & 1 == 1  # the path breaks off to the right
        r, left = part[right], part[~right]
        pred[r], succ[r] = node_last[r], node_last[r] + 1
        succ[left], pred[left] = node_first[left], node_first[left] - 1
        for leaf in (pred, succ):
            inside = (leaf >= 0) & (leaf < leaves)
            inside[inside] = self.group[leaf[inside]] == group[inside]
            leaf[~inside] = -1
        return pred, succ


_OUT = "left_id bigint, right_id bigint"


def _matcher(tolerance: int, shift: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    bits = max(shift, (2 * tolerance + 1).bit_length()) + 1

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(["entity", "block"], sort=False).ngroup().to_numpy(np.int64)
        local = (pdf["t"] - pdf["block"] * (1 << shift)).to_numpy(np.int64) + tolerance
        ids, left = pdf["id"].to_numpy(np.int64), pdf["is_left"].to_numpy(bool)
        order = np.lexsort((ids[left], local[left], group[left]))
        g, k, i = group[left][order], local[left][order], ids[left][order]
        keep = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]) if len(g) else np.zeros(0, bool)
        g, k, i = g[keep], k[keep], i[keep]  # of equal times the smaller id
        asked = pd.DataFrame({"g": group[~left], "k": local[~left], "id": ids[~left]}).drop_duplicates()
        if not len(g) or not len(asked):
            return pd.DataFrame({"left_id": [], "right_id": []}, dtype="int64")
        qg, qk, qid = (asked[c].to_numpy(np.int64) for c in ("g", "k", "id"))
        pred, succ = XFastTries(g, k, bits).around(qg, qk)
        far = np.iinfo(np.int64).max
        before = np.where(pred >= 0, qk - k[pred], far)
        after = np.where(succ >= 0, k[succ] - qk, far)
        take_pred = (before < after) | ((before == after) & (i[pred] < i[succ]))
        near = np.where(take_pred, before, after)
        leaf = np.where(take_pred, pred, succ)
        ok = near <= tolerance
        return pd.DataFrame({"left_id": i[leaf[ok]], "right_id": qid[ok]})

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # parts of the last block, put together once when it ends
        key: tuple | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            entity, block = pdf["entity"].to_numpy(object), pdf["block"].to_numpy()
            last = (entity == entity[-1]) & (block == block[-1])
            if last.all() and key == (entity[-1], block[-1]):
                held.append(pdf)
                continue
            yield match(pd.concat([*held, pdf[~last]], ignore_index=True))
            held, key = [pdf[last]], (entity[-1], block[-1])
        if held:
            yield match(pd.concat(held, ignore_index=True))

    return body


def match_nearest(
    left: DataFrame,
    right: DataFrame,
    entity: str,
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    tolerance_us: int,
    block_bits: int = 16,
) -> DataFrame:
    """For each row of ``right`` the row of ``left`` nearest in time: (left_id, right_id).

    Both belong to the same ``entity`` (a string column of both) and lie at
    most ``tolerance_us`` apart, before or after; of equally near ones the
    smaller id is taken. A left row may serve several right rows; right rows
    without a partner give no row. Rows with a null entity, time or id are
    left out, rows that repeat an id with the same entity and time count
    once. Other columns are ignored; an empty table gives no rows.

    Method: per entity and block of ``2 ** block_bits`` microseconds the left
    times are put into an x-fast trie (hash tables of bit prefixes); a binary
    search over prefix lengths gives predecessor and successor. Left rows
    within the tolerance of a block's edge are put into the next block too,
    so blocks need nothing from each other and a busy entity is spread by
    time. One shuffle brings both sides together.
    """
    if tolerance_us < 0 or tolerance_us >= 1 << block_bits:
        raise ValueError("the tolerance has to be shorter than a block")

    def side(df: DataFrame, time: str, ident: str) -> DataFrame:
        return df.select(
            F.col(entity).cast("string").alias("entity"),
            F.col(time).cast("bigint").alias("t"),
            F.col(ident).cast("bigint").alias("id"),
        ).dropna()

    block = f"shiftright(t, {block_bits})"
    near = f"array_distinct(array(shiftright(t - {tolerance_us}, {block_bits}), {block}, shiftright(t + {tolerance_us}, {block_bits})))"
    lefts = side(left, left_time, left_id).withColumn("block", F.explode(F.expr(near))).withColumn("is_left", F.lit(True))
    rights = side(right, right_time, right_id).withColumn("block", F.expr(block)).withColumn("is_left", F.lit(False))
    both = lefts.unionByName(rights).repartition("entity", "block").sortWithinPartitions("entity", "block")
    return both.mapInPandas(_matcher(tolerance_us, block_bits), _OUT)


def tensor_set(name: str = "name") -> str:
    """The tensor ids of an event's name as a text that doesn't depend on their order; null if it has none."""
    ids = rf"regexp_extract({name}, '^Comm[.]([0-9]+(?:[+][0-9]+)*)[.]', 1)"
    return f"nullif(array_join(array_sort(array_distinct(split({ids}, '[+]'))), '+'), '')"

"""Packing of items into containers of fixed capacity with little room left over."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.session import by_key


@dataclass(frozen=True)
class PackingRules:
    group_items: int = 20_000  # items that are packed together


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A number of bins below which no packing can go.

    The larger of: all sizes over the capacity; and, for each bound ``k`` up to
    half the capacity, the items over ``capacity - k`` (each alone beside any
    item of ``k`` or more), those over half of it, and what the middle items
    need beyond the room that the latter leave.
    """
    if not len(sizes):
        return 0
    held = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    count = np.concatenate([[0], np.cumsum(held)])  # items below each size
    total = np.concatenate([[0], np.cumsum(held * np.arange(capacity + 1))])
    k = np.unique(np.concatenate([[0], sizes[2 * sizes <= capacity]]))
    half = capacity // 2
    alone = count[-1] - count[capacity - k + 1]
    large = count[capacity - k + 1] - count[half + 1]
    room = large * capacity - (total[capacity - k + 1] - total[half + 1])
    middle = total[half + 1] - total[k]
    need = alone + large + np.maximum(0, -((room - middle) // capacity))
    return max(int(need.max()), -(-int(sizes.sum()) // capacity))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Start of the search: best fit by falling size; a bin number per item."""
    bins = np.empty(len(sizes), np.int64)
    frees: list[int] = []  # free room of open bins, sorted
    owner: dict[int, list[int]] = {}
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(frees, s)
        if at < len(frees):
            free = frees.pop(at)
            b = owner[free].pop()
        else:
            b, free, made = made, capacity, made + 1
        bins[i] = b
        left = free - s
        insort(frees, left)
        owner.setdefault(left, []).append(b)
    return bins


class _Offers:
    """What bins would give away: an offer (lo, bin) takes a size ``s`` with ``lo < s <= lo + room``.

    Offers are kept by their reach ``lo + room``; the lowest ``lo`` of each
    reach stands in an array, so the offer that fills its bin up best is found
    by one scan of neighbouring numbers. Offers of a bin that has changed
    since are dropped when they are met.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, capacity: int) -> None:
        self.lowest = np.full(capacity + 2, self.NONE, np.int32)
        self.heaps: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, los: list[int], room: int, bin_: int, version: int) -> None:
        for lo in los:
            reach = lo + room
            heap = self.heaps.get(reach)
            if heap is None:
                heap = self.heaps[reach] = []
            heappush(heap, (lo, bin_, version))
            if lo < self.lowest[reach]:
                self.lowest[reach] = lo

    def find(self, s: int, room: int, versions: list[int]) -> tuple[int, int] | None:
        """(lo, bin) of the offer for ``s`` that leaves its bin the least room, less than ``room``."""
        end = min(s + room, len(self.lowest))
        at = s
        while at < end:
            part = self.lowest[at:end] < s
            k = int(part.argmax())
            if not part[k]:
                return None
            at += k
            heap = self.heaps[at]
            while heap and versions[heap[0][1]] != heap[0][2]:
                heappop(heap)
            self.lowest[at] = heap[0][0] if heap else self.NONE
            if heap and heap[0][0] < s:
                return heap[0][0], heap[0][1]
        return None


class Search:
    """Local search that raises the sum of squared fills until bins run empty.

    Underfull bins give their items away, the emptiest first: an item moves
    to another bin, is exchanged for a smaller one or for two that are smaller
    together, or two items are exchanged for one that is smaller than both, so
    that the other bin ends up fuller than this one was. Each step raises the
    squared fill, a whole number with an upper bound, so the search ends: at a
    packing that no such step improves, or at the least possible number of
    bins. Nothing else stops it.
    """

    def __init__(self, sizes: np.ndarray, bins: np.ndarray, capacity: int) -> None:
        self.sizes, self.bins, self.capacity = sizes.tolist(), bins.tolist(), capacity
        n = int(bins.max()) + 1
        self.members: list[dict[int, list[int]]] = [{} for _ in range(n)]  # per bin: size -> items
        self.fill = [0] * n
        self.version = [0] * n
        self.least = least_bins(sizes, capacity)
        self.rooms: dict[int, set[int]] = {}  # bins by room
        for i, b in enumerate(self.bins):
            self.members[b].setdefault(self.sizes[i], []).append(i)
            self.fill[b] += self.sizes[i]
        self.used = n
        self.open_rooms: list[int] = []  # rooms of at least one open bin, sorted
        self.single, self.double = _Offers(capacity), _Offers(capacity)
        for b in range(n):
            self._enter(b)

    # ---- index

    def _enter(self, b: int) -> None:
        """Makes a bin findable; full bins have nothing to offer."""
        room = self.capacity - self.fill[b]
        if not room or not self.members[b]:
            return
        held = self.rooms.get(room)
        if held:
            held.add(b)
        else:
            self.rooms[room] = {b}
            insort(self.open_rooms, room)
        own = sorted(self.members[b])
        self.single.add(own, room, b, self.version[b])
        self.double.add(self._pair_sums(b, own), room, b, self.version[b])

    def _pair_sums(self, b: int, own: list[int]) -> list[int]:
        """Sums of two items of a bin, each once."""
        if len(own) < 8:
            return sorted({x + y for i, x in enumerate(own) for y in own[i:] if x != y or len(self.members[b][x]) > 1})
        z = np.array(own)
        twice = np.array([len(self.members[b][x]) > 1 for x in own])
        return np.unique(np.concatenate([(z[:, None] + z)[np.triu_indices(len(z), 1)], 2 * z[twice]])).tolist()

    def _leave(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        held = self.rooms.get(room)
        if held and b in held:
            held.discard(b)
            if not held:
                del self.rooms[room]
                self.open_rooms.pop(bisect_left(self.open_rooms, room))
        self.version[b] += 1

    # ---- steps

    def _take(self, b: int, size: int) -> int:
        items = self.members[b][size]
        i = items.pop()
        if not items:
            del self.members[b][size]
        self.fill[b] -= size
        return i

    def _put(self, b: int, i: int) -> None:
        size = self.sizes[i]
        self.members[b].setdefault(size, []).append(i)
        self.fill[b] += size
        self.bins[i] = b

    def _swap(self, away: int, give: tuple[int, ...], to: int, back: tuple[int, ...]) -> None:
        """``away`` (which isn't in the index meanwhile) gives sizes to ``to`` and gets others back."""
        self._leave(to)
        given = [self._take(away, s) for s in give]
        got = [self._take(to, s) for s in back]
        for i in given:
            self._put(to, i)
        for i in got:
            self._put(away, i)
        self._enter(to)

    def _split(self, b: int, both: int) -> tuple[int, int]:
        """Two sizes of a bin with the given sum, the most uneven."""
        own = self.members[b]
        for x in sorted(own):
            y = both - x
            if y in own and (x != y or len(own[x]) > 1):
                return x, y
        raise KeyError(both)

    def _step(self, away: int) -> bool:
        """One improving step for a bin that is out of the index, if there is any."""
        room = self.capacity - self.fill[away]
        own = sorted(self.members[away], reverse=True)
        for s in own:  # move: into the bin that it fills up best, fuller than this one
            at = bisect_left(self.open_rooms, s)
            if at < len(self.open_rooms) and self.open_rooms[at] - s < room:
                self._swap(away, (s,), min(self.rooms[self.open_rooms[at]]), ())
                return True
        for s in own:
            hit = self.single.find(s, room, self.version)
            if hit:
                self._swap(away, (s,), hit[1], (hit[0],))
                return True
        for s in own:
            hit = self.double.find(s, room, self.version)
            if hit:
                self._swap(away, (s,), hit[1], self._split(hit[1], hit[0]))
                return True
        for both in self._pair_sums(away, sorted(own)):
            hit = self.single.find(both, room, self.version) if both <= self.capacity else None
            if hit:
                self._swap(away, self._split(away, both), hit[1], (hit[0],))
                return True
        return False

    def run(self) -> np.ndarray:
        changed = True
        while changed and self.used > self.least:
            changed = False
            todo = [(f, b) for b, f in enumerate(self.fill) if self.members[b] and f < self.capacity]
            heapify(todo)
            while todo and self.used > self.least:
                fill, b = heappop(todo)
                if fill != self.fill[b] or not self.members[b]:
                    continue  # has changed since and is tried in the next round
                self._leave(b)
                moved = False
                while self.members[b] and self._step(b):
                    moved = True
                changed |= moved
                if not self.members[b]:
                    self.used -= 1
                else:
                    self._enter(b)
        return np.unique(np.array(self.bins, np.int64), return_inverse=True)[1]


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin numbers (from 0) of each item: those of the search and those of its start; no item may exceed the capacity."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = best_fit(sizes, capacity)
    some = sizes > 0  # items without size take no room, wherever they are
    if not some.any():
        return start, start
    found = np.unique(start[some], return_inverse=True)[1]
    if found.max() + 1 > least_bins(sizes[some], capacity):  # else the start can't be beaten
        found = Search(sizes[some], found, capacity).run()
    bins = np.zeros(len(sizes), np.int64)
    bins[some] = found
    return bins, start


_OUT = "bin_kind string, capacity int, item_id bigint, part int, n_tokens bigint, start_token bigint, grp int, bin int, start_bin int, least_bins bigint"


def pack_items(
    items: DataFrame,
    kinds: DataFrame,
    item_id: str,
    size: str,
    rules: PackingRules = PackingRules(),
    report: bool = False,
) -> DataFrame:
    """The container of each item, for each kind of container.

    ``kinds`` (bin_kind, capacity_tokens) is a short list (at most 1000
    rows). Columns: bin_kind, capacity, item_id, part (0 unless split),
    n_tokens, start_token (where the part begins in the item), bin_id (unique
    within the kind). An item is split only if it exceeds the capacity: into
    full containers and a rest. Items of size 0 take no room but get a
    container too. Items with a null id or size, kinds with a null name or a
    capacity below 1 are left out. Repeated rows are items of their own.
    Other columns are ignored; empty tables give no rows.

    With ``report`` there are two columns more: least_bins, a number of
    containers that the item's group can't go below, and start_id, the
    container that best fit alone gave.

    Method: items are spread by a hash over groups of about ``group_items``,
    each packed by best fit and then by the local search, which runs until no
    exchange improves or the least number of bins is reached; sizes are alike
    in all groups, so packing apart costs at most about one underfull bin per
    group. No group grows with the data, only their number.
    """
    result = [*_RESULT, *(["grp", "start_id", "least_bins"] if report else [])]
    bounded = kinds.select("bin_kind", F.col("capacity_tokens").cast("int").alias("c")).dropna().filter("c >= 1").distinct().limit(1001).collect()
    if len(bounded) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    base = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(size).cast("bigint").alias("size")).dropna()
    if not bounded:
        return base.sparkSession.createDataFrame([], _OUT + ", bin_id string, start_id string").select(*result)
    count = base.count()
    groups = max(1, -(-count // rules.group_items))
    choices = F.array(*[F.struct(F.lit(r["bin_kind"]).alias("bin_kind"), F.lit(r["c"]).alias("capacity")) for r in bounded])
    parts = (
        base.withColumn("grp", F.pmod(F.xxhash64("item_id", "size"), F.lit(groups)).cast("int"))
        .withColumn("k", F.explode(choices))
        .select("item_id", "size", "grp", "k.bin_kind", "k.capacity")
        .withColumn("full", F.expr("greatest(0, cast(ceil(size / capacity) as int) - 1)"))
        .withColumn("part", F.explode(F.expr("sequence(0, `full`)")))
        .withColumn("start_token", F.col("part").cast("bigint") * F.col("capacity"))
        .withColumn("n_tokens", F.least(F.col("capacity").cast("bigint"), F.col("size") - F.col("start_token")))
    )

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "item_id", "part"], ascending=[False, True, True], ignore_index=True)
        capacity = int(pdf["capacity"].iloc[0])
        sizes = pdf["n_tokens"].to_numpy(np.int64)
        whole = sizes == capacity  # these fill a container alone
        full = int(whole.sum())
        bins = np.empty(len(sizes), np.int64)
        bins[whole] = np.arange(full)
        start = bins.copy()
        bins[~whole], start[~whole] = (full + x for x in pack(sizes[~whole], capacity))
        least = full + least_bins(sizes[~whole], capacity)
        pdf = pdf.assign(bin=bins.astype(np.int32), start_bin=start.astype(np.int32), least_bins=least)
        return pdf[[c.split()[0] for c in _OUT.split(", ")]]

    packed = by_key(parts, "bin_kind", "grp").groupBy("bin_kind", "grp").applyInPandas(place, _OUT)
    ids = {"bin_id": F.format_string("%d-%d", "grp", "bin"), "start_id": F.format_string("%d-%d", "grp", "start_bin")}
    return packed.withColumns(ids).select(*result)


_RESULT = ["bin_kind", "capacity", "item_id", "part", "n_tokens", "start_token", "bin_id"]


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind, of ``pack_items`` with ``report``: parts, tokens, bins, those of best fit alone, the fewest possible, and the share of room used.

    ``least_bins`` is the bound of all items together, ``least_apart`` that of
    the groups packed apart, summed up.
    """
    kind = ["bin_kind", "capacity"]
    bins = packed.groupBy(*kind, "grp", "bin_id").agg(
        F.sum("n_tokens").alias("fill"), F.count(F.lit(1)).alias("parts"), F.first("least_bins").alias("least")
    )
    groups = bins.groupBy(*kind, "grp").agg(
        F.sum("parts").alias("parts"), F.sum("fill").alias("fill"), F.count(F.lit(1)).alias("bins"), F.first("least").alias("least")
    )
    found = groups.groupBy(*kind).agg(
        F.sum("parts").alias("parts"),
        F.sum("fill").alias("tokens"),
        F.sum("bins").alias("bins"),
        F.ceil(F.sum("fill") / F.first("capacity")).alias("least_bins"),
        F.sum("least").alias("least_apart"),
        (F.sum("fill") / (F.sum("bins") * F.first("capacity"))).alias("used"),
    )
    starts = packed.select(*kind, "start_id").distinct().groupBy(*kind).agg(F.count(F.lit(1)).alias("start_bins"))
    return found.join(starts, kind)

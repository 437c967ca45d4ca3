"""Algorithms on one graph that fits a task: order, longest path, replay, rewrites, samples.

No Spark in here. A graph is a list of node keys, dicts of attributes and
lists of edges by position. The callers run these per (trial, step, scenario)
group, so parallelism comes from the number of graphs and scenarios.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
from bisect import insort
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from tracequarry.functions.names import CATEGORIES, LAST_PRIORITY, PRIORITIES


@dataclass
class Graph:
    """A directed graph; ``avg`` in ms and ``gaps`` in us per node."""

    names: list[str]
    avg: list[float]
    succ: list[list[int]]
    pred: list[list[int]]
    gaps: list[dict[str, float]]
    _places: list[int] | None = None

    @classmethod
    def build(
        cls, nodes: Iterable[tuple[str, float]], edges: Iterable[tuple[str, str]], gaps: dict[str, dict[str, float]] | None = None
    ) -> Graph:
        """Edges to unknown nodes and repeated edges are left out."""
        table = {}
        for name, avg in nodes:
            table.setdefault(name, float(avg or 0.0))
        names = list(table)
        at = {n: i for i, n in enumerate(names)}
        succ: list[list[int]] = [[] for _ in names]
        pred: list[list[int]] = [[] for _ in names]
        for u, v in dict.fromkeys(edges):
            if u in at and v in at and u != v:
                succ[at[u]].append(at[v])
                pred[at[v]].append(at[u])
        found = gaps or {}
        return cls(names, [table[n] for n in names], succ, pred, [dict(found.get(n) or {}) for n in names])

    def order(self) -> tuple[list[int], list[int]]:
        """A topological order, and the nodes that lie on or behind a cycle."""
        left = [len(p) for p in self.pred]
        out = self.ordered(left)
        return out, [i for i, n in enumerate(left) if n > 0]

    def ordered(self, left: list[int]) -> list[int]:
        """The order, of nodes with ``left`` predecessors each, which are counted down."""
        ready = [i for i, n in enumerate(left) if n == 0]
        heapq.heapify(ready)
        out = []
        while ready:
            u = heapq.heappop(ready)
            out.append(u)
            for v in self.succ[u]:
                left[v] -= 1
                if left[v] == 0:
                    heapq.heappush(ready, v)
        return out

    def places(self) -> list[int]:
        """Each node's place in a topological order, worked out once; those on or behind a cycle come last, all alike."""
        if self._places is None:
            order, _ = self.order()
            self._places = [len(self.names)] * len(self.names)
            for i, u in enumerate(order):
                self._places[u] = i
        return self._places


def longest_path(g: Graph, cost: Callable[[int, int], float]) -> list[tuple[str, float]]:
    """The path of largest total edge cost: (node, cost of the edge behind it), 0 at its end.

    Ties go to the first predecessor and the first end. A graph with a cycle
    raises ValueError; an empty graph has an empty path.
    """
    order, cyclic = g.order()
    if cyclic:
        raise ValueError(f"cycle through {g.names[cyclic[0]]}")
    if not order:
        return []
    best, via = [0.0] * len(g.names), [-1] * len(g.names)
    for v in order:
        for u in g.pred[v]:
            total = best[u] + cost(u, v)
            if via[v] < 0 or total > best[v]:
                best[v], via[v] = total, u
        best[v] = max(best[v], 0.0) if via[v] < 0 else best[v]
    end = max(order, key=lambda i: best[i])
    path = [end]
    while via[path[-1]] >= 0:
        path.append(via[path[-1]])
    path.reverse()
    return [(g.names[u], cost(u, v)) for u, v in zip(path, path[1:])] + [(g.names[path[-1]], 0.0)]


@lru_cache(maxsize=100_000)
def coarse(name: str) -> str:
    """Coarse category of a node's name: ``virtual`` for END, ``none`` where no rule fits."""
    for cat, parts in CATEGORIES:
        if any(x in name for x in parts):
            return cat
    return "virtual" if name.split("->", 1)[-1].split("~>")[0] == "END" else "none"


def pid_of(name: str) -> str:
    return name.split("->", 1)[0] if "->" in name else "none"


def node_cost(g: Graph, u: int, v: int) -> float:
    """Cost of an edge in ms: the node's mean and the gaps between the two categories."""
    a, b = coarse(g.names[u]), coarse(g.names[v])
    gap = 0.0
    for key, value in g.gaps[u].items():
        if key == "INTERNODEGAP":
            gap += value if "PUSH_RES" in g.names[u] and "PULL_REQ" in g.names[v] else 0.0
        elif key.split("GAP") == [a, b]:
            gap += value
    return g.avg[u] + gap / 1000.0


# Order in which the parts of a tensor's synchronisation hold the kernel device.
KERNEL_PARTS = ["QUEUE", "MEMCPY_IN_FUSION_BUFFER", "NCCL_ALLREDUCE", "MEMCPY_OUT_FUSION_BUFFER"]


@lru_cache(maxsize=100_000)
def device_of(name: str, endless_update: bool = False) -> tuple[str, str]:
    """Virtual device of a node, and its kind: plain, lock or endless."""
    pid, cat = pid_of(name), coarse(name)
    if cat == "Comm":
        if "SEND" in name or "RECV" in name:
            return f"{pid}->Comm", "plain"
        if "Sync" in name:
            return f"{pid}->Comm.Sync", "plain"
        if any(p in name for p in KERNEL_PARTS):
            return f"{pid}->Comm.Kernel", "lock"
    if "UPDATE" in name and endless_update:
        return f"{pid}->UPDATE", "endless"
    return f"{pid}->{cat}", "plain"


@lru_cache(maxsize=100_000)
def rank_of(name: str) -> int:
    """Replay priority by parts of the name; smaller goes first."""
    return next((rank for part, rank in PRIORITIES if part in name), LAST_PRIORITY)


@dataclass
class Delays:
    """Changes of durations: by node, else all computation, all communication, or all: (ms, factor)."""

    nodes: dict[str, tuple[float, float]] = field(default_factory=dict)
    computation: tuple[float, float] | None = None
    communication: tuple[float, float] | None = None
    all: tuple[float, float] | None = None

    def of(self, name: str) -> tuple[float, float]:
        if name in self.nodes:
            return self.nodes[name]
        cat = coarse(name)
        if self.computation and cat in ("operator", "ServerOp"):
            return self.computation
        if self.communication and cat == "Comm":
            return self.communication
        return self.all or (0.0, 1.0)


@dataclass
class Run:
    """One executed node: times in us, its place in the execution and the queue behind it."""

    node: int
    device: str
    start: float
    end: float
    seq: int
    queue: int


def replay(
    g: Graph,
    delays: Delays | None = None,
    steps: int = 1,
    endless_update: bool = False,
    arrivals: dict[str, str] | None = None,
    served: dict[str, list[str]] | None = None,
) -> tuple[list[Run], float, list[tuple[int, int]]]:
    """Runs the graph on virtual devices: the executed nodes, the time in ms, edges of execution order.

    The device with the earliest free time that has a ready node runs next
    (ties: the device that was made first); its queue is ordered by priority,
    then by readiness, then by arrival. A node starts when it is ready and its
    device free; gaps between nodes of one category keep the device busy, the
    gap from computation to communication delays the successor. The parts of
    a tensor's synchronisation hold their device until the last one has run;
    others wait in turn. With several steps clocks go on.

    Parameter servers take pushes in the order in which the replay runs them:
    ``arrivals`` gives a push its tensor at a server, ``served`` that tensor's operations
    (first copy, then sums); each push that ends lets the next of them go,
    which waits for it beside its own predecessors.
    """
    delays = delays or Delays()
    n = len(g.names)
    where = [device_of(x, endless_update) for x in g.names]
    ids: dict[str, int] = {}
    for d, _ in where:
        ids.setdefault(d, len(ids))
    device = [ids[d] for d, _ in where]
    kind = {ids[d]: k for d, k in where}
    free = [0.0] * len(ids)
    last = [-1] * len(ids)
    lock: list[str | None] = [None] * len(ids)
    blocked: list[list[tuple[int, float]]] = [[] for _ in ids]
    names = list(ids)
    tensor = [x.split("->", 1)[-1].rsplit(".", 1)[0] for x in g.names]
    final = [KERNEL_PARTS[-1] in x for x in g.names]
    rank = [rank_of(x) for x in g.names]
    cats = [coarse(x) for x in g.names]
    ended: dict[str, float] = {}
    runs: list[Run] = []
    order_edges: list[tuple[int, int]] = []
    have = {(u, v) for u in range(n) for v in g.succ[u]}
    at_name = {x: i for i, x in enumerate(g.names)}
    serial = 0
    for _ in range(steps):
        left = [len(p) for p in g.pred]
        waiting = {k: [at_name[x] for x in ops if x in at_name] for k, ops in (served or {}).items()}
        for ops in waiting.values():
            for i in ops:
                left[i] += 1
        ready: list[float | None] = [None] * n
        queues: list[list[tuple[int, float, int, int]]] = [[] for _ in ids]
        heads: list[tuple[float, int]] = []

        def put(i: int, t: float) -> None:
            nonlocal serial
            serial += 1
            d = device[i]
            heapq.heappush(queues[d], (rank[i], t, serial, i))
            heapq.heappush(heads, (free[d], d))

        for i in range(n):
            if left[i] == 0:
                put(i, ended.get(pid_of(g.names[i]), 0.0))
        while heads or any(blocked):
            if not heads:  # tensors without a last part leave others waiting; these run in turn
                for d, held in enumerate(blocked):
                    lock[d] = None
                    if held:
                        put(*held.pop(0))
            t, d = heapq.heappop(heads)
            if not queues[d] or t != free[d]:
                if queues[d] and t < free[d]:
                    heapq.heappush(heads, (free[d], d))
                continue
            _, at, _, i = heapq.heappop(queues[d])
            if kind[d] == "lock":
                if lock[d] not in (None, tensor[i]):
                    blocked[d].append((i, at))
                    if queues[d]:
                        heapq.heappush(heads, (free[d], d))
                    continue
                lock[d] = tensor[i]
            start = at if kind[d] == "endless" else max(at, free[d])
            shift, factor = delays.of(g.names[i])
            end = start + 1000.0 * max(g.avg[i] + shift, 0.0) * factor
            if last[d] >= 0 and kind[d] != "endless" and (last[d], i) not in have:
                if not ("BW" in g.names[last[d]] and "UPDATE_" in g.names[i]):
                    order_edges.append((last[d], i))
            last[d] = i
            gap = sum(v for k, v in g.gaps[i].items() if len(set(k.split("GAP"))) == 1 and k != "INTERNODEGAP")
            free[d] = end + max(gap, 0.0)
            ended[pid_of(g.names[i])] = end
            runs.append(Run(i, names[d], start, end, len(runs), len(queues[d])))
            turn = waiting.get((arrivals or {}).get(g.names[i], ""), [])
            for v in [*g.succ[i], *turn[:1]]:
                wait = 0.0
                if cats[v] == "Comm" and (cats[i] == "operator" or "Sync" in g.names[i]):
                    wait = g.gaps[i].get("operatorGAPComm", 0.0)
                ready[v] = max(ready[v] if ready[v] is not None else 0.0, end + wait)
                left[v] -= 1
                if left[v] == 0:
                    put(v, ready[v])
            del turn[:1]
            if kind[d] == "lock" and final[i]:
                lock[d] = None
                if blocked[d]:
                    put(*blocked[d].pop(0))
            if queues[d]:
                heapq.heappush(heads, (free[d], d))
    return runs, max(ended.values(), default=0.0) / 1000.0, list(dict.fromkeys(order_edges))


# ---------------------------------------------------------------- rewrites


def reaches(g: Graph, u: int, v: int, skip_direct: bool = False) -> bool:
    """Whether a path leads from u to v, other than the edge itself if ``skip_direct``.

    Nodes behind v in topological order can't lead to it and are passed over,
    so neighbours cost little, however large the graph.
    """
    place = g.places()
    stack = [x for x in g.succ[u] if not (skip_direct and x == v) and place[x] <= place[v]]
    seen = set(stack)
    while stack:
        x = stack.pop()
        if x == v:
            return True
        for y in g.succ[x]:
            if y not in seen and place[y] <= place[v]:
                seen.add(y)
                stack.append(y)
    return False


def contractible(g: Graph, u: int, v: int) -> bool:
    """Two neighbours may become one node unless that closes a cycle."""
    return v in g.succ[u] and not reaches(g, u, v, skip_direct=True)


def contract(g: Graph, u: int, v: int, avg: float | None = None) -> Graph:
    """The graph with u and v as one node, named by both; gaps are the larger ones."""
    name = f"{g.names[u]}+{g.names[v].split('->', 1)[-1]}"
    gaps = {k: max(g.gaps[u].get(k, 0.0), g.gaps[v].get(k, 0.0)) for k in {*g.gaps[u], *g.gaps[v]}}
    avg = g.avg[u] + g.avg[v] if avg is None else avg
    if name in g.names:  # a node that has the new name already is the same node
        names = [name if i == u else x for i, x in enumerate(g.names)]
        rename = lambda i: u if i == v else i
        edges = {(rename(a), rename(b)) for a in range(len(names)) for b in g.succ[a] if rename(a) != rename(b)}
        keep = [i for i in range(len(names)) if i != v]
        nodes = [(names[i], avg if i == u else g.avg[i]) for i in keep]
        found = {names[i]: (gaps if i == u else g.gaps[i]) for i in keep}
        return Graph.build(nodes, [(names[a], names[b]) for a, b in sorted(edges)], found)
    rest = lambda x, own: [own if i == u else y for i, y in enumerate(x) if i != v]
    place = [i - (i > v) for i in range(len(g.names))]
    place[v] = place[u]
    both = [*g.succ[u], *g.succ[v]]
    succ = [sorted({place[y] for y in x}) for x in rest(g.succ, [y for y in both if place[y] != place[u]])]
    pred: list[list[int]] = [[] for _ in succ]
    for a, x in enumerate(succ):
        for b in x:
            pred[b].append(a)
    return Graph(rest(g.names, name), [float(x or 0.0) for x in rest(g.avg, avg)], succ, pred, [dict(x) for x in rest(g.gaps, gaps)])


def clusters(g: Graph, most: int, allowed: Callable[[int], bool] = lambda i: True) -> list[list[int]]:
    """Groups of neighbours of at most ``most`` nodes that can be contracted without a cycle, in post order.

    A node joins its predecessor's group if every path into it from the group
    is an edge: then all its predecessors outside come before the group.
    """
    order, _ = g.order()
    level = {x: i for i, x in enumerate(order)}
    group = {x: x for x in order}
    size = {x: 1 for x in order}
    first = {x: level[x] for x in order}
    last = {x: level[x] for x in order}
    for v in order:
        if not allowed(v):
            continue
        for u in sorted(g.pred[v], key=lambda x: -level[x]):
            a = group[u]
            if not allowed(u) or size[a] >= most or size[group[v]] != 1 or group[v] == a:
                continue
            # outside predecessors between the group's first node and v could close a cycle
            if all(group[p] == a or level[p] < first[a] for p in g.pred[v]):
                group[v] = a
                size[a] += 1
                last[a] = level[v]
                break
    out: dict[int, list[int]] = {}
    for x in order:
        out.setdefault(group[x], []).append(x)
    return list(out.values())


def split_in_two(g: Graph, members: Sequence[int]) -> tuple[list[int], list[int]]:
    """A prefix of about half of the members by topological order, and the rest."""
    order, _ = g.order()
    own = [x for x in order if x in set(members)]
    return own[: len(own) // 2], own[len(own) // 2 :]


def shape_hash(g: Graph, labels: Sequence[str], rounds: int = 3) -> str:
    """Hash of a labelled graph that doesn't depend on the order of nodes."""
    cur = [hashlib.md5(x.encode()).hexdigest() for x in labels]
    for _ in range(rounds):
        cur = [
            hashlib.md5((cur[i] + "".join(sorted(cur[p] for p in g.pred[i])) + "|" + "".join(sorted(cur[s] for s in g.succ[i]))).encode()).hexdigest()
            for i in range(len(cur))
        ]
    return hashlib.md5("".join(sorted(cur)).encode()).hexdigest()


# ----------------------------------------------------------------- samples


def forest_fire(g: Graph, size: int, burn: float, seed: int) -> list[int]:
    """Nodes reached by fires that spread to each neighbour with probability ``burn``."""
    rng = random.Random(seed)
    found: dict[int, None] = {}
    while len(found) < min(size, len(g.names)):
        start = rng.randrange(len(g.names))
        front = [start]
        found.setdefault(start)
        while front and len(found) < size:
            x = front.pop(0)
            for y in sorted({*g.succ[x], *g.pred[x]}):
                if y not in found and rng.random() < burn and len(found) < size:
                    found.setdefault(y)
                    front.append(y)
    return sorted(found)


def random_walk(g: Graph, size: int, restart: float, seed: int) -> list[int]:
    """Nodes of a walk along edges of either direction, with restarts."""
    rng = random.Random(seed)
    home = cur = rng.randrange(len(g.names))
    found = {cur: None}
    for _ in range(50 * size):
        if len(found) >= min(size, len(g.names)):
            break
        near = sorted({*g.succ[cur], *g.pred[cur]})
        if not near:
            home = cur = rng.randrange(len(g.names))
        else:
            cur = home if rng.random() < restart else rng.choice(near)
        found.setdefault(cur)
    return sorted(found)


# ------------------------------------------------------------------ search


@dataclass
class Outcome:
    """What a search found: the least cost, the accepted steps and all costs tried."""

    best: float
    steps: list[Move]
    tried: list[float]


#: A step of a strategy: its token and the nodes that it works on.
#: ``+`` fuses two operations, ``++`` two transfers, ``--`` splits a transfer, ``>`` runs an operation in half precision.
Move = tuple[str, ...]


@dataclass(frozen=True)
class MoveRules:
    tokens: tuple[str, ...] = ("+",)
    saving: float = 0.8  # time of a fused operation, of the sum
    overhead_ms: float = 0.05  # of a transfer, whatever its size
    half: float = 0.5  # time in half precision
    cast_ms: float = 0.01
    half_types: tuple[str, ...] = ("Conv2D", "MatMul")


def may_fuse(g: Graph, u: int, v: int) -> bool:
    """Neighbours of one device and category, no communication, whose fusion closes no cycle."""
    cat = coarse(g.names[u])
    return cat not in ("Comm", "virtual", "none") and pid_of(g.names[u]) == pid_of(g.names[v]) and cat == coarse(g.names[v]) and contractible(g, u, v)


def _part(name: str) -> str:
    """The sub-operation of a communication's name."""
    return name.split("~>", 1)[0].rsplit(".", 1)[-1]


def moves_of(g: Graph, rules: MoveRules = MoveRules(), of: set[str] | None = None) -> list[Move]:
    """All steps that a graph allows, of the nodes of ``of`` if given, in the order of their texts."""
    out: list[Move] = []
    for u, name in enumerate(g.names):
        for v in g.succ[u]:
            other = g.names[v]
            if of is not None and name not in of and other not in of:
                continue
            if "+" in rules.tokens and may_fuse(g, u, v):
                out.append(("+", name, other))
            same = "++" in rules.tokens and coarse(name) == coarse(other) == "Comm" and pid_of(name) == pid_of(other) and _part(name) == _part(other)
            if same and "Sync" not in name and g.avg[u] > 0 and g.avg[v] > 0 and contractible(g, u, v):
                out.append(("++", name, other))
        if of is not None and name not in of:
            continue
        if "--" in rules.tokens and coarse(name) == "Comm" and "Sync" not in name and g.avg[u] > 2 * rules.overhead_ms and "#" not in name:
            out.append(("--", name))
        typed = name.split("~>", 1)[0].rsplit("/", 1)[-1].rsplit("_", 1)[0] if "/" in name else ""
        if ">" in rules.tokens and coarse(name) == "operator" and "#" not in name and typed in rules.half_types:
            out.append((">", name))
    return sorted(set(out))


def fuse_moves(g: Graph) -> list[tuple[str, str]]:
    """Pairs of operations that may be fused."""
    return [m[1:] for m in moves_of(g)]


def apply_move(g: Graph, move: Move, rules: MoveRules = MoveRules()) -> Graph:
    """The graph after a step; ValueError where its nodes are gone."""
    at = {n: i for i, n in enumerate(g.names)}
    if not all(n in at for n in move[1:]):
        raise ValueError(f"no such nodes: {move}")
    u = at[move[1]]
    if move[0] == "+":
        return contract(g, u, at[move[2]], rules.saving * (g.avg[u] + g.avg[at[move[2]]]))
    if move[0] == "++":  # one overhead is saved
        return contract(g, u, at[move[2]], max(g.avg[u] + g.avg[at[move[2]]] - rules.overhead_ms, 0.0))
    if move[0] == "--":  # two halves, each with an overhead; what follows waits for both
        half = rules.overhead_ms + (g.avg[u] - rules.overhead_ms) / 2
        first, second = f"{move[1]}#0", f"{move[1]}#1"
        parts = lambda i: [first, second] if i == u else [g.names[i]]
        nodes = [(n, half if i == u else g.avg[i]) for i in range(len(g.names)) for n in parts(i)]
        edges = [(a, b) for i in range(len(g.names)) for j in g.succ[i] for a in parts(i) for b in parts(j)]
        return Graph.build(nodes, edges, {n: g.gaps[i] for i in range(len(g.names)) for n in parts(i)})
    if move[0] == ">":
        low = quantise(g, {move[1]}, rules.half, rules.cast_ms)
        low.names[low.names.index(move[1])] = f"{move[1]}#fp16"
        return low
    raise ValueError(f"no token {move[0]}")


def apply_all(g: Graph, moves: Sequence[Move], rules: MoveRules = MoveRules()) -> Graph:
    """A recorded strategy, step by step."""
    for m in moves:
        g = apply_move(g, m, rules)
    return g


def written(moves: Sequence[Move]) -> list[str]:
    return [" ".join(m) for m in moves]


def accept_probability(beta: float, step: int, cost: float, new: float) -> float:
    """Chance to take a step that may be worse; it falls as the search goes on."""
    return min(1.0, math.exp(min(0.0, beta * math.log(step + 1) * (cost - new))))


def heat_of(history: list[tuple[int, float]], step: int, window: int = 5) -> float:
    """Heat of a node from its last gains (step, gain), the later the more; 0 without any."""
    last = history[-window:]
    return sum((math.exp(h) - 1) / (step + 1 - t) for t, h in last) / len(last) if last else 0.0


class PlainState:
    """A graph under search with any steps: each is applied and replayed anew."""

    def __init__(self, g: Graph, rules: MoveRules, new: Sequence[str] = ()):
        self.g, self.rules, self.new = g, rules, new
        self.cost = replay(g)[1]

    def moves(self) -> list[Move]:
        return moves_of(self.g, self.rules)

    def moves_from(self, name: str) -> list[Move]:
        return [m for m in moves_of(self.g, self.rules, {name}) if m[1] == name]

    def moves_on_path(self) -> list[Move]:
        return moves_of(self.g, self.rules, {n for n, _ in longest_path(self.g, lambda u, v: node_cost(self.g, u, v))})

    def after(self, move: Move) -> PlainState:
        g = apply_move(self.g, move, self.rules)
        return PlainState(g, self.rules, list(set(g.names) - set(self.g.names)))


class FusedState:
    """A graph without cycles under search with fusions only; gives what ``PlainState`` does, in a fraction of its time.

    A fused node stays in the place of its first operation, the other's place
    is left dead, so a step copies lists and changes the two nodes' neighbours
    only. What names say is read once: a fused name holds both names, of one
    device, so its category and device are theirs and its priority the
    smaller. Descendants are bit sets. A step makes an edge (a, b) of other
    nodes impossible if a leads to the fused node and that to b, and allows
    none; so moves are carried on from the graph before. Moves, descendants
    and the time of a state are worked out when asked for.
    """

    parent: FusedState | None = None
    pair = (-1, -1)
    new: Sequence[str] = ()
    _cost: float | None = None
    _below: list[int] | None = None
    _moves: list[tuple[Move, int, int]] | None = None

    @classmethod
    def root(cls, g: Graph, rules: MoveRules) -> FusedState:
        s = cls.__new__(cls)
        s.rules = rules
        s.names, s.avg, s.succ, s.gaps = list(g.names), list(g.avg), [sorted(x) for x in g.succ], g.gaps
        s.pred = [sorted(x) for x in g.pred]
        s.given = g.succ, g.pred  # in the order of the edges, which decides ties; a step puts all in order
        s.left = [len(p) for p in g.pred]
        s.at = {n: i for i, n in enumerate(g.names)}
        s.fused: dict[str, int] = {}
        where = [device_of(x) for x in g.names]
        first: dict[str, int] = {}
        for i, (d, _) in enumerate(where):
            first.setdefault(d, i)
        s.dev = [first[d] for d, _ in where]
        s.locks = {first[d] for d, k in where if k == "lock"}
        pids: dict[str, int] = {}
        s.pid = [pids.setdefault(pid_of(x), len(pids)) for x in g.names]
        s.pids = len(pids)
        s.tensor = [x.split("->", 1)[-1].rsplit(".", 1)[0] for x in g.names]
        s.final = [KERNEL_PARTS[-1] in x for x in g.names]
        s.rank = [rank_of(x) for x in g.names]
        s.cats = [coarse(x) for x in g.names]
        s.comm = [c == "Comm" for c in s.cats]
        s.lets = [c == "operator" or "Sync" in x for c, x in zip(s.cats, g.names)]
        s.dur, s.gap, s.wait, s.out = ([0.0] * len(g.names) for _ in range(4))
        for i in range(len(g.names)):
            s._measure(i)
        return s

    def _measure(self, i: int) -> None:
        """What a replay and a path take from a node's time and gaps."""
        gaps = self.gaps[i]
        self.dur[i] = 1000.0 * max(self.avg[i], 0.0)
        self.gap[i] = self.wait[i] = 0.0
        self.out[i] = None
        if gaps:
            self.gap[i] = max(sum(v for k, v in gaps.items() if len(set(k.split("GAP"))) == 1), 0.0)
            self.wait[i] = gaps.get("operatorGAPComm", 0.0) if self.lets[i] else 0.0
            to: dict[str, float] = {}
            for k, v in gaps.items():
                a, *b = k.split("GAP")
                if a == self.cats[i] and len(b) == 1:
                    to[b[0]] = to.get(b[0], 0.0) + v
            self.out[i] = to

    def after(self, move: Move) -> FusedState:
        u, v = self._place(move[1]), self._place(move[2])
        s = FusedState.__new__(FusedState)
        s.__dict__.update(self.__dict__)
        s.parent, s.pair, s._cost, s._below, s._moves = self, (u, v), None, None, None
        for k in ("names", "avg", "succ", "pred", "gaps", "left", "rank", "lets", "dur", "gap", "wait", "out"):
            setattr(s, k, getattr(self, k)[:])
        s.names[u] = f"{self.names[u]}+{self.names[v].split('->', 1)[-1]}"
        s.new = (s.names[u],)
        s.fused = {**self.fused, s.names[u]: u}
        s.avg[u] = self.rules.saving * (self.avg[u] + self.avg[v])
        a, b = self.gaps[u], self.gaps[v]
        s.gaps[u] = {k: max(a.get(k, 0.0), b.get(k, 0.0)) for k in {*a, *b}} if a or b else a
        s.rank[u] = min(self.rank[u], self.rank[v])
        s.lets[u] = self.lets[u] or self.lets[v]
        s._measure(u)
        s.succ[u] = sorted({*self.succ[u], *self.succ[v]} - {u, v})
        s.pred[u] = sorted({*self.pred[u], *self.pred[v]} - {u, v})
        s.left[u] = len(s.pred[u])
        s.names[v], s.succ[v], s.pred[v], s.left[v] = "", [], [], -1
        for x in self.pred[v]:
            if x != u:
                s.succ[x] = sorted({u if y == v else y for y in self.succ[x]})
        for x in self.succ[v]:
            s.pred[x] = sorted({u if y == v else y for y in self.pred[x]})
            s.left[x] = len(s.pred[x])
        s.given = s.succ, s.pred
        if self.dev[v] == v:  # the device is known by its first node
            rest = min(i for i, d in enumerate(self.dev) if d == v and s.left[i] >= 0)
            s.dev = [rest if d == v else d for d in self.dev]
        return s

    def _run(self) -> None:
        """The time of a replay, and its order; see ``replay``. A device with waiting nodes has one entry among the heads."""
        dev, rank, dur, gap, wait, comm, succ, pid = self.dev, self.rank, self.dur, self.gap, self.wait, self.comm, self.given[0], self.pid
        left, locks, tensor = self.left[:], self.locks, self.tensor
        push, pop = heapq.heappush, heapq.heappop
        ready, free = [0.0] * len(left), [0.0] * len(left)
        queues: list[list] = [[] for _ in left]
        lock: dict[int, str | None] = dict.fromkeys(locks)
        blocked: dict[int, list[tuple[int, float]]] = {d: [] for d in sorted(locks)}
        heads: list[tuple[float, int]] = []
        ended, ends, order, serial = [0.0] * self.pids, [0.0] * len(left), [], 0
        for i, n in enumerate(left):
            if n == 0:
                d = dev[i]
                serial += 1
                if not queues[d]:
                    push(heads, (0.0, d))
                push(queues[d], (rank[i], 0.0, serial, i))
        while heads or any(blocked.values()):
            if not heads:
                for d, held in blocked.items():
                    lock[d] = None
                    if held:
                        i, at = held.pop(0)
                        serial += 1
                        push(heads, (free[d], d))
                        push(queues[d], (rank[i], at, serial, i))
            now, d = pop(heads)
            queue = queues[d]
            _, at, _, i = pop(queue)
            if d in locks:
                if lock[d] not in (None, tensor[i]):
                    blocked[d].append((i, at))
                    if queue:
                        push(heads, (now, d))
                    continue
                lock[d] = tensor[i]
            end = (at if at > now else now) + dur[i]
            free[d] = now = end + gap[i]
            ended[pid[i]] = ends[i] = end
            order.append(i)
            later = end + wait[i]
            for v in succ[i]:
                t = later if comm[v] else end
                if t > ready[v]:
                    ready[v] = t
                left[v] -= 1
                if left[v] == 0:
                    e = dev[v]
                    serial += 1
                    if e != d and not queues[e]:
                        push(heads, (free[e], e))
                    push(queues[e], (rank[v], ready[v], serial, v))
            if d in locks and self.final[i]:
                lock[d] = None
                if blocked[d]:
                    i, at = blocked[d].pop(0)
                    serial += 1
                    push(queue, (rank[i], at, serial, i))
            if queue:
                push(heads, (now, d))
        self._cost, self._order = max(ended, default=0.0) / 1000.0, order
        self._settle(ends)

    def _settle(self, ends: list[float]) -> None:
        """Each node's place on its device from a run, and what ``_carry`` carries on, if that gives the times of the run."""
        n = len(self.left)
        self._prev, self._next, self._loose = [-1] * n, [-1] * n, []
        last: dict[int, int] = {}
        self._end = None
        below = self.below()
        for i in self._order:
            q = last.get(self.dev[i], -1)
            if q >= 0:
                self._prev[i], self._next[q] = q, i
                if not below[q] >> i & 1:
                    self._loose.append(i)
            last[self.dev[i]] = i
        if any(self.dev[i] in self.locks for i in self._loose):
            return
        self._clash = [self.dev[i] in self.locks and q >= 0 and not self.final[q] and self.tensor[q] != self.tensor[i] for i, q in enumerate(self._prev)]
        self._last: list[list[int]] = [[] for _ in range(self.pids)]
        for i in last.values():
            self._last[self.pid[i]].append(i)
        self._last = [[i for i in x if not any(below[i] >> y & 1 for y in x)] for x in self._last]
        self._end, self._free, self._key, self._phase = [-1.0] * n, [0.0] * n, [0.0] * n, [0] * n
        self._follow(self._order, bytearray(b"\1") * n)
        if any(self._end[i] != ends[i] for i in self._order) or self._slack() or self._told() not in (None, self._cost):
            self._end = None

    def _follow(self, order: Iterable[int], dirty: bytearray) -> None:
        """Works out the dirty nodes in topological order, and those that they change.

        Each device runs its nodes in a known order, so a node starts when its
        predecessors and the node before it on the device allow. For the order
        of execution, a node's key is the time at which its device is free, or
        the largest key that has to go before: of two nodes the one with the
        smaller key runs first. A node that another tensor keeps from its
        device is let in when nothing else can run, which begins a phase.
        """
        end, free, key, phase, prev, after, clash = self._end, self._free, self._key, self._phase, self._prev, self._next, self._clash
        pred, succ, comm, wait, dur, gap = self.pred, self.succ, self.comm, self.wait, self.dur, self.gap
        for i in order:
            if not dirty[i]:
                continue
            q = prev[i]
            f = free[q] if q >= 0 else 0.0
            at = k = 0.0
            ph = 0
            waits = comm[i]
            for x in pred[i]:
                t = end[x] + wait[x] if waits else end[x]
                if t > at:
                    at = t
                px = phase[x]
                if px > ph:
                    ph, k = px, key[x]
                elif px == ph and key[x] > k:
                    k = key[x]
            if clash[i] and phase[q] == ph:
                ph += 1
                k = 0.0
            if f > k:
                k = f
            e = (at if at > f else f) + dur[i]
            f = e + gap[i]
            if e != end[i] or f != free[i] or k != key[i] or ph != phase[i]:
                end[i], free[i], key[i], phase[i] = e, f, k, ph
                for y in succ[i]:
                    dirty[y] = 1
                if after[i] >= 0:
                    dirty[after[i]] = 1

    def _slack(self) -> bool:
        """Whether the order on a device isn't sure, where no path tells it: a node has to have run before the next is ready."""
        for i in self._loose:
            q, ph = self._prev[i], self._phase[i]
            if self._phase[q] == ph and self._key[q] >= max((self._key[x] for x in self.pred[i] if self._phase[x] == ph), default=0.0):
                return True
        return False

    def _told(self) -> float | None:
        """The time of the replay: the latest end of what ran last of each process; None if keys don't tell which did."""
        end, out, open_ = self._end, 0.0, []
        for nodes in self._last:
            if len(nodes) == 1:
                out = max(out, end[nodes[0]])
            elif nodes:
                open_.append(nodes)
        for nodes in open_:
            if max([end[i] for i in nodes]) > out:
                marks = [(self._phase[i], self._key[i]) for i in nodes]
                top = max(marks)
                if marks.count(top) > 1:
                    ends = {end[i] for i, m in zip(nodes, marks) if m == top}
                    if len(ends) > 1:
                        return None
                out = max(out, end[nodes[marks.index(top)]])
        return out / 1000.0

    def _carry(self) -> bool:
        """The times of the state before, where the step changes them; False if they can't be carried on."""
        p = self.parent
        if p is None or p._cost is None or p._end is None:
            return False
        u, v = self.pair
        if p._prev[v] != u:
            return False
        order = p._order
        a, b = order.index(u), order.index(v)
        below = p.below()[u]
        between = order[a + 1 : b]
        behind = [x for x in between if below >> x & 1]
        if behind and self._loose:
            return False
        self._order = order = order[:a] + [x for x in between if not below >> x & 1] + [u] + behind + order[b + 1 :]
        self._end, self._free, self._key, self._phase = p._end[:], p._free[:], p._key[:], p._phase[:]
        self._end[u] = -1.0
        self._prev, self._next = p._prev[:], p._next[:]
        x = self._next[u] = p._next[v]
        self._prev[v] = self._next[v] = -1
        if x >= 0:
            self._prev[x] = u
        if x < 0:
            self._last = [[u if i == v else i for i in nodes] for nodes in p._last]
        dirty = bytearray(len(self.left))
        dirty[u] = 1
        self._follow(order[a:], dirty)
        return not self._slack()

    @property
    def cost(self) -> float:
        if self._cost is None:
            cost = self._told() if self._carry() else None
            if cost is None:
                self._run()
            else:
                self._cost = cost
        return self._cost

    def below(self) -> list[int]:
        """Descendants of each node as bits."""
        if self._below is None:
            if self.parent is None:
                self.cost
                out = [0] * len(self.names)
                for u in reversed(self._order):
                    d = 0
                    for v in self.succ[u]:
                        d |= out[v] | 1 << v
                    out[u] = d
            else:
                u, v = self.pair
                old = self.parent.below()
                gone, either, one = ~(1 << v), 1 << u | 1 << v, 1 << u
                own = (old[u] | old[v]) & ~either
                more = own | one
                out = [(d | more) & gone if d & either else d for d in old]
                out[u], out[v] = own, 0
            self._below = out
        return self._below

    def _may(self, u: int, v: int) -> bool:
        """See ``may_fuse``."""
        cat = self.cats[u]
        if cat != self.cats[v] or self.pid[u] != self.pid[v] or cat in ("Comm", "virtual", "none"):
            return False
        below = self.below()
        return not any(below[x] >> v & 1 for x in self.succ[u] if x != v)

    def _place(self, name: str) -> int:
        """The node of that name, -1 if it is gone."""
        i = self.at.get(name, -1)
        i = i if i >= 0 else self.fused.get(name, -1)
        return i if i >= 0 and self.names[i] == name else -1

    def _near(self, name: str) -> list[tuple[Move, int, int]]:
        u = self._place(name)
        return sorted((("+", name, self.names[v]), u, v) for v in self.succ[u] if self._may(u, v)) if u >= 0 else []

    def _all(self) -> list[tuple[Move, int, int]]:
        if self._moves is None:
            names, succ = self.names, self.succ
            if self.parent is None or self.parent._moves is None:
                self._moves = sorted((("+", names[u], names[v]), u, v) for u in range(len(names)) for v in succ[u] if self._may(u, v))
            else:
                u, v = self.pair
                old = self.parent.below()
                to = old[u]
                out = [m for m in self.parent._moves if m[1] not in (u, v) and m[2] not in (u, v) and not (to >> m[2] & 1 and old[m[1]] >> v & 1)]
                for x in succ[u]:
                    if self._may(u, x):
                        insort(out, (("+", names[u], names[x]), u, x))
                for x in self.pred[u]:
                    if self._may(x, u):
                        insort(out, (("+", names[x], names[u]), x, u))
                self._moves = out
        return self._moves

    def moves(self) -> list[Move]:
        return [m for m, _, _ in self._all()]

    def moves_from(self, name: str) -> list[Move]:
        return [m for m, _, _ in self._near(name)]

    def moves_on_path(self) -> list[Move]:
        on = set(self._path())
        return [m for m, u, v in self._all() if u in on or v in on]

    def _path(self) -> list[int]:
        """See ``longest_path``, with the costs of ``node_cost``."""
        self.cost
        avg, out, cats, pred = self.avg, self.out, self.cats, self.given[1]
        best, via = [0.0] * len(avg), [-1] * len(avg)
        for v in self._order:
            b, w = 0.0, -1
            for u in pred[v]:
                total = best[u] + (avg[u] if out[u] is None else avg[u] + out[u].get(cats[v], 0.0) / 1000.0)
                if w < 0 or total > b:
                    b, w = total, u
            best[v], via[v] = b, w
        most = max(best[i] for i in self._order)
        ends = [i for i in self._order if best[i] == most]
        end = ends[0]
        if len(ends) > 1:
            end = next(i for i in Graph([], [], *self.given, []).ordered(self.left[:]) if best[i] == most)
        path = [end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        return path


def searched(g: Graph, rules: MoveRules) -> PlainState | FusedState:
    """The first state of a search."""
    plain = rules.tokens != ("+",) or g.order()[1] or any("INTERNODEGAP" in x for x in g.gaps)
    return PlainState(g, rules) if plain else FusedState.root(g, rules)


def mcmc(
    g: Graph, rounds: int | None, beta: float = 10.0, seed: int = 0, rules: MoveRules = MoveRules(), patience: int = 15, root: PlainState | FusedState | None = None
) -> Outcome:
    """Random search over steps at nodes of the critical path, scored by replay.

    Moves of nodes whose last moves paid are drawn more often (their heat).
    Ends after ``rounds``, or without them when ``patience`` rounds in a row
    have found nothing better. ``root``: the graph's first state, if there is one.
    """
    rng = random.Random(seed)
    history: dict[str, list[tuple[int, float]]] = {}
    cur = root or searched(g, rules)
    cost = cur.cost
    best, steps, tried, taken = cost, [], [cost], []
    step = found = 0
    moves: list[Move] | None = None
    tries: dict[Move, PlainState | FusedState] = {}  # of the present state
    warm: dict[int, Move] = {}  # moves of nodes with a history
    while step < rounds if rounds is not None else step - found < patience:
        step += 1
        if moves is None:
            moves, tries, warm = cur.moves_on_path(), {}, {}
            weights = [1.0] * len(moves)
            for k, m in enumerate(moves):
                if any([x in history for x in m[1:]]):
                    warm[k] = m
        if not moves:
            break
        heat: dict[str, float] = {}
        for k, m in warm.items():
            for x in m[1:]:
                if x not in heat:
                    heat[x] = heat_of(history.get(x, []), step)
            weights[k] = max(1e-3, 1.0 + sum([heat[x] for x in m[1:]]))
        move = rng.choices(moves, weights)[0]
        nxt = tries[move] = tries.get(move) or cur.after(move)
        new = nxt.cost
        tried.append(new)
        for x in (*move[1:], *nxt.new):
            if x not in history:
                history[x] = []
                warm.update((k, m) for k, m in enumerate(moves) if x in m[1:])
            history[x].append((step, max(-5.0, min(5.0, (cost - new) / max(cost, 1e-9)))))
        if rng.random() < accept_probability(beta, step, cost, new):
            cur, cost, moves = nxt, new, None
            taken.append(move)
            if cost < best:
                best, steps, found = cost, list(taken), step
    return Outcome(best, steps, tried)


class Branch:
    """A node of the search tree: its visits, the sum of its rewards, and by move its branches."""

    def __init__(self, state: PlainState | FusedState):
        self.state, self.visits, self.reward = state, 0, 0.0
        self.moves: list[Move] | None = None

    def open(self) -> list[Move]:
        """The moves, worked out when the branch is first gone through."""
        if self.moves is None:
            self.moves = self.state.moves()
            self.fresh = list(range(len(self.moves)))
            self.kids: list[Branch | None] = [None] * len(self.moves)
            self.counts, self.sums = np.zeros(len(self.moves)), np.zeros(len(self.moves))
        return self.moves


def mcts(
    g: Graph,
    loops: int | None,
    depth: int = 5,
    explore: float = 0.1,
    seed: int = 0,
    rules: MoveRules = MoveRules(),
    patience: int = 15,
    root: PlainState | FusedState | None = None,
) -> Outcome:
    """Tree search over steps: upper confidence bound, random completion, mean reward.

    Ends as ``mcmc`` does; without ``loops`` every first step is tried once
    before patience counts.
    """
    rng = random.Random(seed)
    top = Branch(root or searched(g, rules))
    base = top.state.cost
    first = len(top.open())
    best, steps, tried = base, [], [base]
    done, found = 0, first
    while done < loops if loops is not None else done - found < patience:
        done += 1
        at, path, chain = top, [], []
        while len(path) < depth and at.open():
            if at.fresh:
                k = rng.choice(at.fresh)
                at.fresh.remove(k)
                at.kids[k] = Branch(at.state.after(at.moves[k]))
            else:  # of equals the last in the order of moves
                worth = at.sums / at.counts + explore * np.sqrt(math.log(at.visits + 1) / at.counts)
                k = len(worth) - 1 - int(worth[::-1].argmax())
            path.append(at.moves[k])
            chain.append((at, k))
            at = at.kids[k]
            if not at.visits:
                break
        cost = at.state.cost
        tried.append(cost)
        if cost < best:
            best, steps, found = cost, list(path), max(done, first)
        gain = (base - cost) / base if base else 0.0
        top.visits += 1
        for branch, k in chain:
            branch.counts[k] += 1
            branch.sums[k] += gain
            branch.kids[k].visits += 1
    return Outcome(best, steps, tried)


def greedy_walk(g: Graph, patience: int = 5, least: float = 0.001, rules: MoveRules = MoveRules(), root: PlainState | FusedState | None = None) -> Outcome:
    """Walks the nodes in topological order and keeps each step that is no worse.

    Ends after ``patience`` steps in a row with less than ``least`` of gain.
    """
    cur = root or searched(g, rules)
    cost = cur.cost
    tried, steps, idle = [cost], [], 0
    for name in [g.names[i] for i in g.order()[0]]:
        for move in cur.moves_from(name):
            nxt = cur.after(move)
            new = nxt.cost
            tried.append(new)
            if new <= cost:
                idle = idle + 1 if cost - new < least * cost else 0
                cur, cost = nxt, new
                steps.append(move)
                break
        if idle > patience:
            break
    return Outcome(cost, steps, tried)


def simple_paths(g: Graph, u: int, v: int, most: int = 10) -> list[list[str]]:
    """Up to ``most`` paths between two nodes, the shortest first; ties by name."""
    out: list[list[str]] = []
    heap: list[tuple[int, list[str], list[int]]] = [(1, [g.names[u]], [u])]
    while heap and len(out) < most:
        _, text, path = heapq.heappop(heap)
        if path[-1] == v:
            out.append(text)
            continue
        for x in g.succ[path[-1]]:
            if x not in path and (x == v or reaches(g, x, v)):
                heapq.heappush(heap, (len(path) + 1, [*text, g.names[x]], [*path, x]))
    return out


def recompute(g: Graph, keep: set[str]) -> Graph:
    """The graph whose forward outputs are kept at the nodes of ``keep`` only.

    Every other forward node that a backward node reads is run again
    (``…#again``) before it, from the kept nodes on; the backward nodes read
    the second run.
    """
    forward = {i for i, n in enumerate(g.names) if "->FW" in n or n.startswith("FW")}
    backward = {i for i, n in enumerate(g.names) if "->BW" in n or n.startswith("BW")}
    again = {u for u in forward if g.names[u] not in keep and any(v in backward for v in g.succ[u])}
    stack = list(again)
    while stack:  # what a repeated node reads and isn't kept is repeated as well
        u = stack.pop()
        for p in g.pred[u]:
            if p in forward and g.names[p] not in keep and p not in again:
                again.add(p)
                stack.append(p)
    name = lambda i: g.names[i] + "#again"
    nodes = [(n, a) for n, a in zip(g.names, g.avg)] + [(name(i), g.avg[i]) for i in sorted(again)]
    edges = []
    for u in range(len(g.names)):
        for v in g.succ[u]:
            if u in again and v in backward:
                edges.append((name(u), g.names[v]))
            else:
                edges.append((g.names[u], g.names[v]))
            if v in again and u in forward:
                edges.append((name(u) if u in again else g.names[u], name(v)))
    # a repeated node doesn't start before the forward pass has ended, but for what waits for it
    last = sorted(u for u in forward if not any(v in forward for v in g.succ[u]))
    chained = {i: sorted(x for x in again if x == i or reaches(g, i, x)) for i in again}
    for i in sorted(again):
        readers = [v for x in chained[i] for v in g.succ[x] if v in backward]
        edges += [(g.names[u], name(i)) for u in last if u != i and not any(v == u or reaches(g, v, u) for v in readers)]
    return Graph.build(nodes, edges, {n: gap for n, gap in zip(g.names, g.gaps)})


def layer_of(g: Graph, targets: dict[str, str]) -> dict[str, str]:
    """Layer of each node: that of the communications behind it, if they agree on one.

    ``targets`` gives communications their layer.
    """
    order, _ = g.order()
    seen: list[set[str]] = [set() for _ in g.names]
    for u in reversed(order):
        own = targets.get(g.names[u])
        seen[u] = {own} if own else set().union(*(seen[v] for v in g.succ[u])) if g.succ[u] else set()
    return {g.names[u]: next(iter(s)) for u, s in enumerate(seen) if len(s) == 1}


def fuse_tensors(sizes: list[tuple[str, float]], ready: list[float], slope: float, base: float) -> tuple[list[list[str]], float]:
    """Groups of neighbouring tensors that let a link end soonest: (groups, end in ms).

    A tensor of ``size`` takes ``slope * size + base``; a group starts when its
    last tensor is ready and the link free. Best splits by dynamic programming
    over the tensors in the order of readiness.
    """
    n = len(sizes)
    best, cut_at = [0.0] + [math.inf] * n, [0] * (n + 1)
    total = [0.0]
    for _, s in sizes:
        total.append(total[-1] + s)
    for j in range(1, n + 1):
        for i in range(j):
            end = max(best[i], max(ready[i:j])) + slope * (total[j] - total[i]) + base
            if end < best[j] - 1e-12:
                best[j], cut_at[j] = end, i
    groups, j = [], n
    while j:
        groups.append([t for t, _ in sizes[cut_at[j] : j]])
        j = cut_at[j]
    return groups[::-1], best[n]


def quantise(g: Graph, half: set[str], factor: float = 0.5, cast_ms: float = 0.01) -> Graph:
    """The graph with the nodes of ``half`` in half precision.

    They and the communications they lead to (queues apart) take ``factor`` of
    the time; every edge between the precisions gets a cast, one per node and
    direction.
    """
    low = {i for i, n in enumerate(g.names) if n in half}
    comm = {v for u in low for v in g.succ[u] if coarse(g.names[v]) == "Comm" and "QUEUE" not in g.names[v]}
    nodes = [(n, a * factor if i in low | comm else a) for i, (n, a) in enumerate(zip(g.names, g.avg))]
    edges, made = [], {}
    for u in range(len(g.names)):
        for v in g.succ[u]:
            a, b = g.names[u], g.names[v]
            if coarse(b) == "Comm" or coarse(a) == "Comm" or (u in low) == (v in low):
                edges.append((a, b))
                continue
            cast = f"{a}#{'full' if u in low else 'half'}"
            made[cast] = cast_ms
            edges += [(a, cast), (cast, b)]
    return Graph.build([*nodes, *made.items()], edges, {n: gap for n, gap in zip(g.names, g.gaps)})


def grow_batch(g: Graph, factor: int, scale: float = 0.8) -> Graph:
    """The graph with a batch ``factor`` times as large: computation takes ``factor * scale`` of the time."""
    work = lambda n: coarse(n) == "operator" and "UPDATE" not in n
    nodes = [(n, a * factor * scale if work(n) else a) for n, a in zip(g.names, g.avg)]
    edges = [(g.names[u], g.names[v]) for u in range(len(g.names)) for v in g.succ[u]]
    return Graph.build(nodes, edges, {n: gap for n, gap in zip(g.names, g.gaps)})

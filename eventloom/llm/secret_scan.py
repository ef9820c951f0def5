"""Secret scan: fixed patterns, and a probabilistic automaton inferred from labelled credentials that scores all other candidates.

The automaton is inferred in rounds. In each, all labelled values of the table run through what is known of it where they lie, and only
counts of symbols at its states come to the driver; so do those of its background and of what was held out. Nothing is sampled.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import materialize
from eventloom.llm.textvec import buffers, hashes, words

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential has as many characters as the shortest that the fixed patterns take, at least.
LEAST = 6
KINDS = ["assign", "access", "hex", "format"]

ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Public formats of credentials (prefix, alphabet of the rest, its length).
FORMATS = [
    ("AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
    ("ASIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
    ("AIza", ALNUM + "-_", 35),
    ("ghp_", ALNUM, 36),
    ("gho_", ALNUM, 36),
    ("glpat-", ALNUM + "-_", 20),
    ("npm_", ALNUM, 36),
    ("sk_live_", ALNUM, 24),
    ("xoxb-", "0123456789-", 24),
    ("eyJ", ALNUM + "-_", 60),
]
EXAMPLES_EACH = 100
#: A fifth of the labelled values and of the other candidates, by a hash, is held out of the fit.
FOLDS = 5
ALPHA = 0.05
#: Nats by which the automaton must beat the background, at least; where there are held-out candidates enough to tell, the bound is
#: raised until no more than this share of them passes.
MIN_RATIO = 6.0
FALSE_SHARE = 1e-3
SYMBOLS = 67
UNSEEN = 1e-5
PRIOR = 500
#: A round of the inference settles transitions that are at least 1 / SETTLED as frequent as the most frequent one.
SETTLED = 4
#: So many values or fewer are counted one by one.
FEW = 16
#: Ratios of what is held out are counted in steps of 1 / STEPS nats.
STEPS = 64
#: Characters at which a credential may be joined to other text.
JOINS = "=/.-_+"
#: The characters of credentials, numbered from 1; 0 is the end.
LETTERS = ALNUM + "_+/=.-"
N_CODES = len(LETTERS) + 1
CODES = np.zeros(256, np.int64)
CODES[[ord(c) for c in LETTERS]] = np.arange(1, N_CODES)


def labelled(each: int = EXAMPLES_EACH) -> list[str]:
    """Example credentials of the public formats, drawn by a fixed generator."""
    rng = np.random.default_rng(11)
    return [p + "".join(a[k] for k in rng.integers(0, len(a), n)) for p, a, n in FORMATS for _ in range(each)]


def counted(goes: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, n): how many of the values data[off[k]:off[k + 1]] show each pair of next symbols at each node, so that a very long value
    outweighs no others.

    A key is (node * N_CODES + symbol) * N_CODES + the symbol after it. Nodes are the states (rows of goes) and, numbered after them as
    state * N_CODES + symbol, the transitions that are not known yet (-1 in goes); there a value's way ends.
    """
    code = np.append(CODES[data], 0)
    symbol = lambda at, end: np.where(at < end, code[np.minimum(at, end)], 0)
    at, end, q, value = off[:-1], off[1:], np.zeros(len(off) - 1, np.int64), np.arange(len(off) - 1)
    most = np.int64((len(goes) * (N_CODES + 1)) * N_CODES**2)
    shown = [np.zeros(0, np.int64)]

    def add(node: np.ndarray, at: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
        first = symbol(at, end)
        shown.append(value * most + (node * N_CODES + first) * N_CODES + np.where(first > 0, symbol(at + 1, end), 0))
        return first

    while len(at) > FEW:
        c = add(q, at, end, value)
        on = c > 0
        at, end, q, c, value = at[on] + 1, end[on], q[on], c[on], value[on]
        to = goes[q, c]
        known = to >= 0
        add(len(goes) + (q * N_CODES + c)[~known], at[~known], end[~known], value[~known])
        at, end, q, value = at[known], end[known], to[known], value[known]
    table = goes.tolist() if len(at) else []
    for a, z, state, k in zip(at.tolist(), end.tolist(), q.tolist(), value.tolist()):  # the rest of the longest values, one by one
        rest, c, after = set(), int(symbol(a, z)), 0
        for i in range(a, z + 1):
            after = int(code[i + 1]) if i + 1 < z else 0
            rest.add((state * N_CODES + c) * N_CODES + after)
            if c:
                to_ = table[state][c]
                if to_ < 0:
                    rest.add(((len(table) + state * N_CODES + c) * N_CODES + after) * N_CODES + (int(code[i + 2]) if after and i + 2 < z else 0))
                    break
                state = to_
            c = after
        shown.append(np.array([k * most + key for key in rest], np.int64))
    return np.unique(np.unique(np.concatenate(shown)) % most, return_counts=True)


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, n) of two such counts together."""
    keys, place = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, place, np.concatenate((a[1], b[1])))
    return keys, n


def format_counts(goes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return counted(goes, *buffers(pa.array(labelled())))


class Background:
    """How likely other candidates are: even draws from SYMBOLS characters, or pairs of neighbouring characters counted in examples."""

    def __init__(self, counts: dict[str, int] | None = None):
        self.pairs: dict[str, float] | None = None
        if counts:
            before: dict[str, int] = {}
            for pair, n in counts.items():
                before[pair[0]] = before.get(pair[0], 0) + n
            # Counts are added to an even share of PRIOR characters, so that a few candidates do not make a background.
            self.unseen = {c: math.log(n + PRIOR) - math.log(PRIOR / SYMBOLS) for c, n in before.items()}
            self.pairs = {p: math.log(before[p[0]] + PRIOR) - math.log(n + PRIOR / SYMBOLS) for p, n in counts.items()}

    def step(self, was: str, c: str) -> float:
        """Minus the log-probability of c after `was`; ^ is the start."""
        if self.pairs is None:
            return math.log(SYMBOLS)
        got = self.pairs.get(was + c)
        return self.unseen.get(was, math.log(SYMBOLS)) if got is None else got

    def end(self, last: str, n: int) -> float:
        """Minus the log-probability of an end after n characters."""
        return math.log(n + 1) if self.pairs is None else self.step(last, "$")


def _losses(seen: np.ndarray, new: np.ndarray, bound: float) -> np.ndarray:
    """Log-likelihood that pooling a node's outgoing counts with those of each state loses, for each count of the smaller; infinite if their
    outgoing frequencies, or those after the same symbol, differ by more than Hoeffding's bound."""
    a, b = seen.sum(2), new.sum(1)
    na, nb = a.sum(1), b.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = (np.abs(a / na[:, None] - b / nb) > bound * (1 / np.sqrt(na) + 1 / np.sqrt(nb))[:, None]).any(1)
        own = np.flatnonzero(b[1:]) + 1
        x, y = a[:, own], b[own]
        after = np.abs(seen[:, own] / x[:, :, None] - new[own] / y[:, None]) > bound * (1 / np.sqrt(x) + 1 / np.sqrt(y))[:, :, None]
        apart |= (after & (x > 0)[:, :, None]).any((1, 2))
        p = (a + b) / (na + nb)[:, None]
        lost = np.where(a > 0, a * np.log(a / na[:, None] / p), 0).sum(1) + np.where(b > 0, b * np.log(b / nb / p), 0).sum(1)
    return np.where(apart, np.inf, lost / np.maximum(1, np.minimum(na, nb)))


class Automaton:
    """States with the log-probabilities of an end and of each next character, and the background that they are held against.

    counts gives what counted() does, over all examples, for any transitions.
    """

    def __init__(self, counts: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], background: Background, alpha: float = ALPHA):
        self.background = background
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        goes = np.full((1, N_CODES), -1, np.int64)
        while True:
            keys, n = counts(goes)
            node = keys // N_CODES**2
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            pairs = {int(node[a]): (keys[a:z] % N_CODES**2, n[a:z]) for a, z in zip(first, np.append(first[1:], len(keys)))}
            if all(k < len(goes) for k in pairs):
                break
            goes = self._round(goes, pairs, bound)
        self.states = list(range(len(goes)))
        self.logs = {}
        for q in self.states:
            own = np.bincount(pairs[q][0] // N_CODES, pairs[q][1], N_CODES)
            steps = {LETTERS[c - 1]: (math.log(own[c] / own.sum()), int(goes[q, c])) for c in np.flatnonzero(own) if c}
            self.logs[q] = (math.log(max(UNSEEN, own[0] / own.sum())), steps)

    @staticmethod
    def _round(goes: np.ndarray, pairs: dict[int, tuple[np.ndarray, np.ndarray]], bound: float) -> np.ndarray:
        """Gives the transitions that are not known yet, the most frequent first, a target: the compatible state that loses least
        likelihood, or else a state of its own. The start is no target. Rarer ones than SETTLED lets pass wait for a later round, when
        more is known of the states."""
        old = len(goes)

        def dense(k: int) -> np.ndarray:
            out = np.zeros(N_CODES**2)
            out[pairs[k][0]] = pairs[k][1]
            return out.reshape(N_CODES, N_CODES)

        seen, size = np.array([dense(k) for k in range(old)]), old
        often = {k: int(n.sum()) for k, (_, n) in pairs.items() if k >= old}
        least = max(often.values()) / SETTLED
        for k in sorted((k for k in often if often[k] >= least), key=lambda k: (-often[k], k)):
            q, c = divmod(k - old, N_CODES)
            new = dense(k)
            loss = _losses(seen[1:size], new, bound)
            if len(loss) and np.isfinite(loss.min()):
                to = int(loss.argmin()) + 1
                seen[to] += new
            else:
                to = size
                if size == len(seen):
                    seen = np.concatenate((seen, np.zeros_like(seen)))
                    goes = np.concatenate((goes, np.full((len(seen) - len(goes), N_CODES), -1, np.int64)))
                seen[to], size = new, size + 1
            goes[q, c] = to
        return goes[:size]

    def ratio(self, text: str) -> float:
        """Log-likelihood ratio of the automaton against the background; leaving the automaton costs UNSEEN and stays in place."""
        q, out, was = 0, 0.0, "^"
        for c in text:
            step = self.logs[q][1].get(c)
            out += self.background.step(was, c) + (step[0] if step else math.log(UNSEEN))
            q, was = step[1] if step else q, c
        return out + self.logs[q][0] + self.background.end(was, len(text))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(next state [state, byte], gain [state, byte], final gain [state], background [byte, byte], its end [byte]); byte 0 is the start."""
        place = {q: k for k, q in enumerate(self.states)}
        goes = np.repeat(np.arange(len(place))[:, None], 256, axis=1)
        gain = np.full((len(place), 256), math.log(UNSEEN))
        for q, (_, steps) in self.logs.items():
            for c, (value, to) in steps.items():
                goes[place[q], ord(c)], gain[place[q], ord(c)] = place[to], value
        final = np.array([self.logs[q][0] for q in self.states])
        name = lambda b: "^" if b == 0 else chr(b)
        pairs = np.array([[self.background.step(name(a), chr(b)) for b in range(256)] for a in range(256)])
        return goes, gain, final, pairs, np.array([self.background.step(name(a), "$") for a in range(256)])

    def ratios(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables: tuple) -> np.ndarray:
        """ratio() of each data[start:end], all at once, a character at a time."""
        goes, gain, final, pairs, last = tables
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        at, left = starts[order], size[order]
        q, was, out = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint8), np.zeros(len(at))
        for k in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -k, "left"))  # those longer than k
            c = data[at[:n] + k]
            out[:n] += pairs[was[:n], c] + gain[q[:n], c]
            q[:n], was[:n] = goes[q[:n], c], c
        out += final[q] + (last[was] if self.background.pairs is not None else np.log(left + 1))
        back = np.empty(len(at))
        back[order] = out
        return back

    def best(self, text: str, least: int = LEAST) -> tuple[float, int, int] | None:
        """(ratio, start, end) of the best of the sub-runs of `least` characters or more that start at the start or after a character of
        JOINS, and end at the end or before one; neither end is one of "./=".

        One pass with restarts: of two sub-runs in one state, one goes when no end can make it the better.
        """
        unseen, even = math.log(UNSEEN), self.background.pairs is None
        found, live, was = None, [], "^"  # live: (start, state, sum)
        for i, c in enumerate(text):
            if c not in "./=" and (i == 0 or text[i - 1] in JOINS):
                live.append((i, 0, self.background.step("^", c) - self.background.step(was, c)))
            cost = self.background.step(was, c)
            by: dict[int, list[tuple[int, float]]] = {}
            for start, q, out in live:
                step = self.logs[q][1].get(c)
                out += cost + (step[0] if step else unseen)
                by.setdefault(step[1] if step else q, []).append((start, out))
            live = []
            for q, got in by.items():
                kept: list[tuple[int, float]] = []
                for start, out in got:  # by start
                    # A later start that is ahead by more than the length's share stays ahead, once both are long enough.
                    ahead = lambda s: math.log((i + 2 - s) / (i + 2 - start)) if even else 0.0  # noqa: E731, B023
                    kept = [(s, o) for s, o in kept if out - o <= ahead(s) or i + 1 - start < least]
                    if not any(o >= out for s, o in kept):
                        kept.append((start, out))
                live += [(start, q, out) for start, out in kept]
            live.sort()
            was = c
            if c not in "./=" and (i + 1 == len(text) or text[i + 1] in JOINS):
                for start, q, out in live:
                    n = i + 1 - start
                    if n >= least:
                        value = out + self.logs[q][0] + self.background.end(c, n)
                        if found is None or value > found[0]:
                            found = (value, start, i + 1)
        return found

    def spans(self, text: str, min_ratio: float, least: int = LEAST) -> list[tuple[int, int]]:
        """(start, end) of the best sub-run that reaches min_ratio, and of those on both sides of it."""
        out, todo = [], [(0, len(text))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo >= least and (got := self.best(text[lo:hi], least)) and got[0] >= min_ratio:
                start, end = lo + got[1], lo + got[2]
                # "-" and "_" stand in credentials too: what follows them belongs to the span while it reaches min_ratio.
                rest = re.match(r"[A-Za-z0-9_-]*", text[end:hi])[0]
                cuts = [end + k for k in range(1, len(rest) + 1) if end + k == hi or text[end + k] in JOINS]
                end = next((z for z in reversed(cuts) if self.ratio(text[start:z]) >= min_ratio), end)
                out.append((start, end))
                todo += [(lo, start), (end, hi)]
        return sorted(out)


@functools.lru_cache
def default_automaton() -> Automaton:
    """The automaton of the public formats alone, against even draws."""
    return Automaton(format_counts, Background())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: leftmost and non-overlapping for each kind, failing matches dropped."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


_BYTES = lambda text: np.isin(np.arange(256), [ord(c) for c in text])
CREDENTIAL, EDGE, JOIN = _BYTES(LETTERS), _BYTES("./="), _BYTES(JOINS)


def candidates(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) in bytes of the runs of LEAST or more characters of credentials, without "./=" at their ends."""
    starts, ends, doc = words(data, off, CREDENTIAL)
    keep = ends - starts >= LEAST
    starts, ends, doc = starts[keep], ends[keep], doc[keep]
    while len(at := np.flatnonzero((ends > starts) & EDGE[data[np.minimum(starts, len(data) - 1)]])):
        starts[at] += 1
    while len(at := np.flatnonzero((ends > starts) & EDGE[data[ends - 1]])):
        ends[at] -= 1
    keep = ends - starts >= LEAST
    return starts[keep], ends[keep], doc[keep]


def wholes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which runs have no joining character, and are their only sub-run; runs with some, and long ones, are looked at one by one."""
    joins = np.concatenate(([0], np.cumsum(JOIN[data])))
    return np.flatnonzero((joins[ends] == joins[starts]) & (ends - starts <= 256))


def code_points(d: np.ndarray) -> np.ndarray:
    """For each byte of a text, and its end, how many code points start before it."""
    return np.concatenate(([0], np.cumsum((d & 0xC0) != 0x80)))


def different(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of the data[start:end] that differ from the one before in an order of hash h and size: each is there once at least."""
    size = ends - starts
    order = np.lexsort((size, h))
    x, y = order[:-1], order[1:]
    same = (h[x] == h[y]) & (size[x] == size[y])
    at = np.flatnonzero(same)
    if len(at):
        n = size[x[at]]
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        same[at] = ~np.logical_or.reduceat(data[np.repeat(starts[x[at]], n) + place] != data[np.repeat(starts[y[at]], n) + place], first)
    return order[np.concatenate((np.ones(min(1, len(order)), bool), ~same))]


def examples(docs: DataFrame) -> DataFrame:
    """h, value, label: all different values that the fixed patterns find in the table (label), and all different other candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            data, off = buffers(b.column(0))
            labelled_: set[str] = set()
            covered: list[np.ndarray] = []
            starts, ends, doc = candidates(data, off)
            edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
            for k, text in enumerate(b.column(0)):
                text = text.as_py() or ""
                if spans := base_spans(text):
                    labelled_.update(m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST)
                    labelled_.update(text[s:e] for s, e, kind in spans if kind != "assign")
                    cp = code_points(data[off[k] : off[k + 1]])
                    own = np.arange(edge[k], edge[k + 1])
                    lo, hi = cp[starts[own] - off[k]], cp[ends[own] - off[k]]
                    covered.append(own[np.array([any(x <= a and z <= y for x, y, _ in spans) for a, z in zip(lo, hi)], bool)])
            free = np.setdiff1d(np.arange(len(starts)), np.concatenate([np.zeros(0, np.int64), *covered]))
            starts, ends = starts[free], ends[free]
            h = (hashes(data, starts, ends) >> np.uint64(1)).view(np.int64)
            first, known, raw = different(data, starts, ends, h), sorted(labelled_), data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*h[first].tolist(), *(xxhash.xxh64_intdigest(v) >> 1 for v in known)], pa.int64()),
                    pa.array([*(raw[a:z].decode() for a, z in zip(starts[first].tolist(), ends[first].tolist())), *known], pa.string()),
                    pa.array([False] * len(first) + [True] * len(known), pa.bool_()),
                ],
                ["h", "value", "label"],
            )

    return docs.select("text").mapInArrow(run, "h long, value string, label boolean").distinct()


def without_formats(plain: DataFrame) -> DataFrame:
    """The candidates without a public format, by the automaton of these alone."""
    public = default_automaton()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = public.tables()
        for b in batches:
            data, off = buffers(b.column(1))
            passing, whole = np.ones(b.num_rows, bool), wholes(data, off[:-1], off[1:])
            passing[whole] = public.ratios(data, off[:-1][whole], off[1:][whole], tables) >= MIN_RATIO - 1e-6
            for k in np.flatnonzero(passing):
                passing[k] = bool(public.spans(b.column(1)[int(k)].as_py(), MIN_RATIO))
            yield b.filter(pa.array(~passing))

    return plain.select("h", "value").mapInArrow(run, "h long, value string")


def total(rows: DataFrame, run: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(key, n): the counts that run gives for each batch of values, summed by key in Spark; in order of keys."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = run(*buffers(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    got = rows.select("value").mapInArrow(counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = (got.column(k).to_numpy().astype(np.int64) for k in range(2))
    order = np.argsort(keys)
    return keys[order], n[order]


def pairs_of(plain: DataFrame) -> dict[str, int]:
    """How often each pair of neighbouring characters is in the values; ^ is the start and $ the end."""

    def run(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = CODES[data]
        start = np.zeros(len(code) + 1, bool)
        start[off] = True
        before = np.where(start[:-1], 0, np.concatenate(([0], code[:-1])))
        return np.unique(np.concatenate((before * N_CODES + code, code[off[1:] - 1] * N_CODES)), return_counts=True)

    return {("^" + LETTERS)[k // N_CODES] + ("$" + LETTERS)[k % N_CODES]: int(n) for k, n in zip(*total(plain, run))}


def ratio_steps(model: Automaton, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(step, n): how many values have a ratio from step / STEPS on; those below MIN_RATIO share a step of -1."""
    tables = model.tables()

    def run(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ratio = model.ratios(data, off[:-1], off[1:], tables)
        return np.unique(np.where(ratio < MIN_RATIO, -1, np.floor(ratio * STEPS)).astype(np.int64), return_counts=True)

    return total(rows, run)


@dataclass
class Learned:
    """An automaton with its background, the bound on their ratio, and what both are worth on what was held out of the fit.

    recall is the share of held-out values, false_share that of held-out other candidates that reach the bound. Candidates that have a
    public format are no background.
    """

    model: Automaton
    min_ratio: float
    recall: float
    false_share: float


def learn(docs: DataFrame) -> Learned:
    """Learns from all labelled values and all other candidates of the table; only counts, of a number of keys that the symbols and states bound, reach the driver."""
    seen = materialize(examples(docs))
    held = F.pmod("h", F.lit(FOLDS)) == 0
    values, plain = seen.where("label"), materialize(without_formats(seen.where("NOT label")))
    fit = materialize(values.where(~held).select("value"))

    def counts(goes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return added(format_counts(goes), total(fit, lambda data, off: counted(goes, data, off)))

    model = Automaton(counts, Background(pairs_of(plain.where(~held))))
    steps, n = ratio_steps(model, plain.where(held))
    allowed, min_ratio = int(FALSE_SHARE * n.sum()), MIN_RATIO
    if allowed:  # the least step that no more than the allowed candidates reach
        over = steps[(np.cumsum(n[::-1])[::-1] > allowed) & (steps >= 0)]
        min_ratio = max(MIN_RATIO, (int(over.max()) + 1) / STEPS) if len(over) else MIN_RATIO
    share = lambda steps, n: float(n[steps >= min_ratio * STEPS].sum() / max(1, n.sum()))
    return Learned(model, min_ratio, share(*ratio_steps(model, values.where(held))), share(steps, n))


def scan(docs: DataFrame, learned: Learned | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans and found (array of kind, start, end, value) of every row.

    Candidates are the sub-runs, between joining characters, of runs of LEAST or more characters of credentials; the best of a run, and
    of what it leaves, that lies in no base span and reaches the bound is a span of kind format. The automaton is inferred from the
    public formats and from all labelled values of the table itself (what the fixed patterns find), and held against a background of
    all its other candidates; a fifth of both is held out to set the bound and to tell what they are worth. A null
    or empty text has no spans; rows are judged one by one, repeated rows alike; other columns are not used; an empty table gives no rows.
    """
    learned = learn(docs) if learned is None else learned
    model, min_ratio = learned.model, learned.min_ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, int]]] = {}
        tables = model.tables()
        for b in batches:
            data, off = buffers(b.column(1))
            starts, ends, doc = candidates(data, off)
            whole = wholes(data, starts, ends)
            passing = np.ones(len(starts), bool)
            passing[whole] = model.ratios(data, starts[whole], ends[whole], tables) >= min_ratio - 1e-6
            at = np.flatnonzero(passing)
            edge = np.searchsorted(doc[at], np.arange(b.num_rows + 1))
            out: list[tuple] = []
            for k, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                spans = base_spans(text)
                n = [sum(kind == s[2] for s in spans) for kind in KINDS[:3]]
                sha = hashlib.sha256(joined(spans).encode()).hexdigest()
                added, base = 0, list(spans)
                own = at[edge[k] : edge[k + 1]]
                cp = code_points(data[off[k] : off[k + 1]]) if len(own) else None
                for i in own:
                    lo, hi = int(cp[starts[i] - off[k]]), int(cp[ends[i] - off[k]])
                    if any(x <= lo and hi <= y for x, y, _ in base):
                        continue
                    word = text[lo:hi]
                    if (hits := known.get(word)) is None:
                        hits = model.spans(word, min_ratio)
                        if len(known) < 100_000 and len(word) < 200:
                            known[word] = hits
                    for s, e in hits:
                        if not any(x <= lo + s and lo + e <= y for x, y, _ in base):
                            spans.append((lo + s, lo + e, "format"))
                            added += 1
                out.append((*n, added, sha, joined(spans), [{"kind": kind, "start": s, "end": e, "value": text[s:e]} for s, e, kind in sorted(spans)]))
            item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [item]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans", "found"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint,value:string>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")

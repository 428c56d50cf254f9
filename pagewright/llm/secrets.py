"""Secret scans by grammar inference.

Labelled credentials of each kind make a prefix tree; states whose end and symbol
frequencies are statistically compatible (Hoeffding bounds, down to all their
descendants) are merged in red-blue order into a probabilistic automaton. Another is
learnt from labelled strings that are not credentials. Every candidate, a run of at
least ``MIN_LENGTH`` bytes of letters, digits and ``_-+/.``, is scored with the best
kind's log-likelihood less the other's, and is a secret above a threshold set on
labelled strings that were not used for learning.

The labelled strings are made here, seeded, by format; a team would pass its own to
``fit``. The automata are a few hundred kilobytes whatever the corpus.

Defined results: a null or empty text has no candidates; a candidate of any length
is scored as a whole; places are bytes of the UTF-8 text; full stops, dashes and
slashes at either end of a run do not belong to it; documents without secrets have
no rows; repeated rows give repeated findings; of kinds that score alike the first
by name is given; texts of any length are read whole; columns besides doc_id and
text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import pieces, prepare, text_buffers

MIN_LENGTH = 16
ALPHA = 0.05
FAINT = 0.02
SYMBOLS = 96  # printable ASCII, and any other byte
#: Cost of each symbol, and of the end, once a string has left its automaton.
FLAT = -math.log(SYMBOLS + 1)
#: Longer strings are walked one at a time.
LONG = 4096
LABELLED = 300
MIN_PRECISION = 0.99
SEED = 5
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_PART = np.zeros(256, bool)
_PART[[ord(c) for c in _LOWER + _UPPER + _DIGITS + "_-+/."]] = True
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in "-/."]] = True


def labelled(n: int = LABELLED, seed: int = SEED) -> dict[str, list[str]]:
    """n credentials of each kind, and under "" twelve times as many other strings."""
    rng = random.Random(seed)
    of = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "qu", "sch", "ung", "lich", "keit", "ment", "tion", "ing", "b", "c", "d", "f", "g", "k", "l", "m", "p", "w", "z")) for _ in range(rng.randint(1, 9)))
    alnum, url = _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "-_"
    kinds = {
        "hex_token": lambda: of("0123456789abcdef", rng.choice((40, 40, 32, 64))),
        "aws_key_id": lambda: rng.choice(("AKIA", "ASIA")) + of(_UPPER + _DIGITS, 16),
        "base64_key": lambda: of(alnum + "+/", 40),
        "github_token": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + of(alnum, 36),
        "slack_token": lambda: f"xox{rng.choice('bp')}-{of(_DIGITS, 12)}-{of(_DIGITS, 12)}-{of(alnum, 24)}",
        "stripe_key": lambda: f"{rng.choice(('sk', 'rk'))}_{rng.choice(('live', 'test'))}_{of(alnum, 24)}",
        "google_key": lambda: "AIza" + of(url, 35),
        "jwt": lambda: f"eyJ{of(url, rng.randint(17, 40))}.eyJ{of(url, rng.randint(30, 80))}.{of(url, 43)}",
    }

    def long_(make, join: str) -> str:
        s = make()
        while len(s) < MIN_LENGTH:
            s += join + make()
        return s

    others = [
        lambda: long_(word, ""),
        lambda: long_(word, ""),
        lambda: long_(word, "").upper(),
        lambda: long_(word, "").capitalize(),
        lambda: long_(lambda: word().capitalize(), ""),
        lambda: long_(word, "-"),
        lambda: long_(word, "_"),
        lambda: long_(word, "."),
        lambda: long_(word, "/"),
        lambda: of(_DIGITS, rng.randint(16, 30)),
        lambda: of(_DIGITS, 16),
        lambda: of(_DIGITS, rng.randint(16, 20)),
        lambda: f"{rng.randint(1990, 2030)}-{of(_DIGITS, 2)}-{of(_DIGITS, 2)}T{of(_DIGITS, 6)}.{of(_DIGITS, 6)}",
        lambda: long_(lambda: of(_DIGITS, rng.randint(1, 4)), "."),
        lambda: rng.choice("-_.=+a0") * rng.randint(16, 80),
        lambda: f"{of('0123456789abcdef', 8)}-{of('0123456789abcdef', 4)}-4{of('0123456789abcdef', 3)}-a{of('0123456789abcdef', 3)}-{of('0123456789abcdef', 12)}",
        lambda: f"{long_(word, '-')}{of(_DIGITS, rng.randint(1, 3))}",
        lambda: f"www.{word()}.example.com/{word()}/{of(_DIGITS, 4)}.html",
    ]
    return {k: [f() for _ in range(n)] for k, f in kinds.items()} | {"": [rng.choice(others)() for _ in range(12 * n)]}


def symbol(c: str | int) -> int:
    c = ord(c) if isinstance(c, str) else c
    return c - 32 if 32 <= c < 127 else SYMBOLS - 1


class Learner:
    """State merging over a prefix tree; state 0 is the root."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.seen, self.ends, self.next, self.count = [0], [0], [{}], [{}]
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        for s in strings:
            q = 0
            self.seen[0] += 1
            for c in map(symbol, s):
                if c not in self.next[q]:
                    self.next[q][c] = len(self.seen)
                    self.count[q][c] = 0
                    for x, empty in ((self.seen, 0), (self.ends, 0), (self.next, {}), (self.count, {})):
                        x.append(empty)
                self.count[q][c] += 1
                q = self.next[q][c]
                self.seen[q] += 1
            self.ends[q] += 1

    def _far(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) >= self.width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, a: int, b: int) -> bool:
        work = [(a, b)]
        while work:
            a, b = work.pop()
            n, m = self.seen[a], self.seen[b]
            if not n or not m:
                continue
            if self._far(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._far(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    work.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        work = [(a, b)]
        while work:
            a, b = work.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    work.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def learn(self) -> list[int]:
        """Merges until every state left differs from all others; these states."""
        red, parents = [0], {}
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            q, c = blue.pop(0)
            b = self.next[q][c]
            if b in red:
                continue
            for r in red:
                if self.compatible(r, b):
                    self.next[q][c] = r
                    self.fold(r, b)
                    break
            else:
                red.append(b)
                parents[b] = (q, c)
            blue = sorted({(r, c) for r in red for c, to in self.next[r].items() if to not in red}, key=lambda x: (-self.count[x[0]][x[1]], x))
        return red


class Automata:
    """Several learnt automata as tables: next state and log-probability by state and symbol; the last symbol is the end."""

    def __init__(self, strings: dict[str, list[str]], alpha: float = ALPHA):
        self.kinds = sorted(strings, key=lambda k: (k == "", k))
        step, cost, self.first = [], [], []
        for kind in self.kinds:
            learner = Learner(strings[kind], alpha)
            states = learner.learn()
            at = {q: len(step) + 1 + i for i, q in enumerate(states)}
            sink = len(step)
            self.first.append(at[0])
            step.append(np.full(SYMBOLS, sink))
            cost.append(np.full(SYMBOLS + 1, FLAT))
            for q in states:
                to, p = np.full(SYMBOLS, sink), np.full(SYMBOLS + 1, FAINT)
                for c, n in learner.count[q].items():
                    to[c] = at[learner.next[q][c]]
                    p[c] += n
                p[SYMBOLS] += learner.ends[q]
                step.append(to)
                cost.append(np.log(p / p.sum()))
        self.step, self.cost, self.first = np.array(step, np.int32), np.array(cost), np.array(self.first, np.int32)
        self.sink = (self.step == np.arange(len(self.step))[:, None]).all(1) & (self.cost == FLAT).all(1)
        self.threshold = 0.0

    def loglik(self, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log-likelihood of each string (bounded by off) in each automaton; every symbol read in a sink costs the same, so these are counted."""
        size = np.diff(off)
        out = np.empty((len(size), len(self.kinds)))
        long_ = np.flatnonzero(size > LONG)
        for i in long_:
            out[i] = self._walk(symbols[off[i] : off[i + 1]])
        order = np.argsort(-size, kind="stable")[len(long_) :]
        state, total, lost = (np.zeros((len(order), len(self.kinds)), kind) for kind in (np.int32, np.float64, np.int64))
        state += self.first
        begin, size = off[:-1][order], size[order]
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, "left"))
            if t % 64 == 63 and self.sink[state[:live]].all():
                lost[:live] += (size[:live] - t)[:, None]
                break
            c = symbols[begin[:live] + t][:, None]
            sunk = self.sink[state[:live]]
            total[:live] += np.where(sunk, 0.0, self.cost[state[:live], c])
            lost[:live] += sunk
            state[:live] = self.step[state[:live], c]
        out[order] = total + lost * FLAT + self.cost[state, SYMBOLS]
        return out

    def _walk(self, symbols: np.ndarray) -> list[float]:
        """The same for one long string, an automaton at a time, each until its sink."""
        out = []
        for first in self.first.tolist():
            rows: dict[int, tuple[list, list]] = {}
            state, total, at = first, 0.0, 0
            for lo in range(0, len(symbols), 1 << 16):
                if self.sink[state]:
                    break
                for c in symbols[lo : lo + (1 << 16)].tolist():
                    row = rows.get(state)
                    if row is None:
                        if self.sink[state]:
                            break
                        row = rows[state] = (self.cost[state].tolist(), self.step[state].tolist())
                    total += row[0][c]
                    state = row[1][c]
                    at += 1
            out.append(total + (len(symbols) - at) * FLAT + float(self.cost[state, SYMBOLS]))
        return out

    def scores(self, symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best kind of each string, and by how much it beats the strings that are not credentials."""
        found = self.loglik(symbols, off)
        best = found[:, :-1].argmax(1)
        return best, found[np.arange(len(best)), best] - found[:, -1]


def _flat(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    return np.array([symbol(c) for s in strings for c in s], np.int64), off


def fit(known: dict[str, list[str]], held: dict[str, list[str]], min_precision: float = MIN_PRECISION) -> Automata:
    """Automata of the known strings; the threshold is the lowest that is precise enough on the held-out ones."""
    found = Automata(known)
    s = np.concatenate([found.scores(*_flat(v))[1] for v in held.values()])
    y = np.concatenate([np.full(len(v), float(k != "")) for k, v in held.items()])
    order = np.argsort(-s, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero(right >= min_precision)
    found.threshold = max(0.0, float(s[order][ok[-1]])) if len(ok) else math.inf
    return found


@lru_cache(maxsize=1)
def model() -> Automata:
    return fit(labelled(), labelled(seed=SEED + 1))


def candidates(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every run of candidate bytes."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    part = _PART[raw]
    start = np.flatnonzero(part & (edge[:-1] | ~np.concatenate([[False], part[:-1]])))
    end = np.flatnonzero(part & (edge[1:] | ~np.concatenate([part[1:], [False]]))) + 1
    long_ = end - start >= MIN_LENGTH
    start, end = start[long_], end[long_]
    while len(start):
        left, right = _TRIM[raw[start]], _TRIM[raw[end - 1]]
        if not (left.any() or right.any()):
            break
        start, end = start + left, end - right
        long_ = end - start >= MIN_LENGTH
        start, end = start[long_], end[long_]
    return np.searchsorted(off, start, "right") - 1, start, end


_SYMBOL = np.array([symbol(b) for b in range(256)], np.int64)


def _scan(automata: Automata):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, bounds = text_buffers(batch.column(1))
            for first, last in pieces(bounds):
                raw, off = whole[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
                if not len(raw):
                    continue
                row, a, b = candidates(raw, off)
                size = b - a
                at = np.concatenate([[0], np.cumsum(size)])
                kind, s = automata.scores(_SYMBOL[raw[np.repeat(a - at[:-1], size) + np.arange(at[-1])]], at)
                yes = np.flatnonzero(s > automata.threshold)
                here = off[row[yes]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[yes] + first)), pa.array(a[yes] - here), pa.array(b[yes] - here), pa.array([automata.kinds[k] for k in kind[yes]], pa.string()), pa.array(np.round(s[yes], 4))],
                    ["doc_id", "begin", "end", "kind", "score"],
                )

    return run


def scan(docs: DataFrame, automata: Automata | None = None) -> DataFrame:
    """(doc_id, begin, end, kind, score) of each secret."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_scan(automata or model()), "doc_id long, begin long, end long, kind string, score double")

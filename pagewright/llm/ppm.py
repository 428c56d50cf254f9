"""Language-model scoring by prediction by partial matching over a byte-context trie.

The trie's counts come from all documents: every byte with the ``order`` bytes
before it (zero bytes before a document's start), counted in Spark. A byte unseen
in its context costs an escape (method C: as many escapes as distinct successors)
and is looked for in the next shorter context, where symbols of the longer one are
excluded; below order 0 the bytes left are equally likely.

So that no document is scored by its own counts, documents fall into two halves by
a hash of their text, and each half is scored by the trie of the other; exact
copies fall into the same half. Excluded counts depend only on the longer context
and are summed when the trie is built, so scoring is a look-up per byte and level.

The trie's size is measured before it is fetched. Up to ``max_broadcast`` nodes it
goes to every worker. A larger one is dealt out by the last two bytes of the context,
so that a context and its shorter forms down to order 2 meet in one task, to which the
at most 65,536 nodes of order 1 are sent; the costs of nodes are then joined to the
distinct nodes of each chunk of texts. Order and scores are the same either way.
Contexts are shortened only for a caller that gives ``max_nodes``.

Defined results: a null text has 0 bytes, 0 bits and a null rate, as has an empty
one; repeated rows and null doc_ids are counted and scored row by row. If the other
half is empty every byte costs 8 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Places, cut, pieces, prepare, text_buffers

ORDER = 4
MAX_NODES = 6_000_000
#: Nodes to a task and bytes of text to a chunk where the trie is dealt out.
PART_NODES, CHUNK = 500_000, 16 << 20


def keys(raw: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, as one number."""
    n = len(off) - 1
    padded = np.zeros(len(raw) + order * n, np.uint8)
    at = np.arange(len(raw)) + order * (np.repeat(np.arange(n), np.diff(off)) + 1)
    padded[at] = raw
    out = np.zeros(len(raw), np.uint64)
    for k in range(order, -1, -1):
        out = (out << np.uint64(8)) | padded[at - k]
    return out


def halves(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """0 or 1 for each row, by its text."""
    view = raw.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(view[a:b]) & 1 for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.int64)


def _count(order: int):
    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return key, np.bincount(back, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            raw, off = text_buffers(batch.column(0))
            for lo, hi in pieces(off):
                own, rel = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                half = np.repeat(halves(own, rel), np.diff(rel)).astype(np.uint64)
                key = np.sort(keys(own, rel, order) | (half << np.uint64(63)))
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                parts.append((key[first], np.diff(np.concatenate([first, [len(key)]]))))
                if len(parts) > 16:
                    parts = [merged(parts)]
        if parts:
            key, n = merged(parts)
            half, key = (key >> np.uint64(63)).astype(np.int64), (key & np.uint64((1 << 63) - 1)).astype(np.int64)
            for lo in range(0, len(key), 100_000):
                s = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(n[s] * (half[s] == 0)), pa.array(n[s] * (half[s] == 1))], ["key", "n0", "n1"])

    return run


class Trie:
    """Costs in bits of every node, with escapes and exclusions summed beforehand."""

    def __init__(self, key: np.ndarray, n: np.ndarray, order: int, below: tuple[np.ndarray, np.ndarray] | None = None):
        """``below`` has the nodes of order 1 if the keys are only those of some contexts of order 2."""
        key, n = key[n > 0].astype(np.uint64), n[n > 0].astype(np.float64)
        self.order, self.levels = order, []
        levels = []
        for k in range(order, -1, -1):
            if below is not None and k == 1:
                key, n = below[0][below[1] > 0].astype(np.uint64), below[1][below[1] > 0].astype(np.float64)
            context, first = np.unique(key >> np.uint64(8), return_index=True) if len(key) else (key, np.zeros(0, np.int64))
            of = np.searchsorted(context, key >> np.uint64(8))
            total, kinds = np.bincount(of, n, len(context)), np.bincount(of, minlength=len(context)).astype(np.float64)
            levels.append((key, n, context, of, total, kinds))
            if k:
                key, back = np.unique(key & np.uint64((1 << (8 * k)) - 1), return_inverse=True)
                n = np.bincount(back, n, len(key)) if len(key) else n
        for k, (key, n, context, of, total, kinds) in zip(range(order, -1, -1), levels):
            level = {"node": Places(key), "n": n, "context": Places(context), "total": total, "kinds": kinds, "ex_total": None, "ex_kinds": None}
            if k:
                # What this context's symbols hold in the next shorter one.
                key2, n2, context2, of2, total2, kinds2 = levels[order - k + 1]
                mask = np.uint64((1 << (8 * k)) - 1)
                inner = n2[np.searchsorted(key2, key & mask)] if len(key) else n
                short = np.searchsorted(context2, context & np.uint64((1 << (8 * (k - 1))) - 1))
                level["ex_total"] = total2[short] - np.bincount(of, inner, len(context)) if len(key) else total
                level["ex_kinds"] = kinds2[short] - kinds if len(key) else kinds
            self.levels.append(level)
        self.symbols = len(levels[-1][0])

    def bits(self, key: np.ndarray) -> np.ndarray:
        """Cost of each byte in its context."""
        out = np.zeros(len(key))
        rest, longer = np.arange(len(key)), np.full(len(key), -1, np.int32)
        for i, level in enumerate(self.levels):
            k = self.order - i
            here = key[rest] & np.uint64((1 << (8 * (k + 1))) - 1)
            above = self.levels[i - 1] if i else None
            node = level["node"].find(here)
            hit = node >= 0
            context = level["context"].find(here >> np.uint64(8))
            total, kinds = level["total"][context] if len(level["total"]) else np.zeros(len(here)), level["kinds"][context] if len(level["kinds"]) else np.zeros(len(here))
            if above is not None:
                excluded = longer >= 0
                total, kinds = np.where(excluded, above["ex_total"][longer] if len(above["total"]) else 0, total), np.where(excluded, above["ex_kinds"][longer] if len(above["kinds"]) else 0, kinds)
            with np.errstate(divide="ignore", invalid="ignore"):
                found = np.log2((total + kinds) / (level["n"][node] if len(level["n"]) else 1))
                escape = np.where((context >= 0) & (kinds > 0), np.log2((total + kinds) / kinds), 0.0)
            out[rest] += np.where(hit, found, escape)
            rest, longer = rest[~hit], context[~hit]
            if not len(rest):
                return out
        out[rest] += np.log2(256 - self.symbols)
        return out


def _scored(doc_id: pa.Array, text: pa.Array, order: int, costs) -> Iterator[pa.RecordBatch]:
    """Rows scored by ``costs`` of (key, half of each byte)."""
    raw, off = text_buffers(text)
    for lo, hi in pieces(off):
        own, rel = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        cost = costs(keys(own, rel, order), np.repeat(halves(own, rel), np.diff(rel)))
        size = np.diff(rel)
        total = np.zeros(hi - lo)
        if len(cost):
            total[size > 0] = np.add.reduceat(cost, rel[:-1][size > 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = pa.array(np.round(total / size, 6), mask=size == 0)
        yield pa.RecordBatch.from_arrays([doc_id.slice(lo, hi - lo), pa.array(size), pa.array(np.round(total, 3)), rate], ["doc_id", "n_bytes", "bits", "bits_per_byte"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, tries = shared.value

        def costs(key: np.ndarray, at: np.ndarray) -> np.ndarray:
            cost = np.zeros(len(key))
            for h in (0, 1):
                mine = at == h
                cost[mine] = tries[1 - h].bits(key[mine])
            return cost

        for batch in batches:
            yield from _scored(batch.column(0), batch.column(1), order, costs)

    return run


def _halved(key: np.ndarray, half: np.ndarray) -> np.ndarray:
    return (key | (half.astype(np.uint64) << np.uint64(63))).view(np.int64)


def _node_costs(order: int, below):
    """(node, cost): of each key of this partition's contexts in each half that has it, the half being the highest bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy() for i in range(3)] for b in batches if b.num_rows]
        if not parts:
            return
        key, *n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        by = np.argsort(key)
        key, n = key[by], [x[by] for x in n]
        low, *m = below.value
        for h in (0, 1):
            asked = key[n[h] > 0].astype(np.uint64)
            cost, node = Trie(key, n[1 - h], order, (low, m[1 - h])).bits(asked), _halved(asked, np.full(len(asked), h))
            for lo in range(0, len(node), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[lo : lo + 100_000]), pa.array(cost[lo : lo + 100_000])], ["node", "cost"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of a chunk of about ``CHUNK`` bytes, each row counted as 64 bytes more than its text."""
    at, part = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        _, off = text_buffers(batch.column(1))
        begin = at + off + 64 * np.arange(len(off))
        at = int(begin[-1])
        yield pa.RecordBatch.from_arrays([pa.array(part + begin[:-1] // CHUNK), batch.column(0), batch.column(1)], ["chunk", "doc_id", "text"])


def _asked(order: int):
    """(chunk, node): the distinct nodes of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def out() -> Iterator[pa.RecordBatch]:
            node = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            for lo in range(0, len(node), 100_000):
                some = node[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now, np.int64)), pa.array(some)], ["chunk", "node"])

        for batch in batches:
            chunk = batch.column(0).to_numpy()
            raw, off = text_buffers(batch.column(1))
            edges = np.flatnonzero(np.diff(chunk)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(chunk)]):
                if a == b:
                    continue
                if chunk[a] != now:
                    yield from out()
                    now, parts = int(chunk[a]), []
                for lo, hi in pieces(off[a : b + 1]):
                    own, rel = raw[off[a + lo] : off[a + hi]], off[a + lo : a + hi + 1] - off[a + lo]
                    parts.append(np.unique(_halved(keys(own, rel, order), np.repeat(halves(own, rel), np.diff(rel)))))
                if len(parts) > 16:
                    parts = [np.unique(np.concatenate(parts))]
        yield from out()

    return run


def _score_chunk(order: int):
    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        node, cost = found.column("node").to_numpy(), found.column("cost").to_numpy()
        by = np.argsort(node)
        node, cost = node[by], cost[by]

        def costs(key: np.ndarray, at: np.ndarray) -> np.ndarray:
            want = _halved(key, at)
            place = np.searchsorted(node, want)
            if len(want) and not (len(node) and np.array_equal(node[np.minimum(place, len(node) - 1)], want)):
                raise ValueError("a node of the texts has no cost")
            return cost[place]

        rows = rows.combine_chunks()
        doc_id = pa.array([], pa.int64()) if not rows.num_rows else rows.column("doc_id").chunk(0)
        return pa.Table.from_batches(list(_scored(doc_id, rows.column("text"), order, costs)), pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("bits", pa.float64()), ("bits_per_byte", pa.float64())]))

    return run


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n0, n1): occurrences of each byte after each context, in the two halves of all documents."""
    return docs.select("text").mapInArrow(_count(order), "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _shortened(nodes: DataFrame, order: int) -> DataFrame:
    """The nodes with contexts cut to ``order`` bytes."""
    return nodes.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1)).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _fetched(nodes: DataFrame) -> list[np.ndarray]:
    found = nodes.toArrow().combine_chunks().sort_by("key")
    return [found.column(c).to_numpy() for c in ("key", "n0", "n1")]


def _by_shuffle(own: DataFrame, nodes: DataFrame, n: int, order: int) -> DataFrame:
    below = own.sparkSession.sparkContext.broadcast(_fetched(_shortened(nodes, 1)))
    context = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    costs = nodes.repartition(-(-n // PART_NODES), context).mapInArrow(_node_costs(order, below), "node long, cost double")
    chunked = cut(own.mapInArrow(_chunks, "chunk long, doc_id long, text string"))
    found = chunked.select("chunk", "text").mapInArrow(_asked(order), "chunk long, node long").join(costs, "node")
    return chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_score_chunk(order), "doc_id long, n_bytes long, bits double, bits_per_byte double")


def code_lengths(docs: DataFrame, order: int = ORDER, max_nodes: int | None = None, max_broadcast: int = MAX_NODES) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) for each row; ``max_nodes`` asks for shorter contexts where there are more nodes."""
    spark = docs.sparkSession
    prepare(spark)
    nodes = cut(counts(docs, order))
    n = nodes.count()
    while max_nodes is not None and order > 2 and n > max_nodes:
        order -= 1
        nodes = cut(_shortened(nodes, order))
        n = nodes.count()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if order >= 2 and n > max_broadcast:
        return _by_shuffle(own, nodes, n, order)
    key, *halved = _fetched(nodes)
    tries = [Trie(key, x, order) for x in halved]
    shared = spark.sparkContext.broadcast((order, tries))
    return own.mapInArrow(_score(shared), "doc_id long, n_bytes long, bits double, bits_per_byte double")

"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One permutation spreads a document's word shingles over a domain of 2^20 places; a
second one, shifted circularly by k, gives coordinate k of the signature, so all
coordinates come from these two permutations. Two texts are linked if they agree on
all rows of some band and the exact Jaccard similarity of their shingle sets (of
64-bit hashes) reaches the threshold. Every pair that shares a band is verified;
groups are the connected components of the links.

Exact copies are folded into one before banding, so a text with thousands of copies
takes part once. Texts that chains of shared bands connect are brought to one task,
each text sent once; there pairs are verified from the texts' own shingles, and only
each text's number of links and its group go on, never pairs. Where such a chain
holds more than ``part_texts`` texts or ``part_bytes`` bytes, its texts go instead to
a task for each band value that they share, and a band value with more than that is
cut into blocks, a task for each two blocks; a pair is verified where its first
common band is. The links, and so the groups, are the same either way.

Defined results: a null text, or one without words, is a group of its own unless
other texts equal it byte for byte (nulls equal nothing); rows with the same doc_id
and text count as one; several texts under one doc_id are separate documents, of
which the group's lowest (doc_id, text key) is kept; a null doc_id sorts last. Texts
of any length are read whole; those with far more than 2^20 different shingles get
much the same signature and are told apart by verification. Columns besides doc_id
and text are not read; drop_near_duplicates returns them, and of rows equal in doc_id
and text it keeps that with the least hash of all columns. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import cut, mix, pieces, prepare, ragged, remove, shared_folder, stored, text_buffers, word_hashes

DOMAIN_BITS = 20
WORDS = 3
BANDS, ROWS = 50, 5
THRESHOLD = 0.5
SEED = 20240607
#: What one task verifies at most.
PART_TEXTS, PART_BYTES = 2000, 32 << 20
#: Logarithm of a bitmap's largest size in bits.
MAX_BITS = 27


@lru_cache(maxsize=2)
def permutations(size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations; the second is continued by its own beginning so that any shift is one slice."""
    rng = np.random.default_rng(seed)
    first = rng.permutation(1 << DOMAIN_BITS).astype(np.uint32)
    second = rng.permutation(1 << DOMAIN_BITS).astype(np.uint32)
    return first, np.concatenate([second, second[:size]])


def shingles(raw: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``words`` words (of all its words, if fewer) and the rows' offsets into them."""
    hashes, _, _, at = word_hashes(raw, off)
    count = np.diff(at)
    sizes = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    first = ragged(at[:-1], sizes)
    left = np.repeat(at[1:], sizes) - first
    out = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            more = left > k
            out[more] = mix(out[more] * np.uint64(31) + hashes[first[more] + k] + np.uint64(k + 1))
    return out, np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Minimum per row and coordinate; rows without shingles keep the largest value."""
    spread, values = permutations(size)
    out = np.full((len(at) - 1, size), 0xFFFFFFFF, np.uint32)
    place = spread[(hashes & np.uint64((1 << DOMAIN_BITS) - 1)).astype(np.int64)].astype(np.int64)
    shifted = np.lib.stride_tricks.sliding_window_view(values, size)
    for d in np.flatnonzero(np.diff(at)):
        lo, hi = at[d], at[d + 1]
        for x in range(lo, hi, 4096):
            np.minimum(out[d], shifted[place[x : min(hi, x + 4096)]].min(axis=0), out=out[d])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different for different bands."""
    key = np.zeros((len(signature), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r] + np.uint64(1))
    return key.view(np.int64)


def _sign(bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(3))
            for lo, hi in pieces(off):
                hashes, at = shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
                some = np.diff(at) > 0
                keys = band_keys(signatures(hashes, at, bands * rows)[some], bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)), pa.array(keys.ravel()))
                size = pa.array(np.diff(off[lo : hi + 1]))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(3)], size, lists], ["doc_id", "text_key", "node", "n_bytes", "bands"])

    return run


def _edges(band: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of band and node where each band begins, the other rows, and the band's first row for each of these."""
    first = np.ones(len(band), bool)
    first[1:] = band[1:] != band[:-1]
    start = np.flatnonzero(first)
    other = np.flatnonzero(~first)
    return start, other, start[np.cumsum(first)[other] - 1]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, a, b) of texts' (node, bands): of each band value here one row with its least node as a, and with no band an edge from
    this to each other node. So a band value that very many texts share leaves a task as one row."""
    nodes, bands, held = [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        node, band = np.concatenate(nodes), np.concatenate(bands)
        order = np.lexsort((node, band))
        node, band = node[order], band[order]
        start, other, hub = _edges(band, node)
        for at, key, b in ((start, pa.array(band[start]), node[start]), (hub, pa.nulls(len(hub), pa.int64()), node[other])):
            for lo in range(0, len(at), 100_000):
                yield pa.RecordBatch.from_arrays([key.slice(lo, 100_000), pa.array(node[at[lo : lo + 100_000]]), pa.array(b[lo : lo + 100_000])], ["band", "a", "b"])

    for batch in batches:
        lists = batch.column(1)
        nodes.append(np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy()))
        bands.append(lists.flatten().to_numpy())
        held += len(nodes[-1])
        if held > 2_000_000:
            yield from out()
            nodes, bands, held = [], [], 0
    if held:
        yield from out()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): from rows (band, a) in order of both an edge from each band's first node to each other one."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        band, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is not None:
            band, node = np.concatenate([[last[0]], band]), np.concatenate([[last[1]], node])
        start, other, hub = _edges(band, node)
        last = band[start[-1]], node[start[-1]]
        yield pa.RecordBatch.from_arrays([pa.array(node[hub]), pa.array(node[other])], ["a", "b"])


def maybe(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows in a struct ``row`` and ``maybe``, true for each whose key is wanted and for few others.

    A bitmap with about sixteen bits for each wanted row, at most MAX_BITS (16 MB), is broadcast; with more rows it lets
    more through, so it only ever saves shuffling.
    """
    bits = 1 << max(16, min(MAX_BITS, (16 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = wanted.select(place(wanted_key).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    known = rows.select(F.struct(F.col("*")).alias("row"), place(key).alias("p")).withColumns({"bucket": F.bitmap_bucket_number("p"), "at": F.bitmap_bit_position("p")})
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(at DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("CAST(at % 8 AS INT)")
    return known.join(F.broadcast(words), "bucket", "left").select("row", F.coalesce(F.call_function("shiftright", byte, hit).bitwiseAND(F.lit(1)) == 1, F.lit(False)).alias("maybe"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph of columns a and b: least node reached.

    In a round each node takes the least label beside it, tells it to the node it had as its label, and jumps to what its new
    label was labelled with; so rounds grow with the logarithm of a chain's length. Each round's labels are stored in files,
    for a plan over a checkpoint takes over its estimate of size: two joins a round would double that number's digits.
    """
    spark, folder = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/components-{uuid.uuid4().hex}"
    try:
        both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/edges")
        label = stored(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("least", "a").alias("least")), f"{folder}/0")
        none = F.lit(None).cast(label.schema["least"].dataType)
        for done in itertools.count(1):
            seen = both.join(label.select(F.col("a").alias("b"), F.col("least").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
            step = label.join(seen, "a")
            told = F.array(F.struct("a", F.least("near", "least").alias("next"), "least"), F.struct(F.col("least").alias("a"), F.col("near").alias("next"), none.alias("least")))
            step = step.select(F.inline(told)).groupBy("a").agg(F.min("next").alias("next"), F.max("least").alias("least"))
            jump = label.select(F.col("a").alias("next"), F.col("least").alias("far"))
            moved = stored(step.join(jump, "next").select("a", F.least("next", "far").alias("new"), "least"), f"{folder}/{done}")
            remove(spark, f"{folder}/{done - 1}")
            changed = moved.where("new <> least").limit(1).count()
            label = moved.select("a", F.col("new").alias("least"))
            if not changed:
                return cut(label.select(F.col("a").alias("node"), F.col("least").alias("component")))
    finally:
        remove(spark, folder)


def shared_by(ids: list[np.ndarray], i: int, others: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many of the shingles of text i each other text has; ``seen`` is all false, and left so."""
    seen[ids[i]] = True
    size = np.array([len(ids[j]) for j in others])
    hits = np.concatenate([[0], np.cumsum(seen[np.concatenate([ids[j] for j in others])])])
    seen[ids[i]] = False
    ends = np.cumsum(size)
    return hits[ends] - hits[ends - size]


def linked(ids: list[np.ndarray], bands: np.ndarray, block: np.ndarray, band: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each text and the least text it is connected to. With two blocks only pairs of both count, with a band only
    pairs of which it is the first that both share."""
    n, size = len(ids), np.array([len(x) for x in ids])
    links, root = np.zeros(n, np.int64), np.arange(n)
    seen = np.zeros(1 + max((int(x.max()) for x in ids if len(x)), default=0), bool)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    two = len(np.unique(block)) > 1
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        if two:
            j = j[block[j] != block[i]]
        same = bands[j] == bands[i]
        first = same.argmax(1)
        ok = same[np.arange(len(j)), first]
        if band is not None:
            ok &= bands[i][first] == band
        j = j[ok]
        j = j[np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i])]
        if not len(j):
            continue
        both = shared_by(ids, i, j, seen)
        j = j[both >= threshold * (size[j] + size[i] - both)]
        links[i] += len(j)
        links[j] += 1
        mine = top(i)
        for x in np.unique(root[j]).tolist():
            x = top(x)
            if x != mine:
                low, high = min(x, mine), max(x, mine)
                root[high] = mine = low
    return links, np.array([top(i) for i in range(n)], np.int64)


def _verify(threshold: float, words: int):
    """(text_key, root, links) of each text of a task that has a link there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("text_key")
        raw, off = text_buffers(table.column("text"))
        sets = []
        for lo, hi in pieces(off):
            hashes, at = shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
            sets += [np.unique(hashes[at[i] : at[i + 1]]) for i in range(hi - lo)]
        ends = np.cumsum([len(x) for x in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(sets), -1)
        links, root = linked(np.split(ids, ends[:-1]), bands, table.column("block").to_numpy(), table.column("band")[0].as_py(), threshold)
        some = np.flatnonzero(links)
        key = table.column("text_key")
        return pa.table([key.take(pa.array(some)), key.take(pa.array(root[some])), pa.array(links[some])], ["text_key", "root", "links"])

    return run


def _tasks(texts: DataFrame, parts: DataFrame, part_texts: int, part_bytes: int) -> tuple[DataFrame, bool]:
    """(text_key, first_id, bands, tasks): to which tasks each candidate text goes, and whether any chain is too long for one."""
    chained = cut(texts.join(parts, "node").select("text_key", "first_id", "n_bytes", "bands", "component"))
    load = chained.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
    large = (F.col("n") > part_texts) | (F.col("size") > part_bytes)
    some = load.where(large).limit(1).count() > 0
    task = lambda route, unit, blocks, block, band: F.struct(F.lit(route).alias("route"), unit.alias("unit"), blocks.cast("int").alias("blocks"), block.cast("int").alias("block"), band.cast("long").alias("band"))
    if not some:
        whole = task(0, F.col("component"), F.lit(1), F.lit(0), F.lit(None))
        return chained.select("text_key", "first_id", "bands", F.array(whole).alias("tasks")), False
    judged = chained.join(load.select("component", large.alias("large")), "component")
    alone = judged.where("NOT large").select("text_key", "first_id", "bands", F.array(task(0, F.col("component"), F.lit(1), F.lit(0), F.lit(None))).alias("tasks"))
    spread = judged.where("large").select("text_key", "n_bytes", F.explode("bands").alias("band"))
    blocks = F.greatest(F.ceil(F.col("n") / part_texts), F.ceil(F.col("size") / part_bytes))
    full = spread.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size")).where("n > 1").select("band", blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("text_key", F.lit(7)), F.col("blocks"))
    dealt = spread.join(full, "band").groupBy("text_key").agg(F.collect_list(task(1, F.col("band"), F.col("blocks"), block, F.col("band"))).alias("tasks"))
    return alone.unionByName(judged.where("large").select("text_key", "first_id", "bands").join(dealt, "text_key")), True


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text_key, group_id, links, copies, keep): a row for each document. group_id is the lowest doc_id of its group,
    whose row is kept; links is the number of other texts linked with this one, copies that of documents with the same text.

    Of the texts only those that share a band with others are shuffled, once; else only keys move.
    """
    return _classes(docs, **options).drop("repeats")


def _classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, part_texts: int = PART_TEXTS, part_bytes: int = PART_BYTES) -> DataFrame:
    """near_duplicates with ``repeats``, the number of rows of this doc_id and text."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"), F.xxhash64("text").alias("node"), F.col("text"))
    signed = cut(own.mapInArrow(_sign(bands, rows, words), "doc_id long, text_key binary, node long, n_bytes long, bands array<long>"))
    copies = signed.groupBy("doc_id", "text_key").agg(F.count("*").alias("repeats"))
    texts = signed.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.first("node").alias("node"), F.first("n_bytes").alias("n_bytes"), F.first("bands").alias("bands"))
    texts = cut(texts)
    # Nodes of this graph are 64-bit hashes: two texts with one hash would only be verified together.
    stars = texts.select("node", "bands").mapInArrow(_stars, "band long, a long, b long")
    met = stars.where("band IS NOT NULL").select("band", "a").repartition("band").sortWithinPartitions("band", "a").mapInArrow(_joined, "a long, b long")
    parts = components(stars.where("band IS NULL").select("a", "b").unionByName(met).where("a <> b"))
    tasks, some = _tasks(texts, parts, part_texts, part_bytes)
    tasks = cut(tasks.withColumnRenamed("text_key", "key"))
    # One row of each text: that of its first doc_id, and of its repetitions any.
    likely = maybe(own.where("text_key IS NOT NULL").select("doc_id", "text_key", "text"), F.col("text_key"), tasks, F.col("key")).where("maybe").select("row.*")
    member = likely.join(tasks, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    member = member.select("text_key", "text", "bands", "tasks").dropDuplicates(["text_key"]).withColumn("task", F.explode("tasks")).select("text_key", "text", "bands", "task.*")
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("route", "unit", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "band", "text_key", "text", "bands")
    found = cut(member.groupBy("route", "unit", "low", "high").applyInArrow(_verify(threshold, words), "text_key binary, root binary, links long"))
    if some:
        joined = components(found.select(F.col("text_key").alias("a"), F.col("root").alias("b")).where("a <> b")).select(F.col("node").alias("text_key"), F.col("component").alias("root"))
        found = found.groupBy("text_key").agg(F.sum("links").alias("links")).join(joined, "text_key")
    known = found.join(texts.select("text_key", "first_id"), "text_key")
    best = known.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "text_key")).alias("best"))
    groups = known.join(best, "root").select("text_key", "links", F.col("best.first_id").alias("best_id"), (F.col("best.text_key") == F.col("text_key")).alias("first_text"))
    folded = copies.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    # Nulls equal nothing, so they take part in no join.
    every = copies.join(folded, "text_key", "left").join(groups, "text_key", "left")
    group_id = F.when(F.col("text_key").isNull(), F.col("doc_id")).when(F.col("first_text").isNull(), F.col("first_id")).otherwise(F.col("best_id"))
    return every.select(
        "doc_id",
        "text_key",
        group_id.alias("group_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        (F.col("text_key").isNull() | (F.coalesce("first_text", F.lit(True)) & F.col("doc_id").eqNullSafe(group_id))).alias("keep"),
        "repeats",
    )


def text_key(column: str):
    """16 bytes that stand for a text; null for a null."""
    return F.unhex(F.md5(F.col(column)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents, all their columns, of which one of each group of near duplicates stays.

    Documents that are alone in every respect are passed without a shuffle.
    """
    no_text = F.lit(b"")
    found = cut(_classes(docs, **options).select(F.col("doc_id").alias("kept_id"), F.coalesce("text_key", no_text).alias("kept_key"), "keep", (F.col("text_key").isNull() | (F.col("links") > 0) | (F.col("copies") > 1) | (F.col("repeats") > 1)).alias("several")))
    judged = maybe(docs, F.coalesce(text_key("text"), no_text), found.where("several"), F.col("kept_key"))
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = judged.where("maybe").select("row", F.col("row.doc_id").cast("long").alias("id"), F.coalesce(text_key("row.text"), no_text).alias("key"))
    left = keyed.join(found.where("keep"), F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.xxhash64(*plain)))
    return judged.where("NOT maybe").select("row.*").unionByName(left.withColumn("place", first).where("place = 1").select("row.*"))

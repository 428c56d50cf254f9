"""Quality rules on repetition inside a document, by suffix array and longest-common-prefix intervals.

The suffixes of a document's UTF-8 bytes are sorted by prefix doubling; the LCP
array of neighbours gives, for each suffix, its longest prefix that occurs again:
the length of the deepest LCP interval the suffix lies in. An interval of at least
``min_length`` bytes is a maximal repeated substring, and the union of all its
occurrences over all intervals equals the union of these prefixes, which is taken. A document
stays if repeats cover no more than ``max_fraction`` of it and none is longer than
``max_longest`` bytes.

A document none of whose windows of ``min_length`` bytes occurs twice has no such
repeat; this is found by hashing for all documents first, exactly (an equal hash
only sends the document on to its suffix array). Lengths are not limited.

Defined results: a null or empty text has 0 bytes, nothing covered, and stays;
occurrences may overlap, so a run of one character is a repeat of all but one of
its bytes; repeated rows and null doc_ids get a row each; texts of any length are
measured whole; nothing depends on an order, so there are no ties; columns besides
doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import mix, pieces, powers, prefix_hash, prepare, text_buffers

MIN_LENGTH = 50
MAX_FRACTION = 0.4
MAX_LONGEST = 1000


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in lexicographic order; a shorter suffix comes before those it begins."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    # Seven bytes at first: nine bits each, 0 past the end.
    wide = np.zeros(n + 7, np.int64)
    wide[:n] = data.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | wide[k : k + n]
    h = 7
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - h)] = rank[h:] + 1
        key = rank * (n + 1) + after
        h *= 2


def _match(data: np.ndarray, i: int, j: int) -> int:
    """Length of the common prefix of two suffixes, found in pieces of growing length."""
    n, done, step = len(data) - max(i, j), 0, 64
    while done < n:
        size = min(step, n - done)
        differ = data[i + done : i + done + size] != data[j + done : j + done + size]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + size, min(2 * step, 1 << 20)
    return n


def lcp_array(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order; 0 for the first. Exact, by comparing bytes.

    In text order a suffix shares with its neighbour one byte less than the suffix
    before it did, if both are preceded by the same byte. Only the others are
    compared; their common prefixes sum to no more than 2 n log n bytes.
    """
    n = len(data)
    if n < 2:
        return np.zeros(n, np.int64)
    left = np.full(n, -1, np.int64)
    left[order[1:]] = order[:-1]
    at = np.arange(n)
    same = np.zeros(n, bool)
    same[1:] = (left[1:] > 0) & (data[np.maximum(left[1:], 1) - 1] == data[:-1])
    same[left < 0] = False
    start = np.flatnonzero(~same)
    found = np.zeros(len(start), np.int64)
    open_ = np.flatnonzero(left[start] >= 0)
    while len(open_) > 64:
        i, j = start[open_] + found[open_], left[start[open_]] + found[open_]
        inside = np.maximum(i, j) < n
        i, j, open_ = i[inside], j[inside], open_[inside]
        open_ = open_[data[i] == data[j]]
        found[open_] += 1
    for k in open_:
        found[k] += _match(data, int(start[k] + found[k]), int(left[start[k]] + found[k]))
    # A suffix that continues the one before it: that one's prefix, less the way between.
    back = np.cumsum(~same) - 1
    plcp = np.maximum(found[back] - (at - start[back]), 0)
    out = np.zeros(n, np.int64)
    out[1:] = plcp[order[1:]]
    return out


def repeats(data: np.ndarray, min_length: int) -> tuple[int, int]:
    """Bytes covered by repeated substrings of at least min_length, and the longest one's length (any length)."""
    n = len(data)
    if n < 2:
        return 0, 0
    order = suffix_array(data)
    lcp = lcp_array(data, order)
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    at = np.flatnonzero(longest >= min_length)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return int((np.cumsum(edge)[:n] > 0).sum()), int(longest.max())


def suspects(raw: np.ndarray, off: np.ndarray, min_length: int) -> np.ndarray:
    """Rows in which some window of min_length bytes seems to occur twice."""
    n = len(raw) - min_length + 1
    if n < 2:
        return np.zeros(0, np.int64)
    total, (_, down) = prefix_hash(raw), powers(len(raw) + 1)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    with np.errstate(over="ignore"):
        window = (total[min_length:] - total[:-min_length]) * down[:n]
        inside = row[:n] == row[min_length - 1 :]
        key = mix(window + mix(row[:n].astype(np.uint64)))[inside]
    ranked = np.sort(key)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    coarse = np.zeros(1 << 16, bool)
    coarse[(twice & np.uint64(0xFFFF)).astype(np.int64)] = True
    some = np.flatnonzero(coarse[(key & np.uint64(0xFFFF)).astype(np.int64)])
    some = some[twice[np.minimum(np.searchsorted(twice, key[some]), len(twice) - 1)] == key[some]]
    return np.unique(row[:n][inside][some])


def _measure(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            for lo, hi in pieces(off):
                own, rel = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                covered, longest = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for d in suspects(own, rel, min_length):
                    covered[d], longest[d] = repeats(own[rel[d] : rel[d + 1]], min_length)
                longest[longest < min_length] = 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(rel)), pa.array(covered), pa.array(longest)], ["doc_id", "n_bytes", "covered_bytes", "longest_repeat"])

    return run


def repetition(docs: DataFrame, min_length: int = MIN_LENGTH, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST) -> DataFrame:
    """(doc_id, n_bytes, covered_bytes, longest_repeat, covered_fraction, keep); a repeat below min_length counts as 0."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = own.mapInArrow(_measure(min_length), "doc_id long, n_bytes long, covered_bytes long, longest_repeat long")
    share = F.when(F.col("n_bytes") > 0, F.col("covered_bytes") / F.col("n_bytes")).otherwise(F.lit(0.0))
    return found.withColumn("covered_fraction", share).withColumn("keep", (F.col("covered_fraction") <= max_fraction) & (F.col("longest_repeat") <= max_longest))

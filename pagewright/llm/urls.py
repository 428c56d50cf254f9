"""URL filter: a cascade of Bloom filters over the corpus's complete key universe.

Level 1 holds the listed keys. Level 2 holds the unlisted keys of the universe that
level 1 takes for listed, level 3 the listed keys that level 2 takes for those, and
so on until a level has no false positive. A key's answer is then exact: it is
listed if the first level that misses it is an even one (or, if none does, if their
number is odd). Pages are filtered by these bits alone; no key is joined.

Keys are (scheme, host, path): lower-case scheme and host, no "www." or "m.", no
query or fragment, no final slash. A key is known by two independent 64-bit hashes;
a third one shows whether two keys share both, which raises an error. The universe
is cut by hash into shards of about SHARD_KEYS keys, each with a cascade of its own,
built in one task. Cascades of at most ``max_bytes`` together go to every worker;
larger ones stay where they are and pages are sent to their shard, hot shards split.
The filters, and so the answers, are the same either way.

Defined results: a null URL has a null key and is not listed; an empty URL's key is
empty; URLs of any length are read whole; repeated rows get equal answers, so there
are no ties; with no listed keys nothing is listed; an empty table gives no rows;
columns besides page_id and url are not read. A listed key outside the universe is
part of it. The answer for a key outside the universe is not defined, which is why
the universe holds every page's key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import cut, mix, prepare

MAX_BYTES = 64 << 20
RATE = 0.1
SHARD_KEYS = 2_000_000
#: Pages to a task where pages are sent to shards.
ROUTED_ROWS = 100_000
MAX_LEVELS = 64


def url_key(url: str | Column = "url") -> Column:
    """The URL without what does not name the page."""
    u = F.col(url) if isinstance(url, str) else url
    bare = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"/+$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)?", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.concat(F.regexp_replace(head, r"://(www\.|m\.)+", "://"), rest)


def tracked(url: str = "url") -> Column:
    """Whether the URL carries a tracking parameter."""
    return F.col(url).rlike(r"[?&](utm_[a-z]+|ref)=")


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit positions of each key, a row each, by double hashing salted with the level."""
    with np.errstate(over="ignore"):
        a = mix(h1.view(np.uint64) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        b = mix(h2.view(np.uint64) ^ np.uint64(level)) | np.uint64(1)
        return (a[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)


def shape(keys: int, rate: float) -> tuple[int, int]:
    """Bits and hashes for so many keys at this rate of false positives."""
    return max(64, math.ceil(max(keys, 1) * -math.log(rate) / math.log(2) ** 2)), max(1, round(-math.log2(rate)))


class Cascade:
    """Levels of (bits, hashes, data)."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]] | None = None) -> None:
        self.levels = levels or []

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, listed: np.ndarray, rate: float) -> Cascade:
        """The cascade of a universe of distinct keys."""
        made, inside, outside = cls(), np.flatnonzero(listed), np.flatnonzero(~listed)
        # The first level lets through about as many others as half the listed keys, the next ones a tenth each.
        now = min(0.5, max(1e-6, 0.5 * len(inside) / max(len(outside), 1)))
        while len(inside):
            level = len(made.levels)
            if level == MAX_LEVELS:
                raise ValueError("keys that the levels cannot tell apart")
            bits, hashes = shape(len(inside), now)
            on = np.zeros(-(-bits // 8) * 8, np.uint8)
            for lo in range(0, len(inside), 1 << 18):
                part = inside[lo : lo + (1 << 18)]
                on[positions(h1[part], h2[part], level, bits, hashes).ravel().astype(np.int64)] = 1
            made.levels.append((bits, hashes, np.packbits(on, bitorder="little")))
            wrong = outside[made.hits(level, h1[outside], h2[outside])] if len(outside) else outside
            inside, outside, now = wrong, inside, rate
        return made

    def hits(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, hashes, data = self.levels[level]
        out = np.empty(len(h1), bool)
        for lo in range(0, len(h1), 1 << 18):
            at = positions(h1[lo : lo + (1 << 18)], h2[lo : lo + (1 << 18)], level, bits, hashes)
            out[lo : lo + (1 << 18)] = (data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
        return out

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for the keys of the universe: at which level each is missed first."""
        answer = np.full(len(h1), len(self.levels) % 2 == 1)
        rest = np.arange(len(h1))
        for level in range(len(self.levels)):
            hit = self.hits(level, h1[rest], h2[rest])
            answer[rest[~hit]] = level % 2 == 1
            rest = rest[hit]
        return answer


def _build(rate: float):
    def run(keys: pa.Table) -> pa.Table:
        if keys.num_rows and not np.array_equal(keys.column("h3").to_numpy(), keys.column("h3_most").to_numpy()):
            raise ValueError("two keys share both hashes")
        made = Cascade.of(keys.column("h1").to_numpy(), keys.column("h2").to_numpy(), keys.column("listed").to_numpy(), rate)
        shape_of = [pa.array([[x[k] for x in made.levels]], pa.list_(kind)) for k, kind in ((0, pa.int64()), (1, pa.int32()))]
        data = pa.array([[x[2].tobytes() for x in made.levels]], pa.list_(pa.binary()))
        return pa.table([keys.column("shard").slice(0, 1), *shape_of, data], ["shard", "bits", "hashes", "data"])

    return run


def _cascade(bits: list, hashes: list, data: list) -> Cascade:
    return Cascade([(b, h, np.frombuffer(d, np.uint8)) for b, h, d in zip(bits, hashes, data)])


def hashed(key: Column) -> list[Column]:
    """Two hashes from different seeds; a chained second one would depend on the first alone."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def build(universe: DataFrame, rate: float = RATE, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(shard, bits, hashes, data) of a universe (key, listed), and the number of shards; a key's shard is h1 modulo that number."""
    prepare(universe.sparkSession)
    known = universe.where("key IS NOT NULL").select(*hashed(F.col("key")), F.xxhash64(F.lit(2), F.col("key")).alias("h3"), "listed")
    keys = cut(known.groupBy("h1", "h2").agg(F.max("listed").alias("listed"), F.min("h3").alias("h3"), F.max("h3").alias("h3_most")))
    shards = max(1, -(-keys.count() // shard_keys))
    return cut(keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build(rate), "shard long, bits array<long>, hashes array<int>, data array<binary>")), shards


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("long").alias("shard")


def _answers(pages: pa.RecordBatch | pa.Table, cascade_of) -> list[pa.Array]:
    key = pages.column("key")
    h1, h2, shard = (pages.column(c).to_numpy() for c in ("h1", "h2", "shard"))
    listed = np.zeros(len(h1), bool)
    for s in np.unique(shard):
        some = shard == s
        cascade = cascade_of(int(s))
        if cascade is not None:
            listed[some] = cascade.listed(h1[some], h2[some])
    return [pages.column("page_id"), pages.column("url"), key, pa.array(listed & ~key.is_null().to_numpy())] if isinstance(pages, pa.Table) else [pages.column("page_id"), pages.column("url"), key, pa.array(listed & ~key.is_null().to_numpy(zero_copy_only=False))]


_NAMES = ["page_id", "url", "key", "listed"]


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_answers(batch, shared.value.get), _NAMES)

    return run


def _apply_routed(pages: pa.Table, filters: pa.Table) -> pa.Table:
    own = {r["shard"]: _cascade(r["bits"], r["hashes"], r["data"]) for r in filters.to_pylist()}
    return pa.table(_answers(pages, own.get), _NAMES)


def _routed(own: DataFrame, filters: DataFrame) -> DataFrame:
    """Each page at a task that holds its shard's cascade; a shard with many pages has several such tasks."""
    spark = own.sparkSession
    load = own.groupBy("shard").count().select("shard", F.ceil(F.col("count") / ROUTED_ROWS).cast("long").alias("parts")).collect()
    # A row for each shard, of which there are few by SHARD_KEYS.
    parts = F.broadcast(spark.createDataFrame([tuple(r) for r in load], "shard long, parts long"))
    dealt = own.join(parts, "shard").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts"))).drop("parts")
    copies = filters.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "bits", "hashes", "data")
    return dealt.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_apply_routed, "page_id long, url string, key string, listed boolean")


def filter_urls(pages: DataFrame, listed: DataFrame, rate: float = RATE, max_bytes: int = MAX_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(page_id, url, key, listed) for each page; ``listed`` has a column key."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumn("key", url_key())
    marks = listed.select("key").where("key IS NOT NULL")
    universe = own.select("key", F.lit(False).alias("listed")).unionByName(marks.withColumn("listed", F.lit(True)))
    filters, shards = build(universe, rate, shard_keys)
    known = own.select("*", *hashed(F.col("key"))).withColumn("shard", _shard(shards))
    size = filters.agg(F.sum(F.aggregate("data", F.lit(0).cast("long"), lambda n, d: n + F.length(d)))).first()[0] or 0
    if size > max_bytes:
        return _routed(known, filters)
    held = {r["shard"]: _cascade(r["bits"], r["hashes"], r["data"]) for r in filters.collect()}
    shared = pages.sparkSession.sparkContext.broadcast(held)
    return known.mapInArrow(_apply(shared), "page_id long, url string, key string, listed boolean")


def tracked_pages(pages: DataFrame) -> DataFrame:
    """filter_urls with, as its list, the keys of all pages seen with a tracking parameter anywhere."""
    return filter_urls(pages, pages.where(tracked()).select(url_key().alias("key")))


ORACLE = r"""WITH known AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS bare FROM pages),
keyed AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)?', 1)), '://(www\.|m\.)+', '://')
  || regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS key FROM known)
SELECT page_id, url, key, COALESCE(key IN (SELECT key FROM keyed WHERE key IS NOT NULL AND regexp_matches(url, '[?&](utm_[a-z]+|ref)=')), FALSE) AS listed FROM keyed"""

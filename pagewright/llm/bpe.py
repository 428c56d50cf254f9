"""BPE encoding through a table of distinct words, and decoding through a table of pieces.

Spark splits texts into words with the vocabulary's own pattern. Rows are taken in
chunks of about ``chunk_bytes``; a chunk's words are numbered, most frequent first, so
that its rows are lists of small numbers. The chunks' distinct words are brought
together by word, where each distinct word of the corpus is encoded once; the ids go
back to the chunks that hold the word, and are put in their rows' places. Decoding
joins ids to the bytes of their pieces, a table as large as the vocabulary. Nothing
is broadcast and no text is moved: what is shuffled are the numbers and each chunk's
distinct words, in proportion to the input at every size.

The rows are read twice, for their words and for their numbers, so they must come in
the same order both times, as from files. ``stable`` says that they do; otherwise they
are written to the shared folder first. A chunk whose words differ between the two
readings raises an error.

Defined results: a null text gives null ids, an empty one gives no ids; repeated
rows and null doc_ids are encoded row by row; every text decodes to itself; texts of
any length are encoded whole, a long one as a chunk of its own; there are no ties; an
empty table gives no rows; of other columns those named are kept, whatever their names.
Special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import cut, pieces, prepare, ragged, span_hashes, text_buffers

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The rank file's own pattern; (?U) gives Java's \s the Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_BYTES = 24 << 20


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[object, pa.Array]:
    """The encoder of a rank file, and the pieces by id."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    by_id = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = piece
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), pa.array(by_id, pa.large_binary())


def split(text: str = "text") -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))


def _gather(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Number and rows of chunks of about ``limit`` bytes of words, each row counted as 64 bytes more."""
    held, size, number = [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        bounds, _, off = _words(batch)
        at = off[bounds] + 64 * np.arange(len(bounds))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(at, at[lo] + limit - size, "right")) - 1
            if hi <= lo and held:
                yield number, held
                held, size, number = [], 0, number + 1
                continue
            hi = max(hi, lo + 1)
            held.append(batch.slice(lo, hi - lo))
            size += int(at[hi] - at[lo])
            lo = hi
    if held:
        yield number, held


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Bounds of the rows among the words of the last column, the words, and their bounds in bytes."""
    lists = batch.column(batch.num_columns - 1)
    flat = lists.flatten()
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)]), flat, text_buffers(flat)[1]


def _numbered(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array, int]:
    """Number of each word in the chunk, the words by number, and a mark of these."""
    found = pa.concat_arrays([b.column(b.num_columns - 1).flatten() for b in rows]).dictionary_encode()
    code = found.indices.to_numpy()
    order = np.argsort(-np.bincount(code, minlength=len(found.dictionary)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    words = found.dictionary.take(pa.array(order))
    raw, off = text_buffers(words)
    return rank[code], words, xxhash.xxh3_64_intdigest(off.tobytes() + raw.tobytes()) >> 1


def _asked(limit: int, buckets: int):
    """(bucket, chunk, mark, places, sizes, words): each chunk's distinct words, by a hash of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _gather(batches, limit):
            _, words, mark = _numbered(rows)
            raw, off = text_buffers(words)
            bucket = (span_hashes(raw, off[:-1], off[1:]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            raw, off = text_buffers(words.take(pa.array(order)))
            some = np.flatnonzero(np.diff(ends))
            spans = [(int(ends[b]), int(ends[b + 1])) for b in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some.astype(np.int32)),
                    pa.array(np.full(len(some), chunk, np.int64)),
                    pa.array(np.full(len(some), mark, np.int64)),
                    pa.array([_squeezed(_varints(np.diff(order[x:y], prepend=0))) for x, y in spans], pa.binary()),
                    pa.array([_squeezed(_varints(np.diff(off[x : y + 1]))) for x, y in spans], pa.binary()),
                    pa.array([_squeezed(raw[off[x] : off[y]].tobytes()) for x, y in spans], pa.binary()),
                ],
                ["bucket", "chunk", "mark", "places", "sizes", "words"],
            )

    return run


def _encoded(path: str):
    """(chunk, mark, places, counts, ids) of each row of words; a word's rows are all in one partition, where it is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = vocabulary(path)[0].encode_ordinary, {}

        def ids_of(word: bytes) -> list[int]:
            found = known.get(word)
            if found is None:
                found = known[word] = encode(word.decode())
            return found

        for batch in batches:
            for i in range(batch.num_rows):
                ends = np.cumsum(_values(_unsqueezed(batch.column("sizes")[i].as_py()))).tolist()
                words = _unsqueezed(batch.column("words")[i].as_py())
                ids = [ids_of(words[a:b]) for a, b in zip([0, *ends], ends)]
                packed = [pa.array([_squeezed(_varints(np.array(x, np.int64)))], pa.binary()) for x in ([len(x) for x in ids], [y for x in ids for y in x])]
                own = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([own.column("chunk"), own.column("mark"), own.column("places"), *packed], ["chunk", "mark", "places", "counts", "ids"])

    return run


def _squeezed(raw: bytes) -> bytes:
    """Compressed, after its length in four bytes."""
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True) if raw else b""


def _unsqueezed(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[4:], int.from_bytes(raw[:4], "little"), asbytes=True) if raw else b""


def _varints(values: np.ndarray) -> bytes:
    """Non-negative numbers, seven bits to a byte, the last byte of each below 128."""
    v = np.asarray(values, np.int64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 5):
        size += v >= 1 << (7 * k)
    at, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[at[some] + k] = (v[some] >> (7 * k) & 127) | np.where(size[some] > k + 1, 128, 0)
    return out.tobytes()


def _values(raw: bytes) -> np.ndarray:
    """The numbers of _varints; of several of its outputs, one after the other."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    end = np.flatnonzero(b < 128)
    start = np.concatenate([[0], end[:-1] + 1])
    shift = 7 * (np.arange(len(b)) - np.repeat(start, end - start + 1))
    return np.add.reduceat((b & 127).astype(np.int64) << shift, start)


def _rows(limit: int):
    """(chunk, mark, row, n, codes): each row's words as numbers of its chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _gather(batches, limit):
            code, _, mark = _numbered(rows)
            at = 0
            for batch in rows:
                lists, bounds = batch.column(1), _words(batch)[0] + at
                at = int(bounds[-1])
                null = lists.is_null()
                codes = pa.array([None if x else _squeezed(_varints(code[a:b])) for a, b, x in zip(bounds[:-1], bounds[1:], null.to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), chunk)), pa.array(np.full(len(lists), mark)), batch.column(0), pa.array(np.diff(bounds)), codes], ["chunk", "mark", "row", "n", "codes"])

    return run


def _put_back(path: str, decoded: bool):
    """(row, token_ids, and decoded) of the rows of a chunk."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        if len(set(rows.column("mark").unique().to_pylist()) | set(found.column("mark").unique().to_pylist())) > 1:
            raise ValueError("the rows came in another order when they were read again: encode them with stable=False")
        place = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_values(_unsqueezed(x))) for x in found.column("places").to_pylist())])
        count, ids = (_values(b"".join(map(_unsqueezed, found.column(c).to_pylist()))) for c in ("counts", "ids"))
        start, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        start[place], size[place] = np.cumsum(count) - count, count
        n = rows.column("n").to_numpy()
        bounds, null, codes = np.concatenate([[0], np.cumsum(n)]), rows.column("codes").combine_chunks().is_null().to_numpy(zero_copy_only=False), rows.column("codes")
        back, lists, texts = Pieces(path) if decoded else None, [], []
        for lo, hi in pieces(bounds, 200_000):
            code = _values(b"".join(_unsqueezed(x) for x in codes.slice(lo, hi - lo).to_pylist() if x))
            each = size[code]
            ends = np.concatenate([[0], np.cumsum(each)])[bounds[lo : hi + 1] - bounds[lo]]
            got = ids[ragged(start[code], each)]
            lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(got.astype(np.int32)), mask=pa.array(null[lo:hi])))
            if back is not None:
                texts.append(back.join(got, ends, null[lo:hi]))
        made = [pa.chunked_array(lists, pa.list_(pa.int32()))] + ([pa.chunked_array(texts, pa.string())] if decoded else [])
        return pa.table([rows.column("row"), *made], ["row", "token_ids", "decoded"][: 1 + len(made)])

    return run


def encode(docs: DataFrame, columns: list[str], path: str = RANKS, stable: bool = False, decoded: bool = False, chunk_bytes: int = CHUNK_BYTES, buckets: int | None = None) -> DataFrame:
    """The columns named and token_ids array<int>, a row for each row of docs; with ``decoded`` also the text of these ids.

    ``buckets`` is the number of parts in which distinct words are encoded, by default that of the session's shuffles.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    if not stable:
        own = cut(own)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = own.select(split().alias("words")).mapInArrow(_asked(chunk_bytes, buckets), "bucket int, chunk long, mark long, places binary, sizes binary, words binary")
    ids = words.repartition(buckets, "bucket").mapInArrow(_encoded(path), "chunk long, mark long, places binary, counts binary, ids binary")
    kept = own.schema["row"]
    coded = own.select("row", split().alias("words")).mapInArrow(_rows(chunk_bytes), T.StructType([T.StructField("chunk", T.LongType()), T.StructField("mark", T.LongType()), kept, T.StructField("n", T.LongType()), T.StructField("codes", T.BinaryType())]))
    made = T.StructType([kept, T.StructField("token_ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])])
    return coded.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_put_back(path, decoded), made).select("row.*", *made.names[1:])


class Pieces:
    """The id-to-piece table; as large as the vocabulary, whatever the corpus."""

    def __init__(self, path: str):
        self.raw, self.start = text_buffers(vocabulary(path)[1])
        self.size = np.diff(self.start)

    def join(self, ids: np.ndarray, ends: np.ndarray, null: np.ndarray) -> pa.Array:
        """Texts of the rows that ``ends`` bounds among the ids."""
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])[ends].astype(np.int32)
        data = self.raw[ragged(self.start[ids], size)]
        valid = np.packbits(~null, bitorder="little").tobytes()
        return pa.StringArray.from_buffers(len(null), pa.py_buffer(at), pa.py_buffer(data), pa.py_buffer(valid))


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(path)
        for batch in batches:
            lists = batch.column("token_ids")
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            ids, null = lists.flatten().to_numpy(), lists.is_null().to_numpy(zero_copy_only=False)
            for lo, hi in pieces(bounds, 300_000):
                text = table.join(ids[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], null[lo:hi])
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns], text], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """The rows with ``decoded``, the text of their token_ids."""
    prepare(encoded.sparkSession)
    return encoded.mapInArrow(_decoder(path), encoded.select("*").schema.add("decoded", T.StringType()))


def encode_and_decode(docs: DataFrame, path: str = RANKS, **options) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded) for each row."""
    found = encode(docs, ["doc_id"], path, decoded=True, **options)
    return found.select("doc_id", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"), "token_ids", "decoded")

"""Heading hierarchy over ordered elements (doc_id, page_no, pos, type, content, ...).

Order is (page_no, pos) inside a document. Everything that only looks at neighbours
is a window; the stacks of open headings, which are not, are kept while a partition's
headings pass by in order, so neither bodies nor a document's headings are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import numbering as num

MAX_LEVEL = 6
FURNITURE_PAGES, FURNITURE_SHARE, FURNITURE_TITLE = 5, 0.6, 40
CONTINUED = r"(?iU)\(\s*(계\s*속|이어서|이어짐|cont(inued|['’]?d)?)\s*\)"
_ORDER = ("page_no", "pos")


def _doc() -> Window:
    return Window.partitionBy("doc_id").orderBy(*_ORDER)


def is_heading(kind: Column) -> Column:
    return F.coalesce(kind.isin(*num.HEADINGS), F.lit(False))


def drop_toc_entries(elements: DataFrame) -> DataFrame:
    return elements.where(~F.col("type").eqNullSafe("toc_entry"))


def drop_furniture(elements: DataFrame) -> DataFrame:
    """Running heads: of a short heading found on at least 60 % of five or more pages (three at least) only the first stays."""
    title = F.when(F.coalesce(F.col("type"), F.lit("")).startswith("heading"), num.plain_title(F.col("content")))
    by_doc, by_title = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "__title")
    # Distinct pages as the greatest dense rank: two shuffles, no self-join.
    e = elements.withColumn("__title", title).withColumn("__page", F.dense_rank().over(by_doc.orderBy("page_no")))
    e = e.withColumn("__pages", F.max("__page").over(by_doc))
    e = e.withColumns({"__on": F.dense_rank().over(by_title.orderBy("page_no")), "__nth": F.row_number().over(by_title.orderBy(*_ORDER))})
    e = e.withColumn("__on", F.max("__on").over(by_title))
    often = (F.col("__pages") >= FURNITURE_PAGES) & (F.col("__on") >= F.greatest(F.lit(3), F.floor(F.col("__pages") * FURNITURE_SHARE)))
    running = (F.col("__title") != "") & (F.length("__title") <= FURNITURE_TITLE) & often
    return e.where(~F.coalesce(running, F.lit(False)) | (F.col("__nth") == 1)).select(*elements.columns)


def _in_order(elements: DataFrame) -> DataFrame:
    """A document's elements in one partition, in order; a window over documents before or after needs no other shuffle."""
    return elements.repartition("doc_id").sortWithinPartitions("doc_id", *_ORDER)


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows whose heading (__level not null, __plain, __turn, __marked) continues an open one; the rest pass as they are."""
    last, titles = object(), []
    for batch in batches:
        keep = []
        for doc, level, title, turn, marked in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "__level", "__plain", "__turn", "__marked"))):
            if doc != last:
                last, titles = doc, []
            again = level is not None and (marked or (turn and title != "" and any(t == title for _, t in titles)))
            keep.append(not again)
            if level is not None and not again:
                titles = [(n, t) for n, t in titles if n < level]
                titles.append((level, title))
        yield batch.filter(pa.array(keep, pa.bool_())).select([c for c in batch.schema.names if c not in _MARKS])


_MARKS = ("__level", "__plain", "__turn", "__marked")


def merge_continued(elements: DataFrame) -> DataFrame:
    """Without headings marked as continued, or that repeat an open heading's title just after a page break.

    The open titles are a stack by the model's own levels. All rows pass the stack, so they are not made twice for a join.
    """
    page_before = F.lag("page_no").over(_doc())
    head = is_heading(F.col("type"))
    e = elements.withColumns(
        {
            "__level": F.when(head, F.substring("type", 9, 1).cast("int")),
            "__plain": F.when(head, num.plain_title(F.col("content"))),
            "__turn": F.coalesce(page_before != F.col("page_no"), F.lit(False)),
            "__marked": head & F.coalesce("content", F.lit("")).rlike(CONTINUED),
        }
    )
    return _in_order(e).mapInArrow(_gone, elements.schema)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with level and heading_path in place of __rank and __head; a body has those of the heading before it."""
    last, ranks, titles, level, path = object(), [], [], None, None
    for batch in batches:
        levels, paths = [], []
        for doc, head, rank, title in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "__head", "__rank", "title"))):
            if doc != last:
                last, ranks, titles, level, path = doc, [], [], None, None
            if head:
                ranks = [r for r in ranks if r < rank]
                level = min(len(ranks) + 1, MAX_LEVEL)
                ranks.append(rank)
                titles = [(n, t) for n, t in titles if n < level]
                titles.append((level, title))
                path = [t for _, t in titles]
            levels.append(level)
            paths.append(path)
        kept = [i for i, c in enumerate(batch.schema.names) if c != "__rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(levels, pa.int32()), pa.array(paths, pa.list_(pa.string()))], [*(batch.schema.names[i] for i in kept), "level", "heading_path"])


def normalise(elements: DataFrame) -> DataFrame:
    """Adds level (null for bodies), title, heading_path and section (0 before the first heading), with type set anew.

    Prose that begins an article is promoted; a list sentence, or a fragment after an
    unfinished line, is demoted. Levels are one more than the number of open headings of lower rank,
    six at most. A column section_root (boolean), if there is one, makes its headings roots.
    """
    kind, content = F.col("type"), F.col("content")
    promoted = F.when(is_heading(kind), kind).when(num.is_promotable(kind, content), F.lit("heading_1")).when(num.is_definition(content), F.lit("heading_2")).otherwise(kind)
    e = elements.withColumn("__kind", promoted)
    w = _doc()
    # Expressions over texts only where their outcome counts: tables are most of the text.
    ends = F.when(F.col("__kind").isin("text", "paragraph", *num.HEADINGS), num.ends_open(content)).otherwise(F.lit(False))
    e = e.withColumns({"__ends": ends, "__rank": F.when(is_heading(F.col("__kind")), num.rank(content, F.col("__kind")))})
    e = e.withColumn("__open", F.coalesce(F.lag("__ends").over(w), F.lit(False)))
    e = e.withColumn("__may", is_heading(F.col("__kind")) & ~num.is_clause(content))
    earlier = F.max(F.col("__may").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("__first", F.coalesce(earlier, F.lit(0)) == 0)
    e = e.withColumn("__head", F.col("__may") & ~(~F.col("__first") & F.col("__open") & (F.col("__rank") >= 90)))
    root = F.col("section_root") if "section_root" in elements.columns else F.lit(False)
    rank = F.when(F.coalesce(root, F.lit(False)), F.lit(1)).when(F.col("__first") & num.marker(content).isNull() & (F.col("__rank") >= 10), F.lit(1)).otherwise(F.col("__rank"))
    e = e.withColumns({"__rank": rank, "title": F.when(F.col("__head"), num.title(content)), "section": F.sum(F.col("__head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")})

    e = e.select(*elements.columns, "__kind", F.col("__head"), F.col("__rank").cast("int").alias("__rank"), "title", "section")
    made = T.StructType([*[f for f in e.schema.fields if f.name != "__rank"], T.StructField("level", T.IntegerType()), T.StructField("heading_path", T.ArrayType(T.StringType()))])
    joined = _in_order(e).mapInArrow(_levels, made)
    head_type = F.concat(F.lit("heading_"), F.col("level").cast("string"))
    body_type = F.when(is_heading(F.col("__kind")), F.lit("text")).otherwise(F.col("type"))
    return joined.select(
        *[c for c in elements.columns if c != "type"],
        F.when(F.col("__head"), head_type).otherwise(body_type).alias("type"),
        F.when(F.col("__head"), F.col("level")).alias("level"),
        "title",
        F.coalesce("heading_path", F.expr("cast(array() as array<string>)")).alias("heading_path"),
        "section",
        F.coalesce("level", F.lit(0)).alias("depth"),
    )


def prepared(elements: DataFrame) -> DataFrame:
    """The order matters: contents entries, running heads, continued headings, then levels."""
    return normalise(merge_continued(drop_furniture(drop_toc_entries(elements))))


def recover_annexes(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """The elements and, before the first of a page whose text layer (doc_id, page_no, text) begins with an annex title, a heading
    of that title, unless the page begins with it or with another annex heading. Its place is one before the page's first."""
    line = F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), r"(?U)^\s*([^\n\r]*)", 1))
    first = texts.select("doc_id", "page_no", line.alias("annex")).where((F.col("annex") != "") & num.is_annex(F.col("annex")) & (num.rank(F.col("annex"), F.lit("heading_1")) == 1))
    heads = elements.groupBy("doc_id", "page_no").agg(F.min_by(F.struct("pos", "type", "content"), "pos").alias("e"))
    said = F.trim(F.coalesce("e.content", F.lit("")))
    new = heads.join(first, ["doc_id", "page_no"]).where(~said.startswith(F.left("annex", F.lit(10))) & (num.rank(said, F.col("e.type")) != 1))
    shown = {"pos": (F.col("e.pos") - 1).cast(elements.schema["pos"].dataType), "type": F.lit("heading_1"), "content": F.col("annex"), "doc_id": F.col("doc_id"), "page_no": F.col("page_no")}
    return elements.unionByName(new.select(*[shown.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in elements.schema.fields]))

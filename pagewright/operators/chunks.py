"""Retrieval chunks by page, by section and by heading tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import numbering as num
from pagewright.operators.headings import is_heading, prepared

MAX_CHARS = 4000
PATH_SEPARATOR = " > "


def size(*names: str) -> Column:
    """Characters of the text fields, nulls as empty."""
    total = F.lit(0)
    for n in names or ("content", "caption"):
        total = total + F.length(F.coalesce(F.col(n), F.lit("")))
    return total


def _sections(normalised: DataFrame) -> DataFrame:
    return normalised.groupBy("doc_id", "section").agg(
        F.max("depth").alias("depth"),
        F.max_by("heading_path", "section").alias("path"),
        F.count("*").alias("n_elements"),
        F.sum(size()).alias("n_chars"),
        F.min("page_no").alias("page_lo"),
        F.max("page_no").alias("page_hi"),
    )


def by_section(elements: DataFrame) -> DataFrame:
    """A chunk from each heading to the next; what precedes the first is a chunk of its own and is counted."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("section"))
    return _sections(prepared(elements)).select("doc_id", F.format_string("toc_%04d", nth).alias("chunk_id"), F.array_join("path", PATH_SEPARATOR).alias("heading_path"), "n_elements", "n_chars", "page_lo", "page_hi")


def by_tree(elements: DataFrame) -> DataFrame:
    """The same cuts with the heading's depth; ids count headings, 0 being what precedes the first."""
    return _sections(prepared(elements)).select("doc_id", F.format_string("tree_%04d", F.col("section")).alias("chunk_id"), "depth", F.array_join("path", PATH_SEPARATOR).alias("heading_path"), "n_elements", "n_chars", "page_lo", "page_hi")


def _opens_section(kind: Column, content: Column) -> Column:
    """Prose whose first line is a part, chapter or annex title."""
    lead = F.regexp_replace(F.substring(F.split_part(F.trim(F.coalesce(content, F.lit(""))), F.lit("\n"), F.lit(1)), 1, 80), r"^[\[ \t]+", "")
    bare = F.regexp_replace(lead, "(?U)" + num.ANNEX_SEPARATORS, "")
    annex = F.lit(False)
    for word in num.ANNEX:
        rest = F.substr(bare, F.lit(len(word) + 1))
        annex = annex | (bare.startswith(word) & (F.lit(len(word) >= 4) | (rest == "") | rest.rlike(r"(?U)^[\d(\[<]")))
    return F.coalesce(kind.isin("text", "paragraph") & (num.marker(lead).isin("part", "chapter", "roman") | annex), F.lit(False))


def by_page(elements: DataFrame) -> DataFrame:
    """A chunk a page, with its last heading's path, or the one carried over from the last page that had one.

    A page without headings that opens a new section clears what is carried on.
    """
    e = prepared(elements)
    pages = e.groupBy("doc_id", "page_no").agg(
        F.max_by("heading_path", F.when(is_heading(F.col("type")), F.struct("section"))).alias("own"),
        F.bool_or(_opens_section(F.col("type"), F.col("content"))).alias("opens"),
        F.count("*").alias("n_elements"),
        F.sum(size()).alias("n_chars"),
    )
    # An opening page without headings carries the empty path on, so one look back finds what holds.
    pages = pages.withColumn("holds", F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("opens"), F.expr("cast(array() as array<string>)")))
    w = Window.partitionBy("doc_id").orderBy("page_no")
    last = F.coalesce(F.last("holds", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.expr("cast(array() as array<string>)"))
    return pages.withColumn("path", last).select(
        "doc_id",
        F.format_string("page_%04d", F.col("page_no")).alias("chunk_id"),
        F.array_join("path", PATH_SEPARATOR).alias("heading_path"),
        (F.col("own").isNull() & (F.size("path") > 0)).alias("inherited"),
        "n_elements",
        "n_chars",
        F.col("page_no").alias("page_lo"),
        F.col("page_no").alias("page_hi"),
    )


STRATEGIES = {"page": by_page, "toc": by_section, "tree": by_tree}


def chunk(elements: DataFrame, strategies: tuple[str, ...] = ("page", "toc", "tree")) -> dict[str, DataFrame]:
    """The named strategies' chunks; without a structured page only page chunks can be made."""
    return {s: STRATEGIES[s](elements) for s in strategies if s in STRATEGIES}


def split_text(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, cut at sentence ends where possible; a longer sentence is cut by length."""
    whole = F.split(text, "(?U)(?<=[\n。?!.])" + r"\s+")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("parts"), F.lit("").alias("buf"))

    def closed(state: Column) -> Column:
        return F.when(state["buf"] == "", state["parts"]).otherwise(F.array_append(state["parts"], state["buf"]))

    def step(state: Column, s: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda i: F.substr(s, (i * limit + 1).cast("int"), F.lit(limit)))
        full = (state["buf"] != "") & (F.length(state["buf"]) + F.length(s) + 1 > limit)
        long_ = F.length(s) > limit
        parts = F.when(long_, F.concat(closed(state), cuts)).when(full, closed(state)).otherwise(state["parts"])
        buf = F.when(long_, F.lit("")).when(full | (state["buf"] == ""), s).otherwise(F.regexp_replace(F.concat_ws(" ", state["buf"], s), r"(?U)^\s+|\s+$", ""))
        return F.struct(parts.alias("parts"), buf.alias("buf"))

    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.aggregate(whole, start, step, closed))


def split_oversized(chunked: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Elements (doc_id, chunk_id, page_no, pos, type, content) packed in order into sub-chunks of at most max_chars.

    A table is never cut; a chunk within the limit keeps its id, others get _p1, _p2, ...
    Gives doc_id, chunk_id, n_elements, n_chars, page_lo, page_hi.
    """
    e = chunked.withColumn("__n", F.length(F.coalesce("content", F.lit(""))))
    total = F.sum("__n").over(Window.partitionBy("doc_id", "chunk_id"))
    e = e.withColumn("__over", total > max_chars)
    cut = F.when(F.col("__over") & (F.col("__n") > max_chars) & ~F.col("type").eqNullSafe("table"), split_text(F.col("content"), max_chars)).otherwise(F.array(F.coalesce("content", F.lit(""))))
    e = e.select("doc_id", "chunk_id", "page_no", "pos", "__over", F.posexplode(cut).alias("__k", "__piece"))
    items = e.groupBy("doc_id", "chunk_id").agg(F.max("__over").alias("over"), F.sort_array(F.collect_list(F.struct("page_no", "pos", F.col("__k").alias("k"), F.length("__piece").alias("n")))).alias("items"))
    start = F.struct(F.expr("cast(array() as array<struct<n_elements:int,n_chars:int,page_lo:int,page_hi:int>>)").alias("done"), F.expr("cast(null as struct<n_elements:int,n_chars:int,page_lo:int,page_hi:int>)").alias("cur"))

    def step(state: Column, x: Column) -> Column:
        cur = state["cur"]
        full = cur.isNotNull() & (cur["n_chars"] + x["n"] > max_chars)
        fresh = cur.isNull() | full
        page = x["page_no"].cast("int")
        new = F.struct(
            F.when(fresh, F.lit(1)).otherwise(cur["n_elements"] + 1).alias("n_elements"),
            F.when(fresh, x["n"]).otherwise(cur["n_chars"] + x["n"]).alias("n_chars"),
            F.when(fresh, page).otherwise(F.least(cur["page_lo"], page)).alias("page_lo"),
            F.when(fresh, page).otherwise(F.greatest(cur["page_hi"], page)).alias("page_hi"),
        )
        return F.struct(F.when(full, F.array_append(state["done"], cur)).otherwise(state["done"]).alias("done"), new.alias("cur"))

    packed = F.when(F.col("over"), F.aggregate("items", start, step, lambda s: F.array_append(s["done"], s["cur"]))).otherwise(
        F.array(
            F.struct(
                F.size("items").alias("n_elements"),
                F.aggregate("items", F.lit(0), lambda a, x: a + x["n"]).alias("n_chars"),
                F.array_min(F.transform("items", lambda x: x["page_no"].cast("int"))).alias("page_lo"),
                F.array_max(F.transform("items", lambda x: x["page_no"].cast("int"))).alias("page_hi"),
            )
        )
    )
    found = items.select("doc_id", "chunk_id", "over", F.posexplode(packed).alias("k", "c"))
    name = F.when(F.col("over"), F.concat("chunk_id", F.lit("_p"), (F.col("k") + 1).cast("string"))).otherwise(F.col("chunk_id"))
    return found.select("doc_id", name.alias("chunk_id"), "c.n_elements", "c.n_chars", "c.page_lo", "c.page_hi")

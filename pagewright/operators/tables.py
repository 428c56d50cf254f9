"""Table operators over elements and side tables of trusted native tables."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import grid
from pagewright.operators import native
from pagewright.operators.folds import fold

WHERE = ("doc_id", "page_no", "pos")
_FACTS = T.StructType([T.StructField("n_rows", T.IntegerType()), T.StructField("n_cols", T.IntegerType()), T.StructField("confidence", T.DoubleType()), T.StructField("issues", T.StringType())])
_PART = T.StructType([T.StructField("content", T.StringType()), T.StructField("caption", T.StringType())])
_REPAIRED = T.StructType([T.StructField("parts", T.ArrayType(_PART)), T.StructField("again", T.BooleanType()), T.StructField("issues", T.ArrayType(T.StringType()))])


@F.pandas_udf(_FACTS)
def assessed(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(r, c, p, ",".join(i)) for r, c, p, i in map(grid.assess, html)], columns=["n_rows", "n_cols", "confidence", "issues"])


@F.arrow_udf(_REPAIRED)
def repaired(html: pa.Array, caption: pa.Array) -> pa.Array:
    """grid.repair of each table; nothing where there is no HTML."""
    found = [grid.repair(h, c) if h is not None else None for h, c in zip(html.to_pylist(), caption.to_pylist())]
    contents, captions, ends = [], [], [0]
    for f in found:
        for content, title in f[0] if f else ((None, None),):
            contents.append(content)
            captions.append(title)
        ends.append(len(contents))
    parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(contents, pa.string()), pa.array(captions, pa.string())], ["content", "caption"]))
    again, issues = pa.array([bool(f and f[1]) for f in found], pa.bool_()), pa.array([f[2] if f else [] for f in found], pa.list_(pa.string()))
    return pa.StructArray.from_arrays([parts, again, issues], ["parts", "again", "issues"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def cell_keys(html: pd.Series) -> pd.Series:
    return html.map(grid.cell_keys)


@F.pandas_udf(T.StringType())
def topology(html: pd.Series) -> pd.Series:
    return html.map(grid.topology)


@F.pandas_udf(T.BooleanType())
def text_preserved(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([grid.text_preserved(a, b) for a, b in zip(before, after)], dtype=bool)


def facts(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, pos, n_rows, n_cols, confidence, issues) of each table."""
    t = elements.where("type = 'table'").select(*WHERE, assessed("content").alias("a"))
    return t.select(*WHERE, "a.n_rows", "a.n_cols", "a.confidence", "a.issues")


def repair(elements: DataFrame) -> DataFrame:
    """The elements with each table repaired; a split gives two rows, told apart by part."""
    table, fields = F.col("type").eqNullSafe("table"), ("content", "caption")
    e = elements.withColumn("__r", repaired(*[F.when(table, F.col(c)) for c in fields]))
    parts = F.when(table, F.col("__r.parts")).otherwise(F.array(F.struct(*fields)))
    issues = F.when(table, F.col("__r.issues")).otherwise(F.expr("cast(array() as array<string>)"))
    done = e.select(*[c for c in elements.columns if c not in fields], F.posexplode(parts).alias("part", "__p"), issues.alias("issues"))
    return done.select(*[F.col(f"__p.{c}").alias(c) if c in fields else F.col(c) for c in elements.columns], "part", "issues")


def repair_sides(elements: DataFrame) -> DataFrame:
    """The elements before and after repair in one set of rows, made once: side 0 before, 1 after, 2 both (unchanged); part tells
    the tables of a split apart."""
    same = F.array(F.struct(F.lit(2).alias("side"), F.col("content"), F.col("caption")))
    old = F.array(F.struct(F.lit(0).alias("side"), F.col("content"), F.col("caption")))
    table = F.col("type").eqNullSafe("table")
    e = elements.withColumn("__p", repaired(F.when(table, F.col("content")), F.when(table, F.col("caption")))["parts"])
    left = ~table | F.col("content").isNull() | ((F.size("__p") == 1) & F.col("__p")[0]["content"].eqNullSafe(F.col("content")) & F.col("__p")[0]["caption"].eqNullSafe(F.col("caption")))
    new = F.transform("__p", lambda x: F.struct(F.lit(1).alias("side"), x["content"].alias("content"), x["caption"].alias("caption")))
    e = e.select(*[c for c in elements.columns if c not in ("content", "caption")], F.posexplode(F.when(left, same).otherwise(F.concat(old, new))).alias("part", "__s"))
    return e.select(*[F.col(f"__s.{c}").alias(c) if c in ("content", "caption") else F.col(c) for c in elements.columns], "part", "__s.side")


def _best_native(least: float) -> Callable[[list[tuple]], Iterator[tuple]]:
    def each(rows: list[tuple]) -> Iterator[tuple]:
        doc, mine, holders = rows[0][0], [], defaultdict(list)
        if doc is None:
            return
        for _, page, pos, idx, wanted, offered, html in rows:
            keys = grid.cell_keys(html)
            if wanted and len(keys) >= 4:
                mine.append((page, pos, keys))
            if offered and len(keys) >= 2:
                for key in keys:
                    holders[key].append(idx)
        for page, pos, keys in mine:
            met: Counter = Counter()
            for key in keys:
                if key in holders:
                    met.update(holders[key])
            most = max(met.values(), default=0)
            if most and most / len(keys) >= least:
                yield doc, page, pos, min(i for i, n in met.items() if n == most), most / len(keys)

    return each


def matched_natives(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """native_match of (doc_id, page_no, pos, idx, wanted, offered, html): tables that are matched (wanted), natives (offered) or both."""
    schema = T.StructType([*[rows.schema[c] for c in (*WHERE, "idx")], T.StructField("score", T.DoubleType())])
    return fold(rows.select(*WHERE, "idx", "wanted", "offered", "html"), ["doc_id"], [], schema, _best_native(least))


def native_match(elements: DataFrame, natives: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, page_no, pos, idx, score): for each table of four or more distinct cells the native table (doc_id, idx, html)
    that holds the largest share of them, the first of several; only from ``least`` up.

    A document's tables meet in one task by way of their cells, so no pair of tables without a common cell is made.
    """
    none = lambda df, *names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    mine = elements.where("type = 'table'").select(*WHERE, *none(natives, "idx"), F.lit(True).alias("wanted"), F.lit(False).alias("offered"), F.col("content").alias("html"))
    theirs = natives.select("doc_id", *none(elements, "page_no", "pos"), "idx", F.lit(False).alias("wanted"), F.lit(True).alias("offered"), "html")
    return matched_natives(mine.unionByName(theirs), least)


@F.pandas_udf(T.StringType())
def _resolved(mine: pd.Series, best: pd.Series, others: pd.Series, text: pd.Series, paged: pd.Series) -> pd.Series:
    """The native HTML for a table, cut to what it and its page show; None to keep the table."""

    def one(html: str, best: str | None, others: list | None, text: str | None, paged: bool) -> str | None:
        table = grid.first_table(html)
        if table is None or next(table.walk("table"), None) is not None:
            return None
        cells = len(grid.cell_keys(html))
        if cells < 4:
            return None
        sliced = best is not None and len(grid.cell_keys(best)) > 1.5 * cells
        found = grid.ordered_match(html, list(others) if others is not None else []) if best is None else native.slice_to_fragment(best, html) if sliced else best
        if not found or not paged:
            return found
        cut = native.slice_to_source(found, text or "")
        return cut if not (sliced or cut != found) or native.grounded(cut, text or "") else None

    return pd.Series([one(*x) for x in zip(mine, best, others, text, paged)], dtype=object)


@F.pandas_udf(T.IntegerType())
def _ordered_length(html: pd.Series) -> pd.Series:
    return html.map(lambda x: len(grid.ordered_text(x))).astype("int32")


def substitute_natives(elements: DataFrame, natives: DataFrame, least: float = 0.6, texts: DataFrame | None = None) -> DataFrame:
    """The elements, tables that have a native match taking its HTML; flagged by native.

    A native table of more than 1.5 times the table's cells is cut to the rows that the table shows; without a match of
    ``least`` the one whose text is nearly the same is taken. With ``texts`` (doc_id, page_no, text) a native table is
    further cut to its page's text, which must bear out what was cut. A table that holds tables, or whose cut fails, stays.
    """
    tables = elements.where("type = 'table'").select(*WHERE, F.col("content").alias("mine"))
    best = native_match(elements, natives, least).join(natives.select("doc_id", "idx", F.col("html").alias("best")), ["doc_id", "idx"]).select(*WHERE, "best")
    # Pairs for the ordered match: only of one document and of nearly equal length.
    lone = tables.join(best, list(WHERE), "left_anti").select(*WHERE, _ordered_length("mine").alias("a")).where("a >= 80")
    theirs = natives.where(F.size(cell_keys("html")) >= 2).select("doc_id", "idx", "html", _ordered_length("html").alias("b"))
    near = lone.join(theirs, "doc_id").where(F.least("a", "b") >= 0.9 * F.greatest("a", "b"))
    others = near.groupBy(*WHERE).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "html"))), lambda x: x["html"]).alias("others"))
    found = tables.join(best, list(WHERE), "left").join(others, list(WHERE), "left")
    found = found.join(texts.groupBy("doc_id", "page_no").agg(F.max("text").alias("text")), ["doc_id", "page_no"], "left") if texts is not None else found.withColumn("text", F.lit(None).cast("string"))
    found = found.select(*WHERE, _resolved("mine", "best", "others", "text", F.lit(texts is not None)).alias("html")).where("html IS NOT NULL")
    out = elements.join(found, list(WHERE), "left")
    return out.withColumn("content", F.coalesce("html", "content")).withColumn("native", F.col("html").isNotNull()).select(*elements.columns, "native")


def problems(elements: DataFrame, least: float = 0.75) -> DataFrame:
    """Facts of the tables that a repair pass should look at: hard issues or low confidence."""
    f = facts(elements)
    return f.where((F.col("confidence") < least) | f.issues.rlike("ragged_rows|nested_table|bleed|duplicate"))

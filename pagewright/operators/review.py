"""Checks on pages and candidates: hard signals, structure facts, contexts of repeats, the gate for a better page, listings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import grid
from pagewright.operators.elements import squash
from pagewright.operators.folds import fold

PAGE = ("doc_id", "page_no")
HARD_ISSUES = ("no_table", "empty_table", "ragged_rows", "nested_table", "quality_check_error")
NOTICE = "eml_notice"
LOW = 0.75
BROKEN = ("ragged_rows", "nested_table", "empty_table", "no_table")


def hard_signals(elements: DataFrame, low_pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, failure): what no reviewer can overturn, each once; elements have source, confidence and issues.

    An element below 0.75 (unless it is a notice) and each hard issue (up to a colon) is named with its place among the
    page's elements; a page of low_pages (doc_id, page_no) fails as a whole unless it has nothing but notices.
    """
    e = elements.withColumn("at", F.row_number().over(Window.partitionBy(*PAGE).orderBy("pos")) - 1)
    name = lambda what: F.concat(F.lit("element_"), F.col("at").cast("string"), F.lit("_"), what)
    low = e.where((F.col("confidence") < LOW) & ~F.col("source").eqNullSafe(NOTICE)).select(*PAGE, name(F.lit("low_confidence")).alias("failure"))
    issue = e.select(*PAGE, "at", F.explode("issues").alias("issue")).withColumn("issue", F.split_part("issue", F.lit(":"), F.lit(1))).where(F.col("issue").isin(*HARD_ISSUES))
    found = low.unionByName(issue.select(*PAGE, name(F.col("issue")).alias("failure"))).distinct()
    if low_pages is None:
        return found
    pages = low_pages.select(*PAGE).distinct().join(notice_pages(elements), list(PAGE), "left").where(~F.coalesce("notice_only", F.lit(False)))
    return found.unionByName(pages.select(*PAGE, F.lit("page_low_confidence").alias("failure")))


def notice_pages(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, notice_only): whether all of a page's elements are notices with text."""
    notice = F.col("source").eqNullSafe(NOTICE) & (F.trim(F.coalesce("content", F.lit(""))) != "")
    return elements.groupBy(*PAGE).agg(F.bool_and(notice).alias("notice_only"))


_STRUCTURE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("n_rows", "header_rows", "n_columns", "table_tags", "caption_rows")])


def _plain(text: str | None) -> str:
    return " ".join((text or "").split()).casefold()


def _structure(html: str | None, caption: str | None) -> tuple | None:
    plain = grid.plain_rows(html)
    tree = grid.parse(html) if plain is None else None
    table = next(tree.walk("table"), None) if tree else None
    if table is None and plain is None:
        return None
    rows = grid.rows_of(table) if plain is None else plain
    cells = [grid.cells_of(r) for r in rows] if plain is None else plain
    said, built, led = _plain(caption), "", 0
    for row in cells[:3] if said else []:
        text = _plain(" ".join(c.text() if plain is None else c for c in row))
        if not text or not said.startswith(built + text) or built == said:
            break
        built, led = built + text, led + 1
    if plain is not None:
        return len(rows), 0, max(map(len, cells), default=0), 1, led
    return len(rows), sum(any(c.tag == "th" for c in row) for row in cells), max((sum(grid.span(c, "colspan") for c in row) for row in cells), default=0), sum(1 for _ in tree.walk("table")), led


@F.pandas_udf(_STRUCTURE)
def _structures(html: pd.Series, caption: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_structure(*x) or (None,) * 5 for x in zip(html, caption)], columns=_STRUCTURE.names).astype("Int32")


def structure_facts(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, pos, n_rows, header_rows, n_columns, table_tags, caption_rows) of each element that has a table;
    caption_rows counts leading rows whose text the caption begins with."""
    t = elements.where("type = 'table'").select(*PAGE, "pos", _structures("content", "caption").alias("s"))
    return t.select(*PAGE, "pos", "s.*").where("n_rows IS NOT NULL")


def distinct_contexts(elements: DataFrame, kind: str = "table", reach: int = 4) -> DataFrame:
    """(doc_id, page_no, key, n, distinct): for content that elements of a kind repeat on a page, whether each repeat has its own heading.

    A repeat's heading is the last before it, after the repeat before; for the first one within ``reach`` elements.
    """
    page = Window.partitionBy(*PAGE).orderBy("pos")
    key = F.lower(squash(F.regexp_replace(F.concat_ws(" ", "content", "caption"), "<[^>]+>", " ")))
    head = F.col("type").startswith("heading_")
    e = elements.select(*PAGE, "pos", "type", key.alias("key"), (F.row_number().over(page) - 1).alias("i"))
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumns({"head_at": F.max(F.when(head, F.col("i"))).over(before), "context": F.last(F.when(head, F.col("key")), ignorenulls=True).over(before)})
    same = Window.partitionBy(*PAGE, "key").orderBy("i")
    t = e.where(F.col("type") == kind).withColumn("from", F.coalesce(F.lag("i").over(same) + 1, F.greatest(F.col("i") - reach, F.lit(0))))
    own = F.when((F.col("head_at") >= F.col("from")) & (F.col("context") != ""), F.col("context"))
    return t.groupBy(*PAGE, "key").agg(F.count("*").alias("n"), (F.count_distinct(own) == F.count("*")).alias("distinct")).where("n > 1")


def page_listing(elements: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, page_no, n_elements, n_tables, n_low, findings): pages with what was found (doc_id, page_no, issue), sorted, once each."""
    pages = elements.groupBy(*PAGE).agg(F.count("*").alias("n_elements"), F.count_if(F.col("type") == "table").alias("n_tables"), F.count_if(F.col("confidence") < LOW).alias("n_low"))
    found = findings.groupBy(*PAGE).agg(F.array_join(F.array_sort(F.collect_set("issue")), ",").alias("findings"))
    return pages.join(found, list(PAGE), "left").withColumn("findings", F.coalesce("findings", F.lit("")))


def manifest(results: DataFrame) -> DataFrame:
    """(status, n, pages, seconds) of a run's documents (status, pages, seconds)."""
    return results.groupBy("status").agg(F.count("*").alias("n"), F.sum("pages").alias("pages"), F.round(F.sum("seconds"), 3).alias("seconds"))


def _chunks(rows: list[tuple]) -> list[str]:
    said = [grid.bare(grid.said(c) if k == "table" else c).casefold() for k, c, _ in rows]
    return [s for s in said if s]


def better(original: list[tuple], candidate: list[tuple], least: float = 0.75, order: float = 0.8, sequence: float = 0.98) -> dict:
    """Whether a candidate page (rows of type, content, caption in order) improves on the original without losing from it, and by what."""
    from pagewright.operators import layout

    facts = {}
    for name, rows in (("old", original), ("new", candidate)):
        tables = [(content, caption) for kind, content, caption in rows if kind == "table"]
        issues = [set(grid.assess(c)[3]) for c, _ in tables]
        bad = [bool(i & set(BROKEN)) for i in issues]
        kinds = [kind for kind, _, _ in rows]
        orphans = sum(a in ("heading_1", "heading_2", "heading_3") and a == b for a, b in zip(kinds, kinds[1:]))
        nested = [grid.topology(c) for (c, _), i in zip(tables, issues) if "nested_table" in i]
        facts[name] = (tables, bad, orphans, _chunks(rows), nested)
    (old_tables, old_bad, old_orphans, old_chunks, old_nested), (new_tables, new_bad, new_orphans, new_chunks, _) = facts["old"], facts["new"]
    there, old_text, new_text = set(new_chunks), "".join(old_chunks), "".join(new_chunks)
    coverage = sum(c in there for c in old_chunks) / max(1, len(old_chunks))
    chars = len(new_text) / max(1, len(old_text))
    similar = grid.likeness(old_text, new_text)
    options = []
    for (content, caption), bad in zip(old_tables, old_bad):
        if bad:
            found = [layout.metrics(content, c, caption, k) for c, k in new_tables]
            options.append({i for i, m in enumerate(found) if m[0] and m[4] >= sequence})
    changed = not old_nested or not set(old_nested) & {grid.topology(c) for c, _ in new_tables}
    out = {"old_problems": sum(old_bad), "new_problems": sum(new_bad), "coverage": round(coverage, 4), "char_ratio": round(chars, 4), "order_similarity": round(similar, 4), "sequence_kept": grid.assign([sorted(o) for o in options]) is not None}
    fewer = 0 < out["old_problems"] > out["new_problems"] and len(new_tables) >= len(old_tables) and (old_orphans == 0 or new_orphans < old_orphans)
    out["accepted"] = bool(fewer and coverage >= least and chars >= least and similar >= order and out["sequence_kept"] and changed)
    return out


_GATE = "old_problems int, new_problems int, coverage double, char_ratio double, order_similarity double, sequence_kept boolean, accepted boolean"


def _judged(rows: list[tuple]) -> Iterator[tuple]:
    old, new = ([(kind, content or "", caption or "") for *_, side, kind, content, caption in rows if side != other] for other in (1, 0))
    if old and new:
        yield (*rows[0][:2], *better(old, new).values())


def judged_sides(sides: DataFrame) -> DataFrame:
    """improvements of rows (doc_id, page_no, pos, part, side, type, content, caption) of both pages: side 0 of the original, 1 of the
    candidate, 2 of both."""
    gate = [T.StructField(n, {"int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[k]) for n, k in (c.split() for c in _GATE.split(", "))]
    rows = sides.select(*PAGE, "pos", "part", "side", "type", "content", "caption")
    return fold(rows, list(PAGE), ["pos", "part"], T.StructType([*[sides.schema[c] for c in PAGE], *gate]), _judged)


def improvements(original: DataFrame, candidate: DataFrame) -> DataFrame:
    """(doc_id, page_no, old_problems, new_problems, coverage, char_ratio, order_similarity, sequence_kept, accepted) of each page of both."""
    side = lambda df, n: df.select(*PAGE, "pos", F.lit(0).alias("part"), F.lit(n).alias("side"), "type", "content", "caption")
    return judged_sides(side(original, 0).unionByName(side(candidate, 1)))


def layout_score(runs: DataFrame, counts: DataFrame, ink: DataFrame) -> DataFrame:
    """(doc_id, page_no, score): pages worth a layout review, from the longest text run, the number of elements and the image's shares of ink and colour."""
    page = list(PAGE)
    joined = runs.join(counts, page).join(ink, page)
    worth = (F.col("longest") >= 4) & (F.col("n_elements") >= 5) & ((F.col("ink") >= 0.27) | (F.col("colour") >= 0.10))
    return joined.where(worth).select(*PAGE, (F.col("ink") + F.col("colour")).alias("score"))

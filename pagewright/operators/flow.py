"""Reading order and figures: two columns into one, figures to their anchors, text fallbacks for pages, the page pipeline."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators import elements as el
from pagewright.operators import evidence, tables
from pagewright.operators.elements import PAGE, squash
from pagewright.operators.headings import is_heading

ROMAN = r"(?i)^([IVXLCDM]+|[Ⅰ-Ⅹ]+)[.)]\s+"
FALLBACK = ("text_layer_fallback", 0.45)


def roman_subheadings(elements: DataFrame) -> DataFrame:
    """After a heading with a roman numeral on a page, other headings of level 1 become level 2."""
    text, head = F.trim(F.coalesce("content", F.lit(""))), is_heading(F.col("type"))
    w = Window.partitionBy(*PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    roman = head & text.rlike(ROMAN)
    inside = F.max(roman.cast("int")).over(w) == 1
    return elements.withColumn("type", F.when(inside & ~roman & (F.col("type") == "heading_1"), F.lit("heading_2")).otherwise(F.col("type"))).select(*elements.columns)


def merge_columns(elements: DataFrame) -> DataFrame:
    """Elements with a column number (0 left, 1 right) in one order: the left ones, then the right.

    If the left column ends within a sentence and exactly one text of the right one, below a heading,
    begins in lower case, that text goes before the left column's footnotes. pos is given anew.
    """
    by_column = Window.partitionBy(*PAGE, "column").orderBy("pos")
    text = F.coalesce("content", F.lit(""))
    e = elements.withColumn("__n", F.row_number().over(by_column))
    e = e.withColumn("__body", F.coalesce(F.max(F.when(~F.col("type").eqNullSafe("footnote"), F.col("__n"))).over(Window.partitionBy(*PAGE, "column")), F.lit(0)))
    ending = F.regexp_replace(text, r"(?U)[\s\"'”’)\]}]+$", "")
    unfinished = (F.col("column") == 0) & (F.col("__n") == F.col("__body")) & (F.col("type") == "text") & (ending != "") & ~ending.rlike("[.!?。！？:]$")
    below = F.coalesce(F.max(is_heading(F.col("type")).cast("int")).over(by_column.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    start = F.regexp_replace(text, r"^[\s\"'“‘(\[{]+", "")
    may = (F.col("column") == 1) & below & (F.col("type") == "text") & start.rlike("^[a-z]") & (F.length(start) <= 500)
    whole = Window.partitionBy(*PAGE)
    e = e.withColumns({"__may": may, "__open": F.max(unfinished.cast("int")).over(whole) == 1, "__count": F.sum(may.cast("int")).over(whole)})
    moved = F.col("__may") & F.col("__open") & (F.col("__count") == 1)
    part = F.when(moved, 1).when(F.col("column") == 1, 3).when(F.col("__n") <= F.col("__body"), 0).otherwise(2)
    pos = F.row_number().over(Window.partitionBy(*PAGE).orderBy(part, "__n")) - 1
    merged = e.withColumn("pos", pos.cast(elements.schema["pos"].dataType)).select(*elements.columns)
    return roman_subheadings(merged)


def drop_clipped_headers(elements: DataFrame, sources: DataFrame) -> DataFrame:
    """Without headings among the first three of a right column that begin in lower case and end exactly one of the text
    layer's first sixteen lines, being at most three fifths of it."""
    line = F.explode(F.slice(F.filter(F.split("source_text", "\n"), lambda x: F.trim(x) != ""), 1, 16)).alias("line")
    lines = sources.select(*PAGE, line).select(*PAGE, F.regexp_replace(F.lower("line"), r"[^\p{L}\p{N}]", "").alias("full"))
    nth = F.row_number().over(Window.partitionBy(*PAGE, "column").orderBy("pos"))
    short = F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]", "")
    heads = elements.withColumn("__n", nth).where((F.col("column") > 0) & (F.col("__n") <= 3) & is_heading(F.col("type"))).select(*PAGE, "column", "pos", short.alias("part"), "content")
    heads = heads.where(F.length("part").between(4, 32) & F.regexp_extract("content", r"(\p{L})", 1).rlike(r"^\p{Ll}"))
    fits = (F.length("full") >= F.length("part") + 5) & F.endswith(F.col("full"), F.col("part")) & (F.length("part") * 5 <= F.length("full") * 3)
    gone = heads.join(lines, list(PAGE)).where(fits).groupBy(*PAGE, "column", "pos").agg(F.count("*").alias("n")).where("n = 1")
    return elements.join(gone, [*PAGE, "column", "pos"], "left_anti").select(*elements.columns)


def _letters(text: str | None) -> str:
    return re.sub(r"[^0-9a-z가-힣]", "", (text or "").lower())


def place_figures(elements: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each figure goes before the text that follows its anchor (doc_id, page_no, idx, prev, next); anchors are used once, in
    order, by the figure whose caption or content agrees with prev. Figures without one stay. pos is given anew."""

    def run(page: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("pos").reset_index(drop=True)
        free = list(known.sort_values("idx").itertuples())
        figure = [t == "figure" for t in page["type"]]
        if not any(figure) or not free:
            return page
        base = [i for i in range(len(page)) if not figure[i]]
        said = [_letters((page["content"][i] or "") + (page["caption"][i] or "")) for i in base]
        at: list[tuple[int, int]] = []
        for i in (i for i in range(len(page)) if figure[i]):
            key = next((v for v in (_letters(page["caption"][i]), _letters(page["content"][i])) if len(v) >= 4), "")
            target = sum(b < i for b in base)
            for a in free:
                prev = _letters(a.prev)
                if key and prev and (key in prev or prev in key):
                    after = _letters(a.next)[:16]
                    target = next((k for k, s in enumerate(said) if after and after in s), target)
                    free.remove(a)
                    break
            at.append((target, i))
        order = [i for k in range(len(base) + 1) for i in [f for t, f in at if t == k] + base[k : k + 1]]
        places = sorted(page["pos"])
        page = page.iloc[order]
        page["pos"] = places
        return page

    return elements.groupBy(*PAGE).cogroup(anchors.groupBy(*PAGE)).applyInPandas(run, elements.schema)


def figure_pages(figures: DataFrame, texts: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, figure_id, page_no, matched): the first page whose text has a figure's anchor (40 letters of it), else the last."""
    norm = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", "")
    pages = texts.select("doc_id", "page_no", norm("source_text").alias("t"))
    wanted = figures.select("doc_id", "figure_id", F.left(norm("anchor"), F.lit(40)).alias("a"))
    met = wanted.where(F.length("a") >= least).join(pages, "doc_id").where(F.contains("t", "a")).groupBy("doc_id", "figure_id").agg(F.min("page_no").alias("hit"))
    last = pages.groupBy("doc_id").agg(F.max("page_no").alias("last"))
    return wanted.join(last, "doc_id").join(met, ["doc_id", "figure_id"], "left").select("doc_id", "figure_id", F.coalesce("hit", "last").alias("page_no"), F.col("hit").isNotNull().alias("matched"))


def significant_figures(figures: DataFrame, least_inches: float = 0.25, most_aspect: float = 18.0) -> DataFrame:
    """Without tiny ones and lines, as far as the size is known, and equal images of a document but the first (by ord)."""
    a, b = F.least("w_in", "h_in"), F.greatest("w_in", "h_in")
    known = (F.col("w_in") > 0) & (F.col("h_in") > 0)
    kept = figures.where(~F.coalesce(known, F.lit(False)) | ((a >= least_inches) & (b <= a * most_aspect)))
    nth = F.row_number().over(Window.partitionBy("doc_id", F.md5("data")).orderBy("ord"))
    return kept.withColumn("__n", nth).where("__n = 1").select(*figures.columns)


def _single(line: Column) -> Column:
    """A line that repeats a unit of up to 40 characters, once."""
    return F.regexp_replace(line, r"^(\s*)(\S(?:.{0,38}?\S)??)\2+(\s*)$", "$1$2$3")


def fallback_pages(texts: DataFrame) -> DataFrame:
    """Elements (doc_id, page_no, pos, type, content, caption, source, confidence) of pages that have only a text layer: repeated
    units and equal lines in a row once, a text for each paragraph."""
    lines = texts.select(*PAGE, F.posexplode(F.split("source_text", r"\r?\n")).alias("k", "line")).withColumn("line", _single(F.col("line")))
    key = F.regexp_replace("line", r"(?U)\s+", "")
    before = F.lag(key).over(Window.partitionBy(*PAGE).orderBy("k"))
    kept = lines.withColumn("__same", (key != "") & key.eqNullSafe(before)).where("NOT __same")
    whole = kept.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("t"))
    parts = F.filter(F.transform(F.split("t", r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return whole.select(*PAGE, F.posexplode(parts).alias("pos", "content")).select(*PAGE, "pos", F.lit("text").alias("type"), "content", F.lit("").alias("caption"), F.lit(FALLBACK[0]).alias("source"), F.lit(FALLBACK[1]).alias("confidence"))


def sanity_of_contents(elements: DataFrame, sources: DataFrame) -> DataFrame:
    """Contents entries whose title and page no line of the text layer shows, and that look like a group label, become headings."""
    lines = sources.select(*PAGE, F.explode(F.split("source_text", "\n")).alias("line"))
    shown = lines.select(*PAGE, F.regexp_replace(F.lower("line"), r"[^\p{L}\p{N}]", "").alias("__key")).distinct()
    key = F.when(F.col("type").eqNullSafe("toc_entry"), F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}]", ""))
    out = elements.withColumn("__key", key).join(shown.withColumn("__ok", F.lit(True)), [*PAGE, "__key"], "left")
    title = F.trim(F.regexp_extract("content", r"^(.*)::[^:]*$", 1))
    group = F.col("type").eqNullSafe("toc_entry") & F.col("__ok").isNull() & title.rlike(ROMAN)
    return out.withColumn("content", F.when(group, title).otherwise(F.col("content"))).withColumn("type", F.when(group, F.lit("heading_2")).otherwise(F.col("type"))).select(*elements.columns)


DEFAULT_CONFIDENCE = {"figure": 0.82, "table": 0.85}


def clean_pages(elements: DataFrame, sources: DataFrame, mask: Callable[[Column], Column] | None = None) -> DataFrame:
    """The page pipeline, in the order its steps depend on: evidence-based de-duplication, exact and contained texts, trailing
    headings, contents, counters, captions, table repair, prose near tables, provenance, and last the mask if one is given."""
    e = evidence.all_by_source(elements, sources)
    e = sanity_of_contents(el.drop_trailing_headings(e), sources)
    e = el.attach_unit_captions(el.backfill_captions(el.drop_page_artifacts(e)))
    e = tables.repair(e)
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("pos", "part")) - 1
    e = e.withColumn("pos", order.cast(elements.schema["pos"].dataType)).drop("part")
    e = el.dedupe_exact(evidence.per_page(e, evidence.near_tables))
    sure = F.lit(0.88)
    for kind, value in DEFAULT_CONFIDENCE.items():
        sure = F.when(F.col("type") == kind, F.lit(value)).otherwise(sure)
    e = el.mark(e, F.lit("model"), sure, F.expr("cast(array() as array<string>)"))
    return e.withColumn("content", mask(F.col("content"))) if mask else e


def title_like(text: Column) -> Column:
    """Short, no list mark before it and no sentence end behind."""
    s = squash(text)
    return (s != "") & (F.length(s) <= 30) & ~s.rlike("^[-□◦○●*–·•①-⑳]") & ~s.rlike("(\\.|[다음함임됨])$")

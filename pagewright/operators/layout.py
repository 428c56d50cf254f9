"""Gates for proposed pages: text may move but not change, and broken tables are replaced only by strong matches."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import grid
from pagewright.operators.evidence import bare
from pagewright.operators.folds import fold

KEY = ("doc_id", "page_no")
BULLETS = "•◦▪■□※"


def _items(content: Column) -> Column:
    """Characters, words and lines of a text, told apart by their first letter."""
    low = F.lower(content)
    lines = F.transform(F.split(low, f"[\\r\\n]+|(?=[{BULLETS}])"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, f"^[{BULLETS}]\\s*", ""), r"(?U)\s+", " ")))
    return F.concat(
        F.transform(F.split(F.regexp_replace(low, r"(?U)\s", ""), ""), lambda x: F.concat(F.lit("c"), x)),
        F.transform(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda x: F.concat(F.lit("w"), x)),
        F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.concat(F.lit("l"), x)),
    )


def reassigned_sides(sides: DataFrame) -> DataFrame:
    """reassigned_only of rows (doc_id, page_no, side, pos, type, content, caption), side 1 of the original and -1 of the candidate."""
    text = F.col("type") == "text"
    content = F.coalesce("content", F.lit(""))
    place = F.struct("pos", "type", F.when(~text, content).alias("fixed"), F.coalesce("caption", F.lit("")).alias("caption"))
    of = lambda side, what: F.sort_array(F.collect_list(F.when(side, what)))
    old, new = F.col("side") == 1, F.col("side") == -1
    pages = sides.groupBy(*KEY).agg(
        of(old, place).alias("frame"),
        of(new, place).alias("new_frame"),
        of(old & text, content).alias("texts"),
        of(new & text, content).alias("new_texts"),
        (F.size(F.collect_set(F.when(text, F.struct(place.alias("p"), content.alias("c"))))) > F.size(F.collect_set(F.when(text, place)))).alias("changed"),
    )
    # Texts are taken apart only where they are not the same ones.
    apart = lambda c: F.sort_array(F.flatten(F.transform(c, _items)))
    kept = F.when(F.col("texts") == F.col("new_texts"), F.lit(True)).otherwise(apart("texts") == apart("new_texts"))
    return pages.select(*KEY, ((F.col("frame") == F.col("new_frame")) & F.col("changed") & kept).alias("ok"))


def reassigned_only(original: DataFrame, candidate: DataFrame) -> DataFrame:
    """(doc_id, page_no, ok): whether the candidate page has the same elements in the same places, with only prose moved among texts.

    Characters, words and lines of the texts are compared as multisets, all in one aggregation per page.
    """
    side = lambda df, n: df.select(*KEY, F.lit(n).alias("side"), "pos", "type", "content", "caption")
    return reassigned_sides(side(original, 1).unionByName(side(candidate, -1)))


def overlap(a: str, b: str) -> int:
    return sum((Counter(a) & Counter(b)).values())


def metrics(old: str | None, new: str | None, old_caption: str | None = None, new_caption: str | None = None) -> tuple[bool, float, float, float, float]:
    """Eligible, score, recall and precision of characters, similarity of sequence of two tables."""
    a, b = (bare(grid.said(x)) for x in (old, new))
    chunks = [{c for c in map(bare, grid.cell_texts(x)) if len(c) >= 2} for x in (old, new)]
    shared = overlap(a, b)
    recall, precision = shared / max(1, len(a)), shared / max(1, len(b))
    both = len(chunks[0] & chunks[1])
    chunk_recall, chunk_precision = both / max(1, len(chunks[0])), both / max(1, len(chunks[1]))
    x, y = bare(old_caption), bare(new_caption)
    caption = SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    sequence = grid.likeness(a, b)
    total = sum(w * v for w, v in ((0.3, recall), (0.2, precision), (0.2, chunk_recall), (0.1, chunk_precision), (0.1, caption), (0.1, sequence)))
    _, _, sure, issues = grid.assess(new)
    fine = bool(a and b) and not {"ragged_rows", "nested_table", "no_table", "empty_table"} & set(issues) and sure >= 0.75
    return fine and recall >= 0.9 and precision >= 0.8 and (chunk_recall >= 0.5 or caption >= 0.75), round(total, 4), round(recall, 4), round(precision, 4), round(sequence, 4)


_METRICS = T.StructType([T.StructField("eligible", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in ("score", "recall", "precision", "sequence")]])


@F.pandas_udf(_METRICS)
def table_metrics(old: pd.Series, new: pd.Series, old_caption: pd.Series, new_caption: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([metrics(*x) for x in zip(old, new, old_caption, new_caption)], columns=_METRICS.names)


def _graft(least_sequence: float) -> Callable[[list[tuple]], Iterator[tuple]]:
    broken = {"ragged_rows", "nested_table", "empty_table"}

    def each(rows: list[tuple]) -> Iterator[tuple]:
        doc, page = rows[0][:2]
        old, new = [r for r in rows if r[3] != 1], [r for r in rows if r[3] != 0]
        pairs = []
        for *_, pos, _, content, caption in old:
            # Only a broken table takes a candidate.
            if broken & set(grid.assess(content)[3]):
                for *_, other, _, offered, title in new:
                    ok, score, _, _, sequence = metrics(content, offered, caption, title)
                    if ok and sequence >= least_sequence:
                        pairs.append((score, pos, other, offered))
        got, used = {}, set()
        for _, pos, other, offered in sorted(pairs, key=lambda p: p[:3], reverse=True):
            if pos not in got and other not in used:
                got[pos] = offered
                used.add(other)
        for *_, pos, _, content, _ in old:
            yield doc, page, pos, got.get(pos, content), pos in got

    return each


def grafted_tables(sides: DataFrame, least_sequence: float = 0.98) -> DataFrame:
    """(doc_id, page_no, pos, content, changed) of the tables of a page (side 0 or 2) after broken ones took their best strong match
    among the candidates (side 1 or 2)."""
    tables = sides.where("type = 'table'").select(*KEY, "pos", "side", "content", "caption")
    schema = T.StructType([*[sides.schema[c] for c in (*KEY, "pos")], T.StructField("content", T.StringType()), T.StructField("changed", T.BooleanType())])
    return fold(tables, list(KEY), ["side", "pos"], schema, _graft(least_sequence))


def graft(original: DataFrame, candidate: DataFrame, least_sequence: float = 0.98) -> DataFrame:
    """The original elements with broken tables replaced by their best strong match, each candidate used once, best scores first."""
    side = lambda df, n: df.select(*KEY, "pos", "type", F.lit(n).alias("side"), "content", "caption")
    chosen = grafted_tables(side(original, 0).unionByName(side(candidate, 1)), least_sequence).where("changed").select(*KEY, "pos", F.col("content").alias("__new"))
    return original.join(chosen, [*KEY, "pos"], "left").withColumn("content", F.coalesce("__new", "content")).select(*original.columns)


def _one_page(least: float) -> Callable[[list[tuple]], Iterator[tuple]]:
    def each(rows: list[tuple]) -> Iterator[tuple]:
        doc, sizes, wanted, pages = rows[0][0], Counter(), defaultdict(list), defaultdict(set)
        if doc is None:
            return
        for _, table, page, keys in rows:
            if table is not None:
                sizes[table] += len(keys)
                wanted[table].append(keys)
            if page is not None:
                for key in keys:
                    pages[key].add(page)
        for table, lists in wanted.items():
            met: Counter = Counter()
            for keys in lists:
                for key in keys:
                    if key in pages:
                        met.update(pages[key])
            most = max(met.values(), default=0)
            found = [page for page, n in met.items() if n == most]
            if len(found) == 1 and most / sizes[table] >= least:
                yield doc, table, found[0], most / sizes[table]

    return each


def page_of_tables(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """unique_page of rows (doc_id, table_id, page_no, keys): keys of a table, of a page or, where both are there, of both."""
    schema = T.StructType([*[rows.schema[c] for c in ("doc_id", "table_id", "page_no")], T.StructField("share", T.DoubleType())])
    return fold(rows.select("doc_id", "table_id", "page_no", "keys"), ["doc_id"], [], schema, _one_page(least))


def unique_page(wanted: DataFrame, pages: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, table_id, page_no, share) of the one page that holds most of a table's cells; none on a tie.

    wanted has (doc_id, table_id, key), pages (doc_id, page_no, key), a row for each distinct cell. A document's rows meet in
    one task, where only tables and pages with a common cell do.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    mine = wanted.where("key IS NOT NULL").select("doc_id", "table_id", none(pages, "page_no"), F.array("key").alias("keys"))
    return page_of_tables(mine.unionByName(pages.where("key IS NOT NULL").select("doc_id", none(wanted, "table_id"), "page_no", F.array("key").alias("keys"))), least)


def orphan_headings(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, n): headings followed at once by one of the same level."""
    after = F.expr("lead(type) over (partition by doc_id, page_no order by pos)")
    return elements.withColumn("after", after).groupBy(*KEY).agg(F.count_if(F.col("type").startswith("heading") & (F.col("type") == F.col("after"))).alias("n"))

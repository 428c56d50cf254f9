"""Filters and neighbour rules over ordered elements (doc_id, page_no, pos, type, content, caption)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_no")
PROSE = ("text", "footnote")
DASH, COUNT = "[–—-]", r"\s*\d{1,4}\s*"
TITLE_WORDS = "요약|위험|평가|산정|태도|내역|현황|등급|표"


def squash(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _page() -> Window:
    return Window.partitionBy(*PAGE).orderBy("pos")


def numbered(elements: DataFrame) -> DataFrame:
    """With __i, the place on the page from 0, and __n, the page's number of elements."""
    return elements.withColumns({"__i": F.row_number().over(_page()) - 1, "__n": F.count("*").over(Window.partitionBy(*PAGE))})


def is_counter(text: Column, page_no: Column, i: Column, n: Column, marked: Column) -> Column:
    """A printed page counter: always with dashes or a slash; a bare number only at a page's edge and near its page number, or next to a clear counter."""
    s = squash(text)
    edge = (i <= 1) | (i >= F.greatest(F.lit(0), n - 3))
    bare = s.rlike(r"^\d{1,3}$") & edge
    number = F.try_to_number(s, F.lit("999")).cast("int")
    near = F.abs(number - page_no) <= 3
    strong = s.rlike(f"^{DASH}?\\s*/{COUNT}{DASH}?$") | s.rlike(f"^{DASH}{COUNT}{DASH}?$")
    return F.coalesce((s != "") & (strong | (bare & (number <= 200) & (F.coalesce(near, F.lit(False)) | (marked & (i >= F.greatest(F.lit(0), n - 3)))))), F.lit(False))


def drop_page_artifacts(elements: DataFrame) -> DataFrame:
    """Without counters among texts and footnotes; a counter attached to an edge text that names this page is cut off."""
    prose = F.coalesce(F.col("type"), F.lit("text")).isin("text", "footnote")
    i, n = F.col("__i"), F.col("__n")
    e = numbered(elements).withColumn("__marked", prose & is_counter(F.col("content"), F.lit(None).cast("int"), i, n, F.lit(False)))
    e = e.withColumn("__any", F.bool_or("__marked").over(Window.partitionBy(*PAGE)))
    value = F.trim(F.coalesce("content", F.lit("")))
    attached = "(?s)^(.+?)\\s*" + DASH + r"\s*/?\s*(" + "(?:\\d\\s*){1,4}" + f"){DASH}\\s*$"
    body, digits = F.trim(F.regexp_extract(value, attached, 1)), F.regexp_replace(F.regexp_extract(value, attached, 2), r"\s", "")
    cut = (
        F.col("type").isin(*PROSE, *[f"heading_{i}" for i in (1, 2, 3)])
        & ((i <= 1) | (i >= F.greatest(F.lit(0), n - 3)))
        & (digits != "")
        & (F.try_to_number(digits, F.lit("9999")) == F.col("page_no"))
        & (F.length(F.regexp_replace(body, r"[^\p{L}\p{N}]", "")) >= 4)
    )
    e = e.withColumn("content", F.when(cut, body).otherwise(F.col("content")))
    return e.where(~(prose & is_counter(F.col("content"), F.col("page_no"), i, n, F.col("__any")))).select(*elements.columns)


def backfill_captions(elements: DataFrame) -> DataFrame:
    """A table without a caption takes the title-like element right before it; footnotes between do not matter."""
    kind, s = F.coalesce(F.col("type"), F.lit("")), squash("content")
    head = kind.startswith("heading")
    titled = (head | kind.startswith("text")) & (s != "") & (F.length(s) <= 90) & ~s.rlike(f"^{DASH}?\\s*/?{COUNT}{DASH}?$") & (head | s.rlike(TITLE_WORDS))
    # Everything but a footnote either is a title or ends the reach of the one before.
    said = F.when(~kind.eqNullSafe("footnote"), F.when(titled & (kind != "table"), s).otherwise(F.lit("")))
    last = F.last(said, ignorenulls=True).over(_page().rowsBetween(Window.unboundedPreceding, -1))
    lone = (kind == "table") & (F.trim(F.coalesce("caption", F.lit(""))) == "")
    return elements.withColumn("caption", F.when(lone & (F.coalesce(last, F.lit("")) != ""), last).otherwise(F.col("caption"))).select(*elements.columns)


def unit_marker(text: Column) -> Column:
    """The squashed text if it is nothing but a unit label, else empty."""
    s = squash(text)
    bracketed = (F.length(s) >= 3) & s.rlike(r"^(\(.*\)|\[.*\])$")
    body = F.when(bracketed, F.trim(F.substring(s, 2, 1 << 20).substr(F.lit(1), F.length(s) - 2))).otherwise(s)
    named = body.rlike("(?i)^(단위|units?)\\s*[:：]")
    money = body.rlike(r"(?i)\b(RMB|CNY|JPY|EUR|KRW|USD)\b") | body.rlike("[₩¥£€$]")
    words = ("(천|만|백만|억)?\\s*(엔|유로|달러|원)", "(billion|thousand|million)s?", "kg|g|t|tonnes?|%|percent", "m[³²23]?|㎥|㎡")
    whole = body.rlike("(?i)^(" + "|".join(words) + ")$")
    return F.when((s != "") & (F.length(s) <= 48) & (named | (bracketed & (money | whole))), s).otherwise(F.lit(""))


def attach_unit_captions(elements: DataFrame) -> DataFrame:
    """A unit label right after a table moves into its caption; the same label at the end of one of the up to four
    elements before the table is cut off, unless a table, figure or heading stands between."""
    w = _page()
    kind = F.coalesce(F.col("type"), F.lit("text"))
    e = elements.withColumn("__unit", F.when(kind.isin("text", "footnote"), unit_marker(F.col("content"))).otherwise(F.lit("")))
    e = e.withColumn("__after", F.when(F.col("type") == "table", F.coalesce(F.lead("__unit").over(w), F.lit(""))).otherwise(F.lit("")))
    e = e.withColumn("__moved", F.coalesce(F.lag("__after").over(w), F.lit("")) != "")
    # Of the elements before a table the nearest prose that ends with its label gives it up.
    stop = (kind == "table") | (kind == "figure") | kind.startswith("heading")
    e = e.withColumns({"__stop": stop, "__at": F.when(~F.col("__moved"), F.row_number().over(w))})
    left = e.where(~F.col("__moved")).withColumn("__k", F.row_number().over(w))
    tables = left.where(F.col("__after") != "").select(*PAGE, F.col("__k").alias("__t"), F.col("__after").alias("__label"))
    near = left.join(tables, list(PAGE)).where((F.col("__k") < F.col("__t")) & (F.col("__k") >= F.col("__t") - 4))
    between = Window.partitionBy(*PAGE, "__t").orderBy(F.desc("__k"))
    near = near.withColumn("__blocked", F.max(F.col("__stop").cast("int")).over(between.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.where((F.col("__blocked") == 0) & kind.isin("text", "footnote") & F.rtrim(F.coalesce("content", F.lit(""))).endswith(F.col("__label")))
    near = near.withColumn("__r", F.row_number().over(between)).where("__r = 1").select(*PAGE, "pos", F.col("__label").alias("__cut"))
    out = left.join(near, [*PAGE, "pos"], "left")
    text = F.rtrim(F.coalesce("content", F.lit("")))
    shorter = F.rtrim(text.substr(F.lit(1), F.length(text) - F.length("__cut")))
    out = out.withColumn("content", F.when(F.col("__cut").isNotNull(), shorter).otherwise(F.col("content")))
    out = out.where(F.col("__cut").isNull() | (F.col("content") != ""))
    caption = squash("caption")
    new = F.when(F.contains(caption, F.col("__after")), F.col("caption")).otherwise(F.trim(F.concat_ws(" ", caption, F.col("__after"))))
    return out.withColumn("caption", F.when(F.col("__after") != "", new).otherwise(F.col("caption"))).select(*elements.columns)


def dedupe_exact(elements: DataFrame) -> DataFrame:
    """Of equal texts and footnotes on a page (white space aside) the first stays."""
    key = F.when(F.coalesce(F.col("type"), F.lit("text")).isin("text", "footnote") & (squash("content") != ""), squash("content"))
    e = elements.withColumn("__key", key)
    e = e.withColumn("__r", F.row_number().over(Window.partitionBy(*PAGE, "__key").orderBy("pos")))
    return e.where("__key IS NULL OR __r = 1").select(*elements.columns)


def dedupe_contained(elements: DataFrame, least: int = 12) -> DataFrame:
    """Without texts of at least ``least`` characters that another element of the page contains, if it is longer or comes first."""
    long_ = elements.select(*PAGE, "pos", "type", squash("content").alias("t")).where(F.length("t") >= least)
    a, b = long_.where(F.coalesce("type", F.lit("text")).isin("text", "footnote")).alias("a"), long_.alias("b")
    same_page = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_no") == F.col("b.page_no")) & (F.col("a.pos") != F.col("b.pos"))
    inside = F.contains(F.col("b.t"), F.col("a.t")) & ((F.length("b.t") > F.length("a.t")) | (F.col("b.pos") < F.col("a.pos")))
    gone = a.join(b, same_page & inside, "left_semi").select("a.doc_id", "a.page_no", "a.pos")
    return elements.join(gone, [*PAGE, "pos"], "left_anti").select(*elements.columns)


def drop_trailing_headings(elements: DataFrame) -> DataFrame:
    """Without two or more headings that end a page, all of which the page had before; a closing four-digit text may follow them."""
    w = _page().rowsBetween(0, Window.unboundedFollowing)
    head = F.coalesce(F.col("type"), F.lit("")).startswith("heading")
    e = numbered(elements).withColumns({"__head": head, "__year": (F.col("__i") == F.col("__n") - 1) & F.col("type").eqNullSafe("text") & squash("content").rlike(r"^\d{4}$")})
    e = e.withColumn("__tail", F.min((F.col("__head") | F.col("__year")).cast("int")).over(w) == 1)
    e = e.withColumn("__key", squash("content"))
    before = F.max((F.col("__head") & ~F.col("__tail")).cast("int")).over(Window.partitionBy(*PAGE, "__key"))
    e = e.withColumn("__seen", F.coalesce(before, F.lit(0)) == 1)
    group = Window.partitionBy(*PAGE)
    bad = (F.sum((F.col("__tail") & F.col("__head")).cast("int")).over(group) >= 2) & (F.min(F.when(F.col("__tail") & F.col("__head"), F.col("__seen").cast("int"))).over(group) == 1)
    return e.withColumn("__drop", bad & F.col("__tail") & F.col("__head")).where("NOT __drop").select(*elements.columns)


def contents_entries(elements: DataFrame) -> DataFrame:
    """(doc_id, seq, title, page): entries of the first unbroken run of pages that have any."""
    found = elements.where("type = 'toc_entry'")
    pages = found.select("doc_id", "page_no").distinct()
    run = F.col("page_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    pages = pages.withColumn("__run", run).withColumn("__first", F.min("__run").over(Window.partitionBy("doc_id"))).where("__run = __first").select("doc_id", "page_no")
    kept = found.join(pages, ["doc_id", "page_no"], "left_semi")
    parts = r"^(.*)::([^:]*)$"
    return kept.select(
        "doc_id",
        F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "pos")).alias("seq"),
        F.trim(F.regexp_extract("content", parts, 1)).alias("title"),
        F.trim(F.regexp_extract("content", parts, 2)).alias("page"),
    )


def longest_text_run(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, longest): most text elements in a row on a page."""
    w = _page()
    e = elements.withColumn("__text", F.col("type").eqNullSafe("text"))
    e = e.withColumn("__island", F.row_number().over(w) - F.sum(F.col("__text").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = e.groupBy(*PAGE, "__island").agg(F.count_if("__text").alias("n"))
    return runs.groupBy(*PAGE).agg(F.max("n").alias("longest"))


def mark(elements: DataFrame, source: Column, confidence: Column, issues: Column) -> DataFrame:
    """Sets source and confidence where there are none, and adds the issues that are not there yet."""
    has = set(elements.columns)
    old = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    return elements.withColumns(
        {
            "source": F.coalesce(old("source", "string"), source),
            "confidence": F.coalesce(old("confidence", "double"), F.round(confidence, 3)),
            "issues": F.array_union(F.coalesce(old("issues", "array<string>"), F.expr("cast(array() as array<string>)")), issues),
        }
    )


def markdown(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, markdown): each page's elements by type, an empty line between."""
    s = F.trim(F.coalesce("content", F.lit("")))
    level = F.substring("type", 9, 1).cast("int")
    kind = F.col("type")
    line = (
        F.when(kind.startswith("heading"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), s))
        .when(kind == "toc_entry", F.concat(F.lit("- "), F.regexp_replace(s, "::([^:]*)$", " ($1)")))
        .when(kind == "footnote", F.concat(F.lit("> "), s))
        .when(kind == "figure", F.concat(F.lit("!["), F.coalesce("caption", F.lit("")), F.lit("]()")))
        .when((kind == "table") & (F.coalesce("caption", F.lit("")) != ""), F.concat(F.lit("**"), F.col("caption"), F.lit("**\n"), s))
        .otherwise(s)
    )
    return elements.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("markdown"))


def xml(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, xml): each page as an XML document."""

    def escaped(c: str) -> Column:
        out = F.coalesce(F.col(c), F.lit(""))
        for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            out = F.replace(out, F.lit(raw), F.lit(name))
        return out

    item = F.concat(F.lit('<element type="'), escaped("type"), F.lit('">'), escaped("content"), F.lit("</element>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))), lambda x: x["item"]), "")
    return elements.groupBy(*PAGE).agg(F.concat(F.lit("<document><page_number>"), F.first("page_no").cast("string"), F.lit("</page_number><elements>"), body, F.lit("</elements></document>")).alias("xml"))

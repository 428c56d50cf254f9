"""Rules of the review, figure and table helpers on small hand-made pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewright.functions import grid
from pagewright.functions import text as T
from pagewright.operators import evidence, figures, flow, headings, quality, review

SCHEMA = "doc_id int, page_no int, pos int, type string, content string, caption string"
REGULAR = "<table><tr><td>name</td><td>cost</td></tr><tr><td>apple pie</td><td>12</td></tr><tr><td>pear tart</td><td>15</td></tr></table>"
RAGGED = REGULAR.replace("<td>15</td>", "")


def page(spark, *rows, schema=SCHEMA):
    return spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], schema)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_gate_takes_a_better_page_and_nothing_else(spark):
    old = page(spark, ("heading_1", "Prices", ""), ("table", RAGGED, ""), ("text", "Prices hold for a year", ""))
    mended = RAGGED.replace("<td>pear tart</td>", "<td>pear tart</td><td></td>")
    for content, tail, accepted in ((mended, "Prices hold for a year", True), (RAGGED, "Prices hold for a year", False), (mended, "", False)):
        new = page(spark, ("heading_1", "Prices", ""), ("table", content, ""), *([("text", tail, "")] if tail else []))
        row = review.improvements(old, new).first()
        assert row["accepted"] == accepted and row["old_problems"] == 1 and row["coverage"] == (1.0 if tail and content == mended else row["coverage"])
    assert not review.improvements(page(spark, ("table", REGULAR, "")), page(spark, ("table", REGULAR, ""))).first()["accepted"]


def test_hard_signals_and_notices(spark):
    schema = SCHEMA + ", source string, confidence double, issues array<string>"
    e = page(spark, ("text", "a", "", "model", 0.6, []), ("text", "b", "", "eml_notice", 0.1, []), ("table", "", "", "model", 0.9, ["no_table:x", "th_tags_present"]), schema=schema)
    low = e.select("doc_id", "page_no").distinct()
    assert values(review.hard_signals(e, low), "failure") == [("element_0_low_confidence",), ("element_2_no_table",), ("page_low_confidence",)]
    only = e.where("source = 'eml_notice'")
    assert review.notice_pages(only).first()["notice_only"] and not review.notice_pages(e).first()["notice_only"]
    assert values(review.hard_signals(only, low), "failure") == []


def test_structure_counts_caption_rows(spark):
    html = "<table><tr><th colspan='2'>Costs of</th></tr><tr><td>fruit</td><td></td></tr><tr><td>a</td><td><table><tr><td>x</td></tr></table></td></tr></table>"
    row = review.structure_facts(page(spark, ("table", html, "Costs of fruit"), ("table", "none", ""))).collect()
    assert [tuple(r)[3:] for r in row] == [(3, 1, 2, 2, 1)]


@pytest.mark.parametrize("between, distinct", [("heading_2", True), ("text", False)])
def test_repeated_tables_need_headings_of_their_own(spark, between, distinct):
    e = page(spark, ("heading_2", "North", ""), ("table", REGULAR, ""), (between, "South", ""), ("table", REGULAR, ""))
    assert [r["distinct"] for r in review.distinct_contexts(e).collect()] == [distinct]


def test_annex_title_is_recovered_once(spark):
    e = page(spark, ("text", "first words", ""))
    texts = spark.createDataFrame([(1, 1, "\n 별표 2 Rates \nfirst words")], "doc_id int, page_no int, text string")
    found = headings.recover_annexes(e, texts)
    assert values(found, "pos", "type", "content") == [(-1, "heading_1", "별표 2 Rates"), (0, "text", "first words")]
    assert headings.recover_annexes(found, texts).count() == 2
    assert headings.recover_annexes(e, texts.withColumn("text", F.lit("plain"))).count() == 1


def test_figures_are_inserted_after_their_anchor(spark):
    e = page(spark, ("text", "The boiler has three valves", ""), ("text", "end", ""), ("figure", "red boiler valve drawing shown here", ""))
    texts = e.groupBy("doc_id", "page_no").agg(F.array_join(F.collect_list("content"), "\n").alias("source_text"))
    given = spark.createDataFrame([(1, "f1", "The boiler has three", "", "", "boiler valve drawing in red"), (1, "f2", "", "x", "", "")], "doc_id int, figure_id string, anchor string, content string, caption string, description string")
    placed = given.join(flow.figure_pages(given, texts), ["doc_id", "figure_id"])
    found = [(r["pos"], r["type"], r["description"]) for r in figures.insert(e, placed).orderBy("pos").collect()]
    assert found == [(0, "text", None), (1, "figure", "boiler valve drawing in red"), (2, "text", None), (3, "figure", "")]
    assert figures.overlap("a1 b2 c3", "a1 b2 x9") == 0.0 and figures.overlap("a1 b2 c3 d4", "c3 b2 a1") == 1.0


def test_captions_follow_the_source(spark):
    schema = SCHEMA + ", description string"
    e = page(spark, ("figure", "", "Old name", "Old name shows a pump"), ("text", "The pump runs all day", "", None), schema=schema)
    anchors = spark.createDataFrame([(1, "Pump station", "The pump runs all day long", 0)], "doc_id int, prev string, next string, ord int")
    first = figures.correct_captions(e, anchors).orderBy("pos").first()
    assert (first["caption"], first["description"]) == ("Pump station", "Pump station shows a pump")
    for bad in ("□ Pump station", "It ends here.", "The pump runs all day"):
        assert figures.correct_captions(e, anchors.withColumn("prev", F.lit(bad))).orderBy("pos").first()["caption"] == "Old name"


def test_caption_rows_and_definitions():
    table = "<table><tr><td colspan='2'>{}</td></tr><tr><td>a</td><td>b</td></tr></table>"
    assert grid.strip_caption_row(table.format("(won)"), "Costs (won)").count("<tr>") == 1
    assert grid.strip_caption_row(table.format("Costs"), "costs").count("<tr>") == 1
    assert grid.strip_caption_row(table.format("Costs"), "Other") == table.format("Costs")
    formula = "<table><tr><td>A<sub>i</sub></td><td>: area</td></tr><tr><td>B</td><td>: base</td></tr></table>"
    assert grid.definition_text(formula) == "A i : area\nB : base"
    assert grid.definition_text(REGULAR) is None and grid.definition_text(formula.replace(":", "")) is None


def test_native_text_and_words(spark):
    df = spark.createDataFrame([("e\u0301\xa0 \ue000x\n\n\ny ", "그림입니다.\r\n 원본 그림의 크기: 3\n  kept \n")], "a string, b string")
    row = df.select(T.clean_native(F.col("a")).alias("a"), T.without_alt(F.col("b")).alias("b"), T.compact_offsets("a").alias("o")).first()
    assert row["a"] == "\u00e9 x\ny" and row["b"] == "kept" and row["o"] == [0, 5, 9]
    long_, short = "w" * 20_000, "w" * 300
    assert spark.range(1).select(T.excessive_output(F.lit(long_), F.lit(short)).alias("x")).first()["x"]
    assert not spark.range(1).select(T.excessive_output(F.lit(long_), F.lit("w" * 200)).alias("x")).first()["x"]


def test_support_finds_short_long_and_repeated_needles(spark):
    long_ = "the quick brown fox jumps over the lazy dog and runs away from it"
    needles = spark.createDataFrame([(1, long_), (2, "lazy dog"), (3, ""), (4, "absent words of no text at all in here, none"), (5, "é")], "needle_id int, text string")
    sources = spark.createDataFrame([(1, f"x {long_} y {long_.upper()} z"), (2, "a lazy dog, a lazy dog"), (3, None), (4, "Été")], "source_id int, text string")
    assert values(quality.support(needles, sources), "needle_id", "source_id", "n") == [(1, 1, 2), (2, 1, 2), (2, 2, 2), (5, 4, 2)]


def test_page_steps_equal_the_operators(spark):
    rows = [("text", "the same line of text", ""), ("text", "the same line of text", ""), ("text", "a longer one: the same line of text", ""), ("table", REGULAR, ""), ("text", "apple pie", ""), ("footnote", "n", "")]
    listed = [dict(zip(("type", "content", "caption"), r)) for r in rows]
    from pagewright.operators import elements as el

    e = page(spark, *rows)
    kept = lambda df: {r["pos"] for r in df.collect()}
    assert evidence._outside(listed) == kept(el.dedupe_contained(e))
    assert evidence._once(listed) == kept(el.dedupe_exact(e))
    assert evidence.near_tables(listed) == kept(evidence.drop_prose_near_tables(e))


def test_manifest_and_listing(spark):
    runs = spark.createDataFrame([("success", 3, 1.5), ("success", 2, 0.5), ("failed", 0, 0.1)], "status string, pages int, seconds double")
    assert values(review.manifest(runs), "status", "n", "pages", "seconds") == [("failed", 1, 0, 0.1), ("success", 2, 5, 2.0)]
    ink = spark.createDataFrame([(1, 1, 0.3, 0.0)], "doc_id int, page_no int, ink double, colour double")
    runs = spark.createDataFrame([(1, 1, 4)], "doc_id int, page_no int, longest long")
    counts = spark.createDataFrame([(1, 1, 5)], "doc_id int, page_no int, n_elements long")
    assert values(review.layout_score(runs, counts, ink), "score") == [(0.3,)]

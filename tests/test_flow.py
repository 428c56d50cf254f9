"""Columns, figures, fallback pages and the page pipeline as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions.text import mask_pii
from pagewright.operators import flow
from tests.test_evidence import html, page, source


def said(df):
    return [(r.type, r.content) for r in df.orderBy("page_no", "pos").collect()]


def two(spark, left, right):
    return page(spark, *left).withColumn("column", F.lit(0)).unionByName(page(spark, *right).withColumn("column", F.lit(1)))


def test_columns_are_merged(spark):
    df = two(spark, [("heading_1", "I. Intro"), ("text", "it ends with no"), ("footnote", "n")], [("heading_1", "Next"), ("text", "boundary at all."), ("text", "More.")])
    assert said(flow.merge_columns(df)) == [("heading_1", "I. Intro"), ("text", "it ends with no"), ("text", "boundary at all."), ("footnote", "n"), ("heading_2", "Next"), ("text", "More.")]
    done = two(spark, [("text", "It ends.")], [("heading_1", "Next"), ("text", "lower case")])
    assert [c for _, c in said(flow.merge_columns(done))] == ["It ends.", "Next", "lower case"]


def test_clipped_headers(spark):
    df = two(spark, [("text", "x")], [("heading_1", "ual report"), ("heading_2", "Real")])
    kept = flow.drop_clipped_headers(df, source(spark, "The great annual report\nother"))
    assert sorted(c for _, c in said(kept)) == ["Real", "x"]


def test_figures_go_to_their_anchors(spark):
    df = page(spark, ("figure", "chart", "Sales by year"), ("text", "first"), ("text", "The text after the chart"), ("figure", "unknown", ""))
    anchors = spark.createDataFrame([("d", 1, 0, "Sales by year", "The text after")], "doc_id string, page_no int, idx int, prev string, next string")
    assert [c for _, c in said(flow.place_figures(df, anchors))] == ["first", "chart", "The text after the chart", "unknown"]
    figures = spark.createDataFrame([("d", 1, "an anchor that is there"), ("d", 2, "missing anchor"), ("d", 3, "x")], "doc_id string, figure_id int, anchor string")
    texts = source(spark, "an anchor that is there").unionByName(source(spark, "end", page_no=4))
    assert {(r.figure_id, r.page_no, r.matched) for r in flow.figure_pages(figures, texts).collect()} == {(1, 1, True), (2, 4, False), (3, 4, False)}
    raw = spark.createDataFrame([("d", 0, 1.0, 1.0, b"a"), ("d", 1, 1.0, 1.0, b"a"), ("d", 2, 0.1, 1.0, b"b"), ("d", 3, 0.3, 9.0, b"c"), ("d", 4, 0.0, 0.0, b"e")], "doc_id string, ord int, w_in double, h_in double, data binary")
    assert sorted(r.ord for r in flow.significant_figures(raw).collect()) == [0, 4]


def test_fallback_pages(spark):
    got = flow.fallback_pages(source(spark, "abcabcabc\nsame line\nsame  line\n\nnext part\n"))
    assert [(r.content, r.confidence) for r in got.orderBy("pos").collect()] == [("abc\nsame line", 0.45), ("next part", 0.45)]


def test_page_pipeline(spark):
    df = page(
        spark,
        ("heading_1", "Results of the year"),
        ("text", "a.kim@x.org wrote this long line of text"),
        ("text", "a.kim@x.org wrote this long line of text"),
        ("heading_2", "매출 현황"),
        ("table", html(["key", "value"], ["one", "1"], ["two"])),
        ("text", "(단위: 천원)"),
        ("text", "value"),
        ("text", "- 1 -"),
    )
    out = flow.clean_pages(df, source(spark, "Results of the year\na.kim@x.org wrote this long line of text"), lambda c: mask_pii(c, ("email",))).orderBy("pos").collect()
    assert [(r.type, r.content[:9], r.caption) for r in out] == [
        ("heading_1", "Results o", ""),
        ("text", "a***@x.or", ""),
        ("heading_2", "매출 현황", ""),
        ("table", "<table><t", "매출 현황 (단위: 천원)"),
    ]
    assert out[3].content.count("<td>") == 6 and out[3].confidence == 0.85 and out[3].issues == ["ragged_row:2:-1"]

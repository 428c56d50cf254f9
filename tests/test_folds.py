"""The steps that kept queries from growing with the tables: each at a size, or in a form, that the code before could not do."""

import time

import pyarrow as pa
import pytest

from pagewright.functions import grid
from pagewright.operators import folds, layout, native, quality, review
from pagewright.plans import registry

DIR = "/root/testdata/sf0.001"


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


@pytest.fixture
def no_parser(monkeypatch):
    def fail(*_):
        raise AssertionError("the parser was called")

    monkeypatch.setattr(grid._Builder, "feed", fail)


def exchanges(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bare_tables_are_not_parsed(no_parser):
    html = table(["A 1", " b～"], ["", "c>d", "total"])
    assert grid.cell_keys(html) == ["a1", "b~", "c>d", "total"]
    assert grid.assess(html) == (2, 3, 0.65, ["ragged_rows"])
    assert grid.repair(table("ab", "cd", "e"))[0] == [(table("ab", "cd", ["e", ""]), None)]
    assert grid.ordered_text(html) == "a1b~c>dtotal" and grid.topology(html) == "1x1,1x1/1x1,1x1,1x1"


def test_other_html_is_left_to_the_parser():
    for html in (None, "", "x", "<table><tr><td>a<td>b</table>", '<table><tr><td colspan="2">a</td></tr></table>', "<table><tr><td>a&amp;b</td></tr></table>", "<table><tr><td><b>a</b></td></tr></table>", table("a") * 2):
        assert grid.plain_rows(html) is None


def test_stacked_tables_are_found_in_linear_time():
    began = time.time()
    assert grid.repair(table(*["ab"] * 30000, *["abc"] * 30000))[2] == ["stacked_tables_split"]
    assert time.time() - began < 20


def test_groups_pass_over_batches():
    batches = [pa.record_batch({"k": k, "v": v}) for k, v in (([1, 1], [1, 2]), ([1, 2], [3, 4]), ([None], [5]))]
    assert list(folds.grouped(batches, 1)) == [[(1, 1), (1, 2), (1, 3)], [(2, 4)], [(None, 5)]]


def test_native_match_makes_its_rows_once(spark):
    assert exchanges(registry.native_match(spark, DIR)).count("lineitem.parquet") == 1


def test_table_pages_makes_its_rows_once(spark):
    assert exchanges(registry.table_homes(spark, DIR)).count("lineitem.parquet") == 1


def test_equal_long_pages_are_judged_at_once():
    page = [("table", table(*[(str(i), str(i * 7)) for i in range(40000)]), ""), ("table", table(["ab", "cd"], ["ef", "gh", "ij"]), "")]
    began = time.time()
    got = review.better(page, [page[0], ("table", table(["ab", "cd", ""], ["ef", "gh", "ij"]), "")])
    assert got["accepted"] and time.time() - began < 20


def test_graft_matches_equal_long_tables_at_once():
    rows = [(str(i), str(i * 7)) for i in range(40000)]
    broken, whole = table(*rows, ["total"]), table(*rows, ["total", ""])
    began = time.time()
    got = list(layout._graft(0.98)([("d", 1, 0, 0, broken, ""), ("d", 1, 0, 1, whole, "")]))
    assert got == [("d", 1, 0, whole, True)] and time.time() - began < 20


def test_align_takes_long_tables():
    mine, theirs = [str(i) for i in range(14400)], [str(i - 5000) for i in range(72000)]
    began = time.time()
    assert native.align(mine, theirs) == [(i, i + 5000) for i in range(14400)] and time.time() - began < 20


def test_chunks_make_their_rows_once(spark):
    assert exchanges(registry.QUERIES["chunk_toc"](spark, DIR)).count("lineitem.parquet") == 1


def test_conservation_takes_apart_only_lines_that_differ(spark):
    made = lambda *rows: spark.createDataFrame(rows, "doc_id int, content string")
    got = quality.conserved(made((1, "same line\nOne two"), (2, "a"), (3, "")), made((1, "two\nsame line\nthree three"), (2, "a")))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (2, 0, 0)]
    assert "line#" in exchanges(got)


def test_layout_makes_its_rows_once(spark):
    assert exchanges(registry.reassigned(spark, DIR)).count("lineitem.parquet") == 1

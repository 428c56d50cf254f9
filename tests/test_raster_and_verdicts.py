from __future__ import annotations

import numpy as np
import pytest

from pagewright.functions import raster
from pagewright.operators import verdicts


def ruled(spanned: bool) -> np.ndarray:
    image = np.full((200, 400), 255, np.uint8)
    for y in (20, 60, 100, 140):
        image[y : y + 2, 40:342] = 0
    for x in (40, 140, 240, 340):
        image[20:142, x : x + 2] = 0
    if spanned:
        image[64:98, 130:160] = 255
    return image


def test_ruled_tables():
    assert [y for y, _, _ in raster.horizontal_rules(ruled(False))] == [20, 60, 100, 140]
    assert len(raster.vertical_rules(ruled(False))) == 4
    assert raster.spans(ruled(False), 3, 3) == [[1, 1, 1]] * 3
    assert raster.spans(ruled(True), 3, 3) == [[1, 1, 1], [2, 1], [1, 1, 1]]
    assert raster.spans(ruled(False), 4, 3) == [] and raster.table_window(ruled(False), 2) == []


def test_runs():
    length, start = raster.runs(np.array([[1, 1, 0, 1, 1, 1], [0, 0, 0, 0, 0, 0]], bool))
    assert length.tolist() == [3, 0] and start[0] == 3


def test_columns_and_ink():
    page = np.full((300, 400), 255, np.uint8)
    assert not raster.has_ink(page)
    page[20:280:6, 20:180] = 0
    page[20:280:6, 220:380] = 0
    assert raster.has_ink(page) and raster.column_gap(page) == pytest.approx(0.5, abs=0.02)
    page[20:280:6, 180:220] = 0
    assert raster.column_gap(page) is None
    assert raster.decode(2, 1, b"\x01\x02").tolist() == [[1, 2]]


def test_verdicts(spark):
    schema = "key int, ok boolean, score int, severity string, issues array<string>, missing array<string>, mismatches array<struct<image:string,candidate:string>>, invented array<string>, structure array<string>, page_text string"
    text = "The report of 2024 names three towns."
    rows = [
        (1, False, 70, "major", ["missing_text"], ["report of 2024", "- 12 -"], [], [], [], text),
        (2, True, 95, "none", ["missing_text"], ["a fourth town"], [], [], [], text),
        (3, False, 60, "major", ["wrong_text"], [], [("three cities", "three towns"), ("x", "not there")], [], [], text),
        (4, False, 90, "minor", ["hallucination", "other"], [], [], ["five rivers"], [], text),
        (5, False, 50, "major", ["wrong_order"], [], [], [], ["the page number - 3 - is off"], text),
        (6, True, 90, None, ["table_structure"], [], [], [], ["row 2 is split"], text),
    ]
    got = {r.key: r for r in verdicts.stabilise(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r.ok, r.severity, r.score, r.issues) for k, r in got.items()} == {
        1: (True, "none", 80, []),
        2: (False, "major", 95, ["missing_text"]),
        3: (False, "major", 60, ["wrong_text"]),
        4: (True, "minor", 90, ["other"]),
        5: (True, "none", 80, []),
        6: (False, "major", 90, ["table_structure"]),
    }
    assert [m.candidate for m in got[3].mismatches] == ["three towns"]

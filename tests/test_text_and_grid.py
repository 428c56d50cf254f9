"""Functions that need no Spark session, and those that do, on hand-made cases."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import grid, text
from pagewright.sources import files


def table(*rows):
    tag = "<{0}>{1}</{0}>".format
    return tag("table", "".join(tag("tr", "".join(tag("td", c) for c in r)) for r in rows))


def widths(html):
    return [len(r) for r in grid.grid_of(grid.rows_of(grid.first_table(html)))]


def test_rowspan_fills_the_row_below():
    html = "<table><tr><td rowspan=2>a</td><td>b</td><td>c</td></tr><tr><td>d</td><td>e</td></tr></table>"
    assert widths(html) == [3, 3]
    assert grid.grid_of(grid.rows_of(grid.first_table(html)))[1] == [None, "d", "e"]


def test_unclosed_cells_and_nested_tables():
    assert widths("<table><tr><td>a<td>b<tr><td>c<td>d</table>") == [2, 2]
    html = "<table><tr><td>x<table><tr><td>1</td><td>2</td></tr></table></td><td>y</td></tr></table>"
    assert widths(html) == [2]
    assert grid.assess(html)[2:] == (0.95, [])
    assert grid.repair(html)[2] == ["nested_table_kept"]


def test_short_row_is_padded_unless_a_cell_spans():
    html = table("abc", "def", "gh")
    parts, again, issues = grid.repair(html, "cap")
    assert widths(parts[0][0]) == [3, 3, 3] and parts[0][1] == "cap" and not again and issues == ["ragged_row:2:-1"]
    spanned = html.replace("<td>a</td>", '<td colspan="2">a</td>')
    assert grid.repair(spanned) == ([(spanned, None)], False, ["has_merge_keep"])


def test_stacked_and_side_by_side_tables_are_split():
    parts, _, issues = grid.repair(table("ab", "cd", "efg", "hij"))
    assert [widths(p) for p, _ in parts] == [[2, 2], [3, 3]] and issues == ["stacked_tables_split"]
    tiled = table(["name", "size", "name", "size"], ["red", "one", "blue", "two"])
    parts, _, issues = grid.repair(tiled, "t")
    assert len(parts) == 2 and issues == ["tiled_header:2:0"] and parts[1][1] == "t (우)"
    gutter = table(["ab", "cd", "", "ef", "gh"], ["ij", "kl", "", "mn", "op"])
    assert [widths(p) for p, _ in grid.repair(gutter)[0]] == [[2, 2], [2, 2]]
    numbers = table(["1", "2", "1", "2"], ["3", "4", "5", "6"])
    assert grid.repair(numbers)[0] == [(numbers, None)]


def test_doubled_cell_is_merged():
    parts, _, issues = grid.repair(table("abc", "def", "gghi"))
    assert widths(parts[0][0]) == [3, 3, 3] and "adjacent_dup_merged:2:0" in issues


def test_quality_of_tables():
    assert grid.assess(table("ab", "c")) == (2, 2, 0.65, ["ragged_rows"])
    assert grid.assess("no table") == (0, 0, 0.0, ["no_table"])
    assert grid.assess("<table></table>") == (0, 0, 0.2, ["empty_table"])
    assert grid.assess("<table><tr><th>a</th></tr></table>")[2] == 0.9
    twice = "the quick brown fox jumps over"
    assert "possible_internal_duplicate_text" in grid.assess(f"<table><tr><td>{twice}<br>{twice}s</td><td>x</td></tr></table>")[3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab<& ", max_size=4), min_size=3, max_size=3), min_size=2, max_size=5))
def test_rendered_grids_are_parsed_back(rows):
    rows = [[c.strip() for c in r] for r in rows]
    back = grid.grid_of(grid.rows_of(grid.first_table(grid.render(rows))))
    assert back == rows
    once = grid.repair(grid.render(rows))[0]
    assert [grid.repair(h)[0] for h, _ in once] == [[(h, None)] for h, _ in once] or len(once) == 2


def test_matching_and_assignment():
    assert grid.assign([[0, 1], [0], [2]]) == [1, 0, 2]
    assert grid.assign([[0], [0]]) is None
    a = table(*[[f"cell number {i}", f"value {i * 7}"] for i in range(8)])
    assert grid.ordered_match(a, [a.replace("value 7<", "value 8<"), table("ab")]) is not None
    assert grid.ordered_match(a, [a, a]) is None
    assert grid.text_preserved(a, a.replace("</td><td>", "</td><td></td><td>")) and not grid.text_preserved(a, table("ab"))
    assert grid.topology('<table><tr><td colspan="2">x</td></tr></table>') == "2x1"


def test_repeats_and_runaways():
    assert [text.collapse(x) for x in ("참고참고1717", "aaaaaa", "하하 결과", "참고참고 1717", " abab ")] == ["참고17", "a", "하하 결과", "참고 17", " ab "]
    assert text.runs_away("start " + "xyz " * 20) and not text.runs_away("a plain sentence")


def test_json_recovery():
    cut = '{"elements": [{"type": "text", "content": "a]"}, {"type": "table"}, {"type": "te'
    assert text.salvage(cut) == [{"type": "text", "content": "a]"}, {"type": "table"}]
    assert text.mend_strings('{"a": "x\ny\\q"}') == '{"a": "x\\ny\\\\q"}'
    assert text.first_object('so: ```json\n{"a": {"b": 1}}\n``` and {"c": 2}') == '{"a": {"b": 1}}'
    assert text.first_object("none {here}") is None


@settings(max_examples=80, deadline=None)
@given(st.text("ab \n", max_size=400))
def test_pages_lose_no_letters(s):
    assert "".join("".join(p.split()) for p in text.paginate(s, 20, 10)) == "".join(s.split())


def test_masks(spark):
    cases = {
        "900101-1234567": "900101-*******",
        "a.kim@x.org": "a***@x.org",
        "010-1234-5678": "010-****-5678",
        "4785 1234 1234 1139": "4785-****-****-1139",
        "123-45-67890": "123-**-*****",
    }
    kinds = ("card", "rrn", "phone", "email", "bizno")
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert all(r.got == r.want for r in df.select("want", text.mask_pii(F.col("t"), kinds).alias("got")).collect())
    again = text.mask_pii(text.mask_pii(F.col("t"), kinds), kinds)
    assert all(r.got == r.want for r in df.select("want", again.alias("got")).collect())
    assert spark.range(1).select(text.mask_pii(F.lit("no 110-123-456789 x"), ("account",))).first()[0] == "no ***-***-****** x"


def test_column_functions(spark):
    row = spark.range(1).select(
        text.preprocess(F.lit("!!!???#")).alias("noise"),
        text.preprocess(F.lit("가나  다\n\n라 ")).alias("clean"),
        text.hangul_share(F.lit("가나ab12")).alias("share"),
        text.occurrences(F.lit("abcabcab"), F.lit("abc")).alias("n"),
        text.file_stem_number(F.lit("page_0012_structured.json")).alias("page"),
        text.compact(F.lit("Ａﬁ ß-①")).alias("compact"),
        text.sequence_ratio(F.lit("abcd"), F.lit("bcde")).alias("ratio"),
        text.html_text(F.lit("<p>a &amp; b</p><script>x</script><br>c")).alias("html"),
    ).first()
    assert row.noise == "" and row.clean == "가나 다\n라" and row.share == 0.5 and row.n == 2 and row.page == 12
    assert row.compact == "afiss1" and row.ratio == pytest.approx(0.75) and row.html == "a & b\nc"


def test_record_streams():
    data = struct.pack("<I", 66 | 0 << 10 | 2 << 20) + b"ab" + struct.pack("<II", 67 | 1 << 10 | 0xFFF << 20, 3) + b"xyz" + struct.pack("<I", 68 | 1 << 10)
    found = files.records(data)
    assert found == [(66, 0, b"ab"), (67, 1, b"xyz"), (68, 1, b"")]
    assert files.record_parents(found) == [-1, 0, 0]
    coded = "가".encode("utf-16-le") + struct.pack("<H", 9) + b"\0" * 14 + "b".encode("utf-16-le") + struct.pack("<H", 13)
    assert files.paragraph_text(coded) == "가\tb\n"


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), body)
    return out.getvalue()


def test_decoders(spark, tmp_path):
    section = '<s xmlns:h="u"><h:p><h:run><h:t>one</h:t></h:run></h:p><h:p><h:run><h:tbl><h:tr><h:tc><h:cellSpan colSpan="2" rowSpan="1"/><h:p><h:run><h:t>in</h:t></h:run></h:p></h:tc></h:tr></h:tbl></h:run></h:p></s>'
    hwpx = package(Contents__section0_DOT_xml=section)
    assert files.hwpx(hwpx) == ("ok", [("text", "one"), ("table", '<table><tr><td colspan="2">in</td></tr></table>')])
    sheet = '<w><sheetViews><sheetView><pane state="frozen" ySplit="1"/></sheetView></sheetViews><sheetData><row><c r="A1" t="inlineStr"><is><t>key</t></is></c><c r="B1"><v>1</v></c></row><row><c r="A2"><v>2</v></c></row></sheetData><mergeCells><mergeCell ref="A2:B2"/></mergeCells></w>'
    book = package(xl__workbook_DOT_xml='<w xmlns:r="q"><sheets><sheet name="S" r:id="r1"/></sheets></w>', **{"xl___rels__workbook_DOT_xml_DOT_rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl__worksheets__sheet1_DOT_xml": sheet})
    assert files.xlsx(book) == ("ok", [("heading_1", "S"), ("table", '<table><tr><td>key</td><td>1</td></tr><tr><td colspan="2">2</td></tr></table>')])
    assert files.xlsx(book, batch_chars=10)[1][2] == ("table", '<table><tr><td>key</td><td>1</td></tr><tr><td colspan="2">2</td></tr></table>')
    mail = b"Subject: Hi\r\nFrom: a@b.c\r\nContent-Type: text/html\r\n\r\n<p>one</p><style>x</style><p>two &amp; three</p>"
    assert files.email(mail)[1][2] == ("text", "one\n two & three")
    for name, body in (("a.hwpx", hwpx), ("b.xlsx", book), ("c.eml", mail), ("d.txt", b"x\n\ny"), ("e.pdf", b"%PDF-1"), ("f.bin", b"no")):
        (tmp_path / name).write_bytes(body)
    got = files.decode(files.scan(spark, str(tmp_path))).collect()
    by = {}
    for r in got:
        by.setdefault(r.path[-6:], []).append((r.status, r.type))
    assert set(by) == {"a.hwpx"[-6:], "b.xlsx"[-6:], "/c.eml", "/d.txt", "/e.pdf"}
    assert by["/e.pdf"] == [("unsupported: pdf", None)] and len(by["/d.txt"]) == 2

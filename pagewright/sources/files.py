"""Document files as rows: a scan with decoders by magic bytes, each an Arrow function over ``binaryFile`` content.

A decoder never fails a task: it gives (status, parts), and what it cannot read has
a status that says why. Decoders that need software outside the standard library
(office converters, renderers) plug in through ``DECODERS``.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from email import policy
from email.parser import BytesParser
from html import escape, unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import BLOCK_END, LINE_BREAK

SUFFIXES = tuple("pdf hwp hwpx doc docx ppt pptx xls xlsx odt rtf txt csv eml".split())
_SECTION = re.compile("Contents/section" + r"\d+[.]xml")
BATCH_CHARS = 3000


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, name, ext, content) of the document files below the paths, each once, by name and path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = found.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), ext.alias("ext"), "content").where(F.col("ext").isin(*SUFFIXES))
    return rows.dropDuplicates(["path"]).orderBy(F.lower("name"), "path")


def kind_of(content: bytes, ext: str = "") -> str:
    """Decoder for a file, by its first bytes and only then by its suffix."""
    if content[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
        return "ole"
    if content[:4] == b"PK\x03\x04":
        try:
            names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
        except zipfile.BadZipFile:
            return "broken"
        return "hwpx" if any(n.startswith("Contents/section") for n in names) else "xlsx" if "xl/workbook.xml" in names else "zip"
    if content[:4] == b"%PDF":
        return "pdf"
    return "eml" if ext == "eml" else "text" if ext in ("txt", "csv") else "unknown"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _hwpx_text(run: ElementTree.Element) -> str:
    out = [run.text or ""] if _name(run.tag) == "t" else []
    for x in run:
        tag = _name(x.tag)
        out.append("\n" if tag == "lineBreak" else "\t" if tag == "tab" else "" if tag == "tbl" else _hwpx_text(x))
        if _name(run.tag) == "t":
            out.append(x.tail or "")
    return "".join(out)


def _hwpx_table(table: ElementTree.Element) -> str:
    rows = []
    for tr in table:
        if _name(tr.tag) != "tr":
            continue
        cells = []
        for tc in tr:
            if _name(tc.tag) != "tc":
                continue
            spans = next((x.attrib for x in tc if _name(x.tag) == "cellSpan"), {})
            attrs = "".join(f' {h}="{spans[x]}"' for h, x in (("colspan", "colSpan"), ("rowspan", "rowSpan")) if spans.get(x, "1") not in ("", "1"))
            inner = [s for p in tc.iter() if _name(p.tag) == "p" for s in [escape(_hwpx_text(p).strip(), quote=False)] if s]
            cells.append(f"<td{attrs}>{'<br>'.join(inner)}</td>")
        rows.append("<tr>" + "".join(cells) + "</tr>")
    return "<table>" + "".join(rows) + "</table>"


def hwpx(content: bytes) -> tuple[str, list[tuple[str, str]]]:
    """Paragraphs and tables of the sections, in order; encrypted packages are told by their manifest."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        names = z.namelist()
        manifest = z.read("META-INF/manifest.xml") if "META-INF/manifest.xml" in names else b""
        if b"encryption-data" in manifest:
            return "encrypted", []
        sections = sorted((n for n in names if _SECTION.fullmatch(n)), key=lambda n: int(re.search(r"\d+", n).group()))
        parts: list[tuple[str, str]] = []
        for n in sections:
            for p in ElementTree.fromstring(z.read(n)):
                if _name(p.tag) != "p":
                    continue
                text = _hwpx_text(p).strip()
                if text:
                    parts.append(("text", text))
                parts += [("table", _hwpx_table(t)) for t in p.iter() if _name(t.tag) == "tbl"]
        return ("ok" if parts else "empty"), parts
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
        return f"error: {type(e).__name__}", []


def hwpx_memos(content: bytes) -> list[str]:
    """Editors' comments, white space aside each once, in order."""
    seen: dict[str, str] = {}
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        for n in sorted(x for x in z.namelist() if x.startswith("Contents/section")):
            for memo in ElementTree.fromstring(z.read(n)).iter():
                if _name(memo.tag) == "memo":
                    text = " ".join(_hwpx_text(p).strip() for p in memo.iter() if _name(p.tag) == "p").strip()
                    seen.setdefault("".join(text.split()), text)
    except (zipfile.BadZipFile, ElementTree.ParseError):
        pass
    return [v for k, v in seen.items() if k]


def records(data: bytes) -> list[tuple[int, int, bytes]]:
    """(tag, level, payload) of a record stream: ten bits each of tag and level, twelve of size, all ones for a longer one."""
    out, at = [], 0
    while at + 4 <= len(data):
        (head,) = struct.unpack_from("<I", data, at)
        at, size = at + 4, head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                break
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        out.append((head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size]))
        at += size
    return out


def record_parents(found: list[tuple[int, int, bytes]]) -> list[int]:
    """For each record the last one before it of a lower level, -1 at the top."""
    out, open_ = [], []
    for i, (_, level, _) in enumerate(found):
        while open_ and found[open_[-1]][1] >= level:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        open_.append(i)
    return out


def paragraph_text(data: bytes) -> str:
    """UTF-16 text of a paragraph record: of its control codes a tab and line ends stay, extended ones skip sixteen bytes."""
    out, at = [], 0
    while at + 2 <= len(data):
        (c,) = struct.unpack_from("<H", data, at)
        if c >= 32:
            out.append(data[at : at + 2])
            at += 2
        elif c in (0, 10, 13, 24, 25, 26, 27, 28, 29, 30, 31):
            out.append("\n".encode("utf-16-le") if c in (10, 13) else b"")
            at += 2
        else:
            out.append("\t".encode("utf-16-le") if c == 9 else b"")
            at += 16
    return b"".join(out).decode("utf-16-le", "replace")


def inflate(data: bytes) -> bytes:
    """Raw deflate data, or the bytes themselves if they are not."""
    try:
        return zlib.decompress(data, -15)
    except zlib.error:
        return data


def email(content: bytes) -> tuple[str, list[tuple[str, str]]]:
    """A header part, the body, and a notice or the text of each attachment."""
    m = BytesParser(policy=policy.default).parsebytes(content)
    head = "\n".join(f"{k}: {m[k]}" for k in ("Subject", "From", "To", "Cc", "Date") if m[k])
    parts = [("heading_1", str(m["Subject"] or "(no subject)")), ("text", head)]
    body = m.get_body(("plain", "html"))
    if body is not None:
        text = body.get_content()
        if body.get_content_subtype() == "html":
            for pattern, put in ((r"<(style|script)\b[\s\S]*?</\1>", ""), (f"{LINE_BREAK[4:]}|{BLOCK_END[4:]}", "\n"), ("<[^>]+>", " ")):
                text = re.compile(pattern, re.I).sub(put, text)
            text = unescape(text)
        parts.append(("text", re.sub(r"\n\s*\n+", "\n", re.sub(r"[ \t]+", " ", text)).strip()))
    for a in m.iter_attachments():
        name, data = a.get_filename() or "attachment", a.get_payload(decode=True) or b""
        ext = name.rpartition(".")[2].lower()
        kind = kind_of(data, ext)
        if a.get_content_maintype() == "image" and "LOGO" in name.upper():
            continue
        status, inner = DECODERS[kind](data) if kind in DECODERS else ("unsupported", [])
        parts.append(("heading_2", name))
        parts += inner if status == "ok" else [("text", f"[{name}: {status}]")]
    return "ok", parts


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(content: bytes, batch_chars: int = BATCH_CHARS) -> tuple[str, list[tuple[str, str]]]:
    """Each sheet as a heading and tables: the box of its cells, merged ones spanning, rows batched without cutting a vertical merge;
    a frozen first row heads every batch."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        read = lambda n: ElementTree.fromstring(z.read(n))
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter() if _name(t.tag) == "t") for si in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        links = {r.attrib["Id"]: r.attrib["Target"].lstrip("/").removeprefix("xl/") for r in read("xl/_rels/workbook.xml.rels")}
        parts: list[tuple[str, str]] = []
        for sheet in (x for x in read("xl/workbook.xml").iter() if _name(x.tag) == "sheet"):
            parts.append(("heading_1", sheet.attrib["name"]))
            root = read("xl/" + links[next(v for k, v in sheet.attrib.items() if _name(k) == "id")])
            cells: dict[tuple[int, int], str] = {}
            for c in root.iter():
                if _name(c.tag) != "c":
                    continue
                value = {_name(x.tag): "".join(t.text or "" for t in x.iter()) for x in c}
                text = value.get("v", value.get("is", "=" + value["f"] if "f" in value else ""))
                if c.attrib.get("t") == "s" and value.get("v"):
                    text = shared[int(value["v"])]
                if text.strip():
                    cells[int(re.search(r"\d+", c.attrib["r"]).group()) - 1, _column(c.attrib["r"])] = text
            if not cells:
                continue
            top, left, bottom, right = min(r for r, _ in cells), min(c for _, c in cells), max(r for r, _ in cells), max(c for _, c in cells)
            spans, hidden, held = {}, set(), set()
            for m in (x.attrib["ref"] for x in root.iter() if _name(x.tag) == "mergeCell"):
                a, _, b = m.partition(":")
                (r1, c1), (r2, c2) = ((int(re.search(r"\d+", s).group()) - 1, _column(s)) for s in (a, b or a))
                r1, c1, r2, c2 = max(r1, top), max(c1, left), min(r2, bottom), min(c2, right)
                if r1 <= r2 and c1 <= c2:
                    spans[r1, c1] = (r2 - r1 + 1, c2 - c1 + 1)
                    hidden |= {(r, c) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)} - {(r1, c1)}
                    held |= set(range(r1 + 1, r2 + 1))
            frozen = any(_name(x.tag) == "pane" and x.attrib.get("state") == "frozen" and float(x.attrib.get("ySplit", 0)) == top + 1 for x in root.iter())

            def row(r: int) -> str:
                out = []
                for c in range(left, right + 1):
                    if (r, c) not in hidden:
                        tall, wide = spans.get((r, c), (1, 1))
                        attrs = (f' rowspan="{tall}"' if tall > 1 else "") + (f' colspan="{wide}"' if wide > 1 else "")
                        out.append(f"<td{attrs}>{escape(cells.get((r, c), ''), quote=False)}</td>")
                return "<tr>" + "".join(out) + "</tr>"

            batch, size, head = [], 0, row(top)
            for r in range(top, bottom + 1):
                line = row(r)
                if batch and size + len(line) > batch_chars and r not in held:
                    parts.append(("table", "<table>" + "".join(batch) + "</table>"))
                    batch, size = ([head], len(head)) if frozen else ([], 0)
                batch.append(line)
                size += len(line)
            parts.append(("table", "<table>" + "".join(batch) + "</table>"))
        return ("ok" if parts else "empty"), parts
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, IndexError, ValueError) as e:
        return f"error: {type(e).__name__}", []


def plain(content: bytes) -> tuple[str, list[tuple[str, str]]]:
    for encoding in ("utf-8-sig", "cp949", "latin-1"):
        try:
            text = content.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    parts = [("text", p.strip()) for p in re.compile(r"\n\s*\n").split(text) if p.strip()]
    return ("ok" if parts else "empty"), parts


Decoder = Callable[[bytes], tuple[str, list[tuple[str, str]]]]
DECODERS: dict[str, Decoder] = {"hwpx": hwpx, "eml": email, "xlsx": xlsx, "text": plain}
_PARTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("status", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("content", T.StringType())])


def decode(files: DataFrame, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """(path, status, pos, type, content): the elements of each file, or one row with only the status of why there are none."""
    known = dict(DECODERS if decoders is None else decoders)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, ext, content in zip(batch["path"], batch["ext"], batch["content"]):
                kind = kind_of(bytes(content), ext)
                status, parts = known[kind](bytes(content)) if kind in known else (f"unsupported: {kind}", [])
                rows += [(path, status, i, t, c) for i, (t, c) in enumerate(parts)] or [(path, status, None, None, None)]
            yield pd.DataFrame(rows, columns=_PARTS.names).astype({"pos": "Int32"})

    return files.select("path", "ext", "content").mapInPandas(run, _PARTS)


def load_pages(spark: SparkSession, structured: str, texts: str | None = None) -> DataFrame:
    """Elements (doc_id, page_no, pos, type, content, caption) of structured pages, JSON files named page_N_structured.json below
    a folder per document; a page that is missing or broken gives its text layer (page_N.txt) as one element."""
    fields = "struct<type:string,content:string,caption:string>"
    raw = spark.read.text(structured, wholetext=True, recursiveFileLookup=True, pathGlobFilter="page_*_structured.json").select("value", F.input_file_name().alias("p"))
    where = [F.regexp_extract("p", "([^/]+)/[^/]+$", 1).alias("doc_id"), F.regexp_extract("p", r"page_(\d+)", 1).cast("int").alias("page_no")]
    parsed = raw.select(*where, F.coalesce(F.from_json("value", f"struct<elements:array<{fields}>>")["elements"], F.from_json("value", f"array<{fields}>")).alias("e"))
    out = parsed.where("e IS NOT NULL").select("doc_id", "page_no", F.posexplode("e").alias("pos", "x")).select("doc_id", "page_no", "pos", "x.type", "x.content", "x.caption")
    if texts is None:
        return out
    layer = spark.read.text(texts, wholetext=True, recursiveFileLookup=True, pathGlobFilter="page_*.txt").select(F.trim("value").alias("content"), F.input_file_name().alias("p"))
    layer = layer.select(*where, "content").where("content <> ''").join(parsed.where("e IS NOT NULL").select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti")
    return out.unionByName(layer.select("doc_id", "page_no", F.lit(0).alias("pos"), F.lit("text").alias("type"), "content", F.lit(None).cast("string").alias("caption")))


def load_contents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, seq, title, page) of the tables of contents in metadata.json files below a folder per document; none where it is broken."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="metadata.json").select("value", F.input_file_name().alias("p"))
    toc = F.from_json("value", "struct<toc:array<struct<title:string,page:string>>>")["toc"]
    return raw.select(F.regexp_extract("p", "([^/]+)/[^/]+$", 1).alias("doc_id"), F.posexplode(toc).alias("seq", "t")).select("doc_id", "seq", "t.title", "t.page")

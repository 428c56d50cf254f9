"""Personal data: generous generators propose spans, boosted trees judge them, calibrated thresholds choose.

Generators (regular expressions made for recall) may propose overlapping spans of
several kinds. Gradient-boosted trees score each by format (digits, separators,
checksums, ranges) and context (neighbouring characters and words). A kind's
threshold is the lowest at which its redactions reach ``MIN_PRECISION`` on held-out
examples. Chosen spans that overlap are settled by score, then length, then place.

The trees are fitted on the driver from texts made here, seeded, with known spans
and hard negatives (numbers without a valid checksum, versions, dates, ids); the
model is a few kilobytes whatever the corpus.

Defined results: a null text stays null and an empty one empty, both without spans;
offsets count code points; every row is treated by itself, so repeated rows and
null doc_ids get equal results; texts of any length are read whole; columns besides
doc_id and text are not read by redact, and redacted returns them as they were; an
empty table gives no rows. A card number needs its check digit, an address of four
numbers needs each below 256.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import free, pieces, prepare, text_buffers

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "IBAN", "SSN")
GENERATORS = [
    ("EMAIL", re.compile(r"[\w.%+'-]{1,64}@[\w.-]{1,253}")),
    ("PHONE", re.compile(r"\+\d[\d ().-]{6,20}\d")),
    ("PHONE", re.compile(r"(?<![\d.])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\d)")),
    ("PHONE", re.compile(r"(?<![\d.-])(?:\+?\d{1,3}[ .-])?\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}(?![\d.-]*\d)")),
    ("PHONE", re.compile(r"\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)")),
    ("IP", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)")),
    ("CARD", re.compile(r"(?<!\d)\d{12,19}(?!\d)")),
    ("CARD", re.compile(r"(?<!\d)\d{4}([ -])\d{4}\1\d{4}\1\d{3,4}(?!\d)")),
    ("CARD", re.compile(r"(?<!\d)\d{4}([ -])\d{6}\1\d{4,5}(?!\d)")),
    ("IBAN", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("SSN", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
]
#: An address's parts before and after its at sign; the first reads the same backwards.
LOCAL, DOMAIN = re.compile(r"[\w%+-]+(?:\.[\w%+-]+){0,5}"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}")
HINTS = [re.compile(x, re.I) for x in (r"e-?mail|mailto|contact", r"tel|phone|call|fax|mobil", r"\bip\b|host|server|addr", r"card|visa|pay|credit", r"iban|account|konto|bank", r"ssn|social", r"version|\bv\b|release|build|chapter|section", r"order|invoice|\bid\b|serial|number|ref|isbn|item|sku")]
ROUNDS, DEPTH, RATE, LEAF, BINS, SEED = 60, 3, 0.25, 8, 32, 11
EXAMPLES = 3000
MIN_PRECISION = 0.98


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def iban_valid(span: str) -> bool:
    s = span.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def addresses(text: str) -> list[tuple[int, int]]:
    """Where LOCAL, an at sign and DOMAIN stand, looked for from each at sign, so that a long run is read once."""
    found, at = [], 0
    while (sign := text.find("@", at)) >= 0:
        local, domain = LOCAL.match(text[at:sign][::-1]), DOMAIN.match(text, sign + 1)
        at = sign + 1
        if local and domain:
            found.append((sign - local.end(), domain.end()))
            at = domain.end()
    return found


def propose(text: str) -> list[tuple[int, int, str]]:
    """All spans of all generators, each once, in order."""
    found = {(lo, hi, "EMAIL") for lo, hi in addresses(text)}
    for kind, pattern in GENERATORS:
        for m in pattern.finditer(text):
            found.add((m.start(), m.end(), kind))
    return sorted(found)


def describe(text: str, lo: int, hi: int, kind: str) -> list[float]:
    """Format and context of a proposed span."""
    s = text[lo:hi]
    digits = re.sub(r"\D", "", s)
    before, after = text[max(0, lo - 32) : lo], text[hi : hi + 16]
    left, right = before[-1:], after[:1]
    parts = s.split(".")
    groups = re.findall(r"\d+", s)
    domain = s.rpartition("@")[2]
    return [
        *[float(kind == k) for k in KINDS],
        hi - lo,
        len(digits),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        float(kind == "IBAN" and iban_valid(s)),
        float(len(parts) == 4 and all(p.isdecimal() and int(p) < 256 and (p == "0" or p[0] != "0") for p in parts)),
        float(s.startswith("+")),
        s.count("("),
        s.count("-"),
        s.count("."),
        s.count(" "),
        len(groups),
        float(max(map(len, groups), default=0)),
        float(len(groups[-1]) if groups else 0),
        len(set(digits)),
        float(bool(re.fullmatch(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}", domain)) if "@" in s else 0),
        float(s[:1] in ".'-%+" or s[-1:] in ".-" if "@" in s else 0),
        float(bool(re.fullmatch(r"(?:19|20)\d\d", groups[0])) if groups else 0),
        float(s[:3] in ("000", "666") or s[:1] == "9") if kind == "SSN" else 0.0,
        float(left.isalnum() or left in ("_", "$", "#", "@")) if left else 0.0,
        float(left.isdigit() or left in (".", "-") and before[-2:-1].isdigit()) if left else 0.0,
        float(right.isalnum() or right == "_" or right == "@") if right else 0.0,
        float(right in (".", "-", "@", "/") and after[1:2].isalnum()) if right else 0.0,
        float(re.search(r"\d[ .()-]{0,2}$", before) is not None),
        float(re.match(r"[ .()-]{0,2}\d", after) is not None),
        *[float(h.search(before) is not None) for h in HINTS],
    ]


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Texts with their true spans: filler words, personal data of each kind and look-alikes."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwéèüßñ" if rng.random() < 0.3 else "aeionrstlhdcu") for _ in range(rng.randint(2, 9)))

    def card(valid: bool) -> str:
        while True:
            s = num(rng.choice((16, 16, 16, 15, 14, 13, 19)))
            if luhn(s) == valid and s[0] != "0":
                sep = rng.choice(("", "", " ", "-"))
                return s if not sep or len(s) != 16 else sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def iban(valid: bool) -> str:
        country = rng.choice(("DE", "FR", "ES", "GB", "NL"))
        rest = num(rng.choice((18, 20, 16)))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        s = f"{country}{(check if valid else (check + rng.randint(1, 90)) % 97):02d}{rest}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(1, 99)} {num(2)} {num(4)} {num(4)}", f"+1-{a}-{b}-{c}", f"+{rng.randint(30, 49)}{num(10)}", f"0{num(2)}-{num(4)}-{num(4)}", f"+1 {a} {b} {c}"))

    def email() -> str:
        name = rng.choice((word(), f"{word()}.{word()}", f"{word()}.{num(2)}", f"{word()}_{num(3)}", f"{word()}+{word()}"))
        return f"{name}@{rng.choice(('mail', 'mx', word().encode('ascii', 'ignore').decode() or 'x'))}{rng.choice(('', num(1)))}.{rng.choice(('example', 'corp', 'uni'))}.{rng.choice(('com', 'org', 'net', 'de', 'fr'))}" if rng.random() < 0.7 else f"{name}@example.{rng.choice(('com', 'org', 'es'))}"

    real = {
        "EMAIL": email,
        "PHONE": phone,
        "IP": lambda: ".".join(str(rng.randint(1 if i == 0 else 0, 255)) for i in range(4)),
        "CARD": lambda: card(True),
        "IBAN": lambda: iban(True),
        "SSN": lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
    }
    false = [
        lambda: card(False),
        lambda: card(False),
        lambda: iban(False),
        lambda: ".".join(str(rng.randint(256, 999) if i == rng.randint(0, 3) else rng.randint(0, 999)) for i in range(4)),
        lambda: "version " + ".".join(str(rng.randint(0, 30)) for _ in range(4)),
        lambda: f"section {rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}",
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(10, 23)}:{num(2)}",
        lambda: f"{rng.randint(1, 9)}{num(rng.randint(3, 11))}",
        lambda: f"{num(3)}.{num(3)}.{num(3)},{num(2)}",
        lambda: f"order {num(4)}-{num(3)}-{num(4)}",
        lambda: f"id {num(3)}-{num(4)}-{num(5)}-{num(2)}",
        lambda: f"9{num(2)}-{num(2)}-{num(4)}-{num(3)}",
        lambda: f"@{word()}",
        lambda: f"{word()}@{word()}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"isbn 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
        lambda: f"+{num(1)}.{num(2)} - {num(1)}.{num(2)}",
    ]
    said = {"EMAIL": ("email ", "contact: "), "PHONE": ("tel ", "phone: ", "call "), "IP": ("ip ", "host ", "server "), "CARD": ("card ", "credit card "), "IBAN": ("iban ", "account "), "SSN": ("ssn ",)}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 8))), set()
        for _ in range(rng.randint(1, 3)):
            if text:
                text += rng.choice((" ", " ", " ", "\n", ", ", ". "))
            if rng.random() < 0.5:
                kind = rng.choice(KINDS)
                if rng.random() < 0.3:
                    text += rng.choice(said[kind])
                s = real[kind]()
                spans.add((len(text), len(text) + len(s), kind))
            else:
                s = rng.choice(false)()
            text += s + (rng.choice((".", ",", "!!", "###", "%%%", ";")) if rng.random() < 0.25 else "")
            for _ in range(rng.choice((0, 0, 1, 3))):
                text += " " + word()
        out.append((text, spans))
    return out


def _leaf(node: np.ndarray, split: np.ndarray, cuts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Leaf of each row of one tree, whose splits stand in a heap."""
    at = np.zeros(len(x), np.int64)
    for _ in range(DEPTH):
        f = split[at]
        at = 2 * at + 1 + (x[np.arange(len(x)), f] > cuts[at])
    return at - (2**DEPTH - 1)


class Trees:
    """Boosted trees of fixed depth for the logistic loss."""

    def __init__(self) -> None:
        self.bias, self.split, self.cuts, self.values = 0.0, [], [], []

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for split, cuts, values in zip(self.split, self.cuts, self.values):
            z += values[_leaf(values, split, cuts, x)]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)))[:-1] for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(borders)], 1)
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        z = np.full(len(x), self.bias)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            split, cuts, at = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = at == node
                    if rows.sum() < 2 * LEAF:
                        continue
                    gs, hs = g[rows].sum(), h[rows].sum()
                    best = 1e-6
                    for f, b in enumerate(borders):
                        if not len(b):
                            continue
                        of = binned[rows, f]
                        gl, hl, nl = (np.cumsum(np.bincount(of, w, len(b) + 1))[:-1] for w in (g[rows], h[rows], None))
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < LEAF) | (rows.sum() - nl < LEAF)] = 0
                        k = int(np.argmax(gain))
                        if gain[k] > best:
                            best, split[node], cuts[node] = float(gain[k]), f, b[k]
                at = 2 * at + 1 + (x[np.arange(len(x)), split[at]] > cuts[at])
            leaf = at - (2**DEPTH - 1)
            values = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            self.split.append(split)
            self.cuts.append(cuts)
            self.values.append(values)
            z += values[leaf]
        return self


def judged(made: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Descriptions, labels and kinds of all spans proposed in texts whose spans are known."""
    x, y, kinds = [], [], []
    for text, true in made:
        for lo, hi, kind in propose(text):
            x.append(describe(text, lo, hi, kind))
            y.append(float((lo, hi, kind) in true))
            kinds.append(kind)
    return np.array(x), np.array(y), np.array(kinds)


@lru_cache(maxsize=1)
def model() -> tuple[Trees, dict[str, float]]:
    """The trees and each kind's threshold, set on examples the trees were not fitted on."""
    x, y, _ = judged(examples())
    trees = Trees().fit(x, y)
    x, y, kinds = judged(examples(seed=SEED + 1))
    p, limits = trees.probability(x), {}
    for kind in KINDS:
        own = kinds == kind
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero(right >= MIN_PRECISION)
        # At least 0.1, which only makes it stricter; a kind that never gets precise enough is not redacted.
        limits[kind] = float(max(0.1, p[own][order][ok[-1]])) if len(ok) else float("inf")
    return trees, limits


def choose(text: str, spans: list[tuple[int, int, str]], p: np.ndarray, limits: dict[str, float]) -> list[tuple[int, int, str, float]]:
    """The spans to redact, in order, none overlapping another."""
    ranked = sorted(((-round(float(q), 6), lo - hi, lo, hi, kind) for (lo, hi, kind), q in zip(spans, p) if q >= limits[kind]))
    taken: list[tuple[int, int, str, float]] = []
    for q, _, lo, hi, kind in ranked:
        at = bisect_left(taken, (lo,))
        if (at == 0 or taken[at - 1][1] <= lo) and (at == len(taken) or hi <= taken[at][0]):
            taken.insert(at, (lo, hi, kind, -q))
    return taken


def find(texts: list[str], trees: Trees, limits: dict[str, float]) -> list[list[tuple[int, int, str, float]]]:
    spans = [propose(t) for t in texts]
    x = [describe(t, *s) for t, own in zip(texts, spans) for s in own]
    p = trees.probability(np.array(x)) if x else np.zeros(0)
    out, at = [], 0
    for text, own in zip(texts, spans):
        out.append(choose(text, own, p[at : at + len(own)], limits))
        at += len(own)
    return out


def replace(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for lo, hi, kind, _ in spans:
        out += [text[at:lo], f"[{kind}]"]
        at = hi
    return "".join([*out, text[at:]])


_MAY = np.zeros(256, np.int8)
_MAY[[*range(48, 58), 64, *range(0xD9, 256)]] = 1


def _rows_with(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that hold a byte which personal data may contain."""
    seen = np.concatenate([[0], np.cumsum(_MAY[raw], dtype=np.int32)])
    return np.flatnonzero(seen[off[1:]] > seen[off[:-1]])


def _redact(trees: Trees, limits: dict[str, float], text: str, extra: str, with_spans: bool):
    """The batch's columns, ``text`` redacted, and one more named ``extra``: the spans, or whether there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index(text)
            raw, off = text_buffers(batch.column(column))
            for lo, hi in pieces(off):
                own = batch.slice(lo, hi - lo)
                # Every generator needs an ASCII digit or an at sign, but for digits of other scripts.
                some = _rows_with(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                texts = own.column(column).take(pa.array(some)).to_pylist()
                spans = dict(zip(some.tolist(), find(texts, trees, limits)))
                changed = np.zeros(hi - lo, bool)
                changed[[i for i, x in spans.items() if x]] = True
                columns = list(own.columns)
                if changed.any():
                    new = [replace(t, spans[i]) for i, t in zip(some.tolist(), texts) if spans[i]]
                    columns[column] = pc.replace_with_mask(own.column(column), pa.array(changed), pa.array(new, own.column(column).type))
                if with_spans:
                    columns.append(pa.array([[{"begin": a, "end": b, "kind": k, "score": q} for a, b, k, q in spans.get(i, [])] for i in range(hi - lo)], _SPANS))
                else:
                    columns.append(pa.array(changed))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, extra])

    return run


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, redacted, spans array<struct<begin,end,kind,score>>) for each row; spans are places in the text as it was."""
    prepare(docs.sparkSession)
    own = docs.select("doc_id", F.col("text").alias("redacted"))
    span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())])
    return own.mapInArrow(_redact(*model(), "redacted", "spans", True), T.StructType([*own.schema.fields, T.StructField("spans", T.ArrayType(span))]))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows with all their columns, text redacted and n_chars, if there, counted again where the text changed."""
    prepare(docs.sparkSession)
    changed = free(docs.columns, "changed")
    found = docs.mapInArrow(_redact(*model(), "text", changed, False), T.StructType([*docs.schema.fields, T.StructField(changed, T.BooleanType())]))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(changed), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.drop(changed)

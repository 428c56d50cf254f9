"""Scalar text functions, as Spark columns where Catalyst can say them and as Arrow functions where not."""

from __future__ import annotations

import html
import json
import re
import textwrap
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

_SEP = r"[-\s]?"
LINE_BREAK = "(?i)<br" + r"\s*/?>"
BLOCK_END = "(?i)</(" + "|".join("table h[1-6] li tr div p".split()) + ")>"
MASKS = tuple("card account rrn bizno phone email".split())


def _groups(*sizes: str) -> str:
    """Digit groups, each captured, with an optional separator between and no digit around."""
    return r"(?<!\d)" + _SEP.join(f"([0-9]{{{n}}})" for n in sizes) + r"(?!\d)"


def letters_and_digits(text: Column) -> Column:
    """Lower case letters and digits only; equals NFKC, case folding and filtering but for compatibility characters."""
    return F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


@F.pandas_udf(types.StringType())
def compact(text: pd.Series) -> pd.Series:
    """NFKC, case folding, letters and digits only: exact, in Python."""
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "").casefold() if c.isalnum()))


def hangul_share(text: Column) -> Column:
    """Hangul among Hangul and Latin letters, 0 where there are neither."""
    t = F.coalesce(text, F.lit(""))
    hangul, latin = F.regexp_count(t, F.lit("[가-힣]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    return F.when(hangul + latin > 0, hangul / (hangul + latin)).otherwise(F.lit(0.0))


def meaning_length(text: Column) -> Column:
    """Letters and digits, without tags and the element keys of JSON."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", "")
    keys = "|".join(sorted(("content", "caption", "description", "elements", "page_number", "type"), key=len))
    return F.length(F.regexp_replace(F.regexp_replace(t, f'"({keys})"\\s*:', ""), r"[^\p{L}\p{N}]", ""))


def preprocess(text: Column, threshold: float = 0.5) -> Column:
    """Empty if at least half of it is neither Hangul, ASCII letter or digit nor space; else without private-use characters and with single line breaks and blanks."""
    t = F.coalesce(text, F.lit(""))
    special = F.regexp_count(t, F.lit(r"(?U)[^가-힣a-zA-Z0-9\s]"))
    clean = F.regexp_replace(F.replace(F.regexp_replace(t, "[-]", ""), F.lit(" "), F.lit(" ")), "\n+", "\n")
    return F.when(special >= F.length(t) * threshold, F.lit("")).otherwise(F.trim(F.regexp_replace(F.regexp_replace(clean, " +", " "), r"^\s+|\s+$", "")))


def html_text(markup: Column) -> Column:
    """Visible text of simple HTML: blocks end lines, tags are blanks, the common entities are read."""
    t = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?is)<script\b.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style\b.*?</style>", "")
    t = F.regexp_replace(F.regexp_replace(t, LINE_BREAK, "\n"), BLOCK_END, "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), " ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def mask_pii(text: Column, kinds: tuple[str, ...] = MASKS) -> Column:
    """Masks in the order of kinds above, keeping the format; only the kinds named."""
    t = text
    if "card" in kinds:
        t = F.regexp_replace(t, _groups("4", "4", "4", "4"), "$1-****-****-$4")
    if "account" in kinds:
        t = mask_accounts(t)
    if "rrn" in kinds:
        t = F.regexp_replace(t, r"(?<!\d)([0-9]{6})" + _SEP + r"[1-4][0-9]{6}(?!\d)", "$1-*******")
    if "bizno" in kinds:
        t = F.regexp_replace(t, _groups("3", "2", "5"), "$1-**-*****")
    if "phone" in kinds:
        t = F.regexp_replace(t, r"(?<!\d)(01[16-90])" + _SEP + "[0-9]{3,4}" + _SEP + r"([0-9]{4})(?!\d)", "$1-****-$2")
    if "email" in kinds:
        t = F.regexp_replace(t, r"\b([\w.%+-])[\w.%+-]*@([A-Za-z0-9.-]+[.][A-Za-z]{2,})\b", "$1***@$2")
    return t


_ACCOUNT = re.compile(r"(?<!\d)" + r"[-\s]".join((r"\d{2,6}", r"\d{2,6}", r"\d{2,7}")) + r"(?:[-\s]" + r"\d{1,6})?(?!\d)")


@F.pandas_udf(types.StringType())
def mask_accounts(text: pd.Series) -> pd.Series:
    """Digits of account numbers, separators kept."""
    return text.map(lambda t: None if t is None else _ACCOUNT.sub(lambda m: re.sub("[0-9]", "*", m.group()), t))


def file_stem_number(name: Column) -> Column:
    """The page number in a name such as page_0012_structured.json."""
    return F.try_to_number(F.regexp_extract(name, "page_([0-9]+)", 1), F.lit("9999999")).cast("int")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[" + r'<>:"/|?*\\' + "]", "_"), r"^\.+", "")


def _unit(token: str) -> str:
    n = len(token)
    for size in range(1, min(20, n // 2) + 1):
        if n % size == 0 and token == token[:size] * (n // size):
            return token[:size]
    for a in range(1, min(16, n // 2) + 1):
        head, rest = token[:a], token[2 * a :]
        if token[a : 2 * a] != head:
            continue
        unit = next((rest[:b] for b in range(1, 17) if 2 * b <= len(rest) and rest == rest[:b] * (len(rest) // b)), None)
        if unit is not None:
            return head + unit
    return token


def collapse(text: str | None) -> str | None:
    """'AAA' as 'A' and 'AABB' as 'AB' in texts of up to 40 characters; with blanks inside only if two words change."""
    core = (text or "").strip()
    if not 0 < len(core) <= 40:
        return text
    words = re.compile(r"(\s+)").split(core)
    new = [w if i % 2 else _unit(w) for i, w in enumerate(words)]
    changed = sum(a != b for a, b in zip(words, new))
    if changed < (2 if len(words) > 1 else 1):
        return text
    at = text.index(core)
    return text[:at] + "".join(new) + text[at + len(core) :]


@F.pandas_udf(types.StringType())
def collapse_repeats(text: pd.Series) -> pd.Series:
    return text.map(collapse)


def runs_away(text: str, least: int = 16, longest: int = 512, tail: int = 8192) -> bool:
    """Whether the tail ends with a unit of 2 to ``longest`` characters that comes ``least`` times in a row."""
    end = (text or "")[-tail:]
    return any(len(end) >= u * least and end.endswith(end[-u:] * least) and end[-u:].strip() for u in range(2, min(longest, len(end) // least) + 1))


@F.pandas_udf(types.BooleanType())
def is_runaway(text: pd.Series) -> pd.Series:
    return text.map(lambda t: bool(runs_away(t)))


def paginate(text: str | None, width: int = 84, lines: int = 88) -> list[str]:
    """Wrapped pages of plain text: no page is empty and blank lines never stand together."""
    out: list[str] = []
    for line in re.split("\r\n|\r|\n", text or ""):
        if line.strip():
            out += textwrap.wrap(line, max(20, width), break_on_hyphens=False, replace_whitespace=False) or [line]
        elif out and out[-1]:
            out.append("")
    while out and not out[-1]:
        out.pop()
    size = max(10, lines)
    pages = ["\n".join(out[i : i + size]).strip() for i in range(0, len(out), size)]
    return [p for p in pages if p]


@F.pandas_udf(types.ArrayType(types.StringType()))
def plain_pages(text: pd.Series) -> pd.Series:
    return text.map(paginate)


def salvage(text: str | None) -> list[dict]:
    """The complete objects of a cut-off ``elements`` array."""
    start = re.search('"elements"' + r"\s*:\s*\[", text or "")
    out: list[dict] = []
    at, decoder = start.end() if start else -1, json.JSONDecoder()
    while 0 <= at < len(text or ""):
        at = re.compile(r"[\s,]*").match(text, at).end()
        try:
            found, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        if isinstance(found, dict):
            out.append(found)
    return out


@F.pandas_udf(types.ArrayType(types.StringType()))
def salvaged_elements(text: pd.Series) -> pd.Series:
    """As JSON strings."""
    return text.map(lambda t: [json.dumps(x, ensure_ascii=False) for x in salvage(t)])


def mend_strings(text: str | None) -> str | None:
    """JSON whose strings hold raw control characters or bad escapes, made readable."""
    if text is None:
        return None
    out, inside, i, end = [], False, 0, len(text)
    while i < end:
        c = text[i]
        if inside and c == "\\":
            nxt = text[i + 1 : i + 2]
            good = nxt in tuple('"\\/bfnrt') or (nxt == "u" and re.match(r"u[0-9a-fA-F]{4}", text[i + 1 : i + 6]))
            out.append(c + nxt if good else "\\\\" + nxt)
            i += 2
            continue
        if c == '"':
            inside = not inside
        out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, f"\\u{ord(c):04x}") if inside and ord(c) < 32 else c)
        i += 1
    return "".join(out)


@F.pandas_udf(types.StringType())
def mended_json(text: pd.Series) -> pd.Series:
    return text.map(mend_strings)


def first_object(text: str | None) -> str | None:
    """The first JSON object in a text, in a fence or not."""
    body = re.sub(r"```(?:json)?", "", text or "")
    decoder = json.JSONDecoder()
    for m in re.finditer("{", body):
        try:
            found, _ = decoder.raw_decode(body, m.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            return json.dumps(found, ensure_ascii=False)
    return None


@F.pandas_udf(types.StringType())
def first_json(text: pd.Series) -> pd.Series:
    return text.map(first_object)


@F.pandas_udf(types.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, without the popularity heuristic."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(types.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def clip(text: Column, limit: int) -> Column:
    """Head and tail of a text longer than limit."""
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("\n...\n"), F.right(text, F.lit(limit - half))))


def json_coverage(out: Column, source: Column) -> Column:
    """Characters other than white space of the output against the source's, 1 for an empty source."""
    n = F.length(F.regexp_replace(F.coalesce(source, F.lit("")), r"\s", ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(F.coalesce(out, F.lit("")), r"\s", "")) / n)


def occurrences(haystack: Column, needle: Column) -> Column:
    """How often the needle stands in the haystack, without overlaps."""
    return F.when(F.length(needle) > 0, ((F.length(haystack) - F.length(F.replace(haystack, needle))) / F.length(needle)).cast("long")).otherwise(F.lit(0))


#: Bytes from which on a text has an anchor: a window of eight-byte pieces.
ANCHOR_WINDOW = 32
ANCHORED = ANCHOR_WINDOW + 7


def _window_minima(text: str | None) -> np.ndarray:
    """Least mixed value of the eight-byte pieces of each window. A text inside another has its windows there too."""
    raw = (text or "").encode()
    if len(raw) < ANCHORED:
        return np.zeros(0, np.int64)
    h = np.ndarray((len(raw) - 7,), np.uint64, raw, strides=(1,)).copy()
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.lib.stride_tricks.sliding_window_view(h.view(np.int64), ANCHOR_WINDOW).min(axis=1)


@F.pandas_udf(types.ArrayType(types.LongType()))
def anchors(text: pd.Series) -> pd.Series:
    """The anchors of all windows of a text, each once: among them, of every text that it contains, its anchor."""
    return text.map(lambda t: np.unique(_window_minima(t)))


@F.pandas_udf(types.LongType())
def anchor(text: pd.Series) -> pd.Series:
    """The anchor of the first window; null for a text of fewer than ANCHORED bytes."""
    return text.map(lambda t: next(iter(_window_minima((t or "")[:ANCHORED]).tolist()), None)).astype("Int64")


@F.pandas_udf(types.StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC."""
    return text.map(lambda t: unicodedata.normalize("NFC", t or ""))


def clean_native(text: Column) -> Column:
    """NFC, no private-use characters, single blanks and line breaks, none at the ends; for text that needs no more."""
    t = F.regexp_replace(F.replace(F.regexp_replace(composed(text), "[\ue000-\uf8ff]", ""), F.lit("\xa0"), F.lit(" ")), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{2,}", "\n"), r"(?U)^\s+|\s+$", "")


def excessive_output(generated: Column, source: Column, least_source: int = 256, base: int = 8000, ratio: float = 8.0) -> Column:
    """Whether a model's output is far longer than the source text it should repeat; false where there is little source."""
    n = meaning_length(source)
    return (n >= least_source) & (meaning_length(generated) > F.greatest(F.lit(base), F.floor(n * ratio)))


def without_alt(text: Column) -> Column:
    """Lines in one, without those that office programs put in for an image."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("그림입니다") & ~x.startswith("원본 그림의") & (x != "원본")), " ")


def content_words(text: Column, stop: Column) -> Column:
    """Distinct words of two letters or digits and more, but those of the array stop."""
    return F.array_except(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[가-힣A-Za-z0-9]{2,}"), F.lit(0)), stop)


def word_overlap(a: Column, b: Column, stop: Column) -> Column:
    """Shared content words in the smaller set of them; 0 below three."""
    x, y = content_words(a, stop), content_words(b, stop)
    both = F.size(F.array_intersect(x, y))
    return F.when(both >= 3, both / F.least(F.size(x), F.size(y))).otherwise(F.lit(0.0))


@F.pandas_udf(types.ArrayType(types.IntegerType()))
def compact_offsets(text: pd.Series) -> pd.Series:
    """For each character of ``compact`` the place of the character it comes from."""
    return text.map(lambda t: [i for i, c in enumerate(t or "") for x in unicodedata.normalize("NFKC", c).casefold() if x.isalnum()])

"""The numbering grammar of Korean statutes and reports: which marker a line begins with, and its rank.

The same tables make Spark columns and, for checks, SQL text; a lower rank is a higher level.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYLLABLES = "가나다라마바사아자차카타파하"


def _nth(units: str) -> str:
    return rf"^제\s*\d+\s*[{units}]"


#: Marker, pattern and rank, tried in this order.
MARKERS = [
    ("part", _nth("편부"), 0),
    ("chapter", _nth("장") + r"|^[Ⅰ-Ⅹ]+[.\s]", 2),
    ("roman", r"^[IVXLCDM]{1,7}\.\s", 2),
    ("section", _nth("절"), 4),
    ("subsection", _nth("관"), 6),
    ("article", _nth("조"), 8),
    ("circled", "^[①-⑳]", 20),
    ("item", r"^\d+\.(\s|$)", 30),
    ("syllable", rf"^[{SYLLABLES}]\.(\s|$)", 40),
    ("paren_number", r"^\(\s*\d+\s*\)", 50),
    ("paren_syllable", rf"^\(\s*[{SYLLABLES}]\s*\)", 52),
    ("half_number", r"^\d+\)", 60),
    ("half_syllable", rf"^[{SYLLABLES}]\)", 62),
    ("square", r"^[□■]\s", 70),
    ("circle", r"^[○◦●]\s", 74),
    ("dash", r"^[-–·∙]\s", 78),
]
STRONG = ("part", "chapter", "roman", "section", "subsection", "article")
CLAUSE = tuple(m for m, _, rank in MARKERS if rank >= 20)
#: Words that begin an annex, compared without separators.
ANNEX = tuple("참고 첨부 붙임 구조문대비표 신구조문 서식 부칙 별지 별표".split())
ANNEX_SEPARATORS = r"[·.ㆍ・∙•\s]"
_NO = r"\s*\d+"
_ARTICLE = "제" + _NO + r"\s*조"
_ARTICLE_NO = _ARTICLE + "(?:의" + _NO + ")?"
_BRACKET = r"(?:\([^)]*\))?"
CITED = r"\(\s*" + _ARTICLE + r"[^)]*관련\s*\)"
DECIMAL = r"^\d+(\.\d+)+\.?(\s|$|[^\d.])"
QUOTES = "[\"“”]"
DEFINITION = rf"^\s*\d+\.\s*{QUOTES}.{{1,200}}?{QUOTES}\s*(이?란|이라고?|은|는)(?![\p{{L}}\p{{N}}_])"
CLAUSE_MAX = 40
MODEL_RANK = {"heading_1": 90, "heading_2": 92}
HEADINGS = tuple(f"heading_{i}" for i in range(1, 7))


def _u(pattern: str) -> str:
    return "(?U)" + pattern


def marker(text: Column) -> Column:
    """Name of the marker that the text begins with, or null."""
    t = F.ltrim(F.coalesce(text, F.lit("")))
    out = None
    for name, pattern, _ in MARKERS:
        out = (F if out is None else out).when(t.rlike(_u(pattern)), F.lit(name))
    return out


def is_annex(text: Column) -> Column:
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^[\[ \t]+", "")
    bare = F.regexp_replace(t, _u(ANNEX_SEPARATORS), "")
    return bare.rlike("^(" + "|".join(ANNEX) + ")") | t.rlike(_u(CITED))


def rank(text: Column, kind: Column) -> Column:
    """Rank of a heading by its annex word, decimal depth or marker, else by the level the model gave."""
    t = F.trim(F.coalesce(text, F.lit("")))
    dots = F.regexp_count(F.regexp_extract(t, _u(r"^(\d+(\.\d+)+)"), 1), F.lit(r"\."))
    out = F.when(is_annex(t), F.lit(1)).when(t.rlike(_u(DECIMAL)), F.lit(30) + F.least(dots, F.lit(5)))
    for _, pattern, r in MARKERS:
        out = out.when(t.rlike(_u(pattern)), F.lit(r))
    for name, r in MODEL_RANK.items():
        out = out.when(kind == name, F.lit(r))
    return out.otherwise(F.lit(94))


def is_definition(text: Column) -> Column:
    """An entry of a list of definitions: number, quoted term and topic particle."""
    return F.coalesce(text, F.lit("")).rlike("(?s)" + DEFINITION)


def is_clause(text: Column) -> Column:
    """A list marker that stands before a sentence rather than a title."""
    t = F.ltrim(F.coalesce(text, F.lit("")))
    clause = [(name, pattern) for name, pattern, _ in MARKERS if name in CLAUSE]
    # A clause marker is none of the stronger ones, whose patterns exclude it.
    any_clause = t.rlike(_u("|".join(f"(?:{p})" for _, p in clause)))
    long_ = F.length(F.trim(F.coalesce(text, F.lit("")))) > CLAUSE_MAX
    return ~is_definition(text) & any_clause & (t.rlike("^[①-⑳]") | long_)


def is_promotable(kind: Column, text: Column) -> Column:
    """Prose that begins an article or a larger unit: a title in brackets, or short and no reference."""
    t = F.trim(F.coalesce(text, F.lit("")))
    unit = _u("^제" + _NO + r"\s*(조(의" + _NO + ")?|[편장절관부])")
    rest = F.ltrim(F.regexp_replace(t, unit, ""))
    titled = rest.startswith("(")
    plain = ~rest.startswith("제") & ~F.substring(rest, 1, 20).rlike("참조|준용") & (F.length(t) <= 25)
    return kind.isin("text", "paragraph") & t.rlike(unit) & (titled | plain)


def ends_open(text: Column) -> Column:
    """Ends with a particle or connective that no sentence can end with."""
    tails = ("대[한해]", "위[한해]", "관[한해]", "따[라른]", "및", "[와과의에를을로]", "에게", "에서", "하여", "하고", "되어", "또는")
    return F.coalesce(text, F.lit("")).rlike(_u("(" + "|".join(tails) + r")\s*$"))


def title(text: Column) -> Column:
    """The heading's short title: without a page counter, and of an article or definition only its name."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bare = F.trim(F.regexp_replace(t, _u(r"\s*-\s*[\s\d]{1,7}-\s*$"), ""))
    t = F.when(bare != "", bare).otherwise(t)
    names = [
        _u(rf"^\s*(\d+\.\s*{QUOTES}[^\"“”\n]{{1,80}}{QUOTES})"),
        _u("^(" + _ARTICLE_NO + r"\s*" + _BRACKET + ")"),
        _u("^(제" + _NO + r"\s*[편장절관부](?:\s*" + r"\([^)]*\))?)"),
    ]
    out = None
    for n in names:
        found = F.regexp_extract(t, n, 1)
        out = (F if out is None else out).when((found != "") & (F.length(found) < F.length(t)), F.trim(found))
    return out.otherwise(t)


def plain_title(text: Column) -> Column:
    """For comparison: without its marker, single spaces, lower case."""
    t = F.trim(F.coalesce(text, F.lit("")))
    any_marker = "|".join(f"(?:{pattern})" for _, pattern, _ in MARKERS)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, _u(any_marker), ""), _u(r"\s+"), " ")))

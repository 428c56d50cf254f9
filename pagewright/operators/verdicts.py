"""A judge's verdicts held against the page they speak of: what the page's own text does not bear out is dropped.

verdicts: (key, ok, score, severity, issues ARRAY<STRING>, missing ARRAY<STRING>, mismatches ARRAY<STRUCT<image,candidate>>,
invented ARRAY<STRING>, structure ARRAY<STRING>, page_text). All of it is array expressions on one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRUCTURAL = ("panel_assignment", "table_structure", "heading_hierarchy", "wrong_order")
SOFT = ("other", "figure_description")
PASS_SCORE, CLEAN_SCORE = 85, 80


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def is_counter(text: Column) -> Column:
    """A printed page counter and nothing else; a bare number is not one."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    named = t.rlike(r"^(쪽|페이지|p\.?|page)\s*\d{1,4}(\s*(of|/)\s*\d{1,4})?$")
    edge = r"[\s–—_/|·.()\[\]-]*"
    return named | (t.rlike("[–—_/|·.-]") & t.rlike("^" + edge + r"\d{1,4}(\s*(of|/)\s*\d{1,4})?" + edge + "$"))


def without_counter(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    cut = F.trim(F.regexp_replace(t, r"\s*[–—-]\s*(\d\s*){1,4}[–—-]\s*$", ""))
    return F.when(cut != "", cut).otherwise(t)


def about_counters(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return t.rlike("pagination|printed page|page[- ]number|(인쇄|쪽|페이지) 번호") | t.rlike(r"[–—-]\s*(\d\s*){1,4}[–—-]")


def stabilise(verdicts: DataFrame) -> DataFrame:
    """The verdicts with only supported evidence and the issues it bears, ok, severity and score set anew.

    Missing text must be absent from the page, a mismatch's candidate and invented text present; none may be a page counter.
    """
    page = letters(F.col("page_text"))
    has = lambda issue: F.array_contains("issues", issue)
    none = lambda c: F.filter(F.col(c), lambda x: F.lit(False))
    missing = F.when(has("missing_text"), F.filter("missing", lambda x: (letters(x) != "") & ~F.contains(page, letters(x)) & ~is_counter(x))).otherwise(none("missing"))

    def differs(x: Column) -> Column:
        a, b = letters(without_counter(x["image"])), letters(without_counter(x["candidate"]))
        return (a != "") & (b != "") & (a != b) & F.contains(page, b) & ~(is_counter(x["image"]) & is_counter(x["candidate"]))

    mismatches = F.when(has("wrong_text"), F.filter("mismatches", differs)).otherwise(none("mismatches"))
    invented = F.when(has("hallucination"), F.filter("invented", lambda x: (letters(x) != "") & F.contains(page, letters(x)) & ~is_counter(x) & (without_counter(x) == F.trim(x)))).otherwise(none("invented"))
    structure = F.filter("structure", lambda x: (F.trim(x) != "") & ~about_counters(x))
    v = verdicts.withColumns({"missing": missing, "mismatches": mismatches, "invented": invented, "structure": structure})
    bare = {"missing_text": "missing", "wrong_text": "mismatches", "hallucination": "invented"}

    def stands(i: Column) -> Column:
        ok = F.when(i.isin(*STRUCTURAL), F.size("structure") > 0)
        for issue, evidence in bare.items():
            ok = ok.when(i == issue, F.size(evidence) > 0)
        return ok.otherwise(F.lit(True))

    v = v.withColumn("issues", F.filter("issues", stands))
    shape = F.exists("issues", lambda i: i.isin(*STRUCTURAL))
    hard = (F.size("missing") > 0) | (F.size("mismatches") > 0) | (F.size("invented") > 0) | shape | F.array_contains("issues", "empty_or_low_confidence")
    score, empty = F.coalesce("score", F.lit(0)), F.size("issues") == 0
    fine = ~hard & (empty | ((score >= PASS_SCORE) & F.forall("issues", lambda i: i.isin(*SOFT))))
    weak = F.col("severity").isNull() | F.col("severity").isin("none", "minor")
    return v.withColumns(
        {
            "ok": F.when(hard, F.lit(False)).when(fine, F.lit(True)).otherwise(F.col("ok")),
            "severity": F.when(hard & weak, F.lit("major")).when(fine, F.when(empty, F.lit("none")).otherwise(F.lit("minor"))).otherwise(F.col("severity")),
            "score": F.when(fine & empty, F.greatest(F.lit(CLEAN_SCORE), score)).otherwise(score),
        }
    )

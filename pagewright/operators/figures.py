"""Figures taken from the source file: where they belong on parsed pages, and captions by what stands around them there."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PAGE = ("doc_id", "page_no")
STOP_WORDS = frozenset("사진 그림 이미지 그래프 도식 차트 캡처 로고 표시 내용 문구 제품 광고 보여준다 보여주는 나타낸다 나타내는 담은 담긴 관련 효과 정보 이다 있다 한다 대한 위한".split())
OVERLAP = 0.3
_BULLETS = "□◦○●*-–·•"


def tokens(text: str | None) -> set[str]:
    """Words of two letters or digits and more that say something about a picture."""
    return set(re.findall(r"[가-힣A-Za-z0-9]{2,}", text or "")) - STOP_WORDS


def overlap(a: str | None, b: str | None) -> float:
    """Shared words in the smaller set of words; 0 below three."""
    x, y = tokens(a), tokens(b)
    both = len(x & y)
    return both / min(len(x), len(y)) if both >= 3 else 0.0


def _bare(text: object) -> str:
    return "".join(str(text or "").split()) if isinstance(text, str) else ""


def _letters(text: object) -> str:
    return re.sub("[^0-9A-Za-z가-힣]", "", text).lower() if isinstance(text, str) else ""


def insert(elements: DataFrame, figures: DataFrame) -> DataFrame:
    """The elements with the figures of their page, renumbered from 0.

    figures has (doc_id, page_no, figure_id, anchor, matched, content, caption, description), its page found by
    ``flow.figure_pages``. A figure stands after the first element that has the beginning of its anchor, else last; figures
    of the model are dropped where the description of a matched one shares three tenths of their words.
    """
    names = [*PAGE, "pos", "type", "content", "caption", "description"]
    known = elements.select(*[c for c in names if c in elements.columns])
    schema = T.StructType([*[known.schema[c] for c in PAGE], T.StructField("pos", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in names[3:]]])

    def run(page: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        own = page.sort_values("pos").reindex(columns=names).astype(object).where(lambda x: x.notna(), None).to_dict("records")
        new = new.sort_values("figure_id").astype(object).where(lambda x: x.notna(), None)
        said = [d for d, m in zip(new["description"], new["matched"]) if m and d]
        kept = [e for e in own if e["type"] != "figure" or not any(overlap(f"{e['content'] or ''} {e['description'] or ''}", d) >= OVERLAP for d in said)]
        where = {c: (page if len(page) else new)[c].iloc[0] for c in PAGE}
        for f in new.to_dict("records"):
            anchor = _bare(f["anchor"])[:40]
            at = next((i + 1 for i, e in enumerate(kept) if len(anchor) >= 8 and anchor[:20] in _bare(e["content"])), len(kept))
            kept.insert(at, {"type": "figure", **{c: f[c] for c in ("content", "caption", "description")}})
        return pd.DataFrame([{**e, **where, "pos": i} for i, e in enumerate(kept)], columns=names)

    return known.groupBy(*PAGE).cogroup(figures.groupBy(*PAGE)).applyInPandas(run, schema)


def _like_title(text: str) -> bool:
    ends_sentence = text.endswith((".", "다", "음", "함", "임", "됨"))
    return 0 < len(text) <= 30 and text[0] not in _BULLETS and not "①" <= text[0] <= "⑳" and not ends_sentence


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def recaptioned(page: list[dict], anchors: list[dict]) -> list[tuple[str | None, str | None]]:
    """Caption and description of each element; a figure's are set by the line that stands before it in the source (prev),
    found by the line after it (next), if that is a title which the page does not have otherwise."""
    shown = [t for e in page for t in (_letters(e["content"]), _letters(e["caption"])) if t]
    lines = [(_letters(e["content"]), e["type"] or "") for e in page]
    prose = [i for i, (t, k) in enumerate(lines) if k.startswith(("text", "heading")) and (page[i]["content"] or "").strip()]
    keyed = [(a, _letters(a["next"])) for a in anchors]
    out = []
    for k, e in enumerate(page):
        caption, description = e["caption"], e["description"]
        after = next((lines[i][0] for i in prose if i > k), "")
        found = None
        if e["type"] == "figure":
            # First by the line that follows the figure, then by any line of the page.
            near = (x for x in keyed if len(x[1]) >= 6 and _common(after, x[1]) >= 6)
            anywhere = (x for x in keyed if len(x[1]) >= 6 and any(_common(lines[i][0], x[1]) >= 6 for i in prose))
            found = next(near, None) or next(anywhere, None)
        if found:
            title, next_ = (found[0]["prev"] or "").strip(), found[1]
            plain, now = _letters(title), _letters(caption)
            heads_next = any(t.startswith("heading") and _common(s, next_) >= 6 for s, t in lines)
            there = any(plain in t or t in plain for t in shown)
            if _like_title(title) and not heads_next and not there and not (now and (now in plain or plain in now)):
                old = (caption or "").strip()
                if old and (description or "").startswith(old):
                    description = title + description[len(old) :]
                caption = title
        out.append((caption, description))
    return out


def correct_captions(elements: DataFrame, anchors: DataFrame) -> DataFrame:
    """The elements (with description) with figures' captions corrected by anchors (doc_id, prev, next, ord)."""

    def run(page: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if page.empty or known.empty:
            return page
        rows = []
        whole = page.sort_values("pos")
        for _, own in whole.groupby("page_no", sort=True):
            clean = own.astype(object).where(own.notna(), None)
            made = recaptioned(clean.to_dict("records"), known.sort_values("ord").astype(object).where(lambda x: x.notna(), None).to_dict("records"))
            rows.append(clean.assign(caption=[c for c, _ in made], description=[d for _, d in made]))
        return pd.concat(rows)[page.columns.tolist()]

    return elements.groupBy("doc_id").cogroup(anchors.groupBy("doc_id")).applyInPandas(run, elements.schema)

"""Trusted native tables cut to pages: row alignment, support by a page's text, and sharing rows out over pages."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame

from pagewright.functions import grid
from pagewright.functions.grid import Node, cell_key, cells_of, first_table, rows_of, span


def parts_of(html: str | None) -> tuple[list[Node], list[Node]]:
    """Header and body rows; without header cells the first row is the header."""
    table = first_table(html)
    rows = rows_of(table) if table is not None else []
    head = [r for r in rows if next(r.walk("th"), None) is not None]
    return (head, [r for r in rows if r not in head]) if head else (rows[:1], rows[1:])


def row_key(row: Node) -> str:
    first = next(row.walk("td", "th"), None)
    return cell_key(first.text()) if first is not None else ""


def groups_of(rows: list[Node]) -> list[list[Node]]:
    """Rows that a cell ties together, never to be parted."""
    out, i = [], 0
    while i < len(rows):
        reach = min(len(rows), i + max([1, *(span(c, "rowspan") for c in cells_of(rows[i]))]))
        end = i + 1
        while end < reach:
            first = cells_of(rows[end])[:1]
            if first and span(first[0], "rowspan") > 1:
                break
            end += 1
        out.append(rows[i:end])
        i = end
    return out


def as_table(rows: list[Node]) -> str:
    return "<table>" + "".join(r.html() for r in rows) + "</table>"


def align(mine: list[str], theirs: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal keys in order: most of them, then fewest gaps, then the shortest stretch.

    A state is (number of pairs, first and last place in theirs, chain of pairs), the best for mine from i on and theirs from j
    on. With i fixed it gets no better as j grows, so only the places where it changes are kept: the work is in
    proportion to the pairs of equal keys, not to the product of the lengths.
    """

    def worth(s: tuple) -> tuple[int, int]:
        return s[0], -(s[2] - s[1] + 1) if s[0] else 0

    at: dict[str, list[int]] = {}
    for j in range(len(theirs) - 1, -1, -1):
        at.setdefault(theirs[j], []).append(j)
    none = (0, 0, 0, None)
    # states[k] holds for j from past ends[k - 1] to ends[k]; kept with the greatest end first.
    ends: list[int] = []
    states: list[tuple] = []

    def place(j: int) -> int:
        """How many of the kept states end at j or later."""
        return bisect_right(ends, -j)

    for i in range(len(mine) - 1, -1, -1):
        found = []
        for j in at.get(mine[i], ()):
            k = place(j + 1)
            n, _, last, chain = states[k - 1] if k else none
            found.append((j, (n + 1, j, last if n else j, ((i, j), chain))))
        for j, new in found:
            k = place(j)
            if worth(new) <= worth(states[k - 1] if k else none):
                continue
            # What ends before j and is worth less is overtaken; a state that ended at j gives up its last place.
            if k and ends[k - 1] == -j:
                k -= 1
            stop = k
            while stop < len(states) and worth(states[stop]) < worth(new):
                stop += 1
            ends[k:stop], states[k:stop] = [-j], [new]
    out, chain = [], states[-1][3] if states else None
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out


def slice_to_fragment(native: str, fragment: str) -> str | None:
    """The stretch of the native table that a page's fragment shows, with its header; None if too little agrees.

    Rows at the fragment's ends that have no key and whose text the stretch lacks are kept.
    """
    (head, body), own = parts_of(native), parts_of(fragment)[1]
    keyed = [(i, k) for i, k in enumerate(map(row_key, own)) if k]
    theirs = [row_key(r) for r in body]
    if not keyed or not theirs:
        return None
    pairs = align([k for _, k in keyed], theirs)
    if len(pairs) < max(2, (len(keyed) + 1) // 2):
        return None
    lo, hi = pairs[0][1], pairs[-1][1]
    if hi - lo + 1 > max(len(pairs) + 2, int(1.5 * len(pairs))):
        return None
    chosen, at = [], 0
    for group in groups_of(body):
        if at <= hi and at + len(group) > lo:
            chosen += group
        at += len(group)
    said = cell_key(" ".join(r.text() for r in chosen))
    beyond = lambda rows: [r for r in rows if (t := cell_key(r.text())) and not row_key(r) and t not in said]
    first, last = keyed[pairs[0][0]][0], keyed[pairs[-1][0]][0]
    return as_table([*head, *beyond(own[:first]), *chosen, *beyond(own[last + 1 :])])


def supported_rows(rows: list[Node], source: str) -> list[int]:
    """Rows whose longest cell the source has, each at a place after the one before; most rows, then most text."""
    states: dict[int, tuple[int, int, tuple]] = {-1: (0, 0, ())}
    for i, row in enumerate(rows):
        said = [v for v in (cell_key(c.own_text()) for c in cells_of(row)) if len(v) >= 3 and v in source]
        if not said:
            continue
        anchor, weight = max(said, key=len), sum(map(len, said))
        places, at = [], source.find(anchor)
        while at >= 0:
            places.append(at)
            at = source.find(anchor, at + 1)
        new = dict(states)
        for end, (n, w, path) in states.items():
            for p in places:
                if p >= end and (n + 1, w + weight) > new.get(p + len(anchor), (-1, -1))[:2]:
                    new[p + len(anchor)] = (n + 1, w + weight, (*path, i))
        states = new
    return list(max(states.values(), key=lambda s: s[:2])[2])


def slice_to_source(native: str, source_text: str) -> str:
    """The one run of rows that the page's text supports, or the whole table where that is not clear."""
    source, table = cell_key(source_text), first_table(native)
    rows = rows_of(table) if table is not None else []
    if len(source) < 40 or len(rows) < 8:
        return native
    head = next((i for i, r in enumerate(rows) if not any(c.tag == "th" for c in cells_of(r))), len(rows))
    runs: list[list[int]] = []
    for i in (head + k for k in supported_rows(rows[head:], source)):
        if runs and i - runs[-1][-1] <= 3:
            runs[-1].append(i)
        else:
            runs.append([i])
    runs.sort(key=lambda r: (-len(r), r[-1] - r[0]))
    if not runs or len(runs[0]) < 2 or (len(runs) > 1 and len(runs[0]) < len(runs[1]) + 2):
        return native
    keep = [*range(head), *range(runs[0][0], runs[0][-1] + 1)]
    if len(rows) - len(keep) < 2:
        return native
    html = as_table([rows[i] for i in keep])
    return native if {"no_table", "empty_table", "ragged_rows"} & set(grid.assess(html, True)[3]) else html


def grounded(html: str, source_text: str) -> bool:
    """Whether the page's text has nine tenths of every cell of eight characters or more."""
    source, table = cell_key(source_text), first_table(html)
    if len(source) < 40 or table is None:
        return False
    for value in (cell_key(c.own_text()) for r in rows_of(table) for c in cells_of(r)):
        if len(value) >= 8 and value not in source:
            m = grid.SequenceMatcher(None, value, source, autojunk=False)
            if m.find_longest_match().size < 0.9 * len(value):
                return False
    return True


def runs_of_pages(items: list[tuple[int, set]]) -> list[list[tuple[int, set]]]:
    """Stretches of two or more following pages whose neighbours share less than 30 % of their row keys."""
    runs, now = [], []
    for page, keys in sorted(items, key=lambda x: x[0]):
        if now:
            before = now[-1]
            shared = len(before[1] & keys) / max(1, min(len(before[1]), len(keys)))
            if page - before[0] != 1 or shared >= 0.3:
                runs.append(now)
                now = []
        now.append((page, keys))
    return [r for r in [*runs, now] if len(r) > 1]


def share_out(native: str, pages: list[set], beside: set, elsewhere: set) -> list[str | None]:
    """Each group of rows to the first page that has one of its keys; others stay with the page before, unless they belong to a page outside."""
    head, body = parts_of(native)
    got: dict[int, list[Node]] = {}
    last, early = None, []
    for group in groups_of(body):
        keys = [k for k in map(row_key, group) if k]
        page = next((i for k in keys for i, own in enumerate(pages) if k in own), None)
        if page is not None:
            last = page
            got.setdefault(page, []).extend(group)
            continue
        cells = {k for r in group for c in r.walk("td", "th") if (k := cell_key(c.text()))}
        if (keys and keys[0] in elsewhere) or len(cells & beside) > len(cells) / 2:
            continue
        if last is None:
            early += group
        else:
            got[last] += group
    if early and got:
        got[min(got)] = early + got[min(got)]
    return [as_table([*head, *got[i]]) if i in got else None for i in range(len(pages))]


def repartition(elements: DataFrame, natives: DataFrame) -> DataFrame:
    """Rows of a native table (doc_id, idx, html) that several pages' native tables show are shared out over these pages once.

    elements has native (boolean). One shuffle by document; nothing else looks across pages.
    """

    def run(doc: pd.DataFrame, native: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values(["page_no", "pos"]).reset_index(drop=True)
        native = native.sort_values("idx")
        sets = [(html, set(grid.cell_keys(html))) for html in native["html"]]
        cells: dict[int, set] = {}
        keys: dict[int, set] = {}
        owners: dict[int, list[tuple[int, int, set]]] = {}
        for i, e in doc[doc["type"] == "table"].iterrows():
            mine, rows = set(grid.cell_keys(e["content"])), {k for r in parts_of(e["content"])[1] if (k := row_key(r))}
            cells.setdefault(e["page_no"], set()).update(mine)
            keys.setdefault(e["page_no"], set()).update(rows)
            scored = [(len(mine & s) / len(mine), -n) for n, (_, s) in enumerate(sets)] if mine and e["native"] else []
            if scored and max(scored)[0] >= 0.6:
                owners.setdefault(-max(scored)[1], []).append((e["page_no"], i, rows))
        for n, items in owners.items():
            at = {page: i for page, i, _ in items}
            for stretch in runs_of_pages([(page, rows) for page, _, rows in items]):
                pages = [p for p, _ in stretch]
                beside = cells.get(pages[0] - 1, set()) | cells.get(pages[-1] + 1, set())
                elsewhere = set().union(*(k for p, k in keys.items() if p not in pages))
                for page, html in zip(pages, share_out(sets[n][0], [k for _, k in stretch], beside, elsewhere)):
                    if html is not None:
                        doc.loc[at[page], "content"] = html
        return doc

    return elements.groupBy("doc_id").cogroup(natives.select("doc_id", "idx", "html").groupBy("doc_id")).applyInPandas(run, elements.schema)

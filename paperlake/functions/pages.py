"""Page patterns, read when a plan is made."""

from __future__ import annotations

import re

MAX_PAGES = 100_000


def chunk_pages(patterns: list[int | str], extracted: list[int]) -> list[int]:
    """Pages that patterns n, a:b, a: and :b choose among the extracted ones; no pattern chooses all.

    A negative number counts from page 100,000 backwards. A range loses the sign of its ends.
    """
    if not patterns:
        return sorted(set(extracted))
    chosen: set[int] = set()
    for p in map(str, patterns):
        if re.fullmatch(r"-?\d+", p.strip()):
            n = int(p)
            chosen.add(n if n >= 0 else MAX_PAGES + n + 1)
        elif ":" in p:
            a, b = ([x for x in p.split(":")] + [""])[:2]
            low, high = abs(int(a)) if a.strip() else 1, abs(int(b)) if b.strip() else MAX_PAGES
            chosen.update(n for n in extracted if low <= n <= high)
        else:
            raise ValueError(f"page pattern: {p}")
    return sorted(chosen & set(extracted))


def region_pages(patterns: list[int | str], last: int) -> list[int]:
    """Pages that patterns choose of 1..last; negative numbers count from the last page; no pattern chooses all."""
    if not patterns:
        return list(range(1, last + 1))

    def page(s: str) -> int:
        n = int(s)
        return n if n > 0 else last + n + 1

    out: set[int] = set()
    for p in map(str, patterns):
        m = re.fullmatch(r"\s*(-?\d+)?\s*(:)?\s*(-?\d+)?\s*", p)
        if not m or not any(m.groups()):
            raise ValueError(f"page pattern: {p}")
        a, colon, b = m.groups()
        if not colon:
            if b:
                raise ValueError(f"page pattern: {p}")
            out.add(page(a))
        else:
            out.update(range(page(a) if a else 1, (page(b) if b else last) + 1))
    return sorted(n for n in out if 1 <= n <= last)

"""Spans in texts: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

Span = tuple[str, int, int]


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def free(spans: Iterable[Span], taken: Iterable[Span]) -> list[Span]:
    """Those of ``spans`` that overlap none of ``taken`` and no earlier one of their own kind; n log n in both."""
    begins: list[int] = []  # of the merged taken spans, which end at ``ends``
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s)
            ends.append(e)
    out: list[Span] = []
    last: dict[str, int] = {}
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        at = bisect_left(begins, e) - 1  # the last that begins before this ends
        if s >= last.get(k, 0) and (at < 0 or ends[at] <= s):
            out.append((k, s, e))
            last[k] = e
    return out


def outside(spans: Iterable[Span], taken: Iterable[Span]) -> list[Span]:
    """What of ``spans`` lies outside ``taken``: each span's pieces between those."""
    begins: list[int] = []
    ends: list[int] = []  # how far the spans up to each begin reach
    for s, e in sorted((s, e) for _, s, e in taken):
        begins.append(s)
        ends.append(max(e, ends[-1] if ends else e))
    out: list[Span] = []
    for k, s, e in spans:
        at = bisect_right(begins, s) - 1
        s = max(s, ends[at]) if at >= 0 else s
        at += 1
        while s < e:
            stop = min(e, begins[at]) if at < len(begins) else e
            if s < stop:
                out.append((k, s, stop))
            s, at = max(s, ends[at]) if at < len(begins) else e, at + 1
    return out


def beyond(spans: Iterable[Span], found: Iterable[Span]) -> list[Span]:
    """Those of ``spans`` that lie within none of ``found``."""
    begins: list[int] = []
    ends: list[int] = []  # how far the spans up to each begin reach
    for s, e in sorted((s, e) for _, s, e in found):
        begins.append(s)
        ends.append(max(e, ends[-1] if ends else e))
    out = []
    for k, s, e in spans:
        at = bisect_right(begins, s) - 1
        if at < 0 or ends[at] < e:
            out.append((k, s, e))
    return out

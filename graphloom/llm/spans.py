"""Sets of spans without overlaps or without containment, and positions in code points."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


class Disjoint:
    """Spans without overlaps; a look-up and an insertion take a search, not a pass over all spans."""

    def __init__(self, spans=()):
        self.spans = sorted(spans)

    def free(self, start: int, end: int) -> bool:
        """Whether no span shares a position with start to end."""
        at = bisect_left(self.spans, (start, start))
        return not (at and self.spans[at - 1][1] > start) and not (at < len(self.spans) and self.spans[at][0] < end)

    def add(self, start: int, end: int) -> bool:
        """Add the span if it is free."""
        if not self.free(start, end):
            return False
        insort(self.spans, (start, end))
        return True


class Uncontained:
    """Spans none of which contains another, so that in the order of their starts their ends are in order too."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def add(self, start: int, end: int) -> bool:
        """Add the span if no span contains it and it contains none."""
        after = bisect_left(self.spans, (start, end))
        around = after and self.spans[after - 1][1] >= end
        later = bisect_left(self.spans, (start, -1))
        inside = later < len(self.spans) and self.spans[later][1] <= end
        same = after < len(self.spans) and self.spans[after][0] == start
        if around or inside or same:
            return False
        self.spans.insert(after, (start, end))
        return True


def code_points(text: bytes) -> np.ndarray:
    """For each byte position from 0 to the length: the number of characters that begin before it."""
    data = np.frombuffer(text, np.uint8)
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

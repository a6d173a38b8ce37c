"""What a block of a byte stream does to a framing: small tables that follow one another, and the segments in a block.

A stream is cut into blocks of equal size, each with the first HALO bytes of the next, so that a mark which
begins in a block is seen whole there.  ``table`` says, for every state in which the block could be entered, the state in
which it is left; it is as large as the deepest end of nesting in the block, not as the block.  ``step`` follows a table
and ``segments`` lists what the block holds once its state is known.  Both work on whole arrays.

A state is (depth, quoted, escaped, since): the nesting, whether the block begins within a string and right behind an odd run of
backslashes (JSON only), and the offset in the stream where the segment that is open at the block's begin has begun.
"""

from __future__ import annotations

import numpy as np

HALO = 64
START = (0, 0, 0, 0)
#: A segment: (kind, since, end), end after its last byte; what is open at the end of a block is not in the list.
Segment = tuple[str, int, int]


def overlaps(a: bytes, b: bytes) -> bool:
    """Whether an occurrence of ``b`` can begin within one of ``a`` (other than at its first byte, or as the same one)."""
    return any(a[k:].startswith(b[: len(a) - k]) or b.startswith(a[k:]) for k in range(1, len(a))) or (a != b and (a.startswith(b) or b.startswith(a)))


def places(a: np.ndarray, mark: bytes, n: int) -> np.ndarray:
    """Where ``mark`` begins among the first ``n`` bytes of ``a``."""
    n = min(n, len(a) - len(mark) + 1)
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(a[:n] == mark[0])
    for k in range(1, len(mark)):
        at = at[a[at + k] == mark[k]]
    return at


class Cuts:
    """lines, ndjson and delimiters: every mark ends a segment."""

    def __init__(self, mark: bytes, kept: bool):
        self.mark, self.kept = mark, kept

    def table(self, a: np.ndarray, n: int, at: int):
        found = places(a, self.mark, n)
        return int(found[-1]) + len(self.mark) + at if len(found) else None

    def step(self, state, table, at: int, n: int):
        return state if table is None else (0, 0, 0, table)

    def segments(self, state, a: np.ndarray, n: int, at: int) -> tuple[list[Segment], tuple]:
        """(segments, the state after the block); a segment's end leaves out the mark unless it is kept, the next begins behind the mark."""
        found = places(a, self.mark, n) + at
        begin = np.concatenate([[state[3]], found + len(self.mark)])
        ends = found + len(self.mark) * self.kept
        return [("message", b, e) for b, e in zip(begin[:-1].tolist(), ends.tolist())], (0, 0, 0, int(begin[-1]))


class Fixed:
    """Segments of ``width`` bytes."""

    def __init__(self, width: int):
        self.width = width

    def table(self, a, n, at):
        return None

    def step(self, state, table, at, n):
        return (0, 0, 0, (at + n) // self.width * self.width)

    def segments(self, state, a, n, at):
        ends = range(state[3] + self.width, at + n + 1, self.width)
        return [("message", e - self.width, e) for e in ends], self.step(state, None, at, n)


class Markers:
    """Nesting start and end marks that cannot overlap; equal ones alternate.

    Depth never falls below 0, so a block entered at depth d reaches 0 where its own sum of marks first reaches -d;
    from every larger depth it stays inside.
    """

    def __init__(self, start: bytes, end: bytes):
        self.start, self.end = start, end

    def _marks(self, a: np.ndarray, n: int):
        s = places(a, self.start, n)
        if self.start == self.end:
            return s, np.zeros(len(s), np.int64)
        e = places(a, self.end, n)
        at = np.concatenate([s, e])
        order = np.argsort(at, kind="stable")
        return at[order], np.concatenate([np.ones(len(s), np.int64), -np.ones(len(e), np.int64)])[order]

    def _events(self, at, delta, d: int):
        """(where messages open, the index past the mark at which they close, depth at the end) when entered at depth ``d``."""
        if self.start == self.end:
            depth = (d + 1 + np.arange(len(at))) % 2
        else:
            total = np.cumsum(delta)
            depth = total + np.maximum(d, -np.minimum.accumulate(np.minimum(total, 0))) if len(at) else total
        before = np.concatenate([[d], depth[:-1]])
        opens, closes = at[(before == 0) & (depth == 1)], at[(before == 1) & (depth == 0)] + len(self.end)
        return opens, closes, int(depth[-1]) if len(at) else d

    def table(self, a, n, at):
        pos, delta = self._marks(a, n)
        deepest = 1 if self.start == self.end else max(0, -int(np.cumsum(delta).min(initial=0)))
        out = []
        for d in range(deepest + 1):
            opens, closes, end = self._events(pos, delta, d)
            last = opens if end else closes
            changed = len(opens) or len(closes)
            out.append((end, int(last[-1]) + at if changed and len(last) else None))
        return out, int(delta.sum())

    def step(self, state, table, at, n):
        rows, change = table
        if state[0] >= len(rows):
            return (state[0] + change, 0, 0, state[3])
        depth, since = rows[state[0]]
        return (depth, 0, 0, state[3] if since is None else since)

    def segments(self, state, a, n, at):
        opens, closes, depth = self._events(*self._marks(a, n), state[0])
        edges = np.sort(np.concatenate([opens, closes])) + at if len(opens) + len(closes) else np.zeros(0, np.int64)
        if len(opens) and len(closes):  # a message that opens right where another closes comes after it
            edges = np.empty(len(opens) + len(closes), np.int64)
            edges[bool(state[0]) :: 2], edges[not state[0] :: 2] = opens + at, closes + at
        begin = np.concatenate([[state[3]], edges]).tolist()
        kinds = ("unframed", "message") if not state[0] else ("message", "unframed")
        out = [(kinds[k % 2], b, e) for k, (b, e) in enumerate(zip(begin[:-1], begin[1:])) if e > b or kinds[k % 2] == "message"]
        return out, (depth, 0, 0, begin[-1])


class Objects:
    """JSON objects one after another.  Quotes count within objects only; a quote behind an odd run of backslashes does not."""

    def _quotes(self, a: np.ndarray, escaped: int):
        """(whether the quotes before each place are odd, with one place more; whether the end stands behind an odd run of backslashes)."""
        at = np.arange(len(a))
        other = np.maximum.accumulate(np.where(a != 92, at, -1 - escaped)) if len(a) else at
        run = (at - other) % 2 == 1
        behind = np.concatenate([[bool(escaped)], run])
        quote = (a == 34) & ~behind[:-1]
        return np.concatenate([[0], np.cumsum(quote) % 2]).astype(np.int8), int(behind[-1])

    def _walk(self, a: np.ndarray, escaped: int):
        """What the block does: its opening braces, where each one's object ends (-1: not here), and for both ways to count quotes
        the levels and the places after which the level first falls to -1, -2, ..."""
        odd, after = self._quotes(a, escaped)
        brace = np.flatnonzero((a == 123) | (a == 125))
        delta = np.where(a[brace] == 123, 1, -1)
        side = odd[brace]
        close = np.full(len(brace), -1)
        levels, falls, depth = [], [], np.zeros(len(brace), np.int64)
        for c in (0, 1):
            own = np.flatnonzero(side == c)
            level = np.cumsum(delta[own])
            depth[own] = level
            order = np.argsort(np.maximum(level, level - delta[own]), kind="stable")  # an open and its close cross the same level, one after another
            pair = (delta[own][order][:-1] == 1) & (delta[own][order][1:] == -1) & (np.maximum(level, level - delta[own])[order][:-1] == np.maximum(level, level - delta[own])[order][1:])
            close[own[order[:-1][pair]]] = brace[own[order[1:][pair]]] + 1
            low = np.minimum.accumulate(np.minimum(level, 0)) if len(level) else level
            new = np.flatnonzero(np.diff(np.concatenate([[0], low])) < 0)
            levels.append(int(level[-1]) if len(level) else 0)
            falls.append(brace[own[new]] + 1)
        first = delta == 1
        return brace[first], close[first], depth[first], side[first], levels, falls, int(odd[-1]), after

    def _ends(self, walk):
        """For each opening brace met outside of objects: the last of the objects that follow one another from it."""
        opens, close, *_ = walk
        nxt = np.searchsorted(opens, close)
        to = np.where((close >= 0) & (nxt < len(opens)), nxt, np.arange(len(opens)))
        while True:
            far = to[to]
            if (far == to).all():
                return to
            to = far

    def table(self, a, n, at):
        out = {}
        for escaped in (0, 1):
            walk = self._walk(a[:n], escaped)
            opens, close, depth, side, levels, falls, odd, after = walk
            to = self._ends(walk)

            def outside(x, since):
                """The state at the end if the block is outside from ``x`` on."""
                k = int(np.searchsorted(opens, x))
                if k == len(opens):
                    return (0, 0, 0, since)
                t = to[k]
                if close[t] >= 0:
                    return (0, 0, 0, int(close[t]) + at)
                c = side[t]
                return (levels[c] - int(depth[t]) + 1, int(odd != c), after, int(opens[t]) + at)

            if not escaped:
                out["outside"] = outside(0, None)
            for quoted in (0, 1):
                ways = [outside(int(x), int(x) + at) for x in falls[quoted]]
                out[quoted, escaped] = (ways, levels[quoted], int(odd != quoted), after)
        return out

    def step(self, state, table, at, n):
        depth, quoted, escaped, since = state
        if not depth:
            new = table["outside"]
            return new if new[3] is not None else (*new[:3], since)
        ways, change, q, e = table[quoted, escaped]
        return ways[depth - 1] if depth <= len(ways) else (depth + change, q, e, since)

    def segments(self, state, a, n, at):
        depth, quoted, escaped, since = state
        walk = self._walk(a[:n], escaped if depth else 0)
        opens, close, level, side, levels, falls, odd, after = walk
        out, x = [], 0
        if depth:
            if depth > len(falls[quoted]):
                return out, (depth + levels[quoted], int(odd != quoted), after, since)
            x = int(falls[quoted][depth - 1])
            out.append(("message", since, x + at))
            since = x + at
        starts, ends, nxt = opens.tolist(), close.tolist(), np.searchsorted(opens, close).tolist()
        k = int(np.searchsorted(opens, x))
        while k < len(starts):
            if starts[k] + at > since:
                out.append(("unframed", since, starts[k] + at))
            if ends[k] < 0:
                c = side[k]
                return out, (levels[c] - int(level[k]) + 1, int(odd != c), after, starts[k] + at)
            out.append(("message", starts[k] + at, ends[k] + at))
            since, k = ends[k] + at, nxt[k]
        return out, (0, 0, 0, since)


class Prefixes:
    """Length prefixes: each length is known only behind the one before, so ``table`` is left out and a stream is walked in order.

    The state's since is the begin of the prefix of the message that is open, or lies in a later block.
    """

    in_order = True

    def __init__(self, width: int, order: str):
        self.width, self.order = width, order

    def segments(self, state, a, n, at):
        data, out, i = a.tobytes(), [], state[3]
        if i < at:
            i = state[1]  # the end of the message that began before this block; kept in the second place
            if i > at + n:
                return out, state
            out.append(("message", state[3], i))
        while i < at + n:
            if i - at + self.width > len(data):
                return out, (0, 1 << 62, 0, i)  # the stream ends within a prefix
            end = i + self.width + int.from_bytes(data[i - at : i - at + self.width], self.order)
            if end > at + n:
                return out, (0, end, 0, i)
            out.append(("message", i, end))
            i = end
        return out, (0, i, 0, i)


class InOrder:
    """Marks that overlap: what counts as one depends on all before, so a stream is walked in order; found one after another."""

    in_order = True

    def __init__(self, start: bytes, end: bytes):
        self.start, self.end = start, end

    def segments(self, state, a, n, at):
        """state: (depth, place from which marks are looked for, 0, since)."""
        data, out = a.tobytes(), []
        depth, look, _, since = state
        look = max(look - at, 0)
        while True:
            s = data.find(self.start, look) if self.start and (not depth or self.start != self.end) else -1
            e = data.find(self.end, look) if depth or not self.start else -1
            if min((x for x in (s, e) if x >= 0), default=n) >= n:
                return out, (depth, max(look, n) + at, 0, since)
            if e >= 0 and (s < 0 or e <= s):
                look, depth = e + len(self.end), depth - 1 if self.start else 0
                if depth == 0:
                    out.append(("message", since, look + at))
                    since = look + at
            else:
                if depth == 0:
                    if s + at > since:
                        out.append(("unframed", since, s + at))
                    since = s + at
                look, depth = s + len(self.start), depth + 1


def scanner(framing):
    """The scanner of a ``Framing``."""
    if framing.kind in ("lines", "ndjson"):
        return Cuts(b"\n", False)
    if framing.kind == "fixed":
        return Fixed(framing.width)
    if framing.kind == "json":
        return Objects()
    if framing.kind == "length_prefix":
        return Prefixes(framing.width, framing.order)
    if framing.kind == "delimiter":
        return InOrder(b"", framing.end) if overlaps(framing.end, framing.end) else Cuts(framing.end, True)
    if framing.kind == "markers":
        s, e = framing.start, framing.end
        return InOrder(s, e) if any(overlaps(x, y) for x in (s, e) for y in (s, e)) else Markers(s, e)
    raise ValueError(f"{framing.kind} has no blocks")

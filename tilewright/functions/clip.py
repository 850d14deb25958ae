"""Clipping of polygons to a window, pieces apart.

A simple polygon clipped to a rectangle may fall into several pieces. Each
side of the window is a half-plane: the part inside is cut out as a set of
closed chains, whose ends on the line are paired in order along it, so pieces
of concave subjects stay apart. Holes are cut in the same way and taken off.
"""

from __future__ import annotations

Point = tuple[float, float]


def _cut(ring: list[Point], axis: int, limit: float, keep_above: bool) -> list[list[Point]]:
    """Pieces of an open ring on one side of a line along an axis."""
    sign = 1.0 if keep_above else -1.0
    side = [sign * (p[axis] - limit) for p in ring]
    if all(s >= 0 for s in side):
        return [ring] if any(s > 0 for s in side) else []
    if all(s <= 0 for s in side):
        return []
    n = len(ring)
    # chains of points strictly inside, each with its crossing points at both ends
    start = next(i for i in range(n) if side[i] > 0 and side[i - 1] <= 0)
    chains: list[list[Point]] = []
    chain: list[Point] = []
    for k in range(n):
        i, j = (start + k) % n, (start + k - 1) % n
        if side[i] > 0:
            if not chain:
                chain = [_cross(ring[j], ring[i], side[j], side[i], axis, limit)]
            chain.append(ring[i])
        elif chain:
            chain.append(_cross(ring[j], ring[i], side[j], side[i], axis, limit))
            chains.append(chain)
            chain = []
    if chain:
        i, j = start, (start - 1) % n
        chain.append(_cross(ring[j], ring[i], side[j], side[i], axis, limit))
        chains.append(chain)
    # along the line, inside alternates with outside: ends in order are joined two by two
    other = 1 - axis
    ends = sorted((c[e][other], k, e) for k, c in enumerate(chains) for e in (0, -1))
    partner = {}
    for (_, k, e), (_, m, f) in zip(ends[::2], ends[1::2], strict=True):
        partner[k, e], partner[m, f] = (m, f), (k, e)
    pieces, used = [], set()
    for k in range(len(chains)):
        if k in used:
            continue
        piece, at, e = [], k, 0
        while at not in used:
            used.add(at)
            piece += chains[at] if e == 0 else chains[at][::-1]
            at, e = partner[at, -1 if e == 0 else 0]
        pieces.append(piece)
    return pieces


def _cross(a: Point, b: Point, sa: float, sb: float, axis: int, limit: float) -> Point:
    t = sa / (sa - sb)
    along = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
    return (limit, along) if axis == 0 else (along, limit)


def ring_area(ring: list[Point]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def clip_ring(ring: list[Point], window: tuple[float, float, float, float]) -> list[list[Point]]:
    """Pieces with area of a ring (closed or not) within (x1, y1, x2, y2), as open rings."""
    own = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    pieces = [own] if len(own) > 2 else []
    for axis, limit, above in ((0, window[0], True), (0, window[2], False), (1, window[1], True), (1, window[3], False)):
        pieces = [q for p in pieces for q in _cut(p, axis, limit, above)]
    return [p for p in pieces if len(p) > 2 and ring_area(p) > 0]

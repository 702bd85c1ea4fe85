"""Long routes: candidate neighbours instead of a matrix, and improvement where something may still help.

A stop is compared with its candidates only: near stops (found in the order of a curve through grid cells, shifted a few times) and near
stops of its own group. The cheapest edges between candidates that fit together are the first pieces of the route, and the nearest
ends join them. Then 2-opt and moves of up to three stops in a row are tried from each stop to its candidates; a stop at which nothing helped is left alone until an edge at it changes. Space is stops times
candidates, and so is the time of a pass.

Points are unit vectors, so a leg costs a chord and an arc sine; a group's further runs cost as in ``route.cost``, half where a
run begins and half where it ends.
"""

import math
from collections import deque
from collections.abc import Callable

import numpy as np

from ..functions.geo import EARTH_M

#: Candidates of a stop by nearness, and within its group; places looked at along each curve; shifted curves.
NEAREST, OWN, REACH, SHIFTS = 8, 3, 8, 4
_BITS = 20


def _along_curve(x: np.ndarray, y: np.ndarray, shift: float = 0.0) -> np.ndarray:
    """The order of points along a curve that visits grid cells quarter by quarter."""
    span = max(float(np.ptp(x)), float(np.ptp(y)), 1e-12) * (1 + 1e-9)
    side = 1 << _BITS
    a = ((x - x.min()) / span * 0.5 + shift * 0.5) * side
    b = ((y - y.min()) / span * 0.5 + shift * 0.5) * side
    a, b = a.astype(np.int64), b.astype(np.int64)
    place, s = np.zeros(len(x), np.int64), side >> 1
    while s:  # Hilbert's curve: quarters in order, each turned so that the curve goes on where it left
        right, up = (a & s) > 0, (b & s) > 0
        place += s * s * ((3 * right) ^ up)
        turn = ~up
        a, b = np.where(turn & right, side - 1 - a, a), np.where(turn & right, side - 1 - b, b)
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        s >>= 1
    return np.argsort(place, kind="stable")


def _candidates(unit: np.ndarray, x: np.ndarray, y: np.ndarray, group: np.ndarray) -> list[list[int]]:
    n = len(x)
    found = []
    for k in range(SHIFTS):
        order = _along_curve(x, y, k / SHIFTS)
        within = order[np.argsort(group[order], kind="stable")]
        for line, least in ((order, None), (within, 0)):
            for step in range(1, REACH + 1):
                a, b = line[:-step], line[step:]
                if least is not None:
                    same = (group[a] == group[b]) & (group[a] >= least)
                    a, b = a[same], b[same]
                found += [np.stack([a, b]), np.stack([b, a])]
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    far = ((unit[pairs[0]] - unit[pairs[1]]) ** 2).sum(1)
    out: list[list[int]] = [[] for _ in range(n)]
    own = (group[pairs[0]] == group[pairs[1]]) & (group[pairs[0]] >= 0)
    for keep, most in ((np.ones(len(far), bool), NEAREST), (own, OWN)):
        p, d = pairs[:, keep], far[keep]
        order = np.lexsort((p[1], d, p[0]))
        p = p[:, order]
        first = np.searchsorted(p[0], p[0])
        top = np.arange(len(first)) - first < most
        for a, b in zip(p[0, top].tolist(), p[1, top].tolist(), strict=True):
            if b not in out[a]:
                out[a].append(b)
    return out


def _fragments(near: list[list[int]], leg: Callable[[int, int], float], n: int) -> list[list[int]]:
    """Pieces of a route out of the cheapest edges that fit together; 0 begins its piece."""
    edges = sorted({(leg(a, b), min(a, b), max(a, b)) for a in range(n) for b in near[a]})
    links: list[list[int]] = [[] for _ in range(n)]
    root = list(range(n))

    def top(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for _, a, b in edges:
        if len(links[a]) < (1 if a == 0 else 2) and len(links[b]) < 2 and top(a) != top(b):
            root[top(a)] = top(b)
            links[a].append(b)
            links[b].append(a)
    out, seen = [], [False] * n
    for a in range(n):
        if seen[a] or len(links[a]) == 2:
            continue
        piece, before = [], -1
        while a >= 0:
            piece.append(a)
            seen[a] = True
            a, before = next((c for c in links[a] if c != before), -1), a
        out.append(piece)
    return out


def _joined(pieces: list[list[int]], unit: np.ndarray) -> list[int]:
    """The pieces from 0 on, each followed by the one with the nearest end."""
    path = pieces[0]
    ends = np.array([[p[0], p[-1]] for p in pieces])
    left = np.arange(1, len(pieces))
    while len(left):
        far = ((unit[ends[left]] - unit[path[-1]]) ** 2).sum(2)
        k = int(far.argmin())
        piece = pieces[left[k // 2]]
        path = path + piece if k % 2 == 0 else path + piece[::-1]
        left = np.delete(left, k // 2)
    return path


def tour(lat: np.ndarray, lng: np.ndarray, groups: list[str | None], factor: float, split: float) -> list[int]:
    """The order of points 1..n-1 from point 0: an open path that no candidate's 2-opt or move makes cheaper.

    Stops of one group at one place are one point of it, in the order in which they are given.
    """
    numbers: dict[str, int] = {}
    group = np.array([-1 if g is None or i == 0 else numbers.setdefault(g, len(numbers)) for i, g in enumerate(groups)])
    _, first, which = np.unique(np.stack([lat[1:], lng[1:], group[1:]]), axis=1, return_index=True, return_inverse=True)
    kept = np.concatenate([[0], 1 + first])
    members = np.split(1 + np.argsort(which.ravel(), kind="stable"), np.cumsum(np.bincount(which.ravel()))[:-1]) if len(first) else []
    return [int(i) for c in _tour(lat[kept], lng[kept], group[kept], factor, split) for i in members[c - 1]]


def _tour(lat: np.ndarray, lng: np.ndarray, group: np.ndarray, factor: float, split: float) -> list[int]:
    n = len(lat)
    p, q = np.radians(lat), np.radians(lng)
    unit = np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)
    x, y = q * math.cos(float(p.mean())), p
    near = _candidates(unit, x, y, group)
    ux, uy, uz, own = *(unit[:, i].tolist() for i in range(3)), group.tolist()
    scale, half, end = factor * 2 * EARTH_M, split / 2, n
    near.append([])
    own.append(-1)

    def leg(a: int, b: int) -> float:
        ga, gb = own[a], own[b]
        price = 0.0 if ga == gb else half * ((ga >= 0) + (gb >= 0))
        if a == end or b == end:
            return price
        chord = math.sqrt((ux[a] - ux[b]) ** 2 + (uy[a] - uy[b]) ** 2 + (uz[a] - uz[b]) ** 2) / 2
        return price + scale * math.asin(min(1.0, chord))

    path = [*_joined(_fragments(near, leg, n), unit), end]
    at = [0] * (n + 1)
    for i, c in enumerate(path):
        at[c] = i

    def turn(i: int, j: int) -> None:
        """path[i..j] the other way round."""
        path[i : j + 1] = path[i : j + 1][::-1]
        for k in range(i, j + 1):
            at[path[k]] = k

    waiting, queued = deque(path[1:-1]), [False] + [True] * (n - 1) + [False]

    def changed(*cities: int) -> None:
        for c in cities:
            if not queued[c] and 0 < c < end:
                queued[c] = True
                waiting.append(c)

    def better(c: int) -> bool:
        i = at[c]
        before, after = path[i - 1], path[i + 1]
        to_before, to_after = leg(before, c), leg(c, after)
        for d in near[c]:
            j, new = at[d], leg(c, d)
            # c next to d, what is between them turned: c - after and d - next, or before - c and previous - d
            if new < to_after and d != after and j < n:
                e = path[j + 1]
                if new + leg(after, e) < to_after + leg(d, e) - 1e-6:
                    turn(*((i + 1, j) if i < j else (j + 1, i)))
                    changed(c, after, d, e)
                    return True
            if new < to_before and d != before and j > 0:
                e = path[j - 1]
                if e != c and new + leg(before, e) < to_before + leg(e, d) - 1e-6:
                    turn(*((i, j - 1) if i < j else (j, i - 1)))
                    changed(c, before, d, e)
                    return True
            # up to three stops that begin or end with c go next to d
            if new >= max(to_before, to_after):
                continue
            for size in (1, 2, 3):
                for first, last in ((i, i + size - 1), (i - size + 1, i)):
                    if first < 1 or last >= n or first <= j <= last:
                        continue
                    a, b, left, right = path[first], path[last], path[first - 1], path[last + 1]
                    gain = leg(left, a) + leg(b, right) - leg(left, right)
                    if gain <= 1e-6:
                        continue
                    for u, v in ((j, j + 1), (j - 1, j)):  # between these places, either way round
                        if u < 0 or v > n or first <= u <= last or first <= v <= last:
                            continue
                        s, t = path[u], path[v]
                        whole, flat, back = leg(s, t), leg(s, a) + leg(b, t), leg(s, b) + leg(a, t)
                        if min(flat, back) - whole < gain - 1e-6:
                            part = path[first : last + 1]
                            if back < flat:
                                part.reverse()
                            if u < first:
                                path[v : last + 1] = part + path[v:first]
                                span = range(v, last + 1)
                            else:
                                path[first : u + 1] = path[last + 1 : u + 1] + part
                                span = range(first, u + 1)
                            for k in span:
                                at[path[k]] = k
                            changed(a, b, left, right, s, t)
                            return True
        return False

    while waiting:
        c = waiting.popleft()
        queued[c] = False
        while better(c):
            pass
    return path[1:-1]

"""One-to-one assignment of one component of pairs: exact, with a canonical choice among equals."""

from __future__ import annotations

import heapq
from fractions import Fraction


def _whole_weights(edges: list[tuple]) -> list[int]:
    """One whole number a pair that ranks sums of p first and sums of sim second, without rounding."""
    unit = max((Fraction(v).denominator for _, _, p, s in edges for v in (p, s)), default=1)
    step = (min(len({e[0] for e in edges}), len({e[1] for e in edges})) * unit) + 1
    return [int(Fraction(p) * unit) * step + int(Fraction(s) * unit) for _, _, p, s in edges]


class Assignment:
    """A matching of largest weight with prices that prove it: price(left) + price(right) >= weight on every pair, equal on the
    matched ones, and 0 for whoever stays alone. Prices never exceed the largest weight, so numbers stay small."""

    def __init__(self, edges: list[tuple], weights: list[int]):
        self.edges, self.weights = edges, weights
        self.out: dict = {}
        for i, (a, b, *_) in enumerate(edges):
            self.out.setdefault(a, []).append((b, i))
        self.up = {a: max(weights[i] for _, i in es) for a, es in self.out.items()}
        self.down = {e[1]: 0 for e in edges}
        self.mate: dict = {}  # left -> index of its pair
        self.holder: dict = {}  # right -> left
        for a in sorted(self.out):
            self._place(a)

    def _place(self, start) -> None:
        """Find room for one more left record by the cheapest chain of moves; the last in the chain takes a free right or stays alone."""
        dist, came, done = {start: 0}, {}, []
        heap, settled = [(0, start)], set()
        best, end = self.up[start], (start, None)
        while heap:
            d, a = heapq.heappop(heap)
            if d >= best:
                break
            if a in settled:
                continue
            settled.add(a)
            done.append((a, d))
            base, mine = d + self.up[a], self.mate.get(a)
            for b, i in self.out[a]:
                if i == mine:
                    continue
                cost = base + self.down[b] - self.weights[i]
                if cost >= best:
                    continue
                other = self.holder.get(b)
                if other is None:
                    best, end = cost, (a, i)
                elif other not in settled and cost < dist.get(other, best):
                    dist[other], came[other] = cost, (a, i)
                    if cost + self.up[other] < best:
                        best, end = cost + self.up[other], (other, None)
                    heapq.heappush(heap, (cost, other))
        for a, d in done:
            if d < best:
                self.up[a] -= best - d
                if (i := self.mate.get(a)) is not None:
                    self.down[self.edges[i][1]] += best - d
        a, i = end
        if i is None:  # stays alone; its right goes to the one before it in the chain
            self.mate.pop(a, None)
            if a == start:
                return
            a, i = came[a]
        while True:
            self.mate[a], self.holder[self.edges[i][1]] = i, a
            if a == start:
                return
            a, i = came[a]

    def earliest(self) -> list[int]:
        """Among all matchings of this weight the one with the earliest pairs. They use tight pairs only and leave nobody alone who has a
        price, so a pair enters if those it displaces can be placed again along tight pairs."""
        order = sorted(range(len(self.edges)), key=lambda i: self.edges[i][:2])
        tight = [i for i in order if self.up[self.edges[i][0]] + self.down[self.edges[i][1]] == self.weights[i]]
        to_right: dict = {}
        to_left: dict = {}
        for i in tight:
            a, b = self.edges[i][:2]
            to_right.setdefault(a, []).append((b, i))
            to_left.setdefault(b, []).append((a, i))
        fixed_l, fixed_r = set(), set()
        for i in tight:
            a, b = self.edges[i][:2]
            if a in fixed_l or b in fixed_r:
                continue
            if self.mate.get(a) != i:
                mate, holder = dict(self.mate), dict(self.holder)
                lost_r, lost_l = (self.edges[mate.pop(a)][1] if a in mate else None), holder.pop(b, None)
                if lost_r is not None:
                    holder.pop(lost_r, None)
                if lost_l is not None:
                    mate.pop(lost_l, None)
                mate[a], holder[b] = i, a
                ok = lost_l is None or self.up[lost_l] == 0 or self._replace(lost_l, to_right, mate, holder, fixed_l | {a}, fixed_r | {b}, True)
                ok = ok and (lost_r is None or lost_r in holder or self.down[lost_r] == 0 or self._replace(lost_r, to_left, mate, holder, fixed_l | {a}, fixed_r | {b}, False))
                if not ok:
                    continue
                self.mate, self.holder = mate, holder
            fixed_l.add(a)
            fixed_r.add(b)
        return sorted(self.mate.values())

    def _replace(self, who, ways: dict, mate: dict, holder: dict, fixed_l: set, fixed_r: set, left: bool) -> bool:
        """Match ``who`` again along tight pairs; the chain ends at somebody free on the other side or frees one without a price."""
        came, seen, queue = {}, {who}, [who]
        closed = fixed_r if left else fixed_l
        for x in queue:
            for y, i in ways.get(x, ()):
                if y in closed or y in came:
                    continue
                came[y] = (x, i)
                held = holder.get(y) if left else (self.edges[mate[y]][1] if y in mate else None)
                if held is None or held not in seen and (self.up if left else self.down)[held] == 0:
                    if held is not None:
                        (mate if left else holder).pop(held)
                    while True:
                        x, i = came[y]
                        before = (self.edges[mate[x]][1] if x in mate else None) if left else holder.get(x)
                        a, b = self.edges[i][:2]
                        mate[a], holder[b] = i, a
                        if x == who:
                            return True
                        y = before
                if held not in seen:
                    seen.add(held)
                    queue.append(held)
        return False


def assign(edges: list[tuple]) -> list[int]:
    """Indices of the matching of largest sum of p, then of sim, then with the earliest pairs, exactly. Pairs are (left, right, p, sim)."""
    return Assignment(edges, _whole_weights(edges)).earliest()

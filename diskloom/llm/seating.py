"""Seats of a Pitman-Yor hierarchy: explicit tables, customers re-seated one at a time.

A *dish* is a word in one restaurant.  Its tables are kept by size, side by side in one
flat array, so that a step takes one customer from each of many dishes at once.  Every step
is the plain Gibbs step of the Chinese restaurant: a customer drawn evenly from a dish gets
up, an empty table is gone (and its customer leaves the parent), and the customer sits down
at a table with weight ``size - discount`` or at a new one (a new customer of the parent).
"""

from __future__ import annotations

import numpy as np

from .textops import ragged


class Seats:
    """Tables of many dishes, by size."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, discount: float, rng: np.random.Generator):
        """A start: so many customers at so many tables (none without customers), sizes drawn at random."""
        self.c, self.t = customers.astype(np.int64), tables.astype(np.int64)
        self.discount, self.rng = discount, rng
        self.size = np.ones(int(self.t.sum()), np.int64)
        spare = self.c - self.t
        some = np.flatnonzero(spare > 0)
        if len(some):
            first = self._first()
            at = ragged(first[some], self.t[some])
            of = np.repeat(np.arange(len(some)), self.t[some])
            share = rng.standard_gamma(1 - discount, len(at)) + 1e-300
            share /= np.bincount(of, share)[of]
            more = np.floor(share * spare[some][of]).astype(np.int64)
            self.size[at] += more
            self.size[first[some]] += spare[some] - np.bincount(of, more).astype(np.int64)

    def _first(self) -> np.ndarray:
        return np.cumsum(self.t) - self.t

    def leave(self, who: np.ndarray) -> np.ndarray:
        """One customer of each of these dishes gets up; returns whether the table was left empty."""
        low = self._first()[who]
        upto = np.cumsum(self.size)
        base = upto[low] - self.size[low]
        at = np.searchsorted(upto, base + (self.rng.random(len(who)) * self.c[who]).astype(np.int64), side="right")
        gone = self.size[at] == 1
        self.size[at] -= 1
        if gone.any():
            self.size = self.size[self.size > 0]
        self.c[who] -= 1
        self.t[who] -= gone
        return gone

    def sit(self, who: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One customer of each dish sits down; ``weight`` is that of a new table.  Returns whether one was taken."""
        seated = self.c[who] - self.discount * self.t[who]
        draw = self.rng.random(len(who)) * (seated + weight)
        new = (draw >= seated) | (self.t[who] == 0)
        low = self._first()[who]
        old = np.flatnonzero(~new)
        if len(old):
            upto = np.cumsum(self.size - self.discount)
            a = low[old]
            at = np.searchsorted(upto, upto[a] - (self.size[a] - self.discount) + draw[old], side="right")
            self.size[np.clip(at, a, a + self.t[who][old] - 1)] += 1
        fresh = np.flatnonzero(new)
        if len(fresh):
            turn = np.argsort(low[fresh] + self.t[who][fresh], kind="stable")
            self.size = np.insert(self.size, (low[fresh] + self.t[who][fresh])[turn], 1)
        self.c[who] += 1
        self.t[who] += new
        return new

    def change(self, who: np.ndarray, by: np.ndarray, weight: np.ndarray) -> None:
        """So many customers leave (below 0) or come (above 0), one after another."""
        part = Seats.__new__(Seats)
        part.c, part.t, part.discount, part.rng = self.c[who], self.t[who], self.discount, self.rng
        at = ragged(self._first()[who], part.t)
        part.size = self.size[at]
        left = by.copy()
        while len(live := np.flatnonzero(left < 0)):
            part.leave(live)
            left[live] += 1
        while len(live := np.flatnonzero(left > 0)):
            part.sit(live, weight[live])
            left[live] -= 1
        rest = np.ones(len(self.size), bool)
        rest[at] = False
        of = np.repeat(np.arange(len(self.t)), self.t)[rest]
        self.c[who], self.t[who] = part.c, part.t
        of = np.concatenate([of, np.repeat(who, part.t)])
        self.size = np.concatenate([self.size[rest], part.size])[np.argsort(of, kind="stable")]

    def alone(self, who: np.ndarray) -> np.ndarray:
        """Tables of one customer of some dishes."""
        upto = np.concatenate(([0], np.cumsum(self.size == 1)))
        low = self._first()[who]
        return upto[low + self.t[who]] - upto[low]


def first_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A start for the number of tables: customers sit down in groups that grow with those seated."""
    tables = np.minimum(customers, 1).astype(np.int64)
    seated = tables.copy()
    live = np.flatnonzero(customers > 1)
    while len(live):
        n, t, w = seated[live], tables[live], weight[live]
        group = np.minimum(np.maximum(1, n // 8), customers[live] - n)
        tables[live] = t + rng.binomial(group, w / (n - discount * t + w))
        seated[live] = n + group
        live = live[seated[live] < customers[live]]
    return tables


class Hierarchy:
    """Restaurants of two levels below a parent whose probabilities stand still.

    ``count`` has the customers of each lowest dish; ``upper`` is its dish in the middle,
    ``room`` its restaurant; ``middle`` is the restaurant of each middle dish and ``parent``
    the parent's probability of its word.  Dishes without customers are only asked for.
    """

    def __init__(self, count, upper, room, middle, parent, discounts, strengths, rng):
        self.count, self.upper, self.room, self.middle, self.parent = count, upper, room, middle, parent
        (self.d2, self.d3), (self.s2, self.s3), self.rng = discounts, strengths, rng
        self.rooms, self.middles = int(room.max()) + 1, int(middle.max()) + 1
        self.live = np.flatnonzero(count > 1)
        self.customers3 = np.bincount(room, count, minlength=self.rooms)
        tables = np.minimum(count, 1)
        self._total(tables)
        c2 = np.bincount(upper, tables, minlength=len(middle)).astype(np.int64)
        self._open(c2, np.minimum(c2, 1))
        p2 = self._middle()
        own = self.live
        few = first_tables(count[own], (self.s3 + self.d3 * self.tables3[room[own]]) * p2[upper[own]], self.d3, rng)
        self.low = Seats(count[own], few, self.d3, rng)
        tables[own] = few
        self._total(tables)
        c2 = np.bincount(upper, tables, minlength=len(middle)).astype(np.int64)
        self._open(c2, first_tables(c2, (self.s2 + self.d2 * self.tables2[middle]) * parent, self.d2, rng))

    def _total(self, tables: np.ndarray) -> None:
        self.tables3 = np.bincount(self.room, tables, minlength=self.rooms)

    def _open(self, customers: np.ndarray, tables: np.ndarray) -> None:
        self.mid = Seats(customers, tables, self.d2, self.rng)
        self.customers2 = np.bincount(self.middle, customers, minlength=self.middles)
        self.tables2 = np.bincount(self.middle, tables, minlength=self.middles)

    def _middle(self) -> np.ndarray:
        back = (self.s2 + self.d2 * self.tables2) / (self.s2 + self.customers2)
        return (self.mid.c - self.d2 * self.mid.t) / (self.s2 + self.customers2)[self.middle] + back[self.middle] * self.parent

    def round(self, turns: int = 2) -> None:
        """Every dish with two customers or more re-seats one, a random part of the dishes at a time."""
        rng = self.rng
        part = rng.integers(0, turns, len(self.live)) if turns > 1 else np.zeros(len(self.live), np.int64)
        for turn in range(turns):
            who = np.flatnonzero(part == turn)
            if not len(who):
                continue
            upper, room = self.upper[self.live[who]], self.room[self.live[who]]
            gone = self.low.leave(who)
            # The parent as it is without this customer.
            lone = np.zeros(len(who), bool)
            left = np.flatnonzero(gone)
            lone[left] = rng.random(len(left)) * self.mid.c[upper[left]] < self.mid.alone(upper[left])
            m = self.middle[upper]
            p2 = self.mid.c[upper] - gone - self.d2 * (self.mid.t[upper] - lone) + (self.s2 + self.d2 * (self.tables2[m] - lone)) * self.parent[upper]
            p2 = p2 / (self.s2 + self.customers2[m] - gone)
            new = self.low.sit(who, (self.s3 + self.d3 * (self.tables3[room] - gone)) * p2)
            change = new.astype(np.int64) - gone
            self.tables3 += np.bincount(room, change, minlength=self.rooms)
            self._follow(np.bincount(upper, change, minlength=len(self.middle)).astype(np.int64))
        part = rng.integers(0, turns, len(self.middle)) if turns > 1 else np.zeros(len(self.middle), np.int64)
        for turn in range(turns):
            who = np.flatnonzero((part == turn) & (self.mid.c > 1))
            if len(who):
                m = self.middle[who]
                gone = self.mid.leave(who)
                new = self.mid.sit(who, (self.s2 + self.d2 * (self.tables2[m] - gone)) * self.parent[who])
                self.tables2 += np.bincount(m, new.astype(np.int64) - gone, minlength=self.middles)

    def _follow(self, by: np.ndarray) -> None:
        """The middle dishes take in what has changed below."""
        who = np.flatnonzero(by)
        if not len(who):
            return
        m, before = self.middle[who], self.mid.t[who].copy()
        self.mid.change(who, by[who], (self.s2 + self.d2 * self.tables2[m]) * self.parent[who])
        self.customers2 += np.bincount(m, by[who], minlength=self.middles)
        self.tables2 += np.bincount(m, self.mid.t[who] - before, minlength=self.middles)

    def probabilities(self) -> np.ndarray:
        """Predictive probabilities of all lowest dishes, those without customers too."""
        tables = np.minimum(self.count, 1)
        tables[self.live] = self.low.t
        back = (self.s3 + self.d3 * self.tables3) / (self.s3 + self.customers3)
        return (self.count - self.d3 * tables) / (self.s3 + self.customers3)[self.room] + back[self.room] * self._middle()[self.upper]

    def hints(self) -> list[float]:
        """For both levels, the lowest first: dishes of one and of two customers, and the two sums that a strength is drawn from."""
        out: list[float] = []
        for count, customers, tables, s, d in ((self.count, self.customers3, self.tables3, self.s3, self.d3), (self.mid.c, self.customers2, self.tables2, self.s2, self.d2)):
            some = customers >= 2
            x = self.rng.beta(s + 1, customers[some] - 1)
            more = np.maximum(tables[some] - 1, 0).astype(np.int64)
            i = ragged(np.ones(len(more), np.int64), more)
            y = self.rng.random(len(i)) * (s + d * i) < s
            out += [float((count == 1).sum()), float((count == 2).sum()), float(y.sum()), float(np.log(x).sum())]
        return out

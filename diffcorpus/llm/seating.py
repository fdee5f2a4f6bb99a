"""Chinese-restaurant seating, many groups of tables at a time, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Groups up to this size draw their tables from the whole distribution at once.
EXACT = 1 << 11


class Seating:
    """Table sizes of many independent groups (one dish in one restaurant each), flat with spare slots."""

    def __init__(self, sizes: np.ndarray, tables: np.ndarray, spare: np.ndarray | int):
        room = tables + spare
        self.end = np.cumsum(room)
        self.first = self.end - room
        self.tables = tables.astype(np.int64)
        self.used = self.first + self.tables  # next free slot
        self.seats = np.zeros(int(self.end[-1]) if len(room) else 0, dtype=np.int64)
        inside = np.arange(len(sizes)) - np.repeat(np.cumsum(tables) - tables, tables)
        self.seats[np.repeat(self.first, tables) + inside] = sizes
        self.customers = self._sums()

    def _sums(self) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.seats)))
        return total[self.end] - total[self.first]

    def _pick(self, groups: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The table of a customer drawn evenly from each group."""
        total = np.cumsum(self.seats)
        before = np.where(self.first[groups] > 0, total[self.first[groups] - 1], 0)
        draw = before + (rng.random(len(groups)) * self.customers[groups]).astype(np.int64)
        return np.searchsorted(total, draw, side="right")

    def remove(self, groups: np.ndarray, rng: np.random.Generator) -> None:
        """One customer, drawn evenly, leaves each of ``groups`` (distinct, none empty)."""
        if not len(groups):
            return
        slot = self._pick(groups, rng)
        self.seats[slot] -= 1
        self.customers[groups] -= 1
        self.tables[groups] -= self.seats[slot] == 0

    def add(self, groups: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """One customer joins each of ``groups``: a new table with weight ``new``, table k with its size less ``discount``."""
        if not len(groups):
            return
        old = self.customers[groups] - discount * self.tables[groups]
        opens = (self.customers[groups] == 0) | (rng.random(len(groups)) * (new + old) < new)
        fresh = groups[opens]
        slot = np.empty(len(groups), dtype=np.int64)
        slot[opens] = self.used[fresh]
        wait = np.flatnonzero(~opens)
        while len(wait):  # a table by its size, kept with the odds that the discount leaves it
            got = self._pick(groups[wait], rng)
            slot[wait] = got
            wait = wait[rng.random(len(wait)) * self.seats[got] < discount]
        self.seats[slot] += 1
        self.used[fresh] += 1
        self.tables[fresh] += 1
        self.customers[groups] += 1

    def sizes(self) -> np.ndarray:
        return self.seats[self.seats > 0]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers: Stirling's series eight steps further on."""
    low = np.ones_like(x)
    for k in range(8):
        low *= np.where(x < 1e3, x + k, 1.0)
    y = np.where(x < 1e3, x + 8, x)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(low)


@lru_cache(maxsize=2)
def _arrangements(discount: float) -> list[np.ndarray]:
    """Of n customers, for n up to ``EXACT``: log weight of all seatings with 1 to n tables (generalised Stirling numbers)."""
    rows = [np.zeros(0), np.zeros(1)]
    for n in range(1, EXACT):
        t = np.arange(1, n + 1)
        row = np.full(n + 1, -np.inf)
        row[:-1] = rows[n] + np.log(n - discount * t)
        row[1:] = np.logaddexp(row[1:], rows[n])
        rows.append(row)
    return rows


def _chances(c: int, new: float, discount: float) -> tuple[int, np.ndarray]:
    """Least number of tables that has a chance in a group of ``c``, and the weights from there on.

    The weight of t tables is the coefficient of x ** c in
    ``(new / discount * (1 - (1 - x) ** discount)) ** t / t!``.  Cauchy's
    integral gives it to floating-point accuracy, with ``x = exp(-z)`` on a
    hyperbola round the cut z <= 0 through the saddle point of the sum over t.
    """
    low, high = np.log(1 / c), np.log(50.0)  # of z; nearer to the cut than 1 / c the saddle is no help
    for _ in range(60):
        mid = (low + high) / 2
        x = np.exp(-np.exp(mid))
        if np.log(new) + np.log(x) + (discount - 1) * np.log(-np.expm1(-np.exp(mid))) > np.log(c):
            low = mid
        else:
            high = mid
    at = np.exp(low)

    def path(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points and their direction; far from the cut the hyperbola gives way to the circle |x| = exp(-at)."""
        if at > 0.3:
            return at + 1j * u, np.ones(len(u))
        return at * (1 + np.sin(1j * u - 1)) / (1 - np.sin(1)), np.cos(1j * u - 1)

    def log_g(z: np.ndarray) -> np.ndarray:
        return np.log(1 - (-np.expm1(-z)) ** discount)

    often = new / discount * np.exp(log_g(np.array(at)))
    wide = 12 * np.sqrt(often + 1) + 12
    first = max(1, int(often - wide))
    t = np.arange(first, min(c, int(often + wide) + 1) + 1)
    steady = t * np.log(new / discount) - _lgamma(t + 1.0)
    u = np.geomspace(1e-6, np.pi if at > 0.3 else 20, 400)  # as far out as the integrand still counts
    z = path(u)[0]
    u, z = u[abs(z.imag) <= np.pi], z[abs(z.imag) <= np.pi]
    size = (often * log_g(z) + c * z).real - (often * log_g(np.array(at)) + c * at)
    u = (np.arange(256) + 0.5) * (u[size > -42][-1] / 256)
    z, slope = path(u)
    top = steady + t * log_g(np.array(at)) + c * at
    weight = np.empty(len(t))
    for k in range(0, len(t), 1 << 12):
        some = slice(k, k + (1 << 12))
        power = t[some, None] * log_g(z) + (c * z)[None] + (steady[some] - top.max())[:, None]
        weight[some] = (np.exp(power) * slope).real.sum(axis=1)
    return first, np.maximum(weight, 0)


def draw_tables(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator | np.ndarray) -> np.ndarray:
    """Numbers of tables after every customer of every group is reseated, a new table having the weight ``new``.

    The seatings of a group have the weight ``new ** tables`` times, for a table
    of s, ``(1 - discount)(2 - discount)...(s - 1 - discount)``: what single
    Gibbs moves converge to.  The number of tables is drawn from just that, for
    groups up to ``EXACT`` by their recursion, for larger ones by ``_chances``.
    ``rng`` may be one number from 0 to 1 for each group instead.
    """
    chance = rng if isinstance(rng, np.ndarray) else rng.random(len(customers))
    out = np.minimum(customers, 1).astype(np.int64)
    small = np.flatnonzero((customers > 1) & (customers <= EXACT))
    small = small[np.argsort(customers[small], kind="stable")]
    sizes, first = np.unique(customers[small], return_index=True)
    for c, a, b in zip(sizes.tolist(), first.tolist(), np.append(first[1:], len(small)).tolist()):
        t = np.arange(1, c + 1)
        step = max(1, (1 << 19) // c)
        for k in range(a, b, step):
            at = small[k : min(k + step, b)]
            weight = np.log(new[at])[:, None] * t + _arrangements(discount)[c]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (weight[:, :-1] <= (chance[at] * weight[:, -1])[:, None]).sum(axis=1)
    for k in np.flatnonzero(customers > EXACT):
        least, weight = _chances(int(customers[k]), float(new[k]), discount)
        weight = np.cumsum(weight)
        out[k] = least + min(np.searchsorted(weight, chance[k] * weight[-1], side="right"), len(weight) - 1)
    return out

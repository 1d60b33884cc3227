"""Metric-space join of sets under the Jaccard distance, inside one region that a task holds.

Pivots are sets of the region: first the most central, then each time the one farthest from those before. A pivot is compared with
all, so what it links needs no comparison among itself. The rest goes to Voronoi regions: each set belongs to its nearest pivot's,
or to a region of its own kind if all pivots are far, and is copied to every other that the triangle inequality leaves open. Regions
are joined recursively, and pieces that no longer shrink are joined exactly.
"""

from __future__ import annotations

import numpy as np

#: Most pivots of a split, one for about so many sets; and the size below which the pivots' distances are the last filter.
PIVOTS, SETS_PER_PIVOT, LEAF = 8, 16, 32
#: A split whose regions hold more than this many times the sets is not worth it.
SPREAD = 1.5
#: Allowance for rounding of distances.
EPSILON = 1e-9


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def voronoi(apart: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """For distances (pivots x sets): each set's own region, and (regions x sets) which regions it must be in.

    The last region is that of sets far from all pivots. It takes part like a pivot at a constant distance, so that sets which share
    nothing with a pivot stay out of the pivot's region. For functions that differ by ``radius`` at most between linked
    sets, one of two linked sets finds the other in its own region if each is in all regions within twice the radius of its nearest.
    """
    far = np.full((1, apart.shape[1]), 1 - 2 * radius - 3 * EPSILON)
    measured = np.vstack([apart, far])
    return measured.argmin(0), measured <= measured.min(0) + 2 * radius + EPSILON


class Region:
    """Sets, with the components that links have made so far. Shingles are numbered from the region's rarest on, and each
    set lists its own in that order."""

    def __init__(self, sets: list[np.ndarray], share: int):
        self.share, self.radius = share, 1 - share / 100
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum([0, *self.sizes])
        _, names, self.held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(self.held), np.int64)
        rank[np.argsort(self.held, kind="stable")] = np.arange(len(self.held))
        of_set = np.repeat(np.arange(len(sets)), self.sizes)
        self.members = np.sort(of_set * len(self.held) + rank[names]) - of_set * len(self.held)
        self.mark = np.zeros(len(self.held), np.int64)
        self.parent = np.arange(len(sets))
        self.prefix = self.sizes - -(-share * self.sizes // 100) + 1
        first = np.arange(len(of_set)) - self.starts[:-1][of_set] < self.prefix[of_set]
        order = np.argsort(self.members[first], kind="stable")
        self.holders = of_set[first][order]
        self.held_from = np.searchsorted(self.members[first][order], np.arange(len(self.held) + 1))

    def candidates(self, i: int) -> np.ndarray:
        """The sets whose rarest shingles, as many as a linked set may lack and one more, meet those of set i. All linked ones do."""
        own = self.members[self.starts[i] : self.starts[i] + self.prefix[i]]
        found = [self.holders[a:b] for a, b in zip(self.held_from[own], self.held_from[own + 1], strict=True) if b - a > 1]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def unite(self, i: int, others: np.ndarray) -> None:
        for j in others:
            self.parent[self.root(j)] = self.root(i)

    def distances(self, i: int, others: np.ndarray) -> np.ndarray:
        """Jaccard distances of set i to others; those near enough are linked."""
        own = self.members[self.starts[i] : self.starts[i + 1]]
        self.mark[own] = 1
        lengths = self.sizes[others]
        both = np.add.reduceat(self.mark[self.members[runs(self.starts[others], lengths)]], np.cumsum(lengths) - lengths)
        self.mark[own] = 0
        union = self.sizes[i] + lengths - both
        self.unite(i, others[100 * both >= self.share * union])
        return 1 - both / union

    def pivots(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``inside`` of some pivots, and their distances to all that is inside."""
        lengths = self.sizes[inside]
        members = self.members[runs(self.starts[inside], lengths)]
        held = np.bincount(members, minlength=len(self.held))[members]
        places, apart = [int((np.add.reduceat(held, np.cumsum(lengths) - lengths) / lengths).argmax())], []
        while True:
            apart.append(self.distances(inside[places[-1]], inside))
            nearest = np.min(apart, axis=0)
            if len(places) == min(PIVOTS, 1 + len(inside) // SETS_PER_PIVOT) or nearest.max() <= 4 * self.radius:
                return np.array(places), np.array(apart)
            places.append(int(nearest.argmax()))

    def join(self, inside: np.ndarray, native: np.ndarray) -> None:
        """Link what is near in ``inside``, as far as one of a pair is native, until what belongs together is connected."""
        todo = [(inside, native)]
        while todo:
            inside, native = todo.pop()
            roots = self.roots()[inside]
            if not native.any() or (roots == roots[0]).all():
                continue
            pivots, apart = self.pivots(inside)
            own, reached = voronoi(apart, self.radius)
            reached[:, pivots] = False
            if len(inside) <= LEAF or reached.sum() > SPREAD * len(inside):
                self.leaf(inside, native, apart)
            else:
                todo += [(inside[some], (native & (own == k))[some]) for k, some in enumerate(reached) if some.any()]

    def leaf(self, inside: np.ndarray, native: np.ndarray, apart: np.ndarray) -> None:
        """Compare each native with the candidates that size, pivots and components leave open."""
        place = np.full(len(self.sizes), -1)
        place[inside] = np.arange(len(inside))
        natives = np.zeros(len(self.sizes), bool)
        natives[inside[native]] = True
        for x, i in enumerate(inside):
            if not native[x]:
                continue
            others = self.candidates(i)
            others = others[(place[others] >= 0) & ((others > i) | ~natives[others]) & (others != i)]
            others = others[(self.sizes[others] * 100 >= self.sizes[i] * self.share) & (self.sizes[others] * self.share <= self.sizes[i] * 100)]
            if len(others):
                others = others[(np.abs(apart[:, place[others]] - apart[:, x : x + 1]) <= self.radius + EPSILON).all(0)]
            if len(others):
                others = others[self.roots()[others] != self.root(i)]
            if len(others):
                self.distances(i, others)


def connected(sets: list[np.ndarray], native: np.ndarray, share: int, united: np.ndarray | None = None) -> np.ndarray:
    """For each set the place of one that stands for its component. Pairs without a native set are not compared; ``united`` marks sets
    that are known to belong together."""
    region = Region(sets, share)
    if united is not None and united.any():
        together = np.flatnonzero(united)
        region.parent[together] = together[0]
    region.join(np.arange(len(sets)), native)
    return region.roots()

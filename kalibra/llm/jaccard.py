"""Exact Jaccard join of word-shingle sets in metric regions, down to components (operator 4).

The pairs sought have a Jaccard similarity of t percent or more, so their symmetric difference is a bounded
part of their sizes. Regions are made in steps, each exact:

1. Shells. In the metric of the symmetric difference, a set's distance to the empty pivot is its size.
   Sizes fall into shells; a set that may have a partner in a smaller shell is replicated into it (the
   window that the triangle inequality allows).
2. Signatures. In a shell at most T elements of a pair differ. The universe is split into more than T ranges
   of hashes, so a pair's sets are equal within one of them at least: each set goes to the cell of what it has
   in every range, and a cell with two sets or more is a region. (Whole sets as pivots can't do this
   step: nearly all Jaccard distances are 1, and every window would hold everything.)
3. Sketches. A range that differs costs a pair one of the elements in which it may differ. Sets carry a byte a range;
   only pairs of a region that differ in few enough bytes are tied, and what is tied together is a cluster.
   So a passage that unlike texts share ties nothing.
4. Pivots. A cluster too large for a task is a region that whole sets chosen as pivots part into Voronoi
   regions by Jaccard distance, a set a row; a set whose distance to a pivot exceeds that to its own by no more than twice
   the radius is replicated there. Sets linked to pivots make classes, and a region of one class is done. The others are
   parted again, by pivots where those shrink them and else by signatures of another split of the universe, until they fit
   a task, which joins them in the same way: pivots, windows, recursion, and counts of what is left.

What neither shrinks (sets that all differ a little more than links allow) is cut into blocks, and each pair of blocks is a task.
A task emits a spanning forest of its links (at most a row a set), never pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles, tokens
from .common import saved, spread, unused
from .components import components

#: Sets of a region joined by counting.
LEAF = 64
#: Up to so many rows (three numbers each) are broadcast to find their texts.
BROADCAST_SETS = 200_000
#: Sets of a large region that become pivots, about; rounds of parting before blocks.
PIVOTS, ROUNDS = 24, 4
_TAG = np.uint64(0xA0761D6478BD642F)


def shells(top: int) -> list[int]:
    """Least sizes of shells up to one beyond top."""
    out = [1]
    while out[-1] <= top:
        out.append(2 * out[-1])
    return out


def differ(n: int, t: int) -> int:
    """Elements in which a pair differs at most if its smaller set has n elements."""
    return (100 - t) * (n + 100 * n // t) // (100 + t)


def ranges(high: int, t: int) -> int:
    """Ranges of a shell of sets under high elements: one more than a pair differs in, and those that chance leaves empty."""
    most = differ(high - 1, t)
    empty = most * math.exp(-high / (most + 1))
    return most + 1 + math.ceil(empty + 4 * empty**0.5)


def cells(u: np.ndarray, t: int, seed: int = 0) -> np.ndarray:
    """Keys of the cells of a sorted set u; another seed splits the universe in another way.

    A pair differs in no more elements than its smaller set allows. If a set has more ranges with elements than
    that, one of them must agree, so its empty ranges need no cells (they would hold all sets alike). A set with
    fewer gives all its ranges: two such sets agree in one of all ranges, as there are more than they may differ in.
    """
    n = len(u)
    low = shells(n)
    if seed:
        u = np.sort(shingles.mix(u ^ shingles.mix(np.full(1, seed, np.uint64))))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles.mix(u ^ _TAG), dtype=np.uint64)])
    keys = []
    for k in range(len(low) - 2, -1, -1):  # n's own shell, then those that hold a smaller partner
        if 100 * (low[k + 1] - 1) < t * n and low[k + 1] <= n:
            break
        most = differ(low[k + 1] - 1, t)
        if not most:  # only equal sets, which are one here
            continue
        m = ranges(low[k + 1], t)
        cut = np.searchsorted((u >> np.uint64(32)) * np.uint64(m) >> np.uint64(32), np.arange(m + 1))
        held = cut[1:] > cut[:-1]
        key = shingles.mix((sums[cut[1:]] - sums[cut[:-1]]) ^ shingles.mix(np.arange(m, dtype=np.uint64) + np.uint64(k << 32)))
        keys.append(key[held] if held.sum() > min(most, differ(n, t)) else key)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def sketch(u: np.ndarray, t: int) -> np.ndarray:
    """A byte for each of a power of two of ranges, half as many again as a pair of this size may differ in; what equal ranges
    hold makes equal bytes. Neighbours add up to the sketch of half as many ranges."""
    bits = max(3, math.ceil(math.log2(max(1.0, 1.4 * differ(len(u), t)))))
    return np.bincount((u >> np.uint64(64 - bits)).astype(np.int64), (u & np.uint64(0xFF)).astype(float), 1 << bits).astype(np.int64).astype(np.uint8)


def tie(sizes: np.ndarray, sketches: list[np.ndarray], t: int) -> list[tuple[int, int]]:
    """Edges, a spanning forest of the places whose sketches allow a link."""
    width = np.array(list(map(len, sketches)))
    levels = sorted(set(width.tolist()))
    fold = lambda m, w: m.reshape(len(m), w, -1).sum(axis=2, dtype=np.uint8)
    # of each width: the places of sets that have it or more, and their sketches brought to it
    held = {}
    for w in levels:
        parts = [(np.flatnonzero(width == x), np.stack([s for s in sketches if len(s) == x])) for x in levels if x >= w]
        held[w] = np.concatenate([p for p, _ in parts]), np.concatenate([fold(m, w) for _, m in parts])
    seen, out = np.zeros(len(sizes), bool), []
    for first in range(len(sizes)):
        if seen[first]:
            continue
        seen[first], todo = True, [first]
        while todo:
            i = todo.pop()
            for w in levels:
                if w > width[i]:
                    break
                place, m = held[w]
                due = ~seen[place] & ((width[place] == w) | (w == width[i]))
                if not due.any():
                    continue
                j = place[due]
                same = (m[due] == fold(sketches[i][None], w)).sum(axis=1)
                low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
                new = j[(same >= w - (100 - t) * (low + high) // (100 + t)) & (100 * low >= t * high)]
                seen[new] = True
                todo += new.tolist()
                out += [(int(x), i) for x in new]
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _digest(u: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    d1, d2 = np.sum(shingles.mix(u), dtype=np.uint64, keepdims=True), np.sum(shingles.mix(u * _TAG + np.uint64(len(u))), dtype=np.uint64, keepdims=True)
    return int(_signed(d1)[0]), int(_signed(d2)[0])


def shingle_table(docs: DataFrame, k: int, t: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, d1, d2, sketch): size, digest and sketch of each row's set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, sketches = [], [], []
            for words in shingles.word_hashes(list(tokens.utf8(b.column(1)))):
                u = shingles.shingle_set(words, k)
                n.append(len(u))
                digests.append(_digest(u))
                sketches.append(sketch(u, t).tobytes() if len(u) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *[pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)], pa.array(sketches, pa.binary())], names=["doc_id", "n", "d1", "d2", "sketch"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(made, "doc_id long, n long, d1 long, d2 long, sketch binary")


class _Cells:
    """The cells of a bucket while its memberships come in. A cell with more than `most` sets is hot: its sets are given out
    at once, tied to its first, which alone is kept; so memory holds `most` sets of a cell at most."""

    def __init__(self, most: int):
        self.most, self.parts, self.hot = most, [], {}
        self.size = self.kept = 0

    def add(self, cell: np.ndarray, d: np.ndarray) -> None:
        self.parts.append((cell, d))
        self.size += len(cell)

    def settle(self) -> Iterator[tuple[int, np.ndarray]]:
        """Yields (head, sets) of hot cells; the rest is kept, each set of a cell once."""
        if not self.parts:
            return
        cell, d = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        order = np.lexsort((d, cell))
        cell, d = cell[order], d[order]
        new = np.concatenate([np.ones(min(1, len(cell)), bool), (cell[1:] != cell[:-1]) | (d[1:] != d[:-1])])
        cell, d = cell[new], d[new]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1]]))
        size = np.diff(np.append(start, len(cell)))
        keep = np.ones(len(cell), bool)
        known = np.isin(cell[start], np.array(list(self.hot), np.uint64))
        for at, n in zip(start[(size > self.most) | known], size[(size > self.most) | known], strict=True):
            head = self.hot.setdefault(int(cell[at]), int(d[at]))
            yield head, d[at : at + n]
            keep[at : at + n] = False
        self.parts = [(cell[keep], d[keep])]
        self.size = self.kept = int(keep.sum())

    def regions(self) -> Iterator[tuple[int, np.ndarray]]:
        """(least set, sets) of each other cell of two sets or more."""
        for cell, d in self.parts:
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1]]))
            size = np.diff(np.append(start, len(cell)))
            for at, n in zip(start[size > 1], size[size > 1], strict=True):
                yield int(d[at]), d[at : at + n]


def cell_regions(docs: DataFrame, k: int, t: int, most: int, seed: int = 0) -> DataFrame:
    """(head, d1, tied) from docs (region, text): the sets of each cell of two sets or more, by the cell's head; tied where the
    cell is hot. Cells with the same head make one region, so sets that agree in many ranges meet once. Sets go by d1.

    Cells are shuffled in packets, one for each bucket of cells and batch of documents: 48 bits of the cell and 16 of
    the document's place in the packet's list make 8 bytes a membership, under half of what a row would take. A task
    gives the cells of equal sets once (of those among its first million); what it repeats does no harm.
    """
    buckets = spread(docs.sparkSession)

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                names, keys, owners = [], [], []
                part = whole.slice(at, 1 << 14)
                for region, words in zip(part.column(0).to_pylist(), shingles.word_hashes(list(tokens.utf8(part.column(1)))), strict=True):
                    u = shingles.shingle_set(words, k)
                    own = _digest(u)[0]
                    if (region, own) in given:
                        continue
                    if len(given) < 1_000_000:
                        given.add((region, own))
                    key = cells(u, t, seed)
                    keys.append(shingles.mix(key ^ np.uint64(region & (1 << 64) - 1)) if region else key)
                    owners.append(np.full(len(key), len(names), np.uint64))
                    names.append(own)
                if not sum(map(len, keys)):
                    continue
                key, owner, d1 = np.concatenate(keys), np.concatenate(owners), np.array(names, np.int64)
                bucket = ((key >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int32)
                order = np.lexsort((key, bucket))
                key, owner, bucket = key[order], owner[order], bucket[order]
                held, cut = np.unique(bucket, return_index=True)
                rows = []
                for lo, hi in zip(cut, [*cut[1:], len(key)], strict=True):
                    used, place = np.unique(owner[lo:hi].astype(np.int64), return_inverse=True)
                    rows.append((d1[used].tobytes(), ((key[lo:hi] << np.uint64(16)) | place.astype(np.uint64)).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)]], names=["bucket", "sets", "members"])

    def given_out(found: list[tuple[int, np.ndarray]], tied: bool) -> pa.RecordBatch:
        head = np.repeat(np.array([h for h, _ in found], np.int64), [len(d) for _, d in found])
        rows = np.unique(np.stack([head, np.concatenate([d for _, d in found])], axis=1), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(np.full(len(rows), tied))], names=["head", "d1", "tied"])

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Cells] = {}
        for b in batches:
            for bucket, sets, members in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(members, np.uint64)
                own = held.setdefault(bucket, _Cells(most))
                own.add(x >> np.uint64(16), np.frombuffer(sets, np.int64)[(x & np.uint64(0xFFFF)).astype(np.int64)])
                if own.size > 2 * own.kept + 2_000_000:
                    yield given_out(list(own.settle()), True)
        for own in held.values():
            yield given_out(list(own.settle()), True)
            yield given_out(list(own.regions()), False)

    sent = docs.select("region", "text").mapInArrow(packets, "bucket int, sets binary, members binary")
    return sent.repartition(buckets, "bucket").mapInArrow(regions, "head long, d1 long, tied boolean")


class Forest:
    """Union of places, the least as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _common(sets: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    """Elements that each set shares with pivot."""
    flat = np.concatenate(sets)
    at = np.searchsorted(pivot, flat)
    hit = pivot[np.minimum(at, len(pivot) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *map(len, sets)])[:-1], dtype=np.int64)


def _count_links(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A matrix of which sets are linked, by the products of their columns of elements found twice or more."""
    sizes = np.array(list(map(len, sets)))
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    held = count > 1
    to, keep = np.cumsum(held) - 1, held[column]
    column, row = to[column[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, (1 << 22) // max(1, len(sets)))
    for at in range(0, int(held.sum()), width):
        i, j = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(sets), width), np.float32)
        x[row[i:j], column[i:j] - at] = 1
        common += x @ x.T
    common = common.astype(np.int64)
    return 100 * common >= t * (sizes[:, None] + sizes[None, :] - common)


def join_sets(sets: list[np.ndarray], t: int) -> Forest:
    """Links of non-empty sets, exactly, as a forest of the places in the list."""
    forest, sizes, radius = Forest(len(sets)), np.array(list(map(len, sets))), 1 - t / 100

    def region(held: np.ndarray) -> None:
        """held: places of the sets of a region. Joins all of them with each other."""
        if len({forest.root(int(i)) for i in held}) < 2:
            return
        if len(held) > LEAF:
            at = np.linspace(0, len(held) - 1, max(2, int(len(held) ** 0.5) // 2)).astype(int)
            pivots = held[np.argsort(sizes[held], kind="stable")][at]
            own, distance = [sets[i] for i in held], np.empty((len(held), len(pivots)))
            for j, p in enumerate(pivots):
                both = _common(own, sets[p])
                union = sizes[held] + sizes[p] - both
                distance[:, j] = 1 - both / union
                for i in held[100 * both >= t * union]:
                    forest.link(int(i), int(p))
            home = distance.argmin(axis=1)
            nearest = distance[np.arange(len(held)), home]
            members = []
            for j in range(len(pivots)):
                in_cell = home == j
                if in_cell.any():
                    # a partner of a set of this cell is within the radius of it: bisector and ball, with room for rounding
                    near = (distance[:, j] <= nearest + 2 * radius + 1e-9) & (distance[:, j] <= nearest[in_cell].max() + radius + 1e-9)
                    members.append(held[near | in_cell])
            if sum(len(x) ** 2 for x in members) < 0.5 * len(held) ** 2:
                for x in members:
                    region(x)
                return
        linked, seen = _count_links([sets[i] for i in held], t), np.zeros(len(held), bool)
        for i in range(len(held)):
            if not seen[i]:
                seen[i], todo = True, [i]
                while todo:
                    new = np.flatnonzero(linked[todo.pop()] & ~seen)
                    seen[new] = True
                    todo += new.tolist()
                    for j in new:
                        forest.link(int(held[i]), int(held[j]))

    if len(sets) > 1:
        region(np.arange(len(sets)))
    return forest


def _own_sets(docs: DataFrame, rows: DataFrame, few: bool, k: int, doc_id: str, text: str) -> DataFrame:
    """rows (lead, ...) with own, the bytes of the lead's sorted set."""
    extra = [c for c in rows.columns if c != "lead"]
    found = docs.select(F.col(doc_id).cast("long").alias("lead"), F.col(text).alias("text")).join(F.broadcast(rows) if few else rows.hint("shuffle_hash"), "lead")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles.shingle_set(w, k).tobytes() for w in shingles.word_hashes(list(tokens.utf8(b.column(1))))]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(own, pa.binary())], names=["lead", *extra, "own"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "lead")
    return found.select("lead", "text", *extra).mapInArrow(rebuilt, f"lead long, {kinds}, own binary")


def _join_groups(members: DataFrame, keys: list[str], t: int) -> DataFrame:
    """Links (a, b), a spanning forest, of members (keys, region, lead, own): a group of keys is a task, regions in it are joined one by one."""

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by([("region", "ascending"), ("lead", "ascending")])
        region, lead, sets = (table.column(x).to_pylist() for x in ("region", "lead", "own"))
        a, b, at = [], [], 0
        while at < len(lead):
            end = at
            while end < len(lead) and region[end] == region[at]:
                end += 1
            forest = join_sets([np.frombuffer(x, np.uint64) for x in sets[at:end]], t)
            for i in range(end - at):
                if (r := forest.root(i)) != i:
                    a.append(lead[at + i])
                    b.append(lead[at + r])
            at = end
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.select(*keys, *[c for c in ("region", "lead", "own") if c not in keys]).groupBy(*keys).applyInArrow(joined, "a long, b long")


def tied_by_sketches(regions: DataFrame, sets: DataFrame, t: int, task_bytes: int = 8 << 20) -> DataFrame:
    """(a, b) from regions (head, d1) and sets (d1, n, sketch): ties of the sets whose sketches allow a link, region by region.
    A task hangs what it ties together on the least of it, so paths are short before the first star."""
    bins = max(spread(sets.sparkSession), int((regions.join(sets, "d1").agg(F.sum(F.length("sketch") + F.lit(32))).first()[0] or 0) // task_bytes + 1))

    def near(table: pa.Table) -> pa.Table:
        table = table.sort_by([("head", "ascending"), ("d1", "ascending")])
        head, d1, n = (table.column(c).to_numpy() for c in ("head", "d1", "n"))
        sketches = [np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()]
        cuts = np.append(np.flatnonzero(np.append(True, head[1:] != head[:-1])), len(head))
        names, place = np.unique(d1, return_inverse=True)
        forest = Forest(len(names))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for i, j in tie(n[lo:hi], sketches[lo:hi], t):
                forest.link(int(place[lo + i]), int(place[lo + j]))
        root = np.array([forest.root(i) for i in range(len(names))], np.int64)
        tied = root != np.arange(len(names))
        return pa.table({"a": pa.array(names[tied]), "b": pa.array(names[root[tied]])})

    rows = regions.join(sets, "d1").select(F.pmod(F.xxhash64("head"), F.lit(bins)).alias("bin"), "head", "d1", "n", "sketch")
    return rows.groupBy("bin").applyInArrow(near, "a long, b long")


def part_by_pivots(members: DataFrame, t: int) -> DataFrame:
    """(region, lead, n, pivot, linked, near) from members (region, block, lead, n, own, is_pivot), pivots once in each block: a row
    for each pivot that the set is linked with, or whose Voronoi region or window it lies in."""
    radius = 1 - t / 100

    def dealt(table: pa.Table) -> pa.Table:
        table = table.sort_by("lead")
        flags = table.column("is_pivot").to_numpy(zero_copy_only=False)
        pivots, rows = table.filter(pa.array(flags)), table.filter(pa.array(~flags))
        out = {c: [] for c in ("lead", "n", "pivot", "linked", "near")}
        if pivots.num_rows and rows.num_rows:
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("own").to_pylist()]
            size = np.array(list(map(len, sets)))
            names = pivots.column("lead").to_numpy()
            distance, linked = np.empty((len(sets), len(names))), np.empty((len(sets), len(names)), bool)
            for j, p in enumerate(pivots.column("own").to_pylist()):
                pivot = np.frombuffer(p, np.uint64)
                both = _common(sets, pivot)
                union = size + len(pivot) - both
                distance[:, j], linked[:, j] = 1 - both / union, 100 * both >= t * union
            near = distance <= distance.min(axis=1, keepdims=True) + 2 * radius + 1e-9
            i, j = np.nonzero(near | linked)
            out = {"lead": rows.column("lead").to_numpy()[i], "n": size[i], "pivot": names[j], "linked": linked[i, j], "near": near[i, j]}
        region = table.column("region")[0].as_py()
        return pa.table({"region": pa.array([region] * len(out["lead"]), pa.int64()), **{c: pa.array(out[c], pa.bool_() if c in ("linked", "near") else pa.int64()) for c in out}})

    return members.groupBy("region", "block").applyInArrow(dealt, "region long, lead long, n long, pivot long, linked boolean, near boolean")


def near_duplicates(
    docs: DataFrame, k: int = 3, t: int = 90, doc_id: str = "doc_id", text: str = "text", task_shingles: int = 1_000_000, region_sets: int = 4096
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: documents linked when 100 * shared >= t * union of their sets.

    Words are runs of anything but ASCII white space, A-Z in lower case; a set holds the distinct windows of
    k words of the whole text, or all words as one window where there are fewer. component_id is the least
    doc_id reached by links, the document's own included. Documents with equal sets are one from the start.

    A null, empty or blank text has no shingles and links with nothing. Rows with one id are one document.
    A row without an id takes the component of its equals that have one, else none. Elements are told apart
    by 64-bit hashes, equal sets by 128 bits. t must be over 50 and at most 100. task_shingles: what a
    task holds at once (8 bytes each); region_sets: a region with more sets is tied without sketches. Neither changes the result.
    """
    if not 50 < t <= 100:
        raise ValueError("t must be over 50 and at most 100")
    sets = saved(shingle_table(docs, k, t, doc_id, text), "sets")
    leads = saved(sets.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("lead"), F.max("n").alias("n")), "leads")

    # regions of cells, and what sketches leave tied in them
    found = saved(cell_regions(docs.select(F.lit(0).cast("long").alias("region"), F.col(text).alias("text")), k, t, region_sets).groupBy("head", "d1").agg(F.max("tied").alias("tied")), "regions")
    sizes = found.groupBy("head").agg((F.count(F.lit(1)) > region_sets).alias("large")).where("large").select("head", "large")
    found = found.join(sizes, "head", "left").withColumn("tied", F.col("tied") | F.coalesce("large", F.lit(False)))
    drawn = sets.join(leads.select(F.col("lead").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"]).select("d1", "n", "sketch").dropDuplicates(["d1"])
    ties = tied_by_sketches(found.where("not tied").select("head", "d1"), drawn, t).union(found.where("tied").select(F.col("d1").alias("a"), F.col("head").alias("b")))
    rows = components(ties).withColumnRenamed("node", "d1").withColumnRenamed("component", "region").join(leads, "d1").select("region", "lead", "n")

    links = _join_regions(docs, saved(rows, "clusters"), k, t, doc_id, text, task_shingles, region_sets)
    joint = components(links).select(F.col("node").alias("lead"), "component")
    named = leads.join(joint, "lead", "left").select("d1", "d2", F.coalesce("component", "lead").alias("component_id"))
    full, empty = sets.where("n > 0"), sets.where("n = 0")
    out = full.join(named, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(empty.select("doc_id", "n", "doc_id"))


def _join_regions(docs: DataFrame, rows: DataFrame, k: int, t: int, doc_id: str, text: str, task_shingles: int, region_sets: int) -> DataFrame:
    """Links (a, b) between the leads of regions (region, lead, n), a spanning forest in all but name."""
    links = None

    def take(found: DataFrame) -> None:
        nonlocal links
        links = found if links is None else links.union(found)

    def sized(rows: DataFrame) -> tuple[DataFrame, int, int, int]:
        """rows with the weight and number of sets of their region; the weight and rows of small regions, and the number of large ones."""
        own = rows.groupBy("region").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("sets"))
        small = F.col("weight") <= task_shingles
        a = own.agg(F.sum(F.when(small, F.col("weight"))), F.sum(F.when(small, F.col("sets"))), F.count(F.when(~small, 1))).first()
        return rows.join(own, "region"), a[0] or 0, a[1] or 0, a[2]

    for turn in range(ROUNDS + 1):
        rows, weight, n_small, n_large = sized(rows)
        if n_small:
            bins = max(spread(docs.sparkSession), weight // task_shingles + 1)
            leaves = rows.where(F.col("weight") <= task_shingles).select("lead", "region", F.pmod(F.xxhash64("region"), F.lit(bins)).alias("bin"))
            take(saved(_join_groups(_own_sets(docs, leaves, n_small <= BROADCAST_SETS, k, doc_id, text), ["bin"], t), "links"))
        if not n_large:
            break
        large = rows.where(F.col("weight") > task_shingles)
        blocks = F.ceil(F.col("weight") / task_shingles).cast("int")
        if turn == ROUNDS:  # block by block: each pair of blocks is a task
            block = F.pmod(F.xxhash64("lead", F.lit("block")), blocks).cast("int")
            pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
            members = _own_sets(docs, large.select("lead", "region", pairs.alias("pairs")), False, k, doc_id, text)
            take(saved(_join_groups(members.select("region", "lead", "own", F.explode("pairs").alias("p")).select("region", "lead", "own", "p.*"), ["region", "i", "j"], t), "links"))
            break
        # pivots: a set by chance of its hash, PIVOTS of a region about and no more than a task holds; each goes to all blocks of its region
        draw = F.pmod(F.xxhash64("lead", F.lit("pivot"), F.lit(turn)), F.greatest(F.floor(F.col("sets") / PIVOTS), blocks)) == 0
        own = _own_sets(docs, large.select("lead", "region", "n", blocks.alias("blocks"), draw.alias("chosen")), False, k, doc_id, text)
        every = F.when(F.col("chosen"), F.sequence(F.lit(0), F.col("blocks") - 1))
        mine = F.struct(F.pmod(F.xxhash64("lead", F.lit("block")), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("is_pivot"))
        places = F.concat(F.array(mine), F.coalesce(F.transform(every, lambda b: F.struct(b.cast("int").alias("block"), F.lit(True).alias("is_pivot"))), F.array().cast("array<struct<block:int,is_pivot:boolean>>")))
        parted = saved(part_by_pivots(own.select("region", "lead", "n", "own", F.explode(places).alias("p")).select("region", "lead", "n", "own", "p.*"), t), "parted")
        near = parted.where("linked and lead <> pivot").select(F.col("lead").alias("a"), F.col("pivot").alias("b"))
        take(near)
        # a region whose sets are all of one class is done
        classes = components(near).select(F.col("node").alias("lead"), F.col("component").alias("class"))
        size = large.select("region", F.col("weight").alias("whole")).distinct()
        sub = parted.where("near").select("region", "pivot", "lead", "n").join(classes, "lead", "left").withColumn("class", F.coalesce("class", "lead"))
        cut = saved(sub.groupBy("region", "pivot").agg(F.sum("n").alias("w"), (F.min("class") != F.max("class")).alias("open")).where("open").select("region", "pivot", "w"), "cuts")
        shrunk = saved(cut.groupBy("region").agg(F.sum(F.pow("w", 2)).alias("work")).join(size, "region").select("region", (F.col("work") < 0.5 * F.pow("whole", 2)).alias("shrunk")), "shrunk")
        voronoi = sub.join(cut, ["region", "pivot"]).join(shrunk.where("shrunk"), "region").select(F.xxhash64("region", "pivot", F.lit(turn)).alias("region"), "lead", "n")
        # what pivots don't shrink (and a region that chance left without pivots) is parted by signatures of another split
        unparted = large.select("region", "lead", "n").join(parted.select("region").distinct(), "region", "left_anti")
        dense = saved(large.select("region", "lead", "n").join(shrunk.where("not shrunk"), "region", "left_semi").union(unparted), "dense")
        rows = voronoi
        if dense.head(1):
            texts = docs.select(F.col(doc_id).cast("long").alias("lead"), F.col(text).alias("text")).join(dense.hint("shuffle_hash"), "lead")
            again = cell_regions(texts.select("region", "text"), k, t, region_sets, turn + 1).select(F.xxhash64("head", F.lit(turn)).alias("region"), "d1").distinct()
            # written, as heads of cells too large to hold depend on what comes first: computed twice, they could differ
            again = saved(again.join(_leads_of(texts, k), "d1").join(classes, "lead", "left").withColumn("class", F.coalesce("class", "lead")), "again")
            open_ = again.groupBy("region").agg((F.min("class") != F.max("class")).alias("open")).where("open")
            rows = rows.union(again.join(open_, "region", "left_semi").select("region", "lead", "n"))
        rows = saved(rows, "regions")
    if links is None:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    return links


def _leads_of(texts: DataFrame, k: int) -> DataFrame:
    """(d1, lead, n) of rows (region, lead, n, text), once."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1 = [_digest(shingles.shingle_set(w, k))[0] for w in shingles.word_hashes(list(tokens.utf8(b.column(2))))]
            yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), b.column(0), b.column(1)], names=["d1", "lead", "n"])

    return texts.select("lead", "n", "text").mapInArrow(made, "d1 long, lead long, n long").distinct()


def keep_one(docs: DataFrame, k: int = 5, t: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near duplicates, the one with the least id, with the columns of docs.

    Documents without words stay, as does every row without an id.
    """
    (gone_,) = unused(docs, "__gone")
    gone = near_duplicates(docs, k, t, doc_id, text).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_)).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col(doc_id).cast("long") == F.col(gone_), "left_anti")

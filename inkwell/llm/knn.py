"""The k most similar vectors of every vector (problem 1).

Method: cross-polytope hashing. A vector, less the mean of its group, is turned by fast
pseudo-rotations (three rounds of random signs and a Hadamard transform); its cells are the
signed axes, or sums of one axis each of two rotations, that lie nearest. Several tables
with multiprobe collect candidates, which are compared by their cosines. One path serves
every size:

1. Where to send a vector. The first table has `SPREAD` cells (more cells and probes where a
   cell would hold over `most` / 2 on average, fewer cells where under `FEW`), and a vector
   goes to its `probes` nearest ones. A cell that still holds more than `most`, as a crowd
   does, is divided by a rotation of its own around its own mean, and so on: a tree of
   cells, which a count and a sum of each cell decide.
2. What to compare. Inside a cell, in one task, `tables` further tables are laid around the
   cell's own mean; every vector is entered in its `entered` nearest fine cells and looked
   up in its `asked` nearest ones. A fine cell into which a crowd has fallen is solved the
   same way again. There are so many fine cells that a vector meets about
   `WORK * (n / 11,000) ** 0.3` others of a cell of n vectors: candidates grow with the
   0.3th power of the rows; copies (what is shuffled) are 7 up to 36 million rows.
3. Lists of all cells are merged to the k best; `exact` takes their cosines anew from the
   vectors as given.

Equal vectors travel and are compared once, with all their ids, so that copies under other
ids, however many, neither weigh on a task nor escape. Vectors that no rotation parts (more
than `most` of them in one cell, which are not equal) are compared in pairs of blocks.
What is shuffled is the unit vector in 16-bit steps (cosines keep four to five digits).

Defined results: a vector that is null, not of `dim` numbers, all zero, or with a NaN or
infinite number is in no pair; lengths don't matter; rows with the same id are one vector
(exact copies), and no vector is its own neighbour; of equal cosines the smaller id comes
first; fewer than k others give fewer rows; an empty table gives none; further columns are
ignored. Null ids are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.sources.tables import shared_dir

#: Cells of the first table; vectors that one task compares with each other (half
#: as many on average at most: 450 MB with the best found so far).
SPREAD, MOST = 128, 4_000_000
#: Vectors on average in a cell of a small table, which has fewer cells instead of emptier ones.
FEW = 1_000
#: How probes grow with the cells beyond SPREAD.
PROBES_GROW = 0.43
#: Cells of a divided cell that a vector goes to.
DIVIDED = 5
#: Others that a vector meets in a cell of 11,000, and how that grows with the cell.
WORK, WORK_AT, WORK_GROWS = 4_500, 11_000, 0.3
#: Queries multiplied at once, products held at most, columns of a group, rows hashed at once.
STRIPE, STRIPE_CELLS, WIDE, HASHED = 256, 16_000_000, 8, 16_384
STEPS = 32_767.0
#: Nothing, where a packed (distance, place) is expected; steps of a distance.
NOTHING, FINE = np.iinfo(np.int64).max, float(1 << 30)
LOW = np.int64(0xFFFFFFFF)


def hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / math.sqrt(n)


def rotation(dim: int, seed: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard; dim is padded to a power of two."""
    n = 1 << max(0, (dim - 1).bit_length())
    rng = np.random.default_rng(seed)
    h, out = hadamard(n), np.eye(n)
    for _ in range(3):
        out = (out * rng.choice([-1.0, 1.0], n)) @ h
    return out[:dim].astype(np.float32)


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the usable vectors, their unit vectors)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    ok = (lengths == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ok)
    values = column.values.to_numpy(zero_copy_only=False)
    first = column.offsets.to_numpy()[at]
    x = values[first[:, None] + np.arange(dim)].astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        fine = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
    return at[fine], (x[fine] / norm[fine, None]).astype(np.float32)


def largest(s: np.ndarray, c: int) -> np.ndarray:
    """Columns of the c largest of each row, in any order."""
    c = min(c, s.shape[1])
    return np.argpartition(-s, c - 1, axis=1)[:, :c]


class Cells:
    """A table of about `count` cells around a centre: signed axes of one rotation, or, if it
    has too few, pairs of signed axes of two."""

    def __init__(self, centre: np.ndarray, count: int, seed: int):
        dim = len(centre)
        self.centre = centre.astype(np.float32)
        self.first = rotation(dim, seed)
        axes = self.first.shape[1]
        if count <= 2 * axes:
            self.first, self.second = self.first[:, : max(1, count // 2)], None
        else:
            h = min(axes, -(-count // (4 * axes)))
            self.first = self.first[:, : min(axes, max(1, round(count / (4 * h))))]
            self.second = rotation(dim, seed + 500_009)[:, :h]
        self.count = 2 * self.first.shape[1] * (2 * self.second.shape[1] if self.second is not None else 1)

    def of(self, x: np.ndarray, c: int) -> np.ndarray:
        """The c nearest cells of each vector, nearest first; fewer if there are fewer."""
        return np.concatenate([self._of(x[a : a + HASHED], c) for a in range(0, len(x), HASHED)]) if len(x) else np.zeros((0, min(c, self.count)), np.int64)

    def _of(self, x: np.ndarray, c: int) -> np.ndarray:
        y = x - self.centre
        s = y @ self.first
        s = np.concatenate([s, -s], 1)
        cell = np.broadcast_to(np.arange(s.shape[1]), s.shape)
        if self.second is not None:
            # The c best sums of two take both from the c best of their own rotation.
            w = y @ self.second
            w = np.concatenate([w, -w], 1)
            a, b = largest(s, c), largest(w, c)
            width = w.shape[1]
            s = (np.take_along_axis(s, a, 1)[:, :, None] + np.take_along_axis(w, b, 1)[:, None, :]).reshape(len(x), -1)
            cell = (a[:, :, None] * width + b[:, None, :]).reshape(len(x), -1)
        best = largest(s, c)
        order = np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable")
        return np.take_along_axis(cell, np.take_along_axis(best, order, 1), 1)


class Tree:
    """Cells of cells: which leaves a vector is sent to."""

    def __init__(self, root: Cells, probes: int):
        self.nodes: list[tuple[Cells, int, np.ndarray]] = [(root, probes, np.arange(root.count))]
        self.leaves = root.count

    def divide(self, leaf: int, cells: Cells, probes: int) -> None:
        """The leaf becomes a node; its first cell takes over its number."""
        for _, _, child in self.nodes:
            child[child == leaf] = -len(self.nodes) - 1
        self.nodes.append((cells, probes, np.append([leaf], np.arange(self.leaves, self.leaves + cells.count - 1))))
        self.leaves += cells.count - 1

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the leaves of every vector."""
        waiting = {0: [np.arange(len(x))]}
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for number, (cells, probes, child) in enumerate(self.nodes):
            if number not in waiting:
                continue
            at = np.concatenate(waiting.pop(number))
            near = cells.of(x[at], probes)
            row, to = np.repeat(at, near.shape[1]), child[near.ravel()]
            rows.append(row[to >= 0])
            leaves.append(to[to >= 0])
            for below in np.unique(to[to < 0]):
                waiting.setdefault(int(-below - 1), []).append(row[to == below])
        return np.concatenate(rows), np.concatenate(leaves)


def classes(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each different vector, number of every row's vector)."""
    if not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.ascontiguousarray(q).view(np.uint16).astype(np.uint64)
    odd = np.random.default_rng(7).integers(1, 1 << 63, q.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        h = (words * odd).sum(1, dtype=np.uint64)
        h ^= h >> np.uint64(29)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    if len(first) < len(q) and (q[first[number]] != q).any():  # two vectors with one hash
        whole = np.ascontiguousarray(q).view(np.dtype((np.void, q.itemsize * q.shape[1]))).ravel()
        _, first, number = np.unique(whole, return_index=True, return_inverse=True)
    return first, number


def packed(score: np.ndarray, who: np.ndarray) -> np.ndarray:
    """(score, place below 2^32) as one number: a better score, then a smaller place first."""
    return (np.rint((1.0 - np.clip(score.astype(np.float64), -1, 1)) * FINE).astype(np.int64) << 32) | who


class Best:
    """The k best found so far of n rows, packed."""

    def __init__(self, n: int, k: int):
        self.k, self.kept = k, np.full((n, k), NOTHING, np.int64)

    def least(self, rows: np.ndarray) -> np.ndarray:
        """A score that a further one must reach."""
        last = self.kept[rows, -1]
        return np.where(last == NOTHING, -2.0, 1.0 - (last >> 32) / FINE - 1e-6).astype(np.float32)

    def add(self, rows: np.ndarray, new: np.ndarray) -> None:
        """new: packed finds, a line for each of the (different) rows."""
        both = np.concatenate([self.kept[rows], new], 1)
        turned = (both & LOW) << 32 | (both >> 32)  # by place, so that the same place found twice stands together
        turned[both == NOTHING] = NOTHING
        turned.sort(1)
        again = np.zeros(turned.shape, bool)
        again[:, 1:] = (turned[:, 1:] >> 32) == (turned[:, :-1] >> 32)
        both = (turned & LOW) << 32 | (turned >> 32)
        both[again | (turned == NOTHING)] = NOTHING
        both.sort(1)
        self.kept[rows] = both[:, : self.k]


class Vectors:
    """Unit vectors in 16-bit steps, given as floats for the rows asked for."""

    def __init__(self, q: np.ndarray):
        self.q, self.scale = q, np.empty((len(q), 1), np.float32)
        for a in range(0, len(q), HASHED):
            x = q[a : a + HASHED].astype(np.float32)
            self.scale[a : a + HASHED, 0] = 1 / np.sqrt(np.einsum("ij,ij->i", x, x))

    def of(self, rows: np.ndarray) -> np.ndarray:
        return self.q[rows] * self.scale[rows]


def meet(q: Vectors, asking: np.ndarray, there: np.ndarray, best: Best, same: bool = True) -> None:
    """Compares the rows `asking` of q with the rows `there`, both ascending; same: those that
    ask are among the others. A stripe of queries is multiplied with all rows; the k-th best
    of the maxima over groups of columns bounds the k-th best from below, and only groups that
    reach the bound, and the k-th found before, are looked into."""
    k, n = best.k, len(there)
    if not len(asking) or n <= same:
        return
    groups = -(-n // WIDE)
    x = q.of(there)
    table = np.zeros((groups * WIDE, x.shape[1]), np.float32)
    table[:n] = x
    table = table.T
    stripe = max(16, min(STRIPE, STRIPE_CELLS // (groups * WIDE)))
    own = np.searchsorted(there, asking) if same else None
    for a in range(0, len(asking), stripe):
        rows = asking[a : a + stripe]
        m = len(rows)
        s = (x[own[a : a + stripe]] if same else q.of(rows)) @ table
        s[:, n:] = -3
        if same:
            s[np.arange(m), own[a : a + stripe]] = -3
        g = s.reshape(m, WIDE, groups).max(1)
        bound = best.least(rows)
        if groups > k:
            bound = np.maximum(bound, np.partition(g, groups - k, axis=1)[:, groups - k])
        row, group = np.nonzero(g >= bound[:, None])
        if not len(row):
            continue
        cols = group[:, None] + np.arange(WIDE) * groups
        values = s.ravel()[row[:, None] * (groups * WIDE) + cols]
        at, which = np.nonzero(values >= bound[row][:, None])
        row, col, value = row[at], cols[at, which], values[at, which]
        key = packed(value, there[col])
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(m))[row]
        keep = place < k
        row, key, place = row[keep], key[keep], place[keep]
        found, line = np.unique(row, return_inverse=True)
        new = np.full((len(found), k), NOTHING, np.int64)
        new[line, place] = key
        best.add(rows[found], new)


def work(n: int) -> float:
    """Others that a vector is to meet among n."""
    return WORK * (n / WORK_AT) ** WORK_GROWS


def solve(q: Vectors, rows: np.ndarray, best: Best, tables: int, entered: int, asked: int, seed: int) -> None:
    """Finds neighbours among the rows of q (ascending) by tables of fine cells."""
    n = len(rows)
    count = int(tables * entered * asked * n / work(max(n, 1)))
    if n <= work(n) or count <= entered:
        meet(q, rows, rows, best)
        return
    centre = sum(q.of(rows[a : a + HASHED]).sum(0, dtype=np.float64) for a in range(0, n, HASHED)) / n
    for t in range(tables):
        cells = Cells(centre, count, seed + 31 * t)
        near = np.concatenate([cells.of(q.of(rows[a : a + HASHED]), entered).astype(np.int32) for a in range(0, n, HASHED)])
        order = np.argsort(near.ravel(), kind="stable")
        edges = np.searchsorted(near.ravel()[order], np.arange(cells.count + 1))
        for c in range(cells.count):
            at = order[edges[c] : edges[c + 1]]
            if len(at) < 2:
                continue
            there, probe = at // near.shape[1], at % near.shape[1]
            asking = there[probe < asked]
            if not len(asking):
                continue
            # A crowd lies in few cells; around its own mean it can be parted.
            if len(asking) * len(there) > 16 * work(n) ** 2 and len(there) < 0.7 * n:
                solve(q, rows[there], best, tables, entered, asked, seed + 7919 * (c + 1) + t)
            else:
                meet(q, rows[asking], rows[there], best)


def spread_out(ids: np.ndarray, number: np.ndarray, best: Best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From neighbours among different vectors to neighbours of ids, flat (id, other, score),
    k for each id. ids ascend within a vector; number: the vector of each id, ascending."""
    k = best.k
    kept = best.kept
    at, column = np.nonzero(kept != NOTHING)
    other, score = kept[at, column] & LOW, 1.0 - (kept[at, column] >> 32) / FINE
    size = np.bincount(number, minlength=len(kept))
    begin = np.cumsum(size) - size
    if (size == 1).all():
        return ids[at], ids[other], score.astype(np.float32)
    take = np.minimum(size[other], k)
    step = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
    cls, who, score = np.repeat(at, take), ids[np.repeat(begin[other], take) + step], np.repeat(score, take)
    # A vector with several ids: they are each other's nearest.
    several = np.flatnonzero(size > 1)
    take = np.minimum(size[several], k + 1)
    step = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
    cls, who, score = np.append(cls, np.repeat(several, take)), np.append(who, ids[np.repeat(begin[several], take) + step]), np.append(score, np.ones(len(step)))
    order = np.lexsort((who, -score, cls))
    cls, who, score = cls[order], who[order], score[order]
    place = np.arange(len(cls)) - np.searchsorted(cls, np.arange(len(kept)))[cls]
    keep = place <= k
    cls, who, score = cls[keep], who[keep], score[keep]
    length = np.bincount(cls, minlength=len(kept))
    first = np.cumsum(length) - length
    n = length[number]
    line = np.repeat(np.arange(len(ids)), n)
    entry = np.repeat(first[number], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    other = who[entry] != ids[line]
    line, entry = line[other], entry[other]
    place = np.arange(len(line)) - np.searchsorted(line, np.arange(len(ids)))[line]
    keep = place < k
    return ids[line[keep]], who[entry[keep]], score[entry[keep]].astype(np.float32)


def merged(ids: np.ndarray, who: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat finds of many lists to the k best different ones of each id, with places."""
    names, row = np.unique(ids, return_inverse=True)
    others, place = np.unique(who, return_inverse=True)
    key = row.astype(np.int64) << 32 | place
    order = np.argsort(key)
    key, score = key[order], score[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key, score = key[new], score[new]
    down = (np.rint((1.0 - np.clip(score.astype(np.float64), -1, 1)) * FINE)).astype(np.int64)
    order = np.argsort((key >> 32) << 32 | down, kind="stable")  # equal ones stay in the order of `who`
    row, other, score = (key >> 32)[order], (key & LOW)[order], score[order]
    at = np.arange(len(row)) - np.searchsorted(row, np.arange(len(names)))[row]
    keep = at < k
    return names[row[keep]], others[other[keep]], score[keep], at[keep]


def pack(ids: np.ndarray, who: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each id (rows of an id stand together): its neighbours and scores as bytes."""
    edges = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids))
    wide = bool(len(who)) and bool((np.abs(who) >= 2**31).any())
    kind = np.dtype([("who", "<i8" if wide else "<i4"), ("score", "<f4")])
    for b in range(0, len(edges) - 1, 50_000):
        e = edges[b : b + 50_001]
        body = np.empty(e[-1] - e[0], kind)
        body["who"], body["score"] = who[e[0] : e[-1]], score[e[0] : e[-1]]
        offsets = ((e - e[0]) * kind.itemsize).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(e) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(ids[e[:-1]]), pa.array(np.full(len(e) - 1, wide)), found], names=["id", "wide", "found"])


def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What pack() put together, flat again, in the order of the rows."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    wide = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
    body = batch.column(2)
    off = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    raw = np.frombuffer(body.buffers()[2], np.uint8) if body.buffers()[2] is not None else np.zeros(0, np.uint8)
    out = []
    for is_wide in (False, True):
        rows = np.flatnonzero(wide == is_wide)
        if not len(rows):
            continue
        kind = np.dtype([("who", "<i8" if is_wide else "<i4"), ("score", "<f4")])
        length = off[rows + 1] - off[rows]
        take = np.repeat(off[rows] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        flat = raw[take].view(kind)
        out.append((np.repeat(ids[rows], length // kind.itemsize), flat["who"].astype(np.int64), flat["score"].copy(), np.repeat(rows, length // kind.itemsize)))
    ids, who, score, row = (np.concatenate(v) for v in zip(*out))
    order = np.argsort(row, kind="stable")
    return ids[order], who[order], score[order]


def first_table(rows: int, probes: int, most: int) -> tuple[int, int]:
    """(cells, probes): cells hold `most` / 2 vectors on average at most, so that only crowds
    exceed `most`; more cells take more probes, so that neighbours still share one."""
    if probes * rows / FEW <= SPREAD:
        count = int(probes * rows / FEW)
        return (count, probes) if count > probes else (1, probes)
    count, p, before = float(SPREAD), probes, 0
    while p != before:
        before = p
        count = max(float(SPREAD), 2 * p * rows / most)
        p = max(before, math.ceil(probes * (count / SPREAD) ** PROBES_GROW))
    return int(count), p


def planted(source: DataFrame, dim: int, probes: int, most: int, seed: int) -> tuple[Tree, np.ndarray] | None:
    """(tree, vectors in each leaf); None without usable vectors. A pass over the vectors for
    each level: a count and a sum of every leaf come to the driver, never rows."""

    def measure(place) -> tuple[np.ndarray, np.ndarray]:
        leaves, of = place

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(leaves, np.int64), np.zeros((leaves, dim))
            for batch in batches:
                _, x = unit_rows(batch.column(1), dim)
                x = x[classes(np.rint(x * STEPS).astype("<i2"))[0]]
                row, leaf = of(x)
                order = np.argsort(leaf, kind="stable")
                row, leaf = row[order], leaf[order]
                at = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])) if len(leaf) else leaf
                if len(at):
                    n[leaf[at]] += np.diff(np.append(at, len(leaf)))
                    total[leaf[at]] += np.add.reduceat(x[row], at, axis=0, dtype=np.float64)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["leaf", "n", "total"])

        got = source.mapInArrow(run, "leaf long, n long, total array<double>").groupBy("leaf").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)))
        n, total = np.zeros(leaves, np.int64), np.zeros((leaves, dim))
        for r in got.toLocalIterator():
            n[r.leaf], total[r.leaf] = r.n, [r[f"t{i}"] for i in range(dim)]
        return n, total

    n, total = measure((1, lambda x: (np.arange(len(x)), np.zeros(len(x), np.int64))))
    if not n[0]:
        return None
    count, probes = first_table(int(n[0]), probes, most)
    tree = Tree(Cells(total[0] / n[0], count, seed), probes)
    whole: set[int] = set()  # leaves that no rotation parts
    while True:
        n, total = measure((tree.leaves, tree.of))
        large = [c for c in np.flatnonzero(n > most).tolist() if c not in whole]
        if not large:
            return tree, n
        before = {}
        for c in large:
            first = tree.leaves
            # No more cells than it takes, so that neighbours still share one.
            tree.divide(c, Cells(total[c] / n[c], max(16, int(2 * DIVIDED * n[c] / most)), seed + 1_000 + c), DIVIDED)
            before[c] = [c, *range(first, tree.leaves)], n[c]
        after, _ = measure((tree.leaves, tree.of))
        for own, size in before.values():
            if after[own].max() > 0.7 * size:
                whole.update(c for c in own if after[c] > most)


def nearest(
    df: DataFrame,
    id_col: str = "seg_id",
    vec_col: str = "vec",
    k: int = 10,
    dim: int = 64,
    probes: int = 7,
    tables: int = 2,
    entered: int = 12,
    asked: int = 2,
    seed: int = 11,
    most: int = MOST,
) -> DataFrame:
    """(id, neighbour, rank, cosine): the k most similar others of every usable vector.

    Recall against brute force is in the README. cosine is that of the 16-bit unit vectors;
    see exact().
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    grown = planted(source, dim, probes, most, seed)
    if grown is None:
        return spark.createDataFrame([], "id bigint, neighbour bigint, rank int, cosine double")
    tree, size = grown
    # Groups: a leaf, or a pair of blocks of a leaf that nothing parts; each is one task's.
    cut = np.maximum(1, -(-size // most)).astype(np.int64)
    first_group = np.concatenate([[0], np.cumsum(cut * (cut + 1) // 2)])
    weight = np.empty(first_group[-1])
    for c in range(tree.leaves):
        part = float(size[c]) / float(cut[c])
        weight[first_group[c] : first_group[c + 1]] = part * (min(part, work(part)) + 500) if part else 0.0
    shuffled = int((size * cut).sum()) * (2 * dim + 24)
    tasks = int(min(len(weight), max(int(spark.conf.get("spark.sql.shuffle.partitions")), shuffled >> 26)))
    load, task_of = np.zeros(tasks), np.zeros(len(weight), np.int64)
    for g in np.argsort(-weight):
        task_of[g] = t = int(load.argmin())
        load[t] += weight[g]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = unit_rows(batch.column(1), dim)
            if not len(at):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            q = np.rint(x * STEPS).astype("<i2")
            first, number = classes(q)
            order = np.lexsort((ids, number))
            edges = np.append(np.searchsorted(number[order], np.arange(len(first))), len(order))
            names = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edges * 8).astype(np.int32).tobytes()), pa.py_buffer(ids[order].astype("<i8").tobytes())])
            who, c = tree.of(x[first])
            n = cut[c]
            mixed = (q[first].astype(np.int64) * np.arange(1, 2 * dim, 2)).sum(1).astype(np.uint64)
            mine = ((mixed[who] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
            # With n blocks a vector goes to the groups (mine, j) of all j.
            other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            who, c, mine, n = (np.repeat(v, n) for v in (who, c, mine, n))
            lo, hi = np.minimum(mine, other), np.maximum(mine, other)
            group = first_group[c] + hi * (hi + 1) // 2 + lo
            # 0: a block with itself; 1 and 2: the lower and the higher block of a pair.
            side = np.where(lo == hi, 0, np.where(mine == lo, 1, 2))
            body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * dim), len(who), [None, pa.py_buffer(np.ascontiguousarray(q[first][who]).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(task_of[group].astype(np.int32)), pa.array((group * 4 + side).astype(np.int64)), names.take(pa.array(who)), body], names=["task", "place", "ids", "q"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        current, waiting = -1, 0

        def finish() -> None:
            nonlocal waiting
            if not held:
                return
            side, ids, of, q = [], [], [], []
            seen = 0
            for s, i, n, v in held:
                side.append(np.repeat(s, n))
                ids.append(i)
                of.append(np.repeat(np.arange(seen, seen + len(n)), n))
                q.append(v)
                seen += len(n)
            held.clear()
            side, ids, of, q = (np.concatenate(v) for v in (side, ids, of, q))
            first, number = classes(q)
            ids, one = np.unique(ids, return_index=True)  # copies of a row
            number, side = number[of[one]], side[one]
            # Vectors in the order of their smallest ids, so that ties fall to those.
            used, smallest = np.unique(number, return_index=True)
            order = np.argsort(smallest)
            rank = np.full(len(first), -1)
            rank[used[order]] = np.arange(len(used))
            q = q[first[used[order]]]
            number = rank[number]
            by = np.lexsort((ids, number))
            ids, number, side = ids[by], number[by], side[by]
            best, q = Best(len(q), k), Vectors(q)
            if (side == 0).all():
                solve(q, np.arange(len(best.kept)), best, tables, entered, asked, seed + 17 + current)
            else:
                mine = side[np.searchsorted(number, np.arange(len(best.kept)))]
                low, high = np.flatnonzero(mine == 1), np.flatnonzero(mine == 2)
                meet(q, low, high, best, same=False)
                meet(q, high, low, best, same=False)
            got = spread_out(ids, number, best)
            done.append(got)
            waiting += len(got[0])

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if not waiting:
                return
            ids, who, score, _ = merged(*(np.concatenate(v) for v in zip(*done)), k)
            done.clear()
            waiting = 0
            yield from pack(ids, who, score)

        for batch in batches:
            place = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(place):
                continue
            flat = []
            for column in (batch.column(2), batch.column(3)):
                off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                flat.append((off, column.buffers()[2]))
            (at, names), (off, body) = flat
            q = np.frombuffer(body, "<i2", count=(off[-1] - off[0]) // 2, offset=int(off[0])).reshape(-1, dim)
            ids = np.frombuffer(names, "<i8", count=(at[-1] - at[0]) // 8, offset=int(at[0]))
            at = (at - at[0]) // 8
            group = place >> 2
            edges = np.flatnonzero(np.diff(group)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(group)]):
                if group[a] != current:
                    finish()
                    if waiting > 4_000_000:
                        yield from emit()
                    current = int(group[a])
                held.append((place[a:b] & 3, ids[at[a] : at[b]].copy(), np.diff(at[a : b + 1]), q[a:b].copy()))
        finish()
        yield from emit()

    spread_rows = source.mapInArrow(spread, "task int, place bigint, ids binary, q binary")
    placed = spread_rows.repartitionById(tasks, F.col("task")).sortWithinPartitions("place")
    lists = placed.mapInArrow(search, "id bigint, wide boolean, found binary")

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            ids, who, score = (np.concatenate(v) for v in zip(*held))
            held.clear()
            if not last:  # the last id may go on in the next batch
                more = ids == ids[-1]
                held.append((ids[more], who[more], score[more]))
                ids, who, score = ids[~more], who[~more], score[~more]
            ids, who, score, place = merged(ids, who, score, k)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(who), pa.array((place + 1).astype(np.int32)), pa.array(score.astype(np.float64))], names=["id", "neighbour", "rank", "cosine"])

        for batch in batches:
            if batch.num_rows:
                held.append(unpack(batch))
                yield from emit(False)
        yield from emit(True)

    return lists.repartition(F.col("id")).sortWithinPartitions("id").mapInArrow(best_of, "id bigint, neighbour bigint, rank int, cosine double")


def exact(pairs: DataFrame, df: DataFrame, id_col: str = "seg_id", vec_col: str = "vec") -> DataFrame:
    """pairs (id, neighbour, ...) with `cosine` taken anew from the vectors of df as given, in
    double precision; a join of the vectors for each side."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id is not null and vec is not null").groupBy("id").agg(F.first("vec").alias("vec"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    both = pairs.drop("cosine").join(rows.select("id", F.col("vec").alias("a")), "id").join(rows.select(F.col("id").alias("neighbour"), F.col("vec").alias("b")), "neighbour")
    return both.withColumn("cosine", dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))).drop("a", "b")


def reranked(found: DataFrame, df: DataFrame, id_col: str = "seg_id", vec_col: str = "vec") -> DataFrame:
    """nearest() with exact cosines, ranked by them."""
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return exact(found, df, id_col, vec_col).withColumn("rank", F.row_number().over(w)).select("id", "neighbour", "rank", "cosine")


#: Pairs whose 16-bit cosine lies this near the bound are decided by their vectors as given;
#: pairs of which so many at most are sent to the vectors instead of meeting them by a shuffle.
NEAR, SENT = 1e-4, 50_000


def close_pairs(found: DataFrame, df: DataFrame, least: float = 0.95, id_col: str = "seg_id", vec_col: str = "vec") -> DataFrame:
    """(a, b), a < b, each once: the pairs of nearest() whose cosine is `least` or more, exactly.

    A pair within NEAR of the bound (five times what 16 bits can be wrong) is decided by the
    float vectors. These few are laid down and counted; up to SENT of them are broadcast,
    more meet the vectors by a shuffle.
    """
    spark, folder = found.sparkSession, shared_dir(found.sparkSession)
    pairs = found.where(F.col("cosine") >= least - NEAR).select(F.least("id", "neighbour").alias("id"), F.greatest("id", "neighbour").alias("neighbour"), (F.col("cosine") >= least + NEAR).alias("sure"))
    pairs.write.parquet(f"{folder}/pairs")
    pairs = spark.read.schema("id bigint, neighbour bigint, sure boolean").parquet(f"{folder}/pairs")
    unsure = pairs.where("not sure").select("id", "neighbour").distinct()
    if unsure.count() <= SENT:
        names = F.broadcast(unsure.select("id").union(unsure.select("neighbour")).distinct())
        df = df.join(names.withColumnRenamed("id", id_col), id_col, "left_semi")
    decided = exact(unsure, df, id_col, vec_col).where(F.col("cosine") >= least)
    return pairs.where("sure").select("id", "neighbour").unionByName(decided.select("id", "neighbour")).distinct().toDF("a", "b")

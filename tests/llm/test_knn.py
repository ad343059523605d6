import numpy as np
import pytest

from inkwell.llm import knn
from inkwell.llm.knn import STEPS, Best, Cells, Tree, Vectors, close_pairs, exact, meet, nearest, reranked, solve


def brute(x, ids, k):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, -row))[:k]] for i, row in zip(ids, s)}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def steps(x):
    return np.rint(x / np.linalg.norm(x, axis=1)[:, None] * STEPS).astype("<i2")


@pytest.mark.parametrize("most", [2_000_000, 250, 100])
def test_recall_with_divided_and_cut_cells(spark, most):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 64))
    x = centre[rng.integers(0, 40, 1500)] + 0.9 * rng.normal(size=(1500, 64))
    x[:500] = x[0] + 0.2 * rng.normal(size=(500, 64))  # a crowded region
    ids = np.arange(1500) * 3 + 2**33
    df = spark.createDataFrame([(int(i), v.astype("float32").tolist(), 1) for i, v in zip(ids, x)], "seg_id long, vec array<float>, id int").repartition(4)
    true = brute(x.astype(np.float32), ids, 10)
    got = found(nearest(df, most=most))
    recall = np.mean([len(set(got[i]) & set(true[i])) / 10 for i in true])
    assert len(got) == 1500 and recall > 0.9, recall


def test_unusable_vectors_copies_and_small_tables(spark):
    nan = float("nan")
    v = [1.0] + [0.0] * 63
    near = [1.0, 0.1] + [0.0] * 62
    far = [0.0, 0.0, 1.0] + [0.0] * 61
    rows = [(1, v), (1, v), (2, [5 * a for a in near]), (3, None), (4, []), (5, [0.0] * 64), (6, [nan] * 64), (7, [1.0] * 32), (8, far), (None, v)]
    df = spark.createDataFrame(rows, "seg_id long, vec array<float>")
    out = nearest(df)
    assert found(out)[1] == [2] + ([8] if 8 in found(out)[1] else [])
    assert sorted(map(tuple, close_pairs(out, df).collect())) == [(1, 2)]
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.where("seg_id = 3")).count() == 0
    assert close_pairs(nearest(df.limit(0)), df).count() == 0


def test_equal_vectors_under_many_ids(spark):
    """A third of the rows have one vector: each is the nearest of the others, smaller ids first."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 64))
    x[::3] = x[0]
    x[1] = x[0] + 0.05 * rng.normal(size=64)
    df = spark.createDataFrame([(i, v.astype("float32").tolist()) for i, v in enumerate(x)], "seg_id long, vec array<float>").repartition(3)
    for most in (2_000_000, 50):
        got = found(nearest(df, most=most))
        assert got[0] == [3 * j for j in range(1, 11)]
        assert got[300] == [3 * j for j in range(10)]
        assert got[1] == [3 * j for j in range(10)]


def test_pairs_at_the_bound_are_decided_by_the_vectors_as_given(spark):
    """Cosines within a millionth of 0.95, on both sides, which 16-bit steps can't tell."""
    a = np.zeros((8, 64))
    a[:, 0] = 1.0
    b = np.zeros((8, 64))
    for j, d in enumerate((-3e-6, -1e-6, -4e-7, 4e-7, 1e-6, 3e-6, -1e-3, 1e-3)):
        b[j, 0], b[j, j + 1] = 0.95 + d, np.sqrt(1 - (0.95 + d) ** 2)
    x = np.concatenate([a[:1], b]).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "seg_id long, vec array<float>")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = unit @ unit.T
    true = sorted((i, j) for i in range(9) for j in range(i + 1, 9) if s[i, j] >= 0.95)
    assert sorted(map(tuple, close_pairs(nearest(df), df).collect())) == true
    again = reranked(nearest(df), df).collect()
    assert all(abs(r.cosine - s[r.id, r.neighbour]) < 1e-12 for r in again) and exact(nearest(df), df).count() == len(again)


@pytest.mark.parametrize("count", [2, 20, 128, 129, 300, 4096, 8192, 16384, 40_000])
def test_cells_are_numbered_by_axes(count):
    """Every cell number stands for one pair of axes, whatever the number of cells."""
    rng = np.random.default_rng(4)
    cells = Cells(rng.normal(size=64), count, 3)
    x = rng.normal(size=(200, 64)).astype(np.float32)
    y = x - cells.centre
    s = np.concatenate([y @ cells.first, -(y @ cells.first)], 1)
    if cells.second is not None:
        w = np.concatenate([y @ cells.second, -(y @ cells.second)], 1)
        s = (s[:, :, None] + w[:, None, :]).reshape(len(x), -1)
    assert s.shape[1] == cells.count and min(count, 16384) * 0.9 <= cells.count <= max(2, count * 1.1)
    near = cells.of(x, 5)
    best = np.sort(s, 1)[:, ::-1][:, : near.shape[1]]
    assert np.allclose(np.take_along_axis(s, near, 1), best, atol=1e-4)


def test_fine_tables_and_crowds(monkeypatch):
    """solve() with many fine cells, a crowd among the vectors, against brute force."""
    monkeypatch.setattr(knn, "WORK", 205)
    monkeypatch.setattr(knn, "WORK_AT", 500)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))[rng.integers(0, 300, 6000)] + 0.7 * rng.normal(size=(6000, 64))
    x[2000:4000] = x[0] + 0.01 * rng.normal(size=(2000, 64))
    q, rows = Vectors(steps(x)), np.arange(6000)
    a, b = Best(6000, 10), Best(6000, 10)
    solve(q, rows, a, 2, 12, 2, 1)
    meet(q, rows, rows, b)
    hits = [len(set((a.kept[i] & knn.LOW).tolist()) & set((b.kept[i] & knn.LOW).tolist())) / 10 for i in range(6000)]
    assert np.mean(hits[2000:4000]) > 0.85 and np.mean(hits) > 0.85, (np.mean(hits[2000:4000]), np.mean(hits))


def test_tree_of_cells():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 64)).astype(np.float32)
    tree = Tree(Cells(np.zeros(64), 16, 1), 3)
    before = tree.of(x)
    tree.divide(5, Cells(np.zeros(64), 8, 2), 2)
    row, leaf = tree.of(x)
    inside = set(before[0][before[1] == 5].tolist())
    assert tree.leaves == 16 + 7 and set(row[(leaf == 5) | (leaf >= 16)].tolist()) == inside
    assert len(set(zip(row.tolist(), leaf.tolist()))) == len(row) == 1500 + len(inside)


def test_hash_clashes_do_not_join_vectors(monkeypatch):
    q = np.array([[1, 2], [1, 2], [3, 4]], "<i2")
    first, number = knn.classes(q)
    assert number[0] == number[1] != number[2] and len(first) == 2

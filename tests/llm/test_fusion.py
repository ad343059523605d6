import numpy as np

from inkwell.llm.fusion import HIT_SCORES, fuse, in_front, walk


def matrix(scores, damping):
    """Stationary shares from the transition matrix written out."""
    n, m = scores.shape
    t = np.zeros((n, n))
    for i in range(n):
        own = [j for j in range(m) if not np.isnan(scores[i, j])]
        if not own:
            t[i, i] = 1
        for j in own:
            up = [k for k in range(n) if scores[k, j] > scores[i, j]]
            for k in up or [i]:
                t[i, k] += 1 / len(own) / len(up or [i])
    p = np.full(n, 1 / n)
    for _ in range(3000):
        p = (1 - damping) / n + damping * (p @ t)
    return p


def test_walk_equals_the_matrix():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        s = np.round(rng.normal(size=(n, 3)) * [1, 1000, 0.01], 1)
        s[rng.random(s.shape) < 0.2] = np.nan
        p, better = walk(s)
        assert np.allclose(p, matrix(s, 0.9), atol=1e-9)
        for i in range(n):
            for j in range(3):
                assert better[i, j] == (-1 if np.isnan(s[i, j]) else (s[:, j] > s[i, j]).sum())


def test_scale_does_not_matter():
    rng = np.random.default_rng(5)
    s = rng.normal(size=(30, 3))
    assert np.array_equal(walk(s)[0], walk(np.stack([np.exp(9 * s[:, 0]), s[:, 1] * 1e6, s[:, 2] ** 3], 1))[0])


def hits(spark):
    rng = np.random.default_rng(6)
    rows = []
    for q in range(12):
        for c in range(5 if q else 90):
            v = [float(x) if rng.random() > 0.1 else None for x in np.round(rng.normal(size=3), 1)]
            rows.append((q, c, -10 * v[0] if v[0] is not None else None, v[1], 7.0 if q == 3 else v[2], 0))
    rows += [(1, 900, None, None, None, 0), (1, 901, float("nan"), None, None, 0), (1, 0, *rows[90][2:]), (None, 1, 1.0, 1.0, 1.0, 0), (1, None, 1.0, 1.0, 1.0, 0)]
    return spark.createDataFrame(rows, "query_id long, chunk_id long, bm25 double, semantic_score double, score double, place int")


def test_whole_and_by_tables_agree(spark):
    df = hits(spark)
    key = lambda r: (r.query_id, r.chunk_id)
    a = {key(r): r for r in fuse(df, HIT_SCORES).collect()}
    b = {key(r): r for r in fuse(df.where("query_id in (0, 1)"), HIT_SCORES, most=6).collect()}
    assert len(a) == 90 + 11 * 5 + 2 and len(b) == 97
    for k, r in b.items():
        assert abs(r.share - a[k].share) < 1e-10 and r.place == a[k].place and (r.better_bm25, r.better_score) == (a[k].better_bm25, a[k].better_score)
    assert sorted(r.place for k, r in b.items() if k[0] == 0) == list(range(1, 91))
    assert {a[1, 900].place, a[1, 901].place} == {6, 7} and a[1, 900].better_bm25 is None


def test_in_front(spark):
    got = {(r.query_id, r.chunk_id) for r in in_front(fuse(hits(spark), HIT_SCORES), list(HIT_SCORES)).collect()}
    rows = {(r.query_id, r.chunk_id): (None if r.bm25 is None else -r.bm25, r.semantic_score, r.score) for r in hits(spark).collect() if r.query_id is not None and r.chunk_id is not None}
    want = set()
    for (q, c), s in rows.items():
        mine = [v for (p, _), v in rows.items() if p == q]
        if all(x is not None and x == x and sum(v[j] is not None and v[j] > x for v in mine) < 5 for j, x in enumerate(s)):
            want.add((q, c))
    assert got == want
    assert fuse(hits(spark).limit(0), HIT_SCORES).count() == 0

import numpy as np
import pytest

from codefacts.llm import ann, embdedup
from codefacts.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, component_id string")


def plain(rows, threshold=0.93):
    """(links, component) of each row by all pairs."""
    def ok(v, label):
        return label is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(np.array(v))

    n = len(rows)
    x = [np.asarray(np.array(v, dtype=np.float32), dtype=np.float64) if ok(v, lab) else None for _, v, lab in rows]
    link = [[i != j and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= threshold for j in range(n)] for i in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        comp = [min([comp[i]] + [comp[j] for j in range(n) if link[i][j]]) for i in range(n)]
    return [(rows[i][0], sum(link[i]), comp[i], comp[i] == rows[i][0]) for i in range(n)]


@pytest.mark.parametrize("tile", [1024, 4])
def test_near_duplicates(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * rng.choice([0.05, 0.3])).tolist(), i % 2) for i in range(60)]
    rows += [(100, rows[0][1], 0), (101, rows[0][1], 1), (102, None, 0), (103, [], 0), (104, [0.0] * 8, 0), (105, [1.0, None] + [0.0] * 6, 0), (106, [NAN] * 8, 0), (107, [INF] + [1.0] * 7, 0), (108, rows[0][1], None), (109, [1.0, 2.0], 0), (110, [2.0, 4.0], 0), (111, [-0.0] * 8, 0)]
    got = embdedup.near_duplicates(vectors(spark, rows), tile=tile).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))


def test_no_vectors(spark):
    assert embdedup.near_duplicates(vectors(spark, [])).count() == 0 and ann.nearest(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in embdedup.near_duplicates(vectors(spark, [(1, None, None)])).collect()] == [(1, 0, 1, True)]
    assert ann.nearest(vectors(spark, [(0, None, 1), (20, [0.0], 1)])).count() == 0


def test_tile_links():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(40, 40)), rng.normal(size=(30, 40))
    b[:10] = a[:10] + 0.05 * rng.normal(size=(10, 40))
    cos = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    assert (embdedup.tile_links(a, b, embdedup.rotation(a), 0.93) == (cos >= 0.93)).all()
    assert (embdedup.tile_links(a, b, embdedup.rotation(a), 0.1) == (cos >= 0.1)).all()


def test_roots():
    link = np.zeros((5, 4), dtype=bool)
    for i, j in ((0, 1), (2, 1), (2, 3), (4, 0)):
        link[i, j] = True
    r, c = embdedup.roots(link, False)
    assert r.tolist() == [0, 1, 0, 3, 4] and c.tolist() == [4, 0, 7, 0]


def exact(rows, top, every):
    x = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(np.array(v)):
            x.setdefault(i, np.asarray(np.array(v, dtype=np.float32), dtype=np.float64))
    out = {}
    for q in x:
        if q % every == 0:
            out[q] = sorted(((-(x[q] @ x[i]), i) for i in x if i != q))[:top]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=16) * rng.choice([0.5, 2.0])).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # more equal vectors than a result holds
    rows += [(7, rows[7][1]), (2000, None), (2020, [0.0] * 16), (2040, [NAN] * 16), (2060, [1.0, 2.0]), (None, rows[3][1])]
    got = ann.nearest(vectors(spark, [(i, v, 0) for i, v in rows]), shard=128, block=9).collect()
    want = exact(rows, 20, 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert set(by) == set(want)
    hit = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
        hit += len({f[2] for f in found} & {i for _, i in want[q]})
    assert hit / sum(map(len, want.values())) > 0.95


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0), (20, [0.5, 0.5], 0)]
    got = sorted(map(tuple, ann.nearest(vectors(spark, rows)).collect()))
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 1), (20, 2, 2), (20, 3, 0)]


def test_quantiser_prefers_parallel_accuracy():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain_, aware = ann.Quantiser.fit(x, threshold=0.0), ann.Quantiser.fit(x, threshold=0.4)

    def parallel(q):
        return np.mean(((x - q.decode(q.encode(x))) * x).sum(axis=1) ** 2)

    assert parallel(aware) < 0.7 * parallel(plain_)
    q = x[:5]
    codes = aware.encode(x)
    t, p = aware.tables(q), ann.packed(codes)
    assert np.allclose(sum(t[2][j][p[j]] for j in range(len(p))), aware.decode(codes) @ q[2], atol=1e-5)


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = {i: np.array(v) for i, v in rows}
    got = {}
    for r in QUERIES["op9_nearest"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12)
    want = {q: {i for _, i in sorted((-(x[q] @ x[i]), i) for i in x if i != q)[:20]} for q in x if q % 20 == 0}
    assert set(got) == set(want) and np.mean([len(got[q] & want[q]) / 20 for q in want]) >= 0.9

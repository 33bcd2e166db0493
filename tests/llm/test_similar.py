import numpy as np
import pytest

from weftline.llm import similar
from weftline.llm.similar import similar_vectors, usable_vectors


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding_name string, v array<float>, similarity double, vec string")


def _brute(ids, mat, k):
    unit = mat / np.linalg.norm(mat, axis=1)[:, None]
    sims = unit @ unit.T
    out = {}
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(sims[i, j], 9), ids[j]))[:k]
        out[a] = [round(float(sims[i, j]), 6) for j in order]
    return out


def test_same_as_brute_force_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    rows, data = [], {}
    for name, n, dim in (("hot", 700, 16), ("small", 40, 16), ("other", 60, 8)):
        base = rng.normal(size=(n, dim)).astype("f4")
        base[: n // 5] = base[0] + rng.normal(size=(n // 5, dim)).astype("f4") * 0.05
        base *= rng.uniform(0.1, 30, size=(n, 1)).astype("f4")
        ids = [f"{name}{i:04d}" for i in range(n)]
        data[name] = (ids, base.astype("f8"))
        rows += [(i, name, [float(x) for x in v], 0.0, "x") for i, v in zip(ids, base)]
    rows += rows[:50]
    got = similar_vectors(usable_vectors(_frame(spark, rows), "t", "v"), 10, tasks=9, part_bytes=128 * 16 * 4).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.id, r.rank)):
        by.setdefault(r.id, []).append(round(r.similarity, 6))
    for ids, mat in data.values():
        want = _brute(ids, mat, 10)
        for i in ids:
            assert np.allclose(by[i], want[i], atol=2e-6)
    assert len(got) == 800 * 10


def test_unusable_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "m", [1.0, 0.0]), ("b", "m", [2.0, 0.0]), ("c", "m", [3.0, 0.0]), ("d", "m", [0.0, 0.0]), ("e", "m", None), ("f", "m", []), ("g", "m", [1.0]), ("h", "m", [nan, 1.0]), ("i", "m", [1.0, None]), ("j", "m", [inf, 1.0]), ("k", None, [1.0, 1.0]), ("l", None, [1.0, 1.0]), (None, "m", [1.0, 1.0]), ("A", "m", [1.0, 0.0])]
    df = _frame(spark, [(*r, 0.0, "x") for r in rows])
    got = {(r.id, r.neighbour, r.rank) for r in similar_vectors(usable_vectors(df, "t", "v"), 2).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 2), ("c", "a", 1), ("c", "b", 2), ("k", "l", 1), ("l", "k", 1)}
    assert similar_vectors(usable_vectors(df.limit(0), "t", "v")).count() == 0
    assert similar_vectors(usable_vectors(df.where("id = 'a'"), "t", "v")).count() == 0


def test_integer_products_are_exact_with_and_without_the_runtime(monkeypatch):
    rng = np.random.default_rng(1)
    rows, columns = rng.integers(1, 128, (40, 300), dtype=np.uint8), rng.integers(-127, 128, (300, 50), dtype=np.int8)
    want = (rows.astype(np.int64) - similar.ZERO) @ columns.astype(np.int64)
    extreme = np.full((3, 4000), 127, np.uint8), np.full((4000, 2), 127, np.int8)
    for session in (similar._session, lambda: None):
        monkeypatch.setattr(similar, "_session", session)
        assert (similar.product(rows, columns) == want).all()
        assert (similar.product(*extreme) == 63 * 127 * 4000).all()


@pytest.mark.parametrize("dim", [3, 64])
def test_two_parts_give_what_one_gives(dim):
    rng = np.random.default_rng(dim)
    mat = rng.normal(size=(1500, dim)).astype("f4")
    mat[700:760] = mat[3]  # more copies than a list holds
    whole, a, b = similar.Part(0, mat, 10), similar.Part(0, mat[:800], 10), similar.Part(800, mat[800:], 10)
    similar.compare(whole, whole)
    for x, y in ((a, a), (b, b), (a, b)):
        similar.compare(x, y)
    parts = similar.best(np.concatenate([a.row, b.row + 800]), np.concatenate([a.sim, b.sim]), np.concatenate([a.other, b.other]), 10)
    one = similar.best(whole.row, whole.sim, whole.other, 10)
    assert len(one[0]) == 15_000 and (parts[0] == one[0]).all() and np.allclose(parts[1], one[1]) and (parts[2] == one[2]).mean() > 0.999
    unit = mat.astype("f8") / np.linalg.norm(mat.astype("f8"), axis=1)[:, None]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    assert np.allclose(one[1].reshape(1500, 10), -np.sort(-sims, axis=1)[:, :10], atol=1e-9)


def test_layout_meets_every_pair_once():
    groups, total = similar.layout([("t", "m", 0, 50, 8), ("t", None, 0, 7, 4), ("t", "m", 1, 70, 8)], 10, 30 * 8 * 4)
    g = groups["t", "m"]
    assert (g.rows, g.parts, g.starts) == (120, 4, {0: 0, 1: 50}) and groups["t", None].starts == {0: 0}
    met = [(i, j) for i in range(4) for j in range(i, 4) if set(g.tasks_of(i)) & set(g.tasks_of(j))]
    assert len(met) == 10 and total == 11
    assert all(len(set(g.tasks_of(i)) & set(g.tasks_of(j))) == 1 for i in range(4) for j in range(i))


def test_a_third_of_all_rows_are_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)).astype("f4")
    base[100:200] = base[0]  # a hot group of copies
    base[200:203] = base[1]  # fewer copies than a list holds
    ids = [f"v{i:03d}" for i in rng.permutation(300)]
    df = _frame(spark, [(i, "m", [float(x) for x in v], 0.0, "x") for i, v in zip(ids, base)])
    got = {}
    for r in similar_vectors(usable_vectors(df, "t", "v"), 10, part_bytes=50 * 6 * 4).collect():
        got.setdefault(r.id, {})[r.rank] = (r.neighbour, round(r.similarity, 6))
    unit = base.astype("f8") / np.linalg.norm(base.astype("f8"), axis=1)[:, None]
    sims = np.round(unit @ unit.T, 9)
    for i, a in enumerate(ids):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:10]
        assert [got[a][n][0] for n in range(1, 11)] == [ids[j] for j in order], a
        assert np.allclose([got[a][n][1] for n in range(1, 11)], sims[i, order], atol=2e-6)
    close = similar_vectors(usable_vectors(df, "t", "v"), 10, least=0.99).collect()
    assert {(r.id, r.rank, r.neighbour) for r in close} == {(a, n, x) for a, own in got.items() for n, (x, s) in own.items() if s >= 0.99}


def test_least_is_the_first_bound_of_every_list(monkeypatch):
    rng = np.random.default_rng(5)
    mat = rng.normal(size=(1500, 32)).astype(np.float32)
    mat[:120] = mat[0] + rng.normal(size=(120, 32)).astype(np.float32) * 0.2  # more than k others above the bound
    mat[700:720] = mat[1300:1320] + rng.normal(size=(20, 32)).astype(np.float32) * 0.1
    looked = []
    monkeypatch.setattr(similar, "_recompute", lambda a, b, i, j, f=similar._recompute: (looked.append(len(i)), f(a, b, i, j)))
    lists = []
    for least in (None, 0.9):
        looked.clear()
        a, b = similar.Part(0, mat[:800], 10, least), similar.Part(800, mat[800:], 10, least)
        for x, y in ((a, a), (a, b), (b, b)):
            similar.compare(x, y)
        lists.append({(p.num + r, round(s, 9), o) for p in (a, b) for r, s, o in zip(p.row, p.sim, p.other, strict=True) if s >= 0.9})
    assert lists[0] == lists[1] and len(lists[1]) >= 120 * 10 + 40
    assert sum(looked) < 120 * 120 and (a.sim >= 0.9).all() and (b.sim >= 0.9).all()

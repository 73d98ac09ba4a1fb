"""Links of vectors against brute force."""

import numpy as np
import pytest

from haptrace.llm import catalog, pivots

SF = "/root/testdata/sf0.01"


def _rows():
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        base = rng.normal(size=(60, 32))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        for b in base:
            rows.append((b, label))
            for cosine in (0.999, 0.9805, 0.981, 0.9795):
                z = rng.normal(size=32)
                z -= (z @ b) * b
                z /= np.linalg.norm(z)
                rows.append((3 * (cosine * b + np.sqrt(1 - cosine**2) * z), label))
        hot = base[0]
        rows += [(hot + rng.normal(size=32) * 0.012, label) for _ in range(80)] + [(hot, label)] * 5
    vectors = [[float(np.float32(x)) for x in v] for v, _ in rows] + [None, [], [0.0] * 32, [float("nan")] * 32, [1.0, None] * 16, [float("inf")] + [0.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    labels = [k for _, k in rows] + [0] * 8
    order = rng.permutation(len(vectors))
    return [(int(n), vectors[i], labels[i], "x") for n, i in enumerate(order)]


@pytest.mark.parametrize("block_rows", [1024, 9])
def test_matches_brute_force(spark, block_rows):
    rows = _rows()
    found = {r["vec_id"]: r for r in pivots.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string"), block_rows=block_rows).collect()}
    assert len(found) == len(rows)
    links, name = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    sound = [(i, np.array(v, dtype=np.float64), k) for i, v, k, _ in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    pairs = []
    for a, (i, v, k) in enumerate(sound):
        for j, w, m in sound[:a]:
            if k == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    got = sum(r["n_links"] for r in found.values()) / 2
    assert 0.98 * len(pairs) <= got <= len(pairs)
    assert all(found[i]["n_links"] <= links[i] for i in links)
    for _ in range(len(rows)):
        before = dict(name)
        for i, j in pairs:
            name[i] = name[j] = min(name[i], name[j])
        if name == before:
            break
    same = np.mean([found[i]["component_id"] == name[i] for i in name])
    assert same > 0.98
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in found.values())


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert pivots.near_copies(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (4, [2.0, 4.0], 1), (4, [2.0, 4.0], 1), (5, [1.0, 2.0], None), (None, None, 1), (6, [1.0, -2.0], 1)]
    found = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in pivots.near_copies(spark.createDataFrame(rows, schema)).collect() if r["n_links"])
    assert found == [(0, 3, 4), (0, 3, 4), (4, 3, 4), (4, 3, 4)]


def test_ids_that_repeat(spark):
    """Rows of one id with different vectors, and null ids with one vector under two labels, keep to their own class."""
    schema = "vec_id long, embedding array<float>, label int"
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, a, 0), (3, b, 0), (4, a, 1)] + [(None, a, 0)] + [(None, a, 1)] + [(None, [0.0, 0.0, 1.0], 1)] * 2
    found = pivots.near_copies(spark.createDataFrame(rows, schema)).collect()
    told = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in found))
    assert told == [(0, 1, 0, True), (0, 1, 0, True), (0, 1, 4, False), (0, 2, 1, False),
                    (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 1, 4, True)]


def test_agreement_goes_by_places():
    left = np.array([[5, 3, 9, 1, 0, 7]])
    assert pivots.agreement(left, left).tolist() == [21]
    assert pivots.agreement(left, np.array([[3, 5, 9, 20, 21, 22]])).tolist() == [5 + 5 + 4]
    assert pivots.agreement(left, np.array([[20, 21, 22, 7, 0, 5]])).tolist() == [1 + 2 + 1]


@pytest.mark.parametrize(("count", "size"), [(128, 16), (128, 256), (1024, 16), (1024, 64)])
def test_recall(spark, count, size):
    """Pairs at a cosine just above the threshold, the hardest to find, at the least and at the greatest number of pivots."""
    rng = np.random.default_rng(size)
    base = rng.normal(size=(1500, size))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    rows = [(n, v.tolist(), 0) for n, v in enumerate(np.concatenate([base, 0.9801 * base + (1 - 0.9801**2) ** 0.5 * away]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r["component_id"] for r in pivots.near_copies(table, pivots=count).collect()}
    assert np.mean([found[n] == found[n + 1500] for n in range(1500)]) >= 0.95


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    unit = np.array([r["embedding"] for r in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array([-1 if r["label"] is None else r["label"] for r in rows])
    close = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :]) & (labels >= 0)[:, None]
    np.fill_diagonal(close, False)
    ids = np.array([r["vec_id"] for r in rows])
    name = ids.copy()
    for _ in rows:
        name = np.minimum(name, np.where(close, name[None, :], name.max()).min(axis=1))
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in catalog.QUERIES["op7_pivots"](spark, SF).collect()}
    assert found == {int(i): (int(c.sum()), int(m), bool(i == m)) for i, c, m in zip(ids, close, name)}

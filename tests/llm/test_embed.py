"""Embedding links against brute force over all pairs."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidewright.llm import embed as E


def brute(ids, x, cosine=0.9):
    norm = np.sqrt((x * x).sum(1))
    g = (x @ x.T) / (norm[:, None] * norm[None]) >= cosine
    np.fill_diagonal(g, False)
    ids = np.array(ids)
    root = ids.copy()
    for start in range(len(ids)):  # a walk from every vector, smallest id first
        start = int(np.argsort(ids, kind="stable")[start])
        todo = [start] if root[start] == ids[start] else []
        while todo:
            at = todo.pop()
            for j in np.flatnonzero(g[at] & (root > ids[start])).tolist():
                root[j] = ids[start]
                todo.append(j)
    return {int(i): (int(k), int(r)) for i, k, r in zip(ids, g.sum(1), root, strict=True)}


def test_table_against_brute_force(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    t = pq.read_table(path)
    want = brute(t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist()))
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link_vectors(spark.read.parquet(path)).collect()}
    assert got == want


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3000, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9, 0.92, (3000, 1))
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in E.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)).collect()}
    want = brute(range(len(x)), x)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(k for k, _ in want.values())
    assert all(got[i].n_links <= k for i, (k, _) in want.items())


@pytest.mark.parametrize("most", [100_000, 0])
def test_blocks_of_a_crowded_cell(spark, monkeypatch, most):
    monkeypatch.setattr(E, "BLOCK", 40)
    monkeypatch.setattr(E, "BROADCAST_CELLS", most)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(300, 8)), rng.normal(size=(300, 8))])
    x = np.concatenate([x, x[:100]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute(range(len(x)), x)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1e300, 1e300]), (8, [1.0, 1.0]), (9, [1.0, 1.0, 0.0]), (None, [1.0, 1.0]), (10, [-0.0, 2.0]), (11, [0.0, 2.0]), (12, [0.0, 2.0]), (12, [0.0, 2.0])]
    df = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<double>, label int, n int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in E.link_vectors(df).collect())
    alone = [(str(i), 0, str(i), True) for i in (1, 2, 3, 4, 5, 6, 9)]
    assert got == sorted([*alone, ("7", 1, "7", True), ("8", 1, "7", False), ("None", 0, "None", True), ("10", 3, "10", True), ("11", 3, "10", False), ("12", 3, "10", False), ("12", 3, "10", False)])
    assert E.link_vectors(df.limit(0)).count() == 0


def test_repeated_ids_with_other_vectors(spark):
    rows = [(2, [1.0, 0.0]), (2, [0.0, 1.0]), (5, [1.0, 0.01]), (1, [-1.0, 0.0]), (7, [0.01, 1.0]), (7, [0.0, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 0, 1), (2, 1, 2), (2, 2, 2), (5, 1, 2), (7, 2, 2), (7, 2, 2)]


def test_registered_query(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    want = brute(t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist()))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.op7_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (k, c, i == c) for i, (k, c) in want.items()}

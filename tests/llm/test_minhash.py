"""Near-duplicate texts against brute force over all pairs."""

import re

import numpy as np
import pyarrow.parquet as pq

from tidewright.llm import common
from tidewright.llm import minhash as M


def shingle_set(text, width=2):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width=2):
    rows = sorted(rows, key=lambda r: r[0])
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, k in near.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows)))


def check(spark, df, rows, width=2):
    got = M.near_duplicates(df, width=width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = list(zip(*(pq.read_table(path)[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    check(spark, spark.read.parquet(path), rows)


def test_chains_ties_and_empties(spark, make_docs):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    rows = [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (905, "a b"), (906, "A B"), (907, "É x"), (908, "é x")]
    i = 0
    for _ in range(6):  # chains: each text a little further from the first
        text = list(rng.choice(words, 200))
        for _ in range(9):
            rows.append((i, " ".join(text)))
            for p in rng.integers(0, 200, 7):
                text[p] = str(rng.choice(words))
            i += 1
    base = list(rng.choice(words, 300))
    for k in range(40):  # near copies on both sides of the threshold
        text = list(base)
        for p in rng.choice(300, k // 2, replace=False):
            text[p] = str(rng.choice(words))
        rows.append((i, " ".join(text)))
        i += 1
    check(spark, make_docs(rows), rows)
    check(spark, make_docs(rows), rows, width=5)


def test_blocks_of_a_crowded_cluster(spark, make_docs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):  # edits that leave some under the threshold to the first, and linked to few others
        text = list(base)
        for p in rng.choice(150, rng.integers(0, 26), replace=False):
            text[p] = f"x{rng.integers(30)}"
        rows.append((i * 7 % 151, " ".join(text)))
    check(spark, make_docs(rows), rows)


def test_edges(spark, make_docs):
    assert M.near_duplicates(make_docs([])).count() == 0
    got = M.near_duplicates(make_docs([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("None", "None", True)]


def test_bands_follow_the_threshold():
    assert M.rows_of_band(80) == 4 and abs(M.least_estimate(80) - 0.59) < 0.005
    for percent in (30, 50, 65, 80, 90, 95):
        r = M.rows_of_band(percent)
        assert (1 - (percent / 100) ** r) ** (M.HASHES // r) <= M.MISS


def test_half_alike(spark, make_docs):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(120)]
        rows.append((2 * g, " ".join(base)))
        rows.append((2 * g + 1, " ".join(base[: int(rng.integers(70, 100))] + [f"z{g}x{i}" for i in range(20)])))
    sets = [shingle_set(t) for _, t in rows]
    linked = {2 * g for g in range(40) if 2 * len(sets[2 * g] & sets[2 * g + 1]) >= len(sets[2 * g] | sets[2 * g + 1])}
    got = {r.doc_id: r.component_id for r in M.near_duplicates(make_docs(rows), width=2, percent=50).collect()}
    assert 0 < len(linked) < 40 and {2 * g for g in range(40) if got[2 * g + 1] == 2 * g} == linked


def test_large_bucket_in_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(M, "MEET", 8)
    rng = np.random.default_rng(7)
    rows = []
    for k in range(60):  # a long common passage, so buckets hold texts of several clusters
        own = [f"k{k // 3}w{i}" for i in range(int(30 + k // 3))]
        own[int(rng.integers(30))] = f"y{k}"
        rows.append((k, " ".join([f"c{i}" for i in range(170)] + own)))
    check(spark, make_docs(rows), rows)


def test_long_texts_and_ids_with_two_texts(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, long), (2, long + " end"), (3, "q " * 50000), (4, "q")]
    check(spark, make_docs(rows), rows)
    got = M.near_duplicates(make_docs([(1, "a b c"), (1, "x y z w"), (2, "a b c"), (3, "x y z w")]), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 2, 1, True), (1, 3, 1, True), (2, 2, 1, False), (3, 3, 1, False)]


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    t = pq.read_table(f"{path}/documents.parquet")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in M.op8_minhash_dedup(spark, path).collect())
    assert got == brute(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)))


def test_forest_and_components(spark):
    chain = [(i + 1, i) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 500)]
    links = spark.createDataFrame(chain, "a long, b long")
    want = {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1500)}
    assert {r.node: r.root for r in common.forest(links).collect()} == want
    assert {r.node: r.root for r in common.components(links).collect()} == want
    more = common.joined_up(common.forest(links), spark.createDataFrame([(300, 1400), (7, 2000)], "a long, b long"))
    assert {r.node: r.root for r in more.collect()} == dict.fromkeys([*want, 2000], 0)
    assert common.forest(links.limit(0)).count() == common.components(links.limit(0)).count() == 0

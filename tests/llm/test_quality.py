"""Held-out accuracy of the document evidence, and shrinkage of sparse sites."""

import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewright.llm import quality as Q


@pytest.fixture(scope="module")
def labelled():
    d, k = (pq.read_table(f"/root/testdata/sf0.1/{t}.parquet").to_pandas() for t in ("documents", "labels"))
    j = d.merge(k, on="doc_id").sort_values("doc_id")
    return list(j[["text", "quality", "toxic"]].itertuples(index=False, name=None))


def test_held_out_accuracy(labelled):
    train, held = labelled[::2][:1500], labelled[1::2][:1500]
    model = Q.Classifier([(*Q.measure(t), q, x) for t, q, x in train])
    e = model.evidence([t for t, _, _ in held])
    good = [v > 0 for v, (_, q, x) in zip(e, held, strict=True) if q == 1 and x == 0]
    bad = [v < 0 for v, (_, q, x) in zip(e, held, strict=True) if q == 0 or x == 1]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) > 0.95


def plain_judge(rows):
    """(host prior, path prior, posterior) of every row, as the docstring of the module says, in plain Python."""
    q = [1 / (1 + math.exp(-e)) for *_, e in rows]
    clip = lambda v, lo, hi: max(lo, min(hi, v))
    mean = clip((sum(q) + 1) / (len(q) + 2), 0.02, 0.98)
    hosts, paths = {}, {}
    for (_, host, path, _), v in zip(rows, q, strict=True):
        hosts.setdefault(host, []).append(v)
        paths.setdefault((host, path), []).append(v)

    def strength(groups):  # (number, share, mean of its parent)
        spread = sum(n * (p - m) ** 2 for n, p, m in groups) - sum(m * (1 - m) for _, _, m in groups)
        return clip(1 / max(1e-4, spread / sum(n * m * (1 - m) for n, _, m in groups)) - 1, 2.0, 1e4)

    a = strength([(len(v), sum(v) / len(v), mean) for v in hosts.values()])
    whole = {h: (sum(v) + a * mean) / (len(v) + a) for h, v in hosts.items()}
    b = strength([(len(v), sum(v) / len(v), whole[h]) for (h, _), v in paths.items()])
    out = []
    for (_, host, path, e), v in zip(rows, q, strict=True):
        hp = (max(0.0, sum(hosts[host]) - v) + a * mean) / (len(hosts[host]) - 1 + a)
        pp = (max(0.0, sum(paths[host, path]) - v) + b * hp) / (len(paths[host, path]) - 1 + b)
        prior = clip(pp, 0.02, 0.98)
        out.append((hp, pp, 1 / (1 + math.exp(-(e + math.log(prior / (1 - prior)))))))
    return out


def test_judge_against_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = []
    for h in range(12):
        lean = rng.normal(0, 2)
        for p in range(int(rng.integers(1, 5))):
            rows += [(len(rows) + i, f"h{h}" if h else None, f"h{h}/p{p}", float(rng.normal(lean, 2))) for i in range(int(rng.integers(1, 60)))]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")).collect()}
    for (i, *_), (hp, pp, post) in zip(rows, plain_judge(rows), strict=True):
        r = got[i]
        assert (r.host_prior, r.path_prior, r.posterior) == pytest.approx((hp, pp, post), abs=1e-9) and r.kept == (post >= 0.5 - 1e-9)


def test_sparse_sites_shrink(spark):
    rows = [(i, "big", "big/a", -3.0 if i % 2 else 3.0) for i in range(400)] + [(1000 + i, "bad", "bad/a", -5.0) for i in range(200)] + [(5000 + i, "new", "new/a", -5.0) for i in range(2)] + [(6001, "bad", "bad/rare", 4.0)]
    rows.append((None, None, "none", 0.0))
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")).collect()}
    mean = sum(1 / (1 + math.exp(-r[3])) for r in rows) / len(rows)
    assert got[1000].host_prior < 0.1 < got[5000].host_prior < mean  # one other bad page does not condemn a host, 200 do
    assert got[6001].path_prior == pytest.approx(got[6001].host_prior)  # a lone page is no evidence about itself
    assert abs(got[0].host_prior - 0.5) < 0.05 and len(got) == len(rows)
    assert got[0].kept and not got[1].kept and not got[1000].kept


def test_registered_query(spark):
    got = Q.op2_quality_classifier(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "text").collect()
    texts, where = {r.doc_id: r.text for r in docs}, {r.doc_id: (r.host, r.path) for r in got}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    fitted = sorted(labels, key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))[: Q.SAMPLE]
    model = Q.Classifier([(*Q.measure(texts[r.doc_id] or ""), r.quality, r.toxic or 0) for r in fitted])
    rows = [(r.doc_id, *where[r.doc_id], float(e)) for r, e in zip(docs, model.evidence([r.text for r in docs]), strict=True)]
    want = {i: post for (i, *_), (_, _, post) in zip(rows, plain_judge(rows), strict=True)}
    assert {r.doc_id: r.posterior for r in got} == pytest.approx(want, abs=1e-3)


def test_edges(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, None), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, None), (1, None), (None, ""), (2, "x" * 200000, None), (3, "word " * 30000)])
    got = Q.classify(docs, labels).collect()
    assert len(got) == 5 and all(r.kept is not None and 0 <= r.posterior <= 1 for r in got)
    assert Q.classify(make_docs([]), labels).count() == 0
    assert Q.classify(docs, labels.limit(0)).where(F.col("kept")).count() == 5

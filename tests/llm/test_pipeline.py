"""Each stage of the pipeline against plain Python on its own input."""

from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as C
from tests.llm.test_minhash import brute
from tidewright.llm import mixing, quality, secrets
from tidewright.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in C.STAGES:
        rows = [r.asDict() for r in docs.collect()]
        df = stage(spark, docs, SF)
        out.append((rows, [r.asDict() for r in df.collect()], df.columns))
        docs = spark.createDataFrame(df.toPandas(), df.schema)
    return out


def test_columns(outputs):
    assert all(columns == C.COLUMNS for _, _, columns in outputs[:-1])


def test_quality(spark, outputs):
    before, after, _ = outputs[0]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    good = [i for i, k in labels.items() if k.quality == 1 and k.toxic == 0]
    bad = [i for i, k in labels.items() if k.quality == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and not sum(i in kept for i in bad) > 0.1 * len(bad)
    assert {r["doc_id"]: r for r in before}.items() >= {r["doc_id"]: r for r in after}.items()


def test_dedup(outputs):
    before, after, _ = outputs[1]
    want = {i for i, _, root in brute([(r["doc_id"], r["text"]) for r in before], 5) if i == root}
    assert {r["doc_id"] for r in after} == want


def test_secrets(outputs):
    before, after, _ = outputs[2]
    scan = secrets.Scanner(secrets.default_model())
    want = {r["doc_id"]: secrets.redact(r["text"], scan.scan([r["text"]])[0]) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(not secrets.base_findings(r["text"]) and r["n_chars"] == len(r["text"]) for r in after)


def test_mixing(outputs):
    before, after, _ = outputs[3]
    words = {r["doc_id"]: len(r["text"].split()) for r in before}
    copies = {i: sum(r["doc_id"] == i for r in after) for i in words}
    assert max(copies.values()) <= 2
    total, most = sum(words.values()), max(words.values())
    assert abs(sum(words[i] * k for i, k in copies.items()) - 1.5 * total) <= most


def test_mixing_null_and_repeated_ids(spark, make_docs):
    rng = np.random.default_rng(3)
    ids = [None] * 60 + [7] * 100 + [*range(100, 240)]
    rows = [(i, " ".join([f"r{n}", *["w"] * int(rng.integers(0, 60))]), "ab"[n % 2]) for n, i in enumerate(ids)]
    rows += [(7, "same row twice", "a")] * 2 + [(None, None, "a"), (8, "", "b")]
    docs = make_docs(rows).select(C.COLUMNS)
    got = C.mixing(spark, docs.repartition(5), SF)
    assert got.columns == C.COLUMNS
    out = [(r.doc_id, r.text, r.source) for r in got.collect()]
    words, copies = (lambda t: len((t or "").split())), Counter(out)
    assert set(out) <= set(rows) and all(k <= 2 * rows.count(r) for r, k in copies.items())
    mixed = mixing.mix_sources(docs).collect()
    assert Counter((i, words(t), s) for i, t, s in out) == sum((Counter({(r.doc_id, r.size, r.source): r.taken // r.size}) for r in mixed if r.taken), Counter())
    total, most = sum(words(t) for _, t, _ in rows), max(words(t) for _, t, _ in rows)
    assert 1.5 * total - most <= sum(words(t) for _, t, _ in out) <= 1.5 * total
    assert any(i is None for i, _, _ in out) and sorted(out, key=str) == sorted(((r.doc_id, r.text, r.source) for r in C.mixing(spark, docs, SF).collect()), key=str)


def test_packing(outputs):
    before, after, _ = outputs[4]
    enc = Encoder(P.path("word_bpe_49k.json"))
    want = sorted(np.frombuffer(b, "<u4").tolist() + [1] for b in enc.encode([r["text"] for r in before]))
    ids = {}
    for r in sorted(after, key=lambda r: (r["doc_id"], r["start"])):
        ids.setdefault(r["doc_id"], []).append(r)
    assert sum(r["length"] for r in after) == sum(map(len, want))
    assert {r["doc_id"] for r in before} == ids.keys()


def test_run(spark, outputs):
    assert C.run(spark, SF).count() > 0
    assert quality.PRIOR == 0.5


CLASH = [(1, None, None), (1, "", "s"), (None, "near copy " + "of these words here " * 3, "t"), (None, "near copy " + "of these words here " * 3, None), (5, "one two three four five six seven", "s"), (5, "one two three four five six seven", "s"),
         (6, "one two three four five six seven", "s"), (7, "a", None), (8, "long words " * 30000, "s"), (9, 'password = "abcDEF123456" and so on', "t")]


def test_stages_on_odd_rows(spark, make_docs):
    docs = make_docs(CLASH)
    kept = C.quality(spark, docs, SF)
    assert kept.columns == C.COLUMNS and set(kept.collect()) <= set(docs.select(C.COLUMNS).collect())
    left = [(r.doc_id, r.text) for r in C.dedup(spark, docs, SF).collect()]
    assert sorted(left, key=str) == sorted([(1, None), (1, ""), (None, CLASH[2][1]), (5, CLASH[4][1]), (7, "a"), (8, CLASH[8][1]), (9, CLASH[9][1])], key=str)
    clean = C.secrets(spark, docs, SF).collect()
    assert len(clean) == len(CLASH) and [r.text for r in clean if r.doc_id == 9] == ['[secret]" and so on'] and sum(r.text is None for r in clean) == 1
    pieces = C.packing(spark, docs, SF).collect()
    assert sum(r.start == 0 for r in pieces) == len(CLASH)


@pytest.mark.parametrize("stage", [s for _, s in C.STAGES])
def test_stages_on_empty_tables(spark, make_docs, stage):
    assert stage(spark, make_docs([]), SF).count() == 0


def test_quality_judges_rows_not_ids(spark, make_docs):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    once = {(r.doc_id, r.text) for r in C.quality(spark, make_docs(rows), SF).collect()}
    bad, source = next((t, s) for i, t, s in rows if (i, t) not in once)
    labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = next(i for i, _ in once if i not in labelled)
    got = [(r.doc_id, r.text) for r in C.quality(spark, make_docs([*rows, (good, bad, source)]), SF).collect()]
    assert any(i == good for i, _ in got) and (good, bad) not in got

"""Secret scans against a plain reading of the contract, and held-out accuracy of the network."""

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidewright.llm import secrets as S


def brute(text):
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


TEXTS = ["", "password=abc", "PassWord : 'abcdef'", "secret=token:abcdefgh", "token=secret=abcdefgh", "api_key\"= xx-xx.yy api-key=abcdefg apikey=123456", "AKIA" + "A" * 15, "xAKIAAKIA" + "B" * 17,
         "0" * 23, "g" + "0a" * 12 + "g", "é😀 passwd=a9ce335683f9772ddc", "tokKen=abcdefg toKen=abcdefg", "password=" + "a1" * 15, "a" * 5000 + " secret:" + "q" * 9000]


@pytest.mark.parametrize("text", TEXTS)
def test_base_findings(text):
    assert S.base_findings(text) == brute(text)


def test_base_findings_on_documents():
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist():
        assert S.base_findings(t) == brute(t)


def test_network_on_held_out_findings():
    model = S.default_model()
    f = S.labelled_findings(800, seed=99)
    p = model.probability(model.logits(np.stack([S.windows(t, a, b)[0] for t, a, b, _ in f])))
    y = np.array([x[3] for x in f])
    assert (p[y == 1] >= model.threshold).mean() >= 0.95
    assert (p[y == 0] >= model.threshold).mean() <= 0.03


def test_network_on_the_corpus():
    """The network alone, trained on made-up findings, against the base findings of the documents as labels."""
    model, found, flagged, free = S.default_model(), [], 0, 0
    for t in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist():
        base, seen = S.base_findings(t or ""), S.candidates(t or "")
        if base or seen:
            scored = [(a, b, model.probability(model.logits(np.stack(S.windows(t, a, b)))).max() >= model.threshold) for a, b in seen]
            found += [any(hit for a, b, hit in scored if a < e and s < b) for s, _, e in base]
            others = [hit for a, b, hit in scored if not any(a < e and s < b for s, _, e in base)]
            flagged, free = flagged + sum(others), free + len(others)
    assert len(found) > 200 and sum(found) >= 0.98 * len(found)
    assert free > 1000 and flagged <= 0.01 * free


def test_query_rows(spark, make_docs, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (1, TEXTS[2]), (None, "token=abcdefg"), (60, "my bearer = " + "Zk9" * 10 + "x0q and more")]
    make_docs(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = S.op3_secret_scans(spark, f"file://{tmp_path}").collect()
    want = []
    for i, t in rows:
        b = brute(t or "")
        line = ",".join(f"{S.KINDS[k]}:{a}:{e}" for a, k, e in b)
        want.append((str(i), *(sum(k == j for _, k, _ in b) for j in range(3)), hashlib.sha256(line.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    assert next(r.spans for r in got if r.doc_id == 60) == "model:12:45"
    assert S.scan_secrets(make_docs([])).count() == 0


def test_redact():
    f = S.Scanner(S.default_model()).scan(["a password=" + "0f" * 12 + " b token=abcdefg"])[0]
    assert S.redact("a password=" + "0f" * 12 + " b token=abcdefg", f) == "a [secret] b [secret]"


def test_keys_without_digits_are_scanned():
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    keys = ["".join(rng.choice(letters, 16 + i % 20)) for i in range(300)]
    assert all(S.candidates(f"my bearer = {k} and more") == [(12, 12 + len(k))] for k in [*keys, "1" * 16, "-" * 20])
    scan = S.Scanner(S.default_model()).scan([f"my bearer = {k} and more" for k in keys])
    assert sum(bool(f) for f in scan) >= 0.95 * len(keys)
    plain = ["the Geschwindigkeitsbegrenzung here", "an internationalization of it", "a ---------------------------- rule", "call getDefaultValueFromParent now"]
    assert not any(S.Scanner(S.default_model()).scan(plain))

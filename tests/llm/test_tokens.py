"""Token ids, packing and the token file against the library itself and exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewright.llm import huffman, packing
from tidewright.llm.common import scratch_path
from tidewright.llm.tokens import Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "  two  spaces ", "a\n\nb", "a \n b", "\n", "tab\tx", "x y", "x\x1cy", "x\x01y \x01", "don't we'll 's", "<|endoftext|> <|startoftext|>a",
       "éte ́x", "ΑΣ ΣΑΣ", "12 345", "a b　 c", "日本 語", "😀 x😀", "a" * 3000, "A B  C\r\n d", "\x85q \x0b\x0c"]


def plain(name, text):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    t = Tokenizer.from_file(P.path(request.param))
    t.encode_special_tokens = True
    return t, Encoder(P.path(request.param), limit=700)


def same(pair, texts):
    t, enc = pair
    for text, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_equal_whole_texts(pair):
    assert pair[1].split is not None
    same(pair, ODD)
    same(pair, pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sAé́Σ1.,\x01\x1c "), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_pieces_equal_whole_texts_any(pair, texts):
    same(pair, texts)


def test_packing_keeps_every_id_once(spark, make_docs):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta!", "x9"]
    texts = [" ".join(rng.choice(words, n)) for n in [0, 1, 5, 400, 1500, 2047, 2048, 9000, *rng.integers(1, 900, 60)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (5, texts[5])]
    out = packing.pack_documents(make_docs(rows).repartition(2), P.path("word_bpe_49k.json")).collect()
    seq = defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) // 4 > 0
        seq[r.sequence_id].append(r)
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    for i, t in rows:
        want = plain("word_bpe_49k.json", t or "") + [1]
        got, copies = sorted(by_doc[i], key=lambda r: r.start), 2 if i == 5 else 1
        assert sum(r.length for r in got) == copies * len(want)
        if copies == 1:
            assert [x for r in got for x in np.frombuffer(r.ids, "<u4").tolist()] == want
            assert {r.doc_tokens for r in got} == {len(want)}
    assert packing.pack_documents(make_docs([]), P.path("word_bpe_49k.json")).count() == 0


def test_sum_of_squares_picks_the_least_cost():
    p = packing.SumOfSquares(10, 50)
    rng = np.random.default_rng(2)
    for n in rng.integers(1, 10, 400).tolist():
        before = p.levels.copy()
        level = p.level_for(n)

        def cost(at):
            c = before.copy()
            if at:
                c[at] -= 1
            if at + n < 10:
                c[at + n] += 1
            return int((c**2).sum())

        options = [0] * (p.open < 50) + [k for k in range(1, 10) if before[k] and k + n <= 10]
        assert cost(level) == min(map(cost, options))
        list(p.add(0, np.zeros(n, "<u4").tobytes()))


def plain_pack(docs, size):
    """Windows of (doc, start, length), by the rule alone: every level tried, sums of squares added up anew each time."""
    windows, out = [], []

    def squares(fills):
        return sum(fills.count(f) ** 2 for f in set(fills) if 0 < f < size)

    def place(doc, start, n, may_open):
        while n:
            fills = [sum(p[2] for p in w) for w in windows]
            options = []
            for f in sorted(set(fills), reverse=True):
                if f + n <= size:
                    rest = list(fills)
                    rest[rest.index(f)] = f + n
                    options.append((squares(rest), 0, -f, f))
            if may_open or not windows:
                options.append((squares([*fills, n]), 1, 0, 0))
            take, f = n, 0
            if options:
                f = min(options)[3]
            else:
                f = max(fills)
                take = size - f
            if f == 0:
                windows.append([])
                w = windows[-1]
            else:
                w = next(w for w in reversed(windows) if sum(p[2] for p in w) == f)
                windows.remove(w)
                windows.append(w)  # the one filled last is taken first
            w.append((doc, start, take))
            if f + take == size:
                windows.remove(w)
                out.append(w)
            start, n = start + take, n - take

    for doc, n in docs:
        full = n // size
        out.extend([(doc, i * size, size)] for i in range(full))
        place(doc, full * size, n - full * size, True)
    while len(windows) > 1:
        low = min(sum(p[2] for p in w) for w in windows)
        w = next(w for w in reversed(windows) if sum(p[2] for p in w) == low)
        windows.remove(w)
        for p in w:
            place(*p, False)
    rest = [p for w in windows for p in w]
    left = sum(p[2] for p in rest)
    while left:
        goal, window = 1 << (left.bit_length() - 1), []
        while goal:
            doc, start, n = rest.pop(0)
            k = min(n, goal)
            window.append((doc, start, k))
            if k < n:
                rest.insert(0, (doc, start + k, n - k))
            goal, left = goal - k, left - k
        out.append(window)
    return out


@pytest.mark.parametrize("size, n", [(16, 60), (64, 150), (10, 1), (32, 0)])
def test_layout_against_plain_packing(size, n):
    rng = np.random.default_rng(size + n)
    docs = [(i, int(k)) for i, k in enumerate(rng.integers(0, 2 * size, n))]
    packer = packing.SumOfSquares(size)
    got = [w for doc, k in docs for w in packer.add(doc, bytes(4 * k))] + list(packer.close())
    assert sorted([(d, s, len(b) // 4) for d, s, b, _ in w] for w in got) == sorted(plain_pack(docs, size))


def test_little_padding_at_any_size():
    rng = np.random.default_rng(1)
    for n in (3, 40, 1000):
        packer = packing.SumOfSquares()
        sizes = [int(k) for k in rng.lognormal(6, 1.2, n)]
        windows = [w for i, k in enumerate(sizes) for w in packer.add(i, bytes(4 * k))] + list(packer.close())
        fills = [sum(len(p[2]) // 4 for p in w) for w in windows]
        assert sum(fills) == sum(sizes) and all(f == 2048 or f & (f - 1) == 0 for f in fills) and sum(f < 2048 for f in fills) <= 11


@pytest.mark.parametrize("limit", [4, 6, 16])
def test_code_lengths_are_best(limit):
    rng = np.random.default_rng(limit)
    counts = rng.integers(1, 1000, 14) ** 3
    counts[3] = 0
    bits = huffman.code_lengths(counts, limit)
    assert bits.max() <= limit and bits[3] == 0 and sum(2.0 ** -int(b) for b in bits if b) == 1
    import heapq
    heap, free = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        free += a
        heapq.heappush(heap, a)
    cost = int((counts * bits).sum())
    assert cost >= free and (limit < 16 or cost == free)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=700))
def test_blocks_round_trip(ids):
    a = np.array(ids)
    bits = huffman.code_lengths(np.bincount(a, minlength=301), 10)
    total, offsets, data = huffman.encode_block(a, bits, huffman.canonical(bits))
    assert huffman.Decoder(bits).decode(data, offsets, len(a)).tolist() == ids


@pytest.mark.parametrize("most", [100_000, 0])
def test_token_file_round_trip(spark, make_docs, most, monkeypatch):
    monkeypatch.setattr(huffman, "BROADCAST_PARTS", most)
    rows = [(7, "hello  world\n"), (3, None), (None, "no id"), (12, ""), (5, "word " * 40000), (5, "word"), (-2, "é😀 <|endoftext|>")]
    path = scratch_path(spark, "t")
    huffman.write_tokens(make_docs(rows).repartition(3), path, P.path("byte_bpe_50k.json"), end_id=2)
    got = huffman.read_tokens(spark, path).collect()
    want = sorted(((-1e9 if i is None else i, plain("byte_bpe_50k.json", t or "") + [2]) for i, t in rows), key=lambda x: x[0])
    assert sorted((-1e9 if r.doc_id is None else r.doc_id, zlib.crc32(r.ids), r.n_tokens) for r in got) == sorted((k, zlib.crc32(np.asarray(x, "<u4").tobytes()), len(x)) for k, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, -2, 3, 5, 5, 7, 12]
    empty = scratch_path(spark, "t")
    huffman.write_tokens(make_docs([]), empty, P.path("byte_bpe_50k.json"), end_id=2)
    assert huffman.read_tokens(spark, empty).count() == 0


def test_blocks_hold_whole_documents(monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 10)
    sizes = [0, 3, 4, 5, 0, 40, 1, 9, 1, 0, 2]
    rows = [(i, np.arange(k, dtype="<u2").tobytes()) for i, k in enumerate(sizes)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[a:b]]), pa.array([r[1] for r in rows[a:b]], pa.binary())], names=["doc_id", "ids"]) for a, b in ((0, 4), (4, 4), (4, 11))]
    got = [(keys, n.tolist(), ids.tolist()) for keys, n, ids in huffman.blocks_of(iter([batches[0], batches[1], batches[2].slice(0, 3), batches[2].slice(3)]), "<u2")]
    assert [k for keys, _, _ in got for k in keys] == list(range(11)) and [x for _, n, _ in got for x in n] == sizes
    assert [x for _, _, ids in got for x in ids] == [x for k in sizes for x in range(k)] and all(len(ids) >= 10 for _, _, ids in got[:-1])


def test_registered_queries(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = {r.doc_id: r for r in huffman.op10_token_output(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for i, t in docs:
        ids = plain("byte_bpe_50k.json", t) + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    pieces = packing.op6_packing(spark, "/root/testdata/sf0.001").collect()
    ids = {i: plain("word_bpe_49k.json", t) + [1] for i, t in docs}
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
    for r in pieces:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())

"""Token ids as canonical, length-limited Huffman codes in independent blocks.

A token file is a folder with parquet tables: ``codebook`` (id, bits), the code lengths from the
corpus's counts, and ``blocks`` (part, block, n_ids, payload). Parts are ranges of document ids in ascending
order; ``parts`` (part, start) has the ids before each. A payload is, little-endian:

    "TWH1" | documents u32 | ids u32 | bits u64 | ids before the block within its part u64
    | document ids i64 each | null flags u8 each | ids of each document u32
    | bit offset of every 128th id u32 | code bits, the first in the highest bit of a byte

Blocks hold whole documents. A reader builds one table over all ``limit``-bit strings and decodes the
lanes between bit-offset checkpoints side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import materialize, release, scratch_path, small_batches, table, tidy
from tidewright.llm.tokens import chunks, encoder

STRIDE, BLOCK = 128, 1 << 17
BROADCAST_PARTS = 100_000
#: Bytes of token ids in a part, about.
PART = 64 << 20
HEAD = struct.Struct("<4sIIQQ")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits of each id by package-merge: the best prefix code whose codes have at most ``limit`` bits."""
    bits = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        bits[used] = 1
        return bits
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.float64)
    leaf_first, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        leaf_first.append(rank < len(weight))
        both = both[rank]
        packages = both[0 : len(both) // 2 * 2 : 2] + both[1::2]
    take = 2 * len(order) - 2
    for is_leaf in reversed(leaf_first):
        leaves = int(is_leaf[:take].sum())
        bits[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return bits


def canonical(bits: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id."""
    codes = np.zeros(len(bits), dtype=np.uint64)
    code = last = 0
    for i in np.lexsort((np.arange(len(bits)), bits)):
        if n := int(bits[i]):
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def encode_block(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """(bits in all, bit offset of every 128th id, packed bits)."""
    n = bits[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    total = int(ends[-1]) if len(ids) else 0
    v = codes[ids] << (32 - n - (at & 7)).astype(np.uint64)
    byte, size = at >> 3, (total + 7) // 8 + 4
    out = np.zeros(size)
    for k in range(4):  # codes share no bit, so adding is setting
        out += np.bincount(byte + k, weights=(v >> np.uint64(24 - 8 * k)) & np.uint64(255), minlength=size)
    return total, at[::STRIDE].astype("<u4"), out.astype(np.uint8)[: (total + 7) // 8].tobytes()


class Decoder:
    def __init__(self, bits: np.ndarray):
        self.limit = max(1, int(bits.max(initial=1)))
        self.symbol = np.zeros(1 << self.limit, dtype=np.uint32)
        self.length = np.zeros(1 << self.limit, dtype=np.int64)
        at = 0
        for i in np.lexsort((np.arange(len(bits)), bits)):  # canonical codes fill the table in this order
            if n := int(bits[i]):
                span = 1 << (self.limit - n)
                self.symbol[at : at + span], self.length[at : at + span] = i, n
                at += span

    def decode(self, data: bytes, offsets: np.ndarray, count: int) -> np.ndarray:
        buf = np.frombuffer(data + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        win = (buf[:-3] << 24) | (buf[1:-2] << 16) | (buf[2:-1] << 8) | buf[3:]
        at = offsets.astype(np.int64)
        out = np.zeros((STRIDE, len(at)), dtype=np.uint32)
        drop = np.uint32(32 - self.limit)
        full = count // STRIDE
        for k in range(STRIDE):
            lanes = at if k < count - full * STRIDE else at[:full]
            if not len(lanes):
                break
            i = (win[lanes >> 3] << (lanes & 7).astype(np.uint32)) >> drop
            out[k, : len(lanes)] = self.symbol[i]
            lanes += self.length[i]  # a view, so this moves the lane on
        return out.T.reshape(-1)[:count]


def pack_payload(docs: list, counts: np.ndarray, ids: np.ndarray, before: int, bits: np.ndarray, codes: np.ndarray) -> bytes:
    total, offsets, data = encode_block(ids, bits, codes)
    null = np.array([d is None for d in docs], dtype=np.uint8)
    keys = np.array([d or 0 for d in docs], dtype="<i8")
    return HEAD.pack(b"TWH1", len(docs), len(ids), total, before) + keys.tobytes() + null.tobytes() + counts.astype("<u4").tobytes() + offsets.tobytes() + data


def open_payload(payload: bytes, decoder: Decoder) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc id, ids before it within the part, its ids) for every document of a block."""
    magic, n_docs, n_ids, _, before = HEAD.unpack_from(payload)
    if magic != b"TWH1":
        raise ValueError("not a token block")
    p = HEAD.size
    keys = np.frombuffer(payload, "<i8", n_docs, p).tolist()
    null = payload[p + 8 * n_docs : p + 9 * n_docs]
    counts = np.frombuffer(payload, "<u4", n_docs, p + 9 * n_docs).tolist()
    p += 13 * n_docs
    lanes = -(-n_ids // STRIDE)
    ids = decoder.decode(payload[p + 4 * lanes :], np.frombuffer(payload, "<u4", lanes, p), n_ids)
    at = 0
    for key, no, n in zip(keys, null, counts, strict=True):
        yield None if no else key, before + at, ids[at : at + n]
        at += n


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    held, columns = 0, [[] for _ in schema]
    for row in rows:
        for c, v in zip(columns, row, strict=True):
            c.append(v)
        held += weigh(row)
        if held > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            held, columns = 0, [[] for _ in schema]
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def blocks_of(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, ids of each, all their ids) of blocks of whole documents, from (doc_id, ids) batches in order."""
    width, n = np.dtype(kind).itemsize, 0
    keys, counts, ids = [], [], []
    for batch in batches:
        key, data = batch.column(0).to_pylist(), batch.column(1)
        ends = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, 4 * data.offset).astype(np.int64) // width
        flat = np.frombuffer(data.buffers()[2], kind, int(ends[-1])) if len(data) and ends[-1] else np.zeros(0, kind)
        i = 0
        while i < len(data):
            j = min(len(data), max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK - n))))
            keys += key[i:j]
            counts.append(np.diff(ends[i : j + 1]))
            ids.append(flat[ends[i] : ends[j]].copy())  # the batch's memory goes with the batch
            n += len(ids[-1])
            if n >= BLOCK:
                yield keys, np.concatenate(counts), np.concatenate(ids)
                keys, counts, ids, n = [], [], [], 0
            i = j
    if keys:
        yield keys, np.concatenate(counts), np.concatenate(ids)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> None:
    """Encode whole texts and write them as a token file, ascending by document id.

    A null text is empty; ``end_id``, if given, ends every document; null ids come first; rows with
    equal ids stay, ordered by a hash of the text, then by token ids; a very long text is one row of
    ids in a block of its own; other columns are ignored; an empty table makes an empty file.

    Texts are encoded where they are read, and counted in the same pass (a row of counts for each task,
    summed before anything reaches the driver, which gets one number for each id of the vocabulary).
    One range shuffle, of token ids of two bytes, brings documents in order; compressing follows in the
    tasks that it ends in.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocab = max(encoder(tokenizer).vocab, (end_id or 0) + 1)
    kind = "<u2" if vocab <= 1 << 16 else "<u4"
    limit = max(16, (vocab - 1).bit_length()) + 2
    coded = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("ids", pa.binary()), ("used", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = encoder(tokenizer), np.zeros(vocab, np.int64)
        end = np.asarray([] if end_id is None else [end_id], kind).tobytes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts):
                ids = []
                for x in enc.encode(texts[a:b]):
                    x = np.frombuffer(x, "<u4")
                    ids.append(x.astype(kind).tobytes() + end)
                step = np.frombuffer(b"".join(ids), kind)
                total += np.bincount(step, minlength=vocab)
                none = pa.nulls(b - a, coded.field(3).type), pa.nulls(b - a, coded.field(4).type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(ids, pa.binary()), *none], schema=coded)
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_pylist([{"used": used.tolist(), "times": total[used].tolist()}], schema=coded)
        tidy()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = materialize(d.mapInArrow(tokenise, "doc_id long, tie long, ids binary, used array<int>, times array<long>"), "ids")
    counts = np.zeros(vocab, dtype=np.int64)
    tally = rows.where("used IS NOT NULL").select(F.explode(F.arrays_zip("used", "times")).alias("x")).groupBy("x.used").agg(F.sum("x.times").alias("n"))
    for row in tally.collect():  # one row for each id of the vocabulary
        counts[row["used"]] = row["n"]
    bits = code_lengths(counts, limit)
    spark.createDataFrame(pa.table({"id": np.arange(vocab), "bits": bits.astype(np.int32)})).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((bits, canonical(bits)))
    made = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, codes = shared.value
        part = TaskContext.get().partitionId()

        def payloads() -> Iterator[tuple]:
            before = 0
            for block, (keys, n, ids) in enumerate(blocks_of(batches, kind)):
                yield part, block, len(ids), pack_payload(keys, n, ids.astype(np.int64), before, bits, codes)
                before += len(ids)

        yield from _batches(payloads(), made, lambda r: len(r[3]))
        tidy()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, int(counts.sum()) * np.dtype(kind).itemsize // PART))
    d = rows.where("used IS NULL").select("doc_id", "tie", "ids").repartitionByRange(n, *order).sortWithinPartitions(*order, "ids").select("doc_id", "ids")
    d.mapInArrow(compress, "part int, block long, n_ids long, payload binary").write.parquet(f"{path}/blocks")
    release(rows)
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of ids
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a token file; ids as unsigned 32-bit little-endian bytes.

    ``start`` counts the ids of all documents before it. Blocks are decoded where they are read;
    only the table of parts, a row for each, is joined.
    """
    rows = spark.read.parquet(f"{path}/codebook").collect()  # one for each id of the vocabulary
    bits = np.zeros(len(rows), dtype=np.uint8)
    for r in rows:
        bits[r["id"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bits)
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for part, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for doc, before, ids in open_payload(payload.as_py(), decoder):
                        yield part, doc, before, len(ids), ids.astype("<u4").tobytes()

        yield from _batches(rows(), schema, lambda r: len(r[4]))
        tidy()

    docs = spark.read.parquet(f"{path}/blocks").select("part", "payload").mapInArrow(expand, "part int, doc_id long, before long, n_tokens long, ids binary")
    parts = spark.read.parquet(f"{path}/parts")
    if parts.count() <= BROADCAST_PARTS:  # one row of two numbers for each part
        parts = F.broadcast(parts)
    return docs.join(parts, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def op10_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

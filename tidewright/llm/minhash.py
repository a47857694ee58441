"""Near-duplicate texts by b-bit MinHash: band candidates, bit counts, exact confirmation.

1. One pass over whole texts makes each document's set of shingle hashes, its 128 minima, band keys
   (for 0.8, 32 of four minima each), and a signature of the low two bits of every minimum (32 bytes).
2. Documents with equal sets are one class, represented by its smallest id.
3. Classes that share a band key are candidates. The share of equal two-bit cells, less what chance
   makes equal, estimates similarity; candidates below a margin under the threshold go.
4. The rest is confirmed on full sets, and confirmed links are joined to components.

Candidates are never listed as all pairs. Each class is tried against the smallest member of each of
its band buckets; the pairs whose estimate passes join classes to loose clusters, and pairs of one
bucket that pass between clusters join those too, so every candidate lies inside one cluster. The
likeliest of these pairs is confirmed for each class, which settles most clusters: what is linked needs
no second look. In the others, what lies in different components is compared on full sets, block
against block, and a block pair gives back a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import forest, joined_up, materialize, release, settle, small_batches, table, tidy

HASHES, BITS = 128, 2
#: Chance that a pair at the threshold shares no band, at most.
MISS = 1e-6
#: Documents in a block of an exact comparison, and shingles, about; of the two the one reached first.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Members of one bucket that meet in one task of the candidate search.
MEET = 256
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[2]
    x = (x ^ (x >> np.uint64(32))) * _MIX[2]
    return x ^ (x >> np.uint64(32))


def rows_of_band(percent: int) -> int:
    """Minima in a band: as many as leave a pair at the threshold a chance of ``MISS`` to share none."""
    s = percent / 100
    return max([r for r in (1, 2, 4, 8, 16) if (1 - s**r) ** (HASHES // r) <= MISS], default=1)


def least_estimate(percent: int) -> float:
    """Estimated similarity that a candidate needs: 5 standard deviations of the estimate under the threshold."""
    chance = 0.5**BITS
    same = percent / 100 * (1 - chance) + chance
    return percent / 100 - 5 * math.sqrt(same * (1 - same) / HASHES) / (1 - chance)


class Shingler:
    """Sets of word-shingle hashes (64 bits) of whole texts; words by ASCII white space, A-Z lowered."""

    def __init__(self, width: int, limit: int = 100_000):
        self.width, self.limit, self.cache = width, limit, {}

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        try:
            h = np.array([cache[w] for w in words], np.uint64)
        except KeyError:
            if len(cache) > self.limit:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = xxhash.xxh64_intdigest(w)
            h = np.array([cache[w] for w in words], np.uint64)
        k = min(self.width, len(words))
        s = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            s = _scramble(s * _MIX[0] + _MIX[1]) ^ h[i : len(h) - k + 1 + i]
        return np.unique(_scramble(s + np.uint64(k)))


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over each non-empty set, (sets, hashes) of 32 bits."""
    out = np.zeros((len(sets), len(a)), np.uint32)
    i = 0
    while i < len(sets):  # runs of sets that stay in the processor's cache
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 1 << 14):
            n += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        at = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
        for k in range(len(a)):
            out[i:j, k] = np.minimum.reduceat(((x * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), at)
        i = j
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, signature) per row; the last three are null for empty sets. rows: minima in a band."""
    rng = np.random.default_rng(42)
    a = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingler.shingles(t or "") for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                m = minima(full, a, b)
                bands = np.zeros((len(full), HASHES // rows), np.uint64)
                for r in range(rows):
                    bands = _scramble(bands * _MIX[0] + m[:, r::rows].astype(np.uint64) + _MIX[1])
                bands = _scramble(bands + np.arange(HASHES // rows, dtype=np.uint64)).view(np.int64)
                cells = (m & np.uint32(3)).astype(np.uint64).reshape(len(full), HASHES * BITS // 64, 64 // BITS)
                packed = (cells << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64).view(np.int64)
                made = iter(zip(bands.tolist(), packed.tolist(), strict=True))
                pairs = [next(made) if len(s) else (None, None) for s in sets]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                    pa.array([p[0] for p in pairs], pa.list_(pa.int64())), pa.array([p[1] for p in pairs], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands", "signature"])
        tidy()

    return d.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, signature array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, shingles array<long>) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingler.shingles(t or "").view(np.int64) for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                flat = pa.array(np.concatenate(sets)) if sets else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "shingles"])
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, shingles array<long>")


def likeness(a, b):
    """Collision-corrected similarity of two signatures: equal two-bit cells by bit counts, less chance."""
    words = HASHES * BITS // 64
    differ = sum(F.bit_count((F.get(a, i).bitwiseXOR(F.get(b, i))).bitwiseOR(F.shiftrightunsigned(F.get(a, i).bitwiseXOR(F.get(b, i)), 1)).bitwiseAND(F.lit(0x5555555555555555))) for i in range(words))
    chance = 0.5**BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets have 100 * intersection >= percent * union.

    Sets travel once for each pair they are in; the joins on a frequent id may be split.
    """
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over slices of the shared shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingle, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = count[at] > 1
    owner, at = owner[use], shared[at[use]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        out += m @ m.T
    return out


def compare_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside clusters, as spanning forests, from (id, cluster, root, shingles) rows.

    Members of a cluster's largest component need no comparison among themselves; all others are compared
    with everything. Both kinds are dealt into blocks of about 256 members or 400,000 shingles, and a task
    takes two blocks. Small clusters are whole, several to a task, as many as have a block's shingles.
    """
    weight = F.size("shingles").cast("long").alias("w")
    size = members.select("cluster", "root", weight).groupBy("cluster", "root").agg(F.count("*").alias("k"), F.sum("w").alias("w")).groupBy("cluster").agg(
        F.sum("k").alias("n"), F.sum("w").alias("w"), F.max(F.struct("k", "root", "w")).alias("top"))
    # a table of its own: a join with it can be split where a cluster is large
    size = materialize(size.select("cluster", "n", "w", F.col("top.k").alias("settled"), F.col("top.w").alias("settled_w"), F.col("top.root").alias("main")), "sizes")
    total = members.agg(F.sum(F.size("shingles").cast("long"))).first()[0] or 0
    m = members.join(size, "cluster")
    small = (F.col("n") <= BLOCK) & (F.col("w") <= BLOCK_SHINGLES)
    zero = F.col("root") == F.col("main")
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    n0, n1 = blocks(F.col("settled"), F.col("settled_w")), blocks(F.col("n") - F.col("settled"), F.col("w") - F.col("settled_w"))
    own = F.when(zero, -1 - F.pmod(F.xxhash64("id"), n0)).otherwise(F.pmod(F.xxhash64("id"), n1)).cast("int")
    m = m.withColumn("own", F.when(small, 0).otherwise(own))
    others = F.sequence(F.lit(0), n1 - 1)
    tasks = F.when(small, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).when(
        zero, F.transform(others, lambda k: F.struct(F.col("own").alias("i"), k.alias("j")))).otherwise(F.concat(
            F.transform(others, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))),
            F.transform(F.sequence(-n0, F.lit(-1)), lambda k: F.struct(k.cast("int").alias("i"), F.col("own").alias("j")))))
    bin_ = F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(1 + total // BLOCK_SHINGLES))).otherwise(F.col("cluster"))
    m = m.select("id", "cluster", "root", "shingles", "own", small.alias("small"), bin_.alias("bin"), F.explode(tasks).alias("t"))

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        ids, cluster, root = (group[c].to_numpy() for c in ("id", "cluster", "root"))
        sets = [np.asarray(x.values) for c in group["shingles"].chunks for x in c]
        found_a, found_b = [], []
        for c in np.unique(cluster):
            at = np.flatnonzero(cluster == c)
            at = at[np.argsort(ids[at], kind="stable")]
            if len(at) < 2 or (root[at] == root[at[0]]).all():
                continue
            common = overlaps([sets[k] for k in at])
            n = np.array([len(sets[k]) for k in at], np.float64)
            linked = (100 * common >= percent * (n[:, None] + n[None] - common)) & (root[at][:, None] != root[at][None])
            top = settle(linked)
            child = np.flatnonzero(top != np.arange(len(at)))
            found_a.append(ids[at[child]])
            found_b.append(ids[at[top[child]]])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *found_a]), "b": np.concatenate([none, *found_b])})

    return m.select("id", "cluster", "root", "shingles", "small", "bin", F.col("t.i").alias("i"), F.col("t.j").alias("j")).groupBy("small", "bin", "i", "j").applyInArrow(compare, "a long, b long")


def across_clusters(cells: DataFrame, clusters: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """(a, b) of loose clusters that a pair of one bucket joins, its estimate passing.

    Only buckets with members of several clusters are looked at. A bucket of more than 256 members is dealt
    into blocks, and a pair of blocks is a join key of its own, so no task takes a whole large bucket.
    """
    known = cells.select("cell", "rep").join(clusters.toDF("rep", "cluster"), "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
    mixed = known.groupBy("cell").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = materialize(mixed.select("cell", F.ceil(F.col("n") / MEET).cast("int").alias("blocks")), "mixed")
    members = materialize(known.join(mixed, "cell").join(signatures, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "open")
    x = members.select("cell", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("cluster").alias("ca"), F.col("signature").alias("s"))
    y = members.select("cell", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("cluster").alias("cb"), F.col("signature").alias("t"))
    pairs = x.join(y, ["cell", "i", "j"]).where((F.col("ca") != F.col("cb")) & (likeness(F.col("s"), F.col("t")) >= least))
    out = materialize(pairs.select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct(), "across")
    release(members)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; kept where the row has the smallest id of its component.

    width: words in a shingle. percent: least similarity (Jaccard), confirmed on full sets of 64-bit
    shingle hashes; bands follow from it. A text with fewer words than ``width`` is one shingle; null and
    blank texts have none and link with nothing; texts of any length are taken whole. Rows that share an
    id count as one document, each with the size of its own set; a null id links with nothing and has no
    component; other columns are ignored; an empty table gives no rows.

    Pairs of similarity 0.8 share no band with probability (1 - 0.8**4) ** 32 = 5e-8.
    """
    small_batches(docs.sparkSession)
    least = least_estimate(percent)
    rows = materialize(sketch(docs, id_col, text_col, width, rows_of_band(percent)), "sketch")
    classes = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.max("bands").alias("bands"), F.max("signature").alias("signature"))
    classes = materialize(classes, "classes", rows.count())
    cells = classes.select("rep", F.explode("bands").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last")
    shared = materialize(shared.select("cell", "first"), "shared", 8 * classes.count())
    # only cells of two classes and more; a class has a row for each band at most
    cells = materialize(cells.join(shared, "cell"), "cells", 8 * classes.count())
    release(shared)
    signatures = classes.select("rep", "signature")
    a_sig, b_sig = signatures.toDF("a", "s"), signatures.toDF("b", "t")
    stars = cells.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    stars = stars.join(a_sig, "a").join(b_sig, "b").withColumn("like", likeness(F.col("s"), F.col("t"))).where(F.col("like") >= least)
    stars = materialize(stars.select("a", "b", "like"), "stars", cells.count())
    best = materialize(stars.groupBy("a").agg(F.max_by("b", F.struct("like", -F.col("b"))).alias("b")), "best", stars.count())

    # loose clusters: every candidate that passes the estimate ends up inside one
    clusters = joined_up(materialize(forest(best), "labels"), stars.select("a", "b"))
    across = across_clusters(cells, clusters, signatures, least)
    if not across.isEmpty():
        clusters = joined_up(clusters, across)
    release(cells)
    release(stars)

    # full sets of what lies in clusters, and of nothing else
    need = clusters.select(F.col("node").alias("need"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(need, F.col("doc") == F.col("need"), "left_semi")
    sets = materialize(shingle_sets(texts, "doc", "text", width), "sets")
    links = materialize(confirm(best, sets, percent), "links")
    roots = materialize(forest(links), "roots")
    members = clusters.toDF("id", "cluster").join(roots.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    unsettled = members.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("cluster")
    unsettled = materialize(unsettled, "unsettled")
    members = materialize(members.join(unsettled, "cluster").join(sets, "id").select("id", "cluster", "root", "shingles"), "members")
    release(sets)
    more = materialize(compare_blocks(members, percent), "more")
    release(members)
    if not more.isEmpty():
        roots = joined_up(roots, more)
    found = classes.select("set_key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("set_key").alias("k"), F.coalesce("root", "rep").alias("root"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(found, F.col("set_key") == F.col("k"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)

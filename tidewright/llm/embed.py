"""Embedding near-dedup by collision counting on one-dimensional projections.

Equal vectors are one class first. Candidates come in tables: a table cuts q projections at zero, and
vectors on the same sides meet in one cell; q grows with the logarithm of the number of classes, and
the number of tables follows from it so that a pair at the threshold shares a cell almost surely.
Inside a cell, 32 more projections are sorted; a pair's count is how many of them have the second
vector within a window centred on the first. Pairs whose count passes (a count that pairs at the
threshold miss once in a thousand times) are verified by their cosine in double precision.

(Sorting whole tables on each projection and counting every window collision costs the square of the
rows: a window that keeps close pairs holds a quarter of all unrelated ones. Cells leave each count
as it is and bound the pairs that are counted.)

A pair is counted in the first table whose cell it shares, so neither pairs nor links are shuffled:
a cell yields, for each of its vectors, a number of links and one edge of a spanning forest. Collisions
are counted first; whether an earlier table has a pair is asked of those alone that pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import components, materialize, settle, table

#: Projections in a collision count, rows of a cell (about), rows of a block that one task takes, and
#: cells (a power of two) that go to a task together.
COUNTED, CELL, BLOCK, TOGETHER = 32, 200, 1024, 5
MISS = 0.001
#: Crowded cells, rows of four numbers, are broadcast up to so many.
BROADCAST_CELLS = 100_000


def plan(classes: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(cuts per table, tables): a pair at the threshold shares no cell with probability ``miss`` at most."""
    cuts = max(0, math.ceil(math.log2(max(1, classes) / CELL)))
    same = (1 - math.acos(cosine) / math.pi) ** cuts
    return cuts, 1 if same >= 1 else math.ceil(math.log(miss) / math.log(1 - same))


def calibrate(cosine: float, miss: float = MISS) -> tuple[float, int]:
    """(window half-width, count): projections of unit vectors at the threshold differ by a normal
    variable of variance 2 - 2 cosine; the width is its deviation, the count a binomial tail."""
    width = math.sqrt(2 - 2 * cosine)
    p, tail = math.erf(1 / math.sqrt(2)), 0.0
    for k in range(COUNTED + 1):
        tail += math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)
        if tail > miss:
            return width, k
    return width, COUNTED


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to largest component 1 (against overflow), then to length 1."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def collisions(x: np.ndarray, y: np.ndarray, width: float) -> np.ndarray:
    """For each row of x and y the number of projections (columns) where y lies in x's window.

    Each projection is sorted; a window is a run of places on it, from ``lo`` on, ``many`` long.
    """
    order = np.argsort(y, axis=0, kind="stable")
    line = np.ascontiguousarray(np.take_along_axis(y, order, 0).T)
    place = np.empty(y.shape, np.uint16)
    np.put_along_axis(place, order, np.arange(len(y), dtype=np.uint16)[:, None], 0)
    place = np.ascontiguousarray(place.T)
    out = np.zeros((len(x), len(y)), np.uint8)
    for j in range(x.shape[1]):
        lo = np.searchsorted(line[j], x[:, j] - width, "left").astype(np.uint16)
        many = np.searchsorted(line[j], x[:, j] + width, "right").astype(np.uint16) - lo
        out += (place[j][None] - lo[:, None]) < many[:, None]  # places before ``lo`` wrap around to large numbers
    return out


def type_of(vectors: DataFrame, column: str) -> str:
    return vectors.schema[column].dataType.simpleString()


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; kept where the row has the smallest id of its component.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor
    do vectors of different lengths; a null id links with nothing and has no component. Rows that share
    an id, with equal vectors or not, are vectors of their own, so their links are counted apart. Labels
    and other columns are ignored; an empty table gives no rows. A cell of more than 1,024 vectors is
    dealt out in pairs of blocks.
    """
    single = type_of(vectors, vector_col) == "array<float>"  # shuffled as they are, compared in double precision
    kind = "array<float>" if single else "array<double>"
    v = F.col(vector_col).cast(kind)
    ok = F.col(id_col).isNotNull() & F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(ok, v).alias("v")).withColumn("code", F.xxhash64("v"))
    classes = rows.where("v IS NOT NULL").groupBy("code", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")  # written, so the number stays a class's own
    cuts, tables = plan(classes.count(), cosine)
    width, least = calibrate(cosine)

    def planes(dim: int, k: int, what: int) -> np.ndarray:
        return np.random.default_rng([seed, what, dim]).normal(size=(dim, k))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.array([len(x) for x in b.column(0).to_pylist()]) if b.num_rows else np.zeros(0, int)
            out = np.zeros((b.num_rows, tables), np.int32)
            for dim in set(size.tolist()):
                at = np.flatnonzero(size == dim)
                x = unit(np.array(b.column(0).take(pa.array(at)).flatten()).reshape(-1, dim))
                side = (x @ planes(dim, max(1, cuts * tables), 0) > 0)[:, : cuts * tables].reshape(len(at), tables, cuts)
                out[at] = (side << np.arange(cuts)).sum(2)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat, pa.array(size, pa.int32())], names=["v", "rep", "n", "cells", "dim"])

    coded = materialize(classes.select("v", "rep", "n").mapInArrow(cells, f"v {kind}, rep long, n long, cells array<int>, dim int"), "cells")
    met = coded.select("v", "rep", "n", "cells", "dim", F.posexplode("cells").alias("t", "cell"))
    # only crowded cells are known by size: a row for each, so mostly none
    sizes = coded.select("dim", F.posexplode("cells").alias("t", "cell")).groupBy("dim", "t", "cell").agg(F.count("*").alias("size"))
    crowded = materialize(sizes.where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size"), "crowded")
    n_crowded = crowded.count()
    if n_crowded:
        met = met.join(F.broadcast(crowded) if n_crowded <= BROADCAST_CELLS else crowded, ["dim", "t", "cell"], "left")
    met = met.withColumn("blocks", F.coalesce("blocks", F.lit(1)) if n_crowded else F.lit(1)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = F.when(F.col("blocks") > 1, -1 - F.col("cell")).otherwise(F.shiftright("cell", TOGETHER)).alias("g")
    met = met.select("dim", "t", dealt, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cell", "own", "rep", "n", "v", "cells")

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        dim, t, _, i, j = (k.as_py() for k in key)
        cell, own, rep, n = (group[c].to_numpy() for c in ("cell", "own", "rep", "n"))
        x = np.concatenate([np.asarray(c.flatten()) for c in group["v"].chunks]).reshape(-1, dim).astype(np.float64)
        shadow = unit(x) @ planes(dim, COUNTED, 1)
        order = np.lexsort((own, cell))
        cuts_ = np.flatnonzero(np.diff(cell[order])) + 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in np.split(order, cuts_):
            left, right = (at, at) if i == j else (at[own[at] == i], at[own[at] == j])
            if len(at) < 2 or not len(left) or not len(right):
                continue
            close = collisions(shadow[left], shadow[right], width) >= least
            if i == j:  # both directions of a pair by one decision, and no vector with itself
                close = np.triu(close | close.T, 1)
            p, q = np.nonzero(close)
            a.append(left[p])
            b.append(right[q])
        a, b = np.concatenate(a), np.concatenate(b)
        code = np.concatenate([np.asarray(c.flatten()) for c in group["cells"].chunks]).reshape(-1, tables)
        for s in range(t):  # what an earlier table has is counted there
            if not len(a):
                break
            fresh = code[a, s] != code[b, s]
            a, b = a[fresh], b[fresh]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        size = np.sqrt((x * x).sum(axis=1))
        good = [np.einsum("ij,ij->i", x[a[k : k + 65536]], x[b[k : k + 65536]]) / (size[a[k : k + 65536]] * size[b[k : k + 65536]]) >= cosine for k in range(0, len(a), 65536)]
        if good:
            a, b = a[np.concatenate(good)], b[np.concatenate(good)]
        has = np.unique(np.concatenate([a, b]))  # those with a link; smallest numbers first below
        has = has[np.argsort(rep[has], kind="stable")]
        place = np.zeros(len(rep), np.int64)
        place[has] = np.arange(len(has))
        linked = np.zeros((len(has), len(has)), bool)
        linked[place[a], place[b]] = linked[place[b], place[a]] = True
        links = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
        return pa.table({"rep": rep[has], "links": links[has].astype(np.int64), "root": rep[has][settle(linked)] if len(has) else rep[:0]})

    found = materialize(met.groupBy("dim", "t", "g", "i", "j").applyInArrow(meet, "rep long, links long, root long"), "links")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of = materialize(classes.select("code", "v", "rep", "least_id", (F.col("n") - 1).alias("same")).join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "linked")
    lowest = materialize(of.groupBy("root").agg(F.min("least_id").alias("component_id")), "lowest")  # a table, so a large root's join can be split
    of = of.join(lowest, "root").select(F.col("code").alias("c"), F.col("v").alias("w"), (F.col("same") + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(of, (F.col("code") == F.col("c")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))

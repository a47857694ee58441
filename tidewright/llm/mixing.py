"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash and queued, twice over. A copy's virtual finish time
is the source's words up to and with it, divided by the source's target; copies are served in order
of finish time until the total budget is spent. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import WORD_GAP, materialize, table

WEIGHTS, BUDGET, REPEATS = (3, 1, 2), 1.5, 2
#: Documents in one slice of a source's queue, about; and parts in which the cut is searched.
SLICE, PARTS = 500, 4096


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple, budget: float, repeats: int) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size).

    The budget share of a source is proportional to its weight, but at most ``repeats`` times its
    size; what a capped source leaves goes to the others by weight. Sources sorted by cap / weight,
    the first k of them are capped for the smallest k whose level the next source stays below.
    """
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", pick)
    s = s.withColumn("cap", F.col("source_size") * repeats)
    up = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    s = s.select("*", F.sum("source_size").over(Window.partitionBy()).alias("all"),
                 F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
                 F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))
    # the level if this source and all after it were not capped; it is capped if that exceeds its cap
    level = (F.lit(budget) * F.col("all") - F.col("capped"))
    s = s.withColumn("over", level * F.col("w") > F.col("cap").cast("double") * F.col("rest"))
    s = s.withColumn("level", F.min(F.when(~F.col("over"), F.struct(F.col("cap") / F.col("w"), "rank", level.alias("left"), "rest"))).over(Window.partitionBy()))
    share = F.when(F.col("over"), F.col("cap").cast("double")).otherwise(F.col("level.left") * F.col("w") / F.col("level.rest"))
    return s.select("source", "source_size", "rank", F.coalesce(share, F.lit(0.0)).alias("target"))


def slice_starts(sums: DataFrame) -> DataFrame:
    """(rank, slice, start) from (rank, slice, words): the words of a source before each of its slices.

    Summed in two levels, so that no task takes a source's slices: first runs of 4096 slices, then inside each.
    """
    run = F.floor(F.col("slice") / PARTS)
    up = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.groupBy("rank", run.alias("run")).agg(F.sum("words").alias("words"))
    runs = runs.select("rank", "run", F.coalesce(F.sum("words").over(up("rank").orderBy("run")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("words").over(up("rank", "run").orderBy("slice")), F.lit(0))
    return sums.withColumn("run", run).select("rank", "run", "slice", inside.alias("more")).join(runs, ["rank", "run"]).select("rank", "slice", (F.col("first") + F.col("more")).alias("start"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: str = "", carry: tuple = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row, plus the columns in ``carry``; taken counts repeats.

    ``weights`` go to the sources by code point, null last, repeating. A null text has no words; an
    empty document takes none. Rows with a null id are shuffled by a hash of their text. Equal rows are
    queued one after the other; texts of any length count whole. Other columns are ignored; an empty table gives no rows. Carried columns decide
    between rows of one id and size; they wait beside the queue and join it by a row number.

    The running sum of a source, however large, is taken in slices: sums per (source, slice) give
    each slice its start, and a window runs inside one slice only. The cut in the global order is
    found by narrowing an interval of finish times, with sums of at most 4096 parts at a time.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.xxhash64(text_col).cast("string")))
    key = F.md5(F.concat(F.lit(seed), name)).alias("key")
    number = [F.monotonically_increasing_id().alias("row"), F.xxhash64(*carry).alias("tie"), F.struct(*carry).alias("carried")] if carry else []
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key, *number), "mix")
    carried, rows = rows, rows.drop("carried")
    n = rows.count()
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = materialize(targets(sizes, weights, budget, repeats), "targets")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    slices = max(1, -(-n // SLICE))
    at = F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * slices / (1 << 28)).cast("long")
    t = t.withColumnRenamed("source", "of")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("slice", at)
    sums = rows.groupBy("rank", "slice").agg(F.sum("size").alias("words"))
    starts = slice_starts(sums)
    inside = Window.partitionBy("rank", "slice").orderBy("key", "doc_id", "size", *["tie", "row"][: len(number)]).rowsBetween(Window.unboundedPreceding, 0)
    q = rows.join(starts, ["rank", "slice"]).withColumn("cum", F.col("start") + F.sum("size").over(inside))
    q = materialize(q.select("doc_id", "source", "size", "source_size", "target", "rank", "key", "cum", *["row"][: len(number)]), "queue")

    finish = lambda e: (F.col("cum") + F.lit(e) * F.col("source_size")).cast("double") / F.col("target")
    place = lambda e: F.struct(finish(e).alias("finish"), F.lit(e).alias("copy"), "rank", "key", "cum", F.coalesce("doc_id", F.lit(-1)).alias("doc"))
    copies = q.where("size > 0 AND target > 0").select("size", F.explode(F.array(*[place(e) for e in range(repeats)])).alias("p")).select("size", "p.*")
    spent, lo, hi, limit = 0, 0.0, None, budget * total
    for _ in range(3):  # narrows to (lo, hi]; all copies up to lo fit the budget
        top = copies.agg(F.max("finish")).first()[0] if hi is None else hi
        if not top or top <= lo:
            break
        hi = top
        span = copies.where((F.col("finish") > lo) & (F.col("finish") <= hi))
        part = F.least(F.floor((F.col("finish") - F.lit(lo)) / F.lit((hi - lo) / PARTS)), F.lit(PARTS - 1))
        found = span.groupBy(part.alias("part")).agg(F.sum("size").alias("words"), F.min("finish").alias("first"), F.max("finish").alias("last"), F.count("*").alias("n")).orderBy("part").collect()
        for x in found:
            if spent + x["words"] > limit:
                hi = x["last"]
                break
            spent, lo = spent + x["words"], x["last"]
        else:
            hi = lo
            break
        if x["n"] <= SLICE or x["first"] == x["last"]:
            break
    edge = None
    if hi is not None and hi > lo:
        order = Window.orderBy("finish", "copy", "rank", "key", "cum", "doc").rowsBetween(Window.unboundedPreceding, 0)
        run = copies.where((F.col("finish") > lo) & (F.col("finish") <= hi)).withColumn("run", F.sum("size").over(order))
        edge = run.where(F.col("run") + spent <= F.lit(limit)).agg(F.max(F.struct("finish", "copy", "rank", "key", "cum", "doc"))).first()[0]
    fits = lambda e: finish(e) <= F.lit(lo)
    if edge is not None:
        cut = F.struct(*[F.lit(edge[k]).cast(copies.schema[k].dataType).alias(k) for k in ("finish", "copy", "rank", "key", "cum", "doc")])
        fits = lambda e: place(e) <= cut
    taken = sum((F.when(fits(e), F.col("size")).otherwise(0) for e in range(repeats)), F.lit(0).cast("long"))
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    out = q.withColumn("taken", F.when(F.col("target") > 0, taken).otherwise(F.lit(0)).cast("long"))
    if not carry:
        return out.select(names)
    return out.select("row", *names).join(carried.select("row", "carried"), "row").select(*names, *[F.col("carried")[c].alias(c) for c in carry])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2 AS cap FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
         CAST(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM s2),
s4 AS (SELECT *, CAST(1.5 AS DOUBLE) * total - capped AS lft, (CAST(1.5 AS DOUBLE) * total - capped) * w > CAST(cap AS DOUBLE) * rest AS over_cap FROM s3),
lev AS (SELECT lft, rest FROM s4 WHERE NOT over_cap ORDER BY cap / w, rank LIMIT 1),
t AS (SELECT source, source_size, rank, coalesce(CASE WHEN over_cap THEN CAST(cap AS DOUBLE) ELSE (SELECT lft FROM lev) * w / (SELECT rest FROM lev) END, 0) AS target FROM s4),
q AS (SELECT d.*, t.source_size, t.target, t.rank, CAST(sum(size) OVER (PARTITION BY t.rank ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e, CAST(cum + e * source_size AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) AS v(e) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, e, rank, key, cum ROWS UNBOUNDED PRECEDING) AS run FROM c),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE run <= CAST(1.5 AS DOUBLE) * (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target, coalesce(k.taken, 0) AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""

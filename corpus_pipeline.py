"""From documents to training sequences: five stages, each written and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, with the
columns of ``documents`` for all but the last. ``run`` applies them to a folder's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import materialize, table
from tidewright.llm.minhash import near_duplicates
from tidewright.llm.mixing import mix_sources
from tidewright.llm.packing import pack_documents
from tidewright.llm.quality import classify
from tidewright.llm.secrets import scan_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps, each judged for itself.

    A null or empty text is judged as an empty one; texts are judged whole; null and repeated ids, equal rows
    and null sources are rows like all others; columns beyond those of documents go; no rows give none.
    """
    judged = classify(docs, table(spark, sf_dir, "labels"), carry=("text", "lang", "source", "n_chars"))
    return judged.where("kept").select("doc_id", "carried.*").select(COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, 0.8): that with the smallest id, of equal ids the first.

    Rows are told apart by a number of their own, so copies with null or equal ids are found as well; null ids
    come last in a group. Texts without words link with nothing and stay; long texts are compared whole; no
    rows give none.
    """
    numbered = materialize(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered, id_col="row", width=5, percent=80).where("component_id IS NOT NULL").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    groups = materialize(groups, "groups")
    ids = numbered.select("row", "doc_id")
    # tables of their own: joins with them can be split where a group is large
    several = materialize(groups.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "several")
    members = materialize(groups.join(several, "component").join(ids, "row"), "members")
    first = materialize(members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")), "first")
    gone = members.join(first, "component").where("row <> first.row").select("row")
    return numbered.join(gone, "row", "left_anti").select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret in their texts replaced.

    A null text stays null, with no characters; null and repeated ids and equal rows stay; long texts are
    scanned whole; overlapping findings are replaced by one mark; no rows give none.
    """
    out = scan_secrets(docs, with_text=True, carry=("lang", "source"))
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.coalesce(F.length("redacted"), F.lit(0)).cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, each as often as it takes that row; null and repeated ids are rows like all others.

    Null and empty texts have no words and are not taken; null sources are a source, the last; ties and equal
    rows are queued one after the other; no rows give none.
    """
    mixed = mix_sources(docs, carry=("text", "lang", "n_chars")).where("taken > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 token ids.

    A null or empty text is its end id alone; long texts are cut into full windows and a rest; rows with null or
    repeated ids, and equal rows, are packed each for itself; no rows give none.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", dedup), ("secret scans", secrets), ("source mixing", mixing), ("packing", packing)]
#: The classifier, the network and the tokenizer have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)

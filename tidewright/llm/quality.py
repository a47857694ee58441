"""Quality classifier: document evidence shrunk towards host and path by hierarchical empirical Bayes.

Two logistic models over shape measures and telling words and word beginnings, one for quality and
one for toxicity, give each document a log-likelihood ratio for "good" (quality 1 and not toxic).
Grouped sums of the resulting posteriors give each host and each path a beta posterior: a host
shrinks towards the corpus, a path towards its host, by a strength that the spread between hosts
(paths) sets. A document is judged by its evidence and its path's prior together; its own posterior is
left out of the sums that make that prior, so that it does not count twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import materialize, small_batches, table, tidy

#: Labelled documents that the classifier is fitted on at most, taken by a hash of their id.
SAMPLE = 5000
#: Telling words and word beginnings that each model keeps, and labelled documents that one must occur in.
WORDS, SUPPORT = 128, 6
BEGINNINGS = (4, 5, 6)
N_SHAPE = 9
SYMBOLS = b"#*$%&|<>!@^~_=+{}[]\\"
PRIOR = 0.5


def measure(text: str) -> tuple[list[float], set[bytes]]:
    """Shape measures of a whole text, and its set of words (ASCII letters lowered, outer marks stripped)."""
    raw = text.encode()
    ws = raw.split()
    n = len(ws)
    if not n:
        return [0.0] * (N_SHAPE - 1) + [1.0], set()
    letters = len(raw) - n or 1
    distinct = set(raw.lower().split())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, ws, ws[1:]))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    pipes = ws.count(b"|")
    shape = [min(1.0, symbols / n), min(1.0, capitals / letters), pipes / n, same / n, 1 - len(distinct) / n if n < 50 else max(0.0, 0.6 - len(distinct) / n * min(1.0, n / 400)),
             1 - len(set(lines)) / len(lines), min(2.0, letters / n / 10), 1.0 if n < 5 else 0.0, 0.0]
    return shape, {w.strip(b".,;:!?\"'()") for w in distinct}


def features(words: set[bytes]) -> set[bytes]:
    """Words, and the first 4, 5 and 6 bytes of longer ones, marked with a star."""
    return words | {w[:k] + b"*" for w in words if len(w) > 4 for k in BEGINNINGS if len(w) > k}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton steps; both classes count alike, and the last column, the constant, is free."""
    n, pos = len(y), y.sum()
    weight = np.where(y > 0, n / 2 / pos, n / 2 / (n - pos)) / n
    free = np.full(x.shape[1], ridge)
    free[-1] = 1e-9
    v = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (weight * (p - y)) + free * v
        hess = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(free)
        step = np.linalg.solve(hess, grad)
        v -= step
        if np.abs(step).max() < 1e-4:
            break
    return v


class Model:
    """Logistic regression over shape measures and the presence of telling features; 0 without both classes."""

    def __init__(self, shapes: list[list[float]], found: list[np.ndarray], labels: list[int], names: list[bytes]):
        """found: the numbers of each document's features, into ``names``."""
        y, n = np.array(labels, dtype=np.float64), len(labels)
        self.tells: list[bytes] = []
        self.mean, self.spread, self.weights = np.zeros(N_SHAPE), np.ones(N_SHAPE), np.zeros(N_SHAPE + 1)
        if n and 0 < y.sum() < n:
            picked = self._pick(found, y, names)
            self.tells = [names[k] for k in picked]
            shape = np.array(shapes)
            self.mean, self.spread = shape.mean(0), shape.std(0) + 1e-3
            column = np.full(len(names), -1)
            column[picked] = np.arange(len(picked))
            x = np.zeros((n, N_SHAPE + len(picked) + 1))
            x[:, :N_SHAPE], x[:, -1] = (shape - self.mean) / self.spread, 1
            for i, f in enumerate(found):
                at = column[f]
                x[i, N_SHAPE + at[at >= 0]] = 1
            self.weights = logistic(x, y)
        self.of = dict(zip(self.tells, self.weights[N_SHAPE:-1].tolist(), strict=True))
        self.whole = {w for w in self.of if not w.endswith(b"*")}
        self.starts = {k: {w[:-1] for w in self.of if w.endswith(b"*") and len(w) == k + 1} for k in BEGINNINGS}

    @staticmethod
    def _pick(found: list[np.ndarray], y: np.ndarray, names: list[bytes]) -> list[int]:
        """The features with most mutual information with the label, ties by name."""
        n, pos = len(y), y.sum()
        flat = np.concatenate(found)
        owner = np.repeat(y, [len(f) for f in found])
        seen, good = np.bincount(flat, minlength=len(names)).astype(float), np.bincount(flat, owner, len(names))
        gain = np.zeros(len(names))
        for k, have, of in ((good, seen, pos), (seen - good, seen, n - pos), (pos - good, n - seen, pos), (n - pos - seen + good, n - seen, n - pos)):
            some = k > 0
            gain[some] += k[some] / n * np.log(k[some] * n / (have[some] * of))
        enough = np.flatnonzero((seen >= SUPPORT) & (seen <= n - SUPPORT))
        return sorted(enough.tolist(), key=lambda k: (-gain[k], names[k]))[:WORDS]

    def logit(self, shape: list[float], words: set[bytes], starts: dict[int, set[bytes]]) -> float:
        z = float((np.array(shape) - self.mean) / self.spread @ self.weights[:N_SHAPE]) + self.weights[-1]
        for w in words & self.whole:
            z += self.of[w]
        for k, found in starts.items():
            for w in found & self.starts[k]:
                z += self.of[w + b"*"]
        return z


class Classifier:
    """Evidence for a good document: a model of quality and one of toxicity, taken as independent."""

    def __init__(self, rows: Iterable[tuple[list[float], set[bytes], int, int]]):
        """rows: (shape, words, quality, toxic), taken one by one; equal ones count once. Features are kept as numbers."""
        number: dict[bytes, int] = {}
        once: dict[tuple, tuple] = {}
        for shape, words, good, bad in rows:
            found = np.sort(np.fromiter((number.setdefault(f, len(number)) for f in features(words)), np.int32))
            once[(tuple(shape), found.tobytes())] = (shape, found, good, bad)
        shapes, found, good, bad = (list(x) for x in zip(*once.values(), strict=True)) if once else ([], [], [], [])
        names = list(number)
        self.quality, self.toxic = Model(shapes, found, good, names), Model(shapes, found, bad, names)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Log-likelihood ratios of good against not; the models are fitted with even classes, so a logit is one."""
        q, x = np.zeros(len(texts)), np.zeros(len(texts))
        if not self.quality.tells and not self.toxic.tells:
            return q
        for i, t in enumerate(texts):
            shape, words = measure(t or "")
            starts = {k: {w[:k] for w in words if len(w) > k} for k in BEGINNINGS}
            q[i], x[i] = self.quality.logit(shape, words, starts), self.toxic.logit(shape, words, starts)
        if not self.quality.tells:
            q += 12 * bool(self.toxic.tells)
        if not self.toxic.tells:
            x -= 12 * bool(self.quality.tells)
        q, x = np.clip(q, -12, 12), np.clip(x, -12, 12)
        good = 1 / (1 + np.exp(-q)) / (1 + np.exp(x))
        return np.clip(np.log(good / (1 - good)), -12, 12)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, size: int = SAMPLE) -> Iterator[tuple[list[float], set[bytes], int, int]]:
    """Measures of at most ``size`` labelled documents, made where their texts are.

    Labels come down to ids by one ordered take, so the joined side has ``size`` rows at most and
    may be broadcast; per document the driver gets its shape and its distinct words.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.coalesce("toxic", F.lit(0)).cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(size)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("quality", "toxic", "text")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([b"\n".join(sorted(g[1])) for g in got], pa.binary())], names=["quality", "toxic", "shape", "words"])

    found = rows.mapInArrow(shapes, "quality int, toxic int, shape array<double>, words binary")
    return ((list(r["shape"]), set(bytes(r["words"]).split(b"\n")), r["quality"], r["toxic"]) for r in found.toLocalIterator())


def score(docs: DataFrame, model: Classifier, id_col: str, text_col: str, host_col: str, path_cols: tuple, carry: tuple = ()) -> DataFrame:
    """(doc_id, host, path, evidence[, carried]) per row: one pass over whole texts, nothing shuffled. carried: a struct of ``carry``."""
    path = F.to_json(F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate((host_col, *path_cols))]))
    more = [F.struct(*carry).alias("carried")] if carry else []
    d = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), path.alias("path"), *more)
    names = ["doc_id", "host", "path", *["carried"][: len(more)], "evidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.evidence(b.column(0).to_pylist()))], names=names)
        tidy()

    kind = f", carried {d.schema['carried'].dataType.simpleString()}" if carry else ""
    return d.mapInArrow(run, f"doc_id long, host string, path string{kind}, evidence double")


def _strength(groups: DataFrame, mean: Column | float, weight: str = "n", share: str = "p") -> float:
    """Beta strength by moments: how far group shares spread around their mean beyond chance. Three sums are collected."""
    m = mean if isinstance(mean, Column) else F.lit(mean)
    r = groups.where(f"{weight} > 0").agg(
        F.sum(F.col(weight) * (F.col(share) - m) ** 2).alias("spread"), F.sum(m * (1 - m)).alias("chance"),
        F.sum(F.col(weight) * m * (1 - m)).alias("total"), F.count("*").alias("k")).first()
    if not r["k"] or not r["total"]:
        return 100.0
    between = max(1e-4, (r["spread"] - r["chance"]) / r["total"])
    return float(min(1e4, max(2.0, 1 / between - 1)))


def judge(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add host_prior, path_prior, posterior and kept to (doc_id, host, path, evidence) rows.

    Sums by path combine on the map side, and hosts are sums of paths, so a host with a third of all
    rows is a few partial sums. Sums go back to the rows by a join on path, which adaptive execution may
    split where Spark does not broadcast them by their size; a row's own share is taken off there.
    """
    q = 1 / (1 + F.exp(-F.col("evidence")))
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(q).alias("s")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(np.clip(((total["s"] or 0) + 1) / ((total["n"] or 0) + 2), 0.02, 0.98))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    a = _strength(hosts.select(F.col("hn").alias("n"), (F.col("hs") / F.col("hn")).alias("p")), mean)
    both = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    shrunk = (F.col("hs") + a * mean) / (F.col("hn") + a)
    b = _strength(both.select("n", (F.col("s") / F.col("n")).alias("p"), shrunk.alias("host_prior")), F.col("host_prior"))
    # a table of its own: while it is small, rows with all they carry stay where they are
    sums = materialize(both.select(F.col("path").alias("of"), "n", "s", "hn", "hs"), "sums")
    out = scored.join(sums, F.col("path") == F.col("of"), "left").withColumn("own", q)
    out = out.withColumn("host_prior", (F.greatest(F.col("hs") - F.col("own"), F.lit(0.0)) + a * mean) / (F.col("hn") - 1 + a))
    out = out.withColumn("path_prior", (F.greatest(F.col("s") - F.col("own"), F.lit(0.0)) + b * F.col("host_prior")) / (F.col("n") - 1 + b))
    p = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("path_prior")))
    out = out.drop("of", "n", "s", "hn", "hs", "own").withColumn("posterior", 1 / (1 + F.exp(-(F.col("evidence") + F.log(p / (1 - p))))))
    return out.withColumn("kept", F.col("posterior") >= threshold - 1e-9)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_cols: tuple = ("lang",), threshold: float = PRIOR, carry: tuple = ()) -> DataFrame:
    """(doc_id, host, path, evidence, host_prior, path_prior, posterior, kept[, carried]) per row of ``docs``.

    ``labels`` has doc_id, quality, toxic; of several labels of a document the worst count. A null text
    is empty, and so is judged as one; a text of any length is judged whole; null hosts and paths are
    groups of their own; repeated rows and null ids stay, each judged for itself, equal ones alike; a
    posterior just at the threshold is kept. Other columns are ignored, but those in ``carry`` come
    back as the struct ``carried``. Without labels of both classes there is no evidence and every
    document is judged by an even prior. An empty table gives no rows. The classifier is fitted on at
    most 5,000 labelled documents; all else covers every row.
    """
    small_batches(docs.sparkSession)
    model = Classifier(labelled_sample(docs, labels, id_col, text_col))
    return judge(materialize(score(docs, model, id_col, text_col, host_col, path_cols, carry), "scores"), threshold)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

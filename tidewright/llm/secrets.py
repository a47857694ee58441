"""Secret scans: base patterns plus a character convolutional network over every candidate.

The network (numpy) reads a candidate with the characters around it: character embeddings and an
inside-the-candidate flag, one convolution, maximum and mean over positions, one logit. It is trained
on labelled findings, scaled on a held-out part (Platt), and its threshold is the highest that keeps
the asked recall there. Base findings always stay; the network adds spans that no base finding
overlaps.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import small_batches, table, tidy

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Characters before, inside and after a candidate that one window shows; longer candidates take several.
LEFT, INSIDE, RIGHT = 24, 40, 8
LENGTH = LEFT + INSIDE + RIGHT
CHARS, DIM, WIDTH, FILTERS = 98, 8, 5, 16


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping within each kind, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of 16 and more key characters, whatever they are made of."""
    if all(len(w) < 16 for w in text.split()):
        return []
    return [m.span() for m in CANDIDATE.finditer(text)]


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Rows of (character class, inside flag) pairs: one for each 40 characters of the candidate, overlapping by half."""
    out = []
    for a in range(start, max(start + 1, end - INSIDE // 2), INSIDE // 2):
        b = min(end, a + INSIDE)
        row = np.zeros((2, LENGTH), dtype=np.uint8)
        left, right = text[max(0, a - LEFT) : a], text[b : b + RIGHT]
        s = left + text[a:b] + right
        at = LEFT - len(left)
        code = np.frombuffer(s.encode("utf-32-le"), "<u4")
        row[0, at : at + len(s)] = np.where(code == 10, 97, np.where((code >= 32) & (code < 127), code - 30, 1))
        row[1, LEFT : LEFT + b - a] = 1
        out.append(row)
    return out


class CharConv:
    """One convolution over characters; trained by Adam on the logistic loss."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        k = WIDTH * (DIM + 1)
        self.p = {"e": rng.normal(0, 0.3, (CHARS, DIM)), "w": rng.normal(0, (2 / k) ** 0.5, (k, FILTERS)), "b": np.zeros(FILTERS), "v": rng.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        h = np.concatenate([self.p["e"][x[:, 0]], x[:, 1, :, None].astype(np.float32)], axis=2)
        cols = np.lib.stride_tricks.sliding_window_view(h, WIDTH, axis=1).transpose(0, 1, 3, 2)
        cols = np.ascontiguousarray(cols).reshape(len(x), h.shape[1] - WIDTH + 1, -1)
        a = np.maximum(cols @ self.p["w"] + self.p["b"], 0)
        pooled = np.concatenate([a.max(1), a.mean(1)], axis=1)
        return cols, a, pooled, pooled @ self.p["v"] + self.p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[3] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 7) -> None:
        rng, t = np.random.default_rng(seed), 0
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 64):
                xb, yb = x[order[i : i + 64]], y[order[i : i + 64]]
                cols, a, pooled, z = self._forward(xb)
                d = ((1 / (1 + np.exp(-z)) - yb) / len(xb)).astype(np.float32)
                dp = d[:, None] * self.p["v"]
                da = np.repeat(dp[:, None, FILTERS:] / a.shape[1], a.shape[1], axis=1)
                np.add.at(da, (np.arange(len(xb))[:, None], a.argmax(1), np.arange(FILTERS)[None]), dp[:, :FILTERS])
                da *= a > 0
                g = {"v": pooled.T @ d, "c": d.sum(keepdims=True), "b": da.sum((0, 1)), "w": np.tensordot(cols, da, ([0, 1], [0, 1]))}
                dc = (da @ self.p["w"].T).reshape(len(xb), a.shape[1], WIDTH, DIM + 1)
                dh = np.zeros((len(xb), LENGTH, DIM + 1), np.float32)
                for k in range(WIDTH):
                    dh[:, k : k + a.shape[1]] += dc[:, :, k]
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], xb[:, 0], dh[:, :, :DIM])
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps, then the highest threshold that keeps the recall."""
        w = np.array([1.0, 0.0])
        f = np.stack([z, np.ones_like(z)], axis=1).astype(np.float64)
        soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            hess = (f * (p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
            w = w - np.clip(np.linalg.solve(hess, f.T @ (p - soft) + 1e-3 * (w - [1, 0])), -1, 1)
        self.scale, self.shift = w
        good = np.sort(self.probability(z)[y > 0])
        self.threshold = float(good[int((1 - recall) * len(good))])

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def labelled_findings(n: int = 1600, seed: int = 11, runs: bool = False) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): made-up keys in contexts that give them away, and look-alikes in prose; with ``runs``, of letters or digits alone."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper = lower.upper()
    word = lambda: pick(lower, int(rng.integers(2, 9)))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(1, 7))))
    size = lambda: int(rng.integers(16, 60))
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "auth", "bearer", "access_key", "private_key", "credential", "client_secret"]
    secrets = [lambda: pick(lower + upper + digits, size()), lambda: pick(lower + upper + digits + "+/", size()) + "=", lambda: pick("0123456789abcdef", size()),
               lambda: "AKIA" + pick(upper + digits, 16), lambda: pick(lower, 3) + "_" + pick(lower + upper + digits, size())]
    plain = [lambda: "-".join(word() for _ in range(4)) + pick(digits, 2), lambda: "/".join([word(), word(), word(), pick(digits, 4)]), lambda: pick(lower, 14) + pick(digits, 3),
             lambda: f"{pick(digits, 4)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 6)}Z", lambda: word() + "_" + word() + "_" + word() + "_v" + pick(digits, 1), lambda: pick(digits, 16) + pick(lower, 1), lambda: "=" * 15 + pick(digits, 1) + word(), lambda: "-".join(word() for _ in range(3)) + "-" + pick(digits, 6)]
    if runs:
        secrets = [lambda: pick(lower + upper, size())]
        plain = [lambda: pick(lower, size()), lambda: pick(upper, 1) + pick(lower, size()), lambda: word() + "".join(word().title() for _ in range(4)), lambda: str(rng.choice(list("-=_"))) * size(),
                 lambda: "_".join(word() for _ in range(5)), lambda: "/".join(word() for _ in range(5)), lambda: "-".join(word() for _ in range(5)), lambda: pick(digits, size()), lambda: pick(upper, size())]
    out = []
    for i in range(n):
        label = i % 2
        body = (secrets if label else plain)[int(rng.integers(len(secrets if label else plain)))]()
        mark = str(rng.choice([" ", "=", ": ", ' = "', ":"]))
        lead = str(rng.choice(names)) if label and rng.random() < 0.8 else word()
        lead = lead.upper() if rng.random() < 0.2 else lead
        before = prose() + " " + lead + (mark if label else str(rng.choice([" ", ", ", ": ", " (", "\n"])))
        text = before + body + str(rng.choice(["", " ", '"', ".", "\n"])) + prose()
        out.append((text, len(before), len(before) + len(body), label))
    return out


@functools.lru_cache(maxsize=4)
def default_model(recall: float = 0.98) -> CharConv:
    return train(labelled_findings() + labelled_findings(runs=True), recall)


def train(findings: list[tuple[str, int, int, int]], recall: float = 0.98, seed: int = 7) -> CharConv:
    """Fit on three quarters of the findings; every fourth one is held out for scaling and threshold.

    A finding is shown as a scan would show it: by all windows of the candidates that meet its span (in
    training also by those of the span itself, as base findings are scored). A held-out one
    that no candidate meets counts as missed.
    """
    seen = [[w for a, b in candidates(t) if a < end and start < b for w in windows(t, a, b)] for t, start, end, _ in findings]
    y = np.array([f[3] for f in findings], dtype=np.float32)
    held = np.arange(len(y)) // 2 % 4 == 0
    shown = [(w, label) for ws, f, label, h in zip(seen, findings, y, held, strict=True) if not h for w in ws + windows(*f[:3])]
    model = CharConv(seed)
    model.fit(np.stack([w for w, _ in shown]), np.array([label for _, label in shown], dtype=np.float32), seed=seed)
    z = np.array([model.logits(np.stack(ws)).max() if ws else -30.0 for ws, h in zip(seen, held, strict=True) if h])
    model.calibrate(z, y[held], recall)
    return model


@dataclass
class Scanner:
    model: CharConv

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """(start, kind, end, score) for each text, by start, then kind; candidates of the batch are scored together."""
        found, spans, rows = [], [], []
        for i, t in enumerate(texts):
            t = t or ""
            base = base_findings(t)
            found.append([])
            places = [(a, k, b) for a, k, b in base]
            starts, reach = [a for a, _, _ in base], []  # reach: the furthest end so far
            for _, _, b in base:
                reach.append(max(b, reach[-1] if reach else 0))
            for a, b in candidates(t):
                before = bisect.bisect_left(starts, b)
                if not before or reach[before - 1] <= a:
                    places.append((a, 3, b))
            for a, k, b in places:
                w = windows(t, a, b)
                rows += w
                spans.append((i, a, k, b, len(w)))
        if rows:
            p = self.model.probability(self.model.logits(np.stack(rows)))
            at = 0
            for i, a, k, b, n in spans:
                score, at = float(p[at : at + n].max()), at + n
                if k < 3 or score >= self.model.threshold:
                    found[i].append((a, k, b, score))
        return [sorted(f) for f in found]


def redact(text: str, findings: list[tuple[int, int, int, float]]) -> str:
    """The text with every finding replaced by ``[secret]``; overlapping ones become one."""
    out, at, end = [], 0, 0
    for a, _, b, _ in findings:
        if a >= end:
            out += [text[at:a], "[secret]"]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: CharConv | None = None, with_text: bool = False, carry: tuple = ()) -> DataFrame:
    """(doc_id, findings array<struct<kind, start, end, score>>[, redacted]) per row, plus the columns in ``carry``.

    Positions are code points, ends exclusive. A null text is empty for the scan and stays null when
    redacted; repeated rows and null ids stay; other columns are ignored; an empty table gives no
    rows. Texts of any length are scanned whole where they are read, a bounded batch at a time; of spans
    that tie in their start the kinds come in the order of ``KINDS``; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    scanner = Scanner(model or default_model())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    keep = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in carry])
    text_type = ", redacted string" if with_text else ""
    schema = "doc_id long, findings array<struct<kind:string,start:long,end:long,score:double>>" + text_type + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(1).to_pylist()
                found = scanner.scan(texts)
                columns = [part.column(0), pa.array([[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in f] for f in found], kind)]
                if with_text:
                    columns.append(pa.array([t if t is None or not f else redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
                names = ["doc_id", "findings", "redacted"][: len(columns)] + list(carry)
                yield pa.RecordBatch.from_arrays(columns + part.columns[2:], names=names)
        tidy()

    return keep.mapInArrow(scan, schema)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda s: s["kind"] != "model")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("findings", line), ",").alias("spans"))

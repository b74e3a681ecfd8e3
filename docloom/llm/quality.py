"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

With x the features of a text, v_i the factors of feature i,

    y(x) = w_0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],

so all pairwise interactions cost as much as one pass over the features.  Features are the shares
of a text's words in ``WORDS`` hash buckets, statistics of its structure (capitals, symbols,
repetition, line and word lengths) and metadata that the text itself gives (its size).  The model
is trained by adaptive gradient descent on a bounded sample of labelled rows; its margin is
calibrated by a logistic fit on held-back rows.

Defined cases: null and empty texts have the features of an empty text and get a score as any
other; with no labels, or labels of one kind, scores are the labels' smoothed share; repeated rows
score alike; texts are described whole, whatever their length; nothing depends on the order of
ties, as features are sums; an empty table gives no rows; other columns are carried along, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.training import labelled, sigmoid, word_hashes

WORDS = 1 << 12
RANK = 8
SYMBOLS = b"#$%&*<>{}[]\\^~=+_@"
STATS = ("log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "pipe", "exclaim", "stop", "comma", "space", "line_words", "distinct", "repeats", "top_share", "beyond_ascii", "short_lines")


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, shares, statistics) of a text."""
    h = word_hashes(text.lower())
    n, size = max(1, len(h)), max(1, len(text))
    count = np.bincount((h & np.uint64(WORDS - 1)).astype(np.int64), minlength=WORDS)
    at = np.flatnonzero(count)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size
    letters = max(1e-9, seen[65:91].sum() + seen[97:123].sum())
    _, each = np.unique(h, return_counts=True)
    lines = text.count(b"\n") + 1
    stats = np.array([
        np.log1p(len(text)), np.log1p(len(h)), min(40.0, size / n), seen[65:91].sum() / letters, seen[48:58].sum(), seen[list(SYMBOLS)].sum(), seen[124], seen[33], seen[46], seen[44], seen[32],
        np.log1p(n / lines), len(each) / n, float((h[1:] == h[:-1]).sum()) / n, (each.max() if len(each) else 0) / n, seen[128:].sum(), lines / n,
    ])
    return at, count[at] / n, stats


class Model:
    """A factorisation machine with its calibration."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 25, rate: float = 0.08, decay: float = 2e-4, batch: int = 64, seed: int = 11):
        self.flat = (labels.sum() + 1) / (len(labels) + 2) if len(set(labels.tolist())) < 2 else None
        if self.flat is not None:
            return
        stats = np.array([r[2] for r in rows])
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        scaled = np.clip((stats - self.mean) / self.scale, -6, 6)
        self.low, self.high = scaled.min(axis=0), scaled.max(axis=0)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        held, learn = order[: len(rows) // 5], order[len(rows) // 5 :]
        size = WORDS + len(STATS)
        self.w0, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK))
        sums = [1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)]
        for _ in range(epochs):
            learn = rng.permutation(learn)
            for i in range(0, len(learn), batch):
                now = learn[i : i + batch]
                x = self._dense([rows[k] for k in now])
                xv = x @ self.v
                y = self._margin(x, xv)
                g = (sigmoid(y) - labels[now]) / len(now)
                gw = x.T @ g + decay * self.w
                gv = x.T @ (g[:, None] * xv) - (x * x).T @ g[:, None] * self.v + decay * self.v
                for k, (name, grad) in enumerate((("w0", g.sum()), ("w", gw), ("v", gv))):
                    sums[k] = sums[k] + grad * grad
                    setattr(self, name, getattr(self, name) - rate * grad / np.sqrt(sums[k]))
        self.a, self.b = 1.0, 0.0
        if len(set(labels[held].tolist())) == 2:
            self._calibrate(np.array([self._margin_of(rows[k]) for k in held]), labels[held])

    def _scaled(self, stats: np.ndarray) -> np.ndarray:
        """Statistics in their spread, within the range that the sample has: the machine does not extrapolate."""
        return np.clip((stats - self.mean) / self.scale, self.low, self.high)

    def _dense(self, rows) -> np.ndarray:
        out = np.zeros((len(rows), WORDS + len(STATS)))
        for r, (at, share, stats) in enumerate(rows):
            out[r, at] = share * 8
            out[r, WORDS:] = self._scaled(stats)
        return out

    def _margin(self, x: np.ndarray, xv: np.ndarray) -> np.ndarray:
        return self.w0 + x @ self.w + 0.5 * ((xv**2).sum(axis=1) - (x**2) @ (self.v**2).sum(axis=1))

    def _margin_of(self, row) -> float:
        """In time linear in the features that are not zero."""
        at, share, stats = row
        i = np.concatenate([at, np.arange(WORDS, WORDS + len(STATS))])
        x = np.concatenate([share * 8, self._scaled(stats)])
        v = self.v[i]
        return float(self.w0 + x @ self.w[i] + 0.5 * (((x @ v) ** 2).sum() - ((x * x) @ (v * v)).sum()))

    def _calibrate(self, y: np.ndarray, labels: np.ndarray) -> None:
        a, b = 1.0, 0.0
        for _ in range(200):
            g = sigmoid(a * y + b) - labels
            w = np.maximum(1e-3, sigmoid(a * y + b) * sigmoid(-a * y - b))
            h = np.array([[(w * y * y).sum() + 1.0, (w * y).sum()], [(w * y).sum(), w.sum() + 1e-3]])
            da, db = np.linalg.solve(h, [(g * y).sum() + (a - 1), g.sum()])
            a, b = a - 0.5 * da, b - 0.5 * db
        if a > 0:
            self.a, self.b = float(a), float(b)

    def score(self, text: bytes) -> float:
        return float(self.flat) if self.flat is not None else float(sigmoid(np.array(self.a * self._margin_of(features(text)) + self.b)))


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", most_rows: int = 8000) -> Model:
    """A model of about ``most_rows`` labelled rows at most, of the ids that ``learn`` admits."""

    def run(batches):
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a.astype(np.uint16).tobytes() for a, _, _ in got], pa.binary()), pa.array([s.tobytes() for _, s, _ in got], pa.binary()), pa.array([s.tobytes() for _, _, s in got], pa.binary())], ["label", "at", "share", "stats"])

    rows = labelled(docs, labels, label_col, id_col, text_col, learn, most_rows).select("text", "label")
    got = rows.mapInArrow(run, "label int, at binary, share binary, stats binary").orderBy("label", "at", "share", "stats").collect()
    return Model([(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["share"]), np.frombuffer(r["stats"])) for r in got], np.array([r["label"] for r in got], float))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(doc, score) for each row; doc holds the row's own columns but the text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())], pa.float64())], ["doc", "score"])

    rows = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))

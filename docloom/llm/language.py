"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of two to four characters of its words, word edges included, hashed
into ``BUCKETS``.  The model averages their embeddings and puts a softmax over the languages on
top; it is trained by stochastic gradient descent on a bounded sample of texts.  Averaging is
linear, so embeddings and output weights fold into one table of a row for each bucket, and a text
is scored by its bucket counts.  A temperature fitted on held-back rows of the sample calibrates
the probabilities, and the least probability at which accepted held-back rows are right often
enough is the limit below which a prediction is rejected.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and not accepted; with
no labelled text to learn from every text is; repeated rows are predicted alike, and of the rows of
one id (null is one) one teaches, the least; ties go to the first language by code point; texts of
any length are counted whole, some ten bytes a character at a time; an empty table gives no rows;
other columns are carried along, whatever their names.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.training import once_each, sampled

BUCKETS = 1 << 13
UNKNOWN = "und"
#: Characters in which subwords begin that are hashed at a time, and the longest subword.
PIECE, LONGEST = 1 << 20, 4


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def bucket_counts(text: str) -> np.ndarray | None:
    """How often the subwords of a text fall into each bucket; None without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1]
    edge = np.array([32], np.uint32)
    whole = np.concatenate([edge, points[keep], edge])
    counts = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(whole), PIECE):
        c = whole[i : i + PIECE + LONGEST - 1].astype(np.uint64)  # subwords that begin in a piece end beyond it
        gap = c == 32
        h = c * np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, LONGEST + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :] * np.uint64(0x94D049BB133111EB)
            within = np.ones(len(h), bool)
            within[PIECE:] = False
            for k in range(1, n - 1):
                within &= ~gap[k : k + len(h)]
            if n == 2:
                within &= ~(gap[:-1] & gap[1:])
            mixed = h[within]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            counts += np.bincount((mixed >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
    return counts


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for r, (at, n) in enumerate(rows):
        out[r, at] = n / n.sum()
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """languages, table (a row of log-odds for each bucket), bias, temperature and reject_below."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], dims: int = 16, epochs: int = 12, rate: float = 4.0, batch: int = 32, right: float = 0.995, seed: int = 3):
        self.languages = sorted(set(labels))
        want = np.array([self.languages.index(x) for x in labels])
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        held = order[: len(rows) // 5]
        learn = order[len(held) :]
        # Embeddings start large enough for averages over many subwords to tell texts apart.
        embed = rng.normal(0, 1, (BUCKETS, dims)).astype(np.float32)
        out, bias = np.zeros((dims, len(self.languages)), np.float32), np.zeros(len(self.languages), np.float32)
        steps = max(1, epochs * -(-len(learn) // batch))
        step = 0
        for _ in range(epochs):
            learn = rng.permutation(learn)
            for i in range(0, len(learn), batch):
                now = learn[i : i + batch]
                x = _dense([rows[k] for k in now])
                mean = x @ embed
                wrong = _softmax(mean @ out + bias)
                wrong[np.arange(len(now)), want[now]] -= 1
                pace = rate * (1 - step / steps) / len(now)
                back = wrong @ out.T
                out -= pace * (mean.T @ wrong)
                bias -= pace * wrong.sum(axis=0)
                embed -= pace * 50 * (x.T @ back)  # a bucket takes part by its share only
                step += 1
        self.table, self.bias, self.temperature, self.reject_below = (embed @ out).astype(np.float64), bias.astype(np.float64), 1.0, 0.0
        if len(held):
            self._calibrate([rows[k] for k in held], want[held], right)

    def _logits(self, rows) -> np.ndarray:
        return np.array([(n / n.sum()) @ self.table[at] for at, n in rows]) + self.bias

    def _calibrate(self, rows, want: np.ndarray, right: float) -> None:
        logits = self._logits(rows)
        loss = {t: -np.log(_softmax(logits / t)[np.arange(len(want)), want] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
        self.temperature = float(min(loss, key=loss.get))
        p = _softmax(logits / self.temperature)
        sure, hit = p.max(axis=1), p.argmax(axis=1) == want
        order = np.argsort(-sure)
        enough = np.cumsum(hit[order]) >= right * np.arange(1, len(order) + 1)
        last = np.flatnonzero(enough)
        self.reject_below = 0.0 if enough[-1] else float(sure[order[last[-1]]]) if len(last) else 1.0

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        logits = counts @ self.table / counts.sum() + self.bias
        p = _softmax(logits[None, :] / self.temperature)[0]
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def fitted(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_rows: int = 3000) -> Model | None:
    """A model of about ``most_rows`` rows at most that ``learn`` admits and whose text and language are known; None if there are none."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = once_each(sampled(rows, "id", most_rows), "id", ["lang", "text"])

    def run(batches):
        for batch in batches:
            out = []
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                n = bucket_counts(text)
                if n is not None:
                    at = np.flatnonzero(n)
                    out.append((lang, at.astype(np.uint16).tobytes(), n[at].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["lang", "at", "n"])

    got = rows.mapInArrow(run, "lang string, at binary, n binary").orderBy("lang", "at", "n").collect()
    return Model([(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["n"], np.float32)) for r in got], [r["lang"] for r in got]) if got else None


def predicted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """(doc, lang_pred, score, accepted) for each row; doc holds the row's own columns."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                n = bucket_counts(text) if text and model else None
                out.append((UNKNOWN, 0.0, False) if n is None else (*(p := model.predict(n)), p[1] >= model.reject_below))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[j] for o in out], t) for j, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["doc", "lang_pred", "score", "accepted"])

    rows = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *T.StructType.fromDDL("lang_pred string, score double, accepted boolean").fields]))

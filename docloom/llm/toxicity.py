"""Toxicity classifier: gradient-boosted trees over dense features with isotonic calibration.

The lexicon is learned: words and word beginnings that are far more frequent in labelled toxic
texts than in others, counted over the training sample in Spark.  Dense features are the
densities of lexicon terms, their nearness to second-person words, and rates of capitals,
punctuation and obfuscated words (letters mixed with digits or symbols, undone before they are
looked up).  When the trees' training rows are described, each row's own contribution to the
counts is taken back, so that a term which only that row supports does not count for it.  Margins
from folds calibrate the scores.

Defined cases: null and empty texts have the features of an empty text and get a score as any
other; with no labels, or labels of one kind, scores are the labels' smoothed share; repeated rows
score alike, and equal texts of one label teach once; ties among splits go to the first feature and
least cut; texts are described whole, whatever their length; an empty table gives no rows; other
columns are carried along, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.boosting import Isotonic, Trees
from docloom.llm.shared import written
from docloom.llm.training import labelled

WORD = re.compile(r"[^\W\d_]+")
#: What stands between two letters of one word and is no letter.
INSIDE = re.compile(r"[\d@$!*_.-]+(?=[^\W\d_])")
AFTER = re.compile(r"[\w@$!*.-]*")
BEYOND_ASCII = re.compile(r"[^\x00-\x7F]+")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = str.maketrans("013457@$!", "oieastasi", "*_.-")
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro".split())
STEMS = (4, 5, 6)
NEAR = 3
#: Texts that are Python strings at a time.
ROWS = 250
FEATURES = ("hits", "density", "distinct", "near_second", "second", "upper", "exclaim", "punctuation", "mixed", "undone", "log_words", "longest_run")


def terms(word: str) -> list[str]:
    """A word's entry, marked at its end, and its beginnings."""
    return [word + "$", *(word[:n] for n in STEMS if len(word) >= n)]


def _odds(toxic: float, other: float, n_toxic: int, n_other: int) -> float:
    return ((toxic + 0.5) / (n_toxic + 1)) / ((other + 0.5) / (n_other + 1))


class Lexicon:
    """Terms by what is known of a row: nothing, that it is toxic, or that it is not."""

    def __init__(self, counts: list[tuple[str, int, int]], n_toxic: int, n_other: int, support: int, odds: float):
        keep = lambda t, o, least: t >= least and _odds(t, o, n_toxic, n_other) >= odds
        self.any = frozenset(w for w, t, o in counts if keep(t, o, support))
        self.if_toxic = frozenset(w for w, t, o in counts if keep(t - 1, o, support))
        self.if_other = frozenset(w for w, t, o in counts if keep(t, max(0, o - 1), support))


def mixed_words(text: str) -> list[str]:
    """Words in which digits or symbols stand between letters."""
    found, end = [], 0
    for m in INSIDE.finditer(text):
        at = m.start()
        if at < end or not at or not text[at - 1].isalpha():
            continue
        begin = at - 1  # a word is walked back over once, as ``end`` then lies behind it
        while begin > end and ((c := text[begin - 1]).isalnum() or c in "_@$!*.-"):
            begin -= 1
        end = AFTER.match(text, at).end()
        found.append(text[begin:end])
    return found


def capitals(text: str) -> int:
    raw = text.encode("utf-8", "replace")
    found = len(raw) - len(raw.translate(None, CAPITALS))
    if not text.isascii():
        others = "".join(BEYOND_ASCII.findall(text))
        found += sum(others.count(c) for c in set(others) if c.isupper())
    return found


def _known(word: str, lexicon: frozenset[str], heads: set[str]) -> bool:
    return (word[:4] in heads or word + "$" in lexicon) and any(t in lexicon for t in terms(word))


def _features(text: str, low: str, words: list[str], lexicon: frozenset[str], heads: set[str]) -> list[float]:
    known = {w for w in set(words) if _known(w, lexicon, heads)}
    hits = [i for i, w in enumerate(words) if w in known] if known else []
    second = [i for i, w in enumerate(words) if w in SECOND]
    near, near_at = 0, set(second)
    for i in hits:
        near += any(k in near_at for k in range(i - NEAR, i + NEAR + 1))
    mixed = mixed_words(low)
    undone = sum(_known(w.translate(PLAIN), lexicon, heads) for w in mixed) if mixed else 0
    n, size = max(1, len(words)), max(1, len(text))
    letters = max(1, sum(map(len, words)))
    run = longest = 0
    for a, b in zip(hits, hits[1:]):
        run = run + 1 if b - a <= NEAR else 0
        longest = max(longest, run)
    punctuation = sum(map(text.count, ".,;:?'\"()-"))
    return [min(50.0, len(hits)), len(hits) / n, min(50.0, len(known)), near / n, len(second) / n, capitals(text) / letters, text.count("!") / size, punctuation / size, len(mixed) / n, float(min(20, undone)), float(np.log1p(len(words))), float(longest)]


class Model:
    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, folds: int = 3):
        self.lexicon = lexicon.any
        self.flat = (y.sum() + 1) / (len(y) + 2) if len(set(y.tolist())) < 2 else None
        if self.flat is not None:
            return
        self.trees = Trees(x, y)
        fold, margins = np.arange(len(y)) % folds, np.zeros(len(y))
        for k in range(folds):
            rest = fold != k
            margins[~rest] = Trees(x[rest], y[rest]).margins(x[~rest]) if len(set(y[rest].tolist())) == 2 else self.trees.margins(x[~rest])
        self.calibrated = Isotonic(margins, y)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(texts), float(self.flat))
        if not texts:
            return np.zeros(0)
        heads = {t[:4] for t in self.lexicon}
        x = np.array([_features(t, low := t.lower(), WORD.findall(low), self.lexicon, heads) for t in texts])
        return self.calibrated(self.trees.margins(x))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, other): in how many different texts of each label a term occurs; counted by task, then summed."""

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            both = list(counts[0].keys() | counts[1].keys())
            got = pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([counts[1][t] for t in both], pa.int64()), pa.array([counts[0][t] for t in both], pa.int64())], ["term", "toxic", "other"])
            counts[0].clear()
            counts[1].clear()
            return got

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                counts[label > 0].update({t for w in set(WORD.findall(text.lower())) for t in terms(w)})
                if len(counts[0]) + len(counts[1]) > 150_000:
                    yield out()
        if counts[0] or counts[1]:
            yield out()

    parts = rows.select("text", "label").mapInArrow(run, "term string, toxic bigint, other bigint")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", most_rows: int = 20_000, odds: float = 15.0) -> Model:
    """A model of about ``most_rows`` labelled rows at most, of the ids that ``learn`` admits.

    All terms of that sample that are frequent enough make the lexicon, so the sample bounds it.
    """
    rows = labelled(docs, labels, label_col, id_col, text_col, learn, most_rows)
    rows = written(rows.groupBy(F.sha2("text", 256).alias("hash"), "label").agg(F.min("text").alias("text")).select("text", "label"), "toxicity_sample")
    n_toxic, n_other = (n or 0 for n in rows.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first())
    support = max(3, round(0.003 * n_toxic))
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.greatest(F.col("other") - 1, F.lit(0)) + 0.5) / (n_other + 1))
    chosen = term_counts(rows).where((F.col("toxic") >= support) & (ratio >= odds)).orderBy("term").collect()
    lexicon = Lexicon([(r["term"], r["toxic"], r["other"]) for r in chosen], n_toxic, n_other, support, odds)
    heads = [{t[:4] for t in s} for s in (lexicon.if_other, lexicon.if_toxic)]

    def run(batches):
        for batch in batches:
            got = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = lexicon.if_toxic if label > 0 else lexicon.if_other
                got.append(_features(text, low := text.lower(), WORD.findall(low), own, heads[label > 0]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(got, pa.list_(pa.float64()))], ["label", "x"])

    got = rows.mapInArrow(run, "label int, x array<double>").orderBy("x", "label").collect()
    spread = np.random.default_rng(9).permutation(len(got))
    x, y = np.array([got[k]["x"] for k in spread]).reshape(-1, len(FEATURES)), np.array([float(got[k]["label"] > 0) for k in spread])
    return Model(lexicon, x, y)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(doc, score) for each row; doc holds the row's own columns, the text among them, which goes to Python once."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                texts = part.column(0).flatten()[at].to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores([t or "" for t in texts]), pa.float64())], ["doc", "score"])

    rows = docs.select(F.struct("*").alias("doc"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))

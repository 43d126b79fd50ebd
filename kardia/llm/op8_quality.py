"""Quality by regularised quadratic discriminant analysis over document statistics.

Each text becomes a vector of transformed statistics (lengths, character classes,
repetition, line shape). Each class has a mean and a covariance that is shrunk
towards the pooled covariance and towards a multiple of the identity. The
Cholesky factor of each class covariance is computed once and cached in the model; a text's
log-density under a class is -0.5 * (|L^-1 (x - mean)|^2 + log det). The score is a
logistic calibration of the difference of the two log-densities, fitted on the same training
rows, so labels that are wrong at random keep it from 0 and 1.

The fit uses a bounded sample, ``SAMPLE`` labelled rows by the smallest hash of the
id; only their vectors reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kardia.llm.common import documents, map_rows
from kardia.llm.op10_toxicity import held_out, logistic, training_rows

SAMPLE = 20_000  # labelled rows of the fit, at most
TO_POOLED, TO_IDENTITY = 0.2, 0.05  # shares of the shrinkage targets
THRESHOLD = 0.3
LEAST_ROWS = 8  # of each class, for a fit
MARK = 5  # bytes after a word's letters that count as marks

_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_PUNCT = np.array([33, 34, 39, 44, 46, 58, 59, 63])  # ! " ' , . : ; ?
_SYMBOL = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in _PUNCT])

STATISTICS = ("chars", "words", "word_length", "word_length_spread", "upper", "digits", "punctuation", "symbols", "exclamations", "pipes",
              "distinct_words", "echoed_words", "echoed_pairs", "top_word", "short_words", "lines", "line_length", "repeated_lines", "beyond_ascii")


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text; an empty text has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = float(raw.sum())
    words = text.lower().split()
    k = len(words) or 1
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    root = lambda v: float(np.sqrt(max(v, 0.0)))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        root(raw[_UPPER].sum() / n), root(raw[_DIGIT].sum() / n), root(raw[_PUNCT].sum() / n), root(raw[_SYMBOL].sum() / n), root(raw[33] / n), root(raw[124] / n),
        len(distinct) / k, root(sum(map(eq, words, words[1:])) / k), root(1 - pairs / max(1, k - 1)) if k > 1 else 0.0, root(max(distinct.values(), default=0) / k),
        float((lengths <= 3).mean()), float(np.log1p(len(lines))), float(np.log1p(n / len(lines))), root(1 - len(set(lines)) / len(lines)), root(raw[128:].sum() / n),
    ]


@dataclass
class Discriminant:
    """Standardisation, class means, inverse Cholesky factors, log determinants, calibration."""
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class, statistic
    factors: np.ndarray  # class, lower triangular: inverse of the Cholesky factor
    logdets: np.ndarray
    link: tuple[float, ...]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density under class 1 less that under class 0, damped far from both classes."""
        z = (x - self.centre) / self.scale
        logs = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets)]
        return np.arcsinh(logs[1] - logs[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.link[0] + self.link[1] * self.difference(x), -30, 30)))


def discriminant(x: np.ndarray, y: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """Fit from vectors and 0/1 classes. With too few rows of a class the score is the share of class 1 (a half without rows)."""
    p = x.shape[1] if x.ndim == 2 and len(x) else len(STATISTICS)
    if min((y == 1).sum(), (y == 0).sum()) < LEAST_ROWS:
        share = float(np.clip((y == 1).mean(), 0.01, 0.99)) if len(y) else 0.5
        eye = np.stack([np.eye(p)] * 2)
        return Discriminant(np.zeros(p), np.ones(p), np.zeros((2, p)), eye, np.zeros(2), (float(np.log(share / (1 - share))), 0.0))
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - centre) / scale
    parts = [z[y == c] for c in (0, 1)]
    means = np.stack([q.mean(axis=0) for q in parts])
    own = [np.cov(q.T, bias=True) for q in parts]
    pooled = sum(len(q) * s for q, s in zip(parts, own)) / len(z)
    factors, logdets = [], []
    for s in own:
        shrunk = (1 - to_pooled - to_identity) * s + to_pooled * pooled
        shrunk += (to_identity * max(np.trace(shrunk) / p, 1e-3) + 1e-6) * np.eye(p)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        logdets.append(2 * np.log(np.diag(lower)).sum())
    model = Discriminant(centre, scale, means, np.stack(factors), np.array(logdets), (0.0, 1.0))
    model.link = logistic(model.difference(x)[:, None], y.astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant:
    """A model of ``labels.quality`` from labelled rows outside the held-out fold."""
    def run(cols):
        return {"x": [statistics(t) for t in cols["text"]], "y": cols["label"]}

    seen = map_rows(training_rows(docs, labels, "quality", sample).select("text", "label"), run, "x array<double>, y int").collect()
    return discriminant(np.array([r.x for r in seen]), np.array([int(r.y == 1) for r in seen]))


def score(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row.

    Null and empty texts are scored as vectors of zeros. A null id counts as not
    held out. Repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols):
        if not cols["text"]:
            return []
        scores = shared.value.score(np.array([statistics(t) for t in cols["text"]]))
        return {"doc_id": cols["doc_id"], "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    scored = map_rows(documents(docs, id_col, text_col), run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")

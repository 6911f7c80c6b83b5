"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

A token's index vector is sparse and ternary and follows from its hash; its word vector is the sum of the index
vectors of its neighbours wherever it occurs in the training texts. A document is the mean of its words'
vectors and the mean of its symbol runs' vectors, with shares that describe its surface (capitals, repeats, symbols, unknown words). A
hidden layer of tanh units and a logistic output are fitted by Adam; a temperature fitted on a part held back from training
calibrates the probabilities.

Defined results: null text counts as empty and is scored like other texts; with labelled rows of one class only, or none, every
score is that class's (or 1); repeated keys are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import WordNames, mix64, named_words, only, remainder, sliced, text_of, training_rows

#: Labelled rows that are fitted at most, tokens of each that have word vectors at most.
SAMPLE = 5_000
VOCABULARY = 20_000
DIMENSIONS, NONZERO, WINDOW, HIDDEN = 48, 6, 2, 32
_names = WordNames()
_WORDS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_SYMBOLS = bytes(32 if chr(b).isalnum() or b >= 128 or b in (9, 10, 11, 12, 13) else b for b in range(256))


def index_vectors(tokens: np.ndarray) -> np.ndarray:
    """Ternary vectors, a function of each token's hash alone."""
    out = np.zeros((len(tokens), DIMENSIONS), np.float32)
    with np.errstate(over="ignore"):
        for k in range(NONZERO):
            h = mix64(tokens + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15))
            out[np.arange(len(tokens)), (h % np.uint64(DIMENSIONS)).astype(np.int64)] += np.where(h >> np.uint64(63), 1.0, -1.0)
    return out


def word_vectors(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest tokens, and their unit context vectors. `at`: where each text begins."""
    names, ids, count = np.unique(tokens, return_inverse=True, return_counts=True)
    common = np.sort(np.argsort(-count, kind="stable")[:VOCABULARY])
    rank = np.full(len(names), -1)
    rank[common] = np.arange(len(common))
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    vectors = np.zeros((len(common), DIMENSIONS), np.float32)
    for gap in range(1, WINDOW + 1):
        same = np.flatnonzero(text[gap:] == text[:-gap]) if len(text) > gap else np.zeros(0, np.int64)
        for one, other in ((0, gap), (gap, 0)):
            code = rank[ids[same + one]]
            code = (code * len(names) + ids[same + other])[code >= 0]
            pair, times = np.unique(code, return_counts=True)
            del code
            for s in range(0, len(pair), 100_000):  # sorted by the common token
                l, r = np.divmod(pair[s : s + 100_000], len(names))
                first = np.flatnonzero(np.concatenate([[True], l[1:] != l[:-1]]))
                vectors[l[first]] += np.add.reduceat(index_vectors(names[r]) * times[s : s + 100_000, None].astype(np.float32), first, axis=0)
    return names[common], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)


def _shares(texts: list[bytes], word_at: np.ndarray, words: np.ndarray, symbol_at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Surface shares of each text."""
    out = np.zeros((len(texts), 7), np.float32)
    for i, t in enumerate(texts):
        w = words[word_at[i] : word_at[i + 1]]
        n = max(1, len(w))
        b = np.frombuffer(t, np.uint8)
        letters = max(1, int(((b >= 97) & (b <= 122)).sum() + (caps := int(((b >= 65) & (b <= 90)).sum()))))
        distinct = len(np.unique(w))
        out[i] = caps / letters, float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0, distinct / n**0.8, min(3.0, (symbol_at[i + 1] - symbol_at[i]) / n), known[word_at[i] : word_at[i + 1]].mean() if len(w) else 0, np.log1p(len(w)) / 8, np.log1p(len(b) / n) / 3
    return out


def pooled(texts: list[str], vocabulary: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of features for each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    parts = []
    for (names, vectors), blanks, low in zip(vocabulary, (_WORDS, _SYMBOLS), (True, False), strict=True):
        tokens, at, _ = named_words([t.lower() for t in raw] if low else raw, blanks, _names)
        place = np.minimum(np.searchsorted(names, tokens), max(len(names) - 1, 0))
        known = names[place] == tokens if len(names) else np.zeros(len(tokens), bool)
        sums = np.zeros((len(texts) + 1, DIMENSIONS), np.float64)
        if len(names):
            weight = known.astype(np.float32)
            text = np.repeat(np.arange(len(texts)), np.diff(at))
            for s in range(0, len(tokens), 100_000):
                t = text[s : s + 100_000]
                first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                sums[t[first]] += np.add.reduceat(vectors[place[s : s + 100_000]] * weight[s : s + 100_000, None], first, axis=0)
        parts.append((sums[:-1] / np.maximum(1, np.diff(at))[:, None]).astype(np.float32))
        if low:
            words, word_at, word_known = tokens, at, known
        else:
            symbol_at = at
    return np.hstack([*parts, _shares(raw, word_at, words, symbol_at, word_known)])


class Model:
    """Word and symbol vectors, a standardisation, two layers and a temperature."""

    def __init__(self, vocabulary: list, features: np.ndarray, label: np.ndarray, rounds: int = 400):
        self.vocabulary, self.constant = vocabulary, None
        if not len(label) or label.min() == label.max():
            self.constant = float(label[0]) if len(label) else 1.0
            return
        rng = np.random.default_rng(7)
        self.mean, self.scale = features.mean(0), features.std(0) + 1e-3
        x, y = (features - self.mean) / self.scale, label.astype(np.float64)
        order = rng.permutation(len(y))
        check, train = order[: len(y) // 5], order[len(y) // 5 :]
        params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        best, kept = np.inf, params
        for k in range(1, rounds + 1):
            some = rng.choice(train, min(len(train), 512), replace=False)
            h = np.tanh(x[some] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[some]) / len(some)
            back = d[:, None] * params[2] * (1 - h * h)
            for i, g in enumerate((x[some].T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()]))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - 0.01 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
            if k % 20 == 0 and len(check):
                loss = self._loss(self._logit(x[check], params), y[check], 1.0)
                if loss < best:
                    best, kept = loss, list(params)
        self.params = kept
        heats = np.geomspace(0.25, 4, 33)
        losses = [self._loss(self._logit(x[check], kept), y[check], t) for t in heats] if len(check) else [0]
        self.temperature = float(heats[int(np.argmin(losses))]) if len(check) else 1.0

    @staticmethod
    def _logit(x: np.ndarray, params: list) -> np.ndarray:
        return np.tanh(x @ params[0] + params[1]) @ params[2] + params[3]

    @staticmethod
    def _loss(logit: np.ndarray, y: np.ndarray, temperature: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(logit / temperature, -30, 30))), 1e-6, 1 - 1e-6)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = (pooled(texts, self.vocabulary) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self._logit(x, self.params) / self.temperature, -30, 30)))


def trained(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "quality", folds: int = 4, held: int = 2, bound: int = SAMPLE) -> Model:
    """Fits on at most `bound` labelled rows: their token hashes come to the driver, which makes word vectors; executors pool; the network is small."""
    rows = training_rows(df, labels, target, folds, held, bound, key, text)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for whole in batches:
            for b in sliced(whole, 0):
                raw = [t.encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist()]
                columns = []
                for texts, blanks in (([t.lower() for t in raw], _WORDS), (raw, _SYMBOLS)):
                    h, at, _ = named_words(texts, blanks, _names)
                    columns.append(pa.array([h[s:e].tobytes() for s, e in zip(at, at[1:], strict=False)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["words", "symbols"])

    vocabulary = []
    sample = sorted(map(tuple, rows.mapInArrow(tokens, "words binary, symbols binary").collect()))
    for k in range(2):
        streams = [np.frombuffer(bytes(r[k]), np.uint64) for r in sample]
        vocabulary.append(word_vectors(np.concatenate([np.zeros(0, np.uint64), *streams]), np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)))
    del sample

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, 0):
                x = pooled(b.column(0).to_pylist(), vocabulary).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1)], names=["x", "label"])

    fitted = sorted((bytes(r[0]), r[1]) for r in rows.mapInArrow(features, "x binary, label int").collect())
    x = np.frombuffer(b"".join(r[0] for r in fitted), "<f4").reshape(len(fitted), -1) if fitted else np.zeros((0, 1), np.float32)
    return Model(vocabulary, x, np.array([r[1] for r in fitted]))


def score_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 4, held: int = 2, threshold: float = 0.7, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `df`."""
    model = trained(df, labels, key, text, folds=folds, held=held, bound=bound)
    types = [pa.int64(), pa.bool_(), pa.float64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for whole in batches:
            for b in sliced(whole, 2):
                score = model.score(b.column(2).to_pylist())
                columns = (b.column(0), b.column(1), score, (score >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "held_out", "score", "predicted"])

    read = df.select(df[key].cast("long").alias("id"), (remainder(df, folds, key) == held).alias("held"), text_of(df, text).alias("text"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def of_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """The rows of `df` that score `threshold` or more, all columns as they are."""
    model = trained(df, labels, key, text, folds=folds, held=held)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(np.concatenate([np.zeros(0), *(model.score(texts.iloc[s : s + 500].tolist()) for s in range(0, len(texts), 500))]), index=texts.index)

    return df.where(score(text_of(df, text)) >= threshold)

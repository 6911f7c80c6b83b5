"""Toxicity by multiple-instance learning: documents are bags of sentences, and only documents are labelled.

A sentence's probability is a logistic function of its evidence: words and the first letters of longer words.
A document's is the noisy-or of its sentences', 1 - prod(1 - p). Weights are fitted through the noisy-or to
document labels only, never below zero, so that no amount of harmless text hides an offending sentence; a penalty on
their sum drops evidence that other evidence explains. Evidence enters if its association with the label is
more than chance often gives among so many candidates. The fitted sentences' scores then locate what is offensive.

Defined results: null text counts as empty and scores 0; without labelled rows of both classes every score is 0; repeated keys are rows of
their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import forget, only, remainder, sliced, stored, text_of, training_rows

#: Labelled rows that are fitted at most.
SAMPLE = 12_000
STEMS = (4, 5)
PENALTY = 0.1
#: How far a likelihood ratio must exceed the logarithm of the number of candidates; the penalty drops what chance lets in.
BEYOND_CHANCE = 0.7
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_BLANKS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def evidence(sentence: str) -> set[str]:
    """Words of a sentence, and `^` with the first letters of words of five letters or more."""
    words = set(sentence.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).decode("utf-8", "surrogatepass").split())
    return words | {"^" + w[:k] for w in words if len(w) >= 5 for k in STEMS}


class Model:
    """Weights by evidence, and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that hold evidence."""
        if self.weights.keys().isdisjoint(evidence(text)):
            return []
        out = []
        for m in _SENTENCE.finditer(text):
            found = [self.weights[e] for e in evidence(m[0]) if e in self.weights]
            if found:
                out.append((m.start(), m.end(), float(1 / (1 + np.exp(-min(30.0, self.bias + sum(found)))))))
        return out


def noisy_or(probabilities: list[float]) -> float:
    return float(-np.expm1(sum(np.log1p(-min(p, 1 - 1e-12)) for p in probabilities)))


def _sentences(rows: DataFrame) -> DataFrame:
    """(label, sentences): each sentence's evidence, joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for whole in batches:
            for b in sliced(whole, 0):
                found = [[" ".join(sorted(evidence(m[0]))) for m in _SENTENCE.finditer(t)] for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.string()))], names=["label", "sentences"])

    return rows.mapInArrow(run, "label int, sentences array<string>")


def _associated(bags: DataFrame) -> dict[str, float]:
    """Evidence of two documents or more whose association with the label is more than chance often gives among so many candidates (a log-likelihood ratio), with its share of toxic documents.

    Counted by aggregation over the sample; only what is chosen comes to the driver.
    """
    n, share = bags.agg(F.count("*"), F.avg("label")).first()
    if not n or share in (0.0, 1.0):
        return {}
    each = bags.select("label", F.explode(F.array_distinct(F.split(F.array_join("sentences", " "), " "))).alias("w")).where("w != ''")
    seen = stored(each.groupBy("w").agg(F.count("*").alias("n"), F.sum("label").alias("t")).where("n > 1"), "evidence")
    many = seen.count()
    rate = F.col("t") / F.col("n")
    gain = 2 * (F.when(F.col("t") > 0, F.col("t") * F.log(rate / share)).otherwise(0) + F.when(F.col("t") < F.col("n"), (F.col("n") - F.col("t")) * F.log((1 - rate) / (1 - share))).otherwise(0))
    chosen = seen.where(rate > share).where(gain > BEYOND_CHANCE * np.log(max(many, 2)))
    out = {r[0]: r[1] for r in chosen.select("w", rate.alias("rate")).collect()}
    forget(seen)
    return out


def fit(bags: list[tuple[int, list[list[int]]]], rate: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights of evidence 0, 1, ... and the bias, by projected Adam on the noisy-or likelihood of (label, evidence of each sentence that has any)."""
    label = np.array([b[0] for b in bags], np.float64)
    entry_f, entry_s, sentence_doc, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for d, (_, found) in enumerate(bags):
        entry_f += [np.array(x, np.int64) for x in found]
        entry_s += [np.full(len(x), at + k) for k, x in enumerate(found)]
        sentence_doc.append(np.full(len(found), d))
        at += len(found)
    if not at:
        return np.zeros(len(rate)), 0.0
    f, s, doc = np.concatenate(entry_f), np.concatenate(entry_s), np.concatenate(sentence_doc)
    weight, bias = np.maximum(0, np.log(np.maximum(rate, 1e-9) / np.maximum(1 - rate, 0.02))), -3.0
    m, v, mb, vb = np.zeros(len(rate)), np.zeros(len(rate)), 0.0, 0.0
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(s, weight[f], at), -30, 30)))
        survive = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(label))
        whole = np.clip(-np.expm1(survive), 1e-6, 1 - 1e-9)
        # d/dz of log P for toxic bags is p(1-P)/P, for clean ones -p
        slope = p * np.where(label[doc] > 0, (1 - whole[doc]) / whole[doc], -1.0)
        g, gb = np.bincount(f, slope[s], len(rate)) - PENALTY, slope.sum() - 0.001 * len(label) * (bias + 3)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate_k = 0.1 / (1 + k / 100)
        weight = np.maximum(0, weight + rate_k * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6))
        bias = min(-1.0, bias + rate_k * mb / (1 - 0.9**k) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-6))
    return weight, float(bias)


def trained(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", target: str = "toxic", folds: int = 5, held: int = 0, bound: int = SAMPLE) -> Model:
    bags = stored(_sentences(training_rows(df, labels, target, folds, held, bound, key, text)), "bags")
    rates = _associated(bags)
    names = sorted(rates)
    number = {w: k for k, w in enumerate(names)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[hit for x in s if (hit := [number[w] for w in x.split(" ") if w in number])] for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["label", "found"])

    sample = sorted((r[0], r[1]) for r in bags.mapInArrow(numbered, "label int, found array<array<int>>").collect()) if names else []  # at most `bound` short rows
    forget(bags)
    weight, bias = fit(sample, np.array([rates[w] for w in names])) if names else (np.zeros(0), 0.0)
    return Model({w: float(x) for w, x in zip(names, weight, strict=True) if x > 0.05}, bias)


def score_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 0, bound: int = SAMPLE, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences' spans (code points) of every row of `df`."""
    model = model or trained(df, labels, key, text, folds=folds, held=held, bound=bound)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    types = [pa.int64(), pa.bool_(), pa.float64(), pa.int32(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for whole in batches:
            for b in sliced(whole, 2):
                found = [model.sentences(t) for t in b.column(2).to_pylist()]
                score = [noisy_or([p for _, _, p in x]) for x in found]
                spans = [[{"start": s, "end": e, "score": p} for s, e, p in x if p >= 0.5] for x in found]
                columns = (b.column(0), b.column(1), score, [int(p >= 0.5) for p in score], spans)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "held_out", "score", "predicted", "spans"])

    read = df.select(df[key].cast("long").alias("id"), (remainder(df, folds, key) == held).alias("held"), text_of(df, text).alias("text"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,score:double>>")


def without_toxic(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """The rows of `df` that score below `threshold`, all columns as they are."""
    model = trained(df, labels, key, text, folds=folds, held=held)

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: noisy_or([p for _, _, p in model.sentences(t)])).astype(float)

    return df.where(score(text_of(df, text)) < threshold)

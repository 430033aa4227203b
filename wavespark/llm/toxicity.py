"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, are trained from document labels."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bounds of the sample that the model is fitted on, those of the lowest id hash: labelled documents, characters of all
#: their texts together, and characters of one text. They are parameters of fit(), and bound what the driver holds.
SAMPLE_DOCS, SAMPLE_CHARS, LONGEST = 6000, 50_000_000, 200_000
#: Hashed features, character n-grams of a word between boundary marks, and steps, rate and L1 penalty of the fit.
FEATURES, GRAMS = 1 << 20, (4, 5)
STEPS, RATE, DECAY = 150, 0.1, 3e-5
#: Documents (of words, counted once each) that a feature must be in.
LEAST_DOCS = 3
#: Scores from which a document is called toxic, and a sentence offending.
TOXIC, OFFENDING = 0.7, 0.5
#: Words whose scores a task remembers.
MEMORY = 300_000

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    marked = f"^{word}$"
    parts = {marked, *(marked[k : k + n] for n in GRAMS for k in range(len(marked) - n + 1))}
    return [crc32(x.encode("utf-8", "surrogatepass")) & (FEATURES - 1) for x in parts]


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lower-cased words of each stretch between sentence marks or line ends that has a word."""
    for found in SENTENCE.finditer(text):
        if words := WORD.findall(found[0].lower()):
            yield found.start(), found.end(), words


@dataclass(frozen=True)
class SentenceModel:
    """P(offending) of a sentence is sigmoid(bias + sum of its words' weights, none negative); a document is toxic if any sentence is."""

    weights: np.ndarray
    bias: float


class _Words(dict):
    """Weight of a word, computed when first asked for; it starts anew when it holds MEMORY words."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = out = float(self.weights[word_features(word)].sum())
        return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def fit_noisy_or(docs: list[list[list[str]]], labels: np.ndarray, steps: int = STEPS) -> SentenceModel:
    """Maximises the likelihood of document labels under P(toxic) = 1 - prod over sentences of (1 - p), by Adam.

    Weights are kept from going below zero: words are evidence of offence or of nothing, so that a sentence isn't excused
    by the company an offending word keeps.
    docs: the words of each sentence of each document. Deterministic. With labels of one kind only, or no words, the
    weights are zero and the bias gives the rate of toxic labels, smoothed.
    """
    rate = (labels.sum() + 1) / (len(labels) + 2)
    vocabulary: dict[str, int] = {}
    words = np.array([vocabulary.setdefault(w, len(vocabulary)) for d in docs for s in d for w in s], np.int64)
    sentence_sizes = np.array([len(s) for d in docs for s in d], np.int64)
    doc_sizes = np.array([len(d) for d in docs], np.int64)
    bias = float(np.log(np.expm1(-np.log1p(-rate) / max(1.0, np.median(doc_sizes) if len(docs) else 1.0))))
    if not len(words) or labels.min() == labels.max():
        return SentenceModel(np.zeros(FEATURES, np.float32), bias)
    sentence_of_word = np.repeat(np.arange(len(sentence_sizes)), sentence_sizes)
    doc_of_sentence = np.repeat(np.arange(len(doc_sizes)), doc_sizes)
    flat, feature_sizes, size = array("i"), [], len(vocabulary)
    for word in vocabulary:
        found = word_features(word)
        flat.extend(found)
        feature_sizes.append(len(found))
    columns = np.frombuffer(flat, np.int32)
    word_of_feature = np.repeat(np.arange(size), feature_sizes)
    # What only a few documents have says nothing about others; leaving it out keeps the fit small and general.
    pairs = np.unique(doc_of_sentence[sentence_of_word] * size + words)
    frequency = np.bincount(columns, np.bincount(pairs % size, minlength=size)[word_of_feature], FEATURES)
    often = frequency[columns] >= LEAST_DOCS
    word_of_feature = word_of_feature[often]
    used, columns = np.unique(columns[often], return_inverse=True)
    params = np.append(np.zeros(len(used)), bias)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        word_score = np.bincount(word_of_feature, params[columns], size)
        z = params[-1] + np.bincount(sentence_of_word, word_score[words], len(sentence_sizes))
        none = np.bincount(doc_of_sentence, _softplus(z), len(docs))  # -log P(no sentence is offending)
        pull = np.where(labels == 1, -1 / np.expm1(np.clip(none, 1e-9, 500)), 1.0)
        slope = pull[doc_of_sentence] / (1 + np.exp(-np.clip(z, -500, 500)))
        by_word = np.bincount(words, slope[sentence_of_word], size)
        grad = np.append(np.bincount(columns, by_word[word_of_feature], len(used)), slope.sum()) / len(docs)
        grad[:-1] += DECAY
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        params -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        np.maximum(params[:-1], 0, out=params[:-1])
    weights = np.zeros(FEATURES, np.float32)
    weights[used] = params[:-1]
    return SentenceModel(weights, float(params[-1]))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS, longest: int = LONGEST,
) -> SentenceModel:
    """Fits on a sample of the labelled documents, drawn by id hash alike wherever the rows lie: about sample of them, or
    fewer, so that their texts have about sample_chars characters together. Labelled texts of more than longest characters
    are not drawn; they are scored like any other.

    Defined results: rows without a label, and labels without a document or an id, are left out; a null text has no
    sentences; a document that is labelled toxic in any row is toxic; repeated rows count as often as they come. Without
    labels, or with labels of one kind, all weights are zero."""
    labels = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    known = docs.where(F.coalesce(F.length(text_col), F.lit(0)) <= longest)
    sizes = known.select(id_col, F.length(text_col).alias("_chars")).join(labels, id_col).agg(F.count("*").alias("n"), F.sum("_chars").alias("chars")).first()
    share = min(1.0, sample / max(1, sizes["n"]), sample_chars / max(1, sizes["chars"] or 0))
    drawn = labels.where(F.pmod(F.xxhash64(id_col, F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About sample rows, whatever the table's size: the one side that is broadcast has this bound.
    rows = known.select(id_col, text_col).join(F.broadcast(drawn), id_col)
    found = rows.select(text_col, F.col("_label").cast("int"), F.xxhash64(id_col, text_col).alias("_order")).toPandas().sort_values("_order", kind="stable")
    words = [[w for _, _, w in sentences(t or "")] for t in found[text_col]]
    return fit_noisy_or(words, found["_label"].to_numpy(np.int64))


def sentence_scores(text: str, words: _Words, bias: float) -> list[tuple[int, int, float]]:
    """Start, end and log-odds of each sentence."""
    get = words.__getitem__
    return [(start, end, bias + sum(map(get, found))) for start, end, found in sentences(text)]


def _scores(batches: Iterator[pa.RecordBatch], model: SentenceModel) -> Iterator[pa.RecordBatch]:
    words = _Words(model.weights)
    for batch in batches:
        out = []
        for text in batch.column(batch.num_columns - 1):
            z = np.array([z for _, _, z in sentence_scores(text.as_py() or "", words, model.bias)])
            out.append(float(-np.expm1(-_softplus(z).sum())) if len(z) else 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], [*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, model: SentenceModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score, the probability that a document is toxic, to the columns keep of docs (all but score, if none are
    named). Every text is read whole, in one pass that shuffles nothing.

    Defined results: texts without a word, null ones too, have score 0. Rows are returned as often as they come; an
    empty table gives none.
    """
    keep = [c for c in docs.columns if c != "score"] if keep is None else keep
    slim = docs.select(*keep, F.col(text_col).alias("_read"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes[:-1]) + ", score double"
    return slim.mapInArrow(lambda batches: _scores(batches, shared.value), schema)


def _located(batches: Iterator[pa.RecordBatch], model: SentenceModel, least: float) -> Iterator[pa.RecordBatch]:
    words = _Words(model.weights)
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            t = text.as_py() or ""
            for start, end, z in sentence_scores(t, words, model.bias):
                p = float(1 / (1 + np.exp(-z)))
                if p >= least:
                    rows.append((key, start, end, p, t[start:end]))
        keys, *rest = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.float64(), pa.string()]
        columns = [pa.array([k.as_py() for k in keys], batch.column(0).type), *(pa.array(x, t) for x, t in zip(rest, types, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "start", "end", "score", "sentence"])


def offending_sentences(docs: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text", least: float = OFFENDING) -> DataFrame:
    """The sentences with a probability of least or more: id_col, start and end (code points, end exclusive), score,
    sentence. A toxic document may have none of them, if it is the sum of its sentences that makes it so.

    Defined results: null texts and ones without a word have none. Repeated rows give theirs as often as they come; an
    empty table gives none. Texts of any length are read whole; their sentences are cut as score() cuts them."""
    slim = docs.select(F.col(id_col).alias("id"), text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"id {slim.dtypes[0][1]}, start long, end long, score double, sentence string"
    return slim.mapInArrow(lambda batches: _located(batches, shared.value, least), schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """The fold whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    found = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))

"""A toxicity classifier that does not learn from mentions of groups of people.

This project keeps no text that people wrote, so the operators here are general:
any table with an id, a text and, for training, a label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.session import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
# Terms that name groups of people, interchangeable within a line
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "transgender"),
    ("immigrants", "natives"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
#: Bound of training: labelled rows used (expected).
MAX_SENTENCES = 8000
RIDGE, FAIRNESS, STEPS, RATE = 1e-3, 1.0, 150, 0.1
#: Standard errors by which a feature's log-odds of toxicity are above zero; no other bound on features.
SURE = 2.0
#: Words whose features a worker keeps; beyond it they are looked up anew.
KNOWN_WORDS = 1 << 17


def word_features(word: str) -> list[str]:
    """The whole word, marked, and its first letters."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swapped(words: set[str], terms: Sequence[Sequence[str]], shift: int) -> set[str]:
    """The words with each identity term replaced by a later one of its line."""
    other = {t: line[(i + shift) % len(line)] for line in terms for i, t in enumerate(line)}
    return {other.get(w, w) for w in words}


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of presence features; as many as the sample has that surely speak for toxicity."""

    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from text to score that keeps the features of known words, boundedly many."""
        index = {f: i for i, f in enumerate(self.weights)}
        values = np.array(list(self.weights.values()), np.float64)
        known: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            present: set[int] = set()
            for word in words_of(text):
                found = known.get(word)
                if found is None:
                    if len(known) > KNOWN_WORDS:
                        known.clear()
                    found = known[word] = tuple(index[f] for f in word_features(word) if f in index)
                if found:
                    present.update(found)
            total = self.bias + float(values[sorted(present)].sum())
            return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))

        return score


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feature, toxic = [], []
        for text, label in zip(batch.column("_text"), batch.column("_toxic").to_pylist(), strict=True):
            own = {f for w in words_of(text.as_py()) for f in word_features(w)}
            feature += own
            toxic += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(feature, pa.string()), pa.array(toxic, pa.int32())], names=["feature", "toxic"])


def _designs(features: Sequence[str], terms: Sequence[Sequence[str]]):
    """Places of the features in each text, and those that go and come in each counterfactual, which differs in identity terms alone."""
    index = {f: i for i, f in enumerate(features)}
    shifts = range(1, max((len(line) for line in terms), default=1))

    def places(words: set[str]) -> set[int]:
        return {index[f] for w in words for f in word_features(w) if f in index}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, gone, come = [], [], []
            for text in batch.column("_text"):
                words = words_of(text.as_py())
                here = places(words)
                there = [places(c) for s in shifts if (c := swapped(words, terms, s)) != words]
                own.append(sorted(here))
                gone.append([sorted(here - t) for t in there])
                come.append([sorted(t - here) for t in there])
            one, many = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
            columns = [batch.column("_hash"), batch.column("_toxic"), pa.array(own, one), pa.array(gone, many), pa.array(come, many)]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "toxic", "own", "gone", "come"])

    return run


def _chosen(hashed: Column, wanted: int, present: int) -> Column:
    """True for a share of evenly spread hashes, so that ``wanted`` of those present are expected."""
    return F.pmod(hashed, F.lit(1 << 32)) < F.lit(min(1.0, wanted / max(present, 1)) * (1 << 32))


def fit_toxicity(
    sentences: DataFrame, text: str = "text", toxic: str = "toxic", terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    fairness: float = FAIRNESS, max_sentences: int = MAX_SENTENCES,
) -> ToxicityModel:
    """Fit on labelled texts, of which an expected ``max_sentences`` at most are chosen by hash of the text.

    ``sentences`` has ``text`` and ``toxic`` (0 or 1). Features are the presence of words and
    word beginnings, all whose log-odds of toxicity are SURE standard errors above zero. The loss is
    class-balanced logistic loss, a ridge, and ``fairness`` times the mean squared change
    of the log-odds when identity terms in a text are swapped for others of their line,
    which takes the weight off terms that only happen to occur in toxic texts.

    Rows with a NULL label are left out, a NULL text is empty, a repeated text counts once
    and is toxic if any copy is, other columns are ignored. Without texts of both labels
    the score is 0 (or 1) for all.
    Only counts and the rows' few chosen features reach the driver.
    """
    labelled = sentences.select(F.col(text).cast("string").alias("_text"), (F.col(toxic) != 0).cast("int").alias("_toxic"))
    labelled = labelled.where("_toxic is not null").withColumn("_hash", F.xxhash64("_text"))
    distinct = labelled.select("_hash").distinct().count()
    chosen = labelled.where(_chosen(F.col("_hash"), max_sentences, distinct))
    sample = cut_lineage(chosen.groupBy("_hash").agg(F.max("_toxic").alias("_toxic"), F.first("_text").alias("_text")))
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    if positive == 0 or positive == n:
        return ToxicityModel({}, 500.0 if positive else -500.0)
    counts = sample.mapInArrow(_feature_counts, "feature string, toxic int")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    rate = F.log((F.col("a") + 0.5) / (positive + 1)) - F.log((F.col("b") + 0.5) / (n - positive + 1))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    features = [r[0] for r in counts.where(rate > error * SURE).select("feature").orderBy("feature").collect()]
    design = "hash long, toxic int, own array<int>, gone array<array<int>>, come array<array<int>>"
    rows = sample.mapInArrow(_designs(features, terms), design).toArrow()
    weights, bias = _descend(rows, len(features), fairness)
    return ToxicityModel(dict(zip(features, weights.tolist(), strict=True)), float(bias))


def _descend(rows: pa.Table, width: int, fairness: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on all rows at once; rows are put in order, so the result does not depend on tasks."""
    rows = rows.sort_by("hash").combine_chunks()
    y = rows["toxic"].to_numpy().astype(np.float64)
    gone, come = (pc.list_flatten(rows[c]).combine_chunks() for c in ("gone", "come"))
    pairs = len(gone)
    row, column = _places(rows["own"].combine_chunks())
    (lost, from_), (won, to) = _places(gone), _places(come)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = -1.0
    for step in range(1, STEPS + 1):
        total = np.bincount(row, w[column], len(y)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(total, -500, 500))) - y) * balance
        slope = np.append(np.bincount(column, error[row], width) + RIDGE * w[:-1], error.sum())
        if pairs:
            change = np.bincount(lost, w[from_], pairs) - np.bincount(won, w[to], pairs)
            swap = np.bincount(from_, change[lost], width) - np.bincount(to, change[won], width)
            slope[:-1] += fairness * 2 * swap / pairs
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], w[-1]


def _places(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element of the lists."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()


def score_toxicity(texts: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``texts`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 if score >= 0.5).

    The score depends on the text alone. NULL and empty texts get the score of no words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = pa.array([score(t.as_py()) for t in batch.column(text).cast(pa.string())], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    if text in ("score", "predicted"):
        raise ValueError(f"the text column may not be named {text}")
    kept = texts.drop("score", "predicted")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "score double"])
    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id"):
    """Fold that is never learned from: crc32 of the id as text, modulo 5, is 0; a NULL id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_on_labels(documents: DataFrame, labels: DataFrame, max_sentences: int = MAX_SENTENCES) -> ToxicityModel:
    """Fit on labelled documents outside the held-out fold; as the ids chosen are bounded, no texts are shuffled to them."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut_lineage(known)
    chosen = cut_lineage(known.where(_chosen(F.xxhash64("doc_id"), max_sentences, known.count())))
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return fit_toxicity(texts, max_sentences=max_sentences)

"""Quality classifier: supervised subword embeddings, averaged per document.

Each word and each of its character n-grams has a learned vector, found by hashing; a document is
the mean of the vectors of all its features, and a softmax over two classes sits on top. The
model is trained by plain stochastic gradient descent in numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortframe.session import materialised

#: Labelled documents the model is fitted on, at most.
MAX_TRAIN = 4_000
BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 16, 8, 6, 0.4, 7
N_GRAMS = (3, 4)
#: Words a worker keeps.
CACHE_ROWS = 500_000
#: Stands for a word that repeats the word before it.
AGAIN = "\x00again"


def features(word: str) -> list[int]:
    """Buckets of a word: the word itself and its character n-grams between boundary marks."""
    if word == AGAIN:
        return [xxhash.xxh32_intdigest(word) % BUCKETS]
    marked = f"<{word}>"
    found = [xxhash.xxh32_intdigest(marked) % BUCKETS]
    for n in N_GRAMS:
        found += [xxhash.xxh32_intdigest(marked[i : i + n], n) % BUCKETS for i in range(len(marked) - n + 1)]
    return found


def words_of(text: str) -> list[str]:
    """The words of a text; a word that repeats the one before it is replaced by a mark for that."""
    words = text.split()
    return [AGAIN if a == b else a for a, b in zip(words, [None, *words])]


@dataclass(frozen=True)
class Model:
    """``score[b]`` is what bucket ``b`` adds to the log-odds, the mean being taken over features."""

    score: np.ndarray
    bias: float


class _Words(dict):
    """Summed score and number of features of each word met so far."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> complex:
        found = features(word)
        value = complex(float(self.model.score[found].sum()), len(found))
        if len(self) < CACHE_ROWS:
            self[word] = value
        return value

    def probability(self, text: str) -> float:
        total = sum(map(self.__getitem__, words_of(text)), 0j)
        odds = total.real / max(total.imag, 1.0) + self.model.bias
        return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Stochastic gradient descent over documents given as buckets and their counts.

    Without documents every score is one half.
    """
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((DIM, 2))
    bias = np.zeros(2)
    steps = EPOCHS * len(documents)
    for step, k in enumerate(k for _ in range(EPOCHS) for k in random.permutation(len(documents))):
        buckets, counts = documents[k]
        if not len(buckets):
            continue
        rate = RATE * (1 - step / steps)
        share = (counts / counts.sum(dtype=np.float64))[:, None]
        hidden = (vectors[buckets] * share).sum(0)
        logits = hidden @ out + bias
        error = np.exp(logits - logits.max())
        error /= error.sum()
        error[labels[k]] -= 1
        vectors[buckets] -= rate * share * (out @ error) * min(len(buckets), 50)
        out -= rate * np.outer(hidden, error)
        bias -= rate * 0.1 * error
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    @lru_cache(maxsize=200_000)
    def known(word: str) -> list[int]:
        return features(word)

    for batch in batches:
        rows = []
        for text in batch.column(2):
            counts = np.bincount([b for w in words_of(text.as_py() or "") for b in known(w)], minlength=1)
            buckets = np.flatnonzero(counts)
            rows.append((buckets.astype(np.uint16).tobytes(), counts[buckets].astype(np.uint32).tobytes()))
        columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in zip(*rows))]
        if rows:
            yield pa.RecordBatch.from_arrays(columns, names=["place", "label", "buckets", "counts"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """A model of ``labels`` (``doc_id`` and ``label``, 0 or 1), fitted on whole texts.

    At most ``max_train`` labelled documents are used, chosen by the hash of their id; rows
    without an id or a label are no examples. A missing text counts as an empty one.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "label").limit(max_train)
    # Written first: the optimizer then knows how small it is, and no text is shuffled.
    examples = docs.select("doc_id", "text").join(materialised(chosen), "doc_id")
    examples = examples.select(F.xxhash64("doc_id", F.lit(SEED)).alias("place"), "label", "text")
    # Some kilobytes a document: the driver holds 4,000 of them in a few tens of megabytes.
    rows = examples.mapInArrow(_counted, "place long, label int, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r["place"], r["label"], bytes(r["buckets"][:64])))  # the order in which tasks end does not matter
    documents = [(np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["counts"], np.uint32)) for r in rows]
    return fit(documents, np.array([r["label"] for r in rows], int))


_WORKER: dict[int, _Words] = {}


def _worker_words(model: Model) -> _Words:
    key = hash((model.score.tobytes(), model.bias))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = _Words(model)
    return _WORKER[key]


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``name``, from the whole text alone.

    A missing text counts as empty; an empty one gets the model's prior. All other columns stay;
    one called ``name`` is replaced. Repeated rows get the same score.
    """
    docs = docs.drop(name)
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_words(shared.value)
        for batch in batches:
            scores = [words.probability(x or "") for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """True for the fifth of the documents that no label is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))

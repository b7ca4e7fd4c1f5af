"""Token counts by a two-tier lookup inside the map tasks: no pre-token is ever shuffled."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chunks in the broadcast table, and documents looked at to find them, shorter than so many
#: characters, so that the driver holds 20 MB of text at most. They set the speed only:
#: a chunk that the table lacks is encoded by the worker that meets it.
TABLE_ROWS = 50_000
TABLE_DOCS = 4_000
SAMPLE_CHARS = 5_000
#: Chunks a worker keeps besides the table.
CACHE_ROWS = 700_000
#: Texts handled at a time.
STEP = 256


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def chunks_of(text: str) -> list[str] | None:
    """The pre-token chunks of a text, or None where the text has to be encoded as a whole.

    The pre-tokenizer never joins a word with what stands before its leading blank, nor a line
    with the single line feed before it. So a text whose white space is single blanks and single
    line feeds between words falls apart at these: a chunk is a word, which stands for the word
    with a leading blank, or a line feed and a word. The first chunk has no blank before it;
    it is returned with a leading line feed's place empty, that is, as ``"\\r" + word``.
    Texts with other white space or with a string that may be a special token are left whole.
    """
    if "<|" in text or " ".join(text.split()) != text.replace("\n", " "):
        return None
    chunks = text.replace("\n", " \n").split(" ")
    chunks[0] = "\r" + chunks[0]
    return chunks


def _written(chunk: str) -> str:
    return chunk[1:] if chunk[:1] == "\r" else chunk if chunk[:1] == "\n" else " " + chunk


#: One mark behind a word is a pre-token of its own.
MARKS = frozenset(".,;:!?")


def byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write each byte as a letter: printable ones stay, the rest follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


LETTERS = byte_letters()


def spelled(word: str) -> str:
    """A word as the model of a byte-level tokenizer takes it."""
    return word.encode().decode("latin-1").translate(LETTERS)


class Lengths(dict):
    """Token numbers of chunks: the broadcast table first, then what this worker has met."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.limit = len(table) + CACHE_ROWS

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def __missing__(self, chunk: str) -> int:
        if chunk.isalpha():
            length = len(self.model.tokenize(spelled(" " + chunk)))
        elif chunk[-1:] in MARKS and chunk[:-1].isalpha():
            length = self[chunk[:-1]] + self.whole(chunk[-1])
        else:
            length = self.whole(_written(chunk))
        if len(self) < self.limit:
            self[chunk] = length
        return length

    def count(self, text: str) -> int:
        chunks = chunks_of(text)
        return self.whole(text) if chunks is None else sum(map(self.__getitem__, chunks))


_WORKER: dict[tuple, Lengths] = {}


def _worker_lengths(path: str, table: dict[str, int]) -> Lengths:
    """The lookup of this worker; it outlives the task, so that the next one finds a warm cache."""
    key = path, len(table)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Lengths(path, table)
    return _WORKER[key]


def frequent_chunks(texts: Iterable[str | None], path: str, rows: int = TABLE_ROWS) -> dict[str, int]:
    counts: Counter[str] = Counter()
    for text in texts:
        counts.update((chunks_of(text) or []) if text else [])
    chunks = [c for c, _ in counts.most_common(rows)]
    lengths = Lengths(path, {})
    return {c: lengths[c] for c in chunks}


def token_counts(
    docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens", table_docs: int = TABLE_DOCS
) -> DataFrame:
    """``docs`` with the number of tokens of each whole text in column ``name``.

    ``path`` is a tokenizer file of the ``tokenizers`` library; its defaults hold, without begin,
    end or added special tokens. A compact table of the chunks that are frequent in ``table_docs``
    documents is broadcast (at most ``TABLE_ROWS`` of them); all other chunks are encoded by the
    worker that meets them and kept in its bounded cache. Counts never depend on the table.

    A missing or empty text has 0 tokens. All columns stay; one that is called ``name`` is
    replaced. Repeated rows are counted each; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    sample = docs.select(F.col(text).alias("t")).where(F.length("t") < SAMPLE_CHARS).take(table_docs)
    table = spark.sparkContext.broadcast(frequent_chunks((r["t"] for r in sample), path))
    docs = docs.drop(name)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _worker_lengths(path, table.value)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                counts = [lengths.count(x) if x else 0 for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(counts, pa.int64())], names=[*part.schema.names, name]
                )

    return docs.mapInArrow(run, schema)

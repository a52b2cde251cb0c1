"""Problem 6: encoding of the whole corpus with a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deponent.llm.bpe import PairIndexEncoder

#: Folder of the vocabulary files, unless a caller names another.
TOKENIZERS = "/opt/tokenizers"
#: Characters of text that are indexed together; one longer text is a block of its own.
BLOCK_CHARS = 2_000_000
#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY_BYTES = 16_000_000

_ENCODERS: dict[int, PairIndexEncoder] = {}
_SHARED: dict[tuple[str, bytes], object] = {}


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The rank lines of a byte-level vocabulary."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def _broadcast(spark: SparkSession, lines: bytes):
    """One broadcast for each vocabulary of an application, however many frames use it."""
    key = (spark.sparkContext.applicationId, lines)
    if key not in _SHARED:
        for old in [k for k in _SHARED if k[0] != key[0]]:
            del _SHARED[old]  # of an application that has ended
        _SHARED[key] = spark.sparkContext.broadcast(lines)
    return _SHARED[key]


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for t in texts:
        if block and size + len(t or "") > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t or "")
    if block:
        yield block


def _encoder(shared) -> PairIndexEncoder:
    """One encoder for each vocabulary in a Python worker; its memory lasts over partitions."""
    lines = shared.value
    key = hash(lines)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PairIndexEncoder(lines)
    return _ENCODERS[key]


def encode_documents(documents: DataFrame, *, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, count_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids) of every document, or (doc_id, n_tokens) with ``count_only``; columns named in
    ``keep`` come along.

    No shuffle: each partition is encoded where it is read, block by block of at most BLOCK_CHARS
    characters; the vocabulary, a file of checked size, is broadcast. Defined results: a null and an
    empty text give the empty list (0 tokens); strings of special tokens are ordinary text; texts of
    any length are encoded whole; a null doc_id and repeated rows stay; an empty table gives no rows;
    further columns are ignored."""
    column, kind = ("n_tokens", "int") if count_only else ("ids", "array<int>")
    carried = ["doc_id", *keep]
    shared = _broadcast(documents.sparkSession, vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            done = 0
            for block in _blocks(batch.column("text").to_pylist()):
                ids = encoder.encode(block)
                out = pa.array([len(x) for x in ids], pa.int32()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(done, len(block)) for c in carried), out], names=[*carried, column])
                done += len(block)

    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name in carried]
    return picked.mapInArrow(run, ", ".join([*kept, f"{column} {kind}"]))

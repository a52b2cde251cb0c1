import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deponent.llm import encoding
from deponent.llm.bpe import PATTERN, PairIndexEncoder

if not os.path.exists(os.path.join(encoding.TOKENIZERS, "byte_bpe_50k.tiktoken")):
    pytest.skip("no vocabulary files", allow_module_level=True)

LINES = encoding.vocabulary()
ENCODER = PairIndexEncoder(LINES)


def other():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


OTHER = other()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab \n"), st.text("the cat's 0123é日😀<|endoftext|>")), max_size=8))
def test_same_ids_as_another_encoder(texts):
    assert ENCODER.encode(texts) == [OTHER.encode_ordinary(t) for t in texts]


def test_long_words_and_blocks():
    r = random.Random(2)
    texts = ["a" * 30_000, "ab" * 10_000, " " * 9_000, "".join(r.choice("abcde") for _ in range(50_000)), "", None, "\0"]
    assert ENCODER.encode(texts) == [OTHER.encode_ordinary(t) if t else [] for t in texts]
    assert [sum(len(t or "") for t in b) for b in encoding._blocks(["x" * 3_000_000, "y", None, "z" * 1_999_999])] == [3_000_000, 2_000_000]


def test_ids_give_the_text_back():
    for t in ("Zażółć gęślą jaźń", "naïve\r\n\ttab", "🙂🙃"):
        assert b"".join(ENCODER.bytes_of[i] for i in ENCODER.encode([t])[0]).decode() == t


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr("deponent.llm.bpe.REMEMBERED", 3)
    e = PairIndexEncoder(LINES)
    for t in ("one two three", "four five six", "one two three"):
        assert e.encode([t]) == [OTHER.encode_ordinary(t)]
    assert len(e.known) <= 6


def test_not_a_byte_vocabulary():
    with pytest.raises(ValueError):
        PairIndexEncoder(base64.b64encode(b"a") + b" 0")


def test_table(spark):
    data = [(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (None, "x"), (1, "hello world")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumns({"ids": F.lit("clash"), "out": F.lit(1)})
    got = sorted(((r["doc_id"], r["ids"]) for r in encoding.encode_documents(df).collect()), key=repr)
    assert got == sorted(((d, OTHER.encode_ordinary(t) if t else []) for d, t in data), key=repr)
    assert dict(encoding.encode_documents(df).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    counted = encoding.encode_documents(df.withColumn("source", F.lit("s")), count_only=True, keep=("source",))
    assert sorted((tuple(r) for r in counted.collect()), key=repr) == sorted(((d, "s", len(OTHER.encode_ordinary(t)) if t else 0) for d, t in data), key=repr)
    assert encoding.encode_documents(df.limit(0)).count() == 0


def test_large_vocabulary_is_refused(tmp_path, monkeypatch):
    (tmp_path / "v.tiktoken").write_bytes(b"x" * 100)
    monkeypatch.setattr(encoding, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        encoding.vocabulary("v", str(tmp_path))

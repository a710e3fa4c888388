"""The word memo against the library's own encoding of whole texts."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from calibrium.llm import tokens

WORDS = tokens.WordEncoder(tokens.tokenizer_path())
ALPHABET = list("aAbZ İıſßẞªºµÿŸéÉÄ'strevdlm\n\t\r\x1c\x85\xa0.,;!?<|>~̱́HKKσΣς字７²½#‍😀-_09")


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.sampled_from(ALPHABET), max_size=40), st.text(max_size=30), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "It's", "DON'T", "x<|endoftext|>y", "naïve,", "e.g.", " ", "\n"]), max_size=6).map("".join)))
def test_same_ids(text):
    assert WORDS.encode(text) == WORDS.library(text)


def test_whole_documents(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        assert WORDS.encode(r.text) == WORDS.library(r.text)


def test_full_memo_starts_anew():
    words = tokens.WordEncoder(tokens.tokenizer_path(), limit=2000)
    text = " ".join(f"w{'abcdefghij'[i % 10] * (i // 10 + 1)}. {'x' * 90}{i}" for i in range(60))
    for _ in range(3):
        assert words.encode(text) == words.library(text) and words.encode(text[::-1]) == words.library(text[::-1])
        assert words.memo.held <= 1000 and len(words.memo) + len(words.memo.older) < 12
    assert words.encode(None) == b""


def test_other_tokenizer_files_go_to_the_library():
    other = tokens.WordEncoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert not other.by_chunk and WORDS.by_chunk
    text = "Two  blanks,\nand Capitals don't vanish"
    assert other.encode(text) == other.library(text)


def test_workers_let_go_of_what_they_keep():
    from calibrium.llm.common import let_go
    from calibrium.llm.tokens import _ENCODERS, _TOKENIZERS, encoder, tokenizer_path

    before = encoder(tokenizer_path()).encode("some words")
    assert _ENCODERS and _TOKENIZERS
    let_go()
    assert not _ENCODERS and not _TOKENIZERS and encoder(tokenizer_path()).encode("some words") == before


def test_a_task_that_leaves_nothing(spark):
    from calibrium.llm import packing
    from calibrium.llm.common import leaves_nothing
    from calibrium.llm.tokens import _ENCODERS, _TOKENIZERS, encoder, tokenizer_path

    def task(batches):
        words = encoder(tokenizer_path())
        for x in batches:
            yield words.encode(x)

    def failing(batches):
        encoder(tokenizer_path())
        yield from batches
        raise ValueError("odd")

    texts = ["some words", None, ""]
    assert list(leaves_nothing(task)(iter(texts))) == [WORDS.encode(x) for x in texts] and not _ENCODERS and not _TOKENIZERS
    with pytest.raises(ValueError, match="odd"):
        list(leaves_nothing(failing)(iter(texts)))
    assert not _ENCODERS and not _TOKENIZERS

    class Rows:  # what token_pieces needs of a table, here without Spark: its task runs in this process
        def select(self, *_):
            return self

        def mapInArrow(self, task, _schema):  # noqa: N802
            batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([3]), "text": pa.array(["some words"])})
            return list(task(iter([batch])))

    out = packing.token_pieces(Rows(), tokenizer_path())
    assert out[0].column("length").to_pylist() == [len(WORDS.encode("some words")) // 4 + 1]
    assert not _ENCODERS and not _TOKENIZERS

import zlib

import numpy as np
import pytest
import tokenizers

import public_tokenizers
from cohortlens.llm import vector_packing as V
from cohortlens.llm.queries import BYTE_BPE
from tests.llm.conftest import prose

HF = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "a  b\n\n c\t\td", "<|endoftext|>x <|endoftext|>", "it's 'll  ", "é日本\x85\xa0\u2028z", "x" * 5000]


def ids_of(text):
    return np.array([*HF.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(text):
    bpe = V.ByteBpe(BYTE_BPE["ranks"], BYTE_BPE["pattern"], BYTE_BPE["special"])
    assert bpe.ids(text) == ids_of(text)[:-1].tobytes()


def check(rows, texts, limits, repeated=()):
    """Every id lies in one piece; sequences are gapless, within the limits and of a length without padding."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = ids_of(texts[i])
        if i in repeated:
            continue
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == limits.tokens or at & (at - 1) == 0
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(p["loss_tokens"] for p in pieces) <= limits.loss


@pytest.mark.parametrize("limits", [V.Limits(), V.Limits(tokens=64, segments=3, loss=40, window=8), V.Limits(tokens=16, segments=1, loss=16, window=2)])
def test_pieces(documents, limits):
    texts = {k: prose(k, 3 + 37 * k % 900) for k in range(60)} | dict(enumerate(ODD, 100)) | {200: None}
    rows = V.pack(documents(list(texts.items()), extra=True), **BYTE_BPE, limits=limits).collect()
    check(rows, texts, limits)


def test_prompt_tokens_bear_no_loss(spark):
    df = spark.createDataFrame([(k, prose(k, 40), 30) for k in range(20)], "doc_id long, text string, prompt int")
    limits = V.Limits(tokens=256, loss=100)
    rows = V.pack(df, **BYTE_BPE, limits=limits, prompt_tokens_col="prompt").collect()
    check(rows, {k: prose(k, 40) for k in range(20)}, limits)
    total = sum(len(ids_of(prose(k, 40))) - 30 for k in range(20))
    assert sum(r["loss_tokens"] for r in rows) == total


def test_null_ids_repeats_and_empty_table(documents):
    rows = V.pack(documents([(None, "a b"), (1, "same"), (1, "same")]), **BYTE_BPE).collect()
    check(rows, {None: "a b", 1: "same"}, V.Limits(), repeated={1})
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 2 * len(ids_of("same"))
    assert V.pack(documents([]), **BYTE_BPE).count() == 0


def test_little_is_lost_to_short_sequences(documents):
    texts = [(k, prose(k, 400)) for k in range(120)]
    rows = V.pack(documents(texts).coalesce(1), **BYTE_BPE).collect()
    full = {r["sequence_id"] for r in rows if r["length"]}
    assert len(full) <= -(-sum(len(ids_of(t)) for _, t in texts) // 2048) + 11

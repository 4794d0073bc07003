import hashlib
import random
from array import array

import tokenizers

import public_tokenizers
from cohortlens.llm import trie_bpe as B
from cohortlens.llm.queries import WORD_BPE
from tests.llm.conftest import prose

HF = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(text):
    ids = HF.encode(text or "", add_special_tokens=False).ids
    return array("I", ids).tobytes(), HF.decode(ids, skip_special_tokens=False)


def test_encoder_equals_the_library():
    r = random.Random(5)
    letters = list("abcdeSTr  \n\t\x1c\x1f\x85\xa0\u2028éß日１²Ⅷİ ΣςσÅ<|>!?.,_-'") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "the", "ing", "e\u0301"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(20))) for _ in range(4000)] + [prose(1, 300), "thing" * 3000, "x" * 20000, "a", "Σ"]
    got = B.Encoder(WORD_BPE["path"], WORD_BPE["pattern"]).encode(texts)
    assert got == [expected(t) for t in texts]


def test_words_made_of_tokens():
    e = B.Encoder(WORD_BPE["path"], WORD_BPE["pattern"])
    parts = sorted(t.removesuffix(B.END) for t in e.vocabulary.ids if t.removesuffix(B.END).isalpha() and t.isascii())[::40]
    r = random.Random(6)
    words = ["".join(r.choice(parts) for _ in range(3)) for _ in range(3000)]
    assert [a for a, _ in e.encode(words)] == [expected(w)[0] for w in words]


def test_table(documents):
    texts = {1: None, 2: "", 3: "Hello  World's <|endoftext|>", 4: prose(4, 200), None: "no id"}
    got = {r["doc_id"]: r for r in B.encode(documents([*texts.items(), (4, texts[4])], extra=True), **WORD_BPE).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids, decoded = expected(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[i]["decoded"] == decoded and got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert array("I", got[i]["ids"]).tobytes() == ids
    assert B.encode(documents([]), **WORD_BPE).count() == 0

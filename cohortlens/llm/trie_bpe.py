"""BPE encoding of texts by prefix-sharing trie traversal, and decoding.

The distinct words of a batch form a trie over their symbols.  A depth-first walk keeps, for
every prefix on the path, the last token of the prefix's encoding; the encoding of a prefix is
its last token after the encoding of what precedes it.  The last token of a longer prefix is
the one token ending there that may follow the last token of the prefix before it, so
prefixes that words share are encoded once, and a word's ids are read off by walking back.

Two tokens may follow each other when merging their symbols never joins a piece of one with a
piece of the other; `Vocabulary.may_follow` steps through the two facing sides in the
order of merge ranks.  Known words are looked up in a cache of bounded size, so each worker
process encodes a word about once.  Nothing is shuffled: texts are encoded in the scan tasks.

Normalisation is NFC, runs of white space to one blank, lower case; words are the matches of a
pattern, and white space is dropped.  Strings of special tokens stand for their ids wherever they
occur.  Decoding joins the tokens of the ids with blanks, as the vocabulary has no decoder.

Defined results: a null text is the empty text (no ids, empty decoded text); a null id is
kept; repeated rows are encoded one by one; other columns of the input are ignored.
"""
from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte (the byte-level alphabet)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in out)
    out.update({b: chr(256 + k) for k, b in enumerate(hidden)})
    return [out[b] for b in range(256)]


class Vocabulary:
    """Tokens, and which of them may stand next to each other."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank of the merge that makes it
        self.merged: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left, right] = k
            self.parts.setdefault(whole, (left, right, k))
        self.symbols = byte_symbols()
        self.follows: dict[tuple[int, int], bool] = {}
        # every ending of a token, with the token's id where it is a whole one and else -1
        self.open_tails: dict[str, int] = {}
        self.end_tails: dict[str, int] = {}
        for t, i in self.ids.items():
            tails, plain = (self.end_tails, t.removesuffix(END)) if t.endswith(END) else (self.open_tails, t)
            for k in range(1, len(plain)):
                tails.setdefault(plain[k:], -1)
            if self._whole(i):
                tails[plain] = i

    def _side(self, token: int, right: bool) -> list[tuple[int, int]]:
        """(piece, rank of the merge that ends it) along one side, from the single symbol to the whole token."""
        out, until = [], 1 << 60
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            left_part, right_part, until = self.parts[token]
            token = right_part if right else left_part

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 500_000:
                self.follows.clear()
            known = self.follows[key] = self._stay_apart(self._side(a, True), self._side(b, False))
        return known

    def _stay_apart(self, a: list[tuple[int, int]], b: list[tuple[int, int]]) -> bool:
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            joined = self.rank.get((x, y))
            if joined is not None and joined < x_until and joined <= y_until:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Little-endian ids of each distinct word (not empty).

        Sorted by their symbols, the words are the leaves of their trie in depth-first order: what a
        word shares with the one before it is the path that stays, with its last-token states.
        """
        spell = self.symbols.__getitem__
        leaves = sorted(("".join(map(spell, w.encode("utf-8"))), w) for w in words)
        out: dict[str, bytes] = {}
        tokens: list[int] = []  # of the prefix that ends at each depth: its last token, and where that begins
        starts: list[int] = []
        before, found = "", []
        open_tail, end_tail, known = self.open_tails.get, self.end_tails.get, self.follows.get
        for spelled, word in leaves:
            end = len(spelled) - 1
            shared, most = 0, min(end, len(tokens))
            while shared < most and spelled[shared] == before[shared]:
                shared += 1
            del tokens[shared:], starts[shared:]
            for depth in range(shared, end + 1):
                # endings of this prefix that are tokens, short to long; one of them is its last token
                tail = open_tail if depth < end else end_tail
                stop, start = depth + 1, depth
                found.clear()
                while start >= 0:
                    token = tail(spelled[start:stop])
                    if token is None:
                        break
                    if token >= 0:
                        found.append(token)
                        found.append(start)
                    start -= 1
                while True:
                    start, token = found.pop(), found.pop()
                    if not start:
                        break
                    ok = known((tokens[start - 1], token))
                    if ok or ok is None and self.may_follow(tokens[start - 1], token):
                        break
                tokens.append(token)
                starts.append(start)
            ids, at = [tokens.pop()], starts.pop()
            while at:
                ids.append(tokens[at - 1])
                at = starts[at - 1]
            ids.reverse()
            out[word] = array("I", ids).tobytes()
            before = spelled
        return out

    @functools.lru_cache(maxsize=100_000)  # noqa: B019  (one vocabulary for each worker process)
    def _whole(self, token: int) -> bool:
        """Whether the token's own symbols merge into it."""
        if token not in self.parts:
            return True
        left, right, _ = self.parts[token]
        return self._whole(left) and self._whole(right) and self._meet(left, right)

    def _meet(self, left: int, right: int) -> bool:
        """Whether two whole tokens stay untouched until their own merge."""
        a, b, i, j = self._side(left, True), self._side(right, False), 0, 0
        while i < len(a) - 1 or j < len(b) - 1:
            (x, x_until), (y, y_until) = a[i], b[j]
            joined = self.rank.get((x, y))
            if joined is not None and joined < x_until and joined <= y_until:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        return True


class Encoder:
    """ids and decoded pieces of whole texts; words, and chunks between blanks, are cached."""

    CACHE = 400_000

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(pattern)  # its first letter-run branch takes a chunk of letters whole
        self.space = re.compile(r"[\s\x85\xa0]+")
        special = self.vocabulary.special
        self.special = re.compile("(" + "|".join(sorted(map(re.escape, special), key=len, reverse=True)) + ")") if special else None
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.known: dict[str, tuple[bytes, str]] = {}  # by word

    @staticmethod
    def normalise(text: str) -> list[str]:
        """Chunks between white space of the normalised text; lower case is taken letter by letter."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            for c in _SEPARATORS & set(text):  # control characters that are no white space here
                text = text.replace(c, _SEPARATORS_TO[c])
            chunks = text.replace("Σ", "σ").lower().split()
        else:
            for c in _SEPARATORS & set(text):
                text = text.replace(c, _SEPARATORS_TO[c])
            chunks = text.lower().split()
        if any(s in text for s in _SEPARATORS_TO.values()):
            back = {v: k for k, v in _SEPARATORS_TO.items()}
            chunks = ["".join(back.get(c, c) for c in x) for x in chunks]
        return chunks

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that are not cached, all in one trie."""
        fresh = []
        for c in chunks:
            if c not in self.cache:
                if c in self.older:
                    self.cache[c] = self.older[c]
                else:
                    fresh.append(c)
        split = {c: self._words_of(c) for c in fresh}
        known, tokens = self.known, self.vocabulary.tokens
        if len(known) > 2 * self.CACHE:
            known.clear()
        for w, ids in self.vocabulary.encode_words([w for w in {w for found in split.values() for w in found} if w not in known]).items():
            known[w] = (ids, " ".join(map(tokens.__getitem__, array("I", ids))))
        for c, found in split.items():
            if len(found) == 1:
                self.cache[c] = known[found[0]]
            else:
                own = [known[w] for w in found]
                self.cache[c] = (b"".join([a for a, _ in own]), " ".join([b for _, b in own]))

    def _words_of(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.words.findall(chunk)

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Little-endian ids and the decoded text of every text."""
        split = []
        for text in texts:
            pieces = self.special.split(text) if self.special and self.special.search(text) else [text]
            split.append([p if k % 2 else self.normalise(p) for k, p in enumerate(pieces)])
        if len(self.cache) > self.CACHE:
            self.older, self.cache = self.cache, {}
        self.learn({c for pieces in split for p in pieces if isinstance(p, list) for c in p})
        get, out = self.cache.__getitem__, []
        for pieces in split:
            ids, decoded = [], []
            for p in pieces:
                if isinstance(p, str):
                    ids.append(array("I", [self.vocabulary.special[p]]).tobytes())
                    decoded.append(p)
                elif p:
                    a, b = zip(*map(get, p), strict=True)
                    ids += a
                    decoded += b
            out.append((b"".join(ids), " ".join(filter(None, decoded))))
        return out


#: Characters that Python's str.split takes for white space though they have no such property.
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
_SEPARATORS_TO = {c: chr(0xF0000 + ord(c)) for c in sorted(_SEPARATORS)}


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process, reused by its later tasks."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, batch: int = 1024) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<long>) and decoded (string)."""
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields += [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path, pattern)
        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                coded = bpe.encode(part["text"].tolist())
                out = {
                    id_col: part["id"].to_numpy(),
                    "n_tokens": [len(a) // 4 for a, _ in coded],
                    "ids_sha256": pd.Series([hashlib.sha256(a).hexdigest() for a, _ in coded], dtype=object),
                    "decoded_sha256": pd.Series([hashlib.sha256(b.encode("utf-8")).hexdigest() for _, b in coded], dtype=object),
                }
                if ids:
                    out["ids"] = pd.Series([array("I", a).tolist() for a, _ in coded], dtype=object)
                    out["decoded"] = pd.Series([b for _, b in coded], dtype=object)
                yield pd.DataFrame(out)

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInPandas(run, T.StructType(fields))

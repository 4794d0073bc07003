"""Vector bin packing of tokenised examples into fixed-length sequences.

Every example is a demand vector (tokens, one segment, loss-bearing tokens) and
every sequence a bin with a limit on each of the three.  Bins are filled by the
dot-product heuristic: among the pending pieces that fit, take the one whose
demand has the largest dot product with the capacity that is left (both in
shares of the limits).  When nothing fits, the longest piece is cut so that the
bin is filled exactly; the rest of it stays pending.

Packing runs inside each scan task over a bounded window of pending pieces, so
there is no shuffle, no group and no driver state; a lost task repeats the same
work on the same input split and gives the same rows.  A sequence that cannot be
filled (segment or loss limit reached, or the end of a task) is closed at the
largest power of two it covers, where no padding is added; what lies beyond
stays pending.  A task thus leaves at most log2(max_tokens) short sequences.

Defined results: a null text is the empty text (its ids are the end id alone); a
null id is kept as null; repeated rows are separate examples; an empty table
gives no rows; other columns of the input are ignored.
"""
from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048
    window: int = 256  # pending pieces from which bins are filled


class ByteBpe:
    """ids of a text for the byte-level vocabulary.

    `ranks` is the vocabulary file (token bytes in base64 and rank per line), `special` the
    strings that the vocabulary treats as one id wherever they occur.  In a text without two
    white-space characters in a row, the pattern's last two branches match single characters
    only, so a pattern without look-ahead gives the same pre-tokens in less time.
    """

    DOUBLE = re.compile(r"\s\s")
    SPACES = (r"|\s+(?!\S)|\s+", r"|\s")

    def __init__(self, ranks: str, pattern: str, special: dict[str, int]):
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        make = lambda p: tiktoken.Encoding("byte_bpe", pat_str=p, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.encode = self.encode_single = make(pattern)
        if pattern.endswith(self.SPACES[0]):
            self.encode_single = make(pattern.removesuffix(self.SPACES[0]) + self.SPACES[1])
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _plain(self, text: str) -> bytes:
        encode = self.encode if self.DOUBLE.search(text) else self.encode_single
        return array("I", encode(text)).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        return b"".join(
            array("I", [self.special[part]]).tobytes() if part in self.special else self._plain(part)
            for part in self.split.split(text) if part
        )


@functools.lru_cache(maxsize=2)
def byte_bpe(ranks: str, pattern: str, special: tuple[tuple[str, int], ...]) -> ByteBpe:
    """One instance per worker process, reused by its later tasks."""
    return ByteBpe(ranks, pattern, dict(special))


class _Packer:
    """Pending pieces and the bins made of them; a piece is [doc, ids, start, end, loss_from]."""

    def __init__(self, limits: Limits):
        self.lim = limits
        self.pool: list[list] = []
        self.length = np.zeros(0)
        self.loss = np.zeros(0)
        self.n_bins = 0

    @staticmethod
    def _loss(piece: list) -> int:
        return max(0, piece[3] - max(piece[2], piece[4]))

    def add(self, piece: list) -> None:
        self.pool.append(piece)
        self.length = np.append(self.length, piece[3] - piece[2])
        self.loss = np.append(self.loss, self._loss(piece))

    def _take(self, k: int) -> list:
        piece = self.pool[k]
        last = len(self.pool) - 1
        self.pool[k] = self.pool[last]
        self.pool.pop()
        for a in (self.length, self.loss):
            a[k] = a[last]
        self.length, self.loss = self.length[:last], self.loss[:last]
        return piece

    def _cut(self, k: int, tokens: int, loss: int) -> list | None:
        """The longest head of pending piece k within both limits; its tail stays pending."""
        piece = self.pool[k]
        end = min(piece[3], piece[2] + tokens, max(piece[2], piece[4]) + loss)
        if end <= piece[2]:
            return None
        head = [piece[0], piece[1], piece[2], end, piece[4]]
        piece[2] = end
        self.length[k], self.loss[k] = piece[3] - piece[2], self._loss(piece)
        return head

    def _fill(self) -> list[list]:
        lim, out = self.lim, []
        tokens, segments, loss = lim.tokens, lim.segments, lim.loss
        while self.pool and tokens and segments:
            score = self.length * (tokens / lim.tokens**2) + self.loss * (loss / lim.loss**2) + segments / lim.segments**2
            score[(self.length > tokens) | (self.loss > loss)] = -1.0
            k = int(score.argmax())
            piece = self._take(k) if score[k] >= 0 else self._cut(int(self.length.argmax()), tokens, loss)
            if piece is None:
                break
            out.append(piece)
            tokens, segments, loss = tokens - (piece[3] - piece[2]), segments - 1, loss - self._loss(piece)
        return out

    def _close(self, content: list[list]) -> list[list]:
        """Cut the content back to a length that needs no padding."""
        total = sum(p[3] - p[2] for p in content)
        keep = self.lim.tokens if total == self.lim.tokens else 1 << (total.bit_length() - 1)
        while total > keep:
            piece = content.pop()
            size = min(piece[3] - piece[2], total - keep)
            if size < piece[3] - piece[2]:
                content.append([piece[0], piece[1], piece[2], piece[3] - size, piece[4]])
            self.add([piece[0], piece[1], piece[3] - size, piece[3], piece[4]])
            total -= size
        return content

    def bins(self, least: int) -> Iterator[tuple[int, list[list]]]:
        """Bins while more than `least` pieces wait (0: until none is left)."""
        while len(self.pool) > least and (not least or self.length.sum() >= self.lim.tokens):
            content = self._close(self._fill())
            yield self.n_bins, content
            self.n_bins += 1

    def whole(self) -> int:
        self.n_bins += 1
        return self.n_bins - 1


def pack(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    special: dict[str, int],
    end_id: int,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_tokens_col: str | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    `prompt_tokens_col` gives how many leading ids of an example bear no loss (instruction
    data); without it only the first id bears none, as nothing precedes it.
    """
    if min(limits.tokens, limits.segments, limits.loss, limits.window) < 1:
        raise ValueError("limits must be positive")
    id_type = docs.schema[id_col].dataType
    prompt = F.coalesce(F.col(prompt_tokens_col).cast("long"), F.lit(0)) if prompt_tokens_col else F.lit(1).cast("long")
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("loss_tokens", T.LongType()),
    ])
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, packer, rows = byte_bpe(ranks, pattern, tuple(special.items())), _Packer(limits), []
        base, end = TaskContext.get().partitionId() << 33, np.array([end_id], dtype="<u4").tobytes()

        def emit(number: int, content: list[list]) -> None:
            offset = 0
            for doc, ids, start, stop, loss_from in content:
                rows.append((doc, start, stop - start, zlib.crc32(ids[4 * start:4 * stop]), len(ids) // 4, base + number, offset, max(0, stop - max(start, loss_from))))
                offset += stop - start

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            rows.clear()
            return out

        for batch in batches:
            for doc, text, prompt_tokens in zip(batch["id"].tolist(), batch["text"], batch["prompt"].tolist(), strict=True):
                ids = bpe.ids(text) + end
                n, start = len(ids) // 4, 0
                loss_from = min(max(prompt_tokens, 0), n)
                while n - start >= limits.tokens and min(limits.tokens, n - max(start, loss_from)) <= limits.loss:
                    emit(packer.whole(), [[doc, ids, start, start + limits.tokens, loss_from]])
                    start += limits.tokens
                if start < n:
                    packer.add([doc, ids, start, n, loss_from])
                if len(packer.pool) >= limits.window:
                    for number, content in packer.bins(limits.window // 2):
                        emit(number, content)
                if len(rows) >= 20_000:
                    yield frame()
        for number, content in packer.bins(0):
            emit(number, content)
        yield frame()

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), prompt.alias("prompt"))
    return source.mapInPandas(run, schema)

"""Statistics of one whole text, used as inputs of the text classifiers."""
from __future__ import annotations

import math
import zlib
from collections import Counter
from operator import eq

import numpy as np

_SENTENCE, _QUOTE, _SYMBOL = ".,;:?", "'\"()-", "#$%&*@^~|\\<>{}[]=+_/`"
_CLASS = np.zeros(256, dtype=np.int64)  # of a byte: 0 other
for _k, _chars in enumerate((_SENTENCE, _QUOTE, _SYMBOL, "!", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\r\n\v\f"), start=1):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 9  # bytes of letters and signs beyond ASCII

#: Function words of the four languages of the corpus (fixed values).
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his at this are or from an but "
    "der die das und ist zu den von mit im auf für nicht ein eine dem des sich sie es auch "
    "le la les de des et un une est que qui dans pour pas sur au du en ne ce par avec "
    "el los las y una es por con para no se lo del al como su o".split()
)

NAMES = (
    "log_words", "word_length", "word_length_sd", "unique_words", "top_word", "repeated_next", "function_words",
    "sentence_marks", "quotes", "symbols", "exclamations", "digits", "upper", "white", "beyond_ascii",
    "line_words", "unique_lines", "compression", "capital_words",
)


def _logit(x: float, floor: float = 1e-3) -> float:
    return math.log((x + floor) / (1 - x + floor))


def text_stats(text: str) -> list[float]:
    """Transformed statistics of NAMES; shares go through a floored logit, counts through a log."""
    words = text.split()
    n = len(words)
    raw = text.encode("utf-8", "replace")
    size = max(len(raw), 1)
    share = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256), minlength=10) / size
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n) if n else np.zeros(1)
    lines = text.split("\n")
    m = max(n, 1)
    return [
        math.log1p(n),
        math.log1p(float(lengths.mean())),
        math.log1p(float(lengths.std())),
        math.log1p(len(counts)) - math.log1p(n),
        _logit((counts.most_common(1)[0][1] if n > 1 else 0) / m),
        _logit(sum(map(eq, words, words[1:])) / m),
        _logit(sum(counts[w] for w in FUNCTION_WORDS & counts.keys()) / m),
        _logit(share[1]), _logit(share[2]), _logit(share[3]), _logit(share[4]), _logit(share[5]),
        _logit(share[6] / max(share[6] + share[7] + share[9], 1e-9)), _logit(share[8]), _logit(share[9]),
        math.log1p(n / len(lines)),
        math.log(len(set(lines)) / len(lines)),
        math.log((len(zlib.compress(raw, 1)) + 1) / size),
        _logit(sum(map(str.isupper, words)) / m),
    ]

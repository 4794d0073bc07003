"""From the text of a formula to its checked syntax trees.

Python's tokenizer cuts the text up, so a filter keyword or a lone `=` only counts where it is
a token of its own, never inside quoted text.
"""
from __future__ import annotations

import ast
import io
import tokenize
import unicodedata

# fixed values: limits and filter keywords of the formula language
MAX_EXPR_LEN = 300
MAX_NODES = 120
FILTER_KEYWORDS = ("onde", "where")

_MARKS = dict.fromkeys(range(0x300, 0x370))  # combining accents, deleted by str.translate


class FormulaError(ValueError):
    pass


def fold_name(name: str) -> str:
    """The form under which column and function names are compared (O-118)."""
    return unicodedata.normalize("NFKD", name).translate(_MARKS).lower().strip()


def _tokens(text: str) -> list[tokenize.TokenInfo]:
    layout = {tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER}
    try:
        return [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in layout]
    except (tokenize.TokenError, SyntaxError) as exc:
        raise FormulaError(f"the formula can't be read: {exc.args[0]}") from exc


def _tree(tokens: list[tokenize.TokenInfo], role: str) -> ast.Expression:
    if not tokens:
        raise FormulaError(f"the {role} is missing")
    source = " ".join("==" if t.string == "=" and t.type == tokenize.OP else t.string for t in tokens)
    try:
        tree = ast.parse(source, mode="eval")
    except SyntaxError as exc:
        raise FormulaError(f"the {role} is not valid: {exc.msg}") from exc
    size = 0
    for size, _ in enumerate(ast.walk(tree), start=1):
        if size > MAX_NODES:
            raise FormulaError(f"the {role} has more than {MAX_NODES} parts")
    return tree


def read_formula(text: str | None) -> tuple[ast.Expression, ast.Expression | None]:
    """(expression, filter or None) of a formula such as `media(g3) onde effort >= 3`."""
    line = " ".join((text or "").split("\n")).strip()
    if not line:
        raise FormulaError("the formula is empty")
    tokens = _tokens(line)
    keyword = next((k for k, t in enumerate(tokens) if t.type == tokenize.NAME and t.string.lower() in FILTER_KEYWORDS), None)
    sides = [tokens] if keyword is None else [tokens[:keyword], tokens[keyword + 1:]]
    for side in sides:
        if side and side[-1].end[1] - side[0].start[1] > MAX_EXPR_LEN:
            raise FormulaError(f"a formula may have {MAX_EXPR_LEN} characters")
    return _tree(sides[0], "expression"), _tree(sides[1], "condition") if keyword is not None else None

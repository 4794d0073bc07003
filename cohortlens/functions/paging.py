"""Numbered pages of an ordered table."""
from __future__ import annotations

from pyspark.sql import DataFrame


def numbered_page(rows: DataFrame, order: str, wanted: int, size: int) -> tuple[int, int, int, DataFrame]:
    """(total, pages, page, rows of that page); a number out of range means the nearest page there is."""
    total = rows.count()
    full, rest = divmod(total, size)
    pages = full + bool(rest) or 1
    page = sorted((1, wanted, pages))[1]
    return total, pages, page, rows.orderBy(order).offset(size * (page - 1)).limit(size)

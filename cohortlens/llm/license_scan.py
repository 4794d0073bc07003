"""License notices in whole texts, by MinHash bands over overlapping text windows.

A template is the set of its 5-word shingles (a shorter one its whole word sequence).  For a
template of s shingles, a text is covered by windows of s + step - 1 shingles, step = ceil(s / 4)
apart, so that some window holds any occurrence whole.  A window and a template meet when they
agree in one of BANDS MinHash values; a window that holds `percent` of the template has a
Jaccard similarity of at least 0.55 with it, so it is missed with a probability below
0.45 ** 20 (1e-7).  Windows that meet are verified by exact shingle containment.

A MinHash value agrees only if the window holds the very shingle that is the template's
smallest under that hash.  So texts are first searched for those anchor shingles (BANDS for each
template, a bounded set), and windows are only built where one of them stands; no window that
would meet a template is left out.  Each text is scanned once, inside its row: the shingles of a
text are never rows of their own, and nothing but the matches is shuffled.  Only DataFrame
functions are used.

The templates of one family differ in a few words (version, Lesser, Affero, ShareAlike): a match
must hold the words that tell its license from the others (`license_texts.required`) between
its first and last shingle.  Where matches of different licenses lie over each other, the one with the
most shingles in common wins, then the one with the higher containment, over those that lie
half or more below it; equal ones stay.

Words are runs of letters and digits in lower case.  Overlapping matches of one template in a
document are one match, with the best containment.

Defined results: texts that are null, empty or without a template give no row; matches of rows
with one id (also null) are merged; other columns of the input are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_texts import NOTICES, WHOLE, required

WIDTH, BANDS = 5, 20

#: Texts of widely used license notices as (license, variant, text).
TEMPLATES = [
    ("Apache-2.0", "line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "line", "Released under the MIT License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("BSD", "clauses", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
     "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Proprietary", "line", "All rights reserved."),
]
#: The registered query's templates.
FAMILIES = [*TEMPLATES, *NOTICES, *WHOLE]


def words_of(text: Column) -> Column:
    """array<string> of the words; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle(words: Column, width: int, i: Column) -> Column:
    """Hash of the `width` words from position i (from 1) on."""
    return F.xxhash64(F.lit(width), *[F.element_at(words, i + k) for k in range(width)])


def _hash_at(words: Column, width: int):
    return lambda i: shingle(words, width, i)


def _anchor_at(words: Column, width: int, anchors: list[int]):
    return lambda i: shingle(words, width, i).isin(anchors)


def _rehash(j: int):
    return lambda h: F.xxhash64(h, F.lit(j))


def _positions(words: Column, width: int) -> Column:
    n = F.size(words) - (width - 1)
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _signature(shingles: Column) -> Column:
    return F.array(*[F.array_min(F.transform(shingles, _rehash(j))) for j in range(BANDS)])


def templates(spark: SparkSession, texts: list[tuple[str, str, str]]) -> list[dict]:
    """license, variant, width, n, shingles, signature and anchors of each template (a bounded list)."""
    rows = spark.createDataFrame(texts, "license string, variant string, text string").withColumn("words", words_of(F.col("text")))
    rows = rows.where(F.size("words") > 0)
    each = [F.array_distinct(F.transform(_positions(F.col("words"), w), _hash_at(F.col("words"), w))) for w in range(1, WIDTH + 1)]
    width = F.least(F.size("words"), F.lit(WIDTH))
    rows = rows.withColumn("width", width).withColumn("shingles", F.element_at(F.array(*each), F.col("width")))
    smallest = lambda j: F.array_min(F.transform(F.col("shingles"), lambda h: F.struct(_rehash(j)(h).alias("v"), h.alias("h"))))["h"]
    anchors = F.array(*[smallest(j) for j in range(BANDS)])
    out = rows.select("license", "variant", "width", "shingles", _signature(F.col("shingles")).alias("signature"), F.array_distinct(anchors).alias("anchors")).collect()
    return [r.asDict() | {"n": len(r["shingles"])} for r in out]


def _bind(value: Column, use) -> Column:
    """use(x) with x bound to the value, so that it is evaluated once in a row wherever the plan puts the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(words: Column, hits: Column, width: int, n: int, anchors: list[int]) -> Column:
    """The windows for templates of n shingles that hold an anchor, as structs with their shingles.

    Window k covers the positions k * step + 1 to k * step + length.
    """
    step = -(-n // 4)
    length = n + step - 1
    own = F.filter(hits, _anchor_at(words, width, anchors))
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - length) / F.lit(step)).cast("int"))
    numbers = F.array_distinct(F.flatten(F.transform(own, lambda p: F.sequence(first(p), F.floor((p - 1) / F.lit(step)).cast("int")))))
    last = F.size(words) - (width - 1)

    def window(k: Column) -> Column:
        begin = k * step + 1
        span = F.transform(F.sequence(begin, F.least(begin + (length - 1), last)), _hash_at(words, width))
        return F.struct(F.lit(width).alias("width"), F.lit(n).alias("n"), begin.alias("begin"), span.alias("shingles"), F.slice(words, begin, length + width - 1).alias("words"))

    return F.transform(numbers, window)


def _all_windows(words: Column, known: list[dict]) -> Column:
    found = []
    for w in sorted({t["width"] for t in known}):
        of_width = [t for t in known if t["width"] == w]
        by_size = {n: sorted({a for t in of_width if t["n"] == n for a in t["anchors"]}) for n in sorted({t["n"] for t in of_width})}
        hits = F.filter(_positions(words, w), _anchor_at(words, w, sorted({a for x in by_size.values() for a in x})))
        found.append(_bind(hits, _sizes(words, w, by_size)))
    return F.concat(*found)


def _sizes(words: Column, width: int, by_size: dict[int, list[int]]):
    return lambda hits: F.concat(*[_windows(words, hits, width, n, anchors) for n, anchors in by_size.items()])


def scan(docs: DataFrame, texts: list[tuple[str, str, str]] | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, variant, first_word (from 0), n_words, containment of every match."""
    spark = docs.sparkSession
    used = TEMPLATES if texts is None else texts
    known = templates(spark, used)
    phrases = {t[:2]: [f" {x} " for x in required(*t[:2])] for t in used if t in FAMILIES}
    windows = _bind(words_of(F.col(text_col).cast("string")), lambda words: _all_windows(words, known))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), windows.alias("w")).select("id", "row", F.explode("w").alias("w"))
    found = rows.select("id", "row", "w.*").withColumn("signature", _signature(F.array_distinct("shingles")))
    table = spark.createDataFrame(
        [(t["license"], t["variant"], t["width"], t["n"], t["shingles"], t["signature"], phrases.get((t["license"], t["variant"]), [])) for t in known],
        "license string, variant string, width int, n int, template array<long>, bands array<long>, required array<string>")
    # as many rows as there are templates
    met = found.join(F.broadcast(table), ["width", "n"]).where(F.exists(F.zip_with("signature", "bands", lambda a, b: a == b), lambda x: x))
    size = F.size("shingles")
    both = met.withColumn("both", F.array_intersect("shingles", "template")).withColumn("common", F.size("both")).where(F.col("common") * 100 >= F.col("n") * percent)
    turned = F.reverse("shingles")
    low = F.array_position("shingles", F.element_at("both", 1)).cast("int")
    high = size + 1 - F.array_position(turned, F.element_at(F.array_intersect(turned, F.col("template")), 1)).cast("int")
    spans = both.withColumns({"low": low, "high": high})
    inside = F.concat(F.lit(" "), F.array_join(F.slice("words", F.col("low"), F.col("high") - F.col("low") + F.col("width")), " "), F.lit(" "))
    verified = spans.where(F.forall("required", lambda x: F.contains(inside, x))).select(
        "id", "row", "license", "variant", (F.col("begin") + F.col("low") - 2).alias("first"), (F.col("begin") + F.col("high") - 2 + F.col("width") - 1).alias("last"), "common", (F.col("common") / F.col("n")).alias("containment"))
    return _merged(_best(verified)).withColumnRenamed("id", id_col)


def _better(m: Column):
    """Whether a span of another license wins over m."""
    def wins(o: Column) -> Column:
        over = F.least(o["last"], m["last"]) - F.greatest(o["first"], m["first"]) + 1
        more = (o["common"] > m["common"]) | (o["common"] == m["common"]) & (o["containment"] > m["containment"])
        return (o["license"] != m["license"]) & (over * 2 >= m["last"] - m["first"] + 1) & more

    return wins


def _best(verified: DataFrame) -> DataFrame:
    """Spans that no competing one wins over; only those of one text that touch are compared."""
    own = Window.partitionBy("row").orderBy("first", "last")
    reach = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = verified.withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("row", "island").agg(F.first("id").alias("id"), F.first(F.when(F.col("id").isNull(), F.col("row")), ignorenulls=True).alias("lone"), F.collect_set(F.struct("license", "variant", "first", "last", "common", "containment")).alias("spans"))
    kept = F.filter("spans", lambda m: ~F.exists("spans", _better(m)))
    return spans.select("id", "lone", F.explode(kept).alias("s")).select("id", "lone", "s.license", "s.variant", "s.first", "s.last", "s.containment")


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans of one template in one document as one; `lone` tells rows without an id apart."""
    own = Window.partitionBy("id", "lone", "license", "variant").orderBy("first", "last")
    reach = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("match", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("id", "lone", "license", "variant", "match").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("containment").alias("containment"))
    return merged.select("id", "license", "variant", F.col("first").cast("long").alias("first_word"), (F.col("last") - F.col("first") + 1).cast("long").alias("n_words"), "containment")

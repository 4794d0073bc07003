"""Missing inputs of models filled inside the pipeline (O-86, O-92): exact medians and modes as an ML stage.

`ExactFill` learns the median of every number column (`quantiles.column_medians`: exact, in bounded
memory) and the most frequent value of every text column (the lowest on ties); its model replaces
missing values in place.  It can be a stage of a `Pipeline`, so that a fit on the training part fills
by the training part alone, and is saved and loaded with the pipeline model.

Defined results: NULL and NaN are missing numbers, NULL and the empty text are missing texts (as in an
uploaded file; Spark's indexer takes no empty level); a column without any value is filled with 0.0 or
`NONE`; numbers become doubles, infinities stay and count in their order; other columns, also rows
that are repeated, pass unchanged; an empty table fits (0.0 and `NONE`).  A column that the table lacks, or that is named twice, is an error.
"""
from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.topk import modes
from .quantiles import column_medians

NONE = "(none)"


def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)  # NULL stays NULL


def _text(c: str) -> Column:
    return F.nullif(F.col(c).cast("string"), F.lit(""))


class _Columns(Params):
    numbers = Param(Params._dummy(), "numbers", "number columns to fill", TypeConverters.toListString)
    texts = Param(Params._dummy(), "texts", "text columns to fill", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(numbers=[], texts=[])

    def _present(self, df: DataFrame) -> tuple[list[str], list[str]]:
        numbers, texts = self.getOrDefault("numbers"), self.getOrDefault("texts")
        both = [*numbers, *texts]
        if len(set(both)) < len(both) or not set(both) <= set(df.columns):
            raise ValueError(f"columns to fill must be columns of the table, each once: {both}")
        return numbers, texts


class ExactFill(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, numbers=None, texts=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ExactFillModel:
        numbers, texts = self._present(dataset)
        medians = column_medians(dataset.select(*[_number(c).alias(c) for c in numbers]), numbers) if numbers else {}
        common = modes(dataset.select(*[_text(c).alias(c) for c in texts]), texts) if texts else {}
        return self._copyValues(ExactFillModel(
            medians=[0.0 if medians[c] is None else medians[c] for c in numbers],
            modes=[NONE if common[c] is None else common[c] for c in texts]))


class ExactFillModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "fill of each number column", TypeConverters.toListFloat)
    modes = Param(Params._dummy(), "modes", "fill of each text column", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, medians=None, modes=None):
        super().__init__()
        self._setDefault(medians=[], modes=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        numbers, texts = self._present(dataset)
        filled = {c: F.coalesce(_number(c), F.lit(m)) for c, m in zip(numbers, self.getOrDefault("medians"))}
        filled |= {c: F.coalesce(_text(c), F.lit(m)) for c, m in zip(texts, self.getOrDefault("modes"))}
        return dataset.withColumns(filled) if filled else dataset

import pytest

from cohortlens.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a documents table; other columns are null."""

    def make(rows, extra: bool = False):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
        if extra:  # names that the operators use themselves
            from pyspark.sql import functions as F

            for name in ("id", "score", "features", "sig", "n", "key", "_row", "cell", "start", "stats", "y", "words"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


WORDS = "river stone cloud market garden silver bridge winter summer candle mirror forest window paper engine harbor".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))

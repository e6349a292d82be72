import pytest


@pytest.fixture
def empty_and_wide():
    """A table without rows, and the same with columns that clash with names used inside."""
    from pyspark.sql import functions as F

    def make(df):
        wide = df
        for name in ("value", "key", "hash", "pos", "text_", "grade", "band_", "tid", "node", "w", "s", "m", "a", "b", "n", "grp", "item", "label"):
            if name not in df.columns:
                wide = wide.withColumn(name, F.lit("x"))
        return df.limit(0), wide

    return make

import pytest


@pytest.fixture
def docs(spark):
    """Documents given as ``(id, text)`` or ``(id, text, source)``, with an extra column whose name clashes with an output."""

    def make(rows, extra="score"):
        wide = [(i, t, *(rest or ("s",)), 1) for i, t, *rest in rows]
        return spark.createDataFrame(wide, f"doc_id long, text string, source string, {extra} int")

    return make

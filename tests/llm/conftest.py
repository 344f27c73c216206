import pytest

TEXT = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names an operator uses itself."""

    def make(pairs):
        rows = [(i, t, "xx", "s", 0 if t is None else len(t), "a", 1, 2, *"abcdefg") for i, t in pairs]
        return spark.createDataFrame(rows, TEXT + ", lang string, source string, n_chars long, kept string, component int, block int, __own string, _own string, _own_number string, _number string, _gone string, _place string, _salt string")

    return make

import pytest

from levelgraph.llm.tokens import VOCABULARY, counter, token_counts
from tests.conftest import rows


def test_counts(spark):
    texts = [None, "", "one two three", "<|endoftext|>", "é" * 100_000, "a" * 300_000]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, tokens int")
    got = dict(rows(token_counts(df, "doc_id")))
    assert got[0] == got[1] == 0 and got[2] == 3 and got[3] > 1
    assert got == {i: counter(VOCABULARY)(t) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        token_counts(df, "nothing")

"""Token counts from flat files against counts of the texts themselves."""

import pytest

from txrisk.llm import packing, token_scan


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_counts_equal_the_texts(spark, block):
    texts = [None, "", "one", "hello! " * 50, "a b c", "!!!", None, "long " * 300]
    rows = [(k if k else None, t, "x") for k, t in enumerate(texts)] + [(2, "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string").repartition(2)
    enc = packing.encoder(packing.default_tokenizer())
    want = sorted((str(i), len(enc.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_scan.count_tokens(df, block=block).collect()) == want
    assert token_scan.count_tokens(df.limit(0)).count() == 0

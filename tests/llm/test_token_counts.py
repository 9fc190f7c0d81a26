import public_tokenizers
from fixtures import documents, words
from logquarry.llm import token_counts as tc


def test_histogram_and_limits(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [None, "", "a", "hello world", "hello world", " ".join(words(1, 1500)), "Ünï©ødé \U0001f600"] + [" ".join(words(k, k)) for k in range(3, 20)]
    docs = documents(spark, list(enumerate(texts)) + [(None, "a"), (2, "a")])
    encode = tc.encoding(path, public_tokenizers.PATTERN).encode_ordinary
    lengths = [len(encode(t or "")) for t in [*texts, "a", "a"]]
    hist = tc.length_histogram(tc.token_lengths(docs, path, public_tokenizers.PATTERN))
    rows = {r.n_tokens: r for r in hist.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r.n_docs == lengths.count(n) and r.docs_from == sum(x >= n for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths) and abs(r.quantile - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    assert [tuple(r) for r in tc.totals_at(hist, [4, 10**6]).collect()] == [(4, sum(x > 4 for x in lengths), sum(min(x, 4) for x in lengths)), (10**6, 0, sum(lengths))]
    assert tc.quantile(hist, 0.5) == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert tc.length_histogram(tc.token_lengths(documents(spark, []), path, public_tokenizers.PATTERN)).count() == 0

import random

from llm.samples import TEXTS, docs
from tidemark.llm import tokencount


def test_parts_add_up_to_the_whole_text():
    sp = tokencount.processor(tokencount.MODEL)
    rnd = random.Random(5)
    for k in range(3000):
        text = "".join(rnd.choice(["a", "the", "b", " ", " ", "  ", "\n", "▁", "é", "日", "</s>", ".", "\t", "ing"]) for _ in range(rnd.randrange(14)))
        parts = tokencount.parts(text.encode())
        assert sum(len(sp.encode(p.decode())) for p in parts) == len(sp.encode(text)), repr(text)


def test_spans_add_up_to_the_whole_text():
    sp = tokencount.processor(tokencount.MODEL)
    rnd = random.Random(9)
    for _ in range(800):
        text = "".join(rnd.choice(["a", "the", " ", " ", "  ", "\n", "▁", "é", "ing "]) for _ in range(rnd.randrange(60)))
        cut = tokencount.spans(text.encode(), 10)
        assert sum(len(sp.encode(p.decode())) for x in cut for p in tokencount.parts(x)) == len(sp.encode(text)), repr(text)


def test_very_long_text(spark):
    text = "of the  house " * 150_000
    (row,) = tokencount.token_counts(docs(spark, [text])).collect()
    assert row.n_tokens == len(tokencount.processor(tokencount.MODEL).encode(text))


def test_counts_equal_the_library(spark):
    sp = tokencount.processor(tokencount.MODEL)
    got = {r.doc_id: r for r in tokencount.token_counts(docs(spark), limit=100).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100), repr(t)


def test_empty_table_null_ids_and_clashing_columns(spark):
    assert tokencount.token_counts(docs(spark, [])).count() == 0
    odd = docs(spark, ["a b", None], [None, 3]).selectExpr("*", "1 AS n_tokens", "2 AS over_limit")
    assert {r.doc_id: r.n_tokens for r in tokencount.token_counts(odd).collect()} == {None: 2, 3: 0}

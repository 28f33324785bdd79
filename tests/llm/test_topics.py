"""Topics come from all documents."""

import numpy as np

from tracelake.llm import mixing


def plain(texts, made, rounds):
    """The centres after further rounds in one piece."""
    x = made.unit(np.array([mixing.terms_of(t)[1] for t in texts]))
    centre = made.centre
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        centre = mixing._norm(np.array([x[near == k].sum(0) if (near == k).any() else centre[k] for k in range(len(centre))]))
    return centre


def test_topics_are_learned_from_every_document(spark):
    texts = [f"{kind} {kind}{i % 7} x{i}" for i in range(400) for kind in ("ant", "bee")] + ["rare words here"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = mixing.learn_topics(docs, topics=3)
    counts = np.array([mixing.terms_of(t)[1] for t in texts])
    assert np.allclose(made.rarity, np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))))
    start = mixing.learn_topics(docs, topics=3, rounds=0)
    assert len(start.centre) == 3
    assert np.allclose(made.centre, plain(texts, start, mixing.TOPIC_ROUNDS), atol=1e-4)
    assert np.array_equal(made.centre, mixing.learn_topics(docs.repartition(2), topics=3).centre)


def test_topics_of_few_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert len(mixing.learn_topics(empty).centre) == 0
    assert len(mixing.learn_topics(spark.createDataFrame([(1, "a b"), (2, "a b"), (None, None)], "doc_id long, text string")).centre) <= 2


def test_counts_go_as_bytes(spark, monkeypatch):
    column = mixing._packed([np.array([1, 1023]), np.zeros(0), np.array([7]), np.array([5, 6])], np.int16)
    n, flat = mixing._unpacked(column.slice(1, 2), np.int16)
    assert (n.tolist(), flat.tolist()) == ([0, 1], [7])
    kept, cut = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df: kept.append(df.dtypes) or cut(df))
    mixing.learn_topics(spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id long, text string"))
    assert [[kind for _, kind in d] for d in kept] == [["bigint", "binary", "binary"]]

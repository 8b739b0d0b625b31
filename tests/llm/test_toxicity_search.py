"""The search of the nearest examples at sizes where it prunes, and the map of labelled ids."""

import numpy as np
import pytest

from wardline.llm import toxicity


@pytest.mark.parametrize("block, group", [(64, 16), (8, 1), (500, 200)])
def test_pruned_search_is_exact(monkeypatch, block, group):
    monkeypatch.setattr(toxicity, "GROUP", group)
    rng = np.random.default_rng(block)
    weight = rng.random(300) ** 6 + 1e-3  # few heavy terms, many light ones
    vectors = []
    for i in range(3000):
        terms = np.sort(rng.choice(300, rng.integers(1, 60), replace=False))
        v = weight[terms] * (1 + rng.random(len(terms)))
        vectors.append(np.stack([terms, v / np.sqrt(v @ v + 1)], 1) if i % 10 else vectors[i // 2] if i else np.zeros((0, 2)))
    index = toxicity.Index(vectors, 300, block)
    dense = np.zeros((len(vectors), 300))
    for row, v in zip(dense, vectors):
        row[v[:, 0].astype(int)] = v[:, 1]
    for n, query in enumerate(vectors[:200]):
        q = np.zeros(300)
        q[query[:, 0].astype(int)] = query[:, 1]
        score = dense @ q
        skip = n if n % 3 == 0 else -1
        if skip >= 0:
            score[skip] = 0
        want = [i for i in np.lexsort((np.arange(len(score)), -score.round(12)))[:15] if score[i] > 0]
        got = index.nearest(query, 15, skip)
        assert [i for _, i in got] == want
        assert np.allclose([s for s, _ in got], score[want])


def test_no_labelled_row_is_lost(spark):
    docs = spark.range(200_000).selectExpr("if(id % 50 = 0, -id, id) as doc_id", "cast(id as string) as text")
    labels = spark.range(0, 300_000, 7).selectExpr("if(id % 50 = 0, -id, id) as doc_id")
    kept = toxicity.likely(docs, labels)
    assert kept.join(labels, "doc_id").count() == docs.join(labels, "doc_id").count()
    assert kept.count() < 1.05 * docs.join(labels, "doc_id").count()
    assert toxicity.likely(docs, labels.limit(0)).count() == 0


def test_texts_are_counted_where_they_are_read(spark, monkeypatch):
    """No text is shuffled to find its label; copies count once per class, a row with two labels in both."""
    texts = ["red fox runs far", "red fox runs far", "blue fish swims", None, "green bird sings now", "red fish unlabelled"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "blue fish swims"), (None, "red")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (99, 1)], "doc_id long, y int")
    plans, land = [], toxicity.landed

    def landed(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return land(df, name)

    monkeypatch.setattr(toxicity, "landed", landed)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        terms = {w: i for i, w in enumerate(["red", "fish", "bird", "none"])}
        a, b, n1, n0 = toxicity.frequencies(docs, labels, terms)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert (a.tolist(), b.tolist(), n1, n0) == ([1, 0, 1, 0], [1, 1, 0, 0], 2.0, 3.0)
    assert len(plans) == 1 and "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]

"""The inverted index against the formula, with short blocks and small chunks so that pruning, look-ups and several chunks happen."""

import math
import random

import numpy as np
import pytest

from quarry.operators import inverted, search


def corpus(words, weights, docs, longest, seed):
    rng = random.Random(seed)
    return [(i * 7 % 1009, " ".join(rng.choices(words, weights, k=rng.randrange(longest)))) for i in range(docs)]


def brute(docs, asks, k):
    split = {i: (t or "").split() for i, t in docs}
    df = {t: sum(t in w for w in split.values()) for w in split.values() for t in w}
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    weight = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    mean = sum(map(len, split.values())) / len(docs)
    out = set()
    for q, text in asks:
        scores = [(-round(sum(weight.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in text.split()), 6) + 0.0, i) for i, w in split.items()]
        out |= {(q, i, -s + 0.0, n) for n, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize(("kind", "block"), [("rare", 3), ("rare", 2048), ("common", 2048)])
def test_bm25_by_index(spark, kind, block):
    """Words of all frequencies; and words that nearly all documents have, whose weights are below 0."""
    words = [f"w{n}" for n in range(200)] if kind == "rare" else list("ab")
    docs = corpus(words, [1 / (n + 1) for n in range(len(words))], 300, 40, 5)
    rng = random.Random(6)
    asks = [(q, " ".join(rng.choices([*words, "unknown"], k=rng.randrange(1, 7)))) for q in range(25)]
    rows, questions = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(asks, "query long, text string")
    split = rows.select("id", search.terms(rows["text"]).alias("listed"))
    index = inverted.build(split, None, 700, 4)
    got = {(r["query"], r.id, r.score, r["rank"]) for r in search.bm25(rows, questions, 5, block, index).collect()}
    assert got == brute(docs, asks, 5)


def test_pruning_scores_few_postings():
    """A rare word with one that all documents have: of the common word's postings few are scored."""
    rng = np.random.default_rng(1)
    impacts = np.sort(rng.random(100_000))[::-1]
    ids = rng.permutation(100_000).astype(np.int64)
    rows = [("the", impacts[at], ids[at : at + 256], impacts[at : at + 256]) for at in range(0, 100_000, 256)]
    rows.append(("rare", 2.0, np.arange(50, dtype=np.int64), np.linspace(2, 1, 50)))
    chunk = inverted._Chunk(rows)
    asked = [("the", 0.1), ("rare", 5.0), ("absent", 9.0)]
    got_ids, scores = chunk.best(asked, 10)
    dense = np.zeros(100_000)
    dense[ids] += 0.1 * impacts
    dense[:50] += 5.0 * np.linspace(2, 1, 50)
    dense = np.round(dense, 6)
    want = np.lexsort((np.arange(100_000), -dense))[:10]
    assert got_ids.tolist() == want.tolist() and scores.tolist() == dense[want].tolist()
    assert chunk.scored < 500


def test_no_questions_and_no_documents(spark):
    docs, asks = spark.createDataFrame([(1, "a b")], "id long, text string"), spark.createDataFrame([(1, "a")], "query long, text string")
    assert search.bm25(docs, asks.limit(0), 3).count() == 0
    assert search.bm25(docs.limit(0), asks, 3).count() == 0


def test_rows_that_leave_the_index_do_not_grow_with_the_chunks(spark):
    """of many chunks only the k best of each share leave a task, and no posting is shuffled."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=12))) for i in range(600)]
    rows = spark.createDataFrame(docs, "id long, text string").repartition(4)
    index = inverted.build(rows.select("id", search.terms(rows["text"]).alias("listed")), None, 24, 4)
    weights = spark.createDataFrame([(q, t, w) for q in range(5) for t, w in (("a", 1.0), ("b", 0.5 + q))], "query long, term string, weight double")
    found = inverted.search(spark, index, weights, 3, 2)
    chunks = spark.read.schema(inverted.INDEX).parquet(index.uri).select("chunk").distinct().count()
    assert chunks > 100 and 0 < found.count() <= 5 * 3 * 8
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()

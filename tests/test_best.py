import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import best, search, store
from quarry.plans import registry


@pytest.fixture(scope="module")
def both(spark, sf):
    return registry._matches(spark, sf), registry._scored(spark, sf).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select("query_id", "rank", *columns).collect())


def test_best_are_those_of_all_scores(both):
    matches, scored = both
    for k in (1, 7):
        assert rows(best.best(matches, k), "id", "source", F.round("score", 9)) == rows(scored.filter(F.col("rank") <= k), "id", "source", F.round("score", 9))


def test_selection_in_rounds_is_the_whole_one(both):
    """From one rank on, every query is read several times; a selection ends where the whole one does."""
    matches, scored = both
    columns = ("id", "score", "truncated", "content", "start_line", F.concat_ws("/", "section_path"))
    want = rows(search.select_results(scored), *columns)
    assert want and rows(best.select_results(matches, first=1), *columns) == want == rows(best.select_results(matches), *columns)


def test_copies_ahead_of_the_rest_are_passed(spark, tmp_path):
    """A hundred chunks of one source stand before those of the others: three of them count, and the selection goes on behind them."""
    docs = [(i, f"zeta zeta word{i}", "one") for i in range(100)] + [(100 + i, f"zeta other words word{i} follow here", f"more{i}") for i in range(4)] + [(200 + i, f"filler{i}", "x") for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zeta"), (2, "absent"), (3, "of the")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = rows(search.select_results(registry._scored(spark, tmp_path)), "id", "score")
    assert rows(registry.q_select_results(spark, tmp_path), "id", "score") == want and len(want) == 5
    assert [tuple(r) for r in registry.q_response_counts(spark, tmp_path).select("query_id", "returned").collect()] == [("1", 5)]


def test_no_row_for_every_match(spark, tmp_path):
    """What is kept of 250 matching chunks are those that can be among the best."""
    docs = [(i, "zeta" + "".join(f" pad{i}x{j}" for j in range(i)), "src") for i in range(250)] + [(i, f"other{i}", "src") for i in range(250, 700)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zeta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.source for r in registry.q_bm25_topk(spark, tmp_path).orderBy("rank").collect()] == [f"docs/src/{i:08}.txt" for i in range(5)]
    path = next(p for _, p in reversed(store._WRITTEN) if "/pairs-" in p)
    assert 5 <= spark.read.parquet(path).count() < 100


def test_equal_gains_have_equal_sums():
    """Whichever terms they are of, and however few gains are added at once."""
    tf = [np.array(x, float) for x in ((1, 2, 3, 5), (5, 3, 2, 1), (2, 5, 1, 3))]
    scorer = best._Scorer(np.arange(4), np.zeros(4, np.int64), np.full(4, 0.7), np.ones(1), 4, 1.0, 5)
    arrays = (np.tile(np.arange(4), 3), np.concatenate(tf), np.full(3, 4), np.full(3, 11.0))
    (_, row, base), = scorer.pairs(*arrays)
    assert row.tolist() == [0, 1, 2] and len(set(base)) == 1
    whole, best.GAINS = best.GAINS, 1
    try:
        parts = list(scorer.pairs(*arrays))
    finally:
        best.GAINS = whole
    assert [(r.tolist(), b.tolist()) for _, r, b in parts] == [([i], [base[0]]) for i in range(3)]

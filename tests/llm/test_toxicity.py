import random

import pytest

from quarry.llm import toxicity
from quarry.llm.common import held_out, table
from pyspark.sql import functions as F


def test_held_out_quality(spark):
    """On labelled rows the model never saw; sf0.01 has some 100 of them."""
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    rows = toxicity.query(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    f1 = 2 * hit / max(1, sum(r.predicted for r in rows) + sum(r.toxic for r in rows))
    false = sum(r.predicted and not r.toxic for r in rows)
    assert f1 > 0.6 and false <= 0.05 * len(rows), (f1, false, len(rows))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "idiot " * 9, "c"), (4, "w" * 100_000, "d"), (4, "w" * 100_000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="too few"):
        model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r._quarry_score <= 1 for r in rows)
    assert len({r._quarry_score for r in rows}) == 1
    odd = docs.withColumnRenamed("score", "_quarry_score")
    with pytest.warns(UserWarning):
        assert toxicity.remove_toxic(odd, labels).columns == odd.columns
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_windows_cover_the_text():
    text = ("Foo, bar! " * 1000).encode()
    assert b" ".join(w.strip() for w in toxicity.windows(text)).split() == [b"foo", b"bar"] * 1000
    assert list(toxicity.windows(b"")) == [b"  "]


def test_labels_never_come_from_held_out_rows(spark):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, f"text number{i} word") for i in range(200)], "doc_id long, text string")
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.dictionaries == b.dictionaries and (a.weights == b.weights).all()


def test_quality_on_more_rows(spark):
    """The same on sf0.1, whose classes share most word stems: 990 rows that were never learned from."""
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    rows = toxicity.query(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    f1 = 2 * hit / max(1, sum(r.predicted for r in rows) + sum(r.toxic for r in rows))
    false = sum(r.predicted and not r.toxic for r in rows)
    assert f1 > 0.6 and false <= 0.05 * len(rows), (f1, false, len(rows))


def test_markers_of_some_toxic_documents_are_learned(spark):
    """A word in half of a hundred toxic documents and in no other is some seven standard errors off."""
    word = [f"common{chr(97 + i)}" for i in range(20)]
    dice = random.Random(7)
    rows = [(i, " ".join(dice.choices(word, k=30)) + (" zorgblat" if i % 4 == 1 else "")) for i in range(270)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(270)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert b"zorgblat" in model.dictionaries[0] and b"zorgblat" not in model.dictionaries[1]
    score = model.scorer()
    assert score(b"commona commonb zorgblat") > 0.5 > score(b"commona commonb commonc")

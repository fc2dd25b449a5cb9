"""Budgets that follow an order over many ranges, with wide rows and however partitions are coalesced."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import ingest


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def rows_of(n=900):
    rng = random.Random(4)
    return [(f"d{i:05d}", "text", "é" * rng.randint(0, 30) + "x" * rng.randint(0, 3000), "extra" * 20) for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 4, 97])
def test_running_sums_keep_every_row(spark, adaptive, ranges):
    rows = rows_of()
    df = spark.createDataFrame(rows, "id string, format string, text string, wide string").repartition(7)
    got = {r.id: (r.sum, r.wide) for r in ingest.running(df, ["id"], F.octet_length("text").cast("long"), "sum", ranges=ranges).collect()}
    total, want = 0, {}
    for i, _, text, wide in sorted(rows):
        total += len(text.encode())
        want[i] = (total, wide)
    assert got == want


def test_bytes_beyond_one_partition(spark, adaptive):
    rows = rows_of()
    df = spark.createDataFrame(rows, "id string, format string, text string, wide string").repartition(7)
    assert ingest.within_bytes(df, 10**12).count() == len(rows)
    budget, left, want = 700_000, 700_000, {}
    for i, _, text, _ in sorted(rows):
        if left <= 0:
            break
        n = len(text.encode())
        want[i] = (budget - left, min(n, left), n > left, text)
        left -= n
    assert {r.id: (r.before, r.kept_bytes, r.truncated, r.text) for r in ingest.within_bytes(df, budget).collect()} == want


def test_positions_and_memory(spark, adaptive):
    rng = random.Random(2)
    chunks = [(f"s{i:04d}", k, "c" * rng.randint(1, 900)) for i in range(300) for k in range(rng.randint(1, 5))]
    df = spark.createDataFrame(chunks, "source string, ord int, content string").repartition(5)
    placed = ingest.positions(df)
    assert sorted((r.chunk_pos, r.source, r.ord) for r in placed.collect()) == [(i, s, k) for i, (s, k, _) in enumerate(sorted(chunks))]
    total, kept = 0, 0
    for s, _, c in sorted(chunks):
        total += 2 * len(c) + 2 * len(s) + 256
        kept += total <= 200_000
    assert ingest.within_memory(placed, 200_000).count() == kept


def test_no_rows(spark):
    df = spark.createDataFrame([], "id string, format string, text string")
    assert ingest.within_bytes(df, 100).collect() == []

"""The sieve before joins: bounded bitmaps at any number of keys, and operators' results that don't depend on them."""

import random

import pytest
from pyspark.sql import functions as F

from recallforge.llm import _common, near_dups, substrings


@pytest.mark.parametrize(("bits", "n", "most"), [(1 << 27, 5000, 0.15), (1 << 16, 12000, 0.3), (1 << 15, 60000, 0.35), (1 << 15, 400000, 1.0)])
def test_every_row_is_marked_once_and_few_wrongly(spark, monkeypatch, bits, n, most):
    monkeypatch.setattr(_common, "MOST_BITS", bits)
    among = spark.range(n).selectExpr("id * 3 key")
    rows = spark.range(20000).selectExpr("id", "if(id % 100 = 99, null, id) key")
    got = _common.sifted(rows, among, "key", "held").groupBy("id").agg(F.count("*").alias("n"), F.max("key").alias("key"), F.max("held").alias("held")).collect()
    assert len(got) == 20000 and {r.n for r in got} == {1}
    there = [r for r in got if r.key is not None and r.key % 3 == 0 and r.key < 3 * n]
    assert all(r.held for r in there) and there
    others = [r.held for r in got if r.key is not None and r.key % 3]
    assert sum(others) <= most * len(others)


def test_a_full_sieve_still_keeps_most_rows_from_the_shuffle(spark, monkeypatch):
    """With bitmaps far too small for one, rows of other keys are dropped before the join, as measured by what is left."""
    monkeypatch.setattr(_common, "MOST_BITS", 1 << 13)
    among, rows = spark.range(20000).selectExpr("id * 7 key"), spark.range(140000).selectExpr("id key")
    left = _common.sieve(rows, among, "key")
    assert left.count() < 20000 + 0.35 * 120000
    assert left.join(among, "key").count() == 20000


def test_operators_have_the_same_rows_with_tiny_bitmaps(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(words) for _ in range(70)]
    rows = []
    for i in range(60):
        own = [rnd.choice(words) for _ in range(80)]
        if i % 3 == 0:
            own[10:10] = passage
        if i % 4 == 1:
            own = rows[-1][1].split() + ["more"]
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame([*rows, (70, None), (71, "")], "doc_id long, text string")

    def results():
        near = sorted(map(str, near_dups.near_duplicates(docs).collect()))
        cut = sorted(map(str, substrings.remove_repeats(docs).collect()))
        return near, cut

    want = results()
    assert any("kept=False" in r for r in want[0]) and any("n_removed=70" in r for r in want[1])
    monkeypatch.setattr(_common, "MOST_BITS", 1 << 6)
    assert results() == want

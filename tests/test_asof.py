"""As-of joins against a plain search of the last version."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recallforge.operators.asof import as_of, valid

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("span", ["1 day", "20 minutes"])
def test_the_last_version_of_every_question(spark, span):
    rnd = random.Random(1)

    def time():
        return DAY + dt.timedelta(minutes=10 * rnd.randrange(600))

    versions = [(rnd.choice("aab"), i, time(), f"v{i}") for i in range(120)] + [("a", 900, None, "none"), (None, 901, DAY, "no key")]
    questions = [(i, rnd.choice("aabc"), time()) for i in range(150)] + [(900, "a", None), (901, None, DAY), (902, "a", DAY - dt.timedelta(days=400)), (903, "b", DAY + dt.timedelta(days=400))]
    got = as_of(spark.createDataFrame(questions, "q long, id string, at timestamp"), spark.createDataFrame(versions, "id string, n long, since timestamp, text string"), ["id"], "at", "since", "n", span).collect()
    assert len(got) == len(questions)
    for r in got:
        known = [(s, n, x) for i, n, s, x in versions if r.id is not None and i == r.id and s is not None and r.at is not None and s <= r.at]
        assert (r.version and r.version.text) == (max(known)[2] if known else None), r


def test_validity_at_the_time_of_a_question(spark):
    one = spark.createDataFrame([("m", 1, DAY, DAY, DAY + dt.timedelta(days=2), None)], "id string, n long, since timestamp, valid_from timestamp, valid_to timestamp, deleted_at timestamp")
    asked = spark.createDataFrame([(k, "m", DAY + dt.timedelta(days=k)) for k in (-1, 0, 2, 3)], "q long, id string, at timestamp")
    got = as_of(asked, one, ["id"], "at", "since", "n").select("q", valid(F.col("version"), F.col("at")).alias("ok")).collect()
    assert {r.q: r.ok for r in got} == {-1: False, 0: True, 2: True, 3: False}
    assert as_of(asked.limit(0), one, ["id"], "at", "since", "n").count() == 0 and as_of(asked, one.limit(0), ["id"], "at", "since", "n").filter("version is null").count() == 4

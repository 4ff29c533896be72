"""Letters and options in replies."""

from pyspark.sql import functions as F

import __spark_entry__
from strandline.plans.joins import judged_choices

OPTIONS = ["red boat", "blue kite", "green door", "tin can"]


def shared_letters(reply, options):
    """The stand-in: how many words of the option the reply holds."""
    return F.transform(options, lambda o: F.size(F.array_intersect(F.split(F.lower(o), " "), F.split(reply, " "))))


def test_reply_chain(spark):
    replies = ["the answer is (B)", "Best option: b. blue kite", "b) it is", "(b", "blue kite", "the blue kite", "Because", "(A) blue kite", "(A) no", "", None, "bb", "(C)", "b\nred"]
    df = spark.createDataFrame([(i, r, OPTIONS, "B") for i, r in enumerate(replies)], "i int, reply string, choices array<string>, answer string")
    got = {r.i: (r.ok, r.failed) for r in judged_choices(df, shared_letters).collect()}
    right, wrong, lost = (True, False), (False, False), (False, True)
    assert [got[i] for i in range(14)] == [right, right, right, right, (True, True), (True, True), lost, right, wrong, lost, lost, lost, wrong, lost]
    plain = {r.i: (r.ok, r.failed) for r in judged_choices(df).collect()}
    assert plain[0] == right and plain[4] == lost and plain[7] == wrong
    assert "agg_rvq" in __spark_entry__.queries()

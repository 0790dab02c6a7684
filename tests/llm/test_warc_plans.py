"""Deciding on revisits: the same by either plan, with one read of the payloads besides that of the digests."""

import hashlib
import random

from pyspark.sql import functions as F

from gridloom.llm import warc
from gridloom.llm.common import load

DATA = "/root/testdata/sf0.001"


def expected(rows):
    first, count = {}, {}
    for i, payload in rows:
        key = payload
        count[key] = count.get(key, 0) + 1
        if i is not None:
            first[key] = min(first.get(key, i), i)
    return sorted(((i, hashlib.sha256(p).hexdigest(), first[p] if len(p) >= 100 and count[p] > 1 and p in first and first[p] != i else None) for i, p in rows), key=str)


def test_both_plans_decide_alike(spark):
    rng = random.Random(4)
    kinds = [bytes([65 + k]) * rng.choice([3, 99, 100, 101, 5000]) for k in range(20)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(kinds)) for _ in range(300)] + [(900 + k, kinds[0]) for k in range(50)] + [(1000, b"")]
    df = spark.createDataFrame([(i, "u", bytearray(p)) for i, p in rows], "page_id long, url string, payload binary").repartition(3)
    for most in (warc.MOST_SENT, 0):
        got = sorted(((r["page_id"], r["payload_digest"], r["refers_to"]) for r in warc.decided(df, most=most).collect()), key=str)
        assert got == expected(rows)


def test_payloads_are_read_once_after_the_digests(spark):
    pages = load(spark, DATA, "pages")
    records = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8").alias("payload"))
    plan = warc.decided(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("pages.parquet") == 1 and "Exchange hashpartitioning" not in plan
    large = warc.decided(records, most=-1)._jdf.queryExecution().executedPlan().toString()
    assert large.count("pages.parquet") == 2

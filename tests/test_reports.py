"""Sketches of latencies, evidence rules, breakers by older keys, and answers that are cut."""

import datetime as dt
import json
import math
import random

from pyspark.sql import functions as F

from ledgerline.functions import payloads
from ledgerline.operators import aggregates, state
from ledgerline.sources import sinks

AT = dt.datetime(2024, 1, 1)


def test_sketches_add_up(spark):
    """Over any grouping: exact ends and means, and percentiles at most 1/64 below the value at their rank; a group has a bounded number of rows."""
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(5), int(r.lognormvariate(6, 3))) for _ in range(4000)] + [("a", 1, 0), ("b", 9, 2**50), ("a", 1, None), ("a", 1, -5)]
    df = spark.createDataFrame(rows, "inst string, hour int, ms long")
    sketch = aggregates.latency_sketch(df, ["inst", "hour"], "ms")
    assert sketch.groupBy("inst", "hour").count().agg(F.max("count")).first()[0] < 64 * 64
    merged = aggregates.merged_sketch(sketch, ["inst"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, aggregates.latency_sketch(df, ["inst"], "ms").collect()))
    for got in aggregates.latency_stats(merged, ["inst"]).collect():
        own = sorted(x for i, _, x in rows if i == got["inst"] and x is not None and x >= 0)
        assert (got["n"], got["least"], got["most"]) == (len(own), own[0], own[-1]) and math.isclose(got["mean"], sum(own) / len(own))
        for p in (50, 95, 99):
            true = own[math.ceil(len(own) * p / 100) - 1]
            assert true * (1 - 1 / 64) <= got[f"p{p}"] <= true
    assert aggregates.latency_stats(sketch.where("false"), ["inst"]).collect() == []


def test_evidence_rules(spark):
    sha = "0aF" + "1" * 61
    items = [("u1", sha, None), ("", sha, None), (None, None, None), ("u2", "", None), ("u3", None, payloads.LEGACY), ("u4", "zz" * 32, None), ("u5", "1" * 63, payloads.LEGACY)]
    df = spark.createDataFrame([([dict(zip(("uri", "sha256", "origin"), i, strict=True)) for i in items],), (None,), ([],)], f"e array<{payloads.ITEM}>")
    found = [r[0] for r in df.select(payloads.validated_evidence(F.col("e")).alias("v")).collect()]
    assert found[0]["error_codes"] == ["EVIDENCE_MISSING_URI:evidence[1]", "EVIDENCE_MISSING_URI:evidence[2]", "EVIDENCE_MISSING_SHA256:evidence[3]:u2", f"EVIDENCE_INVALID_SHA256:evidence[5]:{'z' * 16}...", f"EVIDENCE_INVALID_SHA256:evidence[6]:{'1' * 16}..."]
    assert found[0]["compat_warnings"] == ["EVIDENCE_LEGACY_NO_SHA256:evidence[4]:u3"] and not found[0]["is_valid"]
    assert all(f["is_valid"] and not f["error_codes"] for f in found[1:])
    gates = [tuple(r[0]) for r in df.select(payloads.evidence_gate(F.lit("strict"), F.col("e"))).collect()]
    assert gates == [("reject", "evidence_validation:evidence_missing_uri"), ("allow", "evidence_accepted"), ("allow", "evidence_accepted")]
    assert tuple(df.select(payloads.evidence_gate(F.lit(None).cast("string"), F.col("e"))).first()[0])[0] == "allow"
    old = spark.createDataFrame([(["a", "", None, "b"], None), ([], None), (None, [{"uri": "n", "sha256": sha, "origin": None}])], f"o array<string>, n array<{payloads.ITEM}>")
    told = [(r["e"]["source"], [(i["uri"], i["origin"]) for i in r["e"]["items"]]) for r in old.select(payloads.items_of(F.col("o"), F.col("n")).alias("e")).collect()]
    assert told == [("v1_mapped", [("a", payloads.LEGACY), ("b", payloads.LEGACY)]), ("none", []), ("v2", [("n", None)])]


def test_breakers_by_older_keys(spark):
    rows = spark.createDataFrame([("p:pool:x", "open", 0.5), ("x", "closed", None), ("pool:y", "half_open", 0.1), ("y", "open", 0.9), ("global", "odd", 0.2)], "key string, state string, smoothed_failure_rate double").withColumn("updated_at", F.lit(AT))
    kv = state.breaker_rows(rows)
    assert json.loads(kv.where("key = 'x'").first()["value_json"]) == {"state": "closed", "opened_at": None, "half_open_attempts": None, "half_open_successes": None, "last_failure_reason": None, "smoothed_failure_rate": None, "smoothed_rate_limit_rate": None, "smoothed_timeout_rate": None, "key": "x"}
    keys = spark.createDataFrame([("p:pool:x",), ("p:pool:y",), ("p:global",), ("p:tenant:none",)], "key string")
    got = {r["key"]: (r["found_key"], r["state"], r["half_open_attempts"], r["smoothed_failure_rate"]) for r in state.loaded_breakers(kv, keys).collect()}
    assert got == {"p:pool:x": ("p:pool:x", "open", 0, 0.5), "p:pool:y": ("pool:y", "half_open", 0, 0.1), "p:global": ("global", "closed", 0, 0.2), "p:tenant:none": (None, "closed", 0, None)}
    gone = state.kv_delete(kv, kv.where("key = 'pool:y'"))
    assert state.loaded_breakers(gone, keys.where("key = 'p:pool:y'")).first()["found_key"] == "y"


def test_envelopes_say_what_they_leave_out(spark):
    said = lambda n, limit: json.loads(sinks.envelope(spark.range(n), limit=limit).first()["json"])
    assert len(said(5, 3)["rows"]) == 3 and said(5, 3)["truncated"] and "truncated" not in said(3, 3)

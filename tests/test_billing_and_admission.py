import random
from collections import defaultdict, deque
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from clerkwise.functions.dates import instant
from clerkwise.operators import analytics, billing
from clerkwise.operators.admission import admit_sliding
from tests.helpers import docs, rows, ts

SUBS = "id int, user_id string, plan_tier string, billing_type string, status string, created_at timestamp"
EVENT = """event_id string, sequence long, subscription_id string, event_type string, provider_status string, plan_tier string,
           period_end timestamp, created_at timestamp"""


def test_stats(spark):
    at = ts("2024-03-01 00:00:00")
    subs = spark.createDataFrame([(1, "a", "pro", "monthly", "active", at), (2, "b", "Enterprise ", "monthly", "active", at), (3, "c", "pro", "lifetime", "active", at),
                                  (4, "d", "pro", "monthly", "canceled", at)], SUBS)
    pays = spark.createDataFrame([(1, "invoice.paid", 100, ts("2024-02-09 00:00:00")), (2, "invoice.paid", 7, ts("2024-02-08 23:59:59")),
                                  (3, "checkout.session.completed", None, at), (4, "invoice.payment_failed", 5, at)], "id int, event_type string, amount_cents long, created_at timestamp")
    got = {r["metric"]: r["value"] for r in billing.billing_stats(subs, pays, instant("2024-03-10 00:00:00")).collect()}
    assert got == {"active_subscriptions": 3, "mrr_cents": 12800, "revenue_last_30_days_cents": 100}
    empty = {r["metric"]: r["value"] for r in billing.billing_stats(subs.limit(0), pays.limit(0), instant("2024-03-10 00:00:00")).collect()}
    assert empty == {"active_subscriptions": 0, "mrr_cents": 0, "revenue_last_30_days_cents": 0}


def test_subscription_log(spark):
    def at(day):
        return ts(f"2024-01-{day:02d} 00:00:00")

    log = [
        ("e1", 1, "s", "checkout.session.completed", None, "enterprise", None, at(1)),
        ("e2", 2, "s", "invoice.paid", None, None, at(28), at(2)),
        ("e3", 3, "s", "invoice.payment_failed", None, None, None, at(3)),
        ("e4", 4, "s", "customer.subscription.updated", "trialing", None, None, at(4)),
        ("e3", 5, "s", "invoice.payment_failed", None, None, None, at(9)),
        ("e5", 6, "t", "checkout.session.completed", None, None, None, at(1)),
        ("e6", 7, "t", "customer.subscription.updated", "incomplete_expired", None, None, at(2)),
        ("e7", 8, "u", "charge.refunded", None, None, None, at(2)),
        ("e8", 9, "v", "customer.subscription.updated", "unpaid", None, None, at(2)),
    ]
    got = rows(billing.subscription_fold(spark.createDataFrame(log, EVENT)), "subscription_id")
    assert got == [("s", "active", "enterprise", at(28), None), ("t", "canceled", "free", None, at(2))]


def test_subscription_events_of_one_moment_have_one_order(spark):
    now = ts("2024-01-01 00:00:00")
    log = [("e1", 1, "s", "customer.subscription.deleted", None, None, None, now), ("e1", 1, "s", "checkout.session.completed", None, "pro", None, now),
           ("e2", 1, "t", "customer.subscription.deleted", None, None, None, now), ("e1", 1, "t", "checkout.session.completed", None, "pro", None, now),
           ("e4", 2, "u", "checkout.session.completed", None, "pro", None, now), ("e4", 2, "u", "checkout.session.completed", None, None, None, now)]
    want = [("s", "active", "pro", None, None), ("t", "canceled", "free", None, now), ("u", "active", "pro", None, None)]
    for turn in (log, log[::-1]):
        assert rows(billing.subscription_fold(spark.createDataFrame(turn, EVENT).coalesce(1)), "subscription_id") == want


def test_quota_and_batch(spark, monkeypatch):
    monkeypatch.setitem(billing.DOCUMENT_LIMIT, "free", 3)
    month = [{"workspace_id": "w", "created_at": ts("2024-03-01 00:00:00")}] * 2 + [{"workspace_id": "w", "created_at": ts("2024-02-29 23:59:59")}]
    spaces = spark.createDataFrame([("w", "free"), ("x", "enterprise"), ("y", "free")], "id string, plan_tier string")
    quota = billing.quota_check(docs(spark, *month), spaces, instant("2024-03-10 00:00:00"))
    got = {r["workspace_id"]: (r["used"], r["limit"], r["allowed"], r["connectors_allowed"]) for r in quota.collect()}
    assert got == {"w": (2, 3, True, False), "x": (0, None, True, True), "y": (0, 3, True, False)}
    batch = spark.createDataFrame([(i, w) for i, w in enumerate("wwwxxxxyyyyw")], "id int, workspace_id string")
    got = {r["id"]: r["allowed"] for r in billing.admit_batch(batch, quota, ["id"]).collect()}
    assert [i for i, ok in got.items() if not ok] and sorted(i for i, ok in got.items() if ok) == [0, 3, 4, 5, 6, 7, 8, 9]


def loop(events, limit, window):
    """The same rule, one event after the other."""
    seen, out = defaultdict(deque), {}
    for key, at, number in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        bucket = seen[key]
        while bucket and bucket[0] < at - timedelta(seconds=window):
            bucket.popleft()
        ok = len(bucket) < limit
        if ok:
            bucket.append(at)
        out[number] = (ok, limit - len(bucket) if ok else 0)
    return out


@pytest.mark.parametrize("limit,window,span", [(1, 10, 2000), (3, 10, 2000), (2, 60, 400), (5, 7, 3000)])
def test_admission_equals_a_loop_under_a_hot_key(spark, limit, window, span):
    rng = random.Random(limit * window)
    start = ts("2024-01-01 00:00:00")
    events = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 20)}", start + timedelta(seconds=rng.randint(0, span * 2) / 2), i) for i in range(3000)]
    df = spark.createDataFrame(events, "k string, at timestamp, n long")
    got = {r["n"]: (r["allowed"], r["remaining"]) for r in admit_sliding(df, "k", "at", "n", limit, window, block_windows=2).collect()}
    assert got == loop(events, limit, window)


def test_null_keys_and_a_key_that_never_rests(spark):
    start = ts("2024-01-01 00:00:00")
    events = [(None if i % 3 else "k", start + timedelta(seconds=i / 10), i) for i in range(4000)]
    got = {r["n"]: (r["allowed"], r["remaining"]) for r in
           admit_sliding(spark.createDataFrame(events, "k string, at timestamp, n long"), "k", "at", "n", 20, 60).collect()}
    assert got == loop([("" if k is None else k, at, n) for k, at, n in events], 20, 60)


def test_admission_boundary_and_reset(spark):
    start = ts("2024-01-01 00:00:00")
    events = [("k", start + timedelta(seconds=s), i) for i, s in enumerate((0, 1, 2, 60, 60.5, 61.5))]
    got = admit_sliding(spark.createDataFrame(events, "k string, at timestamp, n long"), "k", "at", "n", 2, 60).orderBy("n").collect()
    # The event at 60 s still counts the one at 0 s; at 60.5 s that one is gone.
    assert [r["allowed"] for r in got] == [True, True, False, False, True, True]
    assert [r["reset_seconds"] for r in got] == [60, 60, 58, 1, 60, 60]
    free = admit_sliding(spark.createDataFrame(events, "k string, at timestamp, n long"), "k", "at", "n", 0, 60)
    assert free.filter("allowed").count() == 6


def test_histogram_and_health(spark):
    calls = spark.createDataFrame([("GET", 0.01), ("GET", 0.5), ("GET", 99.0), ("GET", -1.0)], "method string, latency double")
    got = {r["le"]: r["cumulative_count"] for r in analytics.latency_histogram(calls, ["method"]).collect()}
    assert got == {"0.01": 2, "0.03": 2, "0.1": 2, "0.3": 2, "1.0": 3, "3.0": 3, "10.0": 3, "+Inf": 4}
    now = instant("2024-01-02 00:00:00")
    jobs = spark.createDataFrame([("queued",), ("In_Progress",), ("running",), ("done",)], "status string")
    snapshot = docs(spark, {"status": "routed"}, {"status": "routed", "requires_review": True}, {"status": "failed", "created_at": ts("2023-12-31 00:00:00")})
    audit = spark.createDataFrame([("Pipeline_FAILED", ts("2024-01-01 12:00:00")), ("x_failed", ts("2023-12-01 00:00:00"))], "action string, created_at timestamp")
    mails = spark.createDataFrame([("sent", ts("2024-01-01 12:00:00"))], "status string, created_at timestamp")
    got = {r["metric"]: r["value"] for r in analytics.system_health(jobs, snapshot, audit, mails, now).collect()}
    assert got == {"jobs_queued": 1, "jobs_running": 2, "jobs_failed": 0, "documents_total": 2, "documents_auto_routed": 1, "documents_needs_review": 1,
                   "documents_failed": 0, "audit_errors": 1, "emails_sent": 1, "emails_failed": 0}
    assert analytics.request_counter(calls.withColumn("status", F.lit(200)), ["method", "status"]).first()["requests"] == 4


@pytest.mark.parametrize("limit,window,rounds", [(1, 20, 3), (2, 30, 3), (3, 15, 0), (2, 30, 1)])
def test_a_key_that_never_rests_is_decided_block_by_block(spark, limit, window, rounds):
    """More events than a window admits, for hundreds of windows, beside keys that rest; also with no second round, when the stream decides."""
    rng = random.Random(limit * window)
    start = ts("2024-01-01 00:00:00")
    events, at = [], 0.0
    for i in range(1500):
        at += rng.expovariate(limit * 3 / window)
        events.append(("hot", start + timedelta(seconds=round(at, 1)), i))
    events += [(f"k{i % 7}", start + timedelta(seconds=rng.randint(0, 4000)), 10_000 + i) for i in range(300)] + [(None, start, 20_000), (None, start, 20_001)]
    df = spark.createDataFrame(events, "k string, at timestamp, n long")
    got = {r["n"]: (r["allowed"], r["remaining"]) for r in admit_sliding(df, "k", "at", "n", limit, window, block_windows=3, rounds=rounds).collect()}
    assert got == loop([(k or "", a, n) for k, a, n in events], limit, window)

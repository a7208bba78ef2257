from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from inkveil.operators import accounts, mutations

T = datetime(2024, 5, 1)
REGIONS = "region_id long, doc_id string, page_number int, text string, pii_type string, action string, linked_group string, source string"


def regions(spark):
    return spark.createDataFrame([
        (1, "d", 1, " Ann ", "PERSON", "PENDING", "g", "REGEX"), (2, "d", 2, "ann", "ORG", "PENDING", "g", "MANUAL"), (3, "d", 1, "Bob", "PERSON", "PENDING", None, "REGEX"),
        (4, "e", 1, "ANN", "PERSON", "PENDING", "g", None), (5, None, 1, None, None, None, None, None), (6, "d", 1, "  ", "ORG", "PENDING", None, "REGEX"),
    ], REGIONS)


def ids(df):
    return sorted(r.region_id for r in df.collect())


def test_delete_takes_siblings_of_the_same_document_along(spark):
    chosen = spark.createDataFrame([(1,), (1,), (99,)], "region_id long")
    assert ids(mutations.delete(regions(spark), chosen)) == [3, 4, 5, 6]
    assert ids(mutations.batch_delete(regions(spark), chosen)) == [2, 3, 4, 5, 6]
    assert ids(mutations.delete(regions(spark).limit(0), chosen)) == []


def test_relabel_spreads_by_text_and_not_by_empty_text(spark):
    out = mutations.relabel(regions(spark), spark.createDataFrame([(1, "X"), (6, "Y"), (5, "Z")], "region_id long, pii_type string"))
    assert {r.region_id: r.pii_type for r in out.collect()} == {1: "X", 2: "X", 3: "PERSON", 4: "PERSON", 5: "Z", 6: "Y"}
    out = mutations.edit_text(regions(spark), spark.createDataFrame([(2, "Anna")], "region_id long, text string"))
    assert {r.region_id: r.text for r in out.where("region_id < 4").collect()} == {1: "Anna", 2: "Anna", 3: "Bob"}


def test_manual_regions_stay(spark):
    assert ids(mutations.without_types(regions(spark), ["ORG", "PERSON"]).where("region_id < 5")) == [2]
    again = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page_number int")
    out = mutations.redetected(regions(spark), regions(spark).where("region_id = 3").withColumn("source", F.lit("NEW")), again)
    assert sorted((r.region_id, r.source) for r in out.collect() if r.region_id < 5) == [(2, "MANUAL"), (3, "NEW"), (4, None)]


def test_subscriptions(spark):
    subs = spark.createDataFrame([(1, 7, "pro", "canceled", 1, T, None, None), (2, 7, "free_trial", "trialing", 1, T, None, datetime(2024, 4, 1)), (3, 8, "pro", "active", 2, T, datetime(2024, 5, 3, 12), None), (4, None, "pro", "active", 1, T, None, None)], "subscription_id long, user_id long, plan string, status string, seats int, created_at timestamp, current_period_end timestamp, trial_end timestamp")
    machines = spark.createDataFrame([(i, 8, f"f{i}", i != 6) for i in range(7)], "machine_id long, user_id long, fingerprint string, is_active boolean")
    asked = spark.createDataFrame([(7, "f1"), (8, "f1"), (8, "f6"), (9, "f1"), (None, "f1")], "user_id long, fingerprint string")
    now = F.lit(T)
    got = {(r.user_id, r.fingerprint): r.outcome for r in accounts.activation(asked, subs, machines, machines.limit(0), now).collect()}
    assert got == {(7, "f1"): "trial expired", (8, "f1"): "refreshed", (8, "f6"): "limit reached", (9, "f1"): "no subscription", (None, "f1"): "no subscription"}
    assert {r.outcome for r in accounts.validation(asked.where("user_id = 8"), subs, machines, now).collect()} == {"valid", "not activated"}
    status = {r.user_id: (r.valid, r.days_remaining) for r in accounts.license_status(asked.select("user_id").distinct(), subs, now).collect()}
    assert status == {7: (True, -30), 8: (True, 2), 9: (False, None), None: (False, None)}


def test_updates_in_order_and_once(spark):
    subs = spark.createDataFrame([(1, "free_trial", "trialing", None), (2, "pro", "active", T)], "subscription_id long, plan string, status string, current_period_end timestamp")
    events = [(1, 1, datetime(2024, 1, 2), "active", None), (1, 1, datetime(2024, 1, 2), "active", None), (2, 1, datetime(2024, 1, 3), "past_due", None), (3, 9, T, "active", T), (4, 2, T, None, datetime(2025, 1, 1))]
    out = accounts.apply_updates(subs, spark.createDataFrame(events, "event_id long, subscription_id long, happened timestamp, status string, current_period_end timestamp"))
    assert sorted(map(tuple, out.collect())) == [(1, "pro", "past_due", None), (2, "pro", "active", datetime(2025, 1, 1))]


def test_regions_on_pages(spark):
    from inkveil.operators import mutations

    rows = [("a", "d", 1, 0), ("b", "d", 2, 1), ("c", "d", 2, 0), ("d", "e", 2, 0), ("e", None, 2, 0), ("f", "d", None, 0)]
    r = spark.createDataFrame(rows, "region_id string, doc_id string, page_number long, ord int")
    ids = lambda df: [x.region_id for x in df.collect()]
    assert ids(mutations.on_pages(r, [2])) == ["e", "c", "b", "d"] and ids(mutations.on_pages(r, [1, 2], "d")) == ["a", "c", "b"]
    assert ids(mutations.on_pages(r, [])) == []

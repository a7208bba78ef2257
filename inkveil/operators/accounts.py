"""Accounts, subscriptions, machines and licence keys as relations.

users: user_id. subscriptions: subscription_id, user_id, plan, status, seats, created_at, current_period_end,
trial_end. machines: machine_id, user_id, fingerprint, is_active. keys: key_id, user_id, fingerprint,
issued_at, expires_at, revoked. Times are timestamps; `now` is a column, so that results can be repeated.
Null ids match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that count as a subscription, machines of a seat, days until old keys go.
LIVE, MACHINES_PER_SEAT, KEEP_DAYS = ("active", "trialing"), 3, 90


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def current_subscription(subscriptions: DataFrame) -> DataFrame:
    """Of each user the latest live subscription; the larger id on a tie."""
    live = subscriptions.where(F.col("status").isin(*LIVE) & F.col("user_id").isNotNull())
    latest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("subscription_id"))
    return live.withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__r")


def license_status(users: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """user_id, valid, plan, seats, expires_at, days_remaining (whole days, rounded down), message."""
    own = users.select("user_id").join(current_subscription(subscriptions), "user_id", "left")
    until = F.coalesce("current_period_end", "trial_end")
    days = F.floor((micros(until) - micros(now)) / F.lit(86_400_000_000)).cast("int")
    valid = F.col("status").isNotNull()
    return own.select("user_id", valid.alias("valid"), "plan", "seats", until.alias("expires_at"), days.alias("days_remaining"), F.when(valid, "Active").otherwise("No active subscription").alias("message"))


def _asked(requests: DataFrame, subscriptions: DataFrame, machines: DataFrame, now: Column) -> DataFrame:
    """requests (user_id, fingerprint, ...) with the user's subscription, machines in use, and whether this one is."""
    active = machines.where("is_active")
    used = active.groupBy("user_id").agg(F.count("*").alias("__used"))
    here = active.select("user_id", "fingerprint").distinct().withColumn("__here", F.lit(True))
    subs = current_subscription(subscriptions).select("user_id", F.col("plan").alias("__plan"), F.col("seats").alias("__seats"), ((F.col("status") == "trialing") & (F.col("trial_end") < now)).alias("__over"))
    out = requests.join(subs, "user_id", "left").join(used, "user_id", "left").join(here, ["user_id", "fingerprint"], "left")
    return out.withColumn("__used", F.coalesce("__used", F.lit(0))).withColumn("__here", F.coalesce("__here", F.lit(False)))


def _subscribed(rest: Column) -> Column:
    return F.when(F.col("__plan").isNull(), "no subscription").when(F.coalesce("__over", F.lit(False)), "trial expired").otherwise(rest)


def _full() -> Column:
    return ~F.col("__here") & (F.col("__used") >= F.col("__seats") * MACHINES_PER_SEAT)


def activation(requests: DataFrame, subscriptions: DataFrame, machines: DataFrame, trials: DataFrame, now: Column) -> DataFrame:
    """requests with `outcome` of a single activation each, against the tables as they are: "no subscription",
    "trial expired", "trial used" (a free trial was had on this machine), "limit reached", "refreshed" (already
    active here) or "activated". trials: fingerprint."""
    had = trials.select("fingerprint").distinct().withColumn("__had", F.lit(True))
    out = _asked(requests, subscriptions, machines, now).join(had, "fingerprint", "left")
    used = (F.col("__plan") == "free_trial") & F.coalesce("__had", F.lit(False))
    rest = F.when(used, "trial used").when(F.col("__here"), "refreshed").when(_full(), "limit reached").otherwise("activated")
    return out.select(*requests.columns, _subscribed(rest).alias("outcome"))


def validation(requests: DataFrame, subscriptions: DataFrame, machines: DataFrame, now: Column) -> DataFrame:
    """requests with `outcome` of a validation: "no subscription", "trial expired", "not activated" or "valid"."""
    rest = F.when(F.col("__here"), "valid").otherwise("not activated")
    return _asked(requests, subscriptions, machines, now).select(*requests.columns, _subscribed(rest).alias("outcome"))


def offline_key(requests: DataFrame, subscriptions: DataFrame, machines: DataFrame, now: Column) -> DataFrame:
    """requests with `outcome` of asking for an offline key: as activation, but no machine or trial is taken."""
    rest = F.when(_full(), "limit reached").otherwise("issued")
    return _asked(requests, subscriptions, machines, now).select(*requests.columns, _subscribed(rest).alias("outcome"))


def deactivate(machines: DataFrame, keys: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(machines, keys) after the chosen machine_ids are deactivated: their user's keys for them are revoked."""
    ids = chosen.select("machine_id").distinct().withColumn("__off", F.lit(True))
    out = machines.join(ids, "machine_id", "left").withColumn("is_active", F.col("is_active") & F.col("__off").isNull()).select(*machines.columns)
    gone = machines.join(ids, "machine_id").select("user_id", "fingerprint").distinct().withColumn("__off", F.lit(True))
    revoked = keys.join(gone, ["user_id", "fingerprint"], "left").withColumn("revoked", F.col("revoked") | F.col("__off").isNotNull())
    return out, revoked.select(*keys.columns)


def revocation(fingerprints: DataFrame, keys: DataFrame) -> DataFrame:
    """fingerprint, revoked: a machine is revoked if it has keys and all are revoked; unknown ones are not."""
    state = keys.groupBy("fingerprint").agg(F.bool_and("revoked").alias("revoked"))
    return fingerprints.select("fingerprint").join(state, "fingerprint", "left").select("fingerprint", F.coalesce("revoked", F.lit(False)).alias("revoked"))


def revoke_users(users: DataFrame, machines: DataFrame, keys: DataFrame) -> DataFrame:
    """user_id, revoked_keys, deactivated_machines: what revoking all of a user's licences touches."""
    k = keys.groupBy("user_id").agg(F.count("*").alias("revoked_keys"))
    m = machines.groupBy("user_id").agg(F.count("*").alias("deactivated_machines"))
    out = users.select("user_id").join(k, "user_id", "left").join(m, "user_id", "left")
    return out.select("user_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("revoked_keys", "deactivated_machines")))


def apply_updates(subscriptions: DataFrame, events: DataFrame) -> DataFrame:
    """Subscriptions after status events (event_id, subscription_id, happened, status, current_period_end), in order of
    time: what the last event that tells it says, holds; a free trial that becomes active once is "pro"
    from then on. Events of unknown subscriptions change nothing; an event delivered twice counts once."""
    once = events.dropDuplicates(["event_id"])
    order = F.struct("happened", "event_id")
    told = once.groupBy("subscription_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("__status"),
        F.max_by("current_period_end", F.when(F.col("current_period_end").isNotNull(), order)).alias("__end"),
        F.max(F.col("status") == "active").alias("__active"),
    )
    out = subscriptions.join(told, "subscription_id", "left")
    upgraded = (F.col("plan") == "free_trial") & F.coalesce("__active", F.lit(False))
    out = out.withColumn("plan", F.when(upgraded, "pro").otherwise(F.col("plan"))).withColumn("status", F.coalesce("__status", "status"))
    return out.withColumn("current_period_end", F.coalesce("__end", "current_period_end")).select(*subscriptions.columns)


def purge_keys(keys: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Keys but for those that expired more than `days` days ago."""
    return keys.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now - F.make_dt_interval(F.lit(days))))


def fresh(rows: DataFrame, now: Column, seconds: float, at: str = "updated_at") -> DataFrame:
    """Rows touched within so many seconds: progress entries (300) and locks (600) older than that are gone."""
    return rows.where(micros(now) - micros(F.col(at)) <= int(seconds * 1_000_000))

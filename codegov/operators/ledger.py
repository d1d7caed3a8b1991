"""State of findings from an event ledger, reconciliation with a run, and decisions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import placed

STATES = {"observed": "observed", "baselined": "baselined", "resolved": "resolved", "unverified": "unverified", "revoked": "revoked"}


def latest(events: DataFrame, key: str = "fingerprint", order: str = "ord") -> DataFrame:
    """The last event of each key; max_by keeps one row per key and task before the shuffle."""
    rest = [c for c in events.columns if c != key]
    rows = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return rows.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def not_baselined(snapshot: DataFrame, as_of: datetime) -> DataFrame:
    """Rows that a baseline would take: observed, or baselined with an expiry that has passed."""
    return snapshot.where((F.col("type") == "observed") | ((F.col("type") == "baselined") & (F.col("expires_at") <= F.lit(as_of))))


def with_state(snapshot: DataFrame, only: str | None = None) -> DataFrame:
    """``state`` of every row; ``only``: a comma-separated list of states to keep."""
    table = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    out = snapshot.withColumn("state", F.element_at(table, F.col("type"))).where(F.col("state").isNotNull())
    if only is None:
        return out
    wanted = [x.strip() for x in only.split(",") if x.strip()]
    if bad := [x for x in wanted if x not in STATES]:
        raise ValueError(f"no such state: {', '.join(bad)}")
    return out.where(F.col("state").isin(*wanted))


def axiom_states(events: DataFrame, order: str = "ord") -> DataFrame:
    """The latest event of each axiom as active, superseded or revoked; scope and claim carry on from the declaration."""
    declared = F.max_by(F.struct("scope", "claim"), F.when(F.col("type") == "declared", F.col(order)))
    rows = events.where(F.col("axiom_id").isNotNull()).groupBy("axiom_id").agg(F.max_by("type", order).alias("type"), declared.alias("d"))
    return rows.select("axiom_id", F.when(F.col("type") == "declared", "active").otherwise(F.col("type")).alias("state"), "d.scope", "d.claim")


def rejected_transitions(events: DataFrame, order: str = "ord") -> DataFrame:
    """Events that observe a finding again right after a baseline that is still in force at their own time."""
    w = Window.partitionBy("fingerprint").orderBy(order)
    rows = events.where(F.col("fingerprint").isNotNull()).withColumn("before", F.lag(F.struct("type", "expires_at")).over(w))
    live = (F.col("before.type") == "baselined") & (F.col("before.expires_at") > F.col("timestamp"))
    return rows.where(F.col("type").isin("observed", "unverified") & live).drop("before")


#: Events of one range that a window looks at together.
CHUNK = 65_536


def judge(events: DataFrame, snapshot: DataFrame, as_of: datetime, order: list[str]) -> DataFrame:
    """``events`` with ``rejected``: those that would observe a finding again while its baseline is in force at ``as_of``.

    An event meets the state that the ledger's last event (``snapshot``) and the accepted ones before it leave. Between two
    events of other kinds either all observations pass or none, so the last of the others decides. Events are judged in
    chunks of their order, and a row a chunk carries the state on: a finding may have any share of the events.
    """
    rows = placed(events.where(F.col("fingerprint").isNotNull()), "fingerprint", *order).withColumn("__chunk", F.floor(F.col("place") / CHUNK))
    seen = F.col("type").isin("observed", "unverified")
    other = F.when(~seen, F.struct("place", "type", "expires_at"))
    inside = Window.partitionBy("fingerprint", "__chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__here", F.last(other, ignorenulls=True).over(inside))
    ends = rows.groupBy("fingerprint", "__chunk").agg(F.max(other).alias("__last"))
    ahead = Window.partitionBy("fingerprint").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("fingerprint", "__chunk", F.last("__last", ignorenulls=True).over(ahead).alias("__ahead"))
    state = snapshot.select("fingerprint", F.struct(F.lit(0).cast("long").alias("place"), "type", "expires_at").alias("__state"))
    x = rows.join(ends, ["fingerprint", "__chunk"]).join(state, "fingerprint", "left").withColumn("__now", F.coalesce("__here", "__ahead", "__state"))
    live = (F.col("__now.type") == "baselined") & (F.col("__now.expires_at") > F.lit(as_of))
    return x.withColumn("rejected", F.coalesce(seen & live, F.lit(False))).select(*events.columns, "rejected")


def reconcile(current: DataFrame, snapshot: DataFrame, as_of: datetime) -> DataFrame:
    """One row per fingerprint of either side with its outcome flags, what is visible, and the event to write.

    ``current``: (fingerprint, requires_verification, ...); ``snapshot``: the latest event of each fingerprint.
    """
    left = snapshot.select("fingerprint", F.col("type").alias("was"), "expires_at")
    right = current.select("fingerprint", F.col("requires_verification").alias("needs_review"), F.lit(True).alias("__now"))
    x = left.join(right, "fingerprint", "full_outer").withColumn("present", F.coalesce("__now", F.lit(False))).drop("__now")
    was, here = F.col("was"), F.col("present")
    is_ = lambda t: F.coalesce(was == t, F.lit(False))
    live = is_("baselined") & F.coalesce(F.col("expires_at") > F.lit(as_of), F.lit(False))
    expired = is_("baselined") & ~live
    review = F.coalesce("needs_review", F.lit(False))
    new = here & (was.isNull() | expired | is_("resolved"))
    gone = ~here & (is_("observed") | is_("unverified") | is_("baselined"))
    return x.select(
        "fingerprint", was, here.alias("present"), review.alias("needs_review"), new.alias("is_new"), gone.alias("auto_resolved"), live.alias("baselined"), expired.alias("expired"), is_("revoked").alias("revoked"),
        (here & is_("resolved") & ~review).alias("regression"), (here & is_("resolved") & review).alias("regression_to_review"), (here & is_("unverified")).alias("pending_review"),
        (here & ~live & ~is_("revoked")).alias("visible"), F.when(gone, "resolved").when(new & review, "unverified").when(new, "observed").alias("event"),
    )


def events_to_write(outcome: DataFrame) -> DataFrame:
    """Resolutions first, then observations: (phase, fingerprint, type)."""
    return outcome.where(F.col("event").isNotNull()).select(F.when(F.col("event") == "resolved", 0).otherwise(1).alias("phase"), "fingerprint", F.col("event").alias("type"))


def verdict(outcome: DataFrame, strict: bool = True, with_ledger: bool = True) -> DataFrame:
    """One row of counts and whether the run fails."""
    n = lambda c: F.count_if(c).alias
    actionable = F.col("visible") & ~F.col("needs_review")
    counts = outcome.agg(n(F.col("regression"))("regressions"), n(F.col("regression_to_review"))("regressions_to_review"), n(F.col("expired") & F.col("present"))("expired_baselines"), n(F.col("visible"))("visible"), n(actionable)("actionable"))
    bad = F.lit(strict) & (F.col("actionable") > 0)
    if with_ledger:
        bad = bad | (F.col("regressions") + F.col("regressions_to_review") + F.col("expired_baselines") > 0)
    return counts.withColumn("failed", bad)


def summary(states: DataFrame) -> DataFrame:
    """Counts by state and rule with totals; null stands for all."""
    return states.rollup("state", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def _reason(action: Column, state: Column) -> Column:
    found = F.when(state.isNull(), "unknown finding")
    found = found.when((action == "resolve") & state.isin("resolved", "revoked", "unverified"), F.concat(F.lit("finding is "), state))
    found = found.when(action.isin("verify", "dismiss") & (state != "unverified"), F.lit("finding is not awaiting review"))
    found = found.when((action == "reopen") & (state != "revoked"), F.lit("finding is not revoked"))
    return found.when(~action.isin("resolve", "verify", "dismiss", "reopen"), F.lit("unknown action"))


def decide(requests: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Requests with why they are rejected, or the event that they write; a baselined finding is resolved with a warning."""
    x = requests.join(snapshot.select("fingerprint", F.col("type").alias("state")), "fingerprint", "left")
    clash = F.max((F.col("action") == "dismiss").cast("int")).over(w := Window.partitionBy("fingerprint")) + F.max((F.col("action") == "reopen").cast("int")).over(w) == 2
    why = F.when(clash & F.col("action").isin("dismiss", "reopen"), "dismiss and reopen together").otherwise(_reason(F.col("action"), F.col("state")))
    event = F.create_map(*(F.lit(v) for v in ("resolve", "resolved", "verify", "observed", "dismiss", "revoked", "reopen", "unverified")))
    x = x.withColumn("rejected", why)
    return x.select(*requests.columns, "state", "rejected", F.when(F.col("rejected").isNull(), F.element_at(event, F.col("action"))).alias("event"), (F.col("rejected").isNull() & (F.col("action") == "resolve") & (F.col("state") == "baselined")).alias("warns"))


def missing_links(declarations: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(axiom_id, missing): declarations that name fingerprints which no finding has."""
    named = declarations.select("axiom_id", F.explode(F.split("links", ",")).alias("l")).select("axiom_id", F.trim("l").alias("fingerprint")).where("fingerprint != ''").distinct()
    return named.join(snapshot.select("fingerprint"), "fingerprint", "left_anti").groupBy("axiom_id").agg(F.array_join(F.array_sort(F.collect_list("fingerprint")), ",").alias("missing"))


def axiom_decisions(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Supersede and revoke requests; only an active axiom takes them."""
    x = requests.join(states.select("axiom_id", "state"), "axiom_id", "left")
    why = F.when(F.col("state").isNull(), "unknown axiom").when(F.col("state") != "active", F.concat(F.lit("axiom is "), F.col("state")))
    return x.withColumn("rejected", why)


def baseline_events(snapshot: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """A baselined event with one shared expiry for every row that a baseline takes."""
    if not isinstance(days, int) or not 1 <= days <= 90:
        raise ValueError("a baseline lasts 1 to 90 days")
    return not_baselined(snapshot, as_of).withColumn("type", F.lit("baselined")).withColumn("expires_at", F.lit(as_of) + F.make_interval(days=F.lit(days)))


def lookup(snapshot: DataFrame, requested: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The rows of the requested keys."""
    return snapshot.join(requested.select(key).distinct(), key, "left_semi")

"""Keyed writes as pure functions: (target, batch, parameters) -> new table state.

The merge is the set-based form of "apply the batch one row at a time with
INSERT ... ON CONFLICT": per key, insert-only columns come from the first
batch row and updated columns from the last (min_by / max_by — partial
aggregates, so a hot key is combined map-side), then one full outer join with
the target. NULL keys never conflict: such rows are always inserted.
Sinks (S5/S6) write the returned state to a new path; nothing is modified in
place, so a failed job leaves the old version intact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.core import blank_to_null, json_quote, ts_ntz


# ----------------------------------------------------------------------------- merge
def keyed_merge(target: DataFrame | None, batch: DataFrame, key: str, order: list[str],
                insert_cols: list[str], update_cols: list[str]) -> DataFrame:
    """Upsert ``batch`` into ``target`` on ``key`` (row-at-a-time semantics in ``order``).

    Output columns: key + insert_cols + update_cols. ``target`` may be None (empty table).
    One aggregation of the batch and one full outer join on the keys. Rows without
    a key equal nothing: they are kept (target) or inserted (batch) as they are and
    take no part in either, so they meet in no task.
    """
    ordk = F.struct(*[F.col(c) for c in order])
    cols = [key, *insert_cols, *update_cols]
    keyed, loose = batch.where(F.col(key).isNotNull()), batch.where(F.col(key).isNull())
    loose = loose.select(*cols)
    b = keyed.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in insert_cols]), ordk).alias("_first"),
        F.max_by(F.struct(*[F.col(c) for c in update_cols]), ordk).alias("_last"))
    if target is None:
        return b.select(key, *[F.col("_first")[c].alias(c) for c in insert_cols],
                        *[F.col("_last")[c].alias(c) for c in update_cols]).unionByName(loose)
    t = target.select(*cols)
    loose = loose.unionByName(t.where(F.col(key).isNull()))
    t, b = t.where(F.col(key).isNotNull()).alias("t"), b.alias("b")
    j = t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer")
    in_b = F.col(f"b.{key}").isNotNull()
    in_t = F.col(f"t.{key}").isNotNull()
    return j.select(
        F.coalesce(F.col(f"t.{key}"), F.col(f"b.{key}")).alias(key),
        *[F.when(in_t, F.col(f"t.{c}")).otherwise(F.col("_first")[c]).alias(c) for c in insert_cols],
        *[F.when(in_b, F.col("_last")[c]).otherwise(F.col(f"t.{c}")).alias(c) for c in update_cols]).unionByName(loose)


def require_keys(batch: DataFrame, key: str, message: str) -> DataFrame:
    """Abort the whole job (nothing is written) if any row lacks the key — lazily,
    inside the executing plan rather than with a separate driver-side count."""
    return batch.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(message)).cast("string"))
                            .otherwise(F.col(key)))


# ----------------------------------------------------------------------------- W30
def upsert_drafts(target: DataFrame | None, drafts: DataFrame) -> DataFrame:
    """Draft log keyed by message id: new drafts insert; a repeated message id
    only replaces the draft text and its time (created_at, name and message stay)."""
    return keyed_merge(target, drafts, "customer_message_wamid", ["created_at", "id"],
                       ["id", "customer_wa_id", "customer_name", "customer_message", "created_at"],
                       ["ai_proposed_response", "ai_responded_at"])


# ----------------------------------------------------------------------------- W31
# Allowed review ratings.
RATINGS = ("better", "similar", "worse")


def apply_ratings(shadow: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ratings (seq, shadow_id, quality_rating, notes, created_at) applied in seq order.
    Returns (new shadow state with quality_rating/notes/rated_at, rejects with reason)."""
    valid = ratings.where(F.col("quality_rating").isin(*RATINGS))
    invalid = ratings.where(~F.col("quality_rating").isin(*RATINGS) | F.col("quality_rating").isNull())
    unknown = valid.join(shadow.select(F.col("id").alias("shadow_id")), "shadow_id", "left_anti")
    # ratings of unknown ids find no row in the left join below
    last = valid.groupBy("shadow_id").agg(
        F.max_by(F.struct("quality_rating", "notes", "created_at"), F.col("seq")).alias("r"))
    base = shadow.drop("quality_rating", "notes", "rated_at")
    state = (base.join(last, base.id == last.shadow_id, "left")
             .select(*[base[c] for c in base.columns], F.col("r.quality_rating").alias("quality_rating"),
                     F.col("r.notes").alias("notes"), F.col("r.created_at").alias("rated_at")))
    rejects = (invalid.select("seq", "shadow_id", F.lit("invalid").alias("reason"))
               .unionByName(unknown.select("seq", "shadow_id", F.lit("not_found").alias("reason"))))
    return state, rejects


# ----------------------------------------------------------------------------- W32
# Placeholder draft text and default capture source of imported history.
HISTORY_DRAFT = "[historical export - no AI draft]"
DEFAULT_SOURCE = "tampermonkey_extract_v3"


def ingest_pairs(pairs: DataFrame, as_of, batch_name_col: str = "batch_name") -> tuple[DataFrame, DataFrame]:
    """Batch of historical (message, reply) pairs -> inserted rows, and per-batch
    inserted/skipped counts. Blank (whitespace-only) messages are skipped."""
    blank = ~F.col("customer_message").rlike(r"\S")
    consumed = ("customer_wa_id", "customer_name", "customer_message", "staff_reply", "source", batch_name_col)
    rows = pairs.where(~blank).select(
        *[c for c in pairs.columns if c not in consumed],
        "customer_wa_id",
        F.coalesce(blank_to_null("customer_name"), F.col(batch_name_col)).alias("customer_name"),
        "customer_message", F.lit(HISTORY_DRAFT).alias("ai_proposed_response"),
        F.col("staff_reply").alias("human_reply"),
        F.coalesce(blank_to_null("source"), F.lit(DEFAULT_SOURCE)).alias("capture_source"),
        ts_ntz(as_of).alias("created_at"))
    counts = pairs.groupBy(batch_name_col).agg(
        F.count(F.when(~blank, 1)).alias("inserted"), F.count(F.when(blank, 1)).alias("skipped"))
    return rows, counts


# ----------------------------------------------------------------------------- W34
def stock_ledger(movements: DataFrame) -> DataFrame:
    """Net stock change per item: purchases add, consumptions subtract."""
    signed = F.when(F.col("movement_type") == "consumption", -F.col("quantity")).otherwise(F.col("quantity"))
    return movements.groupBy("item_id").agg(
        F.sum(signed).cast("double").alias("net_change"), F.count(F.lit(1)).alias("movements"))


# ----------------------------------------------------------------------------- W35
def upsert_services(target: DataFrame | None, services: DataFrame, synced_at, order: str = "pos") -> DataFrame:
    """Service cache keyed by service id. Title, price, duration, category and the time of the
    sync are overwritten on conflict; service type and status keep their first value.
    A row without a key aborts the whole batch."""
    b = require_keys(services, "wix_id", "service without id: batch aborted")
    b = b.select(F.col("wix_id").alias("wix_service_id"), "service_type", "title",
                 F.col("price").alias("price_egp"), F.col("duration").alias("duration_minutes"),
                 "category", "status", ts_ntz(synced_at).alias("synced_at"), order)
    return keyed_merge(target, b, "wix_service_id", [order], ["service_type", "status"],
                       ["title", "price_egp", "duration_minutes", "category", "synced_at"])


# ----------------------------------------------------------------------------- W36
def bookings_to_interactions(bookings: DataFrame, as_of, dedupe_by_booking: bool = False) -> DataFrame:
    """Each parsed booking appended as a customer interaction. The source's
    ``ON CONFLICT DO NOTHING`` has no unique key to hit, so re-syncs duplicate;
    ``dedupe_by_booking=True`` keeps one row per booking id instead."""
    b = bookings.dropDuplicates(["wix_booking_id"]) if dedupe_by_booking else bookings
    meta = F.concat(F.lit('{"email": '), json_quote("email"), F.lit(', "phone": '), json_quote("phone"), F.lit("}"))
    keep = [c for c in b.columns if c not in ("wix_contact_id",)]
    return b.select(
        *[c for c in keep if c in ("o_orderkey", "wix_booking_id")],
        "wix_contact_id",
        F.concat(F.lit("Booking: "), F.coalesce(F.col("full_name"), F.lit("None")), F.lit(" - "),
                 F.coalesce(F.col("wix_service_id"), F.lit("None"))).alias("message_text"),
        F.lit("booked").alias("outcome"), meta.alias("metadata"), ts_ntz(as_of).alias("created_at"))


# ----------------------------------------------------------------------------- W40
def insert_metrics(target: DataFrame, batch: DataFrame, mode: str = "error",
                   keys=("log_date", "platform", "metric_name")) -> DataFrame:
    """Insert under a unique key. mode='error': any conflict (with the target or
    inside the batch) fails the job; mode='ignore': conflicting rows are skipped
    (the first row per key in the batch wins)."""
    keys = list(keys)
    if mode not in ("error", "ignore"):
        raise ValueError("mode must be 'error' or 'ignore'")
    if mode == "error":
        dup = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        clash = dup.join(target.select(*keys).withColumn("_t", F.lit(1)), keys, "left")
        bad = clash.where((F.col("_n") > 1) | F.col("_t").isNotNull())
        guard = bad.agg(F.count(F.lit(1))).scalar()
        # a filter (not a projection) so column pruning cannot drop the check
        checked = batch.where(F.when(guard > 0, F.raise_error(F.lit("duplicate key")).cast("boolean"))
                              .otherwise(F.lit(True)))
        return target.unionByName(checked)
    fresh = batch.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return target.unionByName(fresh)


# ----------------------------------------------------------------------------- W42
def rights_delete(conversations: DataFrame, intents: DataFrame) -> DataFrame:
    """Remove every conversation row of senders who asked for deletion."""
    req = intents.where(F.col("intent") == "DELETE").select(F.col("phone").alias("sender_id")).distinct()
    return conversations.join(req, "sender_id", "left_anti")


def rights_optout(blocked: DataFrame, intents: DataFrame, blocked_by: str = "whatsapp_bot") -> DataFrame:
    """Add opt-out requesters to the blocked list unless already there."""
    req = (intents.where(F.col("intent") == "OPTOUT").select(F.col("phone").alias("phone_number")).distinct()
           .join(blocked.select("phone_number"), "phone_number", "left_anti")
           .select("phone_number", F.lit("user_opt_out").alias("reason"), F.lit(blocked_by).alias("blocked_by")))
    return blocked.select("phone_number", "reason", "blocked_by").unionByName(req)


# ----------------------------------------------------------------------------- W50
# The seeded cost-control rules (service name is a parameter).
COST_RULES = (
    ("Daily spend alert", "daily_spend > 40", "send_alert"),
    ("Weekly budget alert", "weekly_spend > 300", "send_alert"),
    ("Enable aggressive cache", "daily_spend > 30", "enable_cache_ttl_120"),
    ("Switch to Flash", "daily_spend > 35", "switch_model_flash"),
)


def cost_rules_frame(spark, service: str, scale: float = 1.0) -> DataFrame:
    """The four seeded rules for ``service``; thresholds multiplied by ``scale``.
    Built JVM-side from literals (a local relation, no Python workers)."""
    rows = []
    for name, cond, action in COST_RULES:
        metric, thr = cond.split(">")
        rows.append(F.struct(F.lit(name).alias("rule_name"), F.lit(service).alias("service_name"),
                             F.lit(f"{metric.strip()} > {float(thr) * scale:g}").alias("trigger_condition"),
                             F.lit(action).alias("action_to_take"), F.lit(True).alias("is_enabled")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def cost_rules_fired(spend_events: DataFrame, rules: DataFrame) -> DataFrame:
    """Evaluate ``daily_spend > N`` / ``weekly_spend > N`` per service and day.
    Spend is summed exactly in cents; weekly = calendar week (Monday start) to date.
    ``rules`` is any rule table (a handful of rows is broadcast by measured size)."""
    from pyspark.sql.window import Window
    daily = (spend_events.where(F.col("agent_name").isNotNull())
             .groupBy(F.col("agent_name").alias("service_name"), F.to_date("created_at").alias("spend_date"))
             .agg(F.sum("cost_cents").alias("daily_cents")))
    wk = (Window.partitionBy("service_name", F.date_trunc("WEEK", "spend_date")).orderBy("spend_date")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    daily = daily.withColumn("weekly_cents", F.sum("daily_cents").over(wk))
    pat = r"^\s*(\w+)\s*>\s*([0-9.]+)\s*$"
    r = (rules.where(F.col("is_enabled"))
         .select("rule_name", "service_name", "action_to_take",
                 F.regexp_extract("trigger_condition", pat, 1).alias("metric"),
                 F.regexp_extract("trigger_condition", pat, 2).cast("decimal(20,2)").alias("threshold")))
    j = daily.join(r, "service_name")
    cents = F.when(F.col("metric") == "daily_spend", F.col("daily_cents")).when(
        F.col("metric") == "weekly_spend", F.col("weekly_cents"))
    return (j.withColumn("cents", cents).where(F.col("cents") > F.col("threshold") * 100)
            .select("rule_name", "service_name", "spend_date", "metric",
                    (F.col("cents").cast("double") / 100).alias("spend"),
                    F.col("threshold").cast("double").alias("threshold"), "action_to_take"))


def seed_rules(target: DataFrame, seeds: DataFrame, key: str = "rule_name") -> DataFrame:
    """W54: adds the seeded rules that the table doesn't have yet (by name); what is there stays as it is."""
    return target.unionByName(seeds.join(target.select(key), key, "left_anti").select(*target.columns))


# ----------------------------------------------------------------------------- W53
def update_rows(target: DataFrame, changes: DataFrame, as_of, key: str = "id", order: str = "seq") -> DataFrame:
    """Updates by key, the last change (in ``order``) of a row wins. Every updated row gets ``updated_at`` =
    ``as_of``, also when a value stays the same; other rows keep theirs. Changes of unknown keys do nothing."""
    cols = [c for c in changes.columns if c not in (key, order)]
    last = changes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max_by(F.struct(*cols), F.col(order)).alias("_new"))
    j = target.join(last, target[key] == last["_key"], "left")
    hit = F.col("_key").isNotNull()
    return j.select(*[(F.when(hit, F.col("_new")[c]).otherwise(target[c]) if c in cols else
                       F.when(hit, ts_ntz(as_of)).otherwise(target[c]) if c == "updated_at" else target[c]).alias(c)
                      for c in target.columns])


# ----------------------------------------------------------------------------- W51
# Modes a setting may take.
SETTING_VALUES = ("active", "paused")


def current_settings(changes: DataFrame) -> DataFrame:
    """Latest accepted value per key (invalid values are rejected, not applied)."""
    ok = changes.where(F.col("value").isin(*SETTING_VALUES))
    return ok.groupBy("key").agg(F.max_by("value", F.struct("created_at", "event_id")).alias("value"))


def ai_mode(settings: DataFrame, key: str = "ai_concierge_mode", default: str = "active") -> DataFrame:
    m = settings.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default)).alias("mode"))
    return m.select("mode", (F.col("mode") == "active").alias("is_active"))


# ----------------------------------------------------------------------------- V52
# The domains declared on the conversation and interaction tables, and the lengths of a submission.
CHANNEL_DOMAIN = ("whatsapp", "messenger", "instagram", "web")
INTERACTION_TYPES = ("booking", "question", "complaint", "feedback", "other")
SENTIMENTS = ("positive", "neutral", "negative")
OUTCOMES = ("resolved", "escalated", "booked", "follow_up", "other")
SUBMISSION_LENGTH = (5, 3000)


def _checked(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Good/quarantine split in one scan: ``reasons`` lists every violated rule ('' when the row is valid)."""
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
    return rows.select("*", F.array_join(reasons, ",").alias("reasons")).withColumn(
        "is_valid", F.col("reasons") == "")


def _outside(c: Column, low: int, high: int) -> Column:
    return c.isNotNull() & ((c < low) | (c > high))


def _not_in(c: Column, domain) -> Column:
    return c.isNotNull() & ~c.isin(*domain)


def validate_rows(rows: DataFrame, max_message: int = 1000) -> DataFrame:
    """Rules of the conversation table."""
    ch, msg = F.col("channel"), F.col("original_message")
    return _checked(rows, [
        ("channel_null", ch.isNull()), ("channel_domain", _not_in(ch, CHANNEL_DOMAIN)),
        ("sender_null", F.col("sender_id").isNull()), ("message_null", msg.isNull()),
        ("message_length", _outside(F.length(msg), 1, max_message)),
        ("feedback_range", _outside(F.col("customer_feedback"), 1, 5))])


def validate_interactions(rows: DataFrame) -> DataFrame:
    """Rules of the customer interaction table; a check on NULL holds, as in the database."""
    return _checked(rows, [
        ("type_domain", _not_in(F.col("interaction_type"), INTERACTION_TYPES)),
        ("sentiment_domain", _not_in(F.col("sentiment"), SENTIMENTS)),
        ("satisfaction_range", _outside(F.col("satisfaction_score"), 1, 5)),
        ("outcome_domain", _not_in(F.col("outcome"), OUTCOMES))])


def validate_submissions(rows: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Length of a submitted text, in characters."""
    text = F.col(text_col)
    return _checked(rows, [("text_null", text.isNull()), ("text_length", _outside(F.length(text), *SUBMISSION_LENGTH))])

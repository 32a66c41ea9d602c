"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry reads the fixture tables through the adapters and applies one
operator with the fixture parameters; all work scales with the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.core import spread
from ledgerline.operators import analytics as A
from ledgerline.operators import facet_index as FI
from ledgerline.operators import growing_index as G
from ledgerline.operators import paging
from ledgerline.operators import stateful as X
from ledgerline.operators import transforms as T
from ledgerline.operators import trend_sketches as TS
from ledgerline.operators import vectors as V
from ledgerline.operators import writes as W
from ledgerline.plans import fixture_params as P
from ledgerline.sources import adapters as ad
from ledgerline.session import ensure_checkpoint_dir
from ledgerline.sources.tables import Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
        return fn
    return deco


# ---------------------------------------------------------------- analytics
@register("student_ltv")
def _a1(c): return A.student_ltv(ad.students(c), ad.registrations(c))


@register("ai_performance")
def _a2(c): return A.ai_performance(ad.ai_events(c), P.EVENTS_AS_OF)


@register("ai_business_impact")
def _a3(c): return A.ai_business_impact(ad.ai_events(c))


@register("channel_performance")
def _a4(c): return A.channel_performance(ad.concierge_conversations(c))


@register("daily_trends")
def _a5(c): return A.daily_trends(ad.concierge_conversations(c))


@register("weekly_trends")
def _a5w(c):
    conversations = ad.concierge_conversations(c)
    path = f"{ensure_checkpoint_dir(c.spark).rstrip('/')}/days-{uuid.uuid4().hex}"
    timed = conversations.where(F.col("created_at").isNotNull())
    TS.refresh_days(timed, path, P.FIRST_DAY)
    return TS.within_error(timed, TS.stored_days(c.spark, path), "WEEK", P.SKETCH_ERROR)


@register("top_intents")
def _a6(c): return A.top_intents(ad.concierge_conversations(c), 20)


@register("hourly_metrics")
def _a7(c): return A.hourly_metrics(ad.concierge_conversations(c))


@register("conversation_stats")
def _a8(c): return A.conversation_stats(ad.concierge_conversations(c))


@register("conversation_page")
def _a9(c): return A.conversation_page(ad.concierge_conversations(c), P.PAGE_CHANNEL, P.PAGE_LIMIT, P.PAGE_OFFSET)


@register("conversation_page_deep")
def _a9d(c):
    conversations = ad.concierge_conversations(c)
    return paging.conversation_page_at(conversations, limit=P.PAGE_LIMIT, offset=conversations.count() // 2)


@register("dashboard_stats")
def _a10(c):
    return A.dashboard_stats(ad.students(c), ad.concierge_conversations(c), ad.finance_transactions(c),
                             P.EVENTS_AS_OF, finance_as_of=P.LINEITEM_AS_OF)


@register("student_search")
def _a11(c): return A.student_search(ad.students(c), P.STUDENT_QUERY, P.SEARCH_LIMIT)


@register("student_activity")
def _a12(c): return A.student_activity(ad.students(c), ad.registrations(c), P.ORDERS_AS_OF)


@register("finance_totals")
def _a13(c): return A.finance_totals(ad.finance_transactions(c))


@register("finance_monthly_trend")
def _a14(c): return A.finance_monthly_trend(ad.finance_transactions(c), P.LINEITEM_AS_OF)


@register("revenue_by_category")
def _a15a(c): return A.revenue_by_category(ad.finance_transactions(c), 5)


@register("revenue_by_category_all")
def _a15b(c): return A.revenue_by_category(ad.finance_transactions(c), 5, keep_blank=True)


@register("transaction_list")
def _a16(c): return A.transaction_list(ad.finance_transactions(c), P.TRANSACTION_LIMIT)


@register("inventory_levels")
def _a17(c): return A.inventory_levels(ad.inventory_items(c))


@register("inventory_category_summary")
def _a18(c): return A.inventory_category_summary(ad.finance_transactions(c))


@register("recent_movements")
def _a19(c): return A.recent_movements(ad.stock_movements(c), ad.inventory_items(c), 25)


@register("purchase_totals")
def _a20(c): return A.purchase_totals(ad.finance_transactions(c), ad.inventory_items(c))


@register("low_stock_top")
def _a21(c): return A.low_stock_top(ad.inventory_items(c), 5)


@register("business_context")
def _a22(c):
    return A.business_context(ad.students(c), ad.finance_transactions(c), ad.inventory_items(c), P.ORDERS_AS_OF)


@register("snapshot_30d")
def _a23(c): return A.snapshot_30d(ad.registrations(c), ad.students(c), P.ORDERS_AS_OF)


@register("recent_rows")
def _a26(c):
    cc = ad.concierge_conversations(c).withColumnRenamed("original_message", "content")
    return A.recent_rows({"concierge_conversations": cc}, "concierge_conversations", P.RECENT_ROWS_LIMIT)


# ---------------------------------------------------------------- transforms


def _services(c): return T.parse_services(ad.service_payload(c))


def _booking_feed(c):
    """The fixture's orders are one row group, hence one task; the feed is fanned out over the cores once."""
    return spread(ad.booking_payload(c), c.spark.sparkContext.defaultParallelism)


def _bookings(c): return T.parse_bookings(_booking_feed(c), P.ORDERS_AS_OF)


def _intents(c): return T.rights_intent(ad.rights_message(c))


def _techniques(c): return T.extract_technique(ad.extraction_response(c))


register("parse_services")(_services)
register("parse_bookings")(_bookings)


@register("sync_summary")
def _t39(c):
    every = T.parse_bookings(_booking_feed(c), P.ORDERS_AS_OF, drop_unidentified=False)
    return T.sync_run(_services(c), every, P.ORDERS_AS_OF)


@register("ga4_metrics")
def _t40(c): return T.ga4_metrics(ad.ga4_payload(c))


register("rights_intent")(_intents)


@register("rights_access_report")
def _t42(c): return T.rights_access_report(_intents(c), ad.concierge_conversations(c))


@register("parse_rewrite")
def _t44(c): return T.parse_rewrite(ad.rewrite_response(c))


@register("resolve_tiers")
def _t45(c): return T.resolve_tiers(ad.tier_response(c))


@register("extract_technique")
def _t46(c):
    return _techniques(c).select(
        "doc_id", "submission_channel", "extracted", "technique_name", "artisan_name", "region", "category",
        F.array_join("materials", ",").alias("materials"), F.array_join("tools", ",").alias("tools"),
        "description", "risk_level")


@register("normalize_technique")
def _t47(c):
    return T.normalize_technique(_techniques(c)).select("doc_id", "technique_name", "artisan_name", "category",
                                                        "risk_level")


@register("embedding_text")
def _t48(c): return T.embedding_text(_techniques(c)).select("doc_id", "embed_text")


@register("technique_facets")
def _t49(c): return T.technique_facets(T.normalize_technique(_techniques(c)))


@register("facet_combinations")
def _t49c(c):
    return FI.facet_combinations(T.normalize_technique(_techniques(c)), T.TECHNIQUE_CATEGORIES, (*T.RISK_LEVELS, "unknown"),
                                 P.FACET_MATERIALS)


# ---------------------------------------------------------------- keyed writes and stateful


def _draft_log(c):
    se = ad.shadow_event(c).where(F.col("kind") == "draft")
    return se.select(F.col("event_id").alias("id"), "customer_wa_id", "customer_name",
                     F.col("text").alias("customer_message"),
                     F.col("wamid").alias("customer_message_wamid"),
                     F.concat(F.lit("draft: "), F.col("text")).alias("ai_proposed_response"),
                     F.col("created_at").alias("ai_responded_at"), "created_at")


def _reply_log(c):
    se = ad.shadow_event(c).where(F.col("kind") == "reply")
    return se.select(F.col("event_id").alias("id"), "customer_wa_id", F.col("text").alias("reply_text"),
                     F.lit("tampermonkey").alias("capture_source"), "created_at")


def _first_half(df, id_col, c, table="events", table_id="event_id"):
    """Rows whose id is in the lower half of the source id range (scalar subquery)."""
    top = c[table].agg(F.max(table_id)).scalar()
    return df.where(F.col(id_col) * 2 <= top), df.where(F.col(id_col) * 2 > top)


@register("upsert_drafts")
def _w30(c):
    first, second = _first_half(_draft_log(c), "id", c)
    return W.upsert_drafts(W.upsert_drafts(None, first), second)


def _open_history(c):
    """Imported messages that nobody has answered: rows of the same log (ids below zero)."""
    rows = W.ingest_pairs(ad.conversation_pair(c), P.EVENTS_AS_OF)[0].where(F.col("human_reply").isNull())
    return rows.select((-1 - (F.col("conv_id") * 100_000 + F.col("turn"))).alias("id"), "customer_wa_id", "customer_name",
                       "customer_message", "ai_proposed_response", "created_at", "capture_source")


def _shadow(c):
    log = W.upsert_drafts(None, _draft_log(c)).unionByName(_open_history(c), allowMissingColumns=True)
    return X.match_replies(log, _reply_log(c), 24)


register("match_replies")(_shadow)


def _rated(c): return W.apply_ratings(_shadow(c), ad.rating(c))


@register("apply_ratings")
def _w31(c): return _rated(c)[0].select("id", "quality_rating", "notes", "rated_at")


@register("apply_ratings_rejects")
def _w31r(c): return _rated(c)[1]


@register("training_pairs")
def _a24(c): return A.training_pairs(_rated(c)[0], only_complete=True, limit=50)


@register("training_pair_stats")
def _a25(c): return A.training_pair_stats(_rated(c)[0])


@register("ingest_pairs")
def _w32(c): return W.ingest_pairs(ad.conversation_pair(c), P.EVENTS_AS_OF)[0]


@register("ingest_pairs_counts")
def _w32c(c): return W.ingest_pairs(ad.conversation_pair(c), P.EVENTS_AS_OF)[1]


@register("usage_log")
def _w33(c):
    return X.usage_log(ad.usage_request(c), ad.inventory_items(c)).select(
        "event_id", "item_id", "verdict", F.col("stock_after").cast("double").alias("stock_after"))


@register("stock_ledger")
def _w34(c): return W.stock_ledger(ad.stock_movements(c))


@register("upsert_services")
def _w35(c):
    first, second = _first_half(_services(c), "pos", c, "part", "p_partkey")
    return W.upsert_services(W.upsert_services(None, first, "2001-07-31 00:00:00"), second, P.ORDERS_AS_OF)


@register("bookings_to_interactions")
def _w36(c): return W.bookings_to_interactions(_bookings(c), P.ORDERS_AS_OF)


@register("insert_metrics")
def _w40(c):
    m = T.ga4_metrics(ad.ga4_payload(c))
    return W.insert_metrics(m.where(F.col("metric_name") == "activeUsers"), m, mode="ignore")


@register("rights_delete")
def _w42a(c):
    return W.rights_delete(ad.concierge_conversations(c), _intents(c)).select("id", "sender_id", "channel",
                                                                             "created_at")


@register("rights_optout")
def _w42b(c):
    intents = _intents(c)
    seed = (intents.where(F.col("intent") == "DELETE").select(F.col("phone").alias("phone_number")).distinct()
            .select("phone_number", F.lit("user_opt_out").alias("reason"), F.lit("seed").alias("blocked_by")))
    return W.rights_optout(seed, intents)


@register("cost_rules_fired")
def _w50(c):
    spark = c.spark
    return W.cost_rules_fired(ad.ai_events(c), W.cost_rules_frame(spark, "agent_a", P.COST_RULE_SCALE))


@register("current_settings")
def _w51(c): return W.current_settings(ad.setting_change(c))


@register("ai_mode")
def _w51m(c): return W.ai_mode(W.current_settings(ad.setting_change(c)))


@register("validate_rows")
def _v52(c): return W.validate_rows(ad.unchecked_conversations(c)).select("id", "is_valid", "reasons")


@register("validate_interactions")
def _v52i(c): return W.validate_interactions(ad.unchecked_interactions(c)).select("id", "is_valid", "reasons")


@register("validate_submissions")
def _v52s(c): return W.validate_submissions(ad.extraction_response(c)).select("doc_id", "is_valid", "reasons")


@register("update_conversations")
def _w53(c):
    rows = ad.concierge_conversations(c).withColumn("updated_at", F.col("created_at"))
    return W.update_rows(rows, ad.feedback_change(c), P.EVENTS_AS_OF).select("id", "customer_feedback", "updated_at")


@register("rate_verdicts")
def _x49(c):
    ev = c["events"].select("event_id", F.col("user_id").alias("client"), F.col("ts").alias("created_at"))
    return X.rate_verdicts(ev, limit=P.RATE_LIMIT, window_seconds=P.RATE_WINDOW_SECONDS).select(
        "event_id", "client", "verdict")


# ---------------------------------------------------------------- vectors


def _kb(c): return ad.knowledge_embeddings(c)


@register("kb_search")
def _v24(c):
    kb = _kb(c)
    return V.kb_search(kb, V.centroid_queries(kb), k=3, min_similarity=0.12)


@register("kb_search_strict")
def _v24s(c):
    kb = _kb(c)
    return V.kb_search(kb, V.centroid_queries(kb), k=10, min_similarity=P.STRICT_MIN_SIMILARITY)


@register("memory_search")
def _v25(c):
    kb = _kb(c)
    return V.memory_search(kb, V.centroid_queries(kb), k=P.MEMORY_K)


def _ivf(c):
    """The index over the categories' centroids: centers that SQL can compute too. (At most one for each category;
    ``build_ivf_index`` fits them by KMeans instead.)"""
    kb = _kb(c)
    rows = V.centroid_queries(kb).orderBy("query_id").collect()
    path = f"{ensure_checkpoint_dir(c.spark).rstrip('/')}/ivf-{uuid.uuid4().hex}"
    indexed, centers = V.ivf_index_of_centers(kb, np.array([r["query_vec"] for r in rows]), path=path)
    return kb, indexed, centers


@register("kb_search_ivf")
def _v26(c):
    kb, indexed, centers = _ivf(c)
    return V.kb_search_ivf(indexed, centers, V.centroid_queries(kb), k=10, n_probe=P.IVF_PROBES)


@register("kb_search_ivf_recall")
def _v26r(c):
    kb, indexed, centers = _ivf(c)
    q = V.centroid_queries(kb)
    return V.recall_at_k(V.kb_search_ivf(indexed, centers, q, k=10, n_probe=P.IVF_PROBES), V.nearest(kb, q, 10))


def _list_queries(kb):
    """Every row whose id is divisible by 50 asks for its neighbours."""
    return kb.where("id % 50 = 0 AND embedding IS NOT NULL").select(
        F.col("id").cast("string").alias("query_id"), F.col("embedding").alias("query_vec"))


def _lists(c):
    kb = _kb(c)
    path = f"{ensure_checkpoint_dir(c.spark).rstrip('/')}/lists-{uuid.uuid4().hex}"
    G.build_index(kb, path, list_rows=P.LIST_ROWS, fanout=P.LIST_FANOUT)
    return kb, G.search(c.spark, path, _list_queries(kb), k=10, beam=P.LIST_BEAM)


@register("kb_search_lists")
def _v26l(c):
    return _lists(c)[1]


@register("kb_search_lists_recall")
def _v26lr(c):
    kb, found = _lists(c)
    return V.recall_at_k(found, V.nearest(kb, _list_queries(kb), 10))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["finance_monthly_trend"](spark, sf_dir)

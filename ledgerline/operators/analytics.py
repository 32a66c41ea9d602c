"""Analytics operators (scan / filter / project / join / aggregate / sort / limit).

Every function takes the business tables as DataFrames plus parameters and
returns a DataFrame; nothing is collected. Time-relative reports take an
explicit ``as_of`` instead of reading the clock.

Plan notes that hold for the whole module:
* facts are aggregated before they meet a dimension (partial aggregation runs
  map-side, so only one row per group and partition crosses the shuffle);
* all conditional counts of a report share one ``agg`` (one scan);
* one-row results are combined through scalar subqueries (``DataFrame.scalar``),
  never through joins;
* top-k is ``orderBy(...).limit(k)`` so Spark plans TakeOrderedAndProject
  (per-partition top-k, then a k-row merge), and every sort has a unique
  tie-break so a LIMIT is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.core import (as_date, blank_to_null, count_if, exact_mean, expense, income, money,
                                       month_start, newest_first, pct, round_int, round_long, sum01, ts_minus, ymd)
from ledgerline.session import cut_lineage

# The four chat channels counted by the stats report.
CHANNELS = ("whatsapp", "messenger", "instagram", "web")
# Finance categories that count as stock purchases.
PURCHASE_CATEGORIES = ("Materials", "Equipment", "Sales (Out)", "Sales Out")


# ----------------------------------------------------------------------------- A1
def student_ltv(students: DataFrame, registrations: DataFrame) -> DataFrame:
    """Per student: registrations booked and lifetime value (NULL if none paid)."""
    per_student = registrations.groupBy("student_id").agg(
        F.count("id").alias("n"), F.sum("amount_paid").alias("ltv"))
    s = students.select("id", "full_name")
    return (s.join(per_student, s.id == per_student.student_id, "left")
            .select(s.id.alias("student_id"), "full_name",
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("total_courses_booked"),
                    money("ltv").alias("lifetime_value")))


# ----------------------------------------------------------------------------- A2
def ai_performance(ai_events: DataFrame, as_of, days: int = 30) -> DataFrame:
    ev = ai_events.where(F.col("created_at") >= ts_minus(as_of, f"'{days}' DAY"))
    n = F.count(F.lit(1))
    return (ev.groupBy("agent_name").agg(
        n.alias("total_requests"),
        (F.sum(F.when(F.col("outcome") == "success", 1).otherwise(0)).cast("double")
         / F.nullif(n, F.lit(0)) * 100).alias("success_rate_percent"),
        sum01(F.col("outcome") == "escalated").alias("escalations_count"),
        exact_mean("success_metric").alias("avg_quality_score"),
        (F.sum("cost_cents").cast("double") / 100).alias("total_cost_dollars"),
        round_int(F.avg("latency_ms")).alias("avg_response_time_ms"),
        F.to_date(F.min("created_at")).alias("first_event_date"),
        F.to_date(F.max("created_at")).alias("last_event_date"),
        F.to_date(F.max("created_at")).alias("report_date"))
        .orderBy(F.desc("total_requests"), F.asc_nulls_first("agent_name")))


# ----------------------------------------------------------------------------- A3
def ai_business_impact(ai_events: DataFrame, value_per_booking: int = 50) -> DataFrame:
    et, oc = F.col("event_type"), F.col("outcome")
    auto = count_if((et == "booking") & (oc == "success"))
    cost = F.sum("cost_cents").cast("double") / 100
    return (ai_events.groupBy(F.to_date("created_at").alias("event_date")).agg(
        auto.alias("bookings_automated"),
        count_if((et == "booking") & (oc == "escalated")).alias("bookings_escalated"),
        count_if((et == "recommendation") & (oc == "success")).alias("recommendations_given"),
        (auto * value_per_booking).alias("estimated_revenue_dollars"),
        cost.alias("total_ai_cost_dollars"),
        F.round(((auto * value_per_booking).cast("double") - cost) / F.nullif(auto, F.lit(0)), 2)
        .alias("revenue_per_ai_cost"))
        .orderBy(F.desc("event_date")))


# ----------------------------------------------------------------------------- A4
def channel_performance(conversations: DataFrame) -> DataFrame:
    esc = count_if(F.col("escalated") == F.lit(True))
    n = F.count(F.lit(1))
    return conversations.groupBy("channel").agg(
        n.alias("total_conversations"), esc.alias("escalated"), pct(esc, n).alias("escalation_rate"),
        F.round(F.avg("response_time_ms"), 2).alias("avg_response_ms"),
        F.round(F.avg("customer_feedback"), 2).alias("avg_csat"),
        F.max("created_at").alias("last_conversation"))


# ----------------------------------------------------------------------------- A5
def daily_trends(conversations: DataFrame, approximate: bool = False) -> DataFrame:
    """Per day; two exact distinct counts (Catalyst's Expand) or HLL sketches
    (``approximate=True``) when the fact is too large for exact distincts."""
    esc = count_if(F.col("escalated") == F.lit(True))
    n = F.count(F.lit(1))
    if approximate:
        u = F.approx_count_distinct("sender_id", 0.01)
        s = F.approx_count_distinct("session_id", 0.01)
    else:
        u, s = F.count_distinct("sender_id"), F.count_distinct("session_id")
    return (conversations.groupBy(F.to_date("created_at").alias("conversation_date")).agg(
        n.alias("total"), esc.alias("escalated"), pct(esc, n).alias("escalation_pct"),
        F.round(F.avg("response_time_ms"), 2).alias("avg_response_ms"),
        u.alias("unique_customers"), s.alias("unique_sessions"))
        .orderBy(F.desc("conversation_date")))


# ----------------------------------------------------------------------------- A6
def top_intents(conversations: DataFrame, n: int = 20) -> DataFrame:
    known = conversations.where(F.col("intent_detected").isNotNull())
    cnt = F.count(F.lit(1))
    agg = known.groupBy("intent_detected").agg(
        cnt.alias("count"),
        F.round(F.avg("response_time_ms"), 2).alias("avg_response_ms"),
        pct(count_if(F.col("escalated") == F.lit(True)), cnt).alias("escalation_rate"))
    # share of all non-NULL rows: a scalar subquery over the same aggregate, so the
    # aggregate's exchange is reused and the table is scanned once
    total = agg.agg(F.sum("count")).scalar()
    return (agg.select("intent_detected", "count", pct(F.col("count"), total).alias("percentage"),
                       "avg_response_ms", "escalation_rate")
            .orderBy(F.desc("count"), "intent_detected").limit(n))


# ----------------------------------------------------------------------------- A7
def hourly_metrics(conversations: DataFrame) -> DataFrame:
    """Hourly rollup in one pass over the fact: one GROUPING SETS aggregation
    ((hour), (hour, intent), (hour, channel)) carrying every additive measure,
    then one group-by hour that takes the totals from the hour rows and each mode
    (most frequent non-NULL value, ties to the smallest) from its own rows with
    ``min_by`` — a linear plan, so the fact is scanned and shuffled once."""
    h, it, ch = "metric_hour", "intent_detected", "channel"
    esc = count_if(F.col("escalated") == F.lit(True))
    sets = conversations.withColumn(h, F.date_trunc("HOUR", "created_at")).groupingSets(
        [[h], [h, it], [h, ch]], h, it, ch).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), esc.alias("e"),
        F.sum("response_time_ms").alias("rs"), F.count("response_time_ms").alias("rn"),
        F.sum("customer_feedback").alias("fs"), F.count("customer_feedback").alias("fn"))
    hour_row = F.col("gid") == 3          # grouping_id bits (hour, intent, channel): 011 = hour only
    by_intent = (F.col("gid") == 1) & F.col(it).isNotNull()
    by_channel = (F.col("gid") == 2) & F.col(ch).isNotNull()

    def tot(c):
        return F.sum(F.when(hour_row, F.col(c)))

    n, e = tot("n"), tot("e")
    return sets.groupBy(h).agg(
        n.alias("total_conversations"), e.alias("escalated_count"),
        round_int(tot("rs").cast("double") / tot("rn")).alias("avg_response_time_ms"),
        F.round((n - e).cast("double") * 100 / n, 2).alias("resolution_rate"),
        F.round(tot("fs").cast("double") / tot("fn"), 2).alias("csat_avg"),
        F.min_by(F.col(it), F.when(by_intent, F.struct((-F.col("n")).alias("nc"), F.col(it).alias("v"))))
        .alias("top_intent"),
        F.min_by(F.col(ch), F.when(by_channel, F.struct((-F.col("n")).alias("nc"), F.col(ch).alias("v"))))
        .alias("top_channel"))


# ----------------------------------------------------------------------------- A8
def conversation_stats(conversations: DataFrame) -> DataFrame:
    ch = F.col("channel")
    return conversations.agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("escalated") == F.lit(True)).alias("escalated"),
        round_int(F.coalesce(F.avg("response_time_ms"), F.lit(0.0))).alias("avg_response_ms"),
        *[count_if(ch == c).alias(c) for c in CHANNELS])


# ----------------------------------------------------------------------------- A9
PAGE_COLUMNS = ("id", "session_id", "channel", "sender_id", "original_message", "rewritten_query", "ai_response",
                "model_used", "intent_detected", "escalated", "response_time_ms", "created_at")


def conversation_page(conversations: DataFrame, channel: str | None = None, limit: int = 50,
                      offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 2000 or offset < 0:
        raise ValueError("limit must be in 1..2000 and offset >= 0")
    df = conversations
    if channel:
        df = df.where(F.col("channel") == channel)
    return (df.select(*PAGE_COLUMNS).orderBy(newest_first("created_at"), "id")
            .offset(offset).limit(limit))


# ----------------------------------------------------------------------------- A10
def dashboard_stats(students: DataFrame, conversations: DataFrame, finance: DataFrame,
                    as_of, finance_as_of=None) -> DataFrame:
    """Four KPIs in one row. ``finance_as_of`` defaults to ``as_of`` (one clock)."""
    fin_now = finance_as_of or as_of
    convos = conversations.where(F.col("created_at") >= ts_minus(as_of, "'24' HOUR")).agg(F.count(F.lit(1)))
    td = F.col("transaction_date")
    unpaid = ((F.col("income_receivable") > 0) & (F.col("income_cash") == 0) & (F.col("income_bank") == 0)
              & (td >= ts_minus(fin_now, "'90' DAY")))
    students_n = students.agg(F.count(F.lit(1))).scalar()
    # one bound that the scan can use: the earlier of the two starts
    since = F.least(ts_minus(fin_now, "'90' DAY"), month_start(fin_now))
    fin = finance.where(td >= since).agg(
        count_if(unpaid).alias("unpaid_invoices"),
        F.coalesce(F.sum(F.when(td >= month_start(fin_now), F.col("income_cash") + F.col("income_bank"))),
                   F.lit(0).cast("decimal(12,2)")).alias("rev"))
    return fin.select(students_n.alias("total_students"), convos.scalar().alias("ai_convos_24h"), "unpaid_invoices",
                      money("rev").alias("revenue_this_month"))


# ----------------------------------------------------------------------------- A11
def student_search(students: DataFrame, q: str | None = None, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be in 1..500")
    df = students
    if q:
        pat = f"%{q}%"           # user % and _ stay wildcards, as in the source API
        df = df.where(F.col("full_name").ilike(pat) | F.col("email").ilike(pat))
    return (df.orderBy(newest_first("created_at"), "id").limit(limit)
            .select("id", F.coalesce(blank_to_null("full_name"), F.lit("Unknown")).alias("name"),
                    F.coalesce(blank_to_null("email"), F.lit("")).alias("email"),
                    F.coalesce(blank_to_null("phone"), F.lit("")).alias("phone"), "created_at"))


# ----------------------------------------------------------------------------- A12
def student_activity(students: DataFrame, registrations: DataFrame, as_of) -> DataFrame:
    this_month = F.col("registration_date") >= month_start(as_of)
    total = students.agg(F.count(F.lit(1))).scalar()
    return registrations.agg(
        F.count_distinct(F.when(this_month, F.col("student_id"))).alias("active_this_month"),
        F.count(F.lit(1)).alias("total_registrations")).select(
        "active_this_month", "total_registrations", total.alias("total_students"))


# ----------------------------------------------------------------------------- A13
def finance_totals(finance: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(12,2)")
    t = finance.agg(F.coalesce(F.sum(income()), zero).alias("i"), F.coalesce(F.sum(expense()), zero).alias("e"))
    return t.select(money("i").alias("total_income"), money("e").alias("total_expense"),
                    money(F.col("i") - F.col("e")).alias("net_profit"))


# ----------------------------------------------------------------------------- A14
def finance_monthly_trend(finance: DataFrame, as_of, months: int = 6) -> DataFrame:
    zero = F.lit(0).cast("decimal(12,2)")
    recent = finance.where(F.col("transaction_date") >= ts_minus(as_of, f"'{months}' MONTH"))
    return (recent.groupBy(F.date_trunc("MONTH", "transaction_date").alias("m")).agg(
        money(F.coalesce(F.sum(income()), zero)).alias("revenue"),
        money(F.coalesce(F.sum(expense()), zero)).alias("expenses"))
        .orderBy("m")
        .select(F.to_date("m").alias("month_start"), F.date_format("m", "MMM yy").alias("month"),
                "revenue", "expenses"))


# ----------------------------------------------------------------------------- A15
def revenue_by_category(finance: DataFrame, n: int = 5, keep_blank: bool = False) -> DataFrame:
    """Top-n income categories. ``keep_blank=True`` keeps NULL and '' categories."""
    df = finance.where(income() > 0)
    if not keep_blank:
        df = df.where(F.col("category").isNotNull() & (F.col("category") != ""))
    return (df.groupBy("category").agg(money(F.sum(income())).alias("total"))
            .orderBy(F.desc("total"), F.asc_nulls_first("category")).limit(n))


# ----------------------------------------------------------------------------- A16
def transaction_list(finance: DataFrame, limit: int = 200) -> DataFrame:
    if not 1 <= limit <= 2000:
        raise ValueError("limit must be in 1..2000")
    inc, exp = income(), expense()
    out = finance.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "transaction_date",
        F.coalesce(ymd("transaction_date"), F.lit("")).alias("date"),
        F.coalesce(blank_to_null("description"), F.lit("")).alias("description"),
        F.coalesce(blank_to_null("category"), F.lit("Uncategorized")).alias("category"),
        # A NULL income cannot be classified: amount and type stay NULL.
        F.when(inc > 0, money(inc)).when(inc.isNotNull(), -money(exp)).alias("amount"),
        F.when(inc > 0, "income").when(inc.isNotNull(), "expense").alias("type"))
    order = [newest_first("transaction_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
             "category", F.asc_nulls_first("amount"), F.asc_nulls_first("type")]
    return out.orderBy(*order).limit(limit).drop("transaction_date")


# ----------------------------------------------------------------------------- A17
def inventory_levels(items: DataFrame) -> DataFrame:
    cpu = F.col("cost_per_unit")
    return (items.select(
        "id", "name", "category", "unit", money("current_stock").alias("current_stock"),
        money("minimum_stock").alias("minimum_stock"), money("reorder_point").alias("reorder_point"),
        F.when(cpu != 0, money(cpu)).alias("cost_per_unit"),
        F.coalesce(blank_to_null("supplier"), F.lit("")).alias("supplier"),
        (F.col("current_stock") <= F.col("minimum_stock")).alias("low_stock"))
        .orderBy(F.asc_nulls_last("category"), F.asc_nulls_last("name"), "id"))


# ----------------------------------------------------------------------------- A18
def inventory_category_summary(finance: DataFrame) -> DataFrame:
    exp = expense()
    p = finance.where(F.col("category").isin(*PURCHASE_CATEGORIES) & (exp > 0))
    return p.groupBy(F.col("category").alias("inventory_category")).agg(
        F.count(F.lit(1)).alias("purchase_count"), money(F.sum(exp)).alias("total_invested"),
        ymd(F.max("transaction_date")).alias("last_purchase"))


# ----------------------------------------------------------------------------- A19
MOST_CANDIDATES = 1_000_000
MOVEMENT_COLUMNS = ("l_orderkey", "l_linenumber", "l_suppkey", "item_id", "movement_type", "quantity", "notes", "created_at",
                    "created_by")


def recent_movements(movements: DataFrame, items: DataFrame, n: int = 25) -> DataFrame:
    """Newest n movements of known items (inner join: a movement whose item is missing must not take a slot).

    The fact is not joined: its newest rows (4 n, then 16 times as many each time) are cut out by a top-k, written, and
    joined to the items, until n of them are known or there are no more. Only when ``MOST_CANDIDATES`` hold too few
    known items, so that nearly all movements are of unknown ones, the whole fact is joined."""
    order = [newest_first("created_at"), "l_orderkey", "l_linenumber", "l_suppkey", "item_id"]
    it = items.select(F.col("id").alias("i_id"), F.col("name").alias("item_name"), "unit")

    def known(rows: DataFrame) -> DataFrame:
        return rows.join(it, rows.item_id == it.i_id, "inner")

    movements = movements.select(*MOVEMENT_COLUMNS)
    joined, width = None, 4 * n
    while joined is None:
        if width > MOST_CANDIDATES:
            joined = known(movements)
            break
        newest = cut_lineage(movements.orderBy(*order).limit(width))
        if known(newest).limit(n).count() == n or newest.count() < width:
            joined = known(newest)
        width *= 16
    return (joined.orderBy(*order).limit(n)
            .select("l_orderkey", "l_linenumber", "l_suppkey", "item_name", F.col("movement_type").alias("type"),
                    money("quantity").alias("quantity"), "unit",
                    F.coalesce(blank_to_null("notes"), F.lit("")).alias("notes"),
                    F.coalesce(ymd("created_at"), F.lit("")).alias("date"),
                    F.coalesce(blank_to_null("created_by"), F.lit("system")).alias("by")))


# ----------------------------------------------------------------------------- A20
def purchase_totals(finance: DataFrame, items: DataFrame) -> DataFrame:
    exp = expense()
    low = items.where(F.col("current_stock") <= F.col("minimum_stock")).agg(F.count(F.lit(1))).scalar()
    p = finance.where(F.col("category").isin(*PURCHASE_CATEGORIES) & (exp > 0))
    return p.agg(F.count(F.lit(1)).alias("total_purchases"),
                 money(F.round(F.coalesce(F.sum(exp), F.lit(0).cast("decimal(12,2)")), 0)).alias("total_invested")
                 ).select("total_purchases", "total_invested", low.alias("low_stock_alerts"))


# ----------------------------------------------------------------------------- A21
def low_stock_top(items: DataFrame, n: int = 5) -> DataFrame:
    return (items.where(F.col("current_stock") <= F.col("minimum_stock"))
            .orderBy("current_stock", "name", "id").limit(n)
            .select("id", "name", money("current_stock").alias("current_stock"),
                    money("minimum_stock").alias("minimum_stock")))


# ----------------------------------------------------------------------------- A22
def _egp(c) -> F.Column:
    return F.format_number(c, 0)


def _joined_line(top: DataFrame, sort_cols: list[str], piece: F.Column, line_no: int, prefix: str) -> DataFrame:
    """One text line from a top-k frame (k rows at most, so the collect is bounded)."""
    rows = top.select(F.struct(*[F.col(c) for c in sort_cols], piece.alias("piece")).alias("r"))
    agg = rows.agg(F.sort_array(F.collect_list("r")).alias("rs"))
    return agg.where(F.size("rs") > 0).select(
        F.lit(line_no).alias("line_no"),
        F.concat(F.lit(prefix), F.array_join(F.transform("rs", lambda r: r["piece"]), ", ")).alias("text"))


def business_context(students: DataFrame, finance: DataFrame, items: DataFrame, as_of) -> DataFrame:
    """The text context lines of the chat assistant, one row per line."""
    # lines 1 and 4 come from one aggregation of the students (one scan), emitted as two rows
    st = students.agg(F.count(F.lit(1)).alias("n"), count_if(F.col("created_at") >= month_start(as_of)).alias("m"))
    l14 = st.select(F.inline(F.array(
        F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("Total students: "), F.col("n").cast("string")).alias("text")),
        F.struct(F.lit(4).alias("line_no"),
                 F.concat(F.lit("New students this month: "), F.col("m").cast("string")).alias("text")))))
    # lines 2 and 5 come from one pass over finance: sums by category, of which there are few
    zero = F.lit(0).cast("decimal(12,2)")
    by_cat = finance.groupBy("category").agg(
        F.sum(income()).alias("i"), F.sum(expense()).alias("e"),
        F.sum(F.when(income() > 0, income())).alias("positive"))
    first = F.struct((-money("positive")).alias("nt"), F.col("category"), money("positive").alias("total"))
    fin = by_cat.agg(F.coalesce(F.sum("i"), zero).alias("i"), F.coalesce(F.sum("e"), zero).alias("e"),
                     F.collect_list(F.when(F.col("positive").isNotNull(), first)).alias("cats"))
    l2_text = F.concat(F.lit("Total revenue: EGP "), _egp(F.col("i")), F.lit(", Total expenses: EGP "), _egp(F.col("e")),
                       F.lit(", Net profit: EGP "), _egp(F.col("i") - F.col("e")))
    top = F.slice(F.sort_array("cats"), 1, 5)
    l5_text = F.concat(F.lit("Revenue by category: "), F.array_join(F.transform(top, lambda x: F.concat(
        F.coalesce(x["category"], F.lit("None")), F.lit(": EGP "), _egp(x["total"]))), ", "))
    line = lambda n, text: F.struct(F.lit(n).alias("line_no"), text.alias("text"))
    l25 = fin.select(F.inline(F.filter(F.array(line(2, l2_text), F.when(F.size("cats") > 0, line(5, l5_text))),
                                       lambda x: x.isNotNull())))
    low = (items.where(F.col("current_stock") <= F.col("minimum_stock"))
           .orderBy("current_stock", "name", "id").limit(5))
    low_piece = F.concat(F.coalesce(F.col("name"), F.lit("None")), F.lit(" ("), F.col("current_stock").cast("string"),
                         F.lit(" left, min "), F.col("minimum_stock").cast("string"), F.lit(")"))
    l3 = _joined_line(low.select("current_stock", "name", "id", low_piece.alias("p")),
                      ["current_stock", "name", "id"], F.col("p"), 3, "Low stock items: ")
    return l14.unionByName(l25).unionByName(l3)


# ----------------------------------------------------------------------------- A23
def snapshot_30d(registrations: DataFrame, students: DataFrame, as_of, days: int = 30) -> DataFrame:
    start = ts_minus(as_date(as_of), f"'{days}' DAY")      # current_date - interval: midnight boundary
    recent = registrations.where((F.col("registration_date") >= start) & (F.col("status") == "CONFIRMED"))
    new = students.where(F.col("created_at") >= start).agg(F.count(F.lit(1))).scalar()
    rev = recent.agg(round_long(F.coalesce(F.sum("amount_paid"), F.lit(0).cast("decimal(12,2)"))).alias("revenue_30d"))
    return rev.select("revenue_30d", new.alias("new_students_30d")).select(
        "*", F.concat(F.lit("Database Snapshot: 30-day Revenue EGP "), F.format_number("revenue_30d", 0),
                      F.lit(", 30-day New Students "), F.col("new_students_30d").cast("string")).alias("snapshot_text"))


# ----------------------------------------------------------------------------- A26
# Tables the recent-rows report may read.
RECENT_ROWS_ALLOWED = ("ai_memory_sandbox", "ai_memory_production", "ai_cinematic_library", "concierge_conversations")


def recent_rows(tables: dict, table_name: str, limit: int = 10) -> DataFrame:
    """Newest rows of an allow-listed table (id, content, metadata, created_at)."""
    if table_name not in RECENT_ROWS_ALLOWED or table_name not in tables:
        raise ValueError(f"Invalid table name. Must be one of: {list(RECENT_ROWS_ALLOWED)}")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be in 1..100")
    df = tables[table_name]
    return df.orderBy(newest_first("created_at"), "id").limit(limit).select("id", "content", "metadata", "created_at")


# ----------------------------------------------------------------------------- A24
PAIR_COLUMNS = ("id", "customer_wa_id", "customer_name", "customer_message", "ai_proposed_response",
                "human_reply", "quality_rating", "capture_source", "created_at", "human_replied_at")


def training_pairs(shadow: DataFrame, only_complete: bool = True, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be in 1..200")
    df = shadow
    if "customer_name" not in df.columns:
        df = df.withColumn("customer_name", F.lit(None).cast("string"))
    if only_complete:
        df = df.where(F.col("ai_proposed_response").isNotNull() & F.col("human_reply").isNotNull())
    return df.orderBy(newest_first("created_at"), "id").limit(limit).select(*PAIR_COLUMNS)


# ----------------------------------------------------------------------------- A25
def training_pair_stats(shadow: DataFrame) -> DataFrame:
    q = F.col("quality_rating")
    return shadow.agg(
        count_if(F.col("ai_proposed_response").isNotNull() & F.col("human_reply").isNotNull())
        .alias("complete_pairs"),
        count_if(q == "better").alias("ai_better"), count_if(q == "similar").alias("ai_similar"),
        count_if(q == "worse").alias("ai_worse"), F.count(F.lit(1)).alias("total"))

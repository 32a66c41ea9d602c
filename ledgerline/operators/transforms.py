"""JSON and text transforms: per-record scripts of the source workflows
re-expressed as column expressions (``from_json``, variant access, regex,
``when`` chains), so they run inside whole-stage codegen with no Python.

Script truthiness is reproduced where the scripts rely on it: ``a || b`` on a
string falls through on '' as well as on a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.core import blank_to_null, spread, ts_ntz

# ----------------------------------------------------------------------------- helpers
NUMERIC_VARIANT = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def _vget(v: Column, path: str, t: str = "variant") -> Column:
    return F.try_variant_get(v, path, t)


def _vkind(v: Column) -> Column:
    """Type name of a variant value: STRING, BIGINT, DECIMAL(p,s), OBJECT<..>, ARRAY<..>, BOOLEAN, VOID."""
    return F.schema_of_variant(v)


def _is_number(kind: Column) -> Column:
    return kind.isin(*NUMERIC_VARIANT) | kind.startswith("DECIMAL")


def _truthy_str(c: Column) -> Column:
    """String value that JS truthiness keeps (NULL for missing or '')."""
    return blank_to_null(c)


def js_parse_float(s: Column) -> Column:
    """``parseFloat`` of a string: longest leading decimal number, NULL (NaN) if none."""
    lead = F.regexp_extract(s, r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1)
    return F.when(lead == "", F.lit(None).cast("double")).otherwise(lead.try_cast("double"))


# ----------------------------------------------------------------------------- T37
SERVICE_SCHEMA = ("id string, type string, name string, info struct<name: string>, status string, "
                  "category struct<name: string>, "
                  "schedule struct<availabilityConstraints: struct<sessionDurations: array<int>>>")


def parse_services(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Service JSON -> cache row. Defaults as in the sync script."""
    s = F.from_json(payload_col, SERVICE_SCHEMA)
    first_duration = F.get(s["schedule"]["availabilityConstraints"]["sessionDurations"], 0)
    keep = [c for c in payloads.columns if c != payload_col]
    return spread(payloads).select(
        *keep,
        F.coalesce(_truthy_str(s["id"]), F.lit("")).alias("wix_id"),
        F.coalesce(_truthy_str(s["type"]), F.lit("BOOKING_SERVICE")).alias("service_type"),
        F.coalesce(_truthy_str(s["name"]), _truthy_str(s["info"]["name"]), F.lit("Unknown Service")).alias("title"),
        F.lit(0.0).alias("price"),
        F.coalesce(_truthy_str(s["status"]), F.lit("ACTIVE")).alias("status"),
        _truthy_str(s["category"]["name"]).alias("category"),
        F.nullif(first_duration, F.lit(0)).alias("duration"))


# ----------------------------------------------------------------------------- T38
def _amount_paid(tp: Column) -> Column:
    """Price of a booking from ``priceInfo.totalPrice`` (a variant), following the
    script's shapes: an object with ``value`` (string -> strip to digits and dots ->
    parseFloat; number -> as is); anything else -> 0.0 (a bare string or number
    makes the script's ``'value' in x`` throw, and the catch sets 0.0)."""
    val = _vget(tp, "$.value")
    vk = _vkind(val)
    clean = F.regexp_replace(_vget(val, "$", "string"), r"[^0-9.]", "")
    from_string = F.when(clean == "", F.lit(0.0)).otherwise(js_parse_float(clean))
    from_number = F.coalesce(F.nullif(_vget(val, "$", "double"), F.lit(0.0)), F.lit(0.0))
    return (F.when(_vkind(tp).startswith("OBJECT") & val.isNotNull(),
                   F.when(vk == "STRING", from_string).when(_is_number(vk), from_number).otherwise(F.lit(0.0)))
            .otherwise(F.lit(0.0)))


def _js_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# One streaming JSON parse per booking; only the price keeps its JSON type (variant)
# because the script branches on whether it is an object, a string or a number.
BOOKING_SCHEMA = ("id string, contactId string, contactDetails struct<contactId: string, email: string, "
                  "firstName: string, lastName: string, phone: string>, "
                  "bookedEntity struct<slot: struct<serviceId: string>>, priceInfo struct<totalPrice: variant>, "
                  "createdDate string, status string")


def parse_bookings(payloads: DataFrame, as_of, payload_col: str = "payload",
                   drop_unidentified: bool = True) -> DataFrame:
    """Booking JSON -> registration row; rows with neither contact id nor email are dropped
    (``drop_unidentified=False`` keeps them with an empty ``wix_contact_id``, for counting).
    ``as_of`` stands in for "now" when ``createdDate`` is missing."""
    keep = [c for c in payloads.columns if c != payload_col]
    j = spread(payloads).select(*keep, F.from_json(payload_col, BOOKING_SCHEMA).alias("_j"))
    b, d = F.col("_j"), F.col("_j.contactDetails")
    contact = F.coalesce(_truthy_str(b["contactId"]), _truthy_str(d["contactId"]), F.lit(""))
    email = F.lower(_js_trim(F.coalesce(_truthy_str(d["email"]), F.lit(""))))
    name = _js_trim(F.concat(F.coalesce(_truthy_str(d["firstName"]), F.lit("")), F.lit(" "),
                             F.coalesce(_truthy_str(d["lastName"]), F.lit(""))))
    out = j.select(
        *keep,
        F.coalesce(_truthy_str(b["id"]), F.lit("")).alias("wix_booking_id"),
        F.coalesce(_truthy_str(contact), email).alias("wix_contact_id"),
        F.coalesce(_truthy_str(name), F.lit("Guest")).alias("full_name"),
        email.alias("email"),
        F.coalesce(_truthy_str(d["phone"]), F.lit("")).alias("phone"),
        F.coalesce(_truthy_str(b["bookedEntity"]["slot"]["serviceId"]), F.lit("")).alias("wix_service_id"),
        F.coalesce(_truthy_str(b["createdDate"]),
                   F.date_format(ts_ntz(as_of), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("registration_date"),
        _amount_paid(b["priceInfo"]["totalPrice"]).alias("amount_paid"),
        F.coalesce(_truthy_str(b["status"]), F.lit("CONFIRMED")).alias("status"))
    if not drop_unidentified:
        return out
    return keep_where(out, lambda r: r["wix_contact_id"] != "")


def keep_where(df: DataFrame, pred) -> DataFrame:
    """Rows of ``df`` where ``pred(row_struct)`` is true, as a 0/1-row generator.
    Catalyst pushes a Filter below a repartition, which would evaluate a
    parse-heavy condition before ``spread`` fans the rows out; a generator is
    not moved, so the parse stays on the wide side of the exchange."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.filter(F.array(row), lambda r: F.coalesce(pred(r), F.lit(False)))))


# ----------------------------------------------------------------------------- T39
def sync_result(services: DataFrame, bookings: DataFrame) -> DataFrame:
    """Answer of the cache write, one row: the numbers written, or an error (and no numbers) if a service has no
    key, since one such row rolls the whole write back. A blank key counts as missing."""
    svc = services.agg(F.count(F.lit(1)).alias("n"), F.count(blank_to_null("wix_id")).alias("keyed"))
    n = bookings.agg(F.count(F.lit(1))).scalar()
    ok = F.col("n") == F.col("keyed")
    return svc.select(F.when(ok, "ok").otherwise("error").alias("status"),
                      F.when(ok, F.col("n")).alias("services_synced"), F.when(ok, n).alias("bookings_synced"),
                      F.when(~ok, F.lit("service without id")).alias("error"))


def _booking_counts(bookings_all: DataFrame) -> Column:
    return bookings_all.agg(F.struct(F.count(F.lit(1)).alias("fetched"),
                                     F.count(F.when(F.col("wix_contact_id") != "", 1)).alias("sent"))).scalar()


def _summary(result: DataFrame, services: Column, bookings: Column, synced_at, paging_total: DataFrame | None) -> DataFrame:
    total = F.nullif(paging_total.agg(F.max("total")).scalar(), F.lit(0)) if paging_total is not None else F.lit(None)
    done = (F.col("status") == "ok") | F.col("services_synced").isNotNull()
    return result.select(
        F.when(done, "SUCCESS").otherwise("PARTIAL").alias("status"), ts_ntz(synced_at).alias("synced_at"),
        F.coalesce("services_synced", services).alias("services_synced"),
        F.coalesce("bookings_synced", bookings["sent"]).alias("bookings_synced"),
        bookings["fetched"].alias("bookings_fetched"),
        F.coalesce(total.cast("long"), bookings["fetched"]).alias("bookings_total_in_wix"), "error")


def sync_summary(services: DataFrame, bookings_all: DataFrame, result: DataFrame, synced_at,
                 paging_total: DataFrame | None = None) -> DataFrame:
    """One summary row of a sync run from the parsed services, *all* parsed bookings
    (``parse_bookings(..., drop_unidentified=False)``) and the answer of the write (``sync_result``): the numbers
    written, or else the numbers sent. ``paging_total`` (one row ``total``) is the source's own count of bookings;
    without it, or if it is 0 or NULL, the fetched ones count."""
    return _summary(result, services.agg(F.count(F.lit(1))).scalar(), _booking_counts(bookings_all), synced_at, paging_total)


def sync_run(services: DataFrame, bookings_all: DataFrame, synced_at, paging_total: DataFrame | None = None) -> DataFrame:
    """``sync_summary`` of a run whose write sends every service and each booking with a contact (``sync_result`` of
    these): both come from one aggregate a table, so that each feed is parsed once."""
    svc = services.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(blank_to_null("wix_id")).alias("keyed"))).scalar()
    b = _booking_counts(bookings_all)
    ok = svc["n"] == svc["keyed"]
    result = services.sparkSession.range(1).select(
        F.when(ok, "ok").otherwise("error").alias("status"), F.when(ok, svc["n"]).alias("services_synced"),
        F.when(ok, b["sent"]).alias("bookings_synced"), F.when(~ok, F.lit("service without id")).alias("error"))
    return _summary(result, svc["n"], b, synced_at, paging_total)


# ----------------------------------------------------------------------------- T40
GA4_SCHEMA = "date string, metricValues array<struct<value: string>>"


def ga4_metrics(payloads: DataFrame, payload_col: str = "payload", platform: str = "ga4") -> DataFrame:
    """Daily analytics row -> two long-format metric rows, only when two values exist."""
    j = payloads.select(F.from_json(payload_col, GA4_SCHEMA).alias("j")).where(F.size("j.metricValues") >= 2)
    log_date = F.to_date(F.try_to_timestamp("j.date", F.lit("yyyyMMdd")))        # NULL if it is no date
    pairs = F.array(
        F.struct(F.lit("activeUsers").alias("metric_name"), F.col("j.metricValues")[0]["value"].alias("v")),
        F.struct(F.lit("sessions").alias("metric_name"), F.col("j.metricValues")[1]["value"].alias("v")))
    return (j.select(log_date.alias("log_date"), F.lit(platform).alias("platform"), F.inline(pairs))
            .select("log_date", "platform", "metric_name", js_parse_float(F.col("v")).alias("metric_value")))


# ----------------------------------------------------------------------------- T41
# Request phrases of the data-rights handler, checked in this order.
DELETE_PHRASES = ("delete my data", "احذف بياناتي", "delete data", "remove my data", "امسح بياناتي", "حذف البيانات")
ACCESS_PHRASES = ("show my data", "my data", "بياناتي", "show data", "what data", "ما بياناتي", "اظهر بياناتي")
OPTOUT_PHRASES = ("stop", "unsubscribe", "opt out", "لا اريد", "ايقاف", "الغاء")


def _contains_any(c: Column, phrases) -> Column:
    cond = F.lit(False)
    for p in phrases:
        cond = cond | c.contains(p)
    return cond


WEBHOOK_SCHEMA = ("entry array<struct<changes: array<struct<value: struct<"
                  "messages: array<struct<from: string, text: struct<body: string>>>, "
                  "contacts: array<struct<wa_id: string>>>>>>>")


def rights_intent(messages: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Webhook message -> (phone, message_text, intent). Substring match; first list wins."""
    keep = [c for c in messages.columns if c != payload_col]
    j = spread(messages).select(*keep, F.from_json(payload_col, WEBHOOK_SCHEMA).alias("_j"))
    value = F.get(F.get(F.col("_j.entry"), 0)["changes"], 0)["value"]
    msg = F.get(value["messages"], 0)
    phone = F.coalesce(_truthy_str(msg["from"]), _truthy_str(F.get(value["contacts"], 0)["wa_id"]), F.lit(""))
    text = F.lower(_js_trim(F.coalesce(_truthy_str(msg["text"]["body"]), F.lit(""))))
    out = j.select(*keep, phone.alias("phone"), text.alias("message_text"))
    t = F.col("message_text")
    intent = (F.when(_contains_any(t, DELETE_PHRASES), "DELETE").when(_contains_any(t, ACCESS_PHRASES), "ACCESS")
              .when(_contains_any(t, OPTOUT_PHRASES), "OPTOUT").otherwise("unknown"))
    return out.withColumn("intent", intent)


# ----------------------------------------------------------------------------- T42
# The answer to a requester of whom nothing is stored.
NO_DATA_TEXT = "ℹ️ لا توجد بيانات مخزنة لرقمك.\n\nNo stored data found for your number."


def rights_access_report(intents: DataFrame, conversations: DataFrame, n: int = 20,
                         preview_chars: int = 60) -> DataFrame:
    """Per ACCESS requester: their newest ``n`` messages as numbered lines.

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before the
    shuffle, so a sender with millions of rows ships only ``n`` per partition;
    the collected list per requester is bounded by ``n``.
    """
    req = intents.where(F.col("intent") == "ACCESS").select("phone").distinct()
    conv = conversations.select("id", "sender_id", "created_at", "intent_detected", "original_message")
    j = conv.join(req, conv.sender_id == req.phone, "left_semi")
    from pyspark.sql.window import Window
    w = Window.partitionBy("sender_id").orderBy(F.col("created_at").desc_nulls_first(), "id")
    top = j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    line = F.concat(F.col("rn").cast("string"), F.lit(". ["),
                    F.coalesce(F.substring(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), 1, 10), F.lit("")),
                    F.lit("] "), F.coalesce(blank_to_null("intent_detected"), F.lit("inquiry")), F.lit(": "),
                    F.substring(F.coalesce("original_message", F.lit("")), 1, preview_chars), F.lit("..."))
    per = top.groupBy("sender_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.sort_array(F.collect_list(F.struct("rn", line.alias("line")))).alias("ls"))
    report = per.select(F.col("sender_id").alias("phone"), "message_count",
                        F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("summary"))
    return (req.join(report, "phone", "left")
            .select("phone", F.coalesce("message_count", F.lit(0)).cast("bigint").alias("message_count"),
                    F.coalesce("summary", F.lit(NO_DATA_TEXT)).alias("summary")))


# ----------------------------------------------------------------------------- T44
REWRITE_SCHEMA = "rewritten_query string, is_greeting variant, detected_language string, intent string"


def parse_rewrite(responses: DataFrame, text_col: str = "response_text",
                  language_col: str = "request_language") -> DataFrame:
    """Model reply of the query rewriter -> structured fields with the script's defaults.
    Validity is one ``try_parse_json``; the fields come from one ``from_json``
    (``is_greeting`` stays typed: only a JSON ``true`` counts)."""
    raw = F.coalesce(_truthy_str(_js_trim(F.col(text_col))), F.lit("{}"))
    keep = [c for c in responses.columns if c not in (text_col,)]
    j = spread(responses).select(*keep, F.try_parse_json(raw).isNull().alias("_bad"),
                                 F.from_json(raw, REWRITE_SCHEMA).alias("_j"))
    failed, r = F.col("_bad"), F.col("_j")
    greet = r["is_greeting"]
    return j.select(
        *keep,
        F.when(failed, F.lit("REWRITE_FAILED")).otherwise(
            F.coalesce(_truthy_str(r["rewritten_query"]), F.lit("REWRITE_FAILED"))).alias("rewritten_query"),
        F.coalesce(~failed & (_vkind(greet) == "BOOLEAN") & _vget(greet, "$", "boolean"), F.lit(False))
        .alias("is_greeting"),
        F.when(failed, F.lit("unknown")).otherwise(
            F.coalesce(_truthy_str(r["detected_language"]), _truthy_str(F.col(language_col)), F.lit("auto")))
        .alias("detected_language"),
        F.when(failed, F.lit("general")).otherwise(F.coalesce(_truthy_str(r["intent"]), F.lit("general")))
        .alias("intent"))


# ----------------------------------------------------------------------------- T45
def resolve_tiers(responses: DataFrame, primary_label: str = "primary", fallback_label: str = "fallback",
                  unavailable_text: str = "AI services are temporarily unavailable. Please try again shortly.",
                  primary_col: str = "primary_text", fallback_col: str = "fallback_text") -> DataFrame:
    """Primary answer, else fallback answer, else a fixed apology (levels 0 / 1 / 2).

    Inputs are one row per request with each tier's answer (NULL = that call
    failed), e.g. the left joins of per-tier response tables on request id.
    """
    p, f = F.col(primary_col), F.col(fallback_col)
    level = F.when(p.isNotNull(), 0).when(f.isNotNull(), 1).otherwise(2)
    keep = [c for c in responses.columns if c not in (primary_col, fallback_col)]
    return responses.select(
        *keep,
        F.when(p.isNotNull(), primary_label).when(f.isNotNull(), fallback_label).otherwise("graceful_error")
        .alias("source"),
        F.coalesce(p, f, F.lit(unavailable_text)).alias("response"),
        (level > 0).alias("fallback_used"), level.alias("fallback_level"))


# ----------------------------------------------------------------------------- T46
# Name of the record stored when no technique could be extracted.
TECHNIQUE_FALLBACK_NAME = "Unknown (extraction pending)"


def _technique_variant(text: Column) -> Column:
    """First '{' to last '}' of the reply, parsed; NULL when absent or malformed."""
    m = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    return F.when(m == "", F.lit(None)).otherwise(F.try_parse_json(m))


def _str_list(v: Column, path: str) -> Column:
    return F.coalesce(_vget(v, path, "array<string>"), F.array().cast("array<string>"))


def extract_technique(responses: DataFrame, artisan_name: str | None = None, description_chars: int = 500,
                      text_col: str = "response_text", raw_col: str = "raw_text") -> DataFrame:
    """Model extraction reply -> technique record; a fallback record when no JSON object parses.
    The fallback description is the first ``description_chars`` characters of the submission,
    as the source service stores it."""
    v = _technique_variant(F.col(text_col))
    ok = v.isNotNull()
    sub_artisan = F.lit(artisan_name).cast("string")
    keep = [c for c in responses.columns if c not in (text_col,)]
    return spread(responses).select(
        *keep, ok.alias("extracted"),
        F.when(ok, F.when(_vget(v, "$.technique_name").isNull(), F.lit("Unknown"))
               .otherwise(_vget(v, "$.technique_name", "string")))
        .otherwise(F.lit(TECHNIQUE_FALLBACK_NAME)).alias("technique_name"),
        F.when(ok, _vget(v, "$.artisan_name", "string")).otherwise(sub_artisan).alias("artisan_name"),
        F.when(ok, _vget(v, "$.region", "string")).alias("region"),
        F.when(ok, _vget(v, "$.category", "string")).otherwise(F.lit("other")).alias("category"),
        F.when(ok, _str_list(v, "$.materials")).otherwise(F.array().cast("array<string>")).alias("materials"),
        F.when(ok, _str_list(v, "$.tools")).otherwise(F.array().cast("array<string>")).alias("tools"),
        F.when(ok, _vget(v, "$.description", "string"))
        .otherwise(F.substring(F.col(raw_col), 1, description_chars)).alias("description"),
        F.when(ok, _vget(v, "$.risk_level", "string")).otherwise(F.lit("unknown")).alias("risk_level"),
        F.when(ok, F.regexp_extract(F.col(text_col), r"\{[\s\S]*\}", 0)).alias("extracted_json"))


# ----------------------------------------------------------------------------- T47
# Allowed categories and risk levels of the technique archive.
TECHNIQUE_CATEGORIES = ("carving", "woodturning", "joinery", "inlay", "marquetry", "finishing", "other")
RISK_LEVELS = ("critical", "rare", "common")


def normalize_technique(techniques: DataFrame, submitter: str | None = None) -> DataFrame:
    """Risk = first word, lower case, if allowed; category lower/trimmed if allowed; artisan
    falls back to the submitter when empty."""
    risk_word = F.get(F.split(F.trim(F.lower(F.col("risk_level"))), r"\s+"), 0)
    risk = F.when(_truthy_str(F.col("risk_level")).isNull(), "unknown").when(
        risk_word.isin(*RISK_LEVELS), risk_word).otherwise("unknown")
    cat_raw = F.trim(F.lower(F.coalesce(F.col("category"), F.lit("None"))))
    cat = F.when(cat_raw.isin(*TECHNIQUE_CATEGORIES), cat_raw).otherwise("other")
    return (techniques.withColumn("risk_level", risk).withColumn("category", cat)
            .withColumn("artisan_name", F.coalesce(_truthy_str(F.col("artisan_name")),
                                                   F.lit(submitter).cast("string"))))


# ----------------------------------------------------------------------------- T48
def _embed_piece(v: Column, key: str, fallback: Column) -> Column:
    """Python ``str(d.get(key, ''))``: absent key -> '', JSON null -> 'None'."""
    x = _vget(v, f"$.{key}")
    present = F.when(x.isNull(), F.lit("")).when(F.is_variant_null(x), F.lit("None")).otherwise(
        F.coalesce(_vget(x, "$", "string"), F.lit("")))
    return F.when(v.isNotNull(), present).otherwise(fallback)


def embedding_text(techniques: DataFrame) -> DataFrame:
    """Text sent to the embedding model: name, description, category, region."""
    v = F.try_parse_json(F.col("extracted_json"))
    parts = [_embed_piece(v, "technique_name", F.col("technique_name")),
             _embed_piece(v, "description", F.coalesce(F.col("description"), F.lit("None"))),
             _embed_piece(v, "category", F.col("category")),
             _embed_piece(v, "region", F.coalesce(F.col("region"), F.lit("None")))]
    text = F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2], F.lit(" "), parts[3])
    return techniques.withColumn("embed_text", F.regexp_replace(text, r"^\s+|\s+$", ""))


# ----------------------------------------------------------------------------- T49
def technique_facets(techniques: DataFrame) -> DataFrame:
    """Counts per normalised category, risk level and material, in one scan and one shuffle."""
    facets = F.concat(
        F.array(F.struct(F.lit("category").alias("facet"), F.col("category").alias("value")),
                F.struct(F.lit("risk_level").alias("facet"), F.col("risk_level").alias("value"))),
        F.transform(F.coalesce("materials", F.array().cast("array<string>")),
                    lambda m: F.struct(F.lit("material").alias("facet"), m.alias("value"))))
    return (techniques.select(F.explode(facets).alias("f")).select("f.facet", "f.value")
            .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")))

"""Strings, JSON and logs (X2 to X20, P18, J16, E40), and extensions that the engine adds (ext_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.registry import Tables, query

LABELS = {("view", "de"): "Ansicht", ("view", "fr"): "vue", ("click", "de"): "Klick", ("error", "fr"): "erreur"}
_LABEL_ROWS = ", ".join(f"('{k}', '{lang}', '{v}')" for (k, lang), v in LABELS.items())


@query("x2_utf16", "SELECT c_custkey, lower(hex(encode(c_name))) AS utf8, length(c_name) AS n FROM customer")
def x2(t: Tables) -> DataFrame:
    """Through UTF-16 and back."""
    there = F.encode("c_name", "UTF-16BE")
    return t["customer"].select("c_custkey", F.lower(F.hex(F.encode(F.decode(there, "UTF-16BE"), "UTF-8"))).alias("utf8"), F.expr("CAST(octet_length(encode(c_name, 'UTF-16BE')) div 2 AS BIGINT)").alias("n"))


@query("x3_byte_pattern", "SELECT page_id, strpos(html, '<nav>') AS at FROM pages")
def x3(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", F.locate("<nav>", "html").cast("bigint").alias("at"))


@query("x4_rescale", "SELECT o_orderkey, (o_orderkey * 7919 % 65536 * 255 + 32767) // 65535 AS v FROM orders")
def x4(t: Tables) -> DataFrame:
    """16 bits to 8, rounded."""
    return t["orders"].selectExpr("o_orderkey", "(o_orderkey * 7919 % 65536 * 255 + 32767) div 65535 AS v")


@query("x6_enabled_spans", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS n, CAST(list_count(embedding) AS BIGINT) AS spans FROM embeddings")
def x6(t: Tables) -> DataFrame:
    return t["embeddings"].select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("n"), F.size("embedding").cast("bigint").alias("spans"))


_LINE = r"^(https?)://([^/:]+)/([^/?#]*)/([0-9]+)(.*)$"


@query("x7_support_lines", "SELECT page_id, " + ", ".join(f"regexp_extract(url, '{_LINE}', {k}) AS g{k}" for k in range(1, 6)) + " FROM pages")
def x7(t: Tables) -> DataFrame:
    """Five groups out of a line."""
    return t["pages"].select("page_id", *(F.regexp_extract("url", _LINE, k).alias(f"g{k}") for k in range(1, 6)))


@query("x8_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_type\":\"' || event_type || '\",\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS compact FROM events")
def x8(t: Tables) -> DataFrame:
    """JSON in, and out again with sorted keys."""
    parsed = t["events"].withColumn("p", F.from_json("props", "k BIGINT"))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct("event_type", F.col("p.k").alias("k"))).alias("compact"))


@query("x17_font_names", "SELECT p_partkey, regexp_replace(lower(p_name), '[ -]', '', 'g') AS norm, regexp_replace(p_name, ' [a-z]+$', '') AS family FROM part")
def x17(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", F.regexp_replace(F.lower("p_name"), "[ -]", "").alias("norm"), F.regexp_replace("p_name", " [a-z]+$", "").alias("family"))


@query("x18_location_label", "SELECT o_orderkey, concat_ws('/', o_orderpriority, o_orderstatus, 'order-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) AS label FROM orders")
def x18(t: Tables) -> DataFrame:
    return t["orders"].select("o_orderkey", F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.format_string("order-%08d", "o_orderkey")).alias("label"))


@query("x20_label_fallback", f"WITH labels_(event_type, lang, label) AS (VALUES {_LABEL_ROWS}), e AS (SELECT event_id, event_type, CASE user_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'en' END AS lang FROM events) SELECT event_id, coalesce(label, e.event_type) AS label FROM e LEFT JOIN labels_ l ON e.event_type = l.event_type AND e.lang = l.lang")
def x20(t: Tables) -> DataFrame:
    """Labels by language, the key itself where one is missing."""
    table = t.spark.createDataFrame([(k, lang, v) for (k, lang), v in LABELS.items()], "event_type string, lang string, label string")
    lang = F.when(F.col("user_id") % 3 == 0, "de").when(F.col("user_id") % 3 == 1, "fr").otherwise("en")
    return t["events"].withColumn("lang", lang).join(F.broadcast(table), ["event_type", "lang"], "left").select("event_id", F.coalesce("label", "event_type").alias("label"))


@query("p18_freshness", "SELECT a.event_id, CASE WHEN b.event_id IS NULL THEN 'Missing' WHEN abs(a.value - b.value) > 1e-6 THEN 'Modified' WHEN a.props <> b.props THEN 'Content' ELSE 'Fresh' END AS state FROM events a LEFT JOIN (SELECT event_id + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS event_id, value, props FROM events WHERE event_type <> 'error') b ON a.event_id = b.event_id")
def p18(t: Tables) -> DataFrame:
    """What changed since a listing: time, then content."""
    e = t["events"]
    seen = e.filter("event_type <> 'error'").selectExpr("event_id + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS event_id", "value AS was", "props AS props_was")
    state = F.when(F.col("was").isNull(), "Missing").when(F.abs(F.col("value") - F.col("was")) > 1e-6, "Modified").when(F.col("props") != F.col("props_was"), "Content").otherwise("Fresh")
    return e.join(seen, "event_id", "left").select("event_id", state.alias("state"))


@query("j16_benchmark_rows", "SELECT a.event_id, a.value AS a, b.value AS b, b.event_id IS NULL AS missing FROM events a LEFT JOIN events b ON b.event_id = a.event_id * 2 AND b.event_type = 'view'")
def j16(t: Tables) -> DataFrame:
    """Two runs by request; rows that the other lacks are told."""
    e = t["events"]
    other = e.filter("event_type = 'view'").select((F.col("event_id") / 2).alias("half"), F.col("value").alias("b"))
    return e.join(other, F.col("event_id") == F.col("half"), "left").select("event_id", F.col("value").alias("a"), "b", F.col("half").isNull().alias("missing"))


@query("e40_trace_census", "SELECT json_extract_string(props, '$.k')[1:1] AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def e40(t: Tables) -> DataFrame:
    return t["events"].groupBy(F.get_json_object("props", "$.k").substr(1, 1).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(t: Tables) -> DataFrame:
    return t["orders"].cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("ext_asof_join", "SELECT e.event_id, arg_max(p.event_id, [p.event_id]) AS purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) <= (e.ts, e.event_id) GROUP BY e.event_id")
def ext_asof(t: Tables) -> DataFrame:
    """Extension: the last purchase of the same user so far, by one window instead of a range join."""
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t["events"].select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(so_far).alias("purchase"))


@query("ext_session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id")
def ext_sessions(t: Tables) -> DataFrame:
    s = t["events"].groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("ext_tumbling_windows", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(t: Tables) -> DataFrame:
    w = t["events"].groupBy("event_type", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.unix_timestamp("window.start").alias("day"), "n", "total")


@query("x19_elapsed", "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since_last, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS since_first FROM events")
def x19(t: Tables) -> DataFrame:
    """Microseconds since a session's last event and since its first."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    session = Window.partitionBy("user_id")
    return t["events"].select("event_id", (at - F.lag(at).over(session.orderBy("ts", "event_id"))).alias("since_last"), (at - F.min(at).over(session)).alias("since_first"))


@query("x19_stale_outputs", "SELECT user_id, max(epoch_us(ts)) FILTER (event_type = 'click') IS NOT NULL AND coalesce(max(epoch_us(ts)) FILTER (event_type = 'click') > max(epoch_us(ts)) FILTER (event_type = 'purchase'), true) AS stale FROM events GROUP BY user_id")
def x19_stale(t: Tables) -> DataFrame:
    """An output is stale if its source was touched after it, or if it was never made."""
    newest = t["events"].groupBy("user_id").agg(*(F.max(F.when(F.col("event_type") == kind, F.col("ts"))).alias(kind) for kind in ("click", "purchase")))
    return newest.select("user_id", (F.col("click").isNotNull() & F.coalesce(F.col("click") > F.col("purchase"), F.lit(True))).alias("stale"))

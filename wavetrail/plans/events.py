"""Event log: scans, predicates, projections, grouping, ordering, ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetrail import reference_data as ref
from wavetrail.functions import scalars as S
from wavetrail.operators import filters as P
from wavetrail.operators.query import Aggregation, EventQuery, facets, grouped_measures, multi_facets, newest, time_range
from wavetrail.plans.registry import query
from wavetrail.sources import sinks
from wavetrail.sources.bindings import AS_OF_NS, EPOCH_S

DAY_NS = 86400 * 10**9
HEAD = ["id", "timestamp_ns", "event_type", "severity", "freq_mhz", "talkgroup", "band"]
HEAD_SQL = ", ".join(HEAD)

# --- scans -----------------------------------------------------------------

FULL = ["id", "timestamp_ns", "ts_bucket", "event_type", "severity", "source", "body", "freq_mhz", "talkgroup",
        "source_unit", "nac", "encrypted", "band", "device_key", "classification", "attributes"]


@query("src01_event_scan", f"SELECT {', '.join(FULL)} FROM ev")
def _(v):
    return v.ev.select(*FULL)


@query("src02_event_by_id", f"SELECT {', '.join(FULL)} FROM ev WHERE id = 477")
def _(v):
    return v.ev.where(F.col("id") == 477).select(*FULL)


# --- predicates ------------------------------------------------------------

PREDICATES = {
    "flt01_eq": (P.Eq("type", "protocol.p25.grant"), "event_type = 'protocol.p25.grant'"),
    "flt02_ne": (P.Ne("cls", "COMM"), "classification <> 'COMM'"),
    "flt03_gt": (P.Gt("severity", 5), "severity > 5"),
    "flt04_gte": (P.Gte("freq", 150.25), "freq_mhz >= 150.25e0"),
    "flt05_lt": (P.Lt("tg", 1010), "talkgroup < 1010"),
    "flt06_lte": (P.Lte("k", 10), "k <= 10"),
    "flt07_in": (P.In("band", ["VHF", "P25"]), "band IN ('VHF', 'P25')"),
    "flt08_not_in": (P.NotIn("cls", ["COMM", "FEDL"]), "classification NOT IN ('COMM', 'FEDL')"),
    "flt09_contains": (P.Contains("body", "CLICK UID 1"), "body ILIKE '%CLICK UID 1%'"),
    "flt10_not_contains": (P.NotContains("cls", "om"), "classification NOT ILIKE '%om%'"),
    "flt11_like": (P.Like("type", "Protocol.P25.%"), "event_type ILIKE 'Protocol.P25.%'"),
    "flt12_regex": (P.Regex("body", "uid [0-9]*7$"), "regexp_matches(body, 'uid [0-9]*7$')"),
    "flt13_exists": (P.Exists("nac"), "nac IS NOT NULL"),
    "flt14_not_exists": (P.NotExists("cls"), "classification IS NULL"),
    "flt15_not": (P.Not(P.Eq("enc", True)), "NOT (encrypted = TRUE)"),
    "flt16_and": (P.And(P.Eq("enc", True), P.Eq("band", "UHF")), "encrypted AND band = 'UHF'"),
    "flt17_or": (P.Or(P.Eq("uid", 3), P.Gt("severity", 10)), "source_unit = 3 OR severity > 10"),
    "flt02b_ne_null_passes": (P.Ne("cls", "COMM"), "classification IS NULL OR classification <> 'COMM'"),
}
for _name, (_f, _sql) in PREDICATES.items():
    query(_name, f"SELECT {HEAD_SQL} FROM ev WHERE {_sql}")(
        lambda v, f=_f, n=_name: v.ev.where(P.compile_filter(f, null_passes="null_passes" in n)).select(*HEAD)
    )

RANGE = (AS_OF_NS - 20 * DAY_NS, AS_OF_NS - 12 * DAY_NS)


@query("flt18_time_range", f"SELECT {HEAD_SQL} FROM ev WHERE timestamp_ns BETWEEN {RANGE[0]} AND {RANGE[1]}")
def _(v):
    return time_range(v.ev, *RANGE).select(*HEAD)


@query(
    "flt19_optional_filters",
    "SELECT id, tgid, uid, grant_type FROM gr WHERE system = 'SYS' AND tgid = 1004 AND ts >= TIMESTAMP '2024-01-10'",
)
def _(v):
    since = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    return P.apply_optional(v.gr, system="SYS", tgid=1004, uid=None, ts__ge=since).select("id", "tgid", "uid", "grant_type")


CLIP = ["id", "tgid", "source_unit", "site_id", "freq_mhz", "trigger_type", "encrypted", "file_size_bytes", "start_time"]


@query(
    "flt20_clip_filter",
    f"""SELECT {', '.join(CLIP)} FROM rec WHERE trigger_type ILIKE 'auto_%' AND ROUND(freq_mhz, 3) = ROUND(150.2500e0, 3)
        AND trigger_type = 'auto_p25' AND encrypted
        ORDER BY start_time DESC, id DESC, tgid DESC, file_size_bytes DESC LIMIT 25 OFFSET 10""",
)
def _(v):
    clips = v.rec.where(F.col("trigger_type").ilike("auto_%") & (F.round("freq_mhz", 3) == F.round(F.lit(150.25), 3)))
    clips = P.apply_optional(clips, tgid=None, source_unit=None, site_id=None, trigger_type="auto_p25", encrypted=True)
    order = [F.desc(c) for c in ("start_time", "id", "tgid", "file_size_bytes")]
    return clips.select(*CLIP).orderBy(*order).offset(10).limit(25)


_rep = " OR ".join(f"f BETWEEN {a}e0 AND {b}e0" for a, b in ref.REPEATER_RANGES)
_cell = " OR ".join(f"f BETWEEN {a}e0 AND {b}e0" for a, b in ref.CELLULAR_RANGES)


@query(
    "flt21_band_plan",
    f"SELECT id, f AS shifted_mhz, {_rep} AS repeater, {_cell} AS cellular FROM (SELECT id, ROUND(140 + k*8.5e0, 3) AS f FROM ev)",
)
def _(v):
    f = F.col("shifted_mhz")
    rows = v.ev.select("id", F.round(140 + F.col("k") * 8.5, 3).alias("shifted_mhz"))
    return rows.withColumn("repeater", S.is_repeater(f)).withColumn("cellular", S.is_cellular(f))


_tactical = ", ".join(f"'{t}'" for t in ref.TACTICAL_EVENTS)


@query(
    "flt22_tactical_only",
    f"SELECT {HEAD_SQL} FROM ev WHERE event_type IN ({_tactical}) OR starts_with(event_type, 'custom.')",
)
def _(v):
    return v.ev.where(S.is_tactical(F.col("event_type"))).select(*HEAD)


@query(
    "flt23_wildcard_search",
    f"""SELECT {HEAD_SQL}, (SELECT COUNT(*) FROM ev WHERE event_type ILIKE 'protocol.%' AND band = 'VHF' AND source = 1) AS total
        FROM ev WHERE event_type ILIKE 'protocol.%' AND band = 'VHF' AND source = 1
        ORDER BY timestamp_ns DESC, id DESC LIMIT 100""",
)
def _(v):
    q = EventQuery((search_type("protocol.*"), P.Eq("band", "VHF"), P.Eq("source", 1)), limit=100)
    page = q.rows(v.ev).select(*HEAD)
    # One total beside at most a hundred rows.
    return page.withColumn("_one", F.lit(1)).join(q.count(v.ev).withColumn("_one", F.lit(1)), "_one").drop("_one")


def search_type(text: str) -> P.Filter:
    return P.Like("type", text.replace("*", "%")) if "*" in text else P.Eq("type", text)


# --- projections -----------------------------------------------------------


@query(
    "prj01_field_aliases",
    "SELECT id, talkgroup AS tg, source_unit AS uid, freq_mhz AS freq, json_extract_string(attributes, '$.opcode') AS opcode FROM ev",
)
def _(v):
    return v.ev.select("id", *[P.resolve_field(n)[0].alias(n) for n in ("tg", "uid", "freq", "opcode")])


@query("prj02_attribute", "SELECT id, json_extract_string(attributes, '$.k') AS k_text, CAST(json_extract_string(attributes, '$.k') AS DOUBLE) > 50 AS high FROM ev")
def _(v):
    k = P.attribute("k")
    return v.ev.select("id", k.alias("k_text"), (k.cast("double") > 50).alias("high"))


@query("prj03_bucket_30s", "SELECT id, (timestamp_ns // 30000000000) * 30000000000 AS bucket FROM ev")
def _(v):
    return v.ev.select("id", S.bucket_30s(F.col("timestamp_ns")).alias("bucket"))


@query(
    "prj04_severity_label",
    """SELECT id, s AS code, CASE WHEN s <= 2 THEN 'TRACE' WHEN s <= 6 THEN 'DEBUG' WHEN s <= 10 THEN 'INFO' WHEN s <= 12 THEN 'NOTICE'
        WHEN s <= 16 THEN 'WARN' WHEN s <= 20 THEN 'ERROR' ELSE 'FATAL' END AS label FROM (SELECT id, (severity + k) % 24 AS s FROM ev)""",
)
def _(v):
    rows = v.ev.select("id", ((F.col("severity") + F.col("k")) % 24).alias("code"))
    return rows.withColumn("label", S.severity_label(F.col("code")))


@query(
    "prj05_source_label",
    """SELECT id, s AS code, CASE s WHEN 0 THEN 'SPECTRUM' WHEN 1 THEN 'PROTOCOL' WHEN 2 THEN 'SIGEX' WHEN 3 THEN 'SYSTEM'
        WHEN 4 THEN 'AUDIO' WHEN 5 THEN 'CUSTOM' ELSE 'SYSTEM' END AS label FROM (SELECT id, k % 8 AS s FROM ev)""",
)
def _(v):
    rows = v.ev.select("id", (F.col("k") % 8).alias("code"))
    return rows.withColumn("label", S.source_label(F.col("code").cast("int")))


@query("prj06_category", "SELECT id, split_part(event_type, '.', 1) AS category FROM ev")
def _(v):
    return v.ev.select("id", S.category(F.col("event_type")).alias("category"))


@query(
    "prj07_display_name",
    """SELECT id, COALESCE(n.name, t) AS display_name FROM (SELECT id, CASE WHEN k % 9 = 0 THEN 'custom.burst' ELSE event_type END AS t FROM ev)
        LEFT JOIN names n ON n.code = t""",
    ref.sql_values(ref.EVENT_NAMES, "code, name", "names"),
)
def _(v):
    t = F.when(F.col("k") % 9 == 0, "custom.burst").otherwise(F.col("event_type"))
    return v.ev.select("id", S.display_name(t).alias("display_name"))


@query(
    "prj08_time_conversion",
    "SELECT id, epoch_us(ts) AS micros, timestamp_ns // 1000000000 AS whole_seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso FROM ev",
)
def _(v):
    ts = S.ns_to_timestamp()
    return v.ev.select(
        "id", F.unix_micros(ts).alias("micros"), F.expr("timestamp_ns div 1000000000L").alias("whole_seconds"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("iso"),
    )


# --- grouping --------------------------------------------------------------


@query(
    "agg01_grouped_measures",
    """SELECT 'count' AS fn, band, COUNT(*)::DOUBLE AS agg_value FROM ev GROUP BY band
       UNION ALL SELECT 'count_distinct', band, COUNT(DISTINCT source_unit) FROM ev GROUP BY band
       UNION ALL SELECT 'sum', band, ROUND(SUM(CAST(json_extract_string(attributes, '$.k') AS DOUBLE)), 6) FROM ev GROUP BY band
       UNION ALL SELECT 'avg', band, ROUND(AVG(freq_mhz), 6) FROM ev GROUP BY band
       UNION ALL SELECT 'min', band, MIN(freq_mhz) FROM ev GROUP BY band
       UNION ALL SELECT 'max', band, MAX(talkgroup) FROM ev GROUP BY band""",
)
def _(v):
    asked = [("count", None), ("count_distinct", "uid"), ("sum", "k"), ("avg", "freq"), ("min", "freq"), ("max", "tg")]
    out = grouped_measures(v.ev, [Aggregation(fn, field) for fn, field in asked], ["band"])
    return out.select("fn", "band", F.round("agg_value", 6).alias("agg_value"))


@query("agg02_page_count", "SELECT COUNT(*) AS total FROM ev WHERE event_type = 'protocol.p25.grant' AND encrypted")
def _(v):
    return EventQuery((P.Eq("type", "protocol.p25.grant"), P.Eq("enc", True))).count(v.ev)


@query(
    "agg03_time_buckets",
    """SELECT (timestamp_ns // 300000000000) * 300 AS time_bucket, talkgroup AS tg, COUNT(*) AS agg_value FROM ev
       WHERE event_type ILIKE 'protocol.p25.%' GROUP BY 1, 2""",
)
def _(v):
    q = EventQuery((P.Like("type", "protocol.p25.%"),), aggregation=Aggregation("count", None, ("tg",), 300))
    return q.aggregate(v.ev)


@query(
    "agg04_having",
    "SELECT talkgroup AS tg, band, COUNT(*) AS agg_value FROM ev GROUP BY 1, 2 HAVING COUNT(*) > 100",
)
def _(v):
    return EventQuery(aggregation=Aggregation("count", None, ("tg", "band"), having=F.col("agg_value") > 100)).aggregate(v.ev)


@query(
    "agg05_facets",
    """SELECT * FROM (SELECT printf('%.4f', freq_mhz) AS value, COUNT(*) AS cnt, 'freq_mhz' AS field FROM ev GROUP BY 1 ORDER BY cnt DESC, value LIMIT 15)
       UNION ALL SELECT * FROM (SELECT classification AS value, COUNT(*) AS cnt, 'classification' AS field FROM ev WHERE classification IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, value LIMIT 15)""",
)
def _(v):
    f = facets(v.ev, "freq_mhz", 15).withColumn("field", F.lit("freq_mhz"))
    c = facets(v.ev, "classification", 15).withColumn("field", F.lit("classification"))
    return f.unionByName(c)


@query(
    "agg06_multi_facets",
    """SELECT field, value, cnt, rank FROM (SELECT field, value, COUNT(*) AS cnt, row_number() OVER (PARTITION BY field ORDER BY COUNT(*) DESC, value) AS rank FROM (
        SELECT 'event_type' AS field, event_type AS value FROM ev UNION ALL SELECT 'severity', severity::VARCHAR FROM ev
        UNION ALL SELECT 'band', band FROM ev UNION ALL SELECT 'source', source::VARCHAR FROM ev) GROUP BY 1, 2) WHERE rank <= 20""",
)
def _(v):
    return multi_facets(v.ev, ["event_type", "severity", "band", "source"], 20)


# --- order, paging, distinct, union ----------------------------------------


@query("ord01_newest_page", f"SELECT {HEAD_SQL} FROM ev ORDER BY timestamp_ns DESC, id DESC LIMIT 500")
def _(v):
    return EventQuery(limit=500).rows(v.ev).select(*HEAD)


@query("ord02_offset_page", f"SELECT {HEAD_SQL} FROM ev WHERE severity >= 9 ORDER BY timestamp_ns, id LIMIT 50 OFFSET 200")
def _(v):
    return EventQuery((P.Gte("severity", 9),), newest_first=False, limit=50, offset=200).rows(v.ev).select(*HEAD)


@query("ord03_top_k", "SELECT source_unit AS uid, COUNT(*) AS cnt FROM ev GROUP BY 1 ORDER BY cnt DESC, uid LIMIT 20")
def _(v):
    return v.ev.groupBy(F.col("source_unit").alias("uid")).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "uid").limit(20)


@query(
    "ord06_distinct",
    "SELECT DISTINCT 'tg' AS kind, tgid::VARCHAR AS value FROM gr UNION ALL SELECT DISTINCT 'department', department FROM tg WHERE department IS NOT NULL",
)
def _(v):
    tgs = v.gr.select(F.lit("tg").alias("kind"), F.col("tgid").cast("string").alias("value")).distinct()
    deps = v.tg.where(F.col("department").isNotNull()).select(F.lit("department").alias("kind"), F.col("department").alias("value")).distinct()
    return tgs.unionByName(deps)


_types = ["sigex.emitter.new", "protocol.p25.grant", "spectrum.detect"]


@query(
    "ord07_merged_lists",
    f"""SELECT {HEAD_SQL} FROM (""" + " UNION ALL ".join(
        f"(SELECT {HEAD_SQL} FROM ev WHERE event_type = '{t}' ORDER BY timestamp_ns DESC, id DESC LIMIT 50)" for t in _types
    ) + ") ORDER BY timestamp_ns DESC, id DESC LIMIT 100",
)
def _(v):
    lists = [EventQuery((P.Eq("type", t),), limit=50).rows(v.ev).select(*HEAD) for t in _types]
    merged = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return merged.orderBy(F.desc("timestamp_ns"), F.desc("id")).limit(100)


@query(
    "ord08_newest_listings",
    """SELECT * FROM (SELECT 'audio' AS listing, id, tgid, start_time FROM rec WHERE rec_type = 'audio' ORDER BY start_time DESC, id DESC, tgid DESC LIMIT 50)
       UNION ALL SELECT * FROM (SELECT 'site 3', id, tgid, start_time FROM rec WHERE site_id = 3 ORDER BY start_time DESC, id DESC, tgid DESC LIMIT 50)""",
)
def _(v):
    cols = ["id", "tgid", "start_time"]
    audio = v.rec.where(F.col("rec_type") == "audio").select(F.lit("audio").alias("listing"), *cols)
    site = v.rec.where(F.col("site_id") == 3).select(F.lit("site 3").alias("listing"), *cols)
    order = [F.desc("start_time"), F.desc("id"), F.desc("tgid")]
    return audio.orderBy(*order).limit(50).unionByName(site.orderBy(*order).limit(50))


# --- maintenance and ad-hoc SQL --------------------------------------------

CUT_NS = (EPOCH_S + 10 * 86400 + 11) * 10**9


@query(
    "snk04_retention_purge",
    f"SELECT id, timestamp_ns FROM ev WHERE NOT (ts_bucket < {CUT_NS} - {CUT_NS} % 30000000000 AND timestamp_ns < {CUT_NS})",
)
def _(v):
    return sinks.kept_after_purge(v.ev, CUT_NS).select("id", "timestamp_ns")


@query(
    "snk08_adhoc_sql",
    "SELECT band, COUNT(*) AS cnt, ROUND(AVG(power), 6) AS avg_power FROM ev WHERE encrypted GROUP BY band",
)
def _(v):
    v.ev.createOrReplaceTempView("event_log")
    return sinks.run_read_only(
        v.spark, "SELECT band, COUNT(*) AS cnt, ROUND(AVG(power), 6) AS avg_power FROM event_log WHERE encrypted GROUP BY band"
    )


@query(
    "udx03_user_sql",
    "SELECT device_key, MAX(talkgroup) AS top_tg FROM ev GROUP BY device_key",
)
def _(v):
    v.ev.createOrReplaceTempView("event_log")
    return sinks.run_read_only(v.spark, "SELECT device_key, MAX(talkgroup) AS top_tg FROM event_log GROUP BY device_key")


@query(
    "snk09_schema_listing",
    """SELECT 'channel_grants' AS view_name, ordinal, column_name, (SELECT COUNT(*) FROM gr) AS row_count,
         CASE column_name WHEN 'ts' THEN 'timestamp' WHEN 'system' THEN 'string' WHEN 'grant_type' THEN 'string' WHEN 'voice_freq' THEN 'double' ELSE 'bigint' END AS column_type
       FROM (VALUES (1,'id'),(2,'system'),(3,'tgid'),(4,'uid'),(5,'voice_freq'),(6,'grant_type'),(7,'ts'),(8,'timestamp_ns'),(9,'operation_id'),(10,'k')) t(ordinal, column_name)
       UNION ALL SELECT 'organizations', ordinal, column_name, (SELECT COUNT(*) FROM orgs), column_type
       FROM (VALUES (1,'organization_id','bigint'),(2,'org_name','string')) t(ordinal, column_name, column_type)""",
)
def _(v):
    return sinks.describe_views(v.spark, {"channel_grants": v.gr, "organizations": v.orgs})

"""Cross-source comparison, joins, windows, paths, integrity and rule packs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bags import field
from ..operators import artifact_copy, asof, cross_source, enrich, integrity, transitions, trust, windows, wmi
from ..operators.mft_paths import full_paths
from ..operators.ranking import evicted, keep_first, keep_newest
from ..operators.throttle import throttled
from ..schema import string_map, to_events
from ..sources import artifacts as shapes
from .base import EV, activity, big, joined_bytes, le_binary, query, raw_events, table, us, with_ev


def _seq():
    return F.col("ingest_seq").alias("seq")


def _customer_items(spark, sf, changed: bool):
    """Customers as items; the second view drops, adds, re-cases and changes some."""
    c = table(spark, sf, "customer")
    key, value = F.col("c_name"), F.col("c_mktsegment")
    if changed:
        c = c.where(F.col("c_custkey") % 50 != 3)
        key = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name"))
        value = F.when(F.col("c_custkey") % 97 == 0, F.lit("CHANGED")).when(
            F.col("c_custkey") % 97 == 1, F.lower("c_mktsegment")
        ).otherwise(F.col("c_mktsegment"))
    else:
        c = c.where(F.col("c_custkey") % 60 != 7)
    return c.select(
        F.concat(F.lit("H"), (F.col("c_custkey") % 4).cast("string")).alias("host"),
        key.alias("key"),
        F.col("c_name").alias("display"),
        value.alias("value"),
        F.col("c_custkey").alias("seq"),
    )


_PAIR_SQL = """WITH live AS (SELECT 'H' || (c_custkey % 4) AS host, c_name, c_mktsegment AS v FROM customer WHERE c_custkey % 60 <> 7),
  off AS (SELECT 'H' || (c_custkey % 4) AS host, c_name, CASE WHEN c_custkey % 97 = 0 THEN 'CHANGED' WHEN c_custkey % 97 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment END AS v,
    CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS k FROM customer WHERE c_custkey % 50 <> 3)"""


@query(
    "jn_cross_source",
    f"""{_PAIR_SQL} SELECT coalesce(live.host, off.host) AS host, CASE WHEN live.c_name IS NULL THEN 'MissingFromLive' WHEN off.c_name IS NULL THEN 'MissingFromOffline' ELSE 'ValueMismatch' END AS kind,
         coalesce(live.c_name, off.k) AS key, live.v AS live_value, off.v AS offline_value
       FROM live FULL JOIN off ON live.c_name = off.c_name WHERE live.c_name IS NULL OR off.c_name IS NULL OR lower(live.v) <> lower(off.v)""",
)
def jn_cross_source(spark, sf):
    found = cross_source.compare("Service", _customer_items(spark, sf, False), _customer_items(spark, sf, True))
    return found.select("host", "kind", "key", "live_value", "offline_value")


@query(
    "fn_anomaly_event",
    f"""{_PAIR_SQL} SELECT '[' || CASE WHEN live.c_name IS NULL THEN 'MissingFromLive' ELSE 'MissingFromOffline' END || '] ''' || coalesce(live.c_name, off.c_name) ||
         CASE WHEN live.c_name IS NULL THEN ''' is present in the raw/offline source (service) but NOT in the live API. Possible hiding/tampering — or a disabled/removed entry. Investigate.'
           ELSE ''' is in the live API but NOT in the raw/offline source (service). Possible memory-only/injected item — or created after capture. Investigate.' END AS summary,
         'Low' AS confidence, 'Service:' || coalesce(live.c_name, off.k) AS reference
       FROM live FULL JOIN off ON live.c_name = off.c_name WHERE live.c_name IS NULL OR off.c_name IS NULL""",
)
def fn_anomaly_event(spark, sf):
    found = cross_source.compare(
        "Service", _customer_items(spark, sf, False), _customer_items(spark, sf, True), compare_values=False
    )
    events = cross_source.anomaly_events(found)
    return events.select("summary", "confidence", F.get("evidence", F.lit(0))["reference"].alias("reference"))


@query(
    "win_last_wins",
    "SELECT o_custkey AS key, max(o_orderkey) AS seq, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY o_custkey",
)
def win_last_wins(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("last"), F.col("o_orderpriority").alias("value")
    )
    kept = cross_source.last_wins(rows, ["key"], ["last", "value"])
    return kept.select("key", F.col("last").alias("seq"), "value")


def _spaced(raw):
    return F.regexp_replace(F.hex(raw), r"(..)(?!$)", "$1 ")


def _service_values(spark, sf):
    """Registry values of services from ``orders``: one service per customer, one value per order."""
    case, key = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    image = F.concat(F.lit("C:\\svc\\"), key, F.when(F.col("o_custkey") % 5 == 0, F.lit(".sys")).otherwise(F.lit(".exe")))
    bag = string_map(
        {
            "QueryName": F.lit("services"),
            "ServiceName": F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("Svc")).otherwise(F.lit("SVC")), key),
            "ServiceImagePath": F.when(case == 0, _spaced(F.encode(image, "UTF-16LE"))),
            "ServiceTypeLabel": F.when((case == 1) & (F.col("o_custkey") % 7 == 0), F.lit("KernelDriver")),
            "ServiceType": F.when(
                case == 2, F.when(F.col("o_custkey") % 3 == 0, F.lit("01 00 00 00")).otherwise(F.lit("16"))
            ),
        }
    )
    return to_events(
        table(spark, sf, "orders"),
        host=F.concat(F.lit("H"), (F.col("o_custkey") % 4).cast("string")),
        ingest_seq=F.col("o_orderkey"),
        ts=F.col("o_orderdate").cast("timestamp"),
        category=F.lit("Registry"),
        action=F.lit("Query"),
        fields=bag,
    )


_SERVICES = """sv AS (SELECT 'H' || (o_custkey % 4) AS host, o_custkey,
    bool_or(o_orderkey % 3 = 0) AS has_image, bool_or(o_orderkey % 3 = 1 AND o_custkey % 7 = 0) AS is_driver, bool_or(o_orderkey % 3 = 2) AS has_type,
    CASE WHEN arg_min(o_orderkey, o_orderkey) % 2 = 0 THEN 'Svc' ELSE 'SVC' END || o_custkey AS display
    FROM orders GROUP BY o_custkey),
  um AS (SELECT *, CASE WHEN is_driver THEN false WHEN has_type THEN o_custkey % 3 <> 0 WHEN has_image THEN o_custkey % 5 <> 0 ELSE false END AS is_user FROM sv)"""


@query(
    "agg_service",
    f"""WITH {_SERVICES} SELECT host, 'svc' || o_custkey AS key, display, CASE WHEN has_image THEN 'C:\\svc\\' || o_custkey || CASE WHEN o_custkey % 5 = 0 THEN '.sys' ELSE '.exe' END END AS value FROM um WHERE is_user""",
)
def agg_service(spark, sf):
    return cross_source.offline_service_items(_service_values(spark, sf)).select("host", "key", "display", "value")


def _live_services(spark, sf, rows=None):
    rows = table(spark, sf, "customer") if rows is None else rows
    return shapes.service_events(
        rows.select(
            F.concat(F.lit("H"), (F.col("c_custkey") % 4).cast("string")).alias("host"),
            F.col("c_custkey").alias("ingest_seq"),
            F.concat(F.lit("svc"), F.col("c_custkey").cast("string")).alias("name"),
            F.col("c_name").alias("display_name"),
            F.lit("x.exe").alias("path_name"),
            F.lit("Running").alias("state"),
            F.lit("Auto").alias("start_mode"),
            F.lit("Own Process").alias("service_type"),
            F.lit("LocalSystem").alias("start_name"),
            F.lit("2024-01-01").cast("timestamp").alias("ts"),
        )
    )


@query(
    "fn_service_event",
    "SELECT c_custkey AS seq, 'Service: svc' || c_custkey || ' (' || c_name || ') — Running/Auto' AS summary FROM customer",
)
def fn_service_event(spark, sf):
    return _live_services(spark, sf).select(_seq(), "summary")


@query(
    "jn_cross_service",
    f"""WITH {_SERVICES}, off AS (SELECT host, 'svc' || o_custkey AS key FROM um WHERE is_user), live AS (SELECT 'H' || (c_custkey % 4) AS host, 'svc' || c_custkey AS key FROM customer WHERE c_custkey % 10 <> 4)
        SELECT coalesce(live.host, off.host) AS host, coalesce(live.key, off.key) AS key, CASE WHEN live.key IS NULL THEN 'MissingFromLive' ELSE 'MissingFromOffline' END AS kind
        FROM live FULL JOIN off ON live.host = off.host AND live.key = off.key WHERE live.key IS NULL OR off.key IS NULL""",
)
def jn_cross_service(spark, sf):
    running = table(spark, sf, "customer").where(F.col("c_custkey") % 10 != 4)  # the others are missing from the live side
    both = _live_services(spark, sf, running).unionByName(_service_values(spark, sf))
    return cross_source.compare_services(both).select("host", "key", "kind")


@query(
    "jn_cross_task",
    r"""WITH disk AS (SELECT 'H' || (p_partkey % 3) AS host, '\' || lower(p_brand) || '\t' || p_partkey AS key FROM part WHERE p_partkey % 9 <> 1),
          cache AS (SELECT 'H' || (p_partkey % 3) AS host, '\' || lower(p_brand) || '\t' || p_partkey AS key FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 8 <> 2)
        SELECT coalesce(disk.host, cache.host) AS host, coalesce(disk.key, cache.key) AS key, CASE WHEN disk.key IS NULL THEN 'MissingFromLive' ELSE 'MissingFromOffline' END AS kind
        FROM disk FULL JOIN cache ON disk.host = cache.host AND disk.key = cache.key WHERE (disk.key IS NULL OR cache.key IS NULL) AND coalesce(disk.host, cache.host) <> 'H2'""",
)
def jn_cross_task(spark, sf):
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    host = F.concat(F.lit("H"), (key % 3).cast("string"))
    name = F.concat(F.lit("\\"), F.col("p_brand"), F.lit("\\T"), key.cast("string"))
    disk = to_events(
        part.where(key % 9 != 1), host=host, ingest_seq=key, ts=F.current_timestamp(), category=F.lit("Persistence"),
        action=F.lit("Query"), fields=F.create_map(F.lit("TaskName"), F.translate(name, "\\", "/")),
    )
    cached = to_events(
        part.where((key % 3 != 2) & (key % 8 != 2)), host=host, ingest_seq=key, ts=F.current_timestamp(), category=F.lit("Registry"),
        action=F.lit("Query"), fields=F.create_map(F.lit("TaskCache_Path"), _spaced(F.encode(name, "UTF-16LE"))),
    )
    return cross_source.compare_tasks(disk.unionByName(cached)).select("host", "key", "kind")


@query(
    "jn_cross_runkey",
    """WITH live AS (SELECT 'H' || (p_partkey % 2) AS host, 'hkcu|' || lower(p_name) || p_partkey AS key FROM part WHERE p_partkey % 9 <> 1),
         off AS (SELECT 'H' || (p_partkey % 2) AS host, 'hkcu|' || lower(p_name) || p_partkey AS key FROM part WHERE p_partkey % 8 <> 2)
       SELECT coalesce(live.host, off.host) AS host, coalesce(live.key, off.key) AS key, CASE WHEN live.key IS NULL THEN 'MissingFromLive' ELSE 'MissingFromOffline' END AS kind
       FROM live FULL JOIN off ON live.host = off.host AND live.key = off.key WHERE live.key IS NULL OR off.key IS NULL""",
)
def jn_cross_runkey(spark, sf):
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    host = F.concat(F.lit("H"), (key % 2).cast("string"))
    name = F.concat(F.col("p_name"), key.cast("string"))

    def values(rows, query_name, mode):
        bag = string_map({"QueryName": F.lit(query_name), "ValueName": name, "Mode": mode, "ValueData": F.lit("x")})
        return to_events(
            rows, host=host, ingest_seq=key, ts=F.current_timestamp(), category=F.lit("Registry"), action=F.lit("Query"), fields=bag
        )

    live = values(part.where(key % 9 != 1), "User Run Key", F.lit(None).cast("string"))
    off = values(part.where(key % 8 != 2), "User Run", F.lit("Offline"))
    return cross_source.compare_run_keys(live.unionByName(off)).select("host", "key", "kind")


@query(
    "jn_cross_process",
    """WITH n1 AS (SELECT c_custkey AS pid FROM customer WHERE c_custkey % 11 <> 1), m1 AS (SELECT c_custkey AS pid FROM customer WHERE c_custkey % 13 <> 2),
         n2 AS (SELECT c_custkey AS pid FROM customer WHERE c_custkey % 22 <> 1), m2 AS (SELECT c_custkey AS pid FROM customer WHERE c_custkey % 26 <> 2)
       SELECT pid::VARCHAR AS key, 'MissingFromLive' AS kind FROM m1 WHERE pid NOT IN (SELECT pid FROM n1) AND pid NOT IN (SELECT pid FROM n2) AND pid IN (SELECT pid FROM m2)
       UNION ALL SELECT pid::VARCHAR, 'MissingFromOffline' FROM n1 WHERE pid NOT IN (SELECT pid FROM m1) AND pid NOT IN (SELECT pid FROM m2) AND pid IN (SELECT pid FROM n2)""",
)
def jn_cross_process(spark, sf):
    listed = table(spark, sf, "customer").select(
        F.lit("H0").alias("host"), F.col("c_custkey").alias("pid"), F.concat(F.col("c_name"), F.lit(".EXE")).alias("process_name"),
        F.col("c_custkey").alias("seq"),
    )
    pid = F.col("pid")
    found = cross_source.compare_processes(
        listed.where(pid % 11 != 1), listed.where(pid % 13 != 2), listed.where(pid % 22 != 1), listed.where(pid % 26 != 2)
    )
    return found.select("key", "kind")


@query(
    "jn_srum_ids",
    """SELECT l_orderkey * 8 + l_linenumber AS seq, CASE WHEN l_partkey % 10 <> 9 THEN '!!' || p_name END AS app, 'S-1-5-' || l_suppkey AS user_sid
       FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
)
def jn_srum_ids(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.lit("H0").alias("host"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_partkey").alias("app_id"),
        (F.col("l_suppkey") + 1_000_000_000).alias("user_id"),
    )
    return enrich.resolve_ids(rows, enrich.srum_id_map(_id_table(spark, sf))).select("seq", "app", "user_sid")


def _id_table(spark, sf):
    apps = table(spark, sf, "part").where(F.col("p_partkey") % 10 != 9).select(
        F.lit("H0").alias("host"),
        F.col("p_partkey").alias("id_index"),
        F.lit(0).alias("id_type"),
        joined_bytes(F.encode(F.concat(F.lit("!!"), F.col("p_name")), "UTF-16LE"), F.unhex(F.lit("0000"))).alias("id_blob"),
    )
    users = table(spark, sf, "supplier").select(
        F.lit("H0").alias("host"),
        (F.col("s_suppkey") + 1_000_000_000).alias("id_index"),
        F.lit(3).alias("id_type"),
        joined_bytes(F.unhex(F.lit("0101000000000005")), le_binary(F.col("s_suppkey"), 4)).alias("id_blob"),
    )
    return apps.unionByName(users)


def _usage_tables(spark, sf):
    base = table(spark, sf, "lineitem").select(
        F.lit("H0").alias("host"),
        F.lit("C:\\SRUDB.dat").alias("database"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("auto_inc_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_partkey").alias("app_id"),
        (F.col("l_suppkey") + 1_000_000_000).alias("user_id"),
        big(F.col("l_quantity")).alias("BytesSent"),
        F.col("l_linenumber").alias("BytesRecvd"),
        "l_returnflag",
    )
    network = base.where(F.col("l_returnflag") == "A").drop("l_returnflag")
    energy = base.where(F.col("l_returnflag") == "N").drop("l_returnflag", "BytesSent", "BytesRecvd")
    cpu = base.where(F.col("l_returnflag") == "R").drop("l_returnflag", "BytesSent", "BytesRecvd")
    return {
        "{DA73FB89-2BEA-4DDC-86B8-6E048C6DA477}": cpu,
        "{973F5D5C-1D90-4944-BE8E-24B94231A174}": network,
        "{d10ca2fe-6fcf-4f6d-848e-b2e99266fa86}": energy,
        "{00000000-0000-0000-0000-000000000000}": energy,
    }


@query(
    "src_srum",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'Network Data Usage' WHEN 'N' THEN 'Energy Usage' ELSE 'SDP CPU Provider' END AS provider, count(*)::BIGINT AS n,
       sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END)::BIGINT AS sent FROM lineitem GROUP BY 1""",
)
def src_srum(spark, sf):
    rows = shapes.usage_rows(_usage_tables(spark, sf))
    return rows.groupBy("provider").agg(F.count("*").alias("n"), big(F.sum("BytesSent")).alias("sent"))


@query(
    "win_table_cap",
    """SELECT provider, count(*)::BIGINT AS n, max(seq)::BIGINT AS last_seq FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'Network Data Usage' WHEN 'N' THEN 'Energy Usage' ELSE 'SDP CPU Provider' END AS provider,
         l_orderkey * 8 + l_linenumber AS seq, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 8 + l_linenumber) AS rn FROM lineitem)
       WHERE rn <= 1500 GROUP BY provider""",
)
def win_table_cap(spark, sf):
    rows = shapes.usage_rows(_usage_tables(spark, sf), cap=1500)
    return rows.groupBy("provider").agg(F.count("*").alias("n"), F.max("auto_inc_id").alias("last_seq"))


@query(
    "fn_srum_event",
    """WITH n AS (SELECT l.*, CASE WHEN l_partkey % 10 <> 9 THEN '!!' || p_name ELSE '(unknown app)' END AS app FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey)
       SELECT category, count(*)::BIGINT AS n, count(DISTINCT summary)::BIGINT AS n_summaries, min(summary) AS first_summary FROM (
         SELECT CASE l_returnflag WHEN 'A' THEN 'Network' ELSE 'System' END AS category,
           CASE l_returnflag WHEN 'A' THEN 'SRUM Network Data Usage: ' || app || ' sent=' || CAST(l_quantity AS BIGINT) || ' recvd=' || l_linenumber WHEN 'N' THEN 'SRUM Energy Usage: ' || app ELSE 'SRUM SDP CPU Provider: ' || app END AS summary
         FROM n) GROUP BY category""",
)
def fn_srum_event(spark, sf):
    events = shapes.usage_events(
        shapes.usage_rows(_usage_tables(spark, sf)), _id_table(spark, sf), ["BytesSent", "BytesRecvd"]
    )
    return events.groupBy("category").agg(
        F.count("*").alias("n"), F.count_distinct("summary").alias("n_summaries"), F.min("summary").alias("first_summary")
    )


def _history(spark, sf):
    """Customers as pages, orders as visits, one database per nation group."""
    database = F.concat(F.lit("C:\\Users\\u\\AppData\\Local\\Google\\Chrome\\User Data\\Profile "), (F.col("k") % 5).cast("string"), F.lit("\\History"))
    urls = table(spark, sf, "customer").withColumn("k", F.col("c_custkey")).select(
        F.lit("H0").alias("host"),
        database.alias("database"),
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 20 != 3, F.concat(F.lit("https://c/"), F.col("c_custkey").cast("string"))).alias("url"),
        F.col("c_name").alias("title"),
        F.lit(2).alias("visit_count"),
        F.lit(1).alias("typed_count"),
    )
    time = F.when(F.col("o_orderkey") % 30 == 1, F.lit(0)).otherwise(us(F.col("o_orderdate")) + 400_000_000_000_000 + 11_644_473_600_000_000)
    visits = table(spark, sf, "orders").withColumn("k", F.col("o_custkey")).select(
        F.lit("H0").alias("host"),
        database.alias("database"),
        F.col("o_custkey").alias("url"),
        time.alias("visit_time"),
        (F.col("o_orderkey") % 9 + 256).alias("transition"),
    )
    return urls, visits


_HISTORY = """h AS (SELECT c_custkey AS id, c_custkey % 5 AS db, c_name, epoch_us(o_orderdate) + 400000000000000 AS us, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey)"""


@query("jn_browser_visits", "SELECT c_custkey AS url_id, count(*)::BIGINT AS visits FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def jn_browser_visits(spark, sf):
    urls, visits = _history(spark, sf)
    joined = enrich.visits_of_urls(urls.withColumnRenamed("id", "url_id").withColumnRenamed("url", "page"), visits, "url_id", "url")
    return joined.groupBy("url_id").agg(F.count("*").alias("visits"))


_CHROMIUM = f"""WITH {_HISTORY} SELECT id AS record_id, us, 'Browser visit: ' || c_name AS summary, 'Profile ' || db AS profile,
  list_extract(['Link','Typed','Auto Bookmark','Auto Subframe','Manual Subframe','Generated','Start Page','Form Submit','Reload'], CAST(o_orderkey % 9 AS INTEGER) + 1) AS visit_type
  FROM h WHERE id % 20 <> 3 AND o_orderkey % 30 <> 1 AND us >= 946684800000000"""


@query("src_chromium_history", _CHROMIUM)
def src_chromium_history(spark, sf):
    return _visits(shapes.chromium_events(*_history(spark, sf)))


def _visits(events):
    bag = F.col("fields")
    return events.select(
        big(field(bag, "RecordId")).alias("record_id"),
        us(F.col("ts")).alias("us"),
        "summary",
        field(bag, "BrowserProfile").alias("profile"),
        field(bag, "VisitType").alias("visit_type"),
    )


@query(
    "src_firefox_history",
    f"""WITH {_HISTORY} SELECT id AS record_id, (epoch_us(date_trunc('day', make_timestamp(us - 400000000000000))) // 1000) * 1000 AS us, 'Browser visit: ' || c_name AS summary, 'Default' AS profile,
  CASE o_orderkey % 9 WHEN 0 THEN '0' WHEN 8 THEN '8' ELSE list_extract(['Link','Typed','Bookmark','Embed','Redirect Perm','Redirect Temp','Download'], CAST(o_orderkey % 9 AS INTEGER)) END AS visit_type FROM h WHERE o_orderkey % 30 <> 1""",
)
def src_firefox_history(spark, sf):
    urls, visits = _history(spark, sf)
    moved = visits.select(
        "host", "database", F.col("url").alias("place_id"),
        F.when(F.col("visit_time") > 0, F.col("visit_time") - 400_000_000_000_000 - 11_644_473_600_000_000).otherwise(F.lit(0)).alias("visit_date"),
        (F.col("transition") - 256).alias("visit_type"),
    )
    return _visits(shapes.firefox_events(urls, moved))


@query(
    "fn_browser_event",
    f"WITH {_HISTORY} SELECT 'https://c/' || id AS object_url, count(*)::BIGINT AS n FROM h WHERE id % 20 <> 3 AND o_orderkey % 30 <> 1 AND us >= 946684800000000 GROUP BY 1",
)
def fn_browser_event(spark, sf):
    return shapes.chromium_events(*_history(spark, sf), cap=0).groupBy("object_url").agg(F.count("*").alias("n"))


@query(
    "jn_mru_rank",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 END AS mru_order FROM orders",
)
def jn_mru_rank(spark, sf):
    key = F.concat(F.lit("K"), F.col("o_custkey").cast("string"))
    values = table(spark, sf, "orders").select(
        F.lit("H0").alias("host"), key.alias("key_path"), (F.col("o_orderkey") % 4).cast("string").alias("value_name"), "o_orderkey"
    )
    raw = joined_bytes(*[le_binary(F.lit(n), 4) for n in (0, 1, 2, 2**32 - 1, 3)])
    lists = values.select("host", "key_path").distinct().withColumn("value_raw", raw)
    joined = enrich.with_mru_rank(values, enrich.mru_ranks(lists))
    return joined.select("o_orderkey", big(F.col("mru_order")).alias("mru_order"))


@query(
    "win_mru_order",
    "SELECT doc_id, (i - 1)::BIGINT AS ordinal, md5(p[i]) AS item FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)",
)
def win_mru_order(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("items"))
    listed = enrich.entry_ordinals(rows, ["doc_id"], "items")
    return listed.select("doc_id", big(F.col("ordinal")).alias("ordinal"), F.md5("item").alias("item"))


@query(
    "jn_mft_paths",
    r"""WITH RECURSIVE w(id, cur, path) AS (SELECT c_custkey, c_custkey, c_name FROM customer
          UNION ALL SELECT w.id, p.c_custkey, p.c_name || '\' || w.path FROM w JOIN customer p ON p.c_custkey = w.cur // 10 WHERE w.cur // 10 <> w.cur)
        SELECT id AS record_index, arg_max(path, length(path)) AS full_path FROM w GROUP BY id""",
)
def jn_mft_paths(spark, sf):
    entries = table(spark, sf, "customer").select(
        F.lit("H0").alias("host"), F.lit("C:").alias("source"), F.col("c_custkey").alias("record_index"),
        F.call_function("div", F.col("c_custkey"), F.lit(10)).alias("parent_record_index"), F.col("c_name").alias("file_name"),
    )
    return full_paths(entries).select("record_index", "full_path")


@query(
    "jn_evidence_rewrite",
    with_ev(r"""SELECT seq, 'events:' || seq || CASE WHEN n_evidence = 2 THEN '|' || CASE WHEN user_id % 2 = 0 THEN 'raw/evtx/' || user_id ELSE 'C:\Logs\u' || user_id || '.evtx' END ELSE '' END AS refs FROM ev"""),
)
def jn_evidence_rewrite(spark, sf):
    ev = activity(spark, sf)
    copied = raw_events(spark, sf).where(F.col("user_id") % 2 == 0).select(
        F.concat(F.lit("H"), (F.col("user_id") % 4).cast("string")).alias("host"), F.lit("C0").alias("collection_id"),
        F.concat(F.lit("c:\\LOGS\\u"), F.col("user_id").cast("string"), F.lit(".evtx")).alias("reference"),
        F.concat(F.lit("raw/evtx/"), F.col("user_id").cast("string")).alias("copied_path"),
    ).distinct()
    rows = enrich.rewrite_evidence(ev, copied)
    return rows.select(_seq(), F.array_join(F.transform("evidence", lambda e: e["reference"]), "|").alias("refs"))


@query(
    "agg_artifact_copy",
    with_ev("""SELECT host, count(*) FILTER (n_evidence = 2 AND user_id % 3 = 0)::BIGINT AS rewritten, count(DISTINCT user_id) FILTER (n_evidence = 2 AND user_id % 3 = 0)::BIGINT AS copied,
      (count(*) + count(*) FILTER (n_evidence = 2 AND user_id % 3 = 2))::BIGINT AS skipped, count(*) FILTER (n_evidence = 2 AND user_id % 3 = 1)::BIGINT AS failed FROM ev GROUP BY host"""),
)
def agg_artifact_copy(spark, sf):
    users = raw_events(spark, sf).select("user_id").distinct().where(F.col("user_id") % 3 != 2)
    files = users.select(
        F.concat(F.lit("H"), (F.col("user_id") % 4).cast("string")).alias("host"),
        F.concat(F.lit("C:\\logs\\U"), F.col("user_id").cast("string"), F.lit(".evtx")).alias("file_path"),
        (F.col("user_id") % 3 == 0).alias("copy_ok"),
    )
    summary = artifact_copy.copy_summary(artifact_copy.evidence_outcomes(activity(spark, sf), files))
    return summary.select(
        "host",
        F.col("rewritten_count").alias("rewritten"),
        F.col("copied_file_count").alias("copied"),
        F.col("skipped_count").alias("skipped"),
        F.col("failed_count").alias("failed"),
    )


def _hash_tables(spark, sf):
    """Documents as files: some changed, some missing, some undeclared, some escaping."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    bundle = F.concat(F.lit("B"), (F.col("doc_id") % 10).cast("string")).alias("collection_id")
    name = F.concat(F.lit("raw/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    declared = docs.where(F.col("doc_id") % 17 != 3).select(
        F.lit("H0").alias("host"), bundle,
        F.when(F.col("doc_id") % 23 == 5, F.concat(F.lit("../"), name)).otherwise(F.translate(name, "/", "\\")).alias("relative_path"),
        F.sha2("text", 256).alias("sha256"),
    )
    actual = docs.where(F.col("doc_id") % 19 != 4).select(
        F.lit("H0").alias("host"), bundle, F.upper(name).alias("relative_path"),
        F.sha2(F.when(F.col("doc_id") % 29 == 6, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"),
    )
    return declared, actual


_CHECKS = r"""d AS (SELECT doc_id, 'B' || (doc_id % 10) AS bundle, doc_id % 17 <> 3 AS declared, doc_id % 23 = 5 AS escaping, doc_id % 19 <> 4 AS present, doc_id % 29 = 6 AS changed FROM documents),
  k AS (SELECT bundle, 'raw\d' || doc_id || '.txt' AS path, CASE WHEN NOT present THEN 'missing' WHEN changed THEN 'mismatch' ELSE 'ok' END AS status FROM d WHERE declared AND NOT escaping
    UNION ALL SELECT bundle, '../raw/d' || doc_id || '.txt', 'escape' FROM d WHERE declared AND escaping
    UNION ALL SELECT bundle, upper('raw/d' || doc_id || '.txt'), 'undeclared' FROM d WHERE present AND (NOT declared OR escaping))"""


@query("jn_integrity", f"WITH {_CHECKS} SELECT bundle AS collection_id, path AS relative_path, status FROM k")
def jn_integrity(spark, sf):
    return integrity.compare_hashes(*_hash_tables(spark, sf)).select("collection_id", "relative_path", "status")


@query(
    "rul_integrity_status",
    f"WITH {_CHECKS} SELECT bundle AS collection_id, CASE WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'Failed' ELSE 'Verified' END AS status, count(*)::BIGINT AS file_count, count(*) FILTER (status <> 'ok')::BIGINT AS issue_count FROM k GROUP BY bundle",
)
def rul_integrity_status(spark, sf):
    checks = integrity.compare_hashes(*_hash_tables(spark, sf))
    return integrity.status_of_checks(checks, ["collection_id"])


_MULTI = """t AS (SELECT l_shipdate, CAST(l_quantity AS BIGINT) AS q FROM lineitem), o AS (SELECT l_shipdate, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_orderkey % 10 <> 3),
  m AS (SELECT t.l_shipdate, t.q, t.n AS truth_count, coalesce(o.n, 0) AS our_count FROM (SELECT l_shipdate, q, count(*) AS n FROM t GROUP BY ALL) t LEFT JOIN (SELECT l_shipdate, q, count(*) AS n FROM o GROUP BY ALL) o ON t.l_shipdate = o.l_shipdate AND t.q = o.q)"""


def _multiset(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", us(F.col("l_shipdate")).alias("ship_us"), big(F.col("l_quantity")).alias("q"))
    ours = rows.where(F.col("l_orderkey") % 10 != 3)
    return rows, ours, enrich.multiset_match(rows, ours, ["ship_us", "q"])


@query("jn_multiset_match", f"WITH {_MULTI} SELECT epoch_us(l_shipdate) AS ship_us, q, truth_count::BIGINT AS truth_count, our_count::BIGINT AS our_count, least(truth_count, our_count)::BIGINT AS matched FROM m")
def jn_multiset_match(spark, sf):
    return _multiset(spark, sf)[2]


@query(
    "agg_coverage",
    f"WITH {_MULTI} SELECT sum(truth_count)::BIGINT AS truth_rows, sum(least(truth_count, our_count))::BIGINT AS matched_rows, (SELECT count(*) FROM o)::BIGINT AS our_rows, round(sum(least(truth_count, our_count)) / sum(truth_count), 6) AS coverage, round(abs((SELECT count(*) FROM o) - sum(truth_count)) / sum(truth_count), 6) AS row_delta FROM m",
)
def agg_coverage(spark, sf):
    _, ours, matches = _multiset(spark, sf)
    result = enrich.coverage(matches, ours)
    return result.select(
        big(F.col("truth_rows")).alias("truth_rows"), big(F.col("matched_rows")).alias("matched_rows"), "our_rows",
        F.round("coverage", 6).alias("coverage"), F.round("row_delta", 6).alias("row_delta"),
    )


@query(
    "agg_collection_summary",
    with_ev("""SELECT host, CASE WHEN host <> 'H3' THEN (count(*) + CASE WHEN host = 'H1' THEN 5 ELSE 0 END)::BIGINT END AS source_event_count, count(*)::BIGINT AS exported_event_count,
      CASE WHEN host <> 'H3' THEN host = 'H1' END AS was_event_count_capped, sum(n_evidence)::BIGINT AS evidence_count FROM ev GROUP BY host"""),
)
def agg_collection_summary(spark, sf):
    ev = activity(spark, sf)
    counts = ev.where(F.col("host") != "H3").groupBy("host").agg(
        (F.count("*") + F.when(F.col("host") == "H1", 5).otherwise(0)).alias("source_event_count")
    )
    return trust.collection_summary(ev, ["host"], counts).drop("event_cap")


@query(
    "agg_drop_totals",
    with_ev("""SELECT host, category, sum(cents)::BIGINT AS total_drops, arg_max(cents, us)::BIGINT AS last_reported_drops, max(us) AS last_us FROM ev GROUP BY host, category"""),
)
def agg_drop_totals(spark, sf):
    reports = activity(spark, sf).select("host", "category", "ts", big(field(F.col("fields"), "Size")).alias("dropped"))
    return trust.drop_totals(reports, ["host"]).select(
        "host", "category", "total_drops", "last_reported_drops", us(F.col("last_report")).alias("last_us")
    )


@query("agg_drop_grand_total", with_ev("SELECT coalesce(sum(cents), 0)::BIGINT AS dropped_event_total FROM ev"))
def agg_drop_grand_total(spark, sf):
    reports = activity(spark, sf).select("host", "category", "ts", big(field(F.col("fields"), "Size")).alias("dropped"))
    return trust.drop_grand_total(reports)


@query("agg_warnings", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || '|' || o_orderstatus ELSE o_orderstatus || '|' || o_orderpriority END AS warnings FROM orders")
def agg_warnings(spark, sf):
    a, b = F.col("o_orderpriority"), F.col("o_orderstatus")
    first = F.when(F.col("o_orderkey") % 2 == 0, F.array(a, F.lit(" "), a)).otherwise(F.array(b, b))
    merged = trust.merge_warnings(first, F.array(b, a, F.lit("")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(merged, "|").alias("warnings"))


def _manifests(spark, sf):
    """One manifest row per order, flags and counts derived from its columns."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, yes, no: F.when(key % n == 0, yes).when(key % n == 1, no)
    yes, no = F.lit(True), F.lit(False)
    return table(spark, sf, "orders").select(
        F.concat(F.lit("H"), (cust % 4).cast("string")).alias("host"),
        key.cast("string").alias("collection_id"),
        (key % 31 != 7).alias("manifest_present"),
        F.when(key % 3 == 0, F.lit("Verified")).when(key % 3 == 1, F.lit("Unverified")).alias("integrity_status"),
        pick(5, yes, no).alias("complete"),
        pick(4, no, yes).alias("was_event_count_capped"),
        big(key + 100).alias("source_event_count"),
        F.when(key % 2 == 0, key).alias("exported_event_count"),
        F.lit(500000).alias("event_cap"),
        F.when(key % 6 < 4, key % 6).alias("trace_dropped_total"),
        F.when(key % 7 < 5, key % 7).alias("render_dropped_total"),
        (cust % 9 == 1).cast("bigint").alias("failed_evidence_count"),
        (cust % 8).alias("skipped_evidence_count"),
        pick(3, yes, no).alias("was_artifact_copy_incomplete"),
        F.lit(None).cast("string").alias("artifact_copy_warning"),
        (key % 2).alias("copied_artifact_count"),
        F.lit(0).alias("evidence_count"),
        pick(5, yes, no).alias("used_shadow_copy"),
        (key % 11 != 3).alias("preflight_present"),
        F.when(cust % 10 == 0, F.array(F.lit("e1"), F.lit("e2"))).otherwise(F.array().cast("array<string>")).alias("preflight_errors"),
        F.when(cust % 6 == 0, F.array(F.lit("w1"))).otherwise(F.array().cast("array<string>")).alias("preflight_warnings"),
        pick(4, yes, no).alias("is_administrator"),
        F.when(key % 5 == 0, F.lit("LIVE_non_forensic")).when(key % 5 == 1, F.lit("offline_only")).alias("registry_mode"),
        pick(6, no, yes).alias("registry_live_enabled"),
        F.when(key % 4 == 0, F.lit("Custom")).when(key % 4 == 1, F.lit("forensic_strict")).alias("mode_profile"),
    )


_SIGNALS = """m AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 31 <> 7 AS present FROM orders),
s AS (
  SELECT k, 'Integrity' AS signal, CASE k % 3 WHEN 0 THEN 0 ELSE 1 END AS level, false AS is_unknown FROM m WHERE k % 3 IN (0, 1)
  UNION ALL SELECT k, 'Manifest', 2, false FROM m WHERE NOT present
  UNION ALL SELECT k, 'Bundle completeness', CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END, k % 5 > 1 FROM m WHERE present
  UNION ALL SELECT k, 'Event truncation', CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END, k % 4 > 1 FROM m WHERE present
  UNION ALL SELECT k, 'ETW completeness', CASE WHEN k % 6 = 0 THEN 0 ELSE 1 END, k % 6 >= 4 FROM m WHERE present
  UNION ALL SELECT k, 'UI render backpressure', CASE WHEN k % 7 IN (0, 5, 6) THEN 0 ELSE 1 END, false FROM m WHERE present
  UNION ALL SELECT k, 'Raw artifact copy', CASE WHEN c % 9 = 1 THEN 2 WHEN c % 8 > 0 OR k % 3 = 0 THEN 1 ELSE 0 END, false FROM m WHERE present
  UNION ALL SELECT k, 'VSS artifact source', CASE WHEN k % 2 = 0 OR k % 5 = 0 THEN 0 ELSE 1 END, NOT (k % 2 = 0 OR k % 5 IN (0, 1)) FROM m WHERE present
  UNION ALL SELECT k, 'Preflight', CASE WHEN k % 11 = 3 THEN 1 WHEN c % 10 = 0 THEN 2 WHEN c % 6 = 0 THEN 1 ELSE 0 END, k % 11 = 3 FROM m WHERE present
  UNION ALL SELECT k, 'Privilege', CASE k % 4 WHEN 0 THEN 0 ELSE 1 END, k % 4 > 1 FROM m WHERE present
  UNION ALL SELECT k, 'Registry mode', CASE WHEN k % 5 = 0 OR k % 6 = 1 THEN 1 WHEN k % 5 = 1 OR k % 6 = 0 THEN 0 ELSE 1 END, NOT (k % 5 IN (0, 1) OR k % 6 IN (0, 1)) FROM m WHERE present
  UNION ALL SELECT k, 'Mode profile', CASE k % 4 WHEN 1 THEN 0 ELSE 1 END, k % 4 > 1 FROM m WHERE present)"""


@query("rul_trust_signals", f"WITH {_SIGNALS} SELECT k::VARCHAR AS collection_id, signal, level::BIGINT AS level, is_unknown FROM s")
def rul_trust_signals(spark, sf):
    rows = trust.trust_signals(_manifests(spark, sf))
    return rows.select("collection_id", "signal", big(F.col("level")).alias("level"), "is_unknown")


@query(
    "agg_trust_overall",
    f"WITH {_SIGNALS} SELECT k::VARCHAR AS collection_id, max(CASE WHEN is_unknown THEN greatest(level, 1) ELSE level END)::BIGINT AS overall_level, count(*) FILTER (level = 2)::BIGINT AS red_count, count(*) FILTER (level = 1)::BIGINT AS amber_count FROM s GROUP BY k",
)
def agg_trust_overall(spark, sf):
    rows = trust.trust_overall(trust.trust_signals(_manifests(spark, sf)))
    return rows.select("collection_id", big(F.col("overall_level")).alias("overall_level"), "red_count", "amber_count")


@query(
    "rul_known_limitations",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || '|' || o_orderstatus WHEN 1 THEN 'a: ' || o_orderpriority || '|b' WHEN 2 THEN o_orderpriority ELSE '' END AS limitations FROM orders""",
)
def rul_known_limitations(spark, sf):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    case = F.col("o_orderkey") % 4
    document = (
        F.when(case == 0, F.concat(F.lit('{"knownLimitations":["'), p, F.lit('"," ","'), s, F.lit('"]}')))
        .when(case == 1, F.concat(F.lit('{"knownLimitations":{"a":"'), p, F.lit('","b":5}}')))
        .when(case == 2, F.concat(F.lit('{"knownLimitations":"'), p, F.lit('"}')))
        .otherwise(F.lit("{}"))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", document.alias("d"))
    return rows.select("o_orderkey", F.array_join(trust.known_limitations(F.col("d")), "|").alias("limitations"))


@query(
    "rul_preflight_warnings",
    """SELECT o_orderkey, ((CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 2 = 1 AND (o_orderkey % 3 = 0 OR o_orderkey % 7 > 0) THEN 1 ELSE 0 END)
         + (CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END))::BIGINT AS n FROM orders""",
)
def rul_preflight_warnings(spark, sf):
    k = F.col("o_orderkey")
    raised = trust.preflight_warnings(
        k % 2 == 0, k % 3 == 0, k % 7, k % 4 == 0, k % 6 == 0,
        F.when(k % 10 == 0, F.lit("custom")).otherwise(F.lit("triage_fast")),
        F.when(k % 5 == 0, F.lit(1000)).otherwise(F.lit(10**12)),
    )
    return table(spark, sf, "orders").select("o_orderkey", big(F.size(raised)).alias("n"))


@query(
    "rul_mode_profile",
    "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'forensic_strict' WHEN o_orderkey % 3 = 1 AND o_custkey % 5 <> 0 THEN 'triage_fast' ELSE 'custom' END AS profile, count(*)::BIGINT AS n FROM orders GROUP BY 1",
)
def rul_mode_profile(spark, sf):
    strict, fast = trust.MODE_PROFILES["forensic_strict"], trust.MODE_PROFILES["triage_fast"]
    case = F.col("o_orderkey") % 3
    columns = [
        F.when(case == 0, F.lit(strict[name])).when(case == 1, F.lit(fast[name])).alias(name) for name in strict
    ]
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", *columns).withColumn(
        "trace_max_entries",
        F.when((case == 1) & (F.col("o_custkey") % 5 == 0), F.lit(1)).otherwise(F.col("trace_max_entries")),
    )
    return rows.groupBy(trust.mode_profile().alias("profile")).agg(F.count("*").alias("n"))


@query(
    "rul_completeness",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 2 WHEN o_orderkey % 100 >= 90 THEN 1 WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS level, o_orderkey % 7 = 0 AS is_losing_data,
       CASE WHEN o_orderkey % 7 = 0 THEN '⚠ Index full — 3 oldest event(s) dropped from memory' WHEN o_orderkey % 100 >= 90 THEN 'Index ~' || (o_orderkey % 100) || '% full — eviction imminent'
         WHEN o_orderkey % 5 = 0 THEN 'Live view dropped 2 render event(s)' ELSE 'Collection complete' END AS headline FROM orders""",
)
def rul_completeness(spark, sf):
    k = F.col("o_orderkey")
    status = trust.completeness(
        big(k % 100), F.lit(100), F.when(k % 7 == 0, F.lit(3)).otherwise(F.lit(0)), F.when(k % 5 == 0, F.lit(2)).otherwise(F.lit(0))
    )
    rows = table(spark, sf, "orders").select("o_orderkey", status.alias("s"))
    return rows.select("o_orderkey", big(F.col("s.level")).alias("level"), "s.is_losing_data", "s.headline")


@query(
    "rul_consistency_scope",
    """SELECT o_custkey, CASE WHEN count(*) FILTER (taken) = 0 THEN 'SingleLive' WHEN count(*) FILTER (taken) = count(*) THEN 'SingleSnapshot' ELSE 'Mixed' END AS consistency_scope, count(*)::BIGINT AS hive_count
       FROM (SELECT o_custkey, o_orderpriority, bool_or(o_orderkey % 2 = 0) AS taken FROM orders GROUP BY ALL) GROUP BY o_custkey""",
)
def rul_consistency_scope(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("hive_path"),
        (F.col("o_orderkey") % 2 == 0).alias("from_snapshot"),
    )
    return trust.consistency_scope(rows, ["o_custkey"])


def _burst(spark, sf):
    """Events squeezed into few seconds, so that limits bite."""
    ev = activity(spark, sf)
    return ev.withColumn("ts", F.timestamp_seconds(F.call_function("div", F.col("ingest_seq"), F.lit(500)) + 1_700_000_000))


_LIMIT = "CASE category WHEN 'File' THEN 50 WHEN 'Network' THEN 30 END"


@query(
    "win_throttle",
    with_ev(f"""SELECT seq FROM (SELECT seq, {_LIMIT} AS lim, row_number() OVER (PARTITION BY host, category, seq // 500 ORDER BY seq) AS rn FROM ev) WHERE lim IS NULL OR rn <= lim""").replace("50 WHEN 'Network' THEN 30", "10 WHEN 'Network' THEN 5"),
)
def win_throttle(spark, sf):
    return windows.throttle(_burst(spark, sf), limits={"File": 10, "Network": 5}).select(_seq())


ANCHORED_LIMITS = {"File": 2, "Network": 1}

# The anchored walk, one event per host and category and step; limits are 2 and 1 per second.
ANCHORED_SQL = f"""WITH RECURSIVE {EV}, t AS (SELECT host, category, seq, 1700000000000000 + seq * 20000 - CASE WHEN seq % 11 = 0 THEN 400000 ELSE 0 END AS us, CASE category WHEN 'File' THEN 2 WHEN 'Network' THEN 1 ELSE 0 END AS lim,
    row_number() OVER (PARTITION BY host, category ORDER BY seq) AS rn FROM ev),
  a(host, category, rn, seq, started, n, dropped, reported, warn) AS (
    SELECT host, category, rn, seq, us, 1, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM t WHERE rn = 1 AND lim > 0
    UNION ALL SELECT host, category, rn, seq, CASE WHEN fresh THEN us ELSE started END, CASE WHEN fresh THEN 1 ELSE n + 1 END,
      CASE WHEN due THEN 0 ELSE dropped END + CASE WHEN NOT fresh AND n + 1 > lim THEN 1 ELSE 0 END, CASE WHEN due THEN us ELSE reported END, CASE WHEN due THEN dropped END
    FROM (SELECT t.host, t.category, t.rn, t.seq, t.us, t.lim, a.started, a.n, a.dropped, a.reported, t.us - a.started >= 1000000 AS fresh,
        t.us - a.started >= 1000000 AND a.dropped > 0 AND (a.reported IS NULL OR t.us - a.reported >= 5000000) AS due
      FROM a JOIN t ON t.host = a.host AND t.category = a.category AND t.rn = a.rn + 1))
  SELECT seq, category, 'pass' AS kind, NULL::BIGINT AS dropped FROM t WHERE lim = 0
  UNION ALL SELECT a.seq, a.category, 'pass', NULL FROM a JOIN t ON t.seq = a.seq WHERE a.n <= t.lim
  UNION ALL SELECT seq, category, 'warning', warn FROM a WHERE warn IS NOT NULL"""


def anchored_feed(spark, sf):
    """An event every 20 milliseconds; one in eleven is stamped 400 milliseconds early."""
    i = F.col("ingest_seq")
    stamp = F.lit(1_700_000_000_000_000) + i * 20_000 - F.when(i % 11 == 0, F.lit(400_000)).otherwise(F.lit(0))
    return activity(spark, sf).select("host", "category", "ingest_seq", F.timestamp_micros(stamp).alias("ts"))


@query("win_throttle_anchored", ANCHORED_SQL)
def win_throttle_anchored(spark, sf):
    """Windows from their first event on, with drop reports."""
    kept, _ = throttled(anchored_feed(spark, sf), ANCHORED_LIMITS)
    return kept.select(_seq(), "category", "kind", "dropped")


@query(
    "win_throttle_drops",
    with_ev("""SELECT host, category, (1700000000 + seq // 500) * 1000000 AS us, (count(*) - CASE category WHEN 'File' THEN 10 ELSE 5 END)::BIGINT AS dropped FROM ev WHERE category IN ('File', 'Network')
      GROUP BY host, category, seq // 500 HAVING count(*) > CASE category WHEN 'File' THEN 10 ELSE 5 END"""),
)
def win_throttle_drops(spark, sf):
    drops = windows.throttle_drops(_burst(spark, sf), limits={"File": 10, "Network": 5})
    return drops.select("host", "category", us(F.col("ts")).alias("us"), "dropped")


@query("win_evict", with_ev("SELECT seq FROM ev ORDER BY seq DESC LIMIT 3000"))
def win_evict(spark, sf):
    return keep_newest(activity(spark, sf), 3000).select(_seq())


@query("win_evict_count", with_ev("SELECT host, greatest(count(*) - 700, 0)::BIGINT AS evicted FROM ev GROUP BY host"))
def win_evict_count(spark, sf):
    return evicted(activity(spark, sf), 700, ("host",))


@query("win_evict_hosts", with_ev("SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY host ORDER BY seq DESC) AS rn FROM ev) WHERE rn <= 700"))
def win_evict_hosts(spark, sf):
    return keep_newest(activity(spark, sf), 700, keys=("host",)).select(_seq())


@query("win_export_cap", with_ev("SELECT seq FROM ev ORDER BY seq LIMIT 2500"))
def win_export_cap(spark, sf):
    return keep_first(activity(spark, sf), 2500).select(_seq())


@query(
    "win_newest_dedup",
    with_ev("SELECT event_key, min(seq) AS seq FROM (SELECT category || '.' || user_id || '.' || (k % 10) AS event_key, seq FROM ev) GROUP BY event_key ORDER BY seq DESC LIMIT 1000"),
)
def win_newest_dedup(spark, sf):
    key = F.concat_ws(".", F.col("category"), (F.col("subject_process.pid") - 1).cast("string"), (field(F.col("fields"), "k").cast("int") % 10).cast("string"))
    return windows.newest_distinct(activity(spark, sf), key).select("event_key", _seq())


@query(
    "win_wmi_lookahead",
    with_ev("""SELECT a.seq, coalesce(string_agg(b.event_type, ',' ORDER BY b.seq), '') AS ahead FROM ev a LEFT JOIN ev b ON b.seq BETWEEN a.seq + 1 AND a.seq + 10 WHERE a.event_type = 'signup' GROUP BY a.seq"""),
)
def win_wmi_lookahead(spark, sf):
    rows = raw_events(spark, sf).select(F.lit("f").alias("file"), F.col("event_id").alias("seq"), "event_type")
    found = windows.lookahead(rows, ["file"], "seq", F.col("event_type") == "signup", "event_type", 10, "ahead")
    return found.select("seq", F.array_join("ahead", ",").alias("ahead"))


def _wmi_runs(spark, sf):
    """A repository image per customer: a binding, a filter with its query, a consumer and class noise."""
    key = F.col("c_custkey").cast("string")
    texts = F.array(
        F.lit("__FilterToConsumerBinding"), F.lit("noise"),
        F.concat(F.lit('CommandLineEventConsumer.Name="c'), key, F.lit('"')),
        F.concat(F.lit('__EventFilter.Name="f'), key, F.lit('"')),
        F.lit("filler one"), F.lit("filler two"), F.lit("filler three"), F.lit("filler four"), F.lit("filler five"), F.lit("filler six"), F.lit("filler seven"),
        F.lit("__EventFilter"), F.lit("root\\cimv2"), F.concat(F.lit("f"), key), F.lit("SELECT * FROM Win32_Thing"), F.lit("WQL"),
        F.lit("__EventFilter"), F.lit("Query"), F.lit("string"),
    )
    return table(spark, sf, "customer").select(
        F.lit("H0").alias("host"), F.concat(F.lit("o"), key).alias("file"), F.posexplode(texts).alias("pos", "run")
    )


_WMI_SQL = """SELECT 'o' || c_custkey AS file, 'Binding' AS kind, 'c' || c_custkey AS consumer_name, 'f' || c_custkey AS filter_name, NULL AS name, NULL AS query, NULL AS query_language FROM customer
  UNION ALL SELECT 'o' || c_custkey, 'Filter', NULL, NULL, 'f' || c_custkey, 'SELECT * FROM Win32_Thing', 'WQL' FROM customer
  UNION ALL SELECT 'o' || c_custkey, 'Consumer', 'c' || c_custkey, NULL, NULL, NULL, NULL FROM customer"""


@query("src_wmi_subscriptions", _WMI_SQL)
def src_wmi_subscriptions(spark, sf):
    return wmi.subscriptions(_wmi_runs(spark, sf)).select("file", "kind", "consumer_name", "filter_name", "name", "query", "query_language")


@query(
    "fn_wmi_event",
    """SELECT summary, count(*)::BIGINT AS n FROM (SELECT 'WMI binding: consumer ''c' || c_custkey || ''' (CommandLineEventConsumer) ← filter ''f' || c_custkey || '''' AS summary FROM customer
       UNION ALL SELECT 'WMI filter ''f' || c_custkey || ''': SELECT * FROM Win32_Thing' FROM customer UNION ALL SELECT 'WMI consumer ''c' || c_custkey || ''' (CommandLineEventConsumer)' FROM customer) GROUP BY summary""",
)
def fn_wmi_event(spark, sf):
    runs = _wmi_runs(spark, sf)
    anchors = runs.select("host", "file").distinct().withColumn("anchor", F.lit("2024-01-01").cast("timestamp"))
    return shapes.subscription_events(runs, anchors).groupBy("summary").agg(F.count("*").alias("n"))


@query(
    "fn_bits_event",
    r"""SELECT page_id AS seq, CASE WHEN page_id % 2 = 0 THEN 'Network' ELSE 'System' END AS category,
        CASE WHEN page_id % 2 = 1 THEN 'BITS job: Job ' || page_id WHEN page_id % 3 = 0 THEN 'BITS download: ' || url ELSE 'BITS download: ' || url || ' → C:\dl\p' || page_id END AS summary FROM pages""",
)
def fn_bits_event(spark, sf):
    key = F.col("page_id").cast("string")
    local = F.when(F.col("page_id") % 3 == 0, F.lit("x")).otherwise(F.concat(F.lit("C:\\dl\\p"), key))
    nul = F.unhex(F.lit("0000"))
    raw = joined_bytes(*[part for p in (F.col("url"), local, F.concat(F.lit("Job "), key)) for part in (F.encode(p, "UTF-16LE"), nul)])
    rows = table(spark, sf, "pages").select(
        F.lit("H0").alias("host"), F.col("page_id").alias("ingest_seq"), F.lit("q.db").alias("database"),
        F.when(F.col("page_id") % 2 == 0, F.lit("File")).otherwise(F.lit("Job")).alias("kind"), key.alias("record_id"), raw.alias("blob"),
        F.lit("2024-01-01").cast("timestamp").alias("anchor"),
    )
    return shapes.transfer_events(rows).select(_seq(), "category", "summary")


def _connection_snapshots(spark, sf):
    """Orders as observations: a connection per customer, a snapshot per month."""
    month = F.months_between(F.trunc(F.col("o_orderdate").cast("date"), "month"), F.lit("1990-01-01").cast("date")).cast("bigint")
    key = F.col("o_custkey") % 100
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("H"), (key % 3).cast("string")).alias("host"),
        month.alias("m"),
        F.when(key % 4 == 0, F.lit("UDP")).otherwise(F.lit("TCP")).alias("protocol"),
        F.concat(F.lit("10.0.0."), key.cast("string"), F.lit(":1")).alias("local_ep"),
        F.lit("1.1.1.1:2").alias("remote_ep"),
        key.alias("pid"),
        F.col("o_orderstatus").alias("state"),
    )
    seen = rows.groupBy("host", "m", "protocol", "local_ep", "remote_ep", "pid").agg(F.max("state").alias("state"))
    stamped = seen.withColumn("snapshot_ts", F.timestamp_seconds(F.col("m") * 600))
    return transitions.number_snapshots(stamped)


_SNAPS = """o AS (SELECT 'H' || ((o_custkey % 100) % 3) AS host, o_custkey % 100 AS pid, CASE WHEN (o_custkey % 100) % 4 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
    ((year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1)::BIGINT AS m, max(o_orderstatus) AS state FROM orders GROUP BY ALL),
  cal AS (SELECT host, m, row_number() OVER (PARTITION BY host ORDER BY m) AS n FROM (SELECT DISTINCT host, m FROM o)),
  x AS (SELECT o.*, cal.n, (o.m * 600) // 3600 AS b FROM o JOIN cal ON o.host = cal.host AND o.m = cal.m)"""


@query(
    "win_conn_transitions",
    f"""WITH {_SNAPS}, j AS (SELECT coalesce(c.host, p.host) AS host, coalesce(c.pid, p.pid) AS pid, coalesce(c.protocol, p.protocol) AS protocol, coalesce(c.n, p.n + 1) AS n,
           c.state AS cs, p.state AS ps, c.b AS cb, p.b AS pb, c.pid IS NOT NULL AS here, p.pid IS NOT NULL AS was
         FROM x c FULL JOIN x p ON c.host = p.host AND c.pid = p.pid AND c.n = p.n + 1),
       k AS (SELECT j.* FROM j JOIN cal ON j.host = cal.host AND j.n = cal.n),
       e AS (SELECT host, pid, n, CASE WHEN protocol = 'UDP' THEN 'Listen' ELSE 'Connect' END AS action, cs AS state FROM k WHERE here AND (NOT was OR cb <> pb)
         UNION ALL SELECT host, pid, n, 'Disconnect', 'Unknown' FROM k WHERE was AND (NOT here OR cb <> pb)
         UNION ALL SELECT host, pid, n, 'Update', cs FROM k WHERE here AND was AND cb = pb AND protocol = 'TCP' AND cs <> ps)
       SELECT host, pid, n::BIGINT AS snapshot_id, action, state FROM e""",
)
def win_conn_transitions(spark, sf):
    return transitions.connection_transitions(_connection_snapshots(spark, sf)).select("host", "pid", "snapshot_id", "action", "state")


@query(
    "fn_connection_event",
    f"""WITH {_SNAPS}, j AS (SELECT coalesce(c.host, p.host) AS host, coalesce(c.n, p.n + 1) AS n, coalesce(c.protocol, p.protocol) AS protocol, c.state AS cs, p.state AS ps, c.b AS cb, p.b AS pb, c.pid IS NOT NULL AS here, p.pid IS NOT NULL AS was
         FROM x c FULL JOIN x p ON c.host = p.host AND c.pid = p.pid AND c.n = p.n + 1),
       k AS (SELECT j.* FROM j JOIN cal ON j.host = cal.host AND j.n = cal.n),
       e AS (SELECT protocol, CASE WHEN protocol = 'UDP' THEN 'Listen' ELSE 'Connect' END AS action FROM k WHERE here AND (NOT was OR cb <> pb)
         UNION ALL SELECT protocol, 'Disconnect' FROM k WHERE was AND (NOT here OR cb <> pb)
         UNION ALL SELECT protocol, 'Update' FROM k WHERE here AND was AND cb = pb AND protocol = 'TCP' AND cs <> ps)
       SELECT 'Network ' || lower(action) || ': ' || protocol AS head, count(*)::BIGINT AS n FROM e GROUP BY 1""",
)
def fn_connection_event(spark, sf):
    events = shapes.connection_events(transitions.connection_transitions(_connection_snapshots(spark, sf)))
    head = F.regexp_extract("summary", r"^(Network \w+: \w+)", 1)
    return events.groupBy(head.alias("head")).agg(F.count("*").alias("n"))


def _process_snapshots(spark, sf):
    """The same observations as process lists; the create time changes with the status and is sometimes unknown."""
    rows = _connection_snapshots(spark, sf)
    known = F.when(
        F.col("snapshot_id") % 5 != 0, F.timestamp_seconds(F.lit(1000) * F.ascii("state") + F.col("pid"))
    )
    return rows.select("host", "snapshot_id", "snapshot_ts", "pid", known.alias("create_time"))


_PROC = f"""{_SNAPS}, y AS (SELECT host, pid, n, m * 600 AS t, CASE WHEN n % 5 <> 0 THEN 1000 * ascii(state) + pid END AS ct FROM x),
  r AS (SELECT *, sum(CASE WHEN n = prev + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY host, pid ORDER BY n) AS run FROM (SELECT *, lag(n) OVER (PARTITION BY host, pid ORDER BY n) AS prev FROM y)),
  f AS (SELECT host, pid, n, coalesce(last_value(ct IGNORE NULLS) OVER w, first_value(t) OVER w) AS eff FROM r WINDOW w AS (PARTITION BY host, pid, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  j AS (SELECT coalesce(c.host, p.host) AS host, coalesce(c.pid, p.pid) AS pid, coalesce(c.n, p.n + 1) AS n, c.eff AS now, p.eff AS before FROM f c FULL JOIN f p ON c.host = p.host AND c.pid = p.pid AND c.n = p.n + 1),
  k AS (SELECT j.* FROM j JOIN cal ON j.host = cal.host AND j.n = cal.n),
  e AS (SELECT host, pid, n, 'Start' AS action, now AS created FROM k WHERE now IS NOT NULL AND (before IS NULL OR now <> before)
    UNION ALL SELECT host, pid, n, 'Stop', before FROM k WHERE before IS NOT NULL AND (now IS NULL OR now <> before))"""


@query("win_proc_transitions", f"WITH {_PROC} SELECT host, pid, n::BIGINT AS snapshot_id, action, (created * 1000000)::BIGINT AS created_us FROM e")
def win_proc_transitions(spark, sf):
    return transitions.process_transitions(_process_snapshots(spark, sf)).select(
        "host", "pid", "snapshot_id", "action", us(F.col("create_time")).alias("created_us")
    )


@query(
    "fn_process_event",
    f"WITH {_PROC} SELECT CASE action WHEN 'Start' THEN 'Process started: PID ' ELSE 'Process stopped: PID ' END || pid AS summary, count(*)::BIGINT AS n FROM e GROUP BY 1",
)
def fn_process_event(spark, sf):
    events = shapes.process_events(transitions.process_transitions(_process_snapshots(spark, sf)))
    return events.groupBy("summary").agg(F.count("*").alias("n"))


def _pid_events(spark, sf):
    """Sign-ups state a create time, errors stop, one user in ten is long-lived."""
    ev = raw_events(spark, sf)
    return ev.select(
        F.lit("H0").alias("host"),
        F.col("user_id").alias("pid"),
        F.col("event_id").alias("ingest_seq"),
        "ts",
        F.when((F.col("event_type") == "signup") & (F.col("k") % 3 != 0), F.timestamp_micros(us(F.col("ts")) - 60_000_000)).alias("create_hint"),
        ((F.col("event_type") == "error") & (F.col("k") % 4 == 0)).alias("is_stop"),
        (F.col("k") % 10 == 0).alias("is_long_lived"),
    )


# The walk itself, one event per pid and step.
_WALK = """e AS (SELECT user_id AS pid, seq, us, CASE WHEN event_type = 'signup' AND k % 3 <> 0 THEN us - 60000000 END AS hint, event_type = 'error' AND k % 4 = 0 AS stop, k % 10 = 0 AS ll,
    row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM ev),
  w(pid, rn, seq, created, seen, kind, how, life, stop) AS (
    SELECT pid, rn, seq, coalesce(hint, us), us, CASE WHEN ll THEN 'l' WHEN hint IS NOT NULL THEN 'a' ELSE 'p' END, CASE WHEN hint IS NOT NULL THEN 'explicit' ELSE 'provisional' END, seq, stop FROM e WHERE rn = 1
    UNION ALL
    SELECT e.pid, e.rn, e.seq,
      CASE WHEN e.hint IS NOT NULL THEN e.hint WHEN NOT w.stop AND e.us - w.seen <= CASE w.kind WHEN 'l' THEN 10080 WHEN 'a' THEN 1440 ELSE 720 END * 60000000::BIGINT THEN w.created ELSE e.us END,
      e.us,
      CASE WHEN e.hint IS NOT NULL THEN CASE WHEN e.ll THEN 'l' ELSE 'a' END WHEN NOT w.stop AND e.us - w.seen <= CASE w.kind WHEN 'l' THEN 10080 WHEN 'a' THEN 1440 ELSE 720 END * 60000000::BIGINT THEN w.kind WHEN e.ll THEN 'l' ELSE 'p' END,
      CASE WHEN e.hint IS NOT NULL THEN 'explicit' WHEN NOT w.stop AND e.us - w.seen <= CASE w.kind WHEN 'l' THEN 10080 WHEN 'a' THEN 1440 ELSE 720 END * 60000000::BIGINT THEN 'cached' ELSE 'provisional' END,
      CASE WHEN e.hint IS NULL AND NOT w.stop AND e.us - w.seen <= CASE w.kind WHEN 'l' THEN 10080 WHEN 'a' THEN 1440 ELSE 720 END * 60000000::BIGINT THEN w.life ELSE e.seq END,
      e.stop
    FROM w JOIN e ON e.pid = w.pid AND e.rn = w.rn + 1)"""
_RECURSIVE_EV = "WITH RECURSIVE " + EV


@query("jn_asof_process", f"{_RECURSIVE_EV}, {_WALK} SELECT pid, seq, created AS created_us, how AS resolution FROM w")
def jn_asof_process(spark, sf):
    resolved = asof.resolve_process_keys(_pid_events(spark, sf))
    return resolved.select("pid", _seq(), us(F.col("process_create_time")).alias("created_us"), "resolution")


@query(
    "agg_key_cache_stats",
    f"""{_RECURSIVE_EV}, {_WALK}, z AS (SELECT w.*, max(rn) OVER (PARTITION BY pid) AS last FROM w), f AS (SELECT * FROM z WHERE rn = last AND NOT stop)
        SELECT 'H0' AS host, count(*)::BIGINT AS total_entries, count(*) FILTER (b.how = 'provisional')::BIGINT AS provisional_entries, count(*) FILTER (b.kind = 'l')::BIGINT AS long_lived_entries
        FROM f JOIN w b ON f.pid = b.pid AND f.life = b.seq""",
)
def agg_key_cache_stats(spark, sf):
    return asof.cache_stats(asof.resolve_process_keys(_pid_events(spark, sf)))

"""Artifact decoders and event shapes over blobs and texts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import artifacts, bags, paths, registry, text, times, transfers
from ..functions.bags import field
from ..functions.blobs import shell_items, shim_cache_entries
from ..operators.enrich import with_dest_list
from ..operators.filters import startup_entries
from ..operators.processes import is_os_process
from ..schema import string_map
from ..sources import artifacts as shapes
from ..sources import mft, texts
from .base import big, iso_sql, joined_bytes, le_binary, padded_utf16, query, raw_events, spread, table, ticks, us

_TOKENS = ["the", "tion", "license", "password", "http", "@", "key", "-enc", "hidden"]
_TOKEN_LIST = "[" + ", ".join(f"'{t}'" for t in _TOKENS) + "]"
_DEFAULT_LIST = "[" + ", ".join(f"'{t}'" for t in text.SUSPICIOUS_TOKENS) + "]"


@query(
    "fn_suspicious_keywords",
    f"""SELECT doc_id, array_to_string(list_filter({_TOKEN_LIST}, lambda w: contains(lower(text), w)), ',') AS words,
        array_to_string(list_filter({_DEFAULT_LIST}, lambda w: contains(lower(text), w)), ',') AS offensive FROM documents""",
)
def fn_suspicious_keywords(spark, sf):
    body = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.array_join(text.suspicious_keywords(body, _TOKENS), ",").alias("words"),
        F.array_join(text.suspicious_keywords(body), ",").alias("offensive"),
    )


@query(
    "fn_rot13",
    """SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
       'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')) AS digest FROM documents""",
)
def fn_rot13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.rot13(F.col("text"))).alias("digest"))


def _spaced_hex(raw):
    return F.regexp_replace(F.hex(raw), r"(..)(?!$)", "$1 ")


@query(
    "fn_decode_utf16_hex",
    "SELECT conv_id, turn, md5(text) AS decoded, 'plain ' || role AS kept FROM conversations",
)
def fn_decode_utf16_hex(spark, sf):
    encoded = _spaced_hex(F.encode("text", "UTF-16LE"))
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.md5(registry.decode_utf16_hex(encoded)).alias("decoded"),
        registry.decode_utf16_hex(F.concat(F.lit("plain "), F.col("role"))).alias("kept"),
    )


@query(
    "fn_decode_dword",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey WHEN 2 THEN p_partkey - 2147483648 END AS number FROM part",
)
def fn_decode_dword(spark, sf):
    n, case = F.col("p_partkey"), F.col("p_partkey") % 4
    raw = (
        F.when(case == 0, n.cast("string"))
        .when(case == 1, _spaced_hex(le_binary(n, 4)))
        .when(case == 2, _spaced_hex(le_binary(n + 2**31, 4)))
        .otherwise(F.lit("01 02"))
    )
    return table(spark, sf, "part").select("p_partkey", registry.decode_dword(raw).alias("number"))


@query(
    "fn_hex_display",
    r"""WITH h AS (SELECT doc_id, rtrim(regexp_replace(hex(text), '(..)', '\1 ', 'g')) AS h FROM documents)
        SELECT doc_id, CASE WHEN length(h) > 200 THEN left(h, 200) || '...' ELSE h END AS display FROM h""",
)
def fn_hex_display(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", registry.hex_display(F.encode("text", "UTF-8")).alias("display")
    )


@query(
    "fn_userassist",
    """WITH e AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
       SELECT event_id, event_type AS decoded_name, CASE WHEN event_id % 4 = 0 THEN cents END AS focus_count,
         CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN k ELSE 0 END AS run_count, epoch_us(ts) AS us
       FROM e WHERE event_id % 4 <> 3""",
)
def fn_userassist(spark, sf):
    case, stamp = F.col("event_id") % 4, ticks(F.col("ts"))
    new = joined_bytes(le_binary(F.col("cents"), 4), le_binary(F.col("k"), 4), le_binary(stamp, 8))
    old = joined_bytes(le_binary(F.col("k"), 4), le_binary(stamp, 8), le_binary(F.lit(0), 4))
    bare = le_binary(stamp, 8)
    raw = F.when(case == 0, new).when(case == 1, old).when(case == 2, bare).otherwise(le_binary(F.lit(0), 16))
    blobs = raw_events(spark, sf).select("event_id", "event_type", raw.alias("raw"))
    rows = blobs.select("event_id", registry.userassist(text.rot13(F.col("event_type")), F.col("raw")).alias("u"))
    return rows.where(F.col("u").isNotNull()).select(
        "event_id", "u.decoded_name", "u.focus_count", "u.run_count", us(F.col("u.last_execution")).alias("us")
    )


@query(
    "fn_bam",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'BAM' ELSE 'DAM' END AS component, 'S-1-5-21-' || user_id AS sid,
         CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) END AS us FROM events WHERE event_id % 5 <> 0""",
)
def fn_bam(spark, sf):
    i, user = F.col("event_id"), F.col("user_id").cast("string")
    service = F.when(i % 2 == 0, F.lit("bam")).otherwise(F.lit("DAM"))
    leaf = F.when(i % 5 == 0, F.lit("Other")).otherwise(F.concat(F.lit("S-1-5-21-"), user))
    key = F.concat(F.lit("ControlSet001\\Services\\"), service, F.lit("\\State\\UserSettings\\"), leaf)
    name = F.when(i % 3 == 0, F.lit("Version")).otherwise(F.lit("\\Device\\HarddiskVolume3\\a.exe"))
    raw = joined_bytes(le_binary(ticks(F.col("ts")), 8), le_binary(F.lit(0), 16))
    values = raw_events(spark, sf).select("event_id", key.alias("key"), name.alias("name"), raw.alias("raw"))
    rows = values.select(
        "event_id",
        registry.bam_component(F.col("key")).alias("component"),
        paths.leaf_segment(F.col("key")).alias("sid"),
        us(registry.bam_last_execution(F.col("name"), F.col("raw"))).alias("us"),
    )
    return rows.where(F.col("component").isNotNull())


@query(
    "fn_taskcache",
    """SELECT event_id, '{' || user_id || '}' AS guid, epoch_us(ts) AS created_us,
         CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) + 5000000 END AS last_run_us,
         CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) + 9000000 END AS success_us,
         CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) + 5000000 ELSE epoch_us(ts) END AS primary_us FROM events""",
)
def fn_taskcache(spark, sf):
    i, base = F.col("event_id"), ticks(F.col("ts"))
    key = F.concat(
        F.lit("Microsoft\\Windows NT\\CurrentVersion\\Schedule\\TaskCache\\Tasks\\{"), F.col("user_id").cast("string"), F.lit("}")
    )
    last_run = F.when(i % 3 == 0, F.lit(0).cast("bigint")).otherwise(base + 50_000_000)
    short = joined_bytes(le_binary(F.lit(3), 4), le_binary(base, 8), le_binary(last_run, 8))
    long = joined_bytes(short, le_binary(F.lit(0), 8), le_binary(base + 90_000_000, 8))
    raw = F.when(i % 2 == 0, long).otherwise(short)
    values = spread(raw_events(spark, sf).select("event_id", "user_id", "ts")).select("event_id", key.alias("key"), raw.alias("raw"))
    t = registry.task_cache_times(F.col("raw"))
    rows = values.select("event_id", registry.task_cache_guid(F.col("key")).alias("guid"), t.alias("t"))
    return rows.select(
        "event_id",
        "guid",
        us(F.col("t.created")).alias("created_us"),
        us(F.col("t.last_run")).alias("last_run_us"),
        us(F.col("t.last_success")).alias("success_us"),
        us(F.coalesce("t.last_run", "t.created")).alias("primary_us"),
    )


@query(
    "fn_shimcache",
    r"""SELECT event_id, 'C:\Apps\' || event_type || '.exe' AS path, epoch_us(ts) AS modified_us, epoch_us(ts) + 1000000 AS updated_us, 'Win7_552' AS format FROM events
        UNION ALL SELECT event_id, 'C:\Users\u' || user_id || '\b.exe', epoch_us(ts) + 2000000, NULL, 'Win7_552' FROM events""",
)
def fn_shimcache(spark, sf):
    base = ticks(F.col("ts"))
    entry = lambda path, modified, updated: joined_bytes(
        padded_utf16(path, 520), le_binary(modified, 8), le_binary(updated, 8), le_binary(F.lit(0), 16)
    )
    first = entry(F.concat(F.lit("C:\\Apps\\"), F.col("event_type"), F.lit(".exe")), base, base + 10_000_000)
    second = entry(
        F.concat(F.lit("C:\\Users\\u"), F.col("user_id").cast("string"), F.lit("\\b.exe")), base + 20_000_000, F.lit(0)
    )
    raw = joined_bytes(le_binary(F.lit(0), 128), first, second)
    rows = spread(raw_events(spark, sf)).select("event_id", F.explode(shim_cache_entries(raw)).alias("e"))
    return rows.select(
        "event_id",
        "e.path",
        us(times.filetime(F.col("e.modified_ticks"))).alias("modified_us"),
        us(times.filetime(F.col("e.updated_ticks"))).alias("updated_us"),
        "e.format",
    )


@query(
    "fn_recentdocs",
    r"""SELECT p_partkey, 'C:\docs' || p_size || '\' || replace(p_name, ' ', '_') || '.txt' AS parsed_path,
        replace(p_name, ' ', '_') || '.txt' AS file_name, 2::BIGINT AS item_count, '0x32,0x32' AS item_types FROM part""",
)
def fn_recentdocs(spark, sf):
    def item(path):
        body = joined_bytes(F.unhex(F.lit("3200")), F.encode(path, "US-ASCII"), F.unhex(F.lit("00")))
        return joined_bytes(le_binary(F.octet_length(body) + 2, 2), body)

    folder = F.concat(F.lit("C:\\docs"), F.col("p_size").cast("string"))
    leaf = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".txt"))
    raw = joined_bytes(item(folder), item(leaf), F.unhex(F.lit("0000")))
    rows = table(spark, sf, "part").select("p_partkey", shell_items(raw).alias("s"))
    return rows.select(
        "p_partkey", "s.parsed_path", "s.file_name", big(F.col("s.item_count")).alias("item_count"), "s.item_types"
    )


@query(
    "fn_mru_order",
    """SELECT p_partkey, 0::BIGINT AS rank, p_size::BIGINT AS value_id FROM part
       UNION ALL SELECT p_partkey, 1, (p_size + 1)::BIGINT FROM part WHERE p_partkey % 2 = 0
       UNION ALL SELECT p_partkey, 2, 7 FROM part WHERE p_partkey % 2 = 0""",
)
def fn_mru_order(spark, sf):
    size = F.col("p_size")
    end = le_binary(F.lit(2**32 - 1), 4)
    tail = F.when(
        F.col("p_partkey") % 2 == 0, joined_bytes(le_binary(size + 1, 4), le_binary(F.lit(7), 4), end)
    ).otherwise(end)
    raw = joined_bytes(le_binary(size, 4), tail, le_binary(F.lit(9), 4))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(registry.mru_order(raw)).alias("rank", "value_id")).select(
        "p_partkey", big(F.col("rank")).alias("rank"), "value_id"
    )


@query(
    "fn_enrich_services",
    """SELECT p_partkey, 'Services' AS decoded, 'svc' || p_size AS service_name, 'ControlSet00' || (p_partkey % 2 + 1) AS control_set,
         CASE p_partkey % 4 WHEN 0 THEN CASE p_size % 6 WHEN 0 THEN 'Boot' WHEN 1 THEN 'System' WHEN 2 THEN 'Auto' WHEN 3 THEN 'Manual' WHEN 4 THEN 'Disabled' ELSE 'Other' END END AS start_label,
         CASE p_partkey % 4 WHEN 1 THEN CASE p_size WHEN 1 THEN 'KernelDriver' WHEN 2 THEN 'FileSystemDriver' WHEN 16 THEN 'OwnProcess' WHEN 32 THEN 'ShareProcess' ELSE 'Other' END END AS type_label,
         CASE p_partkey % 4 WHEN 2 THEN p_name END AS image_path
       FROM part WHERE p_partkey % 4 <> 3""",
)
def fn_enrich_services(spark, sf):
    case, size = F.col("p_partkey") % 4, F.col("p_size")
    key = F.concat(
        F.lit("ControlSet00"), (F.col("p_partkey") % 2 + 1).cast("string"), F.lit("\\Services\\svc"), size.cast("string")
    )
    name = F.element_at(F.array(*[F.lit(x) for x in ("Start", "Type", "ImagePath", "Custom")]), (case + 1).cast("int"))
    data = F.when(case == 0, (size % 6).cast("string")).when(case == 1, size.cast("string")).otherwise(F.col("p_name"))
    pairs = registry.enrich_services(key, name, data)
    rows = table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in pairs.items()])
    return rows.where(F.col("OfflineHiveDecoded").isNotNull()).select(
        "p_partkey",
        F.col("OfflineHiveDecoded").alias("decoded"),
        F.col("ServiceName").alias("service_name"),
        F.col("ServiceControlSet").alias("control_set"),
        F.col("ServiceStartTypeLabel").alias("start_label"),
        F.col("ServiceTypeLabel").alias("type_label"),
        F.col("ServiceImagePath").alias("image_path"),
    )


@query(
    "fn_enrich_startup_approved",
    f"""SELECT event_id, CASE event_id % 4 WHEN 2 THEN 'Disabled' WHEN 3 THEN 'Enabled' ELSE 'Unknown' END AS state,
          event_id % 4 AS first_byte, {iso_sql("ts")} AS hint FROM events""",
)
def fn_enrich_startup_approved(spark, sf):
    raw = joined_bytes(le_binary(F.col("event_id") % 4, 4), le_binary(ticks(F.col("ts")), 8))
    values = raw_events(spark, sf).select("event_id", "event_type", raw.alias("raw"))
    pairs = registry.enrich_startup_approved(F.col("event_type"), F.col("raw"))
    return values.select(
        "event_id",
        pairs["StartupApproved_State"].alias("state"),
        pairs["StartupApproved_FirstByte"].alias("first_byte"),
        pairs["StartupApproved_LastWriteHintUtc"].alias("hint"),
    )


@query(
    "fn_enrich_ifeo",
    """SELECT p_partkey, p_name || '.exe' AS target, CASE WHEN p_partkey % 3 = 0 THEN 'dbg' || p_size END AS debugger,
         CASE WHEN p_partkey % 3 = 1 THEN 'dbg' || p_size END AS global_flag FROM part WHERE p_partkey % 3 <> 2""",
)
def fn_enrich_ifeo(spark, sf):
    case = F.col("p_partkey") % 3
    name = F.when(case == 0, F.lit("debugger")).when(case == 1, F.lit("GlobalFlag")).otherwise(F.lit("Other"))
    key = F.concat(F.lit("Image File Execution Options\\"), F.col("p_name"), F.lit(".exe"))
    pairs = registry.enrich_ifeo(key, name, F.concat(F.lit(" dbg"), F.col("p_size").cast("string")))
    rows = table(spark, sf, "part").select(
        "p_partkey",
        pairs["IFEO_TargetImage"].alias("target"),
        pairs["IFEO_Debugger"].alias("debugger"),
        pairs["IFEO_GlobalFlag"].alias("global_flag"),
    )
    return rows.where(F.col("target").isNotNull())


@query(
    "fn_enrich_winlogon",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS shell, CASE WHEN p_partkey % 3 = 1 THEN p_name END AS userinit
       FROM part WHERE p_partkey % 3 <> 2""",
)
def fn_enrich_winlogon(spark, sf):
    case = F.col("p_partkey") % 3
    name = F.when(case == 0, F.lit("Shell")).when(case == 1, F.lit("USERINIT")).otherwise(F.lit("Nothing"))
    pairs = registry.enrich_winlogon(name, F.concat(F.col("p_name"), F.lit("  ")))
    rows = table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in pairs.items()])
    return rows.where(F.col("OfflineHiveDecoded") == "Winlogon").select(
        "p_partkey", F.col("Winlogon_Shell").alias("shell"), F.col("Winlogon_Userinit").alias("userinit")
    )


@query(
    "fn_enrich_family",
    """WITH d AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(133) || chr(160) || chr(8195) || chr(12288)) AS t FROM documents)
       SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'BITS' WHEN 1 THEN 'SRUM' ELSE 'WMI' END AS family,
         CASE WHEN doc_id % 4 = 0 AND t <> '' THEN md5(CASE WHEN length(t) > 200 THEN left(t, 200) || '…' ELSE t END) END AS bits_preview,
         CASE WHEN doc_id % 4 = 2 AND t <> '' THEN md5(CASE WHEN length(t) > 240 THEN left(t, 240) || '…' ELSE t END)
              WHEN doc_id % 4 = 3 AND t <> '' THEN md5(CASE WHEN length(t) > 120 THEN left(t, 120) || '…' ELSE t END) END AS wmi_preview
       FROM d""",
)
def fn_enrich_family(spark, sf):
    name = F.element_at(
        F.array(*[F.lit(x) for x in ("BitsClient", "SrumRegistry", "WmiCimom", "WmiNamespaceSecurity")]),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    pairs = registry.enrich_family(name, F.lit("A\\B"), F.lit("v"), F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id",
        pairs["OfflineArtifactFamily"].alias("family"),
        F.md5(pairs["Bits_ValuePreview"]).alias("bits_preview"),
        F.md5(pairs["Wmi_ValuePreview"]).alias("wmi_preview"),
    )


@query(
    "fn_bits_classify",
    r"""SELECT page_id, url AS urls, 'C:\dl\p' || page_id || '|\\srv\share' AS local_paths, 'S-1-5-21-' || page_id AS owner_sids,
        'Job ' || page_id AS names FROM pages""",
)
def fn_bits_classify(spark, sf):
    key = F.col("page_id").cast("string")
    local, job = F.concat(F.lit("C:\\dl\\p"), key), F.concat(F.lit("Job "), key)
    pieces = [
        F.col("url"), F.upper("url"), local, F.lit("\\\\srv\\share"), F.upper(local), F.concat(F.lit("S-1-5-21-"), key), job,
        F.lit("abc"), F.lit("漢字漢字漢"),
    ]
    nul = F.unhex(F.lit("0000"))
    raw = joined_bytes(*[part for p in pieces for part in (F.encode(p, "UTF-16LE"), nul)])
    rows = table(spark, sf, "pages").select(
        "page_id", transfers.classify_strings(transfers.utf16_strings(raw)).alias("s")
    )
    names = ["urls", "local_paths", "owner_sids", "names"]
    return rows.select("page_id", *[F.array_join(F.col(f"s.{n}"), "|").alias(n) for n in names])


@query(
    "fn_srum_strings",
    """SELECT s_suppkey, '!!' || s_name AS app, 'S-1-5-21-' || s_suppkey || '-' || (s_nationkey + 4000000000) AS sid FROM supplier""",
)
def fn_srum_strings(spark, sf):
    app = joined_bytes(F.encode(F.concat(F.lit("!!"), F.col("s_name")), "UTF-16LE"), F.unhex(F.lit("00004100")))
    sid = joined_bytes(
        F.unhex(F.lit("0103000000000005")),
        le_binary(F.lit(21), 4),
        le_binary(F.col("s_suppkey"), 4),
        le_binary(F.col("s_nationkey").cast("bigint") + 4_000_000_000, 4),
    )
    return table(spark, sf, "supplier").select(
        "s_suppkey", transfers.app_string(app).alias("app"), transfers.sid_string(sid).alias("sid")
    )


@query(
    "fn_task_path",
    r"""SELECT p_partkey, '\' || lower(p_brand) || '\' || lower(replace(p_name, ' ', '')) AS task_path FROM part""",
)
def fn_task_path(spark, sf):
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
    odd = F.col("p_partkey") % 2 == 1
    raw = F.when(odd, F.concat(F.lit("\\"), F.col("p_brand"), F.lit("\\"), name, F.lit("\\"))).otherwise(
        F.concat(F.lit(" "), F.upper("p_brand"), F.lit("/"), F.upper(name))
    )
    return table(spark, sf, "part").select("p_partkey", paths.task_path(raw).alias("task_path"))


@query(
    "fn_task_name_from_path",
    r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '\' || p_name ELSE '\' || p_brand || '\' || p_name END AS task_name FROM part""",
)
def fn_task_name_from_path(spark, sf):
    case = F.col("p_partkey") % 3
    path = (
        F.when(case == 0, F.concat(F.lit("C:\\Other\\"), F.col("p_name")))
        .when(case == 1, F.concat(F.lit("C:\\Windows\\System32\\Tasks\\"), F.col("p_brand"), F.lit("\\"), F.col("p_name")))
        .otherwise(F.concat(F.lit("/x/Tasks/y/tasks/"), F.col("p_brand"), F.lit("/"), F.col("p_name")))
    )
    return table(spark, sf, "part").select("p_partkey", paths.task_name_from_path(path).alias("task_name"))


def _task_files(spark, sf):
    """A task definition per part."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    date = F.when(key % 3 == 0, F.lit("<Date>2024-01-02T03:04:05</Date>")).otherwise(F.lit(""))
    start = F.when(
        key % 3 != 2, F.concat(F.lit("<StartBoundary>2024-02-0"), (key % 9 + 1).cast("string"), F.lit("T00:00:00Z</StartBoundary>"))
    ).otherwise(F.lit(""))
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-16"?><Task version="1.2"><RegistrationInfo>'), date,
        F.lit("<Author>"), F.col("p_brand"), F.lit("</Author></RegistrationInfo><Triggers><TimeTrigger>"), start,
        F.lit("<Enabled>false</Enabled></TimeTrigger><BootTrigger/></Triggers>"),
        F.lit("<Principals><Principal><UserId>S-1-5-18</UserId></Principal></Principals><Settings><Hidden>true</Hidden></Settings><Actions><ComHandler><ClassId>{"),
        size, F.lit("}</ClassId></ComHandler><Exec><Command>C:\\bin\\"), F.col("p_type"),
        F.lit(".exe</Command><Arguments>-a "), size, F.lit("</Arguments></Exec></Actions></Task>"),
    )
    broken = F.when(key % 10 == 9, F.substring(xml, 1, 200)).when(key % 10 == 8, F.lit("<Other/>")).otherwise(xml)
    return spread(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type")).select(
        F.lit("H0").alias("host"),
        F.concat(F.lit("C:\\Windows\\System32\\Tasks\\T"), key.cast("string")).alias("path"),
        broken.alias("xml"),
        F.sha2(broken, 256).alias("hash"),
        F.lit("2024-03-01 00:00:00").cast("timestamp").alias("modified"),
        key.alias("ingest_seq"),
    )


@query(
    "src_scheduled_tasks",
    r"""SELECT p_partkey AS seq, '\T' || p_partkey AS task_name, p_brand AS author, 'S-1-5-18' AS user_id, true AS hidden,
        2::BIGINT AS n_triggers, 2::BIGINT AS n_actions, 'C:\bin\' || p_type || '.exe' AS command
        FROM part WHERE p_partkey % 10 < 8""",
)
def src_scheduled_tasks(spark, sf):
    rows = texts.parse_tasks(_task_files(spark, sf))
    run = F.get(F.filter("actions", lambda a: a["command"].isNotNull()), F.lit(0))
    return rows.select(
        F.col("ingest_seq").alias("seq"),
        "task_name",
        "author",
        "user_id",
        "hidden",
        big(F.size("triggers")).alias("n_triggers"),
        big(F.size("actions")).alias("n_actions"),
        run["command"].alias("command"),
    )


@query(
    "fn_task_time",
    """SELECT p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN epoch_us(TIMESTAMP '2024-01-02 03:04:05')
         WHEN 1 THEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') + (p_partkey % 9 + 1) * 86400000000
         ELSE epoch_us(TIMESTAMP '2024-03-01 00:00:00') END AS us FROM part WHERE p_partkey % 10 < 8""",
)
def fn_task_time(spark, sf):
    rows = texts.parse_tasks(_task_files(spark, sf))
    when = texts.task_time(F.col("registered"), F.col("triggers"), F.col("modified"))
    return rows.select(F.col("ingest_seq").alias("seq"), us(when).alias("us"))


_TASK_EVENT_SQL = r"""SELECT p_partkey AS seq,
  'Scheduled task: \T' || p_partkey || ' → C:\bin\' || p_type || '.exe -a ' || p_size AS summary,
  'TimeTrigger' || CASE WHEN p_partkey % 3 <> 2 THEN '@2024-02-0' || (p_partkey % 9 + 1) || 'T00:00:00Z' ELSE '' END || ' (disabled); BootTrigger' AS triggers,
  'ComHandler:{' || p_size || '}; Exec:C:\bin\' || p_type || '.exe -a ' || p_size AS actions
  FROM part WHERE p_partkey % 10 < 8"""


@query("fn_task_format", _TASK_EVENT_SQL)
def fn_task_format(spark, sf):
    return texts.parse_tasks(_task_files(spark, sf)).select(
        F.col("ingest_seq").alias("seq"),
        texts.task_summary(F.col("task_name"), F.col("actions")).alias("summary"),
        texts.format_triggers(F.col("triggers")).alias("triggers"),
        texts.format_actions(F.col("actions")).alias("actions"),
    )


@query("fn_task_event", _TASK_EVENT_SQL)
def fn_task_event(spark, sf):
    events = texts.task_events(texts.parse_tasks(_task_files(spark, sf)))
    bag = F.col("fields")
    return events.select(
        F.col("ingest_seq").alias("seq"),
        "summary",
        field(bag, "Triggers").alias("triggers"),
        field(bag, "Actions").alias("actions"),
    )


@query(
    "fn_run_scope",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'HKLM' WHEN 1 THEN 'HKCU' WHEN 2 THEN 'HKLM' WHEN 3 THEN 'HKCU' END AS scope FROM part""",
)
def fn_run_scope(spark, sf):
    names = ["System Run Key", "User Run Key", "Run", "User Run", "RunOnce"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", registry.run_scope(name).alias("scope"))


@query(
    "fn_is_user_service",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN (p_size & 48) <> 0 WHEN 3 THEN true
         WHEN 4 THEN false ELSE false END AS is_user FROM part""",
)
def fn_is_user_service(spark, sf):
    case = F.col("p_partkey") % 6
    number = F.when(case == 2, F.col("p_size"))
    image = (
        F.when(case == 3, F.lit('"C:\\Program Files\\a.exe" -k run'))
        .when(case == 4, F.lit("\\SystemRoot\\System32\\drivers\\x.exe"))
        .when(case == 5, F.lit("system32\\x.sys"))
    )
    kept = registry.is_user_service(case == 0, case == 1, number, image)
    return table(spark, sf, "part").select("p_partkey", kept.alias("is_user"))


def _mft_raw(spark, sf):
    """File-table attributes per part: two names and standard times."""
    key, base = F.col("p_partkey"), F.lit(133_500_000_000_000_000) + F.col("p_partkey") * 10_000_000
    name = lambda text_, space, parent, shift: F.struct(
        text_.alias("name"),
        space.cast("int").alias("namespace"),
        big(parent).alias("parent"),
        big(base + shift).alias("created"),
        big(base).alias("modified"),
        F.lit(False).alias("is_directory"),
    )
    dos = name(F.concat(F.lit("DOS~"), key.cast("string")), F.lit(2), F.lit(5), F.lit(0))
    win = name(F.concat(F.col("p_name"), F.lit("\x01 ")), key % 4, key % 100, (key % 5) * 10_000_000)
    created = F.when(key % 7 != 0, base)
    return table(spark, sf, "part").select(
        F.lit("H0").alias("host"),
        F.lit("C:").alias("source"),
        key.alias("record_index"),
        (key % 2 == 0).alias("in_use"),
        big(created).alias("si_created"),
        F.lit(None).cast("bigint").alias("si_modified"),
        F.array(win, dos).alias("names"),
    )


_MFT_BASE_US = "((133500000000000000 + p_partkey * 10000000 - 116444736000000000) // 10)"
_WIN_WINS = "(p_partkey % 4 IN (0, 1, 3))"


@query(
    "fn_mft_prefer_name",
    f"""SELECT p_partkey AS record_index, CASE WHEN {_WIN_WINS} THEN p_name ELSE 'DOS~' || p_partkey END AS file_name,
          CASE WHEN {_WIN_WINS} THEN p_partkey % 100 ELSE 5 END AS parent FROM part""",
)
def fn_mft_prefer_name(spark, sf):
    return mft.entries_from_attributes(_mft_raw(spark, sf)).select(
        "record_index", "file_name", F.col("parent_record_index").alias("parent")
    )


@query(
    "fn_mft_coalesce_times",
    f"""SELECT p_partkey AS record_index, {_MFT_BASE_US} + CASE WHEN p_partkey % 7 = 0 AND {_WIN_WINS} THEN (p_partkey % 5) * 1000000 ELSE 0 END AS created_us,
          {_MFT_BASE_US} AS modified_us FROM part""",
)
def fn_mft_coalesce_times(spark, sf):
    return mft.entries_from_attributes(_mft_raw(spark, sf)).select(
        "record_index", us(F.col("created_utc")).alias("created_us"), us(F.col("modified_utc")).alias("modified_us")
    )


@query(
    "fn_timestomp",
    f"""SELECT p_partkey AS record_index, (p_partkey % 7 <> 0 AND {_WIN_WINS} AND p_partkey % 5 > 2) AS suspect FROM part""",
)
def fn_timestomp(spark, sf):
    return mft.entries_from_attributes(_mft_raw(spark, sf)).select(
        "record_index", F.col("time_stomp_suspect").alias("suspect")
    )


@query("fn_sanitize_name", "SELECT p_partkey, p_name AS name FROM part")
def fn_sanitize_name(spark, sf):
    dirty = F.concat(F.lit(" \x00\x07"), F.col("p_name"), F.lit("\x1f\x7f  "))
    return table(spark, sf, "part").select("p_partkey", text.drop_controls(dirty).alias("name"))


@query(
    "fn_qualify_path",
    r"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'D:\' WHEN 1 THEN 'D:\' || p_name WHEN 2 THEN 'E:\' || p_name
        WHEN 3 THEN 'D:\' || p_name ELSE 'D:\' || p_name END AS path FROM part""",
)
def fn_qualify_path(spark, sf):
    case, name = F.col("p_partkey") % 5, F.col("p_name")
    raw = (
        F.when(case == 0, F.lit("."))
        .when(case == 1, F.concat(F.lit(".\\"), name))
        .when(case == 2, F.concat(F.lit("E:\\"), name))
        .when(case == 3, F.concat(F.lit("\\"), name))
        .otherwise(name)
    )
    return table(spark, sf, "part").select("p_partkey", paths.qualify_path(raw, F.lit("d")).alias("path"))


@query(
    "fn_is_os_process",
    """SELECT p_partkey, p_partkey % 4 IN (0, 1, 2) AS is_os FROM part""",
)
def fn_is_os_process(spark, sf):
    case = F.col("p_partkey") % 4
    name = F.when(case == 0, F.lit("SvcHost.exe")).when(case == 1, F.lit("lsass")).otherwise(F.col("p_name"))
    company = F.when(case == 2, F.lit("Microsoft corporation")).otherwise(F.lit("Acme"))
    return table(spark, sf, "part").select(
        "p_partkey", is_os_process(name, company, F.lit("c:\\windows\\x.exe")).alias("is_os")
    )


@query(
    "fn_authenticode_summary",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Valid; ' || p_brand WHEN 1 THEN 'Valid' WHEN 2 THEN p_brand ELSE '' END AS summary FROM part""",
)
def fn_authenticode_summary(spark, sf):
    case = F.col("p_partkey") % 4
    bag = string_map(
        {
            "AuthenticodeStatus": F.when(case.isin(0, 1), F.lit("Valid")).otherwise(F.lit(" ")),
            "AuthenticodePublisher": F.when(case.isin(0, 2), F.col("p_brand")),
        }
    )
    return table(spark, sf, "part").select("p_partkey", bags.authenticode_summary(bag).alias("summary"))


@query("fn_file_name", r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS file_name FROM pages")
def fn_file_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.file_name(F.col("url")).alias("file_name"))


@query(
    "fn_extension",
    r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.tar' WHEN 1 THEN '' ELSE '.' || p_size END AS extension FROM part""",
)
def fn_extension(spark, sf):
    case, name = F.col("p_partkey") % 3, F.col("p_name")
    raw = (
        F.when(case == 0, F.concat(F.lit("C:\\a.b\\"), name, F.lit(".x.tar")))
        .when(case == 1, F.concat(F.lit("C:\\a.b\\"), name))
        .otherwise(F.concat(name, F.lit("."), F.col("p_size").cast("string")))
    )
    return table(spark, sf, "part").select("p_partkey", paths.extension(raw).alias("extension"))


@query(
    "fn_sha1_amcache",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(sha256(text), 40) ELSE left(sha256(text), 44) END AS sha1 FROM documents",
)
def fn_sha1_amcache(spark, sf):
    digest = F.sha2("text", 256)
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("0000"), F.left(digest, F.lit(40)))).otherwise(
        F.left(digest, F.lit(44))
    )
    rows = table(spark, sf, "documents").select("doc_id", raw.alias("sha1"))
    return shapes.amcache_rows(rows)


@query(
    "fn_artifact_rules",
    r"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'prefetch' WHEN 1 THEN 'tasks' WHEN 2 THEN 'browser' WHEN 3 THEN 'startup' WHEN 4 THEN 'lnk' ELSE 'other' END AS directory,
        CASE p_partkey % 6 WHEN 2 THEN 'C:\u\History' WHEN 5 THEN NULL WHEN 0 THEN 'C:\' || p_name || '.PF' WHEN 1 THEN 'C:\Tasks\' || p_name
          WHEN 3 THEN 'C:\' || p_name || '.docx' ELSE 'C:\' || p_name || '.customDestinations-ms' END AS path,
        p_partkey % 6 IN (0, 1, 2, 4) AS allowed FROM part""",
)
def fn_artifact_rules(spark, sf):
    case, name = F.col("p_partkey") % 6, F.col("p_name")
    sources = ["Prefetch", "ScheduledTask", "BrowserHistory", "StartupFolder", "JumpList", "Other"]
    source = F.element_at(F.array(*[F.lit(s) for s in sources]), (case + 1).cast("int"))
    reference = (
        F.when(case == 0, F.concat(F.lit("C:\\"), name, F.lit(".PF")))
        .when(case == 1, F.concat(F.lit("C:\\Tasks\\"), name))
        .when(case == 2, F.concat(F.lit("C:\\u\\History:"), F.col("p_size").cast("string")))
        .when(case == 3, F.concat(F.lit("C:\\"), name, F.lit(".docx")))
        .otherwise(F.concat(F.lit("C:\\"), name, F.lit(".customDestinations-ms")))
    )
    path = artifacts.artifact_source_path(source, reference)
    return table(spark, sf, "part").select(
        "p_partkey",
        artifacts.artifact_directory(source).alias("directory"),
        path.alias("path"),
        artifacts.is_allowed_artifact(source, path).alias("allowed"),
    )


@query(
    "fn_evidence_rewrite",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'raw/x/' || p_partkey ELSE 'ref' || p_partkey END AS rewritten,
       CASE p_partkey % 3 WHEN 0 THEN '/case/b1/raw/a/' || p_partkey WHEN 1 THEN 'raw/../../' || p_partkey ELSE 'C:/' || p_partkey END AS resolved FROM part""",
)
def fn_evidence_rewrite(spark, sf):
    key = F.col("p_partkey").cast("string")
    copied = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("raw/x/"), key)).otherwise(F.lit(" "))
    case = F.col("p_partkey") % 3
    reference = (
        F.when(case == 0, F.concat(F.lit("raw\\a/"), key))
        .when(case == 1, F.concat(F.lit("raw/../../"), key))
        .otherwise(F.concat(F.lit("C:/"), key))
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        artifacts.rewrite_reference(F.concat(F.lit("ref"), key), copied).alias("rewritten"),
        artifacts.resolve_reference(reference, F.lit("/case/b1")).alias("resolved"),
    )


def _run_artifacts(spark, sf):
    """A run artifact per order: up to eight run times and two referenced files."""
    day = F.col("o_orderdate").cast("timestamp")
    us_ = us(day)
    runs = F.transform(F.sequence(F.lit(0), F.col("o_orderkey") % 3), lambda i: F.timestamp_micros(us_ + i * 60_000_000))
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select(
        F.lit("H0").alias("host"),
        F.col("o_orderkey").alias("ingest_seq"),
        F.concat(F.lit("APP"), F.col("o_custkey").cast("string"), F.lit(".EXE")).alias("executable"),
        F.concat(F.lit("C:\\bin\\APP"), F.col("o_custkey").cast("string"), F.lit(".EXE")).alias("process_path"),
        F.concat(F.lit("P"), key, F.lit(".pf")).alias("pf_name"),
        F.concat(F.lit("C:\\Windows\\Prefetch\\P"), key, F.lit(".pf")).alias("pf_path"),
        F.md5(key).alias("hash"),
        F.concat(runs, F.array(F.timestamp_micros(us_))).alias("run_times"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(0)).otherwise(F.lit(9)).alias("run_count"),
        F.lit(100).alias("file_size"),
        day.alias("created"),
        day.alias("modified"),
        F.array(F.concat(F.lit("\\DEVICE\\A\\"), key, F.lit(".DLL")), F.lit("\\DEVICE\\NTDLL.DLL")).alias("referenced_files"),
    )


_PF_SQL = f"""SELECT o_orderkey AS seq, epoch_us(o_orderdate) + (o_orderkey % 3) * 60000000 AS us,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 + 1 ELSE 9 END AS run_count,
  array_to_string(list_transform(range(o_orderkey % 3, -1, -1), lambda i: {iso_sql("o_orderdate + to_minutes(i)")}), ';') AS run_times FROM orders"""


@query("fn_prefetch_event", _PF_SQL)
def fn_prefetch_event(spark, sf):
    events = shapes.prefetch_events(_run_artifacts(spark, sf))
    bag = F.col("fields")
    return events.select(
        F.col("ingest_seq").alias("seq"),
        us(F.col("ts")).alias("us"),
        big(field(bag, "RunCount")).alias("run_count"),
        field(bag, "RunTimes").alias("run_times"),
    )


@query("src_prefetch_rows", _PF_SQL.replace("array_to_string(", "len(").replace(", ';') AS run_times", ") AS n_runs"))
def src_prefetch_rows(spark, sf):
    rows = _run_artifacts(spark, sf)
    runs = shapes.distinct_run_times(F.col("run_times"))
    return rows.select(
        F.col("ingest_seq").alias("seq"),
        us(F.get(runs, F.lit(0))).alias("us"),
        shapes.run_count(F.col("run_count"), runs).alias("run_count"),
        big(F.size(runs)).alias("n_runs"),
    )


@query(
    "agg_run_times",
    """SELECT o_orderkey AS seq, unnest(list_transform(range(o_orderkey % 3, -1, -1), lambda i: epoch_us(o_orderdate + to_minutes(i)))) AS run_us FROM orders""",
)
def agg_run_times(spark, sf):
    rows = _run_artifacts(spark, sf).select(
        F.col("ingest_seq").alias("seq"), F.explode(shapes.distinct_run_times(F.col("run_times"))).alias("t")
    )
    return rows.select("seq", us(F.col("t")).alias("run_us"))


@query(
    "exp_prefetch_files",
    r"""SELECT 'C:\Windows\Prefetch\P' || o_orderkey || '.pf' AS pf_path, 0::BIGINT AS ordinal, o_orderkey || '.DLL' AS file_name FROM orders
        UNION ALL SELECT 'C:\Windows\Prefetch\P' || o_orderkey || '.pf', 1, 'NTDLL.DLL' FROM orders""",
)
def exp_prefetch_files(spark, sf):
    return shapes.referenced_files(_run_artifacts(spark, sf)).select(
        "pf_path", big(F.col("ordinal")).alias("ordinal"), "file_name"
    )


@query(
    "src_amcache_rows",
    "SELECT lang, count(*)::BIGINT AS n, count(DISTINCT left(sha256(text), 40))::BIGINT AS n_hashes FROM documents GROUP BY lang",
)
def src_amcache_rows(spark, sf):
    rows = table(spark, sf, "documents").select(
        "lang", F.concat(F.lit("0000"), F.left(F.sha2("text", 256), F.lit(40))).alias("sha1")
    )
    return shapes.amcache_rows(rows).groupBy("lang").agg(
        F.count("*").alias("n"), F.count_distinct("sha1").alias("n_hashes")
    )


@query(
    "src_shimcache_rows",
    """SELECT o_orderkey, epoch_us(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 1 DAY END) AS us FROM orders""",
)
def src_shimcache_rows(spark, sf):
    day = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, day).alias("last_modified"),
        F.lit(None).cast("timestamp").alias("last_update"),
        (day + F.expr("INTERVAL 1 DAY")).alias("last_write"),
    )
    return shapes.shimcache_rows(rows).select("o_orderkey", us(F.col("ts")).alias("us"))


def _links(spark, sf):
    ts = F.col("ts")
    key = F.col("event_id").cast("string")
    empty = F.lit("")
    return raw_events(spark, sf).select(
        F.lit("H0").alias("host"),
        F.col("event_id").alias("ingest_seq"),
        F.concat(F.lit("C:\\Recent\\"), key, F.lit(".lnk")).alias("lnk_path"),
        F.concat(F.lit("D:\\docs\\"), F.col("event_type"), F.lit("\\f"), key, F.lit(".txt")).alias("target_path"),
        (F.col("event_id") % 4 == 0).alias("raw_fallback"),
        F.lit(None).cast("string").alias("hash"),
        ts.alias("creation_time"),
        ts.alias("access_time"),
        ts.alias("write_time"),
        ts.alias("modification_time"),
        F.lit(10).alias("file_size"),
        *[empty.alias(c) for c in ("local_base_path", "common_path_suffix", "network_path", "relative_path", "name_string", "working_directory", "arguments")],
        *[F.lit(None).cast("timestamp").alias(c) for c in ("link_creation", "link_access", "link_write")],
        F.concat(F.lit("app"), (F.col("user_id") % 5).cast("string")).alias("app_id"),
        F.lit("Automatic").alias("list_type"),
        F.concat(F.lit("C:\\jl\\u"), F.col("user_id").cast("string")).alias("file_path"),
        F.lower(F.conv(F.col("event_id").cast("string"), 10, 16)).alias("stream_name"),
        "k",
    )


@query(
    "fn_lnk_event",
    r"""SELECT event_id AS seq, 'Recent file access: f' || event_id || '.txt' AS summary,
        CASE WHEN event_id % 4 = 0 THEN 'Low' ELSE 'Medium' END AS confidence FROM events""",
)
def fn_lnk_event(spark, sf):
    return shapes.recent_link_events(_links(spark, sf)).select(
        F.col("ingest_seq").alias("seq"), "summary", "confidence"
    )


def _dest_list(spark, sf):
    """List entries for even events, stream names in upper case, one repeated."""
    rows = raw_events(spark, sf).where(F.col("event_id") % 2 == 0)
    entry = rows.select(
        F.lit("H0").alias("host"),
        F.concat(F.lit("C:\\jl\\u"), F.col("user_id").cast("string")).alias("file_path"),
        F.upper(F.conv(F.col("event_id").cast("string"), 10, 16)).alias("stream_name"),
        F.col("event_id").alias("seq"),
        F.col("k").alias("mru_order"),
        F.lit(1).alias("access_count"),
        F.lit("").alias("pin_status"),
        F.col("ts").alias("last_access"),
        F.lit("hint").alias("path_hint"),
    )
    stale = entry.withColumns({"seq": F.col("seq") - 1, "mru_order": F.lit(-1).cast("bigint")})
    return entry.unionByName(stale)


@query(
    "jn_destlist",
    """SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) END AS mru_order FROM events""",
)
def jn_destlist(spark, sf):
    joined = with_dest_list(_links(spark, sf), _dest_list(spark, sf))
    return joined.select(F.col("ingest_seq").alias("seq"), "mru_order")


@query(
    "fn_jumplist_event",
    """SELECT event_id AS seq, 'Jump List item: f' || event_id || '.txt (app' || (user_id % 5) || ')' AS summary,
       CASE WHEN event_id % 2 = 0 THEN 'hint' END AS hint, epoch_us(ts) AS us FROM events""",
)
def fn_jumplist_event(spark, sf):
    joined = with_dest_list(_links(spark, sf), _dest_list(spark, sf))
    events = shapes.jump_list_events(joined)
    return events.select(
        F.col("ingest_seq").alias("seq"),
        "summary",
        field(F.col("fields"), "DestListPathHint").alias("hint"),
        us(F.col("ts")).alias("us"),
    )


def _startup_rows(spark, sf):
    name = F.when(F.col("s_suppkey") % 5 == 0, F.lit("Desktop.ini")).otherwise(
        F.concat(F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(".lnk")).otherwise(F.lit(".bat")))
    )
    return table(spark, sf, "supplier").select(
        F.lit("H0").alias("host"),
        F.col("s_suppkey").alias("ingest_seq"),
        F.concat(F.lit("u"), F.col("s_nationkey").cast("string")).alias("user_name"),
        F.concat(F.lit("C:\\Startup\\"), name).alias("entry_path"),
        name.alias("entry_name"),
        F.lit("C:\\Startup").alias("startup_folder"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modified"),
        F.concat(F.lit("C:\\t\\"), F.col("s_suppkey").cast("string"), F.lit(".exe")).alias("target_path"),
        F.lit("-q").alias("arguments"),
        F.lit(" ").alias("working_directory"),
    )


@query(
    "fn_startup_event",
    r"""SELECT s_suppkey AS seq, 'Startup (u' || s_nationkey || '): ' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN '.lnk → C:\t\' || s_suppkey || '.exe' ELSE '.bat' END AS summary
        FROM supplier WHERE s_suppkey % 5 <> 0""",
)
def fn_startup_event(spark, sf):
    return shapes.startup_events(_startup_rows(spark, sf)).select(F.col("ingest_seq").alias("seq"), "summary")


@query("flt_startup_entries", "SELECT s_suppkey AS seq FROM supplier WHERE s_suppkey % 5 <> 0")
def flt_startup_entries(spark, sf):
    return startup_entries(_startup_rows(spark, sf)).select(F.col("ingest_seq").alias("seq"))


def _console_files(spark, sf):
    return table(spark, sf, "documents").select(
        F.lit("H0").alias("host"),
        F.concat(F.lit("C:\\Users\\u"), F.col("doc_id").cast("string"), F.lit("\\ConsoleHost_history.txt")).alias("path"),
        F.col("text").alias("content"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modified"),
        "doc_id",
    )


_LINES = """WITH l AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM documents),
  p AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_number, unnest(parts) AS line FROM l),
  c AS (SELECT doc_id, line_number, trim(line, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(133) || chr(160) || chr(8195) || chr(12288)) AS command FROM p)"""


@query(
    "src_console_history",
    f"{_LINES} SELECT doc_id, line_number::BIGINT AS line_number, md5(command) AS command FROM c WHERE command <> ''",
)
def src_console_history(spark, sf):
    return texts.console_lines(_console_files(spark, sf)).select(
        "doc_id", big(F.col("line_number")).alias("line_number"), F.md5("command").alias("command")
    )


@query(
    "fn_console_event",
    f"""{_LINES} SELECT doc_id::VARCHAR AS doc, line_number::BIGINT AS seq, md5('PowerShell history (u' || doc_id || '): ' || command) AS summary
        FROM c WHERE command <> ''""",
)
def fn_console_event(spark, sf):
    events = texts.console_events(_console_files(spark, sf).drop("doc_id"))
    user = F.substring(field(F.col("fields"), "User"), 2, 20)
    return events.select(user.alias("doc"), F.col("ingest_seq").alias("seq"), F.md5("summary").alias("summary"))

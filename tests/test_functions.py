"""Column functions on small hand-made rows."""

import datetime as dt

import pytest
import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from evidentia.functions import bags, blobs, endpoints, eventmap, keys, paths, registry, text, times, transfers
from evidentia.functions.actions import canonical_verb, normalize_action, normalize_event


def one(spark, column, **values):
    """Value of a column over a single row; every value arrives as a column of its own."""
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw,verb",
    [(" Create ", "Write"), ("LAUNCH", "Open"), ("listen", "Connect"), ("closed", "Query"), ("close", "Stop"), ("", "Query"), (None, "Query")],
)
def test_normalize_action(spark, raw, verb):
    frame = spark.createDataFrame([(raw,)], "a string")
    assert frame.select(normalize_action(F.col("a"))).first()[0] == verb
    assert canonical_verb(raw) == verb


def test_original_action_is_kept_once(spark):
    rows = spark.createDataFrame(
        [("execute", {}), ("Open", {}), ("run", {"OriginalAction": "first"})], "action string, fields map<string,string>"
    )
    got = {r["action"] + "|" + str(r["fields"]) for r in normalize_event(rows).collect()}
    assert got == {"Open|{'OriginalAction': 'execute'}", "Open|{}", "Open|{'OriginalAction': 'first'}"}
    twice = normalize_event(normalize_event(rows)).collect()
    assert twice == normalize_event(rows).collect()


@pytest.mark.parametrize(
    "key",
    [
        "P:FFFFFFFFFFFFFFFF:4294967295:2024-01-02T03:04:05.1234567Z",
        "P:1A:4:2024-01-02T03:04:05.0000000Z",
    ],
)
def test_process_key_round_trip(spark, key):
    frame = spark.createDataFrame([(key,)], "k string")
    parsed = frame.select(keys.parse_process_key(F.col("k")).alias("p")).first()["p"]
    assert parsed["key"] == key
    assert parsed["boot_id"] == int(key.split(":")[1], 16)
    assert parsed["pid"] == int(key.split(":")[2])


@pytest.mark.parametrize("key", ["P::4:2024-01-01T00:00:00Z", "P:1:x:2024-01-01T00:00:00Z", "P:1:4294967296:2024-01-01T00:00:00Z", "P:1:4:soon", "Q:1:4:2024-01-01T00:00:00Z", ""])
def test_bad_process_keys(spark, key):
    frame = spark.createDataFrame([(key,)], "k string")
    assert frame.select(keys.parse_process_key(F.col("k"))).first()[0] is None


@pytest.mark.parametrize(
    "key,protocol,local,remote,pid",
    [
        ("N:TCP:[::1]:8080->[2001:db8::2]:443:77:2024-01-02T03:00:00.0000000Z", "TCP", "[::1]:8080", "[2001:db8::2]:443", 77),
        ("N:UDP:0.0.0.0:53->*:*::2024-01-02T03:00:00.0000000Z", "UDP", "0.0.0.0:53", "*:*", None),
        ("N:TCP:a:1->b:2::2024-01-02T03:00:00.0000000+02:00", "TCP", "a:1", "b:2", None),
    ],
)
def test_flow_key_round_trip(spark, key, protocol, local, remote, pid):
    frame = spark.createDataFrame([(key,)], "k string")
    f = frame.select(keys.parse_flow_key(F.col("k")).alias("f")).first()["f"]
    assert (f["protocol"], f["local_ep"], f["remote_ep"], f["pid"], f["key"]) == (protocol, local, remote, pid, key)


@pytest.mark.parametrize("key", ["N:TCP:a:1->b:2:x:2024-01-02T03:00:00Z", "N:TCP:a:1", "N::a->b::2024-01-02T03:00:00Z", "N:TCP:a->"])
def test_bad_flow_keys(spark, key):
    frame = spark.createDataFrame([(key,)], "k string")
    assert frame.select(keys.parse_flow_key(F.col("k"))).first()[0] is None


@pytest.mark.parametrize(
    "key,path,volume,file_id",
    [
        ("F:Unknown", None, None, None),
        ("F:AB12:99", None, "AB12", 99),
        ("F:C:\\a\\b.exe", "C:\\a\\b.exe", None, None),
        ("F:C:\\a\\b.exe:deadBEEF", "C:\\a\\b.exe", None, None),
        ("F:AB12:18446744073709551616", "AB12:18446744073709551616", None, None),
    ],
)
def test_file_key_parse(spark, key, path, volume, file_id):
    frame = spark.createDataFrame([(key,)], "k string")
    f = frame.select(keys.parse_file_key(F.col("k")).alias("f")).first()["f"]
    assert (f["path"], f["volume_serial"], f["file_id"]) == (path, volume, file_id)


def test_iso_ticks_keep_the_seventh_digit(spark):
    frame = spark.createDataFrame([("2024-01-01T00:00:00.1234567Z",), ("2024-01-01T00:00:00Z",), ("12:30",), ("x",)], "t string")
    got = [r[0] for r in frame.select(times.iso_ticks(F.col("t"))).collect()]
    base = 1704067200 * 10_000_000
    assert got == [base + 1234567, base, None, None]


def test_filetime_limits(spark):
    frame = spark.createDataFrame([(0,), (-1,), (2**63 - 1,), (116_444_736_000_000_000,)], "t bigint")
    epoch = dt.datetime(1970, 1, 1)
    got = [r[0] for r in frame.select(F.unix_micros(times.filetime(F.col("t")))).collect()]
    assert got[1] is None and got[2] is None and got[3] == 0
    assert got[0] == int((dt.datetime(1601, 1, 1) - epoch).total_seconds()) * 1_000_000


@pytest.mark.parametrize(
    "raw,pid", [("12", 12), (" 0xFf ", 255), ("0x", None), ("-1", None), ("4294967296", None), ("+7", 7), ("1.5", None), ("", None)]
)
def test_parse_pid(spark, raw, pid):
    frame = spark.createDataFrame([(raw,)], "v string")
    assert frame.select(bags.parse_pid(F.col("v"))).first()[0] == pid


def test_merge_fields_guards(spark):
    frame = spark.createDataFrame([({"a": "1"},)], "f map<string,string>")
    pairs = {"a": F.lit("2"), "b": F.lit("3"), "c": F.lit(None)}
    assert frame.select(bags.merge_fields(F.col("f"), pairs)).first()[0] == {"a": "2", "b": "3"}
    assert frame.select(bags.merge_fields(F.col("f"), pairs, overwrite=False)).first()[0] == {"a": "1", "b": "3"}


@pytest.mark.parametrize(
    "endpoint,address,port,family",
    [
        ("10.0.0.1:80", "10.0.0.1", "80", "v4"),
        ("[fe80::1%3]:443", "fe80::1%3", "443", "v6"),
        ("[::1]", "::1", "", "v6"),
        ("*:*", "*", "*", "other"),
        ("host", "host", "", "other"),
        ("300.1.1.1:5", "300.1.1.1", "5", "other"),
        ("", "", "", "other"),
    ],
)
def test_endpoints(spark, endpoint, address, port, family):
    frame = spark.createDataFrame([(endpoint,)], "e string")
    e = F.col("e")
    row = frame.select(endpoints.endpoint_address(e), endpoints.endpoint_port(e), endpoints.address_family(e)).first()
    assert tuple(row) == (address, port, family)


@pytest.mark.parametrize(
    "log,event_id,category,action",
    [
        ("Security", 4624, "Logon", "Start"),
        (eventmap.SYSMON_LOGS[1], 22, "DNS", "Query"),
        (eventmap.POWERSHELL_LOG, 1, "PowerShell", "Query"),
        ("Nothing", 1, "Log", "Query"),
    ],
)
def test_event_map(spark, log, event_id, category, action):
    frame = spark.createDataFrame([(log, event_id)], "l string, i bigint")
    got = frame.select(eventmap.map_event_id(F.col("l"), F.col("i")).alias("m")).first()["m"]
    assert (got["category"], got["action"]) == (category, action)


def test_hex_text_decoding(spark):
    spaced = " ".join(f"{b:02X}" for b in "Aé漢\0".encode("utf-16-le"))
    frame = spark.createDataFrame([(spaced,), ("41 00 4",), ("41 0G",), ("plain",), ("41 00 ...",), ("41 00 42",)], "v string")
    got = [r[0] for r in frame.select(registry.decode_utf16_hex(F.col("v"))).collect()]
    assert got == ["Aé漢", "41 00 4", "41 0G", "plain", "A", "A"]


def test_hex_text_of_a_long_value(spark):
    long = " ".join(["41", "00"] * 200_000)
    frame = spark.createDataFrame([(long,)], "v string")
    assert frame.select(F.length(registry.decode_utf16_hex(F.col("v")))).first()[0] == 200_000


def test_dword(spark):
    frame = spark.createDataFrame([("7",), ("FF FF FF FF",), ("10 00 00 00 99",), ("10 00",), ("x",)], "v string")
    assert [r[0] for r in frame.select(registry.decode_dword(F.col("v"))).collect()] == [7, -1, 16, None, None]


@pytest.mark.parametrize(
    "path,name", [("C:\\Windows\\System32\\Tasks\\A\\B", "\\A\\B"), ("x/tasks/y/Tasks/z", "\\z"), ("C:\\q.xml", "\\q.xml")]
)
def test_task_names(spark, path, name):
    frame = spark.createDataFrame([(path,)], "p string")
    assert frame.select(paths.task_name_from_path(F.col("p"))).first()[0] == name


def test_keywords_keep_list_order(spark):
    frame = spark.createDataFrame([("powershell -ENC x; IEX (New-Object Net.WebClient)",), ("dir",)], "c string")
    got = [r[0] for r in frame.select(text.suspicious_keywords(F.col("c"))).collect()]
    assert got == [["-enc", "iex", "net.webclient", "webclient"], []]


def test_transfer_strings(spark):
    blob = "http://x/a\0C:\\d\\f\0漢字漢字\0job one\0S-1-5-21-1-2\0HTTP://X/A\0abc".encode("utf-16-le") + b"\x07"
    frame = spark.createDataFrame([Row(b=bytearray(blob))])
    got = frame.select(transfers.classify_strings(transfers.utf16_strings(F.col("b"))).alias("s")).first()["s"]
    assert (got["urls"], got["local_paths"], got["owner_sids"], got["names"]) == (
        ["http://x/a"],
        ["C:\\d\\f"],
        ["S-1-5-21-1-2"],
        ["job one"],
    )


def shim(payload):
    """Entries of one blob."""
    rows = blobs.shim_cache_table(pd.Series([payload]))
    return [(r.path, int(r.modified) or None, int(r.updated) or None, r.format) for r in rows.itertuples()]


PAYLOADS = [b"", b"\0", b"abc", bytes(16), bytes(256), bytes(4096), b"\xff" * 64, b"\xff" * 256] + [
    bytes((i * 7919 + n) % 256 for i in range(n)) for n in (64, 257, 2048)
]


def test_decoders_survive_any_bytes(spark):
    """Never an exception, and no invented entries from noise."""
    for payload in PAYLOADS:
        assert shim(payload) == []
    assert (blobs.shell_item_table(pd.Series(PAYLOADS))["item_count"] >= 0).all()
    assert len(blobs.shim_cache_table(pd.Series([None, *PAYLOADS]))) == 0
    assert blobs.shell_item_table(pd.Series([None])).iloc[0].isna().all() and len(blobs.shell_item_table(pd.Series([], dtype=object))) == 0
    frame = spark.createDataFrame([Row(b=bytearray(p)) for p in PAYLOADS])
    b = F.col("b")
    rows = frame.select(
        registry.userassist(F.lit("n"), b),
        registry.bam_last_execution(F.lit("\\x"), b),
        registry.task_cache_times(b),
        transfers.sid_string(b),
        transfers.app_string(b),
        transfers.utf16_strings(b),
        registry.mru_order(b),
        registry.hex_display(b),
    ).collect()
    assert len(rows) == len(PAYLOADS)
    assert all(r[0] is None and r[1] is None for r in rows)


def test_surrogates(spark):
    blob = "a😀b".encode("utf-16-le") + b"\x00\xd8" + "c".encode("utf-16-le") + b"\x00\xdc\x01"
    frame = spark.createDataFrame([Row(b=bytearray(blob))])
    assert frame.select(registry.decode_utf16(F.col("b"))).first()[0] == "a😀b\ufffdc\ufffd"


def test_shim_cache_layouts():
    stamp = 133_500_000_000_000_000

    def wide(path):
        return path.encode("utf-16-le").ljust(520, b"\0") + stamp.to_bytes(8, "little") + bytes(24)

    rows = shim(bytes(128) + wide("C:\\a\\one.exe") + wide("C:\\a\\two.exe"))
    assert [(r[0], r[1], r[3]) for r in rows] == [("C:\\a\\one.exe", stamp, "Win7_552"), ("C:\\a\\two.exe", stamp, "Win7_552")]

    def narrow(path):
        return path.encode().ljust(392, b"\0") + stamp.to_bytes(8, "little")

    rows = shim(narrow("C:\\x\\one.exe") + narrow("C:\\x\\two.exe"))
    assert [(r[0], r[3]) for r in rows] == [("C:\\x\\one.exe", "WinXP_400"), ("C:\\x\\two.exe", "WinXP_400")]
    assert shim(bytes(128) + wide("C:\\a\\only.exe")) == []


def test_shim_cache_of_many_steps():
    """Neither padding nor the number of entries ends the search for blocks."""
    stamp = 133_500_000_000_000_000

    def block(path):
        body = path.encode("utf-16-le").ljust(64, b"\0") + stamp.to_bytes(8, "little")
        return (16 + len(body)).to_bytes(4, "little") + bytes(12) + body

    paths = [f"C:\\a\\{n}.exe" for n in range(5_000)]
    padded = shim(bytes(128 + 4 * 5_000) + block(paths[0]) + bytes(4 * 5_000) + block(paths[1]) + bytes(40))
    assert [(r[0], r[1], r[3]) for r in padded] == [(p, stamp, "Win10_Variable") for p in paths[:2]]
    buffer = blobs.Buffer(pd.Series([b"".join(map(block, paths)) + bytes(40)]))
    assert blobs._entries(buffer, np.array([0]), blobs.LAYOUTS[2], 0)["path"].tolist() == paths
    many = blobs.shim_cache_table(pd.Series([None, bytes(128) + block(paths[0]) + bytes(4) + block(paths[1]) + bytes(40), b"", bytes(32) + block(paths[2]) + block(paths[3]) + bytes(33)]))
    assert many[["blob", "path"]].values.tolist() == [[1, paths[0]], [1, paths[1]], [3, paths[2]], [3, paths[3]]]


def test_shell_items_of_a_batch():
    def item(content):
        return (len(content) + 2).to_bytes(2, "little") + content

    wide = "C:\\Users".encode("utf-16-le")
    one = item(b"\x31\0" + wide) + item(b"\x32\0notes.txt\0NOTES.TXT\0x") + item(b"")
    found = blobs.shell_item_table(pd.Series([one, None, one + b"\xff\xff", b"\1\0" + one], index=[7, 8, 9, 10]))
    path = found["parsed_path"].iloc[0]
    assert path.endswith("\\notes.txt") and found["file_name"].iloc[0] == "notes.txt" and found["item_types"].iloc[0] == "0x31,0x32,0x00"
    assert found["item_count"].tolist()[::2] == [3, 3] and found.iloc[1].isna().all() and found["item_count"].iloc[3] == 0

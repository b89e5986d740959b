"""Registry values: hex text, little-endian numbers, per-artifact decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import string_map
from .bags import field
from .paths import last_segment, leaf_segment
from .text import clip, icontains, is_blank, rot13, strip
from .times import (
    REGISTRY_ARTIFACT_YEARS,
    RUN_ARTIFACT_YEARS,
    filetime_checked,
    format_iso,
    format_second,
)

DISPLAY_LIMIT = 200

# Value name (upper case) to the typed field it fills.
SERVICE_VALUES = {
    "IMAGEPATH": "ServiceImagePath",
    "DISPLAYNAME": "ServiceDisplayName",
    "DESCRIPTION": "ServiceDescription",
    "START": "ServiceStartType",
    "TYPE": "ServiceType",
    "OBJECTNAME": "ServiceObjectName",
    "GROUP": "ServiceGroup",
    "ERRORCONTROL": "ServiceErrorControl",
    "FAILURECOMMAND": "ServiceFailureCommand",
    "REBOOTMESSAGE": "ServiceRebootMessage",
    "SERVICEDLL": "ServiceDll",
}
START_TYPES = {0: "Boot", 1: "System", 2: "Auto", 3: "Manual", 4: "Disabled"}
SERVICE_TYPES = {1: "KernelDriver", 2: "FileSystemDriver", 16: "OwnProcess", 32: "ShareProcess"}
IFEO_VALUES = {
    "DEBUGGER": "IFEO_Debugger",
    "GLOBALFLAG": "IFEO_GlobalFlag",
    "MITIGATIONOPTIONS": "IFEO_MitigationOptions",
    "VERIFIERFLAGS": "IFEO_VerifierFlags",
    "FILTERFULLPATH": "IFEO_FilterFullPath",
}
WINLOGON_VALUES = {
    "SHELL": "Winlogon_Shell",
    "USERINIT": "Winlogon_Userinit",
    "NOTIFY": "Winlogon_Notify",
    "VMAPPLET": "Winlogon_VmApplet",
    "AUTOADMINLOGON": "Winlogon_AutoAdminLogon",
    "DEFAULTUSERNAME": "Winlogon_DefaultUserName",
    "DEFAULTDOMAINNAME": "Winlogon_DefaultDomainName",
    "LEGALNOTICECAPTION": "Winlogon_LegalNoticeCaption",
    "LEGALNOTICETEXT": "Winlogon_LegalNoticeText",
    "SYSTEM": "Winlogon_System",
}
FAMILY_NOTES = {
    "BitsClient": "Offline registry snapshot only; does not prove transfers or execution.",
    "WmiCimom": "CIMOM registry values only; does not enumerate __EventFilter/Consumer bindings.",
    "WmiNamespaceSecurity": "Namespace security key present offline; not proof of malicious WMI persistence.",
    "SrumRegistry": "Registry slice only; SRUDB.dat / ESE execution history not decoded.",
}
RUN_SCOPES = {"System Run Key": "HKLM", "User Run Key": "HKCU", "Run": "HKLM", "User Run": "HKCU"}


def _lookup(table: dict, key: Column, value_type: str = "string") -> Column:
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, key).cast(value_type)


def swap_hex(digits: Column) -> Column:
    """Byte order of a hex string reversed."""
    return F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")


def le_bytes(raw: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian number at a zero-based offset; null past the end."""
    swapped = swap_hex(F.hex(F.substring(raw, offset + 1, size)))
    number = F.conv(swapped, 16, 10).try_cast("decimal(20,0)")
    return F.when(F.octet_length(raw) >= offset + size, number)


def spaced_hex(raw: Column) -> Column:
    """All bytes as spaced hex."""
    return F.regexp_replace(F.hex(raw), r"(..)(?!$)", "$1 ")


def hex_display(raw: Column, limit: int = DISPLAY_LIMIT) -> Column:
    """Spaced hex, cut at ``limit`` characters with a trailing ``...``; to be shown only, not decoded or searched."""
    return clip(spaced_hex(raw), limit, "...")


def _hex_text(raw: Column) -> Column:
    return strip(F.replace(raw, F.lit("..."), F.lit("")))


def is_hex_text(raw: Column) -> Column:
    """Two-digit hex groups apart by spaces.

    Stated as what must not occur: a repeated group in the pattern would
    recurse per repetition and long values would exhaust the stack.
    """
    text = _hex_text(raw)
    odd = text.rlike(r"[^0-9A-Fa-f ]|[0-9A-Fa-f]{3}|(^| )[0-9A-Fa-f]( |$)")
    return F.coalesce((text != "") & ~odd, F.lit(False))


def _unhex(raw: Column) -> Column:
    """Bytes of spaced hex text; null where it is not hex."""
    return F.unhex(F.replace(_hex_text(raw), F.lit(" "), F.lit("")))


def decode_utf16(raw: Column) -> Column:
    """UTF-16LE bytes as text; an odd last byte is ignored, lone surrogates become U+FFFD."""
    irregular = F.hex(raw).rlike("D[89A-F]") | (F.octet_length(raw) % 2 == 1)
    return F.when(irregular, _mended_utf16(raw)).otherwise(F.decode(raw, "UTF-16LE"))


def _mended_utf16(raw: Column) -> Column:
    """Unit by unit, for the few values that have surrogates or an odd length."""
    units = F.regexp_extract_all(F.hex(raw), F.lit("...."), F.lit(0))

    def mended(unit: Column, i: Column) -> Column:
        lone_high = unit.rlike("^..D[89AB]") & ~F.coalesce(F.get(units, i + 1).rlike("^..D[C-F]"), F.lit(False))
        lone_low = unit.rlike("^..D[C-F]") & ~F.coalesce(F.get(units, i - 1).rlike("^..D[89AB]"), F.lit(False))
        return F.when(lone_high | lone_low, F.lit("FDFF")).otherwise(unit)

    return F.decode(F.unhex(F.array_join(F.transform(units, mended), "")), "UTF-16LE")


def utf16(raw: Column) -> Column:
    """UTF-16LE bytes as text without the NULs at its end."""
    return F.rtrim(decode_utf16(raw), F.lit("\0"))


def decode_utf16_hex(raw: Column) -> Column:
    """Spaced-hex text decoded as UTF-16LE; anything else is returned unchanged."""
    return F.when(is_hex_text(raw), utf16(_unhex(raw))).otherwise(raw)


def decode_dword(raw: Column) -> Column:
    """Decimal text, else the first four bytes of spaced hex, as a signed 32-bit number."""
    text = strip(raw)
    decimal = F.when(text.rlike(r"^[+-]?\d{1,10}$"), text.try_cast("bigint"))
    decimal = F.when(decimal.between(-(2**31), 2**31 - 1), decimal)
    number = le_bytes(_unhex(raw), 0, 4).cast("bigint")
    signed = F.when(is_hex_text(raw), F.pmod(number + 2**31, F.lit(2**32)) - 2**31)
    return F.coalesce(decimal, signed)


def decode_reg_sz(raw: Column, fallback: Column) -> Column:
    return F.when(F.octet_length(raw) >= 2, utf16(raw)).otherwise(fallback)


def userassist(value_name: Column, raw: Column) -> Column:
    """Struct of the decoded name, run and focus counts and last run; null if no plausible time."""
    size = F.octet_length(raw)
    new_time = filetime_checked(le_bytes(raw, 8, 8), RUN_ARTIFACT_YEARS)
    old_time = filetime_checked(le_bytes(raw, 4, 8), RUN_ARTIFACT_YEARS)
    bare_time = filetime_checked(le_bytes(raw, 0, 8), RUN_ARTIFACT_YEARS)
    wide, narrow = size >= 16, (size >= 8) & (size < 16)
    last_run = F.when(wide, F.coalesce(new_time, old_time)).when(narrow, bare_time)
    is_new = wide & new_time.isNotNull()
    run_count = (
        F.when(is_new, le_bytes(raw, 4, 4)).when(wide & old_time.isNotNull(), le_bytes(raw, 0, 4)).otherwise(F.lit(0))
    )
    built = F.struct(
        value_name.alias("raw_name"),
        rot13(value_name).alias("decoded_name"),
        F.when(is_new, le_bytes(raw, 0, 4)).cast("bigint").alias("focus_count"),
        run_count.cast("bigint").alias("run_count"),
        last_run.alias("last_execution"),
    )
    return F.when((F.length(value_name) > 0) & last_run.isNotNull(), built)


def bam_component(key_path: Column) -> Column:
    """``BAM`` or ``DAM`` for a per-user settings key whose leaf is a SID, else null."""
    path = F.lower(key_path)
    settings = F.contains(path, F.lit("\\usersettings\\")) & F.upper(leaf_segment(key_path)).startswith("S-1-")
    return F.when(settings & F.contains(path, F.lit("\\services\\bam\\")), F.lit("BAM")).when(
        settings & F.contains(path, F.lit("\\services\\dam\\")), F.lit("DAM")
    )


def bam_last_execution(value_name: Column, raw: Column) -> Column:
    return F.when(
        F.contains(value_name, F.lit("\\")), filetime_checked(le_bytes(raw, 0, 8), REGISTRY_ARTIFACT_YEARS)
    )


def task_cache_guid(key_path: Column) -> Column:
    leaf = leaf_segment(key_path)
    inside = F.contains(F.lower(key_path), F.lit("\\schedule\\taskcache\\tasks\\"))
    return F.when(inside & leaf.rlike(r"^\{.*\}$"), leaf)


def task_cache_times(raw: Column) -> Column:
    """Struct ``created, last_run, last_success`` of a DynamicInfo blob; null if none decodes."""
    created, last_run, last_success = [
        filetime_checked(le_bytes(raw, offset, 8), REGISTRY_ARTIFACT_YEARS) for offset in (4, 12, 28)
    ]
    built = F.struct(created.alias("created"), last_run.alias("last_run"), last_success.alias("last_success"))
    return F.when(F.coalesce(created, last_run, last_success).isNotNull(), built)


def service_context(key_path: Column) -> Column:
    """Struct ``service_name, control_set`` from a services key path; null outside services."""
    parts = F.filter(F.split(key_path, r"\\"), lambda p: p != "")
    control_sets = F.filter(parts, lambda p: F.lower(p).startswith("controlset"))
    position = F.array_position(F.transform(parts, lambda p: F.lower(p)), F.lit("services"))
    name = F.when(position > 0, F.get(parts, position.cast("int")))
    built = F.struct(
        name.alias("service_name"), F.get(control_sets, F.size(control_sets) - 1).alias("control_set")
    )
    return F.when(name.isNotNull() & (F.lower(name) != "parameters"), built)


def start_type_label(value: Column) -> Column:
    number = F.when(value.rlike(r"^\d{1,9}$"), value.try_cast("int"))
    return F.when(number.isNotNull(), F.coalesce(_lookup(START_TYPES, number), F.lit("Other")))


def service_type_label(value: Column) -> Column:
    number = F.when(value.rlike(r"^\d{1,9}$"), value.try_cast("int"))
    return F.when(number.isNotNull(), F.coalesce(_lookup(SERVICE_TYPES, number), F.lit("Other")))


def startup_approved_state(raw: Column) -> Column:
    first = F.hex(F.substring(raw, 1, 1))
    return F.when(first == "02", F.lit("Disabled")).when(first == "03", F.lit("Enabled")).otherwise(F.lit("Unknown"))


def run_scope(query_name: Column) -> Column:
    """Registry root of a Run-key query name, null for other queries."""
    return _lookup(RUN_SCOPES, query_name)


def is_user_service(driver_label: Column, process_label: Column, service_type: Column, image_path: Column) -> Column:
    """Labels decide first, then the type bits, then the image path."""
    path = F.lower(F.btrim(strip(image_path), F.lit('"')))
    token = F.regexp_extract(path, r"(?s)^(.*?\.exe)", 1)
    token = F.when(token != "", token).otherwise(path)
    by_path = ~F.contains(path, F.lit("\\drivers\\")) & token.endswith(".exe")
    return (
        F.when(F.coalesce(driver_label, F.lit(False)), F.lit(False))
        .when(F.coalesce(process_label, F.lit(False)), F.lit(True))
        .when(service_type.isNotNull(), service_type.cast("bigint").bitwiseAND(F.lit(48).cast("bigint")) != 0)
        .otherwise(F.coalesce(by_path, F.lit(False)))
    )


def mru_order(raw: Column) -> Column:
    """``MRUListEx`` bytes as value ids in rank order, up to the -1 terminator."""
    words = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.octet_length(raw) / 4).cast("int") - 1, F.lit(0))),
        lambda i: F.hex(F.substring(raw, i * 4 + 1, F.lit(4))),
    )
    words = F.filter(words, lambda w: F.length(w) == 8)
    terminator = F.array_position(words, "FFFFFFFF")
    kept = F.when(terminator > 0, F.slice(words, F.lit(1), (terminator - 1).cast("int"))).otherwise(words)
    return F.transform(
        kept,
        lambda w: F.conv(swap_hex(w), 16, 10).cast("bigint"),
    )


def _is_query(query_name: Column, name: str) -> Column:
    return F.coalesce(F.lower(query_name) == name.lower(), F.lit(False))


def enrich_services(key_path: Column, value_name: Column, value_data: Column) -> dict[str, Column]:
    context = service_context(key_path)
    data, name = strip(value_data), F.upper(value_name)
    known = context.isNotNull() & name.isin(list(SERVICE_VALUES))
    pairs = {
        "OfflineHiveDecoded": F.when(known, F.lit("Services")),
        "ServiceName": F.when(known, context["service_name"]),
        "ServiceControlSet": F.when(known, context["control_set"]),
        "ServiceStartTypeLabel": F.when(known & (name == "START"), start_type_label(data)),
        "ServiceTypeLabel": F.when(known & (name == "TYPE"), service_type_label(data)),
    }
    for value, target in SERVICE_VALUES.items():
        pairs[target] = F.when(known & (name == value), data)
    return pairs


def enrich_startup_approved(value_name: Column, raw: Column) -> dict[str, Column]:
    size = F.octet_length(raw)
    present = size > 0
    hint = filetime_checked(le_bytes(raw, 4, 8), RUN_ARTIFACT_YEARS)
    return {
        "OfflineHiveDecoded": F.when(present, F.lit("StartupApprovedRun")),
        "StartupApproved_EntryName": F.when(present, value_name),
        "StartupApproved_FirstByte": F.when(present, le_bytes(raw, 0, 1)).cast("bigint"),
        "StartupApproved_HeaderPrefixHex": F.when(size >= 8, F.hex(F.substring(raw, 1, 8))),
        "StartupApproved_State": F.when(present, startup_approved_state(raw)),
        "StartupApproved_LastWriteHintUtc": F.when(size >= 12, format_iso(hint)),
    }


def enrich_ifeo(key_path: Column, value_name: Column, value_data: Column) -> dict[str, Column]:
    target, data, name = last_segment(key_path), strip(value_data), F.upper(value_name)
    known = (target != "") & (data != "") & name.isin(list(IFEO_VALUES))
    pairs = {
        "OfflineHiveDecoded": F.when(known, F.lit("IFEO")),
        "IFEO_TargetImage": F.when(known, target),
    }
    for value, column in IFEO_VALUES.items():
        pairs[column] = F.when(known & (name == value), data)
    return pairs


def enrich_winlogon(value_name: Column, value_data: Column) -> dict[str, Column]:
    data, name = strip(value_data), F.upper(value_name)
    known = (data != "") & name.isin(list(WINLOGON_VALUES))
    pairs = {"OfflineHiveDecoded": F.when(known, F.lit("Winlogon"))}
    for value, column in WINLOGON_VALUES.items():
        pairs[column] = F.when(known & (name == value), data)
    return pairs


def enrich_family(query_name: Column, key_path: Column, value_name: Column, value_data: Column) -> dict[str, Column]:
    """Registry families kept for context only: BITS, WMI and SRUM keys."""
    bits, srum = _is_query(query_name, "BitsClient"), _is_query(query_name, "SrumRegistry")
    cimom = _is_query(query_name, "WmiCimom") & (F.length(value_name) > 0)
    namespace = _is_query(query_name, "WmiNamespaceSecurity") & (last_segment(key_path) != "")
    data = F.when(strip(value_data) != "", strip(value_data))
    wmi_preview = F.when(cimom, clip(data, 240)).when(namespace, clip(data, 120))
    return {
        "OfflineArtifactFamily": F.when(bits, F.lit("BITS")).when(srum, F.lit("SRUM")).when(
            cimom | namespace, F.lit("WMI")
        ),
        "OfflineHiveDecoded": F.when(bits, F.lit("BITS_Registry"))
        .when(srum, F.lit("SRUM_Registry"))
        .when(cimom, F.lit("WMI_Cimom"))
        .when(namespace, F.lit("WMI_NamespaceSecurity")),
        "Bits_KeyPathRelative": F.when(bits, key_path),
        "Bits_ValueName": F.when(bits, value_name),
        "Bits_ValuePreview": F.when(bits, clip(data, 200)),
        "Bits_Note": F.when(bits, F.lit(FAMILY_NOTES["BitsClient"])),
        "Srum_KeyPathRelative": F.when(srum, key_path),
        "Srum_ValueName": F.when(srum, value_name),
        "Srum_ValuePreview": F.when(srum, clip(data, 200)),
        "Srum_Note": F.when(srum, F.lit(FAMILY_NOTES["SrumRegistry"])),
        "Wmi_SecurityNamespaceKey": F.when(namespace, last_segment(key_path)),
        "Wmi_ValueName": F.when(cimom | namespace, value_name),
        "Wmi_ValuePreview": wmi_preview,
        "Wmi_Note": F.when(cimom, F.lit(FAMILY_NOTES["WmiCimom"])).when(
            namespace, F.lit(FAMILY_NOTES["WmiNamespaceSecurity"])
        ),
    }


def run_artifact_columns(
    query_name: Column, key_path: Column, value_name: Column, raw: Column
) -> dict[str, Column]:
    """Decoded run artifacts of a value, to be projected before :func:`enrich_run_artifacts`."""
    counted = _is_query(query_name, "UserAssist") & F.lower(key_path).endswith("\\count")
    guid = task_cache_guid(key_path)
    return {
        "_bam_time": F.when(bam_component(key_path).isNotNull(), bam_last_execution(value_name, raw)),
        "_task_guid": guid,
        "_task_times": F.when(
            guid.isNotNull() & (F.lower(value_name) == "dynamicinfo"), task_cache_times(raw)
        ),
        "_assist": F.when(counted, userassist(value_name, raw)),
    }


def enrich_run_artifacts(key_path: Column, value_name: Column, value_data: Column, raw: Column) -> dict[str, Column]:
    """BAM/DAM, TaskCache and UserAssist fields from the columns of :func:`run_artifact_columns`."""
    times, assist, guid = F.col("_task_times"), F.col("_assist"), F.col("_task_guid")
    is_bam = F.col("_bam_time").isNotNull()
    is_path = guid.isNotNull() & (F.lower(value_name) == "path")
    component = F.when(is_bam, bam_component(key_path))
    return {
        "OfflineHiveDecoded": F.coalesce(
            F.when(assist.isNotNull(), F.lit("UserAssist")),
            F.when(is_path | times.isNotNull(), F.lit("TaskCache")),
            component,
        ),
        "BamComponent": component,
        "BamUserSid": F.when(is_bam, leaf_segment(key_path)),
        "BamExecutablePath": F.when(is_bam, value_name),
        "BamLastExecutionUtc": format_iso(F.col("_bam_time")),
        "TaskCache_Guid": guid,
        "TaskCache_Path": F.when(is_path, decode_reg_sz(raw, value_data)),
        "TaskCache_CreatedUtc": format_iso(times["created"]),
        "TaskCache_LastRunUtc": format_iso(times["last_run"]),
        "TaskCache_LastSuccessUtc": format_iso(times["last_success"]),
        "UserAssist_DecodedName": assist["decoded_name"],
        "UserAssist_RunCount": assist["run_count"],
        "UserAssist_FocusCount": assist["focus_count"],
        "UserAssist_LastExecutionUtc": format_iso(assist["last_execution"]),
        "UserAssist_RawValueName": assist["raw_name"],
    }


def enrichment(
    query_name: Column, key_path: Column, value_name: Column, value_data: Column, raw: Column
) -> Column:
    """Fields that the registry enrichments add to one value, each guarded by its own query name."""

    def guarded(name: str, pairs: dict[str, Column]) -> dict[str, Column]:
        return {key: F.when(_is_query(query_name, name), value) for key, value in pairs.items()}

    packs = [
        enrich_run_artifacts(key_path, value_name, value_data, raw),
        guarded("Services", enrich_services(key_path, value_name, value_data)),
        guarded("StartupApprovedRun", enrich_startup_approved(value_name, raw)),
        guarded("IFEO", enrich_ifeo(key_path, value_name, value_data)),
        guarded("Winlogon", enrich_winlogon(value_name, value_data)),
        enrich_family(query_name, key_path, value_name, value_data),
    ]
    pairs: dict[str, Column] = {"OfflineHiveDecoded": F.coalesce(*[p.pop("OfflineHiveDecoded") for p in packs])}
    for pack in packs:
        pairs.update(pack)
    return string_map(pairs)


def primary_time(fields: Column, last_write: Column) -> Column:
    """Execution or registration time found in the enriched fields, else the key's last write."""
    return F.coalesce(
        field(fields, "TaskCache_LastRunUtc").cast("timestamp"),
        field(fields, "TaskCache_CreatedUtc").cast("timestamp"),
        field(fields, "BamLastExecutionUtc").cast("timestamp"),
        last_write,
    )


def value_summary(
    fields: Column, query_name: Column, key_path: Column, value_name: Column, value_data: Column
) -> Column:
    """One line per value, worded by whichever decoder applied."""
    decoded = field(fields, "OfflineHiveDecoded")
    data = strip(value_data)

    def second(name: str) -> Column:
        return F.coalesce(format_second(field(fields, name).cast("timestamp")), F.lit("n/a"))

    def words(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])

    preview = field(fields, "Wmi_ValuePreview")
    return (
        F.when(
            decoded == "UserAssist",
            words(
                "UserAssist: ", field(fields, "UserAssist_DecodedName"),
                " (runs=", field(fields, "UserAssist_RunCount"),
                ", last=", second("UserAssist_LastExecutionUtc"), ")",
            ),
        )
        .when(
            (decoded == "TaskCache") & field(fields, "TaskCache_Path").isNotNull(),
            words("TaskCache task: ", field(fields, "TaskCache_Path"), " (", field(fields, "TaskCache_Guid"), ")"),
        )
        .when(
            decoded == "TaskCache",
            words(
                "TaskCache DynamicInfo (", field(fields, "TaskCache_Guid"), "): created=",
                second("TaskCache_CreatedUtc"), ", lastRun=", second("TaskCache_LastRunUtc"),
            ),
        )
        .when(
            decoded.isin("BAM", "DAM"),
            words(
                decoded, " last-exec: ", value_name, " @ ", second("BamLastExecutionUtc"),
                " (user ", field(fields, "BamUserSid"), ")",
            ),
        )
        .when(
            decoded == "Services",
            words("Services [", field(fields, "ServiceName"), "] ", value_name, ": ", clip(data, 80)),
        )
        .when(
            decoded == "StartupApprovedRun",
            words("StartupApproved [", field(fields, "StartupApproved_State"), "]: ", value_name),
        )
        .when(
            decoded == "IFEO",
            words(
                "IFEO [",
                field(fields, "IFEO_TargetImage"),
                "] ",
                F.when(F.upper(value_name) == "DEBUGGER", F.lit("Debugger configured"))
                .when(F.upper(value_name) == "GLOBALFLAG", F.concat(F.lit("GlobalFlag="), data))
                .when(F.upper(value_name) == "MITIGATIONOPTIONS", F.lit("MitigationOptions"))
                .when(F.upper(value_name) == "VERIFIERFLAGS", F.lit("VerifierFlags"))
                .otherwise(F.lit("FilterFullPath")),
            ),
        )
        .when(decoded == "Winlogon", words("Winlogon ", value_name, ": ", clip(data, 100)))
        .when(decoded == "BITS_Registry", words("BITS registry: ", key_path, "\\", value_name))
        .when(decoded == "SRUM_Registry", words("SRUM registry: ", key_path, "\\", value_name))
        .when(
            (decoded == "WMI_Cimom") & preview.isNotNull(),
            words("WMI CIMOM: ", value_name, " = ", clip(preview, 80)),
        )
        .when(decoded == "WMI_Cimom", words("WMI CIMOM: ", value_name))
        .when(
            decoded == "WMI_NamespaceSecurity",
            words("WMI Security [", field(fields, "Wmi_SecurityNamespaceKey"), "] ", value_name),
        )
        .otherwise(words(query_name, ": ", key_path, "\\", value_name))
    )


def control_set_head(key_path: Column) -> Column:
    head = F.substring_index(key_path, "\\", 1)
    return F.when(F.lower(head).startswith("controlset"), head).otherwise(F.lit(""))


def is_shim_cache_value(query_name: Column, value_name: Column) -> Column:
    return _is_query(query_name, "AppCompatCache") & (F.lower(value_name) == "appcompatcache")


def service_labels(type_label: Column) -> tuple[Column, Column]:
    """(driver label, process label) flags of one type label."""
    driver = icontains(type_label, "driver")
    return driver, ~driver & icontains(type_label, "process")

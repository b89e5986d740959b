"""Endpoint text: address, port and family; building endpoints from field aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bags import first_field, parse_port
from .text import is_blank, not_blank

# Field aliases that make up the two endpoints of a trace record.
LOCAL_ADDRESS_FIELDS = ["LocalAddress", "SourceAddress", "saddr"]
REMOTE_ADDRESS_FIELDS = ["RemoteAddress", "DestAddress", "daddr"]
LOCAL_PORT_FIELDS = ["LocalPort", "SourcePort", "sport"]
REMOTE_PORT_FIELDS = ["RemotePort", "DestPort", "dport"]
PROTOCOL_FIELDS = ["Protocol", "ProtocolName"]

_V4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
_V6 = r"^(?=.*:.*:)[0-9A-Fa-f:]+([0-9.]*)(%[0-9A-Za-z]+)?$"


def endpoint_address(endpoint: Column) -> Column:
    """Address part; brackets of IPv6 endpoints are removed."""
    bracketed = F.regexp_extract(endpoint, r"^\[([^\]]+)\]", 1)
    split = F.regexp_extract(endpoint, r"^(.+):[^:]+$", 1)
    return (
        F.when(is_blank(endpoint), F.lit(""))
        .when(bracketed != "", bracketed)
        .when(split != "", split)
        .otherwise(endpoint)
    )


def endpoint_port(endpoint: Column) -> Column:
    """Port text, empty where there is none."""
    return (
        F.when(is_blank(endpoint), F.lit(""))
        .when(endpoint.startswith("["), F.regexp_extract(endpoint, r"^\[[^\]]*\]:(.*)$", 1))
        .otherwise(F.regexp_extract(endpoint, r"^.+:([^:]+)$", 1))
    )


def address_family(endpoint: Column) -> Column:
    """``v4``, ``v6`` or ``other``."""
    address = endpoint_address(endpoint)
    return F.when(address.rlike(_V4), F.lit("v4")).when(address.rlike(_V6), F.lit("v6")).otherwise(F.lit("other"))


def join_endpoint(address: Column, port: Column) -> Column:
    """``address:port``, with brackets round an IPv6 address."""
    bare = F.concat(address, F.lit(":"), port.cast("string"))
    boxed = F.concat(F.lit("["), address, F.lit("]:"), port.cast("string"))
    return F.when(address.rlike(_V6), boxed).otherwise(bare)


def connection_state(raw_state: Column, action: Column) -> Column:
    return F.upper(F.coalesce(not_blank(raw_state), not_blank(action), F.lit("UNKNOWN")))


def build_endpoints(fields: Column) -> Column:
    """Struct ``protocol, local_ep, remote_ep``; null unless both sides are complete."""
    local_address = first_field(fields, *LOCAL_ADDRESS_FIELDS)
    remote_address = first_field(fields, *REMOTE_ADDRESS_FIELDS)
    local_port = parse_port(first_field(fields, *LOCAL_PORT_FIELDS))
    remote_port = parse_port(first_field(fields, *REMOTE_PORT_FIELDS))
    complete = (
        local_address.isNotNull() & remote_address.isNotNull() & local_port.isNotNull() & remote_port.isNotNull()
    )
    built = F.struct(
        F.coalesce(first_field(fields, *PROTOCOL_FIELDS), F.lit("TCP")).alias("protocol"),
        join_endpoint(local_address, local_port).alias("local_ep"),
        join_endpoint(remote_address, remote_port).alias("remote_ep"),
    )
    return F.when(complete, built)

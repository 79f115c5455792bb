"""Expressions from flow fields to published label values."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DSCP, PROTOCOLS, TCP_FLAGS


def _named(code: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in names.items()))
    return F.coalesce(F.try_element_at(table, code.cast("int")), code.cast("string"))


def protocol(p: Column) -> Column:
    return _named(p, PROTOCOLS)


def dscp_of(tos: Column) -> Column:
    return F.shiftright(tos.cast("int"), 2)


def dscp(code: Column) -> Column:
    return _named(code, DSCP)


def tcp_flags(flags: Column) -> Column:
    """Names of the set bits, lowest first, joined by commas; `none` without any."""
    bits = flags.cast("int")
    return F.when(bits == 0, F.lit("none")).otherwise(F.concat_ws(",", *[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(TCP_FLAGS)]))


def country(code: Column) -> Column:
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("unknown"))


def number(n: Column) -> Column:
    return n.cast("string")


def application(name: Column, app_id: Column) -> Column:
    """The device's or a looked-up name, else engine:selector of a non-zero id, else NULL."""
    packed = F.concat(F.shiftright(app_id, 24).cast("string"), F.lit(":"), app_id.bitwiseAND(F.lit(0xFFFFFF)).cast("string"))
    return F.coalesce(F.nullif(name, F.lit("")), F.when(app_id != 0, packed))


def ipv4(address: Column) -> Column:
    """Dotted text of an address held as a number."""
    return F.concat_ws(".", *[F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def is_private(address: Column) -> Column:
    """RFC 1918, for addresses held as numbers."""
    return address.between(167772160, 184549375) | address.between(2886729728, 2887778303) | address.between(3232235520, 3232301055)

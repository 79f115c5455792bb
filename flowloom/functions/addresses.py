"""Addresses as 4 or 16 bytes, or (IPv4 alone) as numbers: text, private ranges, and halves to mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels


def _number(a: Column) -> Column:
    return F.conv(F.hex(a), 16, 10).cast("long")


def _signed(a: Column, first: int) -> Column:
    """Eight bytes as a signed 64-bit number."""
    return F.conv(F.hex(F.substring(a, first, 8)), 16, -10).cast("long")


def halves(address: Column, kind: str) -> tuple[Column, Column, Column]:
    """(family, upper, lower): 4 with the number and 0, or 6 with both halves of 64 bits; NULL for others."""
    if kind != "binary":
        return F.when(address.isNotNull(), 4), address.cast("long"), F.lit(0).cast("long")
    size = F.octet_length(address)
    family = F.when(size == 4, 4).when(size == 16, 6)
    return family, F.when(size == 4, _number(address)).when(size == 16, _signed(address, 1)), F.when(size == 16, _signed(address, 9)).otherwise(F.lit(0).cast("long"))


def signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def masks(family: int, length: int) -> tuple[int, int]:
    """Masks of both halves for a prefix of this length."""
    if family == 4:
        return (0xFFFFFFFF << (32 - length)) & 0xFFFFFFFF, 0
    whole = ((1 << 128) - 1) ^ ((1 << (128 - length)) - 1)
    return signed(whole >> 64), signed(whole & ((1 << 64) - 1))


def text(address: Column, kind: str) -> Column:
    """Dotted or RFC 5952 text: the longest run of two or more zero groups, the first of equals, becomes a double colon."""
    if kind != "binary":
        return labels.ipv4(address)
    digits = F.lower(F.hex(address))
    plain = F.concat_ws(":", *[F.regexp_replace(F.substring(digits, 4 * i + 1, 4), "^0{1,3}", "") for i in range(8)])
    shown = plain
    for n in range(2, 9):  # the longest run that matches is written last
        run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
        shown = F.when(plain.rlike(run), F.regexp_replace(plain, run, "$1::$2")).otherwise(shown)
    return F.when(F.octet_length(address) == 4, labels.ipv4(_number(address))).when(F.octet_length(address) == 16, shown)


def is_private(address: Column, kind: str) -> Column:
    """RFC 1918, and fc00::/7."""
    if kind != "binary":
        return labels.is_private(address)
    v4 = (F.octet_length(address) == 4) & labels.is_private(_number(address))
    return v4 | ((F.octet_length(address) == 16) & F.hex(F.substring(address, 1, 1)).isin("FC", "FD"))

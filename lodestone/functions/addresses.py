"""IP addresses and networks as numbers: a version and two longs, compared and masked without text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_V6 = r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?(?:::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)?"


def _v4(value: Column) -> Column:
    part = lambda i: F.get(F.split(value, r"\.", -1), F.lit(i)).cast("long")
    return F.shiftleft(part(0), 24) + F.shiftleft(part(1), 16) + F.shiftleft(part(2), 8) + part(3)


def _groups(value: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 address whose last two groups may be written as IPv4; null if there are others."""
    dotted = F.regexp_extract(value, rf"(?<=:){_V4}$", 0)
    as_hex = F.lower(F.concat_ws(":", F.hex(F.shiftright(_v4(dotted), 16)), F.hex(_v4(dotted).bitwiseAND(F.lit(0xFFFF)))))
    plain = F.when(dotted != "", F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(dotted)), as_hex)).otherwise(value)

    def spread(v: Column) -> Column:
        halves = F.split(v, "::", -1)
        part = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":", -1), lambda g: g != "")

        def filled(left: Column) -> Column:
            def with_right(right: Column) -> Column:
                n = F.size(left) + F.size(right)
                whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), right)
                ok = v.rlike(f"^{_V6}\\z") & F.when(v.contains("::"), n <= 7).otherwise(n == 8)
                return F.when(ok, F.transform(whole, lambda g: F.conv(g, 16, 10).cast("long")))

            return bind(part(1), with_right)

        return bind(part(0), filled)

    return bind(plain, spread)


def address(value: Column, fold: bool = True) -> Column:
    """struct(version, high, low) of an address, null if it is none; IPv4 has its number in low. fold: mapped IPv4 is IPv4."""
    number = lambda v, high, low: F.struct(F.lit(v).alias("version"), high.cast("long").alias("high"), low.cast("long").alias("low"))

    def six(g: Column) -> Column:
        def long(first: int) -> Column:
            at = [F.get(g, F.lit(first + i)) for i in range(4)]
            return F.shiftleft(at[0], 48).bitwiseOR(F.shiftleft(at[1], 32)).bitwiseOR(F.shiftleft(at[2], 16)).bitwiseOR(at[3])

        whole = number(6, long(0), long(4))
        mapped = (long(0) == 0) & (F.get(g, F.lit(4)) == 0) & (F.get(g, F.lit(5)) == 0xFFFF)
        inner = number(4, F.lit(0), F.shiftleft(F.get(g, F.lit(6)), 16) + F.get(g, F.lit(7)))
        return F.when(mapped & F.lit(fold), inner).when(g.isNotNull(), whole)

    return F.when(value.rlike(f"^{_V4}\\z"), number(4, F.lit(0), _v4(value))).when(value.contains(":"), bind(_groups(value), six))


def _keep(bits: Column) -> Column:
    """A long with its highest 0 to 64 bits set."""
    return F.when(bits <= 0, F.lit(0)).when(bits >= 64, F.lit(-1)).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - bits).cast("int"))).cast("long")


def masked(a: Column, prefix: Column) -> Column:
    """The address with what is behind the prefix set to zero."""
    bits = F.when(a["version"] == 4, prefix + 32).otherwise(prefix - 64)
    high = F.when(a["version"] == 4, F.lit(0).cast("long")).otherwise(a["high"].bitwiseAND(_keep(prefix)))
    low = F.when(a["version"] == 4, a["low"].bitwiseAND(_keep(bits))).otherwise(a["low"].bitwiseAND(_keep(bits)))
    return F.struct(a["version"].alias("version"), high.alias("high"), low.alias("low"))


def network(cidr: Column) -> Column:
    """struct(version, prefix, high, low) of `address` or `address/prefix`, null if it is none; host bits are cleared.

    A network within the mapped range is the IPv4 network that it maps.
    """
    given = F.regexp_extract(cidr, r"/([0-9]{1,3})\z", 1)

    def built(a: Column) -> Column:
        six = F.regexp_extract(cidr, "^[^/]*", 0).contains(":")
        size = F.when(six, 128).otherwise(32)
        prefix = F.when(given == "", size).otherwise(given.cast("int"))
        folded = six & (a["version"] == 4)
        inner = F.when(folded, prefix - 96).otherwise(prefix)
        valid = a.isNotNull() & (prefix <= size) & (inner >= 0) & cidr.rlike(r"^[^/]+(?:/[0-9]{1,3})?\z")
        m = masked(a, inner)
        return F.when(valid, F.struct(a["version"].alias("version"), inner.cast("int").alias("prefix"), m["high"].alias("high"), m["low"].alias("low")))

    return bind(address(F.regexp_extract(cidr, "^[^/]*", 0)), built)

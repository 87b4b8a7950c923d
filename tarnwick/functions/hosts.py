"""Which URLs lead to a public address: hosts as numbers, met with a sorted table of reserved ranges."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.text import let

#: Fixed blocks of addresses that are private, of this host, link or site, reserved, for documentation or for many receivers.
RESERVED = (
    "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 "
    "::/3 4000::/2 8000::/1 2001::/23 2001:db8::/32 3fff::/20"
).split()
#: Fixed names that stand for this host or network.
OWN_NAMES, OWN_ENDS = ("localhost",), (".local", ".internal", ".localhost")


def range_table(blocks: Sequence[str] = RESERVED) -> list[tuple[str, str]]:
    """(first, last) of each block as keys (see address_key), overlapping ones merged, in order."""
    keys = lambda a: f"{a.version}{int(a):0{8 if a.version == 4 else 32}x}"
    nets = [ipaddress.ip_network(b) for b in blocks]
    merged = [n for v in (4, 6) for n in ipaddress.collapse_addresses([n for n in nets if n.version == v])]
    return sorted((keys(n[0]), keys(n[-1])) for n in merged)


def _number(part: Column) -> Column:
    """The value of a part of a numeric host: hexadecimal after 0x, octal after 0, else decimal; null if it is none or too large."""
    hexed, octal = F.regexp_extract(part, r"^0x0*+([0-9a-f]{0,8})$", 1), F.regexp_extract(part, r"^0+([1-7][0-7]{0,10})$", 1)
    return (
        F.when(part.rlike(r"^0x0*+[0-9a-f]{0,8}$"), F.conv(F.concat(F.lit("0"), hexed), 16, 10).cast("long"))
        .when(part.rlike(r"^0+$"), F.lit(0).cast("long")).when(part.rlike(r"^0+[1-7][0-7]{0,10}$"), F.conv(octal, 8, 10).cast("long"))
        .when(part.rlike(r"^[1-9][0-9]{0,9}$"), F.expr("1L") * F.try_to_number(part, F.lit("9999999999")).cast("long"))
    )


def ipv4(host: Column) -> Column:
    """The number of an IPv4 host of one to four parts, the last of which fills the bytes that are left; null for anything else."""

    def number(values: Column) -> Column:
        n = F.size(values)
        sound = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(F.slice(values, F.lit(1), n - 1), lambda v: v <= 255) & (F.element_at(values, -1) < F.pow(F.lit(256), 5 - n))
        places = F.transform(values, lambda v, i: v * F.when(i == n - 1, F.lit(1)).otherwise(F.pow(F.lit(256), 3 - i).cast("long")))
        return F.when(F.coalesce(sound, F.lit(False)), F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x))

    return let(F.transform(F.split(host, r"\.", -1), _number), number)


_GROUPS = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"


def ipv6(host: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 host (no brackets, a zone left out); null for anything else."""

    def plain(bare: Column) -> Column:
        """An IPv4 address at the end as two groups."""
        tail = F.regexp_extract(bare, r":([0-9]+\.[0-9.]+)$", 1)
        four = let(ipv4(tail), lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535)))))
        return F.when(tail == "", bare).otherwise(F.concat(F.substring(bare, F.lit(1), F.char_length(bare) - F.char_length(tail)), four))

    def digits(halves: Column) -> Column:
        groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":", -1), lambda g: g != "")
        gap = F.when(F.size(halves) == 2, F.greatest(8 - F.size(groups(0)) - F.size(groups(1)), F.lit(1))).otherwise(F.lit(0))
        whole = F.concat(groups(0), F.array_repeat(F.lit("0"), gap), groups(1))
        return let(whole, lambda w: F.when((F.size(halves) <= 2) & (F.size(w) == 8), F.array_join(F.transform(w, lambda g: F.lpad(g, 4, "0")), "")))

    return let(let(F.substring_index(host, "%", 1), plain), lambda x: F.when(x.rlike(f"^(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?$"), let(F.split(x, "::", -1), digits)))


def address_key(host: Column) -> Column:
    """A literal address as a key whose order is that of the addresses: 4 and eight hexadecimal digits, or 6 and 32; null for names. IPv6 hosts may stand in brackets."""

    def key(low: Column) -> Column:
        four = let(ipv4(low), lambda n: F.concat(F.lit("4"), F.lower(F.lpad(F.hex(n), 8, "0"))))
        return F.when(low.contains(":"), F.concat(F.lit("6"), ipv6(F.regexp_replace(low, r"^\[|\]$", "")))).otherwise(four)

    return let(F.lower(F.trim(host)), key)


def in_ranges(key: Column, ranges: Sequence[tuple[str, str]]) -> Column:
    """Whether the key lies in one of the sorted, disjoint ranges: the last one that begins at or before it decides."""
    table = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ranges])
    return F.coalesce(F.try_element_at(F.filter(table, lambda r: r["first"] <= key), F.lit(-1))["last"] >= key, F.lit(False))


def public_url(url: Column, resolved: Column | None = None, blocks: Sequence[str] = RESERVED) -> Column:
    """Whether an http(s) URL may be fetched: its host is no name of this host or network and no address in a reserved block.

    A host that ends in a number must be a sound address. Names are not looked up: `resolved`, if given, is an array of the addresses that the host's name has, of which
    there must be some and all must be public. Null and malformed URLs, and those with a wrong port, are not public.
    """
    ranges = range_table(blocks)

    def judged(place: Column) -> Column:
        name = F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:\[\]]*)(?::[0-9]*)?$", 1))
        port = F.coalesce(F.nullif(F.regexp_extract(place, r":0*+([0-9]{1,9})$", 1), F.lit("")).cast("long"), F.lit(0))
        return (port <= 65535) & ~place.rlike(r":[0-9]{10,}$") & let(F.regexp_replace(name, r"\.$", ""), allowed)

    def allowed(bare: Column) -> Column:
        own = bare.isin("", *OWN_NAMES)
        for end in OWN_ENDS:
            own = own | bare.endswith(end)
        numeric = bare.rlike(r"^\[|(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$")
        return ~own & let(address_key(bare), lambda key: F.when(key.isNotNull(), ~in_ranges(key, ranges)).otherwise(~numeric & named))

    named = F.lit(True)
    if resolved is not None:
        keys = F.transform(resolved, lambda a: let(address_key(a), lambda k: k.isNotNull() & ~in_ranges(k, ranges)))
        named = F.coalesce((F.size(resolved) > 0) & F.forall(keys, lambda ok: ok), F.lit(False))
    authority = F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^(?i:https?)://([^/?#\\]*)", 1)
    return F.coalesce(let(F.substring_index(authority, "@", -1), judged), F.lit(False))

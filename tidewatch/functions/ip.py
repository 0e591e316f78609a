"""IP address parsing and classification as native expressions.

IPv4 is tested by compiled patterns on the text. An IPv6 address becomes a sortable key of 32 hex digits, so that
membership in a network block is one BETWEEN. No Python runs per row.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special-purpose blocks of the public IANA registries, and the exceptions inside them.
PRIVATE_V4 = (
    "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.0.170/31 "
    "192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 255.255.255.255/32"
).split()
PUBLIC_INSIDE_PRIVATE_V4 = "192.0.0.9/32 192.0.0.10/32".split()
SHARED_V4 = "100.64.0.0/10".split()
PRIVATE_V6 = (
    "::1/128 ::/128 ::ffff:0:0/96 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10"
).split()
PUBLIC_INSIDE_PRIVATE_V6 = (
    "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28"
).split()

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
GROUP = "[0-9a-f]{1,4}"
V6_PATTERN = f"^({GROUP}(:{GROUP})*)?(::({GROUP}(:{GROUP})*)?)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A bound variable keeps the expression small when the optimizer moves it, for example when a filter on the
    result is pushed below the projection that computes it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _octets(parts: Column) -> list[Column]:
    return [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]


def v6_key(text: Column) -> Column:
    """The address as 32 lower-case hex digits; NULL when the text is no IPv6 address."""
    def hex_tail(bare: Column) -> Column:
        """A dotted-quad ending rewritten as two hex groups."""
        def rewritten(parts: Column) -> Column:
            a, b, c, d = _octets(parts)
            return F.concat(F.regexp_replace(bare, "[0-9.]+$", ""), F.lower(F.hex(a * 256 + b)), F.lit(":"), F.lower(F.hex(c * 256 + d)))

        quad = F.split(F.regexp_extract(bare, "([0-9.]+)$", 1), r"\.")
        return F.when(bare.rlike(rf":{V4_PATTERN[1:]}"), let(quad, rewritten)).otherwise(bare)

    def key(plain: Column) -> Column:
        return F.when(plain.rlike(V6_PATTERN), let(F.split(plain, "::"), joined))

    def joined(halves: Column) -> Column:
        return let(F.struct(F.size(halves).alias("n"), side(halves, 0).alias("head"), side(halves, 1).alias("rest")), padded)

    def side(halves: Column, i: int) -> Column:
        groups = F.filter(F.split(F.get(halves, F.lit(i)), ":"), lambda g: g != "")
        return F.transform(F.coalesce(groups, F.array().cast("array<string>")), lambda g: F.lpad(g, 4, "0"))

    def padded(s: Column) -> Column:
        used = F.size(s["head"]) + F.size(s["rest"])
        complete = ((s["n"] == 2) & (used <= 7)) | ((s["n"] == 1) & (used == 8))
        return F.when(complete, F.concat(
            F.array_join(s["head"], ""), F.repeat(F.lit("0000"), F.lit(8) - used), F.array_join(s["rest"], "")
        ))

    # one non-empty scope id is allowed
    bare = F.lower(F.regexp_replace(text, "%[^%]+$", ""))
    return F.when(text.contains(":"), let(let(bare, hex_tail), key))


def is_address(text: Column) -> Column:
    return F.when(text.contains(":"), v6_key(text).isNotNull()).otherwise(text.rlike(V4_PATTERN))


def _within(key: Column, blocks: list[str]) -> Column:
    """Membership of an IPv6 key in blocks: one BETWEEN each."""
    def bounds(block: str) -> Column:
        network = ipaddress.ip_network(block)
        return key.between(f"{int(network.network_address):032x}", f"{int(network.broadcast_address):032x}")

    return reduce(lambda a, b: a | b, [bounds(block) for block in blocks])


def _block_pattern(block: str) -> str:
    """Text form of an IPv4 block: whole octets as they are, a divided octet as its values."""
    network = ipaddress.ip_network(block)
    whole, part = divmod(network.prefixlen, 8)
    octets = str(network.network_address).split(".")
    pattern = "".join(rf"{o}\." for o in octets[:whole])
    if part:
        first = int(octets[whole])
        pattern += f"({'|'.join(str(v) for v in range(first, first + 2 ** (8 - part)))})" + r"\."
    return pattern[:-2] + "$" if whole + bool(part) == 4 else pattern


def _in_v4(text: Column, blocks: list[str]) -> Column:
    return text.rlike(f"^({'|'.join(_block_pattern(b) for b in blocks)})")


def _class_of_v4(text: Column, strict_multicast: bool) -> Column:
    """Compiled pattern tests on the text itself: nothing is parsed, and a filter on the result stays small."""
    private = _in_v4(text, PRIVATE_V4) & ~_in_v4(text, PUBLIC_INSIDE_PRIVATE_V4)
    multicast = _in_v4(text, ["224.0.0.0/4"])
    not_public = private | _in_v4(text, SHARED_V4) | (multicast if strict_multicast else F.lit(False))
    return (
        F.when(text.isNull() | ~text.rlike(V4_PATTERN), "Invalid")
        .when(~not_public, "Public")
        .when(_in_v4(text, ["127.0.0.0/8"]), "Loopback")
        .when(_in_v4(text, ["169.254.0.0/16"]), "Link-local")
        .when(multicast, "Multicast")
        .when(text == "0.0.0.0", "Unspecified")
        .when(private, "Private")
        .otherwise("Other non-public")
    )


def _class_of_v6(key: Column, strict_multicast: bool) -> Column:
    private = _within(key, PRIVATE_V6) & ~_within(key, PUBLIC_INSIDE_PRIVATE_V6)
    multicast = _within(key, ["ff00::/8"])
    return (
        F.when(~private & (~multicast if strict_multicast else F.lit(True)), "Public")
        .when(key == f"{1:032x}", "Loopback")
        .when(_within(key, ["fe80::/10"]), "Link-local")
        .when(multicast, "Multicast")
        .when(key == f"{0:032x}", "Unspecified")
        .otherwise("Private")
    )


def ip_class(text: Column, strict_multicast: bool = False) -> Column:
    """One of nine outcomes, first match wins.

    Globally routable comes first, so multicast counts as Public unless ``strict_multicast`` is set. An IPv4
    address mapped into IPv6 is judged by its IPv4 part.
    """
    def mapped(quad: Column) -> Column:
        return F.when(quad == "0.0.0.0", "Private").otherwise(_class_of_v4(quad, strict_multicast))  # only :: is unspecified

    def long(key: Column) -> Column:
        quad = F.concat_ws(".", *[F.conv(F.substring(key, 25 + 2 * i, 2), 16, 10) for i in range(4)])
        return (
            F.when(key.isNull(), "Invalid").when(_within(key, ["::ffff:0:0/96"]), let(quad, mapped))
            .otherwise(_class_of_v6(key, strict_multicast))
        )

    return F.when(text.contains(":"), let(v6_key(text), long)).otherwise(_class_of_v4(text, strict_multicast))


def is_public_ip(text: Column) -> Column:
    return ip_class(text) == "Public"

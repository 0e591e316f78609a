"""Classification of observed names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.cleaning import drop_wildcard, tidy_domain
from tidewatch.functions.ip import is_address, let

# Name endings and the form of one host-name label.
REVERSE_SUFFIXES = (".in-addr.arpa", ".ip6.arpa")
LOCAL_SUFFIXES = (".local", ".lan", ".home", ".internal")
LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
HOST_NAME = f"^{LABEL}([.]{LABEL})+$"
PUBLIC_DOMAIN = "Public domain candidate"


def _ends_with_any(name: Column, suffixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.endswith(s) for s in suffixes])


def domain_class(text: Column) -> Column:
    """One of five candidate types, first match wins."""
    def outcome(name: Column) -> Column:
        return (
            F.when(is_address(name), "IP address")
            .when(_ends_with_any(name, REVERSE_SUFFIXES), "Reverse DNS")
            .when(~name.contains(".") | _ends_with_any(name, LOCAL_SUFFIXES), "Local or single name")
            .when(name.rlike(HOST_NAME), PUBLIC_DOMAIN)
            .otherwise("Non-hostname DNS value")
        )

    return let(drop_wildcard(tidy_domain(text)), outcome)

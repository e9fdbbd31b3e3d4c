"""Addresses that a fetcher must not go to, as column expressions, and errors that are worth another try."""

from __future__ import annotations

from pyspark.sql import functions as F

from .values import let

# IPv4 networks that aren't public, prefixes of IPv6 ones, and marks of passing faults.
CLOSED_V4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
CLOSED_V6 = r"^(::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|ff[0-9a-f]{2}:.*|2001:db8:.*|2001:0?db8:.*|100::.*)$"
RETRYABLE = r"rate limit|429|timeout|timed out|500|502|503|504|overloaded|connection|temporarily"
_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def v4_closed(address):
    """Is a dotted IPv4 address private, loopback, link-local, reserved, multicast or unspecified? Null if it is none."""
    parts = F.transform(F.split(address, r"\."), lambda x: x.cast("long"))

    def closed(p):
        def inside(n):
            out = F.lit(False)
            for net in CLOSED_V4:
                base, bits = net.split("/")
                low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
                out = out | n.between(low, low + 2 ** (32 - int(bits)) - 1)
            return out

        return F.when(F.array_max(p) <= 255, let(p[0] * 2**24 + p[1] * 2**16 + p[2] * 2**8 + p[3], inside))

    return F.when(address.rlike(_V4), let(parts, closed))


def host_of(url):
    """Host of a URL in lower case, brackets of an IPv6 address off."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)
    return F.regexp_replace(found, r"^\[|\]$", "")


def unsafe_reason(url):
    """Why a URL must not be fetched, as far as it says itself: null if nothing is wrong. Names are resolved elsewhere, and every
    address found there is to pass address_closed() too."""
    scheme = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^([a-z][a-z0-9+.-]*):", 1)

    def fault(host):
        return F.when(host == "", "host").when((host == "localhost") | host.endswith(".localhost") | F.coalesce(address_closed(host), F.lit(False)), "address")

    return F.when(~scheme.isin("http", "https"), "scheme").otherwise(let(host_of(url), fault))


def address_closed(address):
    """Is a literal address, IPv4, IPv6 or IPv4 within IPv6, not a public one? Null for what is no address."""
    inner = F.regexp_extract(address, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    return F.when(inner != "", v4_closed(inner)).when(address.contains(":"), address.rlike(CLOSED_V6)).otherwise(v4_closed(address))


def retryable(error):
    """Is an error's text one of a fault that passes?"""
    return F.lower(F.coalesce(error, F.lit(""))).rlike(RETRYABLE)

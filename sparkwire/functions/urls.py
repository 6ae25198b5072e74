"""URL predicates, canonical form and key, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwire.vocab import TRACKING_PARAMS

_UNSAFE = r"""(?U)[\s<>"{}|\\^`\x00-\x1f\x7f]"""
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def strip(text: Column) -> Column:
    """Without white space at either end, in any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _authority(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _PARTS, 2), "^.*@", "")


def host(url: Column) -> Column:
    """Lower-case host, brackets of an IPv6 literal kept; '' if there is none."""
    return F.lower(F.regexp_extract(_authority(strip(url)), r"^(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(?::[^:]*)?$", 1))


def is_http_url(url: Column) -> Column:
    u = strip(url)
    ok = ~u.rlike(_UNSAFE) & F.lower(F.regexp_extract(u, _PARTS, 1)).isin("http", "https") & (host(url) != "")
    return F.coalesce(ok, F.lit(False))


def is_tracking_param(name: Column) -> Column:
    """Of a raw query name; judged by its decoded form."""
    decoded = F.lower(F.coalesce(F.try_url_decode(name), F.replace(name, F.lit("+"), F.lit(" "))))
    return decoded.startswith("utm_") | decoded.isin(*TRACKING_PARAMS)


def canonical_url(url: Column) -> Column:
    """The canonical form, or null where the url is no http(s) url or its port is bad."""
    u = strip(url)
    scheme = F.lower(F.regexp_extract(u, _PARTS, 1))
    port = F.regexp_extract(_authority(u), r"^(?:\[[^\]]*\]|[^:]*)(?::(.*))?$", 1)
    number = F.try_to_number(F.when(port.rlike("^[0-9]{1,9}$"), port), F.lit("999999999")).cast("long")
    bad = (port != "") & (number.isNull() | (number > 65535))
    default = (port == "") | ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    segments = F.split(F.regexp_extract(u, _PARTS, 4), "&")
    kept = F.filter(segments, lambda s: (s != "") & ~is_tracking_param(F.substring_index(s, "=", 1)))
    path = F.regexp_extract(u, _PARTS, 3)
    query = F.array_join(kept, "&")
    out = F.concat(
        scheme, F.lit("://"), host(url), F.when(default, "").otherwise(F.concat(F.lit(":"), number.cast("string"))),
        F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(is_http_url(url) & ~bad, out)


def url_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)

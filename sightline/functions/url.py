"""Column expressions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme and host, path, query, fragment
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normal_url(c: Column) -> Column:
    """Scheme and host in lower case; no fragment, no utm_ parameters, no slash at the end of the path. Null stays null; text without a scheme is treated as a path."""
    u = F.regexp_replace(c, r"[\r\n]", "")
    kept = F.filter(F.split(F.regexp_extract(u, PARTS, 3), "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    return F.concat(
        F.lower(F.regexp_extract(u, PARTS, 1)),
        F.regexp_replace(F.regexp_extract(u, PARTS, 2), r"/+$", ""),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )


#: Fixed value: parameters that tell how a visitor came, not what is asked for.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_ga", "sessionid", "sid", "token", "csrf", "csrf_token")


def asset_url(c: Column) -> Column:
    """A URL without fragment, tracking parameters (in any case) and parameters without a value; the rest as it is."""
    kept = F.filter(F.split(F.regexp_extract(c, PARTS, 3), "&"), lambda p: p.contains("=") & ~p.endswith("=") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    return F.concat(F.regexp_extract(c, PARTS, 1), F.regexp_extract(c, PARTS, 2), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def file_name(c: Column) -> Column:
    """The last part of a URL's path; null if there is none."""
    return F.nullif(F.substring_index(F.regexp_replace(F.regexp_extract(c, PARTS, 2), "/+$", ""), "/", -1), F.lit(""))


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1))

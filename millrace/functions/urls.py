"""URLs as columns: what identifies a posting and how authoritative the link is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import ATS_HOSTS, TRACKING_PARAMS

# scheme, authority, path, query, fragment
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def host_of(url: Column) -> Column:
    """The lower-case host without user and port, else the empty string."""
    authority = F.regexp_extract(F.trim(url), PARTS, 2)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""))


def canonical_url(url: Column, tracking: list[str] = TRACKING_PARAMS) -> Column:
    """Lower-case host without www, no default port, fragment, tracking parameter or trailing slash.

    The rest of the query is sorted and keeps its encoding. Null and empty give the empty string.
    """
    url = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.coalesce(F.nullif(F.lower(F.regexp_extract(url, PARTS, 1)), F.lit("")), F.lit("https"))
    port = F.regexp_extract(F.regexp_extract(url, PARTS, 2), r":(\d+)$", 1)
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    host = F.when((port != "") & ~port.isin("80", "443"), F.concat(host, F.lit(":"), port)).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(url, PARTS, 3), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)

    def kept(p):
        key = F.lower(F.element_at(F.split(p, "=", 2), 1))
        return p.rlike("^[^=]*=.") & ~key.isin(tracking)

    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(url, PARTS, 4), "&"), kept)), "&")
    query = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    return F.when(url == "", "").otherwise(F.concat(scheme, F.lit("://"), host, path, query))


def _within(host: Column, domain: Column) -> Column:
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def url_authority(url: Column, employer_domain: Column | None = None) -> Column:
    """3 for the employer's own domain, 2 for a board that employers run, 1 for anything else."""
    host = host_of(F.coalesce(url, F.lit("")))
    domain = F.lit(None).cast("string") if employer_domain is None else employer_domain
    domain = F.nullif(F.regexp_replace(F.lower(F.trim(domain)), r"^\.+", ""), F.lit(""))
    is_board = F.lit(False)
    for known in ATS_HOSTS:
        is_board = is_board | _within(host, F.lit(known))
    own = F.coalesce(_within(host, domain), F.lit(False))
    return F.when(host == "", 1).when(own, 3).when(is_board, 2).otherwise(1).cast("int")

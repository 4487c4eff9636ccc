"""URL keys as native column expressions.

Five keys look alike but differ on purpose: what counts as "the same page" depends on the question
asked (merging search results, queueing work, exporting entities, pausing or rate limiting an origin).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmlens.functions.text import WHITESPACE, let

_SEPARATOR = "\x01"
# scheme, host, port, path and query of any text; user info and fragment are left out.
_URL = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
    r"(?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:\[]*)(?::([^/?#]*))?)?"
    r"([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
)
_HOST = (
    r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:\[]*)"
)
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
WEB_SCHEMES = ("http", "https")


def _clean(url: Column) -> Column:
    return F.translate(F.btrim(url, F.lit(WHITESPACE)), f"\t\r\n{_SEPARATOR}", "")


class UrlParts:
    """Pieces of one URL; scheme and host are lower case, an absent port is ''."""

    def __init__(self, pieces: Column) -> None:
        scheme, host, port, path, query = (F.get(pieces, F.lit(index)) for index in range(5))
        self.scheme = F.lower(scheme)
        self.host = F.lower(F.translate(host, "[]", ""))
        self.port = F.regexp_replace(port, "^0+(?=[0-9])", "")
        self.port_ok = F.when(port == "", True).when(
            port.rlike("^[0-9]{1,9}$"), port.try_cast("int") <= 65535
        ).otherwise(False)
        self.path = path
        self.query = query

    @property
    def is_web(self) -> Column:
        return self.scheme.isin(*WEB_SCHEMES) & (self.host != "")

    @property
    def is_default_port(self) -> Column:
        return ((self.scheme == "http") & (self.port == "80")) | (
            (self.scheme == "https") & (self.port == "443")
        )


def with_parts(url: Column, use: Callable[[UrlParts], Column]) -> Column:
    """Split a URL with one pattern match and build an expression on its pieces."""
    marked = F.regexp_replace(_clean(url), _URL, _SEPARATOR.join(f"${n}" for n in range(1, 6)))
    return let(F.split(marked, _SEPARATOR, -1), lambda pieces: use(UrlParts(pieces)))


def hostname(url: Column) -> Column:
    """Lower-case host name without user info and port, '' when there is none."""
    return F.lower(F.translate(F.regexp_extract(_clean(url), _HOST, 1), "[]", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _PATH, 1)


def _with_query(base: Column, query: Column) -> Column:
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def _or_root(path: Column) -> Column:
    return F.when(path == "", F.lit("/")).otherwise(path)


def _host_port(parts: UrlParts, keep_default: bool) -> Column:
    hide = parts.port == ""
    if not keep_default:
        hide = hide | parts.is_default_port
    return F.when(hide, parts.host).otherwise(F.concat(parts.host, F.lit(":"), parts.port))


def _origin(parts: UrlParts, keep_default: bool) -> Column:
    return F.concat(parts.scheme, F.lit("://"), _host_port(parts, keep_default))


def normalize_search_url(url: Column) -> Column:
    """Key for merging results across providers; '' for anything but a valid http(s) URL."""

    def key(parts: UrlParts) -> Column:
        path = _or_root(F.rtrim(parts.path, F.lit("/")))
        full = _with_query(F.concat(_origin(parts, keep_default=False), path), parts.query)
        return F.when(parts.is_web & parts.port_ok, full).otherwise("")

    return with_parts(url, key)


def task_key(url: Column) -> Column:
    """Work-queue key: explicit ports and trailing slashes stay; NULL when not absolute http(s)."""

    def key(parts: UrlParts) -> Column:
        full = F.concat(_origin(parts, keep_default=True), _or_root(parts.path))
        return F.when(parts.is_web & parts.port_ok, _with_query(full, parts.query))

    return with_parts(url, key)


def export_url_key(url: Column) -> Column:
    """Entity key of the export: host and path only, whatever the scheme, port or query."""
    return F.concat(hostname(url), _or_root(F.rtrim(path_of(url), F.lit("/"))))


def pause_origin(url: Column) -> Column:
    """Origin used for domain pauses; the port is dropped. NULL when not absolute http(s)."""
    return with_parts(
        url, lambda parts: F.when(parts.is_web, F.concat(parts.scheme, F.lit("://"), parts.host))
    )


def fetch_origin(url: Column) -> Column:
    """Origin used for rate limits and robots rules; non-default ports are kept."""

    def key(parts: UrlParts) -> Column:
        return F.when(parts.is_web & parts.port_ok, _origin(parts, keep_default=False))

    return with_parts(url, key)


def legacy_normalized_url(url: Column) -> Column:
    """Fallback key of rows stored before normalized URLs existed."""
    return F.lower(F.rtrim(url, F.lit("/")))


def robots_path(url: Column) -> Column:
    """Path plus query, as matched by robots rules."""
    return with_parts(url, lambda parts: _with_query(_or_root(parts.path), parts.query))


def is_web_url(url: Column) -> Column:
    return with_parts(url, lambda parts: parts.is_web)

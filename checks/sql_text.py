"""SQL pieces shared by several counterparts: page text, URL parts."""

# Page text the way a browser-like text dump sees it: scripts, styles, comments and tags removed.
UNESCAPE = (
    "regexp_replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), "
    "'&middot;', '·'), '&amp;?', '&', 'g')"
)
TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"
_PIECES = (
    "string_split(regexp_replace(regexp_replace(html, "
    "'(?s)<script.*?</script>|<style.*?</style>', '<x>', 'g'), '(?s)<[^>]*(>|$)', chr(1), 'g'), "
    "chr(1))"
)
TOKENS = (
    f"list_filter(list_transform({_PIECES}, lambda p: {TRIM.format(UNESCAPE.format('p'))}), "
    "lambda p: p <> '')"
)
_TITLE = TRIM.format(UNESCAPE.format("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
_H1 = TRIM.format(UNESCAPE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))
PAGE_TEXT = (
    f"t_page AS (SELECT page_id, url, html, {TOKENS} AS tokens, {_TITLE} AS title, "
    f"{_H1} AS h1 FROM pages)"
)

HOST = "lower(split_part(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':', 1))"
PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
ENTITY = f"({HOST} || CASE WHEN rtrim({PATH}, '/') = '' THEN '/' ELSE rtrim({PATH}, '/') END)"


def url_parts(source: str, url: str = "url") -> str:
    """Common table expression ``u`` with the pieces of a URL column."""
    scheme = "'^[A-Za-z][A-Za-z0-9+.-]*:"
    return f"""
u0 AS (SELECT *, trim({url}) AS t FROM {source}),
u1 AS (SELECT *, lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  regexp_extract(regexp_extract(t, {scheme}//([^/?#]*)', 1), '([^@]*)$', 1) AS hostport,
  regexp_extract(t, {scheme}//[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(t, '^[^?#]*[?]([^#]*)', 1) AS q FROM u0),
u AS (SELECT *, lower(split_part(hostport, ':', 1)) AS host, split_part(hostport, ':', 2) AS port,
  scheme IN ('http', 'https') AND split_part(hostport, ':', 1) <> '' AS web,
  split_part(hostport, ':', 2) = '' OR TRY_CAST(split_part(hostport, ':', 2) AS INT) <= 65535 AS port_ok,
  (scheme = 'http' AND split_part(hostport, ':', 2) = '80')
    OR (scheme = 'https' AND split_part(hostport, ':', 2) = '443') AS default_port
  FROM u1)"""

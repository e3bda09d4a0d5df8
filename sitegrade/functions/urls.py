"""URL helpers."""

HTTP = "http://"
HTTPS = "https://"


def host_of(url: str) -> str:
    """Drop every ``http://`` and ``https://``, keep the text before the first ``/``, then ``:``."""
    bare = f"replace(replace({url}, '{HTTP}', ''), '{HTTPS}', '')"
    return f"split_part(split_part({bare}, '/', 1), ':', 1)"


def http_url(host: str) -> str:
    return f"concat('{HTTP}', {host})"


def https_url(host: str) -> str:
    return f"concat('{HTTPS}', {host})"


def domain_of(url: str) -> str:
    """Authority of a URL (its path when there is none), without ``www.`` and port.

    Letter case and user-info stay, unlike with ``parse_url(..., 'HOST')``.
    """
    clean = rf"translate(regexp_replace({url}, r'^[\x00-\x20]+', ''), '\t\r\n', '')"
    rest = rf"regexp_replace({clean}, r'^[a-zA-Z][a-zA-Z0-9+.\-]*:', '')"
    authority = f"regexp_extract({rest}, r'^//([^/?#]*)', 1)"
    path = f"regexp_extract(regexp_replace({rest}, r'^//[^/?#]*', ''), r'^([^?#]*)', 1)"
    domain = f"coalesce(nullif({authority}, ''), regexp_replace({path}, r';[^/]*$', ''))"
    return rf"split_part(regexp_replace({domain}, r'^www\.', ''), ':', 1)"


def is_https(url: str) -> str:
    return f"coalesce(startswith({url}, '{HTTPS}'), false)"


def stays_on_domain(host: str, final_url: str) -> str:
    """True when an https final URL has the domain the scan started from."""
    return f"coalesce({is_https(final_url)} and {domain_of(host)} = {domain_of(final_url)}, false)"

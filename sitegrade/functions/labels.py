"""Names and cell texts used by the report tables."""

from __future__ import annotations

from sitegrade.functions.numeric import round2_by_value

# Country names, protocol names, header abbreviations.
COUNTRY_NAMES = {"de": "Germany", "fr": "France", "it": "Italy"}
PROTOCOL_NAMES = {"h2": "http/2", "h3": "http/3"}
HTTP_VERSIONS = ("http/3", "http/2", "http/1.1", "http/1.0")
SHORT_NAMES = {
    "strict-transport-security": "HSTS",
    "x-xss-protection": "XXP",
    "x-frame-options": "XFO",
    "x-content-type-options": "XCTO",
    "referrer-policy": "RP",
    "cross-origin-opener-policy": "COOP",
    "cross-origin-embedder-policy": "COEP",
    "cross-origin-resource-policy": "CORP",
    "access-control-allow-origin": "CORS",
    "content-security-policy": "CSP",
    "set-cookie": "SC",
}
GLOSSARY_TERMS = ("HSTS", "XFO", "COOP", "COEP", "CORP", "CORS", "CSP")


def lookup(names: dict[str, str], key: str) -> str:
    """Replace known keys, keep others."""
    branches = " ".join(f"when '{known}' then '{name}'" for known, name in names.items())
    return f"case {key} {branches} else {key} end"


def country_name(code: str) -> str:
    return lookup(COUNTRY_NAMES, code)


def country_code(name: str) -> str:
    return lookup({name: code for code, name in COUNTRY_NAMES.items()}, name)


def protocol_name(protocol: str) -> str:
    return lookup(PROTOCOL_NAMES, protocol)


def short_name(header: str) -> str:
    return SHORT_NAMES.get(header, header)


def glossary_name(header: str) -> str:
    short = short_name(header)
    return rf"\gls{{{short.lower()}}}" if short in GLOSSARY_TERMS else short


def accept_language(country: str, languages: dict[str, str], default: str = "en") -> str:
    pairs = ", ".join(f"'{code}', '{value}'" for code, value in languages.items())
    return f"coalesce(try_element_at(map({pairs}), {country}), '{default}')"


def metric_label(metric: str) -> str:
    """``a_b_between_platforms`` becomes ``A B``."""
    return f"replace(initcap(replace({metric}, '_', ' ')), ' Between Platforms', '')"


def column_label(metric: str) -> str:
    """Table heading of a metric: its label without "Inconsistency"."""
    return f"replace({metric_label(metric)}, ' Inconsistency', '')"


def two_decimals(x: str) -> str:
    return f"format_string('%.2f', {round2_by_value(x)})"


def cell(x: str) -> str:
    """``-`` for null and zero, whole numbers without decimals, two decimals otherwise."""
    return (
        f"case when coalesce({x}, 0) = 0 then '-'"
        f" when {x} = floor({x}) then cast(cast({x} as bigint) as string)"
        f" else {two_decimals(x)} end"
    )


def whole_cell(x: str) -> str:
    """Heat-map text: ``-`` for zero, else no decimals."""
    return f"if({x} = 0, '-', cast(cast(rint({x}) as bigint) as string))"

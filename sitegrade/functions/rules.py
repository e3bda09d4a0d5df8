"""Strong/weak rules: SQL conditions over ``{v}``, the lower-cased header value.

A rule is text, so a policy is plain data. The fixed rules stand in ``policy.DEFAULT_RULES``.
"""

from __future__ import annotations

ONE_YEAR = "31536000"

# The characters that count as white space around a number (Unicode white space and
# the four information separators).
SPACE = (
    r" \t\n\u000b\u000c\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    r"\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def quoted(text: str) -> str:
    """A literal within a rule; braces are doubled, as rules are format strings."""
    text = text.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + text.replace("{", "{{").replace("}", "}}") + "'"


def contains_all(*needles: str) -> str:
    return " and ".join(f"contains({{v}}, {quoted(n)})" for n in needles)


def contains_none(*needles: str) -> str:
    return " and ".join(f"not contains({{v}}, {quoted(n)})" for n in needles)


def one_of(*values: str) -> str:
    return f"{{v}} in ({', '.join(quoted(v) for v in values)})"


def max_age(value: str) -> str:
    """The text that should be a number: after the first ``max-age=``, up to ``;``, trimmed.

    The control character U+0093 and commas are dropped from it.
    """
    token = f"split_part(split_part({value}, 'max-age=', 2), ';', 1)"
    return f"btrim(translate(btrim({token}, '{SPACE}'), '\\u0093,', ''), '{SPACE}')"


def _digits(number: str) -> str:
    return f"translate({number}, '+-_', '')"


# Helper columns a header's rules may use as ``{name}``, computed once per row.
MAX_AGE = {"age": f"if(contains({{v}}, 'max-age='), {max_age('{v}')}, null)"}


def max_age_unreadable() -> str:
    """A ``max-age=`` that is not followed by a whole number.

    A number is digits with single underscores between them, after at most one sign. The tests
    look at one character at a time, so no value is too long for them.
    """
    unsigned = "if({age} like '+%' or {age} like '-%', substr({age}, 2), {age})"
    return (
        f"{{age}} is not null and ({unsigned} = '' or regexp({unsigned}, '[^0-9_]')"
        f" or contains({unsigned}, '__') or startswith({unsigned}, '_') or endswith({unsigned}, '_'))"
    )


def strict_transport() -> str:
    """At least one year and sub-domains included.

    The age is compared as text (length first), so that no value is too long to compare.
    """
    digits = f"trim(leading '0' from {_digits('{age}')})"
    return (
        f"{{age}} is not null and {contains_all('includesubdomains')}"
        f" and not startswith({{age}}, '-') and (length({digits}) > {len(ONE_YEAR)}"
        f" or (length({digits}) = {len(ONE_YEAR)} and {digits} >= '{ONE_YEAR}'))"
    )

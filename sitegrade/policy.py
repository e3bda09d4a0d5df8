"""The assessment policy: which headers count, what makes them strong, how they weigh.

A policy is plain data. A user adds a header by adding its condition to ``rules``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from sitegrade.functions import rules as R

# Expected headers in report order, and what makes each of them strong.
# All content-security-policy conditions hold at once only for a value that equals its
# frame-ancestors part and contains the others, so none is ever strong.
DEFAULT_RULES = {
    "x-xss-protection": R.contains_all("1; mode=block"),
    "x-frame-options": R.one_of("deny", "sameorigin"),
    "x-content-type-options": R.one_of("nosniff"),
    "referrer-policy": R.one_of("no-referrer", "same-origin", "strict-origin-when-cross-origin"),
    "access-control-allow-origin": R.contains_none("*", "null"),
    "strict-transport-security": R.strict_transport(),
    "content-security-policy": " and ".join(
        [
            R.contains_all(
                "default-src 'self'",
                "form-action 'self'",
                "object-src 'none'",
                "upgrade-insecure-requests",
                "block-all-mixed-content",
            ),
            R.contains_none("unsafe-eval"),
            f"({R.contains_none('unsafe-inline')}"
            f" or {R.contains_all('nonce-')} or {R.contains_all('hash-')})",
            R.one_of("frame-ancestors 'self'", "frame-ancestors 'none'"),
            R.contains_none("https://*"),
        ]
    ),
    "cross-origin-resource-policy": R.one_of("same-origin", "same-site"),
    "cross-origin-embedder-policy": R.one_of("require-corp", "credentialless"),
    "cross-origin-opener-policy": R.one_of("same-origin", "same-origin-allow-popups"),
    "set-cookie": " and ".join(
        [
            R.contains_all("secure", "httponly"),
            f"({R.contains_all('samesite=strict')} or {R.contains_all('samesite=lax')})",
        ]
    ),
}


@dataclass(frozen=True)
class Policy:
    rules: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_RULES))
    # Helper columns of a header's rules: name -> expression over ``{v}``.
    helpers: Mapping[str, Mapping[str, str]] = field(
        default_factory=lambda: {"strict-transport-security": R.MAX_AGE}
    )
    # Values that cannot be assessed at all and turn the observation into an error.
    unreadable: Mapping[str, str] = field(
        default_factory=lambda: {"strict-transport-security": R.max_age_unreadable()}
    )
    # Fixed values, down to ``max_passes``: roles, weights, platforms, languages and passes.
    deprecated: tuple[str, ...] = ("x-xss-protection", "x-frame-options")
    critical: tuple[str, ...] = ("strict-transport-security", "content-security-policy")
    multipliers: Mapping[str, float] = field(
        default_factory=lambda: {
            "strict-transport-security": 1.8,
            "content-security-policy": 1.5,
            "cross-origin-embedder-policy": 1.3,
            "cross-origin-resource-policy": 1.3,
            "cross-origin-opener-policy": 1.3,
        }
    )
    platforms: tuple[str, ...] = ("desktop", "mobile")
    languages: Mapping[str, str] = field(
        default_factory=lambda: {
            "de": "de;en;q=0.6",
            "fr": "fr;en;q=0.6",
            "it": "it;en;q=0.6",
        }
    )
    max_passes: int = 10

    def __post_init__(self) -> None:
        """Header names count in any letter case."""
        for name in ("rules", "helpers", "unreadable", "multipliers"):
            lowered = {header.lower(): value for header, value in getattr(self, name).items()}
            object.__setattr__(self, name, lowered)
        for name in ("deprecated", "critical"):
            object.__setattr__(self, name, tuple(header.lower() for header in getattr(self, name)))

    @property
    def headers(self) -> tuple[str, ...]:
        return tuple(self.rules)

    def header_points(self, header: str, label: str | None) -> float:
        """Points of one present header, given its configuration label."""
        points = 100 / (len(self.rules) - len(self.deprecated))
        if header in self.deprecated:
            points *= 0.6
        points *= {"strong": 1.4, "weak": 0.85}.get(label, 1)
        points *= self.multipliers.get(header, 1)
        return round(min(points, 100), 2)

    def role(self, header: str) -> str:
        if header in self.critical:
            return "critical"
        return "deprecated" if header in self.deprecated else "other"


DEFAULT_POLICY = Policy()

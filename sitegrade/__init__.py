"""Web security posture analytics as Spark DataFrame transformations."""

from sitegrade.policy import DEFAULT_POLICY, Policy

__all__ = ["DEFAULT_POLICY", "Policy"]

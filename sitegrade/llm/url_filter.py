"""URL filter by a path-template tree per host. Only DataFrame functions are used.

Given rules label the pages they fit. Every path becomes a template: segments that vary (numbers,
or positions of a host with too many different values) are wildcards. Templates and their prefixes
are the nodes of a tree below the host. A branch is merged with its siblings unless its share of
blocked labels differs significantly from that of all the others together; a branch without labels
has nothing that tells it apart and takes part in the merged ones. A node's purity is its share of
blocked labels, smoothed towards its parent's, from the global share downwards. A page that no rule
fits is blocked when the purity of its template reaches the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrade.llm.shared import cut, quoted
from sitegrade.operators.keyed import attach

# (verdict, host/path)
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


@dataclass(frozen=True)
class TreeSettings:
    # A position of a host is variable with more different values than this, if they have fewer
    # pages each than ``repeats`` on average.
    variety: int = 20
    repeats: int = 5
    smoothing: float = 2.0
    # Standard errors within which a branch counts as similar to its siblings.
    similar: float = 2.0
    purity: float = 0.85


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def after_scheme(url: str) -> str:
    return f"if(instr({url}, '://') > 0, substr({url}, instr({url}, '://') + 3), '')"


def host_of(url: str) -> str:
    """SQL: from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    raw = f"regexp_extract(coalesce({after_scheme(url)}, ''), '^[^/?#]*', 0)"
    return f"translate({raw}, '{upper}', '{upper.lower()}')"


def path_of(url: str) -> str:
    """SQL: what follows the host, up to ``?``, ``#`` or the end."""
    return f"regexp_extract(coalesce({after_scheme(url)}, ''), '^[^/?#]*([^?#]*)', 1)"


def rule_cases(rules: tuple[tuple[str, str], ...]) -> tuple[str, str]:
    """SQL for the longest fitting rule of a ``host`` and ``path``, and for its verdict."""
    rules_in_order, verdicts = [], []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, rest = rule.partition("/")
        fits = (
            f"(host = {_text(host)} or endswith(host, {_text('.' + host)}))"
            f" and startswith(path, {_text(slash + rest)})"
        )
        rules_in_order.append(f"when {fits} then {_text(rule)}")
        verdicts.append(f"when {fits} then {_text(verdict)}")
    if not rules_in_order:
        return "cast(null as string)", "cast(null as string)"
    return f"case {' '.join(rules_in_order)} end", f"case {' '.join(verdicts)} end"


def generalised(segment: str) -> str:
    """SQL: digits, and words that are mostly digits or hexadecimal, become a wildcard.

    A file ending stays.
    """
    return (
        f"case when {segment} rlike '^[0-9]+$' then '*'"
        f" when {segment} rlike '^[0-9]+[.][a-zA-Z]+$' then concat('*', regexp_extract({segment}, '[.][a-zA-Z]+$', 0))"
        f" when {segment} rlike '^(?=.*[0-9])[0-9a-fA-F-]{{8,}}$' then '*' else {segment} end"
    )


def judge(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    settings: TreeSettings = TreeSettings(),
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity``.

    A null url, or one without ``://``, has an empty host and path and is judged like any other.
    Repeated pages count as often as they occur. Of rules of equal length the first in text order
    wins. An empty table gives an empty result.
    """
    rule, verdict = rule_cases(rules)
    parsed = pages.selectExpr(
        f"{quoted(page_id)} as page_id", f"{host_of(quoted(url))} as host", f"{path_of(quoted(url))} as path"
    ).selectExpr("*", f"{rule} as rule", f"{verdict} as by_rule")
    segments = "filter(split(path, '/'), s -> s <> '')"
    listed = parsed.selectExpr("*", f"transform({segments}, s -> {generalised('s')}) as segments")
    rows = cut(listed, "pages")

    # Positions of a host that vary; a hot host is combined in two steps before it meets.
    values = rows.selectExpr("host", "posexplode(segments) as (position, segment)")
    seen = values.groupBy("host", "position", "segment").agg(F.count("*").alias("n"))
    spread = seen.groupBy("host", "position").agg(F.count("*").alias("different"), F.sum("n").alias("n"))
    varying = spread.filter(
        f"different > {settings.variety} and n < {settings.repeats} * different"
    ).groupBy("host").agg(F.collect_list("position").alias("varying"))
    wild = "if(array_contains(varying, p) and not startswith(s, '*'), '*', s)"
    templated = attach(rows, varying, ["host"]).selectExpr(
        "page_id", "host", "path", "rule", "by_rule",
        f"if(varying is null, segments, transform(segments, (s, p) -> {wild})) as segments",
    )
    templated = cut(templated.selectExpr("*", "array_join(segments, '/') as template"), "templates")

    # All nodes: the templates and their prefixes, each named by the digest of its segments, so that
    # a node takes the same room at any depth.
    leaves = templated.groupBy("host", "template").agg(
        F.expr("any_value(segments)").alias("segments"),
        F.count("by_rule").alias("labelled"),
        F.expr("count_if(by_rule = 'block')").alias("blocked"),
    )
    leaves = cut(leaves, "leaves")
    name = "md5(array_join(slice(segments, 1, {0}), '/'))"
    prefixes = leaves.selectExpr(
        "host", "template", "segments", "labelled", "blocked", "explode(sequence(0, size(segments))) as depth"
    ).selectExpr(
        "host", "template", "depth", f"{name.format('depth')} as node",
        f"if(depth = 0, null, {name.format('greatest(depth - 1, 0)')}) as parent", "labelled", "blocked",
    )
    nodes = prefixes.groupBy("host", "depth", "node", "parent").agg(
        F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")
    )
    nodes = cut(nodes, "nodes")
    # Each branch against all its siblings together: two shares of one, within their standard error.
    family = nodes.filter("depth > 0").groupBy("host", "depth", "parent").agg(
        F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked")
    )
    compared = attach(nodes, family, ["host", "depth", "parent"]).selectExpr(
        "*", "all_labelled - labelled as rest", "try_divide(all_blocked, all_labelled) as p"
    )
    apart = "abs(try_divide(blocked, labelled) - try_divide(all_blocked - blocked, rest))"
    bound = f"{settings.similar} * sqrt(p * (1 - p) * (try_divide(1, labelled) + try_divide(1, rest)))"
    merging = compared.selectExpr(
        "host", "depth", "node", "parent", "labelled", "blocked",
        f"""case when all_labelled is null then false when labelled = 0 or rest = 0 then true
            else {apart} <= {bound} end as similar""",
    )
    pools = merging.filter("similar").groupBy("host", "depth", "parent").agg(
        F.sum("labelled").alias("pool_labelled"), F.sum("blocked").alias("pool_blocked")
    )
    merged = attach(merging, pools, ["host", "depth", "parent"]).selectExpr(
        "host", "depth", "node",
        "if(similar, pool_labelled, labelled) as labelled",
        "if(similar, pool_blocked, blocked) as blocked",
    )

    # Purity of a template: from the global share down the path, each node shrunk to its parent.
    total = leaves.agg((F.sum("blocked") / F.greatest(F.sum("labelled"), F.lit(1))).alias("share"))
    paths = prefixes.select("host", "template", "depth", "node")
    chains = attach(paths, merged, ["host", "depth", "node"]).groupBy("host", "template").agg(
        F.expr("array_sort(collect_list(struct(depth, labelled, blocked)))").alias("chain")
    )
    step = f"(c.blocked + {settings.smoothing} * p) / (c.labelled + {settings.smoothing})"
    judged = (
        chains.withColumn("share", F.coalesce(total.scalar(), F.lit(0.0)))
        .selectExpr(
            "host",
            "template",
            f"aggregate(chain, cast(share as double), (p, c) -> cast({step} as double)) as purity",
        )
    )
    return attach(templated, judged, ["host", "template"]).selectExpr(
        "page_id", "host", "path", "rule",
        f"coalesce(by_rule, if(purity >= {settings.purity}, 'block', 'allow')) as verdict",
        "template", "purity",
    )

"""Expected results as SQL for another engine (DuckDB), written from the definitions.

The chain restates the model with windows and plain joins, so it shares no plan with the package.
Rounding: ``round_even(x * 100, 0) / 100``.
"""

from __future__ import annotations

# (column prefix, header, strong condition over v = lower(value), strong, weak and other points)
HEADERS = [
    ("xxp", "x-xss-protection", "contains(v, '1; mode=block')", 9.33, 5.67),
    ("xfo", "x-frame-options", "v IN ('deny', 'sameorigin')", 9.33, 5.67),
    ("xcto", "x-content-type-options", "v = 'nosniff'", 15.56, 9.44),
    ("rp", "referrer-policy",
     "v IN ('no-referrer', 'same-origin', 'strict-origin-when-cross-origin')", 15.56, 9.44),
    ("acao", "access-control-allow-origin",
     "NOT contains(v, '*') AND NOT contains(v, 'null')", 15.56, 9.44),
    ("hsts", "strict-transport-security",
     "age >= 31536000 AND contains(v, 'includesubdomains')", 28.0, 17.0),
    ("csp", "content-security-policy",
     " AND ".join([
         *[f"contains(v, '{x}')" for x in ("default-src ''self''", "form-action ''self''", "object-src ''none''",
                                           "upgrade-insecure-requests", "block-all-mixed-content")],
         "NOT contains(v, 'unsafe-eval')", "NOT contains(v, 'https://*')",
         "(NOT contains(v, 'unsafe-inline') OR contains(v, 'nonce-') AND contains(v, 'hash-'))",
         "v IN ('frame-ancestors ''self''', 'frame-ancestors ''none''')",
     ]), 23.33, 14.17),
    ("corp", "cross-origin-resource-policy", "v IN ('same-origin', 'same-site')", 20.22, 12.28),
    ("coep", "cross-origin-embedder-policy", "v IN ('require-corp', 'credentialless')", 20.22, 12.28),
    ("coop", "cross-origin-opener-policy",
     "v IN ('same-origin', 'same-origin-allow-popups')", 20.22, 12.28),
    ("sc", "set-cookie",
     "contains(v, 'secure') AND contains(v, 'httponly') AND "
     "(contains(v, 'samesite=strict') OR contains(v, 'samesite=lax'))", 15.56, 9.44),
]
SHORT = {"xxp": "XXP", "xfo": "XFO", "xcto": "XCTO", "rp": "RP", "acao": "CORS", "hsts": "HSTS",
         "csp": "CSP", "corp": "CORP", "coep": "COEP", "coop": "COOP", "sc": "SC"}
PLAIN_NAMES = ("XXP", "XCTO", "RP", "SC")
VERSIONS = ["http/3", "http/2", "http/1.1", "http/1.0"]
FLAGS = ["critical_header", "header", "redirect"]


def flag_column(flag: str) -> str:
    return f"{flag}_inconsistency_between_platforms"


def r2(x: str) -> str:
    return f"(round_even(({x}) * 100, 0) / 100)"


def share(part: str, whole: str) -> str:
    return r2(f"CASE WHEN {whole} > 0 THEN {part}::DOUBLE / {whole} * 100 ELSE 0 END")


def cell(x: str) -> str:
    return (
        f"CASE WHEN coalesce({x}, 0) = 0 THEN '-' WHEN {x} = floor({x}) "
        f"THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {x}) END"
    )


def country_name(c: str) -> str:
    return f"CASE {c} WHEN 'de' THEN 'Germany' WHEN 'fr' THEN 'France' WHEN 'it' THEN 'Italy' ELSE {c} END"


OBS = """
inst AS (
  SELECT o.o_orderkey AS k, n.n_name AS nuts, lower(substr(r.r_name, 1, 2)) AS country,
    CASE WHEN c.c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'private' ELSE 'public' END AS category
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
plat AS (SELECT 0 AS p, 'desktop' AS platform UNION ALL SELECT 1, 'mobile' UNION ALL SELECT 2, 'tablet'),
obs AS (
  SELECT inst.*, plat.p, plat.platform, CASE WHEN k % 50 = 0 THEN p ELSE 0 END AS d,
    CASE WHEN k % 61 = 0 THEN p ELSE 0 END AS e, CASE WHEN k % 37 = 0 THEN p ELSE 0 END AS g
  FROM inst CROSS JOIN plat WHERE NOT (k % 101 = 0 AND p = 1) AND (p < 2 OR k % 43 = 0)),
raw AS (
  SELECT CASE WHEN k % 71 <> 0 THEN k END AS k, CASE WHEN k % 83 <> 0 THEN nuts END AS nuts, country,
    CASE WHEN k % 73 <> 0 THEN category END AS category, platform,
    (k + e) % 10 < 7 AS to_https, (k + e) % 10 < 7 AND (k + e) % 4 <> 0 AS same_domain,
    CASE WHEN k % 67 = 0 THEN NULL ELSE CASE (k + g) % 7 WHEN 0 THEN 'h3' WHEN 1 THEN 'h2' WHEN 2 THEN 'H2'
      WHEN 3 THEN 'http/1.1' WHEN 4 THEN 'h2' WHEN 5 THEN 'http/1.0' ELSE 'spdy/3' END END AS protocol_http,
    CASE WHEN (k + e) % 11 = 0 THEN 'http://site' WHEN k % 53 = 0 THEN 'ftp://site'
      WHEN k % 59 = 0 THEN NULL ELSE 'https://site' END AS final_url,
    CASE (k * 3 + d) % 5 WHEN 0 THEN '1; mode=block' WHEN 1 THEN '0' WHEN 2 THEN '1; MODE=block' END AS xxp,
    CASE (k * 5 + d) % 6 WHEN 0 THEN 'DENY' WHEN 1 THEN 'SAMEORIGIN' WHEN 2 THEN 'ALLOWALL'
      WHEN 3 THEN 'sameorigin' END AS xfo,
    CASE (k * 7 + d) % 4 WHEN 0 THEN 'nosniff' WHEN 1 THEN 'nosniff, nosniff' WHEN 2 THEN 'NoSniff' END AS xcto,
    CASE (k * 11) % 7 WHEN 0 THEN 'no-referrer' WHEN 1 THEN 'unsafe-url' WHEN 2 THEN 'same-origin'
      WHEN 3 THEN 'origin' END AS rp,
    CASE (k * 13) % 9 WHEN 0 THEN '*' WHEN 1 THEN 'null' WHEN 2 THEN 'https://a.example' END AS acao,
    CASE (k * 17 + CASE WHEN k % 300 = 0 THEN p ELSE 0 END) % 8
      WHEN 0 THEN 'max-age=31536000; includeSubDomains' WHEN 1 THEN 'max-age=31536000'
      WHEN 2 THEN 'max-age=600; includeSubDomains'
      WHEN 3 THEN 'max-age=63072000, ; includeSubDomains; preload' WHEN 4 THEN 'includeSubDomains'
      WHEN 5 THEN CASE WHEN k % 31 = 0 THEN 'max-age="31536000"' WHEN k % 29 = 0 THEN 'max-age='
        WHEN k % 23 = 0 THEN 'max-age=1__0' WHEN k % 19 = 0 THEN 'max-age=+31_536_000; includeSubDomains'
        WHEN k % 17 = 0 THEN 'max-age=-31536000; includeSubDomains'
        WHEN k % 13 = 0 THEN 'Max-Age=00031536000 ; IncludeSubDomains; x' END END AS hsts,
    CASE (k * 19) % 8 WHEN 0 THEN 'default-src ''self''' WHEN 1 THEN 'frame-ancestors ''none'''
      WHEN 2 THEN 'default-src ''self''; form-action ''self''; object-src ''none''; upgrade-insecure-requests;'
        || ' block-all-mixed-content; frame-ancestors ''self'''
      WHEN 3 THEN 'default-src ''self''; form-action ''self''; object-src ''none''; upgrade-insecure-requests;'
        || ' block-all-mixed-content; frame-ancestors ''self''; ''unsafe-eval''' END AS csp,
    CASE (k * 23) % 10 WHEN 0 THEN 'same-origin' WHEN 1 THEN 'cross-origin' END AS corp,
    CASE (k * 29) % 11 WHEN 0 THEN 'require-corp' WHEN 1 THEN 'unsafe-none' END AS coep,
    CASE (k * 31) % 12 WHEN 0 THEN 'same-origin' WHEN 1 THEN 'unsafe-none' END AS coop,
    CASE WHEN k % 13 = 0 THEN 'a=1; Secure; HttpOnly; SameSite=Lax' WHEN k % 13 = 1 THEN 'a=1; Secure' END AS sc
  FROM obs),
texts AS (
  SELECT *, replace(trim(split_part(split_part(lower(hsts), 'max-age=', 2), ';', 1)), ',', '') AS age_text FROM raw),
aged AS (
  SELECT *, CASE WHEN regexp_full_match(age_text, '[+-]?[0-9]+(_[0-9]+)*')
    THEN CAST(replace(replace(age_text, '_', ''), '+', '') AS HUGEINT) END AS age FROM texts)"""


def _assessed() -> str:
    labels = ", ".join(
        f"CASE WHEN {c} IS NULL THEN 'Missing' WHEN {rule.replace('(v,', f'(lower({c}),').replace('v IN', f'lower({c}) IN').replace('v = ', f'lower({c}) = ')}"
        f" THEN 'Strong' ELSE 'Weak' END AS {c}_config"
        for c, _, rule, _, _ in HEADERS
    )
    present = ", ".join(f"{c} IS NOT NULL AS {c}_presence" for c, *_ in HEADERS)
    return (
        f"{OBS},\nassessed AS (SELECT k, nuts, country, category, platform, to_https, same_domain,"
        f" protocol_http, final_url, {present}, {labels},"
        " CASE WHEN contains(lower(hsts), 'max-age=') AND age IS NULL"
        " THEN 'unreadable value of strict-transport-security' END AS header_error FROM aged)"
    )


ASSESSED = _assessed()
GOOD = f"{ASSESSED},\ngood AS (SELECT * FROM assessed WHERE header_error IS NULL)"


def _scored() -> str:
    points = " + ".join(
        f"CASE {c}_config WHEN 'Strong' THEN {s}::DOUBLE WHEN 'Weak' THEN {w}::DOUBLE ELSE 0::DOUBLE END"
        for c, _, _, s, w in HEADERS
    )

    def varied(columns: list[str]) -> str:
        tests = [f"min({c}_config) OVER w <> max({c}_config) OVER w" for c in columns]
        return " OR ".join(tests)

    def named(value: str) -> str:
        # Rows without an institution number get no institution values.
        return f"CASE WHEN k IS NOT NULL THEN {value} END"

    every = [c for c, *_ in HEADERS]
    return f"""{GOOD},
n AS (SELECT count(DISTINCT platform) AS n FROM good),
s1 AS (SELECT *, {r2(points)} AS header_row,
    CASE WHEN NOT to_https THEN 0::DOUBLE WHEN same_domain THEN 100 ELSE 70 END AS redirect_row,
    CASE WHEN NOT coalesce(starts_with(lower(final_url), 'https://'), FALSE) THEN 1::DOUBLE
      ELSE CASE lower(protocol_http) WHEN 'h2' THEN 84.62 WHEN 'h3' THEN 100 ELSE 76.92 END END AS http_row
  FROM good),
s2 AS (SELECT *, {named(r2("avg(header_row) OVER w"))} AS header_mean,
    {named(r2("avg(redirect_row) OVER w"))} AS redirect_mean, {named(r2("avg(http_row) OVER w"))} AS http_mean,
    {named(varied(["hsts", "csp"]))} AS critical_flag, {named(varied(every))} AS header_flag,
    {named("(min(to_https) OVER w <> max(to_https) OVER w"
           " OR min(same_domain) OVER w <> max(same_domain) OVER w)")} AS redirect_flag,
    {named("(min(secure) OVER w <> max(secure) OVER w)")} AS http_flag
  FROM (SELECT *, coalesce(starts_with(final_url, 'https://'), FALSE) AS secure FROM s1)
  WINDOW w AS (PARTITION BY k)),
s3 AS (SELECT s2.*,
    critical_flag::INT::DOUBLE * 0.85::DOUBLE * (1 - n / 100::DOUBLE)
      + header_flag::INT::DOUBLE * 0.9::DOUBLE * (1 - n / 100::DOUBLE) AS header_penalty,
    redirect_flag::INT::DOUBLE * 0.9::DOUBLE * (1 - n / 100::DOUBLE) AS redirect_penalty,
    http_flag::INT::DOUBLE * 0.1::DOUBLE * (n / 100::DOUBLE) AS http_penalty,
    CASE lower(protocol_http) WHEN 'h3' THEN 1.3::DOUBLE WHEN 'h2' THEN 1.1::DOUBLE ELSE 1 END AS factor
  FROM s2, n),
s4 AS (SELECT *,
    {named(r2("least(100, header_mean * factor * CASE WHEN header_penalty > 0 THEN header_penalty ELSE 1 END)"))}
      AS header_component,
    {named(r2("least(100, redirect_mean * CASE WHEN redirect_penalty > 0 THEN redirect_penalty ELSE 1 END)"))}
      AS redirect_component,
    {named(r2("least(100, http_mean * CASE WHEN http_penalty > 0 THEN http_penalty ELSE 1 END)"))}
      AS http_component
  FROM s3),
scored AS (SELECT *, {r2("header_component * 0.6::DOUBLE + redirect_component * 0.4::DOUBLE")} AS final_score
  FROM s4),
worst AS (SELECT * FROM scored WHERE k IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY final_score, platform) = 1)"""


SCORED = _scored()
GRADE = (
    "CASE WHEN final_score < 0 THEN NULL WHEN final_score < 20 THEN 'F' WHEN final_score < 35 THEN 'E'"
    " WHEN final_score < 50 THEN 'D' WHEN final_score < 65 THEN 'C' WHEN final_score < 80 THEN 'B'"
    " WHEN final_score < 101 THEN 'A' END AS grade"
)
LEVELS = {
    "nuts": "country, nuts",
    "nuts_category": "country, nuts, category",
    "country_category": "country, category",
    "country": "country",
    "country_category_platform": "country, category, platform",
    "country_platform": "country, platform",
}


def _adoption(source: str) -> str:
    counts = ", ".join(
        [f"count(*) FILTER ({c}_presence) AS {c}_present" for c, *_ in HEADERS]
        + [
            f"count(*) FILTER ({c}_config = '{label.title()}') AS {c}_{label}"
            for label in ("strong", "weak")
            for c, *_ in HEADERS
        ]
    )
    levels = []
    for level, keys in LEVELS.items():
        used = keys.split(", ")
        columns = [k if k in used else f"NULL::VARCHAR AS {k}" for k in ("country", "nuts", "category", "platform")]
        levels.append(
            f"SELECT {', '.join(columns)}, '{level}' AS level, count(k) AS total_schools, {counts}"
            f" FROM {source} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in used)} GROUP BY {keys}"
        )
    shares = ", ".join(
        f"{share(f'{c}_{part}', 'total_schools' if part == 'present' else f'{c}_present')} AS {c}_{part}_percent"
        for c, *_ in HEADERS
        for part in ("present", "strong", "weak")
    )
    return f",\nlevels AS ({' UNION ALL '.join(levels)}),\nadoption AS (SELECT *, {shares} FROM levels)"


def _adoption_lines(weak: bool) -> str:
    order = "csp_present_percent DESC, hsts_present_percent DESC, nuts, country"
    if weak:
        order = "csp_weak_percent, hsts_weak_percent, " + order
    kind = "weak" if weak else "present"
    cells = " UNION ALL ".join(
        f"SELECT scope, table_country, country, nuts, row_no, {i} AS col_no, '{h}' AS header,"
        f" '{SHORT[c]}' AS short_name,"
        f" '{SHORT[c] if SHORT[c] in PLAIN_NAMES else chr(92) + 'gls{' + SHORT[c].lower() + '}'}' AS glossary_name,"
        f" {c}_{kind}_percent AS percent FROM numbered"
        for i, (c, h, *_) in enumerate(HEADERS, start=1)
    )
    return f""",
scopes AS (SELECT *, CASE WHEN level = 'nuts' THEN 'region' WHEN level = 'country' THEN 'country'
    WHEN level = 'nuts_category' THEN 'region_' || category END AS scope FROM adoption
  WHERE level IN ('nuts', 'country', 'nuts_category')),
tabled AS (SELECT *, CASE WHEN scope <> 'country' THEN country END AS table_country FROM scopes),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY scope, table_country ORDER BY {order}) AS INT)
  AS row_no FROM tabled),
cells AS ({cells}),
shown AS (SELECT * FROM cells
  QUALIFY sum(percent) OVER (PARTITION BY scope, table_country, header) > 0),
final AS (SELECT scope, country, {country_name("country")} AS country_name, nuts AS region, row_no, col_no,
  header, short_name, glossary_name, percent, {cell("percent")} AS cell FROM shown)"""


def _inconsistency() -> str:
    def counts(level: str) -> str:
        parts = [f"count(k) AS total_schools_{level}"]
        for f in FLAGS:
            name = {"critical_header": "critical_flag", "header": "header_flag", "redirect": "redirect_flag"}[f]
            parts.append(f"count(*) FILTER ({name}) AS {flag_column(f)}_schools_{level}")
        return ", ".join(parts)

    shares = ", ".join(
        r2(f"{flag_column(f)}_schools_{level}::DOUBLE / total_schools_{level} * 100")
        + f" AS {flag_column(f)}_percent_{level}"
        for f in FLAGS
        for level in ("nuts", "country", "nuts_category")
    )
    return f""",
by_nuts AS (SELECT country, nuts, {counts("nuts")} FROM worst WHERE nuts IS NOT NULL GROUP BY ALL),
by_country AS (SELECT country, {counts("country")} FROM worst GROUP BY ALL),
by_category AS (SELECT country, nuts, category AS "Category", {counts("nuts_category")} FROM worst
  WHERE nuts IS NOT NULL AND category IS NOT NULL GROUP BY ALL),
joined AS (SELECT * FROM by_nuts LEFT JOIN by_country USING (country)
  LEFT JOIN by_category USING (country, nuts)),
inconsistency AS (SELECT *, {shares} FROM joined)"""


def _inconsistency_lines() -> str:
    def values(level: str) -> str:
        return ", ".join(f"{flag_column(f)}_percent_{level} AS {flag_column(f)}" for f in FLAGS)

    order = ", ".join(f"{flag_column(f)} DESC" for f in FLAGS)
    return f""",
lines AS (
  SELECT DISTINCT 'region' AS scope, country AS table_country, country, nuts, {values("nuts")} FROM inconsistency
  UNION ALL SELECT 'region_' || "Category", country, country, nuts, {values("nuts_category")}
    FROM inconsistency WHERE "Category" IN ('public', 'private')
  UNION ALL (SELECT DISTINCT 'country', NULL, country, NULL, {values("country")} FROM inconsistency)),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY scope, table_country
  ORDER BY {order}, nuts, country) AS INT) AS row_no FROM lines)"""


LABELS = {"critical_header": "Critical Header", "header": "Header", "redirect": "Redirect"}


def _inconsistency_table() -> str:
    cells = " UNION ALL ".join(
        f"SELECT scope, country, nuts, row_no, {i} AS col_no, '{flag_column(f)}' AS metric,"
        f" '{LABELS[f]}' AS label, {flag_column(f)} AS percent FROM numbered"
        for i, f in enumerate(FLAGS, start=1)
    )
    return f""",
cells AS ({cells}),
final AS (SELECT scope, country, {country_name("country")} AS country_name, nuts AS region, row_no, col_no,
  metric, label, percent, {cell("percent")} AS cell FROM cells)"""


def _versions() -> str:
    def counts(level: str) -> str:
        return ", ".join(
            f"count(*) FILTER (protocol = '{v}') AS \"{v}_{level}\"" for v in VERSIONS
        )

    def shares(level: str) -> str:
        total = " + ".join(f'"{v}_{level}"' for v in VERSIONS)
        parts = [f"{total} AS total_schools_{level}"]
        parts += [f'"{v}_{level}"::DOUBLE / ({total}) * 100 AS "{v}_percent_{level}"' for v in VERSIONS]
        return ", ".join(parts)

    return f""",
named AS (SELECT *, CASE protocol_http WHEN 'h2' THEN 'http/2' WHEN 'h3' THEN 'http/3'
  ELSE protocol_http END AS protocol FROM worst),
vn AS (SELECT country, nuts, {counts("nuts")} FROM named WHERE nuts IS NOT NULL GROUP BY ALL),
vc AS (SELECT country, {counts("country")} FROM named GROUP BY ALL),
vn2 AS (SELECT *, {shares("nuts")} FROM vn),
vc2 AS (SELECT *, {shares("country")} FROM vc),
versions AS (SELECT * FROM vn2 LEFT JOIN vc2 USING (country))"""


def _version_lines(descending: bool) -> str:
    def values(level: str) -> str:
        return ", ".join(f'"{v}_percent_{level}" AS "{v}"' for v in VERSIONS)

    order = ", ".join(f'"{v}" {"DESC" if descending else "ASC"}' for v in VERSIONS)
    return f""",
lines AS (SELECT 'region' AS scope, country AS table_country, country, nuts, {values("nuts")} FROM versions
  UNION ALL (SELECT DISTINCT 'country', NULL, country, NULL, {values("country")} FROM versions)),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY scope, table_country
  ORDER BY {order}, nuts, country) AS INT) AS row_no FROM lines)"""


def _version_table() -> str:
    cells = " UNION ALL ".join(
        f"SELECT scope, table_country, country, nuts, row_no, {i} AS col_no, '{v}' AS version,"
        f" '{v.upper().replace('/', '-')}' AS label, \"{v}\" AS percent FROM numbered"
        for i, v in enumerate(VERSIONS, start=1)
    )
    return f""",
cells AS ({cells}),
shown AS (SELECT * FROM cells QUALIFY scope = 'country'
  OR sum(percent) OVER (PARTITION BY scope, table_country, version) > 0),
final AS (SELECT scope, country, {country_name("country")} AS country_name, nuts AS region, row_no, col_no,
  version, label, percent, {cell("percent")} AS cell FROM shown)"""


def _header_names(prefix: str = "") -> str:
    return ", ".join(
        f'{c}_{part} AS "{h}_{part}"' for c, h, *_ in HEADERS for part in ("presence", "config")
    )


def _adoption_names() -> str:
    parts = [
        f'{c}_{part}{kind} AS "{h}_{part}{kind}"'
        for c, h, *_ in HEADERS
        for part in ("present", "strong", "weak")
        for kind in ("", "_percent")
    ]
    return ", ".join(parts)


HOST = "split_part(split_part(replace(replace(url, 'http://', ''), 'https://', ''), '/', 1), ':', 1)"


def domain(url: str) -> str:
    rest = f"regexp_replace({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*:', '')"
    base = (
        f"CASE WHEN regexp_extract({rest}, '^//([^/?#]*)', 1) <> '' THEN regexp_extract({rest}, '^//([^/?#]*)', 1)"
        f" ELSE regexp_extract({rest}, '^([^?#]*)', 1) END"
    )
    return f"split_part(regexp_replace({base}, '^www\\.', ''), ':', 1)"


LOGS = """
loads AS (SELECT *, CAST(event_id % 2 + 1 AS INT) AS attempt,
    CASE WHEN (event_id // 2) % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS platform FROM events),
logs AS (SELECT *, CASE WHEN attempt = 2 OR user_id % 3 <> 0
      THEN CASE WHEN user_id % 5 = 1 THEN 'https://other.example/u' || user_id
           ELSE 'https://www.u' || user_id || '.example/' END
      ELSE 'http://u' || user_id || '.example/' END AS final_url,
    CASE event_type WHEN 'click' THEN 301 + event_id % 8
      WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 500 END END AS status,
    CASE event_id % 4 WHEN 0 THEN 'h2' WHEN 1 THEN 'h3' ELSE 'Unknown' END AS proto,
    CASE WHEN event_id % 2 = 0 THEN 'DENY' ELSE 'none' END AS frame_options,
    event_id % 40 = 7 AS bad_age FROM loads),
folded AS (SELECT user_id, platform, attempt, final_url,
    CAST(arg_min(status, event_id) FILTER (event_type IN ('click', 'view')) AS INT) AS initial_status,
    CAST(arg_max(status, event_id) FILTER (event_type = 'view') AS INT) AS final_status,
    max(ts) AS logged_at,
    CAST(count(*) FILTER (event_type = 'click') AS INT) AS redirect_count,
    arg_max(frame_options, event_id) FILTER (event_type = 'view') AS frame_options,
    coalesce(arg_max(proto, event_id) FILTER (event_type = 'view'), 'Unknown') AS protocol,
    coalesce(arg_max(bad_age, event_id) FILTER (event_type = 'view'), FALSE) AS bad_age,
    count(*) FILTER (event_type = 'view') > 0 AS has_page
  FROM logs GROUP BY ALL)"""

SCANS = f"""{LOGS},
keys AS (SELECT DISTINCT user_id, platform FROM folded),
pairs AS (SELECT keys.user_id, keys.platform, a.user_id IS NOT NULL AS has_a, b.user_id IS NOT NULL AS has_b,
    a.initial_status AS http_status, a.final_url AS http_url,
    coalesce(starts_with(a.final_url, 'https://'), FALSE) AS to_https, a AS a, b AS b
  FROM keys LEFT JOIN folded a ON a.user_id = keys.user_id AND a.platform = keys.platform AND a.attempt = 1
  LEFT JOIN folded b ON b.user_id = keys.user_id AND b.platform = keys.platform AND b.attempt = 2),
used AS (SELECT *, CASE WHEN to_https THEN a ELSE b END AS u FROM pairs),
scans AS (SELECT user_id, platform, u.logged_at AS assessment_datetime, http_status AS http_status_code, u.final_status AS https_status_code,
    to_https AS redirected_to_https, to_https AND user_id % 5 <> 1 AS redirected_https_to_same_domain,
    u.final_url AS final_url,
    CASE user_id % 4 WHEN 0 THEN 'de;en;q=0.6' WHEN 1 THEN 'fr;en;q=0.6' WHEN 2 THEN 'it;en;q=0.6'
      ELSE 'en' END AS idioma,
    u.protocol AS protocol_http, u.redirect_count AS redirect_count, u.frame_options AS frame_options,
    u.bad_age AS bad_age, u.has_page AS has_page,
    CASE WHEN NOT has_a THEN 'no page load over http'
      WHEN NOT to_https AND NOT has_b THEN 'no page load over https' END AS error
  FROM used)"""


def _build() -> dict[str, str]:
    w, s = f"WITH {SCORED}", f"WITH {SCORED}\n"
    adoption = w + _adoption("worst")
    inconsistency, versions = w + _inconsistency(), w + _versions()
    flags = ", ".join(
        f"{short} AS {flag_column(f)}"
        for f, short in zip(FLAGS, ("critical_flag", "header_flag", "redirect_flag"))
    )
    key = 'k AS "ETER_ID", platform'
    long_cells = "scope, country, region, row_no, col_no, cell"
    q: dict[str, str] = {}
    q["url_sanitize"] = f"""SELECT page_id, host, 'http://' || host AS http_url, 'https://' || host AS https_url
FROM (SELECT page_id, {HOST} AS host FROM pages)"""
    q["url_domain"] = f"SELECT page_id, {domain('url')} AS domain FROM pages"
    q["redirect_flags"] = f"""SELECT page_id, final_url, starts_with(final_url, 'https://') AS redirected_to_https,
  starts_with(final_url, 'https://') AND {domain("host")} = {domain("final_url")} AS redirected_https_to_same_domain
FROM (SELECT page_id, {HOST} AS host, CASE page_id % 3 WHEN 0 THEN replace(url, 'http://', 'https://')
  WHEN 1 THEN 'https://www.' || {HOST} || ':443/' ELSE url END AS final_url FROM pages)"""
    q["result_file_keys"] = """SELECT doc_id, lang || '_' || source || '.csv' AS file_name, lang AS country,
  split_part(source, '_', 1) AS platform FROM documents"""
    q["display_names"] = f"""SELECT k, CASE code WHEN 'de' THEN 'Germany' WHEN 'fr' THEN 'France'
    WHEN 'it' THEN 'Italy' ELSE code END AS country_name,
  CASE code WHEN 'Germany' THEN 'de' ELSE code END AS country_code,
  CASE WHEN code IN ('de', 'fr', 'it') THEN code || ';en;q=0.6' ELSE 'en' END AS idioma,
  share, {cell("share")} AS cell
FROM (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' WHEN 2 THEN 'it'
    WHEN 3 THEN 'es' ELSE 'Germany' END AS code,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 50::DOUBLE
    ELSE o_totalprice / 800 END AS share FROM orders)"""
    q["scan_fold"] = f"""WITH {LOGS} SELECT user_id AS "ETER_ID", platform, attempt, initial_status, final_status,
  redirect_count, frame_options, has_page AS has_server, protocol, final_url FROM folded"""
    q["scan_combine"] = f"""WITH {SCANS} SELECT user_id AS "ETER_ID", platform, assessment_datetime, http_status_code, https_status_code,
  redirected_to_https, redirected_https_to_same_domain, final_url, idioma, protocol_http, redirect_count, error
FROM scans"""
    q["scan_assess"] = f"""WITH {SCANS},
marked AS (SELECT *, error IS NOT NULL OR bad_age AS failed, CASE platform WHEN 'desktop' THEN 1 ELSE 2 END AS o FROM scans),
ranked AS (SELECT *, min(o) FILTER (failed) OVER (PARTITION BY user_id) AS first_failure FROM marked)
SELECT user_id AS "ETER_ID", platform, https_status_code, protocol_http,
  frame_options IS NOT NULL AS "x-frame-options_presence",
  CASE frame_options WHEN 'DENY' THEN 'Strong' WHEN 'none' THEN 'Weak' ELSE 'Missing' END AS "x-frame-options_config",
  CASE WHEN has_page THEN 'Strong' ELSE 'Missing' END AS "strict-transport-security_config",
  FALSE AS "set-cookie_presence"
FROM ranked WHERE NOT failed AND (first_failure IS NULL OR o < first_failure)"""
    q["header_classify"] = f"WITH {ASSESSED} SELECT {key}, {_header_names()}, header_error FROM assessed"
    q["result_error_split"] = f"""WITH {ASSESSED},
ranked AS (SELECT *, min(o) FILTER (header_error IS NOT NULL) OVER (PARTITION BY k) AS first_failure
  FROM (SELECT *, CASE platform WHEN 'desktop' THEN 1 WHEN 'mobile' THEN 2 ELSE 3 END AS o FROM assessed))
SELECT {key}, CASE WHEN header_error IS NULL THEN 'result' ELSE 'error' END AS outcome, header_error AS error
FROM ranked WHERE k IS NULL OR first_failure IS NULL OR o <= first_failure"""
    q["platform_count"] = f"WITH {GOOD} SELECT count(DISTINCT platform) AS n_platforms FROM good"
    q["header_score"] = f"""{s}SELECT {key}, header_row AS header_score_by_platform,
  header_mean AS header_avg_score_btw_platforms, header_component AS header_component_score FROM scored"""
    q["inconsistency_flags"] = f"{s}SELECT {key}, {flags} FROM scored"
    q["redirect_score"] = f"""{s}SELECT {key}, redirect_row AS redirect_score_by_platform,
  redirect_mean AS redirect_avg_score_btw_platforms, redirect_flag AS redirect_inconsistency_between_platforms,
  redirect_component AS redirect_component_score FROM scored"""
    q["http_score"] = f"""{s}SELECT {key}, http_row AS http_score_by_platform,
  http_mean AS http_avg_score_btw_platforms, http_flag AS http_inconsistency_between_platforms,
  http_component AS http_component_score,
  coalesce(NOT starts_with(final_url, 'https://') AND NOT starts_with(final_url, 'http://'), TRUE) AS unknown_scheme,
  coalesce(protocol_http = 'spdy/3', TRUE) AS unknown_protocol FROM scored"""
    q["final_score_grade"] = f"""{s}SELECT {key}, header_component AS header_component_score,
  redirect_component AS redirect_component_score, final_score, {GRADE} FROM scored"""
    place = 'country, nuts AS "NUTS2_Label_2016", category AS "Category"'
    q["worst_observation"] = f"{s}SELECT {key}, {place}, protocol_http, final_score, {GRADE} FROM worst"
    q["worst_scores"] = f"""{s}SELECT {key}, {place}, protocol_http, header_component AS header_component_score,
  redirect_component AS redirect_component_score, final_score, {GRADE},
  header_flag AS header_inconsistency_between_platforms FROM worst"""
    q["country_overview"] = f"""WITH {GOOD} SELECT country, count(*) AS observations, count(DISTINCT k) AS institutions,
  count(DISTINCT nuts) AS regions, count(DISTINCT platform) AS platforms FROM good GROUP BY country"""
    q["adoption_stats"] = f"""{adoption}
SELECT country, nuts, category AS "Category", platform, level, total_schools, {_adoption_names()} FROM adoption"""
    q["adoption_table"] = f"{adoption}{_adoption_lines(False)} SELECT * FROM final"
    q["weak_table"] = f"{adoption}{_adoption_lines(True)} SELECT * FROM final"
    wide = ", ".join(
        f"max(cell) FILTER (short_name = '{name}') AS \"{name}\"" for name in SHORT.values()
    )
    q["adoption_table_wide"] = f"""{adoption}{_adoption_lines(False)}
SELECT scope, country, country_name, region, row_no, {wide} FROM final GROUP BY ALL"""
    q["inconsistency_stats"] = f"{inconsistency} SELECT * FROM inconsistency"
    table = inconsistency + _inconsistency_lines() + _inconsistency_table()
    q["inconsistency_table"] = f"{table} SELECT * FROM final"
    q["table_preview"] = f"""{table},
ends AS (SELECT *, max(row_no) OVER (PARTITION BY scope, CASE WHEN scope <> 'country' THEN country END) AS n FROM final)
SELECT 'head' AS part, {long_cells} FROM ends WHERE row_no <= 2
UNION ALL SELECT 'tail', {long_cells} FROM ends WHERE row_no > n - 2"""
    q["http_version_stats"] = f"{versions} SELECT * FROM versions"
    q["http_version_table"] = f"{versions}{_version_lines(True)}{_version_table()} SELECT * FROM final"
    q["region_score"] = f"""{s}, means AS (SELECT country, nuts AS region,
    sum(CAST(round_even(final_score * 100, 0) AS BIGINT))::DOUBLE / 100 / count(*) AS final_score
  FROM worst WHERE nuts IS NOT NULL GROUP BY ALL)
SELECT country, {country_name("country")} AS country_name, region,
  CAST(row_number() OVER (PARTITION BY country ORDER BY final_score DESC, region) AS INT) AS row_no,
  final_score, printf('%.2f', final_score) AS cell FROM means"""
    points = " UNION ALL ".join(
        f"SELECT scope, table_country, country, nuts, row_no, {i} AS header_no, '{h}' AS header,"
        f" '{SHORT[c]}' AS short_name, {c}_present_percent AS adoption, {c}_weak_percent AS weak FROM numbered"
        for i, (c, h, *_) in enumerate(HEADERS, start=1)
    )
    entity = f"CASE WHEN scope = 'country' THEN {country_name('country')} ELSE nuts END AS entity"

    def whole(x: str) -> str:
        return f"CASE WHEN {x} = 0 THEN '-' ELSE CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) END AS {x}_text"

    q["heatmap_data"] = f"""{adoption},
lines AS (SELECT *, CASE level WHEN 'nuts' THEN 'region' ELSE 'country' END AS scope,
    CASE level WHEN 'nuts' THEN country END AS table_country FROM adoption WHERE level IN ('nuts', 'country')),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY scope, table_country ORDER BY nuts, country) AS INT)
  AS row_no FROM lines),
points AS ({points}),
used AS (SELECT * FROM points QUALIFY sum(adoption) OVER (PARTITION BY scope, table_country, header) > 0)
SELECT scope, country, {entity}, row_no,
  CAST(dense_rank() OVER (PARTITION BY scope, table_country ORDER BY header_no) AS INT) AS col_no,
  header, short_name, adoption, weak, {whole("adoption")}, {whole("weak")} FROM used"""

    def values(level: str) -> str:
        return ", ".join(f"{flag_column(f)}_percent_{level} AS {flag_column(f)}" for f in FLAGS)

    total = " + ".join(f"CAST(round_even({flag_column(f)} * 100, 0) AS BIGINT)" for f in FLAGS)
    dots = " UNION ALL ".join(
        f"SELECT scope, country, entity, entity_no, entity_total, '{flag_column(f)}' AS type,"
        f" {flag_column(f)} AS percent, '{LABELS[f]} Inconsistency' AS label FROM ranked"
        for f in FLAGS
    )
    q["dot_chart_data"] = f"""{inconsistency},
lines AS (SELECT 'region' AS scope, country AS table_country, country, nuts, {values("nuts")} FROM inconsistency
  UNION ALL (SELECT DISTINCT 'country', NULL, country, NULL, {values("country")} FROM inconsistency)),
summed AS (SELECT scope, table_country, country, nuts, sum({total}) AS total,
  {", ".join(f"max({flag_column(f)}) AS {flag_column(f)}" for f in FLAGS)} FROM lines GROUP BY ALL),
ranked AS (SELECT *, {entity}, total::DOUBLE / 100 AS entity_total,
  CAST(row_number() OVER (PARTITION BY scope, table_country ORDER BY total DESC, nuts, country) AS INT) AS entity_no
  FROM summed)
{dots}"""
    bars = " UNION ALL ".join(
        f"SELECT scope, country, {entity}, row_no, {i} AS part_no, '{v}' AS version, \"{v}\" AS percent FROM numbered"
        for i, v in enumerate(VERSIONS, start=1)
    )
    q["bar_chart_data"] = f"{versions}{_version_lines(False)} {bars}"
    role = {"hsts": "critical", "csp": "critical", "xxp": "deprecated", "xfo": "deprecated"}
    ring = [(i, c, h) for i, (c, h, *_) in enumerate(HEADERS)]
    ring.append((len(HEADERS), HEADERS[0][0], HEADERS[0][1]))
    spokes = " UNION ALL ".join(
        f"SELECT country, {country_name('country')} AS country_name, category AS \"Category\", platform,"
        f" {i} AS position, '{h}' AS header, '{role.get(c, 'other')}' AS role,"
        f" {i if i < len(HEADERS) else 0} * (2 * pi() / {len(HEADERS)}) AS angle,"
        f" {c}_present_percent AS adoption FROM rings"
        for i, c, h in ring
    )
    q["radar_data"] = f"""WITH {GOOD}{_adoption("good")},
rings AS (SELECT * FROM adoption WHERE level IN ('country_category_platform', 'country_platform')
    AND platform IN ('desktop', 'mobile')
  QUALIFY count(*) OVER (PARTITION BY level, country, category) = 2)
{spokes}"""
    # Rows with a platform that no policy names are not known to be shifted, so they stay as they are.
    moved = {
        "assessment_datetime": ("platform", "'2025-01-05 10:00:00'"),
        "http_status_code": ("'2025-01-05 10:00:00'", "'301'"),
        "https_status_code": ("'301'", "'200'"),
        "redirected_to_https": ("'200'", "CAST(to_https AS VARCHAR)"),
        "redirected_https_to_same_domain": ("CAST(to_https AS VARCHAR)", "CAST(same_domain AS VARCHAR)"),
        "final_url": ("CAST(same_domain AS VARCHAR)", "final_url"),
        "idioma": ("final_url", "country"),
        "platform": ("country", "platform"),
    }
    columns = ", ".join(
        f"CASE WHEN k % 7 = 0 AND platform = 'tablet' THEN {shifted} ELSE {right} END AS {name}"
        for name, (shifted, right) in moved.items()
    )
    q["row_repair"] = f"""WITH {OBS} SELECT CAST(k AS VARCHAR) AS "ETER_ID", {columns}, protocol_http,
  '1' AS redirect_count FROM raw"""
    q["retry_worklist"] = f"""WITH {OBS},
outcome AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'R') AS failures,
    count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS done FROM lineitem GROUP BY ALL)
SELECT k AS "ETER_ID", country, category AS "Category" FROM inst
WHERE k IN (SELECT k FROM outcome WHERE failures BETWEEN 1 AND 9 AND done = 0)"""
    return q


ORACLES = _build()

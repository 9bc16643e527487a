"""URL filters by rules and by empirical-Bayes host reputation, in SQL functions only.

Pages that a rule decides are labelled outcomes (block = 1, allow = 0). Outcomes are counted per
host in one pass, into a written table, and beta-binomial priors shrink each host's block rate towards
its registered domain, that towards its suffix, and that towards the whole. A suffix is the last label
of a host, or the last two where they are of SUFFIXES; a registered domain has one label more. The strength of each level's prior is estimated
from the spread of its children's rates (method of moments). A page that no rule fits is blocked
when the lower posterior bound of its host's block rate exceeds the threshold.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged as host
''. Repeated rows each get a row and each count as an outcome. An empty table gives no rows. The
input may have any further columns, whatever their names; they are not returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweft.operators.skew import spread_join
from skyweft.session import discard, materialize

#: (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Suffixes of two labels under which domains are registered (fixed values; a selection of the common ones).
SUFFIXES = tuple(
    "co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au edu.au gov.au co.nz org.nz co.jp or.jp ne.jp ac.jp go.jp com.br org.br gov.br com.cn net.cn org.cn"
    " co.in org.in net.in co.kr or.kr co.za org.za com.mx com.ar com.tr com.tw com.sg com.hk com.my co.id co.il com.ua com.pl".split()
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(s: str) -> str:
    if any(c in s for c in "'\\{}"):
        raise ValueError(f"a rule may not hold quotes, backslashes or braces: {s!r}")
    return f"'{s}'"


def _rule_case(rules: Sequence[tuple[str, str, str]], what: str) -> str:
    """CASE over the rules, longest host and path first; ties keep the given order."""
    arms = []
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        h, p = _quoted(host), _quoted(path)
        fits = f"(host = {h} OR right(host, {len(host) + 1}) = {_quoted('.' + host)}) AND left(path, {len(path)}) = {p}"
        arms.append(f"WHEN {fits} THEN {_quoted(host + path if what == 'rule' else verdict)}")
    return f"CASE {' '.join(arms)} ELSE NULL END" if arms else "CAST(NULL AS STRING)"


def _strength(children: str, floor: float, ceiling: float) -> str:
    """Prior strength 1/rho - 1 of a level from its children's (n, k); moments of the beta-binomial."""
    return f"""(SELECT CASE WHEN count(*) < 2 OR sum(n) = 0 OR sum(k) = 0 OR sum(k) = sum(n) THEN 2.0 ELSE
        1.0 / least({ceiling}, greatest({floor},
            (sum(n * (k / n - p) * (k / n - p)) - (count(*) - 1) * max(p) * (1 - max(p)))
            / greatest(1e-9, (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)) * max(p) * (1 - max(p))))) - 1.0 END
        FROM (SELECT cast(n AS DOUBLE) AS n, cast(k AS DOUBLE) AS k, (SELECT sum(k) / sum(n) FROM {children} WHERE n > 0) AS p
              FROM {children} WHERE n > 0) c)"""


def _counts(table: str, rules, id_col: str, url_col: str) -> tuple[str, str]:
    """The pages with host, path and rule, and the outcomes of each host, as SQL over ``table`` and over ``ruled``."""
    ruled = f"""
  SELECT page_id, host, path, {_rule_case(rules, "rule")} AS rule, {_rule_case(rules, "verdict")} AS by_rule FROM (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (
      SELECT {id_col} AS page_id,
             CASE WHEN instr({url_col}, '://') > 0 THEN substr({url_col}, instr({url_col}, '://') + 3) ELSE '' END AS rest
      FROM {table}) cut) parts"""
    hosts = "SELECT host, count(*) AS pages, sum(CASE WHEN by_rule IS NULL THEN 0 ELSE 1 END) AS n, sum(CASE WHEN by_rule = 'block' THEN 1 ELSE 0 END) AS k FROM ruled GROUP BY host"
    return ruled, hosts


def _judged(hosts: str, z: float, threshold: float) -> str:
    """Verdict of every host from its outcomes, as SQL over the table ``hosts``."""
    two, three = "regexp_extract(host, '([^.]+[.][^.]+)$', 1)", "regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1)"
    known = f"{two} IN ({', '.join(map(_quoted, SUFFIXES))})"
    return f"""
WITH placed AS (
  SELECT host, pages, n, k,
         CASE WHEN {known} AND {three} <> '' THEN {three} WHEN {two} = '' THEN host ELSE {two} END AS domain,
         CASE WHEN {known} THEN {two} ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix
  FROM {hosts}
), domains AS (
  SELECT domain, max(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM placed GROUP BY domain
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix
), suffix_rate AS (
  SELECT suffix, (s.m * s.p0 + s.k) / (s.m + s.n) AS rate FROM (
    SELECT suffix, cast(n AS DOUBLE) AS n, cast(k AS DOUBLE) AS k, {_strength("suffixes", 0.001, 0.999)} AS m,
           (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) FROM suffixes) AS p0
    FROM suffixes) s
), domain_rate AS (
  SELECT d.domain, (d.m * r.rate + d.k) / (d.m + d.n) AS rate FROM (
    SELECT domain, suffix, cast(n AS DOUBLE) AS n, cast(k AS DOUBLE) AS k, {_strength("domains", 0.001, 0.999)} AS m FROM domains) d
  JOIN suffix_rate r ON d.suffix = r.suffix
), posterior AS (
  SELECT h.host, h.pages, h.m * r.rate + h.k AS a, h.m * (1 - r.rate) + h.n - h.k AS b FROM (
    SELECT host, pages, domain, cast(n AS DOUBLE) AS n, cast(k AS DOUBLE) AS k, {_strength("placed", 0.001, 0.999)} AS m FROM placed) h
  JOIN domain_rate r ON h.domain = r.domain
)
SELECT host, pages, CASE WHEN a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {threshold}
                         THEN 'block' ELSE 'allow' END AS by_host
FROM posterior
"""


def verdict_sql(table: str, rules=RULES, id_col: str = "page_id", url_col: str = "url", z: float = 1.645, threshold: float = 0.5) -> str:
    """The whole operator as one SQL text over ``table``."""
    ruled, hosts = _counts(table, rules, id_col, url_col)
    return f"""WITH ruled AS ({ruled}), hosts AS ({hosts})
SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.by_rule, j.by_host) AS verdict
FROM ruled u JOIN ({_judged("hosts", z, threshold)}) j ON u.host = j.host
"""


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``; see the module text.

    Pages are read once for the counts and then for the answer; what is known of hosts fits in between.
    Pages of very common hosts meet the verdict where they stand.
    """
    spark = pages.sparkSession
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    ruled_sql, hosts_sql = _counts("{narrow}", rules, "page_id", "url")
    ruled = spark.sql(ruled_sql, narrow=narrow)
    hosts = materialize(spark.sql(hosts_sql.replace("FROM ruled", "FROM {ruled}"), ruled=ruled), "host-outcomes")
    judged = materialize(spark.sql(_judged("{hosts}", z, threshold), hosts=hosts), "host-verdicts")
    discard(hosts)
    out = spread_join(ruled, judged, "host", "pages", "inner")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host").alias("verdict"))

"""Operator 2, URL filter by empirical-Bayes host reputation.

Labelled pages (bad or not) are counted for each host. A beta-binomial prior is fitted on three levels, its weight by the method
of moments: suffixes around all pages, registered domains around their suffix, hosts around their domain; above all stands a
Beta(1, 1). What a child is shrunk to comes from its parent's other pages, so no label counts twice. The share of bad pages of a
host then has a beta posterior, and the host is blocked if the posterior's lower bound at level ``risk`` is over the share of all
pages times ``lift``: it takes evidence to block, and with few labels nothing is. Rules come first.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import letters_folded, scratch


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))
#: Suffixes of two labels; others have one. A whole public list can be given instead.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.mx", "gov.uk", "org.uk")
#: A host is blocked if its share of bad pages is over LIFT times that of all pages but for a chance of RISK.
RISK, LIFT = 0.1, 1.0
#: Pages that a parent speaks for in a child's prior, at least and at most.
LEAST, MOST = 2.0, 8.0
#: So many rules are part of the plan; more are joined as a table, with the same verdicts.
PLAN_RULES = 1000


def host(url: Column) -> Column:
    return F.coalesce(letters_folded(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _rule(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its verdict; null without."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def with_rules(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` (host, path, ...) with the columns rule and ruled: the longest rule that fits, and its verdict."""
    if len(rules) <= PLAN_RULES:
        name, verdict = _rule(rules)
        return rows.select("*", name.alias("rule"), verdict.alias("ruled"))
    table = rows.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, r_host string, r_path string")
    part = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, i, F.size(part)), "."))
    places = rows.select("host", "path").distinct()
    met = places.select("host", "path", F.explode(above).alias("r_host")).join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = met.groupBy("host", "path").agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), "verdict", "r_host", "r_path")).alias("r"))
    best = scratch(best.select("host", "path", F.concat("r.r_host", "r.r_path").alias("rule"), F.col("r.verdict").alias("ruled")), "hosts-rules")
    return rows.join(best, ["host", "path"], "left")


def _levels(hosts: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    last = F.regexp_extract("host", r"([^.]*)$", 1)
    two = F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)
    suffix = F.when(two.isin(*suffixes), two).otherwise(last)
    before = F.regexp_extract(F.col("host").substr(F.lit(1), F.greatest(F.lit(0), F.length("host") - F.length(suffix) - 1)), r"([^.]*)$", 1)
    return hosts.withColumn("suffix", suffix).withColumn("domain", F.concat(before, F.lit("."), suffix))


def _strength(rows: DataFrame) -> float:
    """The prior's weight in pages, from (n, x, mean): 1 / rho - 1, where n * (x / n - mean)^2 sums to m(1 - m)(1 + (n - 1) rho)."""
    spread = F.col("mean") * (1 - F.col("mean"))
    got = rows.where("n > 0").agg(
        F.sum((F.col("x") - F.col("n") * F.col("mean")) * (F.col("x") - F.col("n") * F.col("mean")) / F.col("n")).alias("s"),
        F.sum(spread).alias("a"), F.sum(spread * (F.col("n") - 1)).alias("b"),
    ).first()
    rho = (got.s - got.a) / got.b if got.b else 0.0
    return 1 / min(max(rho, 1 / (MOST + 1)), 1 / (LEAST + 1)) - 1


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """For positive z: Stirling's series, from 10 on."""
    shift = np.zeros_like(z)
    z = z.copy()
    while (z < 10).any():
        low = z < 10
        shift[low] += np.log(z[low])
        z[low] += 1
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - shift


def beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The chance that a Beta(a, b) variable is below x: the regularised incomplete beta function, by its continued fraction."""
    x, a, b = (np.array(v, np.float64) for v in np.broadcast_arrays(x, a, b))
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    inside = (x > 0) & (x < 1)
    safe = np.where(inside, x, 0.5)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(safe) + b * np.log1p(-safe)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.where(np.abs(v := 1 - (a + b) * safe / (a + 1)) < tiny, tiny, v)
    h, m, step = d.copy(), 1, np.zeros_like(x)
    while m < 100_000 and (np.abs(step - 1) > 1e-15).any():
        for t in (m * (b - m) * safe / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * safe / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        m += 1
    got = np.where(inside, front * h, np.where(x <= 0, 0.0, 1.0))
    return np.where(flip, 1 - got, got)


@F.pandas_udf(DoubleType())
def _below(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_below(x.to_numpy(), a.to_numpy(), b.to_numpy()))


def reputation(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES, lift: float = LIFT) -> DataFrame:
    """(host, n, x, bad_share, risk) of (host, n, x): n labelled pages, x of them bad, the posterior's mean, and the chance that
    the host's share is at most ``lift`` times that of all pages."""
    rows = scratch(_levels(hosts, suffixes), "hosts")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x")).first()
    base = (total.x + 1) / (total.n + 2)
    sums = lambda *by: rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))

    def below(own: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
        """``own`` with the mean of its prior: that of its parent without its own pages."""
        weight = _strength(parent)
        up = parent.select(key, F.col("n").alias("pn"), F.col("x").alias("px"), F.col("mean").alias("pm"))
        mean = (F.col("px") - F.col("x") + weight * F.col("pm")) / (F.col("pn") - F.col("n") + weight)
        return scratch(own.join(up, key).withColumn("mean", mean).drop("pn", "px", "pm"), name)

    suffix = scratch(sums("suffix").withColumn("mean", (total.x - F.col("x") + 1) / (total.n - F.col("n") + 2)), "hosts-suffix")
    domain = below(sums("suffix", "domain"), suffix, "suffix", "hosts-domain")
    own = below(rows, domain.drop("suffix"), "domain", "hosts-host")
    weight = _strength(own)
    a, b = F.col("x") + weight * F.col("mean"), F.col("n") - F.col("x") + weight * (1 - F.col("mean"))
    return own.select("host", "n", "x", (a / (a + b)).alias("bad_share"), _below(F.lit(min(1.0, lift * base)), a, b).alias("risk"))


def judge(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[Rule] = RULES, risk: float = RISK, lift: float = LIFT, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_share, risk): every page's verdict, by the longest rule that fits, else by its host.

    bad_share is the mean of the posterior of the host's share of bad pages, risk the chance that this share is no more than
    ``lift`` times that of all pages; under the risk that is asked for, the host is blocked.

    ``labels`` is (id, bad): rows with a null in either are no evidence; a page labelled twice counts twice. A null url, or
    one without ``://``, has an empty host, which is a host like others. Repeated pages get a row each. Empty tables are fine:
    without labels every page without a rule is allowed, and one or two labels block nothing. Other columns are ignored.
    """
    rows = scratch(pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path")), "hosts-pages")
    known = labels.select("id", F.col("bad").cast("boolean").alias("bad")).where("id is not null and bad is not null")
    seen = rows.select(F.col("page_id").alias("id"), "host").join(known, "id").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("x"))
    every = rows.select("host").distinct().join(scratch(seen, "hosts-seen"), "host", "left").fillna(0, ["n", "x"])
    worth = reputation(every, suffixes, lift)
    worth = scratch(worth.select("host", "bad_share", "risk", F.when(F.col("risk") < risk, "block").otherwise("allow").alias("own")), "hosts-verdict")
    return with_rules(rows, rules).join(worth, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "own").alias("verdict"), "bad_share", "risk")


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    got = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels)
    return got.withColumn("bad_share", F.round("bad_share", 6)).withColumn("risk", F.round("risk", 6))


_TWO = ", ".join(f"'{s}'" for s in SUFFIXES)


def _weighed(table: str) -> str:
    return f"""
{table}_w AS (SELECT 1 / least(greatest(coalesce((sum((x - n * mean) * (x - n * mean) / n) - sum(mean * (1 - mean))) / nullif(sum(mean * (1 - mean) * (n - 1)), 0), 0), 1 / {MOST + 1}), 1 / {LEAST + 1}) - 1 AS w FROM {table} WHERE n > 0)"""


_FITS = "\n".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{{{i}}}'" for i, r in sorted(enumerate(RULES), key=lambda v: -len(v[1].host + v[1].path)))
#: The chance below ``base`` is summed as the series x^a (1 - x)^b / (a B(a, b)) * sum of (a + b)_k / (a + 1)_k x^k.
OP2_SQL = f"""
WITH p AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
l AS (SELECT doc_id, (quality = 0 OR toxic = 1) AS bad FROM labels),
s AS (SELECT host, count(bad) AS n, coalesce(sum(CASE WHEN bad THEN 1 ELSE 0 END), 0) AS x FROM p LEFT JOIN l ON page_id = doc_id AND bad IS NOT NULL GROUP BY host),
t AS (SELECT *, CASE WHEN regexp_extract(host, '([^.]*\\.[^.]*)$', 1) IN ({_TWO}) THEN regexp_extract(host, '([^.]*\\.[^.]*)$', 1) ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix FROM s),
h AS (SELECT *, regexp_extract(substr(host, 1, greatest(0, length(host) - length(suffix) - 1)), '([^.]*)$', 1) || '.' || suffix AS domain FROM t),
total AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(x), 0) AS x FROM h),
suffix_t AS (SELECT s.suffix, s.n, s.x, (t.x - s.x + 1) / (t.n - s.n + 2) AS mean FROM (SELECT suffix, sum(n) AS n, sum(x) AS x FROM h GROUP BY suffix) s, total t),{_weighed("suffix_t")},
domain_t AS (SELECT d.domain, d.n, d.x, (u.x - d.x + w * u.mean) / (u.n - d.n + w) AS mean FROM (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM h GROUP BY suffix, domain) d JOIN suffix_t u USING (suffix), suffix_t_w),{_weighed("domain_t")},
host_t AS (SELECT h.host, h.n, h.x, (u.x - h.x + w * u.mean) / (u.n - h.n + w) AS mean FROM h JOIN domain_t u USING (domain), domain_t_w),{_weighed("host_t")},
ab AS (SELECT host, x + w * mean AS a, n - x + w * (1 - mean) AS b, {LIFT} * (tx + 1) / (tn + 2) AS base FROM (SELECT host, n, x, mean FROM host_t) q, host_t_w, (SELECT n AS tn, x AS tx FROM total) t),
r AS (SELECT host, any_value(a / (a + b)) AS bad_share, sum(exp(a * ln(base) + b * ln(1 - base) + lgamma(a + b + k) - lgamma(a + 1 + k) - lgamma(b) + k * ln(base))) AS risk
  FROM ab, (SELECT unnest(generate_series(0, 3000)) AS k) GROUP BY host)
SELECT page_id, host, path,
  CASE {_FITS.format(*(r.host + r.path for r in RULES))} END AS rule,
  CASE {_FITS.format(*(r.verdict for r in RULES))}
    WHEN risk < {RISK} THEN 'block' ELSE 'allow' END AS verdict, round(bad_share, 6) AS bad_share, round(risk, 6) AS risk
FROM p JOIN r USING (host)
"""

"""URL filters: rules first, then empirical-Bayes host reputation, all in DataFrame functions.

Labelled page outcomes are counted by host and shrunk through beta-binomial priors: a host towards its registered
domain, that towards its suffix, that towards all. Each prior's strength comes from how much the members' rates differ
beyond chance (moments of the beta-binomial). A host is blocked if the lower bound of its posterior is too low.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, join_salted, staged


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
# Suffixes of two labels under which names are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.cn", "com.tr", "com.mx", "co.in", "co.nz", "co.za")
#: Strength of a prior whose members say nothing about it, and its limits.
STRENGTH, LEAST, MOST = 10.0, 1.0, 1000.0
#: Normal quantile of the posterior's lower bound, and the least rate of good pages that is allowed.
Z, THRESHOLD = 1.645, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain (suffix and one more label) of a host; an address is its own."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    last_two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    suffix = F.when(last_two.isin(*SUFFIXES), last_two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    domain = F.when(last_two.isin(*SUFFIXES), F.regexp_extract(name, r"([^.]+\.[^.]+\.[^.]+)$", 1)).otherwise(last_two)
    address = name.rlike(r"^[0-9.]+$|^\[")
    return F.when(address, name).otherwise(suffix), F.when(address | (domain == ""), name).otherwise(domain)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as host and path) and its verdict, null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _moments(members: DataFrame, by: list[str]) -> DataFrame:
    """Per group: its outcomes n and good k, members, and the strength of the prior that its members share."""
    some = F.col("n") > 0
    sums = members.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("members"), F.sum(F.when(some, 1).otherwise(0)).alias("m"),
        F.sum(F.when(some, F.col("k") * F.col("k") / F.col("n")).otherwise(0.0)).alias("q"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("s"),
    )
    p = F.col("k") / F.col("n")
    pq = p * (1 - p)
    free = pq * (F.col("n") - F.col("s") / F.col("n") - (F.col("m") - 1))
    rho = (F.col("q") - F.col("n") * p * p - pq * (F.col("m") - 1)) / free
    strength = F.when((F.col("m") < 2) | (F.col("n") == 0), F.lit(STRENGTH)).when(free <= 0, F.lit(STRENGTH)).when(rho <= 1 / (MOST + 1), F.lit(MOST)).otherwise(F.least(F.greatest(1 / rho - 1, F.lit(LEAST)), F.lit(MOST)))
    return sums.select(*by, "n", "k", "members", strength.alias("strength"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, pages, n, k, rate, bound) from (host, pages, n, k): pages, labelled pages and good ones, one row a host.

    rate is the posterior mean and bound its lower bound (mean less Z standard deviations). Without any outcome all
    rates are one half.
    """
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = staged(outcomes.withColumn("suffix", suffix).withColumn("domain", domain), "hosts")
    domains = staged(_moments(hosts, ["suffix", "domain"]), "domains")
    suffixes = staged(_moments(domains, ["suffix"]), "suffixes")
    root = _moments(suffixes, []).select(F.coalesce((F.col("k") + 1.0) / (F.col("n") + 2.0), F.lit(0.5)).alias("mean0"), F.coalesce("strength", F.lit(STRENGTH)).alias("strength0"))  # one row
    prior = root.first()  # two numbers
    mean0, strength0 = F.lit(prior["mean0"]), F.lit(prior["strength0"])
    s = suffixes.select("suffix", ((F.col("k") + strength0 * mean0) / (F.col("n") + strength0)).alias("mean_s"), F.col("strength").alias("strength_s"), F.col("members").alias("w"))
    d = join_salted(domains, s, "suffix", "w", domains.count(), "domain")
    d = d.select("domain", ((F.col("k") + F.col("strength_s") * F.col("mean_s")) / (F.col("n") + F.col("strength_s"))).alias("mean_d"), F.col("strength").alias("strength_d"), F.col("members").alias("w"))
    h = join_salted(hosts, d, "domain", "w", hosts.count(), "host")
    a = F.col("k") + F.col("strength_d") * F.col("mean_d")
    total = F.col("n") + F.col("strength_d")
    rate = a / total
    return h.select("host", "pages", "n", "k", rate.alias("rate"), (rate - Z * F.sqrt(rate * (1 - rate) / (total + 1))).alias("bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) a row of pages (page_id, url).

    A page's outcome is its document's label (labels: doc_id, quality, toxic), where the document's number is the last
    one in the path; it is good if the quality is 1 and it isn't toxic. Null labels are no outcomes; of several labels
    of a document the worst counts. Rules decide first. Null and malformed urls belong to the empty host.
    """
    host, path = host_and_path(F.col("url"))
    sites = pages.select("page_id", host.alias("host"), path.alias("path"))
    number = F.regexp_extract("path", r"([0-9]+)[^0-9]*$", 1)  # the whole run; longer ones are no document's
    keyed = staged(sites.withColumn("doc", F.when(F.length(number).between(1, 18), number.cast("long"))).groupBy("host", "doc").agg(F.count("*").alias("pages")), "pages")
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("doc")).agg(F.min(good).alias("good"))
    n = F.when(F.col("good").isNotNull(), F.col("pages")).otherwise(0)
    # One number may be on many hosts, and pages without one share the null: neither is one task's.
    held = known.join(keyed.where(F.col("doc").isNotNull()).groupBy("doc").agg(F.count("*").alias("w")), "doc")
    paired = join_salted(keyed, held, "doc", "w", keyed.count(), "host")
    outcomes = paired.groupBy("host").agg(F.sum("pages").alias("pages"), F.sum(n).alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("k"))
    hosts = staged(host_reputation(outcomes).select("host", "bound", "pages"), "reputation")
    found = join_salted(sites, hosts, "host", "pages", pages.count(), "page_id")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") >= threshold, "allow").otherwise("block")).alias("verdict"), F.round("bound", 9).alias("bound"))


def _sql_moments(table: str, by: str) -> str:
    return f"""select {by + ',' if by else ''} n, k, members, case when m < 2 or n = 0 then 10.0 when p * (1 - p) * (n - s / n - (m - 1)) <= 0 then 10.0
        when (q - n * p * p - p * (1 - p) * (m - 1)) / (p * (1 - p) * (n - s / n - (m - 1))) <= 1 / 1001.0 then 1000.0
        else least(greatest(1 / ((q - n * p * p - p * (1 - p) * (m - 1)) / (p * (1 - p) * (n - s / n - (m - 1)))) - 1, 1.0), 1000.0) end as strength
    from (select *, case when n > 0 then cast(k as double) / n end as p from (select {by + ',' if by else ''} sum(n) as n, sum(k) as k, count(*) as members, count(case when n > 0 then 1 end) as m,
        sum(case when n > 0 then cast(k as double) * k / n else 0.0 end) as q, sum(cast(n as double) * n) as s from {table} {'group by ' + by if by else ''}))"""


_TWO = ", ".join(f"'{x}'" for x in SUFFIXES)
ORACLE = rf"""
with cut as (select page_id, case when coalesce(instr(url, '://'), 0) > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
sites as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{ASCII_UPPER}', '{ASCII_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
keyed as (select *, case when len(regexp_extract(path, '([0-9]+)[^0-9]*$', 1)) between 1 and 18 then cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint) end as doc from sites),
known as (select doc_id as doc, min(case when quality = 1 and coalesce(toxic, 0) = 0 then 1 else 0 end) as good from labels where doc_id is not null and quality is not null group by doc_id),
named as (select host, regexp_replace(host, ':[0-9]*$', '') as name, count(*) as pages, count(good) as n, coalesce(sum(good), 0) as k from keyed left join known using (doc) group by host),
two as (select *, regexp_extract(name, '([^.]+\.[^.]+)$', 1) as last_two, regexp_matches(name, '^[0-9.]+$|^\[') as address from named),
hosts as (select host, n, k, case when address then name when last_two in ({_TWO}) then last_two else regexp_extract(name, '([^.]*)$', 1) end as suffix,
    case when address then name when last_two in ({_TWO}) then coalesce(nullif(regexp_extract(name, '([^.]+\.[^.]+\.[^.]+)$', 1), ''), name) when last_two = '' then name else last_two end as domain from two),
domains as ({_sql_moments("hosts", "suffix, domain")}),
suffixes as ({_sql_moments("domains", "suffix")}),
root as (select coalesce((k + 1.0) / (n + 2.0), 0.5) as mean0, strength as strength0 from ({_sql_moments("suffixes", "")})),
s as (select suffix, (k + strength0 * mean0) / (n + strength0) as mean_s, strength as strength_s from suffixes, root),
d as (select domain, (k + strength_s * mean_s) / (n + strength_s) as mean_d, strength as strength_d from domains join s using (suffix)),
h as (select host, (k + strength_d * mean_d) / (n + strength_d) as rate, n + strength_d + 1 as size from hosts join d using (domain)),
bounds as (select host, rate - {Z} * sqrt(rate * (1 - rate) / size) as bound from h),
ruled as (select page_id, host, path, bound, case
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from sites join bounds using (host))
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' when bound >= {THRESHOLD} then 'allow' else 'block' end as verdict,
    round(bound, 9) as bound from ruled
"""

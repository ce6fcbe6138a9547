"""URL filters: rules first, else an empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host and shrunk through beta-binomial priors: the suffix is
shrunk towards the whole, the registered domain towards its suffix, the host towards its registered domain. The
strength of each prior is estimated by moments from the spread of the groups' rates (overdispersion). A page is
blocked if the lower posterior bound of its host's bad rate exceeds a limit; a host without outcomes has the
posterior of its nearest ancestor.

Suffixes of several labels are read from ``suffixes.txt`` (a parameter). Counts by host are written to the shared folder once; the priors' strengths are four numbers.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, counts for no host and is judged by the
overall rate. Outcomes without a verdict (null) don't count; a null page id is passed through; urls of any length are read whole. Repeated rows are judged alike. An empty outcome table blocks nothing beyond the rules. Columns of the
pages other than the url are passed through; ``host``, ``path``, ``rule``, ``verdict`` and ``bad_bound`` are ours and replace
columns of those names. Everything is DataFrame operations: counts are aggregated before they are joined, and the one join
against pages takes hot hosts (at most ``HOT_SHARE`` by definition) from a broadcast and shuffles the others' pages alone, as one host may hold a third of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.plans.shared import materialize

from ._spark import LOWER, UPPER, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)
#: Suffixes of more than one label; the last label is a suffix anyway.
SUFFIXES = tuple(Path(__file__).with_name("suffixes.txt").read_text().split())
#: A host that holds more than one in so many pages is hot; there are fewer hot hosts than that.
HOT_SHARE = 1000
LIMIT, Z = 0.5, 1.645
#: The least strength of a prior: a host's own few outcomes never decide alone.
WEAKEST = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    found = F.coalesce(at > 0, F.lit(False))
    return F.when(found, host).otherwise(""), F.when(found, path).otherwise("")


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule, as a struct of text and verdict, or null. Rules are parameters: their number is the caller's."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last two labels if they are a suffix, else the last one."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: one label more than the suffix (the host itself if there is none)."""
    left = F.substring_index(F.left(host, F.greatest(F.length(host) - F.length(suffix) - 1, F.lit(0))), ".", -1)
    return F.when(F.length(host) > F.length(suffix), F.concat_ws(".", left, suffix)).otherwise(host)


def _strength(groups: DataFrame) -> float:
    """Prior strength by moments from the groups' counts (n, bad), within [WEAKEST, 10000]."""
    total = groups.agg(F.sum("n").alias("n"), F.sum("bad").alias("b"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")).first()
    if total.k < 2:
        return 10000.0
    n, p = float(total.n), total.b / total.n
    left = n - total.nn / n
    between = (total.bb - n * p * p - (total.k - 1) * p * (1 - p)) / left if left > 0 else 0.0
    return max(WEAKEST, min(10000.0, p * (1 - p) / between - 1)) if between > 0 else 10000.0


@dataclass(frozen=True)
class Reputation:
    """Posterior means by host (``_h``, m, a), domain (``_d``, m_d) and suffix (``_s``, m_s), the mean of all, and the strength of a host's prior."""

    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    overall: float
    strength: float


def reputation(outcomes: DataFrame) -> Reputation:
    """From outcomes (host, n, bad), one row a host."""
    hosts = outcomes.where("host != ''").withColumnsRenamed({"host": "_h"}).withColumn("_s", suffix_of(F.col("_h")))
    hosts = materialize(hosts.withColumn("_d", domain_of(F.col("_h"), F.col("_s"))), "url-hosts")
    domains = hosts.groupBy("_d", "_s").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("_s").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k_h, k_d, k_s = _strength(hosts), _strength(domains), _strength(suffixes)
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    m0 = (whole.bad + 1) / (whole.n + 2)
    s = suffixes.select("_s", ((F.col("bad") + k_s * m0) / (F.col("n") + k_s)).alias("m_s"))
    d = domains.join(s, "_s").select("_d", ((F.col("bad") + k_d * F.col("m_s")) / (F.col("n") + k_d)).alias("m_d"))
    h = hosts.join(d, "_d").select("_h", ((F.col("bad") + k_h * F.col("m_d")) / (F.col("n") + k_h)).alias("m"), (F.col("n") + k_h).alias("a"))
    return Reputation(h, d, s, m0, k_h)


def posterior(hosts: DataFrame, outcomes: DataFrame, z: float) -> DataFrame:
    """Lower posterior bound ``bad_bound`` of the bad rate of each distinct host."""
    r = reputation(outcomes)
    x = hosts.withColumn("_h", F.col("host")).withColumn("_s", suffix_of(F.col("host")))
    x = x.withColumn("_d", domain_of(F.col("_h"), F.col("_s")))
    x = x.join(r.hosts, "_h", "left").join(r.domains, "_d", "left").join(r.suffixes, "_s", "left")
    mean, strength = F.coalesce("m", "m_d", "m_s", F.lit(r.overall)), F.coalesce("a", F.lit(r.strength))
    return x.select("host", (mean - z * F.sqrt(mean * (1 - mean) / (strength + 1))).alias("bad_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, limit: float = LIMIT, z: float = Z, hot_share: int = HOT_SHARE) -> DataFrame:
    """Judge every page: adds host, path, rule, verdict and bad_bound.

    ``outcomes`` holds (url, bad boolean), one row per labelled page.
    """
    own = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict", "bad_bound"}]
    host, path = host_and_path(F.col("url"))
    x = pages.select(*own, host.alias("host"), path.alias("path"))
    counts = outcomes.select(host.alias("host"), F.col("bad").cast("int").alias("bad")).where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    sizes = materialize(x.groupBy("host").agg(F.count("*").alias("_n")), "url-page-hosts")
    bounds = materialize(posterior(sizes.select("host"), counts, z), "url-bounds")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    hot = sizes.where(F.col("_n") * hot_share > total).select("host")  # fewer than hot_share rows
    of_hot = bounds.join(F.broadcast(hot), "host", "left_semi")
    x = x.join(F.broadcast(of_hot), "host").unionByName(x.join(F.broadcast(hot), "host", "left_anti").join(bounds, "host", "left"))
    x = x.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    return x.select(*own, "host", "path", F.col("_rule.text").alias("rule"), verdict.alias("verdict"), "bad_bound")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad if the labelled document of its number is toxic or of quality 0."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    outcomes = pages.join(labels, pages.page_id == labels.doc_id).select("url", "bad")
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


_CASES = "\n".join(
    f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.text}'" for r in sorted(RULES, key=lambda r: (-len(r.text), r.text))
)
_BLOCKS = ", ".join(f"'{r.text}'" for r in RULES if r.verdict == "block")

_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)


def _sql_strength(name: str) -> str:
    return f"""(select case when count(*) < 2 or sum(n) <= sum(n * n) / sum(n) or v <= 0 then 10000.0 else greatest({WEAKEST}, least(10000.0, p * (1 - p) / v - 1)) end
    from {name}, (select sum(bad) / sum(n) p, (sum(bad * bad / n) - sum(n) * (sum(bad) / sum(n)) ^ 2 - (count(*) - 1) * (sum(bad) / sum(n)) * (1 - sum(bad) / sum(n))) / nullif(sum(n) - sum(n * n) / sum(n), 0) v from {name}) group by p, v)"""


ORACLE = rf"""
with x as (
  select page_id, url, case when instr(url, '://') > 0 then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') else '' end as host,
    case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
y as (select *, case when regexp_extract(host, '[^.]*\.[^.]*$') in ({_SUFFIXES}) then regexp_extract(host, '[^.]*\.[^.]*$') else string_split(host, '.')[-1] end as s from x),
z as (select *, case when length(host) > length(s) then string_split(left(host, length(host) - length(s) - 1), '.')[-1] || '.' || s else host end as d,
  case {_CASES} end as rule from y),
l as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
hosts as (select host, d, s, count(*)::double as n, sum(bad)::double as bad from z join l on page_id = doc_id where host <> '' group by all),
domains as (select d, s, sum(n) as n, sum(bad) as bad from hosts group by all),
suffixes as (select s, sum(n) as n, sum(bad) as bad from domains group by all),
prior as (select {_sql_strength('hosts')} as kh, {_sql_strength('domains')} as kd, {_sql_strength('suffixes')} as ks, (select (sum(bad) + 1) / (sum(n) + 2) from suffixes) as m0),
ms as (select s, (bad + ks * m0) / (n + ks) as ms from suffixes, prior),
md as (select d, (bad + kd * ms) / (n + kd) as md from domains join ms using (s), prior),
mh as (select host, (bad + kh * md) / (n + kh) as m, n + kh as a from hosts join md using (d), prior),
j as (select page_id, host, path, rule, coalesce(m, md, ms, m0) as mean, coalesce(a, kh) as a from z left join mh using (host) left join md using (d) left join ms using (s), prior)
select page_id, host, path, rule, case when rule in ({_BLOCKS}) then 'block' when rule is not null then 'allow'
  when mean - {Z} * sqrt(mean * (1 - mean) / (a + 1)) > {LIMIT} then 'block' else 'allow' end as verdict from j
"""

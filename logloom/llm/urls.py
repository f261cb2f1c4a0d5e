"""URL filters: explicit rules, and empirical-Bayes host reputation for all other pages.

Labelled page outcomes (here: labels of the same id; a page is bad if its quality is 0 or it is toxic) are counted by
host. Rates shrink through beta-binomial priors: all pages -> public suffix -> registered domain -> host. Each level's prior
is the posterior mean of the level above, with a strength found from the spread of the rates below it (method of moments). A host is
blocked if the lower bound of its posterior bad rate, mean - Z standard deviations, is above RATIO times the rate of all labelled pages.

Public suffixes are a parameter: some names of several labels, or a table of any length (read_suffixes). User info, port and trailing dots are no part of a
host's levels.

Defined results: a null url or one without :// has an empty host and path, fits no rule, and is judged as the empty host;
an unlabelled host has its domain's posterior; repeated rows are judged alike, each once; an empty table gives an empty result;
a label that is null counts as no label; other columns are ignored. Hosts are aggregated before they shuffle, so a hot host is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.shared import cut, sized

RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
#: Suffixes of two labels under which names are registered (fixed values; read_suffixes() takes a whole list).
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "org.br", "co.jp", "ne.jp", "or.jp", "co.nz", "co.za", "com.cn",
    "org.cn", "com.mx", "com.ar", "com.tr", "com.tw", "com.hk", "com.sg", "com.ua", "com.pl", "co.in", "co.il", "co.kr", "or.kr", "co.id", "com.my",
    "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "netlify.app", "vercel.app", "herokuapp.com", "web.app", "pages.dev",
)
Z = 1.645
RATIO = 1.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "/", 1))
    for stop in ("?", "#"):
        rest = F.substring_index(rest, stop, 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://[^/?#]*", ""))
    for stop in ("?", "#"):
        rest = F.substring_index(rest, stop, 1)
    return F.coalesce(rest, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(size, rule, verdict), or null. Rules are configuration: a short list."""
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        on_host = (host == h) | host.endswith("." + h)
        hit = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(on_host & path.startswith("/" + p), hit))
    return F.array_max(F.array_compact(F.array(*fits)))


def read_suffixes(spark, path: str) -> DataFrame:
    """(suffix) from a text file with one rule a line, as the public list has it; comments, wildcards and exceptions are left out."""
    line = F.lower(F.trim(F.split("value", r"\s")[0]))
    return spark.read.text(path).select(line.alias("suffix")).where("suffix <> '' AND NOT startswith(suffix, '//') AND NOT suffix RLIKE '[*!]'").distinct()


def with_levels(hosts: DataFrame, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """Adds the public suffix (the longest that is listed, else the last label) and the registered domain of each host."""
    bare = F.regexp_replace(F.substring_index(F.substring_index("host", "@", -1), ":", 1), r"\.+$", "")
    hosts = hosts.withColumn("__l", F.split(bare, r"\."))
    last = lambda n: F.concat_ws(".", F.slice("__l", F.greatest(F.size("__l") - n + 1, F.lit(1)), n))
    if isinstance(suffixes, DataFrame):
        tails = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("__l")), last)).alias("__n", "suffix"))
        listed = suffixes.select("suffix").distinct()
        longest = tails.join(sized(listed, listed.count()), "suffix").groupBy("host").agg(F.max(F.col("__n") + 1).alias("__k"))
        hosts = hosts.join(longest, "host", "left").withColumn("__k", F.coalesce("__k", F.lit(1)))
    else:
        hosts = hosts.withColumn("__k", F.when(last(F.lit(2)).isin(*suffixes), 2).otherwise(1))
    return hosts.withColumn("suffix", last(F.col("__k"))).withColumn("domain", last(F.col("__k") + 1)).drop("__l", "__k")


def _strength() -> Column:
    """Prior strength from child counts (k of n) against their parent's mean m: 1 / rho - 1."""
    v = F.col("m") * (1 - F.col("m"))
    s = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2))
    rho = (s - F.sum(v)) / F.nullif(F.sum(v * (F.col("n") - 1)), F.lit(0.0))
    rho = F.least(F.lit(0.9), F.greatest(F.lit(0.001), F.coalesce(rho, F.lit(0.001))))
    return (1 / rho - 1).alias("strength")


def reputation(outcomes: DataFrame, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, n_labelled, n_bad, prior, posterior, deviation, lower bound and the rate of all, from outcomes(host, bad: 1, 0 or null)."""
    by_host = with_levels(
        outcomes.groupBy("host").agg(
            F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k")
        ),
        suffixes,
    )
    by_host = cut(by_host, "hosts")
    n, k = F.sum("n").alias("n"), F.sum("k").alias("k")
    bad, labelled = by_host.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()

    rate = (bad + 1) / (labelled + 2)

    def shrink(level: DataFrame) -> DataFrame:
        """level has n, k and the parent's posterior mean m; adds its own posterior."""
        strength = F.lit(float(level.where("n > 0").agg(_strength()).first()[0]))
        return level.withColumn("strength", strength).withColumn(
            "posterior", (F.col("m") * F.col("strength") + F.col("k")) / (F.col("strength") + F.col("n"))
        )

    suffix = shrink(by_host.groupBy("suffix").agg(n, k).withColumn("m", F.lit(rate)))
    up = suffix.select("suffix", F.col("posterior").alias("m"))
    domain = shrink(by_host.groupBy("suffix", "domain").agg(n, k).join(up, "suffix"))
    up = domain.select("suffix", "domain", F.col("posterior").alias("m"))
    host = shrink(by_host.join(up, ["suffix", "domain"]))
    total = F.col("strength") + F.col("n")
    dev = F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (total + 1))
    return host.select(
        "host",
        F.col("n").cast("long").alias("n_labelled"),
        F.col("k").cast("long").alias("n_bad"),
        F.col("m").alias("prior"),
        "posterior",
        dev.alias("deviation"),
        (F.col("posterior") - Z * dev).alias("lower_bound"),
        F.lit(rate).alias("rate"),
    )


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, ratio: float = RATIO, suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's reputation for each row of pages(page_id, url)."""
    url = F.col("url").cast("string")
    x = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.lit(1)).alias("__any")
    known = labels.select(
        F.col("doc_id").alias("page_id"),
        bad,
        ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int").alias("bad"),
    )
    known = known.where("__any = 1 and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = cut(reputation(x.select("page_id", "host").join(known, "page_id", "left").select("host", "bad"), suffixes), "reputation")
    out = x.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    out = out.join(sized(hosts, hosts.count()), "host", "left")
    by_host = F.when(F.coalesce(F.col("lower_bound") > ratio * F.col("rate"), F.lit(False)), "block").otherwise("allow")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", by_host).alias("verdict"),
        "n_labelled",
        "n_bad",
        "posterior",
        "lower_bound",
    )


def op3_url_reputation(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    out = judge(pages, labels)
    return out.withColumn("posterior", F.round("posterior", 6)).withColumn("lower_bound", F.round("lower_bound", 6))


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)


def _sql_level(name: str, source: str) -> str:
    """Posterior of each row of source(..., n, k, m) by the moments of its labelled rows."""
    return f"""
{name}_s AS (SELECT 1 / least(0.9, greatest(0.001, coalesce((sum(n * pow(k / n - m, 2)) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.001))) - 1 AS s
  FROM {source} WHERE n > 0),
{name} AS (SELECT *, (m * s + k) / (s + n) AS p FROM {source}, {name}_s)"""


OP3_SQL = (
    f"""
WITH x AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
known AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels
          WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
h0 AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k, string_split(regexp_replace(split_part(regexp_replace(host, '^.*@', ''), ':', 1), '\\.+$', ''), '.') AS l
       FROM x LEFT JOIN known ON page_id = doc_id GROUP BY host),
h1 AS (SELECT *, array_to_string(l[-2:], '.') IN ({_TWO}) AS two FROM h0),
h AS (SELECT host, n, k, array_to_string(CASE WHEN two THEN l[-2:] ELSE l[-1:] END, '.') AS suffix, array_to_string(CASE WHEN two THEN l[-3:] ELSE l[-2:] END, '.') AS dom FROM h1),
t0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM h) AS m FROM h GROUP BY 1),"""
    + _sql_level("t", "t0")
    + """,
d0 AS (SELECT h.suffix, dom, sum(h.n) AS n, sum(h.k) AS k, any_value(t.p) AS m FROM h JOIN t ON h.suffix = t.suffix GROUP BY 1, 2),"""
    + _sql_level("d", "d0")
    + """,
e0 AS (SELECT host, h.n, h.k, d.p AS m FROM h JOIN d ON h.suffix = d.suffix AND h.dom = d.dom),"""
    + _sql_level("e", "e0")
    + f""",
r AS (SELECT host, n, k, p, p - {Z} * sqrt(p * (1 - p) / (s + n + 1)) AS lo FROM e),
y AS (SELECT *, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM x)
SELECT page_id, y.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN lo > {RATIO} * (SELECT (sum(k) + 1) / (sum(n) + 2) FROM h) THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n AS BIGINT) AS n_labelled, CAST(k AS BIGINT) AS n_bad, round(p, 6) AS posterior, round(lo, 6) AS lower_bound
FROM y JOIN r ON y.host = r.host"""
)

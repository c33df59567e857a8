"""URL filters: allow and block rules, and empirical-Bayes host reputation.

Labelled outcomes are counted per host, registered domain and suffix.  Each
level's bad rate is shrunk to the level above by a beta-binomial prior whose
mean is the upper level's shrunken rate and whose strength is estimated from the
spread of rates at its own level.  A host is blocked when the lower bound of its
posterior bad rate exceeds a limit.  Only DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import scratch_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Posterior bound: standard deviations below the mean, and the bad rate above which a host is blocked.
Z, LIMIT = 1.645, 0.3
#: Range of the estimated strength of a prior, in pseudo-observations.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    # the part before the first of the characters that end it; (?s) lets a dot match line ends
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", host).withColumn("path", path)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; null where none does."""
    text = verdict = None
    for what, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        text = F.when(fits, rule) if text is None else text.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if text is None else (text, verdict)


def with_domain_and_suffix(df: DataFrame) -> DataFrame:
    labels = F.split("host", r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(wide, two).otherwise(F.element_at(labels, -1))
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - F.when(wide, 2).otherwise(1), F.lit(1)), 3), ".")
    return df.withColumn("suffix", suffix).withColumn("domain", domain)


def _strength(level: DataFrame) -> DataFrame:
    """One row: prior strength from the spread of (bad, n) around prior_mean, by the method of moments.

    With rates p = bad / n around means m, E[n (p - m)^2] = m (1 - m) (1 + (n - 1) / (s + 1)):
    summed over the level and solved for s.
    """
    noise = F.col("prior_mean") * (1 - F.col("prior_mean"))
    p = F.col("bad") / F.col("n")
    sums = level.agg(
        F.sum(F.col("n") * (p - F.col("prior_mean")) * (p - F.col("prior_mean")) - noise).alias("extra"),
        F.sum((F.col("n") - 1) * noise).alias("room"),
    )
    rho = F.col("extra") / F.col("room")
    s = F.when(F.col("room").isNull() | (F.col("room") <= 0) | (rho <= 0), F.lit(MOST_STRENGTH)).otherwise(F.least(F.greatest(1 / rho - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)))
    return sums.select(s.alias("strength"))


def _shrunk(level: DataFrame) -> DataFrame:
    """Adds alpha and beta of the posterior and its mean, given prior_mean; the strength comes from rows with outcomes."""
    both = level.withColumn("strength", _strength(level.where("n > 0")).scalar())
    both = both.withColumn("alpha", F.col("strength") * F.col("prior_mean") + F.col("bad")).withColumn("beta", F.col("strength") * (1 - F.col("prior_mean")) + F.col("n") - F.col("bad"))
    return both.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def host_reputation(outcomes: DataFrame, *, z: float = Z) -> DataFrame:
    """Posterior per host from (host, bad 0/1) rows: host, n, bad, mean, bound.

    Null outcomes are not counted; repeated rows count each time; the empty host is
    a host like any other.  A host without outcomes has the mean of its domain, of
    its suffix if the domain has none either, and the strength of all hosts; where
    the suffix has none too, the host is left out.  No rows give no hosts.
    """
    path = scratch_dir(outcomes.sparkSession)
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    # each level is read for its strength, its posteriors and the level below: written, it is counted once
    hosts = written(with_domain_and_suffix(hosts), f"{path}/hosts")
    domains = written(hosts.where("n > 0").groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), f"{path}/domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), f"{path}/suffixes")
    total = suffixes.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("prior_mean"))
    top = _shrunk(suffixes.withColumn("prior_mean", total.scalar())).select("suffix", F.col("mean").alias("prior_mean"))
    mid = _shrunk(written(domains.join(top, "suffix"), f"{path}/domain_priors")).select("suffix", "domain", F.col("mean").alias("domain_mean"))
    priors = hosts.join(mid, ["suffix", "domain"], "left").join(top, "suffix", "left").withColumn("prior_mean", F.coalesce("domain_mean", "prior_mean")).drop("domain_mean")
    low = _shrunk(written(priors.where(F.col("prior_mean").isNotNull()), f"{path}/host_priors"))
    size = F.col("alpha") + F.col("beta")
    sd = F.sqrt(F.col("alpha") * F.col("beta") / (size * size * (size + 1)))
    return low.select("host", "n", "bad", "mean", (F.col("mean") - z * sd).alias("bound"))


def filter_urls(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", bad: Column | None = None, rules=RULES, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (allow or block), bound.

    ``labels`` has an outcome for some page ids; ``bad`` tells which are bad
    (toxic or of low quality).  Where no rule fits, a page is blocked if its
    host's posterior bound exceeds ``limit``; a host without labels has the bound
    of its domain's or suffix's prior, and is allowed if these have no labels.
    Null urls have empty host and path.  Repeated pages are each judged; repeated
    labels count each time; null ids match no label; extra columns are ignored.
    """
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)) if bad is None else bad
    src = with_host_and_path(pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias("url")), "url").drop("url")
    marks = labels.select(F.col(f"`{label_id}`").alias(id_col), bad.cast("int").alias("bad"))
    outcomes = src.join(marks, id_col).select("host", "bad").unionByName(src.select("host", F.lit(None).cast("int").alias("bad")))
    reputation = host_reputation(outcomes, z=z).select("host", "bound")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return src.join(reputation, "host", "left").select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")


def oracle_sql(rules=RULES, z: float = Z, limit: float = LIMIT) -> str:
    """The same as DuckDB SQL over ``pages`` and ``labels``, without the bound."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def case(value) -> str:
        arms = []
        for what, rule in ranked:
            name, slash, rest = rule.partition("/")
            arms.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') THEN '{value(what, rule)}'")
        return "CASE " + " ".join(arms) + " END"

    wide = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

    def shrunk(name: str, source: str) -> str:
        return f"""{name}_s AS (SELECT CASE WHEN room IS NULL OR room <= 0 OR extra / room <= 0 THEN {MOST_STRENGTH}::DOUBLE
  ELSE least(greatest(1 / (extra / room) - 1, {LEAST_STRENGTH}::DOUBLE), {MOST_STRENGTH}::DOUBLE) END AS strength FROM (
  SELECT sum(n * (bad / n - prior_mean) * (bad / n - prior_mean) - prior_mean * (1 - prior_mean)) AS extra,
         sum((n - 1) * prior_mean * (1 - prior_mean)) AS room FROM {source}) t),
{name} AS (SELECT *, a / (a + b) AS mean FROM (SELECT *, strength * prior_mean + bad AS a, strength * (1 - prior_mean) + n - bad AS b FROM {source}, {name}_s) t)"""

    return f"""WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
src AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rests),
outcomes AS (SELECT host, ((toxic = 1) OR (quality = 0))::INT AS bad FROM src JOIN labels ON doc_id = page_id),
counted AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, string_split(host, '.') AS l FROM outcomes WHERE bad IS NOT NULL GROUP BY host),
joined AS (SELECT *, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS two FROM counted),
hosts AS (SELECT host, n, bad, CASE WHEN two IN ({wide}) THEN two ELSE l[len(l)] END AS suffix,
  array_to_string(l[greatest(len(l) - CASE WHEN two IN ({wide}) THEN 2 ELSE 1 END, 1):], '.') AS domain FROM joined),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
s0 AS (SELECT s.*, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM suffixes) AS prior_mean FROM suffixes s),
{shrunk("s1", "s0")},
d0 AS (SELECT d.*, s1.mean AS prior_mean FROM domains d JOIN s1 USING (suffix)),
{shrunk("d1", "d0")},
h0 AS (SELECT h.*, d1.mean AS prior_mean FROM hosts h JOIN d1 USING (suffix, domain)),
{shrunk("h1", "h0")},
reputation AS (SELECT host, mean - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h1)
SELECT page_id, host, path, {case(lambda w, r: r)} AS rule,
  coalesce({case(lambda w, r: w)}, CASE WHEN bound > {limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM src LEFT JOIN reputation USING (host)"""

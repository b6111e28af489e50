"""URL filters: fixed rules first, then an empirical-Bayes reputation of the host.

Labelled outcomes are counted by host, registered domain and suffix. Each level shrinks to
the one above through a beta prior whose strength comes from the spread between the
groups of that level (method of moments). A page is blocked when even the lower posterior
bound of its host's share of bad pages is above the limit.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (name, host, path, verdict); fixed values.
RULES = (("net/", "net", "/", "block"), ("example.net/en/", "example.net", "/en/", "allow"), ("example.com/de/", "example.com", "/de/", "block"), ("org/fr/", "org", "/fr/", "allow"))
#: Public suffixes of more than one label, in the form of the public suffix list (`*.` stands for any label, `!` for an exception); each other
#: suffix is the last label. Fixed values, a part of that list: pass all of its lines as `suffixes` for a whole crawl.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "net.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "net.nz", "ac.nz", "co.jp", "ne.jp",
    "or.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "ne.kr", "ac.kr", "com.cn", "net.cn", "org.cn", "edu.cn", "gov.cn", "com.hk", "com.tw", "org.tw", "edu.tw", "com.sg", "edu.sg",
    "com.my", "co.id", "or.id", "ac.id", "co.th", "ac.th", "in.th", "com.vn", "com.ph", "co.in", "net.in", "org.in", "ac.in", "gov.in", "com.pk", "com.bd", "co.il", "org.il",
    "ac.il", "com.tr", "org.tr", "edu.tr", "com.sa", "com.eg", "co.za", "org.za", "ac.za", "co.ke", "com.ng", "com.br", "net.br", "org.br", "com.ar", "com.mx", "org.mx",
    "com.co", "com.pe", "com.ve", "com.ec", "com.uy", "com.ua", "com.pl", "com.ru", "com.gr", "com.pt", "com.es", "org.es", "co.at", "or.at", "*.ck", "!www.ck", "*.bd",
    "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "netlify.app", "vercel.app", "pages.dev", "herokuapp.com", "azurewebsites.net", "cloudfront.net",
)
#: Posterior standard deviations below the mean, and the share of bad pages above which a host is blocked.
Z, LIMIT = 1.645, 0.5
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = None
    for rule, rule_host, rule_path, what in sorted(RULES, key=lambda r: -len(r[0])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return name, verdict


def bare_host(host: Column) -> Column:
    """The host as reputation sees it: without user name, port and trailing dots."""
    name = F.regexp_replace(host, r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(name, r":[0-9]*$", ""), r"[.]+$", "")


def with_domains(hosts: DataFrame, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """`hosts` with public suffix and registered domain of the column `host`.

    The longest listed suffix holds, an exception before it, else the last label; the domain has one label more, or is the
    host where there is none. Numeric addresses are suffix and domain of their own. The list is a bounded table
    (some ten thousand lines at most); a join by suffix finds its lines.
    """
    lines = [F.lit(s) for s in sorted({s.strip() for s in suffixes} - {""}) if not s.startswith("//")]
    listed = hosts.sparkSession.range(1).select(F.explode(F.array(*lines).cast("array<string>")).alias("line"))
    name = bare_host(F.col("host"))
    names = hosts.select("host", name.alias("name"), F.split(name, "[.]").alias("labels")).distinct()
    address = F.col("name").rlike(r"^[0-9]+(?:[.][0-9]+){3}$|^\[")
    tail = lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), ".")
    lengths = F.sequence(F.lit(1), F.size("labels"))
    # each tail of labels may stand in the list as it is, with its first label as *, or as an exception
    forms = F.flatten(
        F.transform(
            lengths,
            lambda k: F.array(
                F.struct(tail(k).alias("line"), k.alias("take"), F.lit(0).alias("exception")),
                F.struct(F.concat(F.lit("*."), tail(k - 1)).alias("line"), k.alias("take"), F.lit(0).alias("exception")),
                F.struct(F.concat(F.lit("!"), tail(k)).alias("line"), (k - 1).alias("take"), F.lit(1).alias("exception")),
            ),
        )
    )
    found = names.filter(~address).select("host", F.explode(forms).alias("f")).select("host", "f.*").join(listed, "line")
    best = found.groupBy("host").agg(F.max(F.struct("exception", "take")).alias("best")).select("host", "best.take")
    out = names.join(best, "host", "left").withColumn("take", F.greatest(F.coalesce("take", F.lit(1)), F.lit(1)))
    suffix, domain = F.expr("array_join(slice(labels, size(labels) - take + 1, take), '.')"), F.expr("array_join(slice(labels, greatest(1, size(labels) - take), take + 1), '.')")
    out = out.select("host", F.when(address, F.col("name")).otherwise(suffix).alias("suffix"), F.when(address, F.col("name")).otherwise(domain).alias("domain"))
    return hosts.join(out, "host")


def _strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: the strength of the beta prior for the groups of one level."""
    s = groups.filter("n > 0").agg(
        F.sum("n").cast("double").alias("n"),
        F.sum("bad").cast("double").alias("k"),
        F.count(F.lit(1)).cast("double").alias("g"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("k2"),
    )
    p = F.col("k") / F.col("n")
    spread = (F.col("k2") - F.col("k") * p) / (p * (1 - p)) - (F.col("g") - 1)
    room = F.col("n") - F.col("n2") / F.col("n") - (F.col("g") - 1)
    usable = (F.col("n") > 0) & (F.col("k") > 0) & (F.col("k") < F.col("n")) & (room > 0) & (spread > 0)
    rho = spread / room
    value = F.when(usable, F.least(F.lit(MAX_STRENGTH), F.greatest(F.lit(MIN_STRENGTH), 1 / rho - 1))).otherwise(MAX_STRENGTH)
    return s.select(value.alias(name))


def host_reputation(outcomes: DataFrame, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """host, n, bad, mean, bound, blocked from rows (host, bad): bad is 1, 0 or null (not labelled).

    Hosts without a label inherit the posterior of their domain. No labels at all: nothing is blocked.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = with_domains(hosts, suffixes)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select(((F.col("bad") + 1) / (F.col("n") + 2)).alias("m0"))

    def posterior(level: DataFrame, parent: DataFrame, on: list[str], prior: str, name: str) -> DataFrame:
        # one row of prior strength beside each group: a one-row broadcast
        joined = level.join(parent, on).crossJoin(F.broadcast(_strength(level, "s"))) if on else level.crossJoin(F.broadcast(parent)).crossJoin(F.broadcast(_strength(level, "s")))
        a = F.col("s") * F.col(prior) + F.col("bad")
        b = F.col("s") * (1 - F.col(prior)) + (F.col("n") - F.col("bad"))
        return joined.withColumn("a", a).withColumn("b", b).withColumn(name, F.col("a") / (F.col("a") + F.col("b")))

    m1 = posterior(suffixes, top, [], "m0", "m1").select("suffix", "m1")
    m2 = posterior(domains, m1, ["suffix"], "m1", "m2").select("suffix", "domain", "m2")
    out = posterior(hosts, m2, ["suffix", "domain"], "m2", "mean")
    both = F.col("a") + F.col("b")
    bound = F.col("mean") - Z * F.sqrt(F.col("a") * F.col("b") / (both * both * (both + 1)))
    return out.withColumn("bound", bound).select("host", "n", "bad", "mean", "bound", (F.col("bound") > LIMIT).alias("blocked"))


def judge_urls(pages: DataFrame, labels: DataFrame, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, n_bad: one row for each row of `pages`.

    `labels` has doc_id (the page's id), quality, toxic; a page is bad if any of its label rows says
    toxic 1 or quality 0, and not labelled if all are null or none exists. Null urls, and urls
    without ://, have an empty host and path; they form a host of their own. Null page ids have no label.
    Repeated pages each count. User names, ports and trailing dots stay in `host` but don't part a host from its domain. Empty
    tables give empty results, or verdicts of the rules alone. Other columns are not read.
    """
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("page_id"), bad.alias("bad")).filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    seen = rows.select("page_id", "host").join(marks, "page_id", "left")
    verdicts = host_reputation(seen, suffixes).select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "blocked")
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return rows.join(verdicts, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "n_labelled", "n_bad")


def _sql() -> str:
    """judge_urls as DuckDB SQL over pages and labels."""
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", r, v) for r, h, p, v in sorted(RULES, key=lambda r: -len(r[0]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " ELSE NULL END"
    listed = ", ".join(f"('{s}')" for s in SUFFIXES)

    def strength(table: str) -> str:
        return f"""(SELECT CASE WHEN n > 0 AND k > 0 AND k < n AND room > 0 AND spread > 0
            THEN least({MAX_STRENGTH}::DOUBLE, greatest({MIN_STRENGTH}::DOUBLE, 1 / (spread / room) - 1)) ELSE {MAX_STRENGTH}::DOUBLE END AS s
          FROM (SELECT n, k, (k2 - k * (k / n)) / ((k / n) * (1 - k / n)) - (g - 1) AS spread, n - n2 / n - (g - 1) AS room
            FROM (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS k, count(*)::DOUBLE AS g, sum(n::DOUBLE * n) AS n2, sum(bad::DOUBLE * bad / n) AS k2
              FROM {table} WHERE n > 0)))"""

    return f"""
WITH marks AS (
  SELECT doc_id AS page_id, max(bad) AS bad FROM (
    SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END AS bad FROM labels)
  WHERE doc_id IS NOT NULL AND bad IS NOT NULL GROUP BY 1),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rest),
rws AS (SELECT page_id, translate(raw_host, '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM raw),
hosts0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM rws LEFT JOIN marks USING (page_id) GROUP BY 1),
listed AS (SELECT * FROM (VALUES {listed}) AS v(line)),
names AS (SELECT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS name FROM hosts0),
labels_ AS (SELECT host, name, string_split(name, '.') AS ls, regexp_matches(name, '^[0-9]+([.][0-9]+){{3}}$') OR starts_with(name, '[') AS address FROM names),
tails AS (SELECT host, unnest(range(1, len(ls) + 1)) AS k, ls FROM labels_ WHERE NOT address),
forms AS (SELECT host, k AS take, 0 AS exception, array_to_string(ls[len(ls) - k + 1:], '.') AS line FROM tails
  UNION ALL SELECT host, k, 0, '*.' || array_to_string(ls[len(ls) - k + 2:], '.') FROM tails
  UNION ALL SELECT host, k - 1, 1, '!' || array_to_string(ls[len(ls) - k + 1:], '.') FROM tails),
best AS (SELECT host, arg_max(take, exception * 1000000 + take) AS take FROM forms SEMI JOIN listed USING (line) GROUP BY 1),
taken AS (SELECT host, name, ls, address, greatest(coalesce(take, 1), 1) AS take FROM labels_ LEFT JOIN best USING (host)),
hosts AS (SELECT hosts0.*, CASE WHEN address THEN name ELSE array_to_string(ls[len(ls) - take + 1:], '.') END AS suffix,
  CASE WHEN address THEN name ELSE array_to_string(ls[greatest(1, len(ls) - take):], '.') END AS domain FROM hosts0 JOIN taken USING (host)),
domains AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY 1),
top AS (SELECT (sum(bad) + 1)::DOUBLE / (sum(n) + 2) AS m0 FROM suffixes),
m1 AS (SELECT suffix, (s * m0 + bad) / ((s * m0 + bad) + (s * (1 - m0) + (n - bad))) AS m1 FROM suffixes, top, {strength("suffixes")}),
m2 AS (SELECT suffix, domain, (s * m1 + bad) / ((s * m1 + bad) + (s * (1 - m1) + (n - bad))) AS m2 FROM domains JOIN m1 USING (suffix), {strength("domains")}),
post AS (SELECT host, n, bad, s * m2 + bad AS a, s * (1 - m2) + (n - bad) AS b FROM hosts JOIN m2 USING (suffix, domain), {strength("hosts")}),
verdicts AS (SELECT host, n AS n_labelled, bad AS n_bad,
  a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {LIMIT} AS blocked FROM post)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(2)}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, n_labelled, n_bad
FROM rws JOIN verdicts USING (host)
"""


SQL = _sql()

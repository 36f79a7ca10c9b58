"""URL rules, and the empirical-Bayes reputation of hosts.

A rule is a host suffix and a path prefix with a verdict; the longest fitting rule wins.
For all other pages the host's labelled outcomes decide, shrunk level by level through
beta-binomial priors: the suffix's rate towards the overall rate, the registered domain's
towards the suffix's, the host's towards the domain's. A prior's strength at a level
follows from the intra-class correlation of the labelled outcomes there (the ANOVA
estimator), so levels whose members differ shrink little and alike ones much.

A page is blocked where its host is bad beyond doubt: the 5 per cent quantile of the host's
beta posterior is above ``lift`` times the overall rate of bad outcomes, which is
what the labels say of any page. So the bound moves with the labels, and where hosts are all
alike none is blocked.

A page's outcome is the label of the document its path names (``/lang/number``): bad
where its quality is 0 or it is toxic.

Defined cases: a null url, or one without ``://``, has an empty host and path and stands
for a host of its own; unlabelled hosts have their domain's rate; without any label the
overall rate is one half with little weight, and nothing is blocked; repeated labels of
a document count once, as bad if any is; repeated pages are judged each, and each counts as an
outcome; an empty table gives no rows; very long urls are matched whole; other columns pass through no further.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, materialize

#: (host suffix, path prefix, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Public suffixes of two labels; all others count as one label. A parameter, not a full list.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn")
#: How many times the overall bad rate a host's posterior bound must exceed.
LIFT = 1.0
#: The normal deviate of the bound's 5 per cent.
BOUND = 1.6448536269514722
#: The prior's strength is held between these, for levels with too few labels to tell.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def parse_urls(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of each page."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(url, pattern, 2).alias("path"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_expressions(rules=RULES) -> tuple[str, str]:
    """SQL for the winning rule's name and verdict; longest rules come first."""
    if not rules:
        return "cast(null as string)", "cast(null as string)"
    name, verdict = [], []
    for host, path, what in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = f"(host = {_quoted(host)} or endswith(host, {_quoted('.' + host)})) and startswith(path, {_quoted(path)})"
        name.append(f"when {fits} then {_quoted(host + path)}")
        verdict.append(f"when {fits} then {_quoted(what)}")
    return f"case {' '.join(name)} end", f"case {' '.join(verdict)} end"


def _strength(level: DataFrame) -> DataFrame:
    """One row: the prior's strength for members with ``n`` outcomes, ``k`` of them bad."""
    labelled = level.where("n > 0")
    sums = labelled.agg(
        F.count("*").alias("m"), F.sum("n").alias("total"), F.sum("k").alias("bad"),
        F.sum(F.expr("cast(n as double) * n")).alias("squares"), F.sum(F.expr("cast(k as double) * k / n")).alias("between"),
    )
    known = sums.selectExpr(
        "case when m > 1 and total > m and bad > 0 and bad < total then (between - cast(bad as double) * bad / total) / (m - 1) end as msb",
        "case when m > 1 and total > m then (bad - between) / (total - m) end as msw",
        "case when m > 1 then (total - squares / total) / (m - 1) end as n0",
    ).selectExpr("(msb - msw) / nullif(msb + (n0 - 1) * msw, 0) as rho")
    return known.selectExpr(
        f"case when rho is null or rho <= {1 / (1 + MOST_STRENGTH)} then {MOST_STRENGTH}D "
        f"when rho >= {1 / (1 + LEAST_STRENGTH)} then {LEAST_STRENGTH}D else (1 - rho) / rho end as strength"
    )


def beta_quantile(a: str, b: str) -> str:
    """SQL for the 5 per cent quantile of a beta distribution (Abramowitz and Stegun, 26.5.22); shapes under 0.6 count as 0.6."""
    p, q = f"(1 / (2 * greatest({a}, 0.6D) - 1))", f"(1 / (2 * greatest({b}, 0.6D) - 1))"
    h, c = f"(2 / ({p} + {q}))", (BOUND * BOUND - 3) / 6
    w = f"({BOUND}D * sqrt({h} + {c}D) / {h} - ({q} - {p}) * ({c + 5 / 6}D - 2 / (3 * {h})))"
    return f"{a} / ({a} + {b} * exp(2 * {w}))"


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """``host, bad_rate, bad_lower, overall`` from ``host, n, k`` (outcomes and bad ones of each host, one row each)."""
    labels = "size(split(host, '[.]'))"
    two = ", ".join(_quoted(x) for x in TWO_LABEL_SUFFIXES)
    hosts = outcomes.selectExpr("host", "n", "k", f"if(substring_index(host, '.', -2) in ({two}) and {labels} > 2, 2, 1) as width")
    hosts = hosts.selectExpr("host", "n", "k", "substring_index(host, '.', -width) as suffix", "substring_index(host, '.', -(width + 1)) as domain")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("rate"))
    # Single rows of one number each: the bound of these broadcasts is one row.
    s = suffixes.crossJoin(F.broadcast(_strength(suffixes))).crossJoin(F.broadcast(overall))
    s = s.selectExpr("suffix", "(k + strength * rate) / (n + strength) as suffix_rate")
    d = domains.crossJoin(F.broadcast(_strength(domains))).join(s, "suffix")
    d = d.selectExpr("domain", "(k + strength * suffix_rate) / (n + strength) as domain_rate")
    h = hosts.crossJoin(F.broadcast(_strength(hosts))).join(d, "domain").crossJoin(F.broadcast(overall))
    h = h.selectExpr("host", "rate as overall", "k + strength * domain_rate as a", "n - k + strength * (1 - domain_rate) as b")
    return h.selectExpr("host", "a / (a + b) as bad_rate", f"{beta_quantile('a', 'b')} as bad_lower", "overall")


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, lift: float = LIFT) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bad_lower`` for each page.

    Labels meet pages by document; outcomes are summed by host, with map-side partial sums,
    before they meet anything else. The last join, of all pages to their hosts, is an
    ordinary join whose hot hosts Spark splits.
    """
    parsed = parse_urls(pages)
    document = F.expr("try_cast(regexp_extract(path, '^/[^/]*/([0-9]+)', 1) as bigint)")
    labelled = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    labelled = labelled.groupBy(F.col("doc_id").cast("long").alias("labelled_doc")).agg(F.max(F.expr("if(quality = 0 or toxic = 1, 1, 0)")).alias("bad"))
    pairs = parsed.select("host", document.alias("document"))
    # Pages that name no document have nothing to join; they only add their host.
    outcomes = pairs.where("document is not null").join(labelled, F.col("document") == F.col("labelled_doc")).groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    hosts = parsed.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
    # One row a host: a table, as each level above is summed from it.
    outcomes = materialize(hosts.union(outcomes).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "hosts")
    name, verdict = rule_expressions(rules)
    judged = parsed.join(materialize(host_reputation(outcomes), "reputation"), "host", "left")
    return judged.selectExpr(
        "page_id", "host", "path", f"{name} as rule",
        f"coalesce({verdict}, if(bad_lower > {float(lift)}D * overall, 'block', 'allow')) as verdict", "bad_rate", "bad_lower",
    )


def oracle_sql(rules=RULES, lift: float = LIFT) -> str:
    """DuckDB SQL for page_id, host, path, rule and verdict of ``judge_urls``."""
    pattern = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for h, p, _ in ranked]
    name = "case " + " ".join(f"when {f} then '{h + p}'" for f, (h, p, _) in zip(fits, ranked)) + " end"
    ruled = "case " + " ".join(f"when {f} then '{v}'" for f, (_, _, v) in zip(fits, ranked)) + " end"
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)

    def strength(level: str) -> str:
        return f"""(select case when rho is null or rho <= {1 / (1 + MOST_STRENGTH)} then {MOST_STRENGTH}::double when rho >= {1 / (1 + LEAST_STRENGTH)} then {LEAST_STRENGTH}::double else (1 - rho) / rho end
            from (select (msb - msw) / nullif(msb + (n0 - 1) * msw, 0) as rho from (select
                case when m > 1 and total > m and bad > 0 and bad < total then (betw - bad::double * bad / total) / (m - 1) end as msb,
                case when m > 1 and total > m then (bad - betw) / (total - m) end as msw, case when m > 1 then (total - squares / total) / (m - 1) end as n0
                from (select count(*) as m, sum(n)::double as total, sum(k)::double as bad, sum(n::double * n) as squares, sum(k::double * k / n) as betw from {level} where n > 0))))"""

    return f"""
        with parsed as (select page_id, translate(regexp_extract(u, {pattern}, 1), '{UPPER}', '{LOWER}') as host, regexp_extract(u, {pattern}, 2) as path from (select page_id, coalesce(url, '') as u from pages)),
        lab as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null and (quality is not null or toxic is not null) group by doc_id),
        hosts as (select host, count(bad) as n, coalesce(sum(bad), 0)::bigint as k, string_split(host, '.') as parts
            from parsed left join lab on lab.doc_id = try_cast(regexp_extract(path, '^/[^/]*/([0-9]+)', 1) as bigint) group by host),
        wide as (select *, case when len(parts) > 2 and array_to_string(parts[-2:], '.') in ({two}) then 2 else 1 end as width from hosts),
        split_ as (select host, n, k, array_to_string(parts[-width:], '.') as suffix, array_to_string(parts[-(width + 1):], '.') as domain from wide),
        domains as (select suffix, domain, sum(n)::bigint as n, sum(k)::bigint as k from split_ group by all),
        suffixes as (select suffix, sum(n)::bigint as n, sum(k)::bigint as k from domains group by all),
        s as (select suffix, (k + {strength("suffixes")} * (select (coalesce(sum(k), 0) + 1.0::double) / (coalesce(sum(n), 0) + 2.0::double) from suffixes)) / (n + {strength("suffixes")}) as rate from suffixes),
        d as (select domain, (k + {strength("domains")} * s.rate) / (n + {strength("domains")}) as rate from domains join s using (suffix)),
        h as (select host, k + {strength("split_")} * d.rate as a, n - k + {strength("split_")} * (1 - d.rate) as b from split_ join d using (domain))
        select page_id, host, path, {name} as rule, coalesce({ruled},
            case when {re.sub(r"([0-9.]+)D", r"cast(\1 as double)", beta_quantile("a", "b"))} > {float(lift)}::double * (select (coalesce(sum(k), 0) + 1.0::double) / (coalesce(sum(n), 0) + 2.0::double) from suffixes) then 'block' else 'allow' end) as verdict
        from parsed join h using (host)"""

"""URL filter: rules on host and path, and trust that spreads over the links between hosts.

Everything is DataFrame operations. A page's links to other hosts become weighted host edges. Hosts whose pages
the rules mostly allow are trusted seeds, hosts whose pages they mostly block are distrusted ones. Personalised
PageRank carries trust forward along the edges from the first and distrust backward from the second, and a
host whose distrust outweighs its trust is blocked. Only the proportion of the two counts, so a seed's number of
links does not matter. Pages without a rule get their host's verdict.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadenz.llm.staging import stage

#: (verdict, host, path): the rules of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Share of a host's rank that moves on; the largest change of a rank, relative to it, at which rounds end; and by
#: which share distrust must exceed trust, so that sums in another order do not decide.
DAMPING, TOLERANCE, MARGIN = 0.85, 1e-4, 1e-3
#: The SQL twin only: its written-out rounds, and distrust that it takes for none. It is right on small graphs.
ROUNDS, LEAST = 10, 0.001
#: Hosts of absolute links; relative ones stay on their host and give no edge.
LINK = r"""(?i)[\s"'/]href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
#: What goes before links are read: comments, and character references for the two signs that a link's host stands behind.
CLEARED = ((r"(?s)<!--.*?(?:-->|\z)", " "), (r"(?i)&(?:#0*58|#x0*3a|colon);", ":"), (r"(?i)&(?:#0*47|#x0*2f|sol);", "/"))


def _low(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty without ://."""
    return _low(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def matching_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the columns host and path, as text and as verdict; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, w) from the column host and the page's links; w: links. Counts meet per task before the shuffle.

    A link is an href of its own, not data-href, and not one in a comment.
    """
    text = reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), CLEARED, F.coalesce(html_col, F.lit("")))
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(text, F.lit(LINK), 1)).alias("dst"))
    links = links.withColumn("dst", _low(F.col("dst"))).where("src <> '' AND dst <> '' AND src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, s). Hosts without links keep nothing to pass on.

    Ranks only grow. Once no rank grows by more than `tolerance` of itself, no later round does either, since a
    host's growth comes from its sources' growth of the round before. A host that is reached first grows by all
    of its rank, so rounds go on until every host within reach has been reached, at any distance.
    """
    share = edges.join(edges.groupBy("src").agg(F.sum("w").alias("total")), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))
    share = stage(share, "edge-shares")
    base = stage(seeds.select("host", ((1 - damping) * F.col("s")).alias("rank"), F.lit(0.0).alias("was")), "seeds")
    rank, change, k = base, 1.0, 0
    while change > tolerance and not share.isEmpty():
        moved = share.join(rank.select(F.col("host").alias("src"), "rank"), "src").select(F.col("dst").alias("host"), (damping * F.col("p") * F.col("rank")).alias("rank"), F.lit(0.0).alias("was"))
        before = rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))
        rank = stage(moved.unionByName(base).unionByName(before).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")), f"rank-{k}")
        change, k = rank.agg(F.max(F.try_divide(F.col("rank") - F.col("was"), F.col("rank")))).first()[0] or 0.0, k + 1
    return rank.select("host", "rank")


def host_verdicts(judged: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust, host_verdict) of hosts that are seeds or reached from them."""
    count = lambda v: F.count(F.when(F.col("ruled") == v, 1))
    known = stage(judged.where("host <> ''").groupBy("host").agg(count("allow").alias("a"), count("block").alias("b")), "hosts")
    edges = stage(edges, "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    trust = propagate(edges, known.where("a > b").select("host", F.lit(1.0).alias("s"))).withColumnRenamed("rank", "trust")
    distrust = propagate(back, known.where("b > a").select("host", F.lit(1.0).alias("s"))).withColumnRenamed("rank", "distrust")
    both = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    blocked = F.col("distrust") > (1 + MARGIN) * F.col("trust")
    return both.withColumn("host_verdict", F.when(blocked, "block").otherwise("allow"))


def url_filter(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES, columns: list[str] | None = None) -> DataFrame:
    """Adds host, path, rule and verdict to every page; rule is null where none fits.

    columns: input columns to return (all but the html, if not given); those named like a result are replaced.
    A null url, or one without ://, has an empty host and path, no rule, and is allowed; so is a host that
    no trust or distrust reaches. Null html has no links. Rows may repeat; an empty table gives an empty result.
    """
    new = ["host", "path", "rule", "verdict"]
    keep = [c for c in columns or pages.columns if c not in (*new, html_col)]
    text, verdict = matching_rule(rules)
    judged = pages.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    judged = judged.select("*", text.alias("rule"), verdict.alias("ruled"))
    edges = host_edges(pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")))
    hosts = stage(host_verdicts(judged, edges).where("host_verdict = 'block'").select(F.col("host").alias("__host")), "blocked-hosts")
    out = judged.join(hosts, judged.host == hosts["__host"], "left")
    final = F.coalesce("ruled", F.when(F.col("__host").isNotNull(), "block").otherwise("allow"))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", final.alias("verdict"))


def oracle(rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, with the rounds written out: hosts up to `rounds` links from a seed, distrust above LEAST."""
    low = lambda c: f"translate({c}, '{ascii_uppercase}', '{ascii_lowercase}')"
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    link = LINK.replace("'", "''")
    text = reduce(lambda c, p: f"regexp_replace({c}, '{p[0]}', '{p[1]}', 'g')", CLEARED, "coalesce(html, '')")
    steps = []
    for name, seed, a, b in (("t", "a > b", "src", "dst"), ("d", "b > a", "dst", "src")):
        steps.append(f"{name}p AS (SELECT {a} AS s, {b} AS d, w / sum(w) OVER (PARTITION BY {a}) AS p FROM e)")
        steps.append(f"{name}0 AS (SELECT host, {1 - damping}::DOUBLE AS r FROM k WHERE {seed})")
        for i in range(rounds):
            steps.append(f"{name}{i + 1} AS (SELECT host, sum(r) AS r FROM (SELECT d AS host, {damping} * p * r AS r FROM {name}p JOIN {name}{i} ON host = s UNION ALL SELECT * FROM {name}0) GROUP BY host)")
    plus = reduce(lambda x, y: f"{x}, {y}", steps)
    return f"""
        WITH u AS (SELECT page_id, html, {low("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        j AS (SELECT *, {case(1)} AS rule, {case(2)} AS ruled FROM u),
        l AS (SELECT host AS src, {low("unnest(regexp_extract_all(" + text + ", '" + link + "', 1))")} AS dst FROM u),
        e AS (SELECT src, dst, count(*)::DOUBLE AS w FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
        k AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
        {plus},
        v AS (SELECT d.host FROM d{rounds} d LEFT JOIN t{rounds} t USING (host) WHERE d.r > {LEAST} AND d.r > coalesce(t.r, 0))
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM v) THEN 'block' ELSE 'allow' END) AS verdict FROM j
    """

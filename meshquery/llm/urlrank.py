"""Operator 6, URL judgement by rules and by trust over the link graph. DataFrame functions only.

Rules (host, path prefix, action) decide where one fits; the longest wins. Elsewhere the host decides: pages that
rules allow or block make their hosts trusted or blocked seeds, personalised PageRank spreads trust along the host
links and distrust against them, and a host is blocked where distrust exceeds trust by more than a threshold. Both are
shares of a whole: mass at hosts without further links goes back to the seeds, which only scales the ranks.

Rounds go on until all further rounds together could move less than ``TOLERANCE``: a round moves at most ``DAMPING`` times
what the one before moved, and ranks only grow, so one sum bounds the rest.

Plan: pages become (host, path) and counted host links in one scan; everything iterative is on host rows and host
links only. Rules meet hosts through the hosts' domain suffixes (an equi-join), once per host and not per page.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed unless its
(empty) host is a seed, which it can't be; null html has no links; repeated rows and null page_id are kept; an empty
table gives no rows; further columns are ignored. A host without links or seeds is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Rounds between two tables in the shared folder.
CHAINED = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-9, 0.0
#: Blanks are taken possessively, so that a page of blanks is read once.
LINK = r"""(?i)<a\s[^<>]*?href\s*+=\s*+["']?+\s*+(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, fits): for every host the rules of its domain suffixes, longest first. ``rules`` is the caller's list."""
    named = lambda h, p, a: F.struct(F.lit(h).alias("suffix"), F.lit(p).alias("prefix"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"))
    listed = hosts.sparkSession.range(1).select(F.inline(F.array(*[named(*r) for r in rules])))
    dots = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit("")))
    lengths = sorted({suffix.count(".") + 1 for suffix, _, _ in rules})  # no other suffixes can be a rule's
    suffixes = F.array_compact(F.array(*[F.when(dots >= k - 1, F.substring_index("host", ".", -k)) for k in lengths]))
    fitting = hosts.select("host", F.explode(suffixes).alias("suffix")).join(listed, "suffix")
    longest = F.struct((-F.length("rule")).alias("order"), "prefix", "rule", "action")
    return fitting.groupBy("host").agg(F.sort_array(F.collect_list(longest)).alias("fits"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust), each adding up to one, by personalised PageRank from (host, good, bad) over (src, dst, n)."""
    start = seeds.select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust"))
    state = saved(start, "trust")
    if not links.isEmpty():
        out, into = (links.groupBy(side).agg(F.sum("n").alias(f"{side}_n")) for side in ("src", "dst"))
        edges = saved(links.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("src_n")).alias("forth"), (F.col("n") / F.col("dst_n")).alias("back")), "links")
        zero = F.lit(0.0)
        placed, moved = sum(_mass(state)), None
        while moved is None or moved * damping / (1 - damping) >= tolerance:
            for _ in range(CHAINED):
                forth = edges.join(state, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth") * damping).alias("trust"), zero.alias("distrust"))
                back = edges.join(state, F.col("dst") == F.col("host")).select(F.col("src").alias("host"), zero.alias("trust"), (F.col("distrust") * F.col("back") * damping).alias("distrust"))
                state = forth.unionByName(back).unionByName(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
            state = saved(state, "trust")
            placed, moved = (now := sum(_mass(state))), now - placed
    trust, distrust = (x or 1.0 for x in _mass(state))
    return state.select("host", (F.col("trust") / F.lit(trust)).alias("trust"), (F.col("distrust") / F.lit(distrust)).alias("distrust"))


def _mass(state: DataFrame) -> tuple[float, float]:
    return tuple(x or 0.0 for x in state.agg(F.sum("trust"), F.sum("distrust")).first())


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page."""
    url = F.col("url").cast("string")
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    seen = saved(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), found.alias("to")), "pages")
    links = seen.select(F.col("host").alias("src"), F.explode("to").alias("dst")).where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    links = saved(links, "host-links")
    hosts = seen.where("host <> ''").select("host").distinct()
    ruled = saved(host_rules(hosts, rules), "host-rules")
    fitting = F.filter("fits", lambda r: F.startswith(F.col("path"), r["prefix"]))
    judged = seen.drop("to").join(ruled, "host", "left").withColumn("fit", F.get(fitting, 0)).drop("fits")
    counts = judged.where("fit is not null").groupBy("host").agg(F.count_if(F.col("fit.action") == "allow").alias("good"), F.count_if(F.col("fit.action") == "block").alias("bad"))
    counts = saved(counts, "seeds")
    all_good, all_bad = (float(x or 0) or 1.0 for x in counts.agg(F.sum("good"), F.sum("bad")).first())
    seeds = counts.select("host", (F.col("good") / F.lit(all_good)).alias("good"), (F.col("bad") / F.lit(all_bad)).alias("bad"))
    scores = propagate(seeds, links, damping, tolerance)
    zero = F.lit(0.0)
    both = judged.join(scores, "host", "left").withColumn("trust", F.coalesce("trust", zero)).withColumn("distrust", F.coalesce("distrust", zero))
    own = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.action"), own).alias("verdict"), "trust", "distrust")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH RECURSIVE rules(suffix, prefix, action) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (
  SELECT row_number() OVER () AS n, page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fit AS (
  SELECT n, arg_max(suffix || prefix, length(suffix || prefix)) AS rule, arg_max(action, length(suffix || prefix)) AS action
  FROM p JOIN rules ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, prefix) GROUP BY n),
seed AS (
  SELECT host, count(*) FILTER (action = 'allow') AS good, count(*) FILTER (action = 'block') AS bad FROM p JOIN fit USING (n) GROUP BY host),
seeds AS (
  SELECT host, good / greatest((SELECT sum(good) FROM seed), 1)::DOUBLE * 0.15 AS good, bad / greatest((SELECT sum(bad) FROM seed), 1)::DOUBLE * 0.15 AS bad FROM seed),
hrefs AS (
  SELECT DISTINCT n, host AS src, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM (SELECT n, host, unnest(regexp_extract_all(html, '(?i)<a\s[^<>]*?href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)) AS u FROM p)),
links AS (SELECT src, dst, count(*) AS n FROM hrefs WHERE src <> dst AND src <> '' GROUP BY src, dst),
edges AS (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM links),
walk(turn, host, trust, distrust) AS (
  SELECT 0, host, good::DOUBLE, bad::DOUBLE FROM seeds
  UNION ALL
  SELECT turn, host, sum(trust)::DOUBLE, sum(distrust)::DOUBLE FROM (
    SELECT turn + 1 AS turn, dst AS host, trust * forth * 0.85 AS trust, 0.0 AS distrust FROM walk JOIN edges ON src = host WHERE turn < 130
    UNION ALL SELECT turn + 1, src, 0.0, distrust * back * 0.85 FROM walk JOIN edges ON dst = host WHERE turn < 130
    UNION ALL SELECT t.turn + 1, s.host, s.good, s.bad FROM seeds s, (SELECT DISTINCT turn FROM walk WHERE turn < 130) t)
  GROUP BY turn, host),
scores AS (
  SELECT host, trust / coalesce(nullif(sum(trust) OVER (), 0), 1) AS trust, distrust / coalesce(nullif(sum(distrust) OVER (), 0), 1) AS distrust FROM walk WHERE turn = 130)
SELECT page_id, p.host, path, rule, coalesce(action, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (n) LEFT JOIN scores ON p.host = scores.host
"""

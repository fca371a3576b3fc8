"""URL filters: rules where they fit, trust along the link graph elsewhere.

A rule is a host and a path prefix; it fits its host and all subdomains; of the
rules that fit, the longest decides.  Where none fits, the host's standing does:
trust starts on hosts with allowed pages and flows along links between hosts;
distrust starts on hosts with blocked pages and flows against them.  Both are
personalised PageRanks with one common scale (pages with a verdict), so that
they compare; a host whose share of distrust exceeds ``MAX_DISTRUST`` is blocked.
What flows to a host without links (for distrust: without links to it) returns
to the seeds in proportion.  Rounds end when the scores of all hosts together
change by less than ``TOLERANCE`` of the seeds; every round shrinks that by
``DAMPING`` at least, so they always end.

Links are absolute and protocol-relative URLs in href and src attributes, in
either case; equal edges are summed before anything is shuffled by host, hot
hosts are dealt over many tasks, and each round is written to the shared
folder.  A null url, or one without
``://``, has an empty host and path, fits no rule, and is allowed; null html has no
links.  Rows are judged each for itself.  Only page_id, url and html are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import spread_join

#: Rules of the query: verdict, rule.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Rules are one literal of the plan, so their number is bounded.
MAX_RULES = 5000
DAMPING, TOLERANCE, MAX_DISTRUST = 0.85, 1e-3, 0.8
#: Rounds of the SQL, which has no loop; the given pages hold no link between hosts, so there it needs none.
SQL_ROUNDS = 10
LINK = r"""(?:[Hh][Rr][Ee][Ff]|[Ss][Rr][Cc])\x20*=\x20*["']?((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^"'<>\x20]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end; A-Z lower-cased; empty without one."""
    return common.lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def link_host(link: Column) -> Column:
    """The host of a link, with or without its scheme."""
    return host_of(F.when(F.startswith(link, F.lit("//")), F.concat(F.lit(":"), link)).otherwise(link))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules exceed {MAX_RULES}")
    table = [{"rule": r, "verdict": v, "host": r.split("/", 1)[0], "path": "/" + r.split("/", 1)[1]} for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1]))]
    known = F.from_json(F.lit(json.dumps(table)), "array<struct<rule:string,verdict:string,host:string,path:string>>")
    fit = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(fit, F.lit(0))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    links = pages.where(F.contains("html", F.lit("//"))).select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("l"))
    edges = links.select("src", link_host(F.col("l")).alias("dst")).where("src <> dst AND src <> '' AND dst <> ''")
    return edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, score: personalised PageRank of ``seeds`` (host, seed) over ``edges`` (src, dst, n).

    A round's lost mass and its change are the only numbers that come to the driver.
    """
    spark = seeds.sparkSession
    out = edges.groupBy("src").agg(F.sum("n").alias("all"), F.count("*").alias("w"))
    weighted = spread_join(edges, out, "src", ["dst"], "w", edges.count()).select("src", "dst", (F.col("n") / F.col("all")).alias("share"))
    weighted = common.materialise(spark, weighted)
    degree = common.materialise(spark, weighted.groupBy("src").agg(F.count("*").alias("w")))
    total, links = seeds.agg(F.sum("seed")).first()[0] or 0.0, weighted.count()
    begin = seeds.select("host", F.col("seed").alias("score"), F.lit(0.0).alias("was"))
    while True:
        # with the links of each host, so that one look gives the mass that no link carries on, and the change
        held = begin.groupBy("host").agg(F.sum("score").alias("score"), F.sum("was").alias("was")).join(degree.withColumnRenamed("src", "host"), "host", "left")
        now = common.materialise(spark, held)
        lost, change = now.agg(F.sum(F.when(F.col("w").isNull(), F.col("score"))), F.sum(F.abs(F.col("score") - F.col("was")))).first()
        if (change or 0.0) <= tolerance * total:
            return now.select("host", "score").where("score > 0")
        scores = now.where("w IS NOT NULL").select(F.col("host").alias("src"), "score", "w")
        moved = spread_join(weighted, scores, "src", ["dst"], "w", links).select(F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        back = (1 - damping) + damping * (lost or 0.0) / total
        base = seeds.select("host", (F.lit(back) * F.col("seed")).alias("score"))
        begin = base.union(moved).withColumn("was", F.lit(0.0)).union(now.select("host", F.lit(0.0), "score"))


def host_standing(judged: DataFrame, edges: DataFrame) -> DataFrame:
    """host, trust, distrust from pages with verdicts (host, verdict) and edges."""
    spark = judged.sparkSession
    counts = common.materialise(spark, judged.where("verdict IS NOT NULL AND host <> ''").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")))
    total = counts.agg(F.sum(F.col("a") + F.col("b"))).first()[0] or 1
    edges = common.materialise(spark, edges)
    trust = counts.where("a > 0").select("host", (F.col("a") / total).alias("seed"))
    distrust = counts.where("b > 0").select("host", (F.col("b") / total).alias("seed"))
    if edges.isEmpty():
        trust, distrust = (x.withColumnRenamed("seed", "score") for x in (trust, distrust))  # all returns to the seeds
    else:
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        trust, distrust = propagate(trust, edges), propagate(distrust, back)
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
    return both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, max_distrust: float = MAX_DISTRUST) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    standing = host_standing(rows, host_edges(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))))
    bad = standing.where(F.col("distrust") > max_distrust * (F.col("trust") + F.col("distrust"))).select(F.col("host").alias("bad_host"))
    joined = rows.join(bad, F.col("host") == F.col("bad_host"), "left")
    by_host = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge(common.table(spark, sf_dir, "pages"))


def _sql() -> str:
    values = ", ".join(f"('{r}', '{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)
    rounds = range(SQL_ROUNDS)
    lower = lambda x: f"translate(coalesce({x}, ''), '{common.UPPER}', '{common.LOWER}')"
    link = LINK.replace("'", "''")
    parts = [
        f"rules(rule, verdict, rhost, rpath) AS (VALUES {values})",
        f"p AS (SELECT row_number() OVER () AS k, page_id, html, {lower("regexp_extract(url, '://([^/?#]*)', 1)")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        "f AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)",
        "j AS (SELECT p.*, rule, verdict FROM p LEFT JOIN f USING (k))",
        f"l AS (SELECT host AS src, {lower("regexp_extract(CASE WHEN starts_with(x, '//') THEN ':' || x ELSE x END, '://([^/?#]*)', 1)")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS x FROM p))",
        "e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL)",
        "c AS (SELECT host, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM j WHERE verdict IS NOT NULL AND host <> '' GROUP BY host)",
        "tot AS (SELECT sum(a + b) AS n FROM c)",
        "wt AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM e)",
        "wd AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS w FROM e)",
    ]
    for name, col in (("t", "a"), ("d", "b")):
        parts.append(f"{name}0 AS (SELECT host, 1.0 * {col} / tot.n AS score FROM c, tot WHERE {col} > 0)")
        for i in rounds:
            parts.append(f"{name}{i + 1} AS (SELECT host, sum(score) AS score FROM (SELECT host, ({1 - DAMPING} + {DAMPING} * (SELECT coalesce(sum(score), 0) FROM {name}{i} WHERE host NOT IN (SELECT src FROM w{name})) / (SELECT sum(score) FROM {name}0)) * score AS score FROM {name}0 UNION ALL SELECT dst, {DAMPING} * score * w FROM {name}{i} JOIN w{name} ON host = src) GROUP BY host)")
    last = SQL_ROUNDS
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN coalesce(d{last}.score, 0) > {MAX_DISTRUST} * (coalesce(t{last}.score, 0) + coalesce(d{last}.score, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN t{last} ON j.host = t{last}.host LEFT JOIN d{last} ON j.host = d{last}.host"""
    )


OP10_SQL = _sql()

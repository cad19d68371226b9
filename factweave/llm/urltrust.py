"""URL filters: host and path rules, and trust and distrust that spread over the links between hosts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import stash, text_of

#: The rules of the production query: verdict, then host and path in one.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A link that may lead to another host; one without ``//`` stays on its own.
LINK = r"""(?i)[ \t\r\n\f]href[ \t\r\n\f]*=[ \t\r\n\f]*["']?((?:https?:)?//[^"' \t\r\n\f>]+)"""
#: Masses are multiples of this, so that their sums are exact and the same in any order.
QUANTUM = 1 << 40

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ordered(rules: Iterable[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """``(verdict, rule, host, path)``, the longest rule first; of equally long ones the longer host, then ``block``, then by text."""
    split = [(verdict, rule, *rule.partition("/")[::2]) for verdict, rule in rules]
    found = [(verdict, rule, host.translate(str.maketrans(_UPPER, _LOWER)), f"/{path}") for verdict, rule, host, path in split]
    return sorted(found, key=lambda r: (-len(r[1]), -len(r[2]), r[0] != "block", r[1]))


def _first_that_fits(rules: list[tuple[str, str, str, str]], host: Column, path: Column, value: int) -> Column:
    fits = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for _, _, h, p in rules]
    cases = [F.when(fit, F.lit(rule[value])) for fit, rule in zip(fits, rules, strict=True)]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(src, dst, n)`` of ``pages(host, html)``: how often pages of one host link to another one."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(text_of(html_col), F.lit(LINK), F.lit(1))).alias("link"))
    target = F.translate(F.regexp_extract("link", "//([^/?#]*)", 1), _UPPER, _LOWER)
    found = found.select("src", target.alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _exact(mass: Column) -> Column:
    return F.floor(mass * float(QUANTUM)) / float(QUANTUM)


def spread(seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """``(host, trust, distrust)``: personalised PageRank of both seed vectors, distrust along reversed links.

    ``seeds(host, trust, distrust)`` are restart masses and ``links(src, dst, n)`` weighted edges. A
    rank is the sum of waves: the first is the restart share of the seeds, and each next one is what
    the last passes on along the edges, damped and split by weight. Only hosts that a wave reaches
    take part in a round. Masses are cut to multiples of ``1 / QUANTUM``, so sums don't depend on
    order, a wave ends by itself, and what is cut off is below ``damping ** rounds``. Hosts that are
    no one's seed and reached by no wave have no row. Each round joins plain scans, so adaptive
    execution may split a host with very many links, and sums are combined before they are shuffled.
    """
    links = stash(links)
    ways = [(0, "trust", "src", "dst"), (1, "distrust", "dst", "src")]
    edges, first = [], []
    for kind, name, a, b in ways:
        out = links.groupBy(a).agg(F.sum("n").alias("out"))
        edge = links.join(stash(out).hint("merge"), a).select(F.lit(kind).alias("kind"), F.col(a).alias("at"), F.col(b).alias("to"), "n", "out")
        edges.append(edge)
        first.append(seeds.filter(F.col(name) > 0).select(F.lit(kind).alias("kind"), "host", _exact(F.col(name) * (1 - damping)).alias("mass")))
    edges = stash(reduce(DataFrame.unionByName, edges))
    wave = stash(reduce(DataFrame.unionByName, first).filter("mass > 0"))
    waves = [wave]
    left = 0 if edges.isEmpty() else rounds
    while left and not wave.isEmpty():
        passed = wave.withColumnRenamed("host", "at").join(edges.hint("merge"), ["kind", "at"])
        part = _exact(F.lit(damping) * F.col("mass") * F.col("n") / F.col("out"))
        wave = stash(passed.select("kind", F.col("to").alias("host"), part.alias("part")).filter("part > 0").groupBy("kind", "host").agg(F.sum("part").alias("mass")))
        waves.append(wave)
        left -= 1
    mass = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0))
    return reduce(DataFrame.unionByName, waves).groupBy("host").agg(mass(0).alias("trust"), mass(1).alias("distrust"))


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, threshold: float = 0.5, least: float = 0.05, damping: float = 0.85, rounds: int = 30, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(id, host, path, rule, verdict, trust, distrust)``, one row per page.

    A rule ``host/path`` fits its host and all subdomains where the url's path starts with its path;
    the longest one gives ``rule`` and ``verdict`` (see ``_ordered`` for ties). A page that no rule
    fits takes its host's verdict: ``block`` where distrust is over ``threshold`` of trust and
    distrust together and over ``least`` of what a blocked seed starts with on average, else ``allow``. Seeds are the hosts of pages that a rule allows (trust) or blocks (distrust),
    each as heavy as its share of all such pages; ``spread`` carries trust along the links in the pages'
    HTML and distrust against them. A null url or one without ``://`` has an empty host and path, is
    no seed, sends no links and is allowed; null or empty HTML has no links. Rows that repeat an id
    or a url each get a row and count as pages of their own; an empty table gives no rows; other
    columns are ignored. The rules stand in the plan, so they are meant as a policy list of at most some hundreds.
    """
    ordered = _ordered(rules)
    url = text_of(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).alias("html"))
    rule, verdict = (_first_that_fits(ordered, F.col("host"), F.col("path"), k) for k in (1, 0))
    ruled = rows.drop("html").withColumns({"rule": rule, "verdict": verdict})
    named = ruled.filter("host <> '' and verdict is not null").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    named = stash(named)
    both, bad, n_bad = named.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum(F.col("a") + F.col("b")), F.sum("b"), F.count_if(F.col("b") > 0)))).first()
    total = max(1, both)
    floor = least * (1 - damping) * (bad / total) / max(1, n_bad)
    seeds = named.select("host", (F.col("a") / F.lit(total)).alias("trust"), (F.col("b") / F.lit(total)).alias("distrust"))
    scores = stash(spread(seeds, host_links(rows), damping, rounds))
    out = ruled.join(scores, "host", "left")
    blocked = (F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") > F.lit(floor))
    by_host = F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), zero("trust"), zero("distrust"))


def sql(rules: Iterable[tuple[str, str]] = RULES, threshold: float = 0.5, least: float = 0.05, damping: float = 0.85, rounds: int = 30) -> str:
    """``judge_urls`` over ``pages`` as DuckDB SQL."""
    ordered = _ordered(rules)
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, _, h, p in ordered]
    case = lambda k: "CASE " + " ".join(f"{fit}'{rule[k]}'" for fit, rule in zip(fits, ordered, strict=True)) + " END"
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    quoted = LINK.replace("'", "''")
    q = f"{QUANTUM}::DOUBLE"
    return f"""WITH RECURSIVE rows_ AS (
  SELECT page_id, {lower("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
 ruled AS (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS verdict FROM rows_),
 named AS (SELECT host, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM ruled WHERE host <> '' AND verdict IS NOT NULL GROUP BY host),
 total AS (SELECT greatest(1, coalesce(sum(a + b), 0))::BIGINT AS t, coalesce(sum(b), 0)::BIGINT AS bad, greatest(1, count(*) FILTER (b > 0)) AS n_bad FROM named),
 found AS (SELECT host AS src, {lower("regexp_extract(link, '//([^/?#]*)', 1)")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{quoted}', 1)) AS link FROM rows_)),
 links AS (SELECT src, dst, count(*) AS n FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
 edges AS (SELECT 0 AS kind, src AS at_, dst AS to_, n, sum(n) OVER (PARTITION BY src)::BIGINT AS out_ FROM links UNION ALL SELECT 1, dst, src, n, sum(n) OVER (PARTITION BY dst)::BIGINT FROM links),
 seeds AS (SELECT 0 AS kind, host, floor((a / t) * {1 - damping!r}::DOUBLE * {q}) / {q} AS mass FROM named, total WHERE a > 0 UNION ALL SELECT 1, host, floor((b / t) * {1 - damping!r}::DOUBLE * {q}) / {q} FROM named, total WHERE b > 0),
 wave AS (SELECT 0 AS k, kind, host, mass FROM seeds WHERE mass > 0
  UNION ALL SELECT k, kind, host, sum(part) FROM (SELECT w.k + 1 AS k, w.kind, e.to_ AS host, floor({damping!r}::DOUBLE * w.mass * e.n / e.out_ * {q}) / {q} AS part FROM wave w JOIN edges e ON w.kind = e.kind AND w.host = e.at_ WHERE w.k < {rounds}) WHERE part > 0 GROUP BY k, kind, host),
 scores AS (SELECT host, coalesce(sum(mass) FILTER (kind = 0), 0) AS trust, coalesce(sum(mass) FILTER (kind = 1), 0) AS distrust FROM wave GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(verdict, CASE WHEN s.distrust > {threshold!r}::DOUBLE * (s.trust + s.distrust) AND s.distrust > {least * (1 - damping)!r}::DOUBLE * (bad / t) / n_bad THEN 'block' ELSE 'allow' END) AS verdict, coalesce(s.trust, 0::DOUBLE) AS trust, coalesce(s.distrust, 0::DOUBLE) AS distrust
FROM ruled r CROSS JOIN total LEFT JOIN scores s ON r.host = s.host"""

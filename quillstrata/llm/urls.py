"""URL filters: host and path rules, and a path-template tree judged by smoothed labelled purity.

Rules come first: a rule fits its host and all subdomains if the path starts with the rule's path; the longest wins.
What rules say of a page is also its label, and a caller may add labels of its own. Everything else is judged by a tree:

- each host is a root, each path segment a level (LEVELS of them; deeper ones share one tail branch);
- a segment that is a number, a hex string, a UUID or a date becomes the wildcard `*`, and so do all segments below a
  node with more than FAN distinct ones that mostly occur once;
- of a node's other branches, those with at least EVIDENCE labels whose share of bad labels does not differ from the
  share of all of them by more than Z standard errors are merged into one branch, `+`;
- a template (host and branches) is rejected if its smoothed purity, (bad + PRIOR_BAD) / (labelled + PRIOR_ALL), is at
  least PURITY. Without labels the purity is the prior, which allows.

Null url, or one without `://`, has an empty host and path, and is a template of its own. Repeated rows count as often
as they occur. An empty table gives an empty result. DataFrame functions only; a node's statistics are partial
aggregates, so a hot host is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import cut

# Fixed values: (host, start of path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

LEVELS = 4
FAN, ONCE = 20, 3
EVIDENCE, Z = 5, 1.64
PRIOR_BAD, PRIOR_ALL, PURITY = 1.0, 4.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^([0-9]+|[0-9]+\.[a-z]+|[0-9a-f]{16,}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def templates(pages: DataFrame) -> DataFrame:
    """pages (host, path, bad: 1.0, 0.0 or null, ...) with template."""
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    rows = pages.withColumn("__qs_seg", segments).withColumn("template", F.lit(""))
    for level in range(LEVELS):
        own = F.when(F.size("__qs_seg") > level, F.get("__qs_seg", F.lit(level)))
        own = F.when(own.rlike(VARIABLE), F.lit("*")).otherwise(own)
        rows = rows.withColumn("__qs_own", own)
        branches = rows.where("__qs_own is not null").groupBy("host", "template", "__qs_own").agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.sum("bad").alias("bad"))
        literal, told = F.col("__qs_own") != "*", (F.col("__qs_own") != "*") & (F.col("known") >= EVIDENCE)
        nodes = branches.groupBy("host", "template").agg(
            F.count(F.when(literal, 1)).alias("fan"), F.sum(F.when(literal, F.col("n"))).alias("all"), F.sum(F.when(told, F.col("bad"))).alias("b"), F.sum(F.when(told, F.col("known"))).alias("k")
        )
        share = F.col("b") / F.col("k")
        wide = (F.col("fan") > FAN) & (F.col("all") < ONCE * F.col("fan"))
        alike = (F.col("known") >= EVIDENCE) & (F.abs(F.col("bad") / F.col("known") - share) <= Z * F.sqrt(share * (1 - share) / F.col("known")))
        named = branches.join(nodes, ["host", "template"]).select("host", "template", "__qs_own", F.when(~literal | wide, F.lit("*")).when(alike, F.lit("+")).otherwise(F.col("__qs_own")).alias("__qs_new"))
        joined = rows.join(named, ["host", "template", "__qs_own"], "left")
        rows = joined.withColumn("template", F.when(F.col("__qs_own").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "__qs_new"))).drop("__qs_own", "__qs_new")
    return rows.withColumn("template", F.when(F.size("__qs_seg") > LEVELS, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("__qs_seg")


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, bad: Column | None = None) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, template, purity. bad: labels where no rule fits (1, 0 or null)."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("__qs_url"), (F.lit(None) if bad is None else bad).cast("double").alias("own"))
    host, path = host_and_path(F.col("__qs_url"))
    split = rows.select("page_id", "own", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", rule).withColumn("said", said)
    labelled = cut(ruled.withColumn("bad", F.coalesce((F.col("said") == "block").cast("double"), "own")))
    placed = cut(templates(labelled.select("page_id", "host", "path", "rule", "said", "bad")))
    judged = placed.groupBy("host", "template").agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + PRIOR_BAD) / (F.count("bad") + PRIOR_ALL)).alias("purity"))
    out = placed.join(judged, ["host", "template"])
    verdict = F.coalesce("said", F.when(F.col("purity") >= PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def _level_sql(k: int) -> str:
    return f"""
own{k} AS (
    SELECT *, CASE WHEN regexp_matches(seg[{k + 1}], '{VARIABLE}') THEN '*' ELSE seg[{k + 1}] END AS own FROM level{k}
),
branch{k} AS (
    SELECT host, template, own, count(*) AS n, count(bad) AS known, sum(bad) AS bad FROM own{k} WHERE own IS NOT NULL GROUP BY ALL
),
node{k} AS (
    SELECT host, template, count(*) FILTER (own <> '*') AS fan, sum(n) FILTER (own <> '*') AS pages,
        sum(bad) FILTER (own <> '*' AND known >= {EVIDENCE}) AS b, sum(known) FILTER (own <> '*' AND known >= {EVIDENCE}) AS k
    FROM branch{k} GROUP BY ALL
),
named{k} AS (
    SELECT host, template, own, CASE WHEN own = '*' OR (fan > {FAN} AND pages < {ONCE} * fan) THEN '*'
        WHEN known >= {EVIDENCE} AND abs(bad / known - b / k) <= {Z} * sqrt(b / k * (1 - b / k) / known) THEN '+' ELSE own END AS new
    FROM branch{k} JOIN node{k} USING (host, template)
),
level{k + 1} AS (
    SELECT own{k}.* EXCLUDE (template, own), CASE WHEN own IS NULL THEN template ELSE template || '/' || new END AS template
    FROM own{k} LEFT JOIN named{k} USING (host, template, own)
),"""


def _rule_sql() -> str:
    fits = [(h, p, said, f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')") for h, p, said in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))]
    name = " ".join(f"WHEN {f} THEN '{h}{p}'" for h, p, _, f in fits)
    said = " ".join(f"WHEN {f} THEN '{s}'" for _, _, s, f in fits)
    return f"CASE {name} END AS rule, CASE {said} END AS said"


URL_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (
    SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest
),
ruled AS (SELECT *, {_rule_sql()} FROM split),
level0 AS (
    SELECT *, CASE said WHEN 'block' THEN 1.0::DOUBLE WHEN 'allow' THEN 0.0::DOUBLE END AS bad,
        list_filter(string_split(path, '/'), lambda s: s <> '') AS seg, '' AS template FROM ruled
),{"".join(map(_level_sql, range(LEVELS)))}
placed AS (SELECT * EXCLUDE (template), template || CASE WHEN len(seg) > {LEVELS} THEN '/**' ELSE '' END AS template FROM level{LEVELS}),
judged AS (
    SELECT host, template, (coalesce(sum(bad), 0) + {PRIOR_BAD}) / (count(bad) + {PRIOR_ALL}) AS purity FROM placed GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
    template, round(purity, 6)::DOUBLE AS purity
FROM placed JOIN judged USING (host, template)
"""

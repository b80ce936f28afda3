"""URL filters with redirect equivalence.

Explicit rules (a host and its subdomains, a path prefix) decide first; the
longest fitting rule wins, an allow before a block of the same length. URLs
without a rule take part in connected components over redirect and
canonical-link edges: one blocked URL in a component blocks its aliases, except
those that a rule allows. What neither reaches is allowed.

A URL is one node with those that differ from it in the case of scheme and host
or in the fragment. Targets are read from the tags of the page, not from
comments, scripts or other attributes, and resolved by RFC 3986 against the
page's URL or its base element; one that cannot be resolved links nothing.

Cases: a null URL or one without ``://`` has empty host and path, fits no rule
and is allowed; repeated rows each get a verdict; an empty table or no edges
give the rules' verdicts alone; extra input columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._tables import bound_batches, table
from codeloom.llm.html import ATTRIBUTE, RAW, TOKEN
from codeloom.operators.components import connected_components
from codeloom.plans.shared import materialize
from codeloom.plans.skew import salted_lookup

#: The production rules: (rule, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: A rule table of at most this many rows is broadcast; a larger one is joined with salts.
BROADCAST_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)"))


def with_host_path(rows: DataFrame, url: str) -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty without a ``://``."""
    rest = rows.withColumn("__u", F.col(url)).withColumn("__r", F.coalesce(_after_scheme(F.col("__u")), F.lit("")))
    raw = F.regexp_extract("__r", r"^[^/?#]*", 0)
    after = F.expr(r"substring(__r, length(regexp_extract(__r, '^[^/?#]*', 0)) + 1)")
    return rest.select(*rows.columns, F.translate(raw, UPPER, LOWER).alias("host"), F.regexp_extract(after, r"^[^?#]*", 0).alias("path"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as rows: rule, verdict, rule_host, rule_path."""
    rows = [(r, v, r.partition("/")[0], "/" + r.partition("/")[2]) for r, v in rules]
    return spark.createDataFrame(rows, "rule string, rule_verdict string, rule_host string, rule_path string")


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule per distinct (host, path) of ``urls``.

    A host meets the rules on its own suffixes by equality, so the join never
    compares every URL with every rule.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = urls.select("host", "path").filter("host <> ''").distinct()
    spread = parts.withColumn("rule_host", F.explode(suffixes))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        met = spread.join(F.broadcast(rules), "rule_host")
    else:
        met = salted_lookup(spread, rules.groupBy("rule_host").agg(F.collect_list(F.struct("rule", "rule_verdict", "rule_path")).alias("r")), ["rule_host"], F.struct("host", "path"), "inner")
        met = met.select("host", "path", F.inline("r"))
    rank = F.struct(F.length("rule"), (F.col("rule_verdict") == "allow").cast("int"), F.col("rule"))
    fits = met.filter(F.expr("startswith(path, rule_path)"))
    return fits.groupBy("host", "path").agg(F.max_by("rule", rank).alias("rule"), F.max_by("rule_verdict", rank).alias("rule_verdict"))


ORIGIN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"
REFRESH = re.compile(r"url\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"';]\S*))", re.I)


def node_of(url: Column) -> Column:
    """The node of a URL: scheme and host in lower case, without the fragment."""
    origin = F.regexp_extract(url, ORIGIN, 0)
    return F.concat(F.translate(origin, UPPER, LOWER), F.regexp_replace(F.substring(url, F.length(origin) + 1, F.length(url)), "#.*", ""))


def page_links(url: str, page: str) -> list[str]:
    """Nodes that a page names as its canonical URL or sends its readers to."""
    found, base, at = [], url, 0
    while (token := TOKEN.search(page, at)) is not None:
        at, tag = token.end(), (token[2] or "").lower()
        if token[1] or not tag:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        if tag not in ("link", "meta", "base"):
            continue
        given: dict[str, str] = {}
        for name, *values in ATTRIBUTE.findall(token[3] or ""):
            given.setdefault(name.lower(), entities.unescape("".join(values)).strip())
        if tag == "base":
            target = given.get("href", "")
        elif tag == "link":
            target = given.get("href", "") if "canonical" in given.get("rel", "").lower().split() else ""
        else:
            sent = REFRESH.search(given.get("content", "")) if given.get("http-equiv", "").lower() == "refresh" else None
            target = "".join(x or "" for x in sent.groups()).strip() if sent else ""
        if not target:
            continue
        try:
            target = urljoin(base, target).partition("#")[0]
        except ValueError:
            continue
        if tag == "base":
            base = target
        elif origin := re.match(ORIGIN, target):
            # Only A-Z, as in the pages' own URLs.
            found.append(origin[0].translate(str.maketrans(UPPER, LOWER)) + target[origin.end() :])
    return found


def link_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Distinct edges (src, dst) from the node of each page to those of its canonical link and meta refresh.

    Only pages that have either word are read tag by tag.
    """
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for node, own, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for target in page_links(own, page):
                    src.append(node)
                    dst.append(target)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src", "dst"])

    has = F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh"))
    found = pages.filter(F.col(url).isNotNull() & has).select(node_of(F.col(url)).alias("node"), F.col(url).alias("url"), F.col(html).alias("html"))
    return found.mapInArrow(run, "src string, dst string").filter("src <> dst").distinct()


def judge(pages: DataFrame, url: str, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    ``edges`` (src, dst) are URLs that redirect to, or name as canonical, one
    another, as :func:`node_of` has them; both ends are judged by the rules, then
    the components carry the blocks.
    """
    edges = materialize(edges, "url-edges")
    rows = with_host_path(pages, url)
    ends = with_host_path(edges.select(F.explode(F.array("src", "dst")).alias("__url")).distinct(), "__url")
    found = apply_rules(rows.select("host", "path").unionByName(ends.select("host", "path")), rules)
    judged = salted_lookup(rows, found, ["host", "path"], F.col(url))
    if edges.isEmpty():
        judged = judged.withColumn("alias_verdict", F.lit(None).cast("string"))
    else:
        labels = connected_components(edges)
        verdicts = labels.join(ends.join(found, ["host", "path"]).select(F.col("__url").alias("node"), "rule_verdict"), "node")
        blocked = verdicts.filter("rule_verdict = 'block'").select("component").distinct()
        aliases = salted_lookup(labels, blocked, ["component"], F.col("node"), "inner").select(F.col("node").alias("__node"), F.lit("block").alias("alias_verdict"))
        judged = salted_lookup(judged.withColumn("__node", node_of(F.col(url))), aliases, ["__node"], F.monotonically_increasing_id())
    return judged.select(*pages.columns, "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL by the production rules and the pages' own links."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return judge(pages.select("page_id", "url"), "url", link_edges(pages, "url", "html"), rule_table(spark)).drop("url")


#: The rules alone: SQL does not read links out of pages, so it holds for tables whose pages have none, as the given ones.
OP8_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts),
rules(rule, verdict, h, p) AS (VALUES ('com/en/','block','com','/en/'), ('example.com/en/7','allow','example.com','/en/7'),
  ('net/de/','allow','net','/de/'), ('example.net/de/8','block','example.net','/de/8'), ('org/es/','block','org','/es/'))
SELECT page_id, host, path,
  (SELECT rule FROM rules WHERE (hp.host = h OR ends_with(hp.host, '.' || h)) AND starts_with(hp.path, p) ORDER BY length(rule) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules WHERE (hp.host = h OR ends_with(hp.host, '.' || h)) AND starts_with(hp.path, p) ORDER BY length(rule) DESC LIMIT 1), 'allow') AS verdict
FROM hp
"""

"""The catalog's registered queries, each beside its SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import catalog, graph, policy
from codeloom.plans.projection import Catalog, with_tables
from codeloom.plans.shared import materialize

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a :class:`Catalog` under its own name."""

    def keep(f: Callable[[Catalog], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _hot_sql(order: str, lines: int, nesting: int) -> str:
    return (
        with_tables("files", "symbols")
        + f"""SELECT name, kind, path, domain, line_start, line_end, symbols.line_count, nesting_depth, floor(symbols.line_count*(1.0::DOUBLE+nesting_depth*0.3::DOUBLE)+0.5)::BIGINT AS risk_score
FROM symbols JOIN files USING (file_id) WHERE symbols.line_count>={lines} AND nesting_depth>={nesting}
ORDER BY {order}, name, path, line_start, line_end, visibility LIMIT 30"""
    )


def _written_edges(c: Catalog) -> DataFrame:
    """The file edges, written once for a query that reads them more than once: each reading sorts all lines of the orders."""
    return materialize(c.file_edges(), "file-edges")


def _hot(c: Catalog, by: str, **least) -> DataFrame:
    rows = catalog.hotspots(catalog.with_domain(c.symbols(), c.files()), by, **least)
    return rows.select("name", "kind", "path", "domain", "line_start", "line_end", "line_count", "nesting_depth", "risk_score")


@query(_hot_sql("round(symbols.line_count*(1.0::DOUBLE+nesting_depth*0.3::DOUBLE),6) DESC, nesting_depth DESC", 30, 1))
def hotspots_risk(c):
    return _hot(c, "risk")


@query(_hot_sql("symbols.line_count DESC, nesting_depth DESC", 0, 1))
def hotspots_lines(c):
    return _hot(c, "lines", min_lines=0)


@query(_hot_sql("nesting_depth DESC, symbols.line_count DESC", 0, 3))
def hotspots_nesting(c):
    return _hot(c, "nesting", min_lines=0, min_nesting=3)


@query(with_tables("files", "symbols") + "SELECT domain, kind, count(*) AS n, sum(symbols.line_count)::BIGINT AS line_total, max(nesting_depth) AS deepest FROM symbols JOIN files USING (file_id) GROUP BY 1,2")
def symbols_with_domain(c):
    return catalog.with_domain(c.symbols(), c.files()).groupBy("domain", "kind").agg(F.count("*").alias("n"), F.sum("line_count").alias("line_total"), F.max("nesting_depth").alias("deepest"))


@query(
    with_tables("symbols")
    + """SELECT file_id, container, coalesce(string_agg(DISTINCT CASE WHEN kind='method' THEN name END, ',' ORDER BY CASE WHEN kind='method' THEN name END), '') AS methods,
  coalesce(string_agg(DISTINCT CASE WHEN kind='property' THEN name END, ',' ORDER BY CASE WHEN kind='property' THEN name END), '') AS properties, count(*) AS n_members
FROM symbols WHERE container IS NOT NULL GROUP BY 1,2"""
)
def members_of_container(c):
    return catalog.members(c.symbols())


@query(
    with_tables("symbols")
    + """, lines AS (SELECT DISTINCT doc_id AS file_id, unnest([1,25,60,110,180,240]) AS line FROM documents)
SELECT file_id, line, name, line_end-line_start AS span FROM (SELECT *, row_number() OVER (PARTITION BY file_id, line ORDER BY line_end-line_start, line_start, name) AS k FROM lines JOIN symbols USING (file_id) WHERE line BETWEEN line_start AND line_end) WHERE k=1"""
)
def enclosing_symbol(c):
    lines = c.table("documents").select(F.col("doc_id").alias("file_id"), F.explode(F.array(*[F.lit(x) for x in (1, 25, 60, 110, 180, 240)])).alias("line"))
    return catalog.enclosing(lines.distinct(), c.symbols())


@query(with_tables("files", "dependencies") + "SELECT domain, path, line_number, target, is_external FROM dependencies JOIN files ON source_id=file_id")
def dependencies_with_domains(c):
    return c.dependencies().join(c.files(), F.col("source_id") == F.col("file_id")).select("domain", "path", "line_number", "target", "is_external")


@query(with_tables("files", "dependencies") + "SELECT target, line_number, path, domain FROM dependencies LEFT JOIN files ON source_id=file_id WHERE NOT is_external AND contains(lower(target), '/th')")
def like_search(c):
    rows = c.dependencies().filter(~F.col("is_external") & catalog.contains_ignoring_case(F.col("target"), "/TH"))
    return rows.join(c.files(), F.col("source_id") == F.col("file_id"), "left").select("target", "line_number", "path", "domain")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE contains(lower(text), 'version') AND regexp_matches(text, '\\bversion\\b')")
def word_boundary_refs(c):
    return catalog.word_references(c.table("documents").select("doc_id", "text"), F.col("text"), "version").select("doc_id", F.length("text").alias("n"))


@query(
    with_tables("files", "dependencies")
    + """SELECT target, count(*) AS dependents, count(DISTINCT path) AS n_files, count(DISTINCT domain) AS n_domains,
  CASE WHEN count(DISTINCT path)>5 OR count(DISTINCT domain)>2 THEN 'high' WHEN count(DISTINCT path)>=2 OR count(DISTINCT domain)>=2 THEN 'medium' ELSE 'low' END AS risk
FROM dependencies JOIN files ON source_id=file_id GROUP BY 1"""
)
def impact_summary(c):
    return catalog.impact(c.dependencies(), c.files())


@query(
    with_tables("file_edges")
    + """SELECT dst AS file, count(DISTINCT src) AS n_inbound, CASE WHEN count(DISTINCT src)>=5 THEN 'high' WHEN count(DISTINCT src)>=2 THEN 'medium' ELSE 'low' END AS level,
  array_to_string(list_sort(list(DISTINCT src))[1:5], ',') AS consumers FROM file_edges GROUP BY 1"""
)
def file_inbound(c):
    return catalog.inbound(c.file_edges())


@query(
    with_tables("file_edges")
    + """SELECT file, coalesce(array_to_string(list_sort(list(DISTINCT t) FILTER (t IS NOT NULL)), ','), '') AS imports, coalesce(array_to_string(list_sort(list(DISTINCT b) FILTER (b IS NOT NULL)), ','), '') AS imported_by,
  count(DISTINCT t) AS n_imports, count(DISTINCT b) AS n_imported_by
FROM (SELECT src AS file, dst AS t, NULL AS b FROM file_edges UNION ALL SELECT dst, NULL, src FROM file_edges) GROUP BY 1"""
)
def file_connections(c):
    return catalog.connections(c.file_edges())


@query(
    with_tables("files", "symbols")
    + """SELECT domain, path, count(s.name) AS n_symbols, coalesce(string_agg(DISTINCT CASE WHEN NOT (visibility='private' AND kind='property') THEN name END, ',' ORDER BY CASE WHEN NOT (visibility='private' AND kind='property') THEN name END),'') AS shown
FROM files LEFT JOIN symbols s USING (file_id) GROUP BY 1,2"""
)
def catalog_compact(c):
    shown = F.when(~((F.col("visibility") == "private") & (F.col("kind") == "property")), F.col("name"))
    rows = c.files().select("file_id", "domain", "path").join(c.symbols().select("file_id", "name", "kind", "visibility"), "file_id", "left")
    return rows.groupBy("domain", "path").agg(F.count("name").alias("n_symbols"), F.array_join(F.array_sort(F.collect_set(shown)), ",").alias("shown"))


@query(
    with_tables("files")
    + """, paths AS (SELECT CASE WHEN file_id%3=0 THEN split_part(path,'/',1)||'/loose/doc_'||file_id ELSE path END AS path FROM files)
SELECT p.path, (SELECT name FROM domains d WHERE p.path=d.root_path OR starts_with(p.path, d.root_path||'/') ORDER BY length(root_path) DESC, name DESC LIMIT 1) AS owner FROM paths p"""
)
def domain_longest_prefix(c):
    loose = F.when(F.col("file_id") % 3 == 0, F.concat(F.element_at(F.split("path", "/"), 1), F.lit("/loose/doc_"), F.col("file_id").cast("string"))).otherwise(F.col("path"))
    return catalog.longest_prefix(c.files().select(loose.alias("path")), "path", c.domains())


@query(
    with_tables("files")
    + """SELECT path, CASE WHEN contains(lower(path),'controller') THEN 'controller' WHEN ends_with(lower(path),'views.py') OR (contains(lower(path),'views/') AND ends_with(lower(path),'.py')) THEN 'controller'
  WHEN contains(lower(path),'service') THEN 'service' WHEN contains(lower(path),'repo') THEN 'repository' WHEN contains(lower(path),'model') OR contains(lower(path),'entit') THEN 'model'
  WHEN contains(lower(path),'action') THEN 'action' WHEN contains(lower(path),'job') OR contains(lower(path),'queue') THEN 'job' WHEN contains(lower(path),'event') THEN 'event' WHEN contains(lower(path),'listener') THEN 'listener'
  WHEN contains(lower(path),'util') OR contains(lower(path),'helper') THEN 'util' ELSE 'unknown' END AS archetype FROM files"""
)
def archetype(c):
    return c.files().select("path", text.archetype(F.col("path")).alias("archetype"))


PATTERNS = ["europe/**", "asia/*", "**/services/*.py", "asia/nation_8/models/doc_?8.go"]


@query(with_tables("files") + "SELECT path, regexp_matches(path,'^europe/.+') OR regexp_matches(path,'^asia/[^/]*$') OR regexp_matches(lower(path),'^(.*/)?services/[^/]*\\.py$') OR regexp_matches(lower(path),'^asia/nation_8/models/doc_[^/]8\\.go$') AS allowed FROM files")
def glob_touchpoints(c):
    return policy.touchpoints(c.files().select("path"), "path", PATTERNS)


@query(
    with_tables("files")
    + """SELECT path, list_has_any(string_split(path,'/'), ['node_modules','dist','build','out','bin','vendor','tmp','temp','scripts','target']) OR starts_with(path,'asia/nation_8/') OR ends_with(path,'.php') OR list_contains(string_split(path,'/'),'helpers') AS ignored FROM files"""
)
def ignore_filter(c):
    return c.files().select("path", text.is_ignored(F.col("path"), ("asia/nation_8/*", "*.php", "helpers")).alias("ignored"))


@query(with_tables("policy", "domain_edges") + "SELECT src, dst, weight, CASE WHEN forbidden THEN 'forbidden_dependency' ELSE 'disallowed_dependency' END AS rule FROM domain_edges JOIN policy USING (src,dst) WHERE forbidden OR NOT allowed")
def boundary_strict(c):
    return policy.audit(c.domain_edges(), c.policy())


@query(with_tables("policy", "domain_edges") + "SELECT src, dst, weight, 'forbidden_dependency' AS rule FROM domain_edges JOIN policy USING (src,dst) WHERE forbidden")
def boundary_forbidden(c):
    return policy.audit(c.domain_edges(), c.policy(), strict=False)


@query(with_tables("policy", "domain_edges") + "SELECT src||' -> '||dst AS pair, count(*) AS n FROM domain_edges JOIN policy USING (src,dst) WHERE forbidden OR NOT allowed GROUP BY 1")
def violation_breakdown(c):
    return policy.breakdown(policy.audit(c.domain_edges(), c.policy()))


@query(
    with_tables("domains", "policy", "domain_edges")
    + """SELECT d.name AS domain, count(v.dst) AS violations, (d.nation%4=0)::INT AS incomplete,
  CASE WHEN count(v.dst)>0 THEN 'rejected' WHEN d.nation%4=0 THEN 'unknown' ELSE 'approved' END AS verdict
FROM domains d LEFT JOIN (SELECT src, dst FROM domain_edges JOIN policy USING (src,dst) WHERE forbidden) v ON v.src=d.name WHERE nation IS NOT NULL GROUP BY d.name, d.nation"""
)
def verdict_tristate(c):
    found = policy.audit(c.domain_edges(), c.policy(), strict=False).groupBy("src").agg(F.count("*").alias("n"))
    rows = c.domains().filter("nation is not null").join(found, F.col("name") == F.col("src"), "left")
    violations, incomplete = F.coalesce("n", F.lit(0)), (F.col("nation") % 4 == 0).cast("int")
    return rows.select(F.col("name").alias("domain"), violations.cast("bigint").alias("violations"), incomplete.alias("incomplete"), policy.verdict(violations, incomplete).alias("verdict"))


@query(
    """WITH steps AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_orderkey, l_linenumber FROM lineitem)
SELECT src, dst, l_orderkey AS first_order, l_linenumber AS first_line, n FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY src, dst) AS n FROM steps WHERE dst IS NOT NULL AND src<>dst) WHERE k=1"""
)
def edge_first_evidence(c):
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = c.table("lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(after).alias("dst"), "l_orderkey", "l_linenumber").filter("dst is not null")
    found = graph.first_evidence(steps, [F.col("l_orderkey"), F.col("l_linenumber")])
    return found.select("src", "dst", F.col("first.l_orderkey").alias("first_order"), F.col("first.l_linenumber").alias("first_line"), "n")


@query(
    with_tables("file_edges", recursive=True)
    + """, walk(start, node, depth) AS (SELECT DISTINCT src, src, 0 FROM file_edges WHERE src IN (0,7,77,100)
  UNION SELECT start, dst, depth+1 FROM walk JOIN file_edges ON node=src WHERE depth<5)
SELECT start, node, min(depth)::INT AS depth FROM walk GROUP BY 1,2"""
)
def bfs_depth5(c):
    edges = _written_edges(c)
    return graph.reachable(edges, edges.filter(F.col("src").isin(0, 7, 77, 100)).select(F.col("src").alias("node")))


@query(
    with_tables("file_edges", recursive=True)
    + """, walk(start, node, depth) AS (SELECT DISTINCT src, src, 0 FROM file_edges WHERE src IN (0,7,77,100)
  UNION SELECT start, dst, depth+1 FROM walk JOIN file_edges ON node=src WHERE depth<8)
SELECT start, node, depth FROM (SELECT start, node, min(depth)::INT AS depth, row_number() OVER (PARTITION BY start ORDER BY min(depth), node) AS k FROM walk GROUP BY 1,2) WHERE k<=25"""
)
def bfs_capped25(c):
    edges = _written_edges(c)
    return graph.reachable(edges, edges.filter(F.col("src").isin(0, 7, 77, 100)).select(F.col("src").alias("node")), depth=9, most=25)


@query(
    with_tables("domain_edges", recursive=True)
    + """, walk(start, node, length) AS (SELECT src, dst, 1 FROM domain_edges UNION SELECT start, dst, length+1 FROM walk JOIN domain_edges ON node=src WHERE start<>node AND length<(SELECT count(*) FROM nation))
SELECT start AS node, min(length)::INT AS length FROM walk WHERE start=node GROUP BY 1"""
)
def cycle_members(c):
    return graph.cycle_members(c.domain_edges())


@query(
    with_tables("file_edges", recursive=True)
    + """, steps AS (SELECT src, max(dst) AS dst FROM file_edges GROUP BY src),
walk(start, node) AS (SELECT src, dst FROM steps UNION SELECT start, dst FROM walk JOIN steps ON node=src)
SELECT a.start AS node, min(a.node) AS component FROM walk a JOIN walk b ON a.start=b.node AND a.node=b.start GROUP BY 1"""
)
def strong_components(c):
    """Cycles of any length where every part has one successor."""
    return graph.strong_components(c.file_edges().groupBy("src").agg(F.max("dst").alias("dst")))


@query()
def cycle_search(c):
    return graph.cycles(c.domain_edges())


@query(
    with_tables("file_edges", recursive=True)
    + """, mounts AS (SELECT src AS parent, dst AS child, '/r'||dst AS path FROM file_edges WHERE src<dst),
found(router, prefix, k) AS (SELECT DISTINCT parent, '/r'||parent, 0 FROM mounts WHERE parent NOT IN (SELECT child FROM mounts) UNION SELECT child, prefix||path, k+1 FROM found JOIN mounts ON router=parent WHERE k<10)
SELECT DISTINCT router, prefix FROM found"""
)
def prefix_fixpoint(c):
    mounts = _written_edges(c).filter("src < dst").select(F.col("src").alias("parent"), F.col("dst").alias("child"), F.concat(F.lit("/r"), F.col("dst").cast("string")).alias("path"))
    tops = mounts.select("parent").distinct().join(mounts.select(F.col("child").alias("parent")), "parent", "left_anti")
    roots = tops.select(F.col("parent").alias("router"), F.concat(F.lit("/r"), F.col("parent").cast("string")).alias("prefix"))
    return graph.prefixes(mounts, roots, rounds=10)


_SCOPE_SQL = """tree AS (SELECT l_orderkey AS path, l_linenumber AS n, 'p'||l_partkey%9 AS p, floor(log2(l_linenumber))::INT AS d FROM lineitem),
spans AS (SELECT path, n AS scope, CASE WHEN p='p0' THEN '' ELSE p END AS prefix, (n-(1<<d))*(64>>d) AS s, (n-(1<<d)+1)*(64>>d)-d AS e FROM tree)"""


@query(
    f"""WITH {_SCOPE_SQL}
SELECT i.path, i.scope, '/'||coalesce(string_agg(o.prefix, '/' ORDER BY o.s, o.e DESC, o.prefix) FILTER (o.prefix<>''), '') AS uri, count(*)::INT AS depth
FROM spans i JOIN spans o ON i.path=o.path AND o.s<=i.s AND i.e<=o.e GROUP BY i.path, i.scope"""
)
def scope_prefixes(c):
    """Scopes of an order: its lines as a binary tree by their numbers, whose spans nest."""
    from codeloom.sources.scopes import fold_prefixes

    n = F.col("l_linenumber").cast("int")
    d = F.floor(F.log2(n)).cast("int")
    at, width = n - F.expr("shiftleft(1, cast(floor(log2(l_linenumber)) as int))"), F.expr("shiftright(64, cast(floor(log2(l_linenumber)) as int))")
    prefix = F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("l_partkey") % 9).cast("string")))
    spans = c.table("lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("scope"), prefix.alias("prefix"), (at * width).alias("start"), ((at + 1) * width - d).alias("end"))
    return fold_prefixes(spans)


_CHAIN_SQL = """, steps AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM file_edges),
walk(start, node, via, way) AS (SELECT DISTINCT src, src, src, []::BIGINT[] FROM steps UNION ALL SELECT start, dst, node, list_append(way, place) FROM walk JOIN steps ON node=src WHERE len(way)<{depth} AND dst<>start),
met AS (SELECT start, node, min(way) AS way, len(min(way)) AS depth FROM (SELECT *, min(len(way)) OVER (PARTITION BY start, node) AS least FROM walk WHERE len(way)>0) WHERE len(way)=least GROUP BY start, node),
placed AS (SELECT start, node AS file, depth, row_number() OVER (PARTITION BY start ORDER BY depth, way) AS place FROM met)
SELECT start, file, depth::INT AS depth, place::INT AS place FROM placed WHERE place<={room}"""


def _chains(c, depth: int, room: int) -> DataFrame:
    from codeloom.operators.chain import discovered

    edges = _written_edges(c)
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    steps = edges.select("src", "dst", F.row_number().over(order).alias("place"))
    starts = edges.select(F.col("src").alias("start"), F.col("src").alias("node"), F.lit(room).alias("room")).distinct()
    return discovered(starts, steps, depth).select("start", "file", "depth", "place")


@query(with_tables("file_edges", recursive=True) + _CHAIN_SQL.format(depth=5, room=23))
def chain_depth5(c):
    return _chains(c, 0, 23)


@query(with_tables("file_edges", recursive=True) + _CHAIN_SQL.format(depth=1, room=23))
def chain_depth1(c):
    return _chains(c, 1, 23)


@query(with_tables("file_edges", recursive=True) + _CHAIN_SQL.format(depth=8, room=23))
def chain_depth8(c):
    return _chains(c, 9, 23)


@query(
    with_tables("file_edges", recursive=True)
    + """, names AS (SELECT p_partkey AS file, lower(substring(p_brand, 1, 7)) AS name, p_partkey%7=0 AS declares FROM part),
words AS (SELECT DISTINCT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place, a.name AS here, b.name AS there FROM file_edges JOIN names a ON src=a.file JOIN names b ON dst=b.file),
walk(ask, name, node, way, visited, hit) AS (SELECT file, name, file, []::BIGINT[], [file], false FROM names
  UNION ALL SELECT ask, walk.name, dst, list_append(way, place), list_append(visited, dst), declares AND n.name=walk.name FROM walk JOIN words ON node=src AND (walk.name=here OR walk.name=there) JOIN names n ON n.file=dst
  WHERE NOT hit AND len(visited)<5 AND NOT list_contains(visited, dst))
SELECT ask, node AS file, len(way)::INT AS hops FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY way) AS k FROM walk WHERE hit) WHERE k=1"""
)
def reexport_chase(c):
    """Parts ask for their group of brands over the edges that mention it; every seventh part declares its own."""
    from codeloom.operators.reexport import chase

    edges = c.file_edges()
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    names = c.table("part").select(F.col("p_partkey").alias("file"), F.lower(F.replace(F.substring("p_brand", 1, 7), F.lit("#"), F.lit(""))).alias("name"))
    # Parts grow with the edges and pack into small files, so they are not broadcast.
    a, b = names.select(F.col("file").alias("src"), F.col("name").alias("here")).hint("merge"), names.select(F.col("file").alias("dst"), F.col("name").alias("there")).hint("merge")
    words = edges.select("src", "dst", F.row_number().over(order).alias("place")).join(a, "src").join(b, "dst").select("src", "dst", "place", F.explode(F.array_distinct(F.array("here", "there"))).alias("word"))
    asks = names.select(F.col("file").alias("ask"), "file", "name")
    return chase(asks, words, names.filter("file % 7 = 0")).select("ask", "file", "hops")


_LEGACY_SQL = """, asks AS (SELECT file_id, path AS source, CASE file_id%6 WHEN 0 THEN './doc_'||(file_id+200) WHEN 1 THEN '../services/doc_'||(file_id+1)||'.'||ext WHEN 2 THEN upper(path) WHEN 3 THEN regexp_replace(path,'[.][^/.]+$','') WHEN 4 THEN 'models/doc_'||(file_id-2) ELSE 'zod' END AS target FROM files),
stems AS (SELECT lower(regexp_replace(path,'[.][^/.]+$','')) AS stem, path FROM files),
shaped AS (SELECT *, regexp_replace(source,'/[^/]*$','') AS dir FROM asks),
joined AS (SELECT *, lower(CASE WHEN target LIKE './%' THEN dir||substring(target,2) WHEN target LIKE '../%' THEN regexp_replace(dir,'/[^/]*$','')||substring(target,3) END) AS j, lower(target) AS a FROM shaped),
hits AS (SELECT joined.file_id, 1 AS step, path FROM joined JOIN files f ON lower(f.path)=j UNION ALL SELECT j.file_id, 2, path FROM joined j JOIN stems ON stem=regexp_replace(j.j,'[.][^/.]+$','')
  UNION ALL SELECT j.file_id, 3, path FROM joined j JOIN files f ON lower(f.path)=a UNION ALL SELECT j.file_id, 4, path FROM joined j JOIN stems ON stem=regexp_replace(a,'[.][^/.]+$','')
  UNION ALL SELECT j.file_id, 5, path FROM joined j JOIN stems ON ends_with(stem, '/'||a))
SELECT file_id, step, file FROM joined LEFT JOIN (SELECT file_id, step, path AS file, row_number() OVER (PARTITION BY file_id ORDER BY step, path) AS k FROM hits) h USING (file_id) WHERE k=1 OR k IS NULL"""


@query(with_tables("files") + _LEGACY_SQL)
def legacy_files(c):
    from codeloom.operators.legacy import resolve_files

    files, i = c.files(), F.col("file_id")
    target = (
        F.when(i % 6 == 0, F.concat(F.lit("./doc_"), (i + 200).cast("string")))
        .when(i % 6 == 1, F.concat(F.lit("../services/doc_"), (i + 1).cast("string"), F.lit("."), "ext"))
        .when(i % 6 == 2, F.upper("path"))
        .when(i % 6 == 3, F.regexp_replace("path", r"\.[^/.]+\z", ""))
        .when(i % 6 == 4, F.concat(F.lit("models/doc_"), (i - 2).cast("string")))
        .otherwise("zod")
    )
    asks = files.select("file_id", F.col("path").alias("source"), target.alias("target"))
    return resolve_files(asks, files.select("path")).select("file_id", "step", "file")


_CASCADE_SQL = r""", doms AS (SELECT name, root_path AS root, row_number() OVER (ORDER BY name) AS place FROM domains),
syms AS (SELECT s.name, min(f.domain) AS domain FROM symbols s JOIN files f USING (file_id) WHERE kind='class' GROUP BY 1),
asks AS (SELECT file_id, path, domain, CASE file_id%8 WHEN 0 THEN '../models/x' WHEN 1 THEN '@pkg/'||domain||'/deep' WHEN 2 THEN replace(d.root_path,'/','.')||'.y' WHEN 3 THEN path WHEN 4 THEN 'App\Brand'||(10*(1+file_id//8%5)+1+file_id//40%6) WHEN 5 THEN 'lib/'||upper(d.root_path)||'/z' WHEN 6 THEN '.x' ELSE 'zod' END AS target FROM files f JOIN domains d ON d.name=f.domain),
named AS (SELECT a.file_id, s.domain FROM asks a JOIN syms s ON s.name=substring(a.target,5))
SELECT a.file_id, CASE file_id%8 WHEN 4 THEN n.domain WHEN 5 THEN (SELECT arg_min(name, place) FROM doms WHERE contains('/'||lower(a.target), '/'||root||'/')) WHEN 7 THEN NULL ELSE a.domain END AS domain,
  (CASE file_id%8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 6 WHEN 4 THEN CASE WHEN n.domain IS NOT NULL THEN 7 END WHEN 5 THEN 8 WHEN 6 THEN 1 END)::INT AS step FROM asks a LEFT JOIN named n USING (file_id)"""


@query(with_tables("files", "symbols") + _CASCADE_SQL)
def legacy_domains(c):
    """Each step of the cascade, hit by the files of one remainder."""
    from codeloom.operators.legacy import resolve_domains

    files, i = c.files(), F.col("file_id")
    order = Window.orderBy("name")  # a fixed list of nations and regions
    domains = c.domains().select("name", F.col("root_path").alias("root"), F.row_number().over(order).alias("place"))
    symbols = c.symbols().filter("kind = 'class'").join(files, "file_id").select("name", "domain")
    packages = domains.select(F.concat(F.lit("@pkg/"), "name").alias("name"), F.col("name").alias("domain"))
    rows = files.join(domains.select(F.col("name").alias("domain"), "root"), "domain")
    target = (
        F.when(i % 8 == 0, "../models/x")
        .when(i % 8 == 1, F.concat(F.lit("@pkg/"), "domain", F.lit("/deep")))
        .when(i % 8 == 2, F.concat(F.replace("root", F.lit("/"), F.lit(".")), F.lit(".y")))
        .when(i % 8 == 3, F.col("path"))
        .when(i % 8 == 4, F.concat(F.lit("App\\Brand"), ((F.floor(i / 8) % 5 + 1) * 10 + 1 + F.floor(i / 40) % 6).cast("string")))
        .when(i % 8 == 5, F.concat(F.lit("lib/"), F.upper("root"), F.lit("/z")))
        .when(i % 8 == 6, ".x")
        .otherwise("zod")
    )
    asks = rows.select("file_id", F.col("path").alias("source"), target.alias("target"))
    return resolve_domains(asks, domains, files.select("path", "domain"), symbols, packages).select("file_id", "domain", "step")


@query(
    with_tables("files")
    + """, sized AS (SELECT file_id, path, file_id%16 AS lane, coalesce(sum(size_bytes) OVER (PARTITION BY file_id%16 ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT//65536 AS part FROM files),
cut AS (SELECT *, (row_number() OVER (PARTITION BY lane, part ORDER BY path)-1)//50 AS slice FROM sized)
SELECT file_id, (dense_rank() OVER (ORDER BY lane, part, slice)-1)::INT AS batch FROM cut"""
)
def commit_batches(c):
    from codeloom.sources.commits import Limits, packed

    return packed(c.files(), Limits(50, 1 << 16), lane=F.col("file_id") % 16).select("file_id", "batch")


_DISCOVERY_SQL = """WITH f AS (SELECT 'r'||doc_id%60 AS repo, doc_id%60%5 AS kind, doc_id//60 AS q FROM documents),
d AS (SELECT DISTINCT repo, kind, CASE kind WHEN 0 THEN (['apps','packages','libs'])[q%3+1] WHEN 3 THEN (['pkg','internal','cmd'])[q%3+1] ELSE '' END AS top,
  CASE kind WHEN 0 THEN (['web','core','api'])[q//3%3+1] WHEN 1 THEN 'm'||q%4 WHEN 2 THEN (['core','cli','types','util'])[q%4+1] WHEN 3 THEN (['pkg','store','run'])[q%3+1] ELSE (['shop','bank'])[q%2+1] END AS sub FROM f),
n AS (SELECT *, CASE WHEN kind=0 AND count(*) OVER (PARTITION BY repo, sub)>1 THEN top||'-'||sub WHEN top='cmd' THEN 'cmd-run' ELSE sub END AS name FROM d),
pairs AS (SELECT a.repo, a.name, string_agg(b.name, ',' ORDER BY b.name) FILTER (CASE a.kind WHEN 0 THEN a.top='apps' AND b.top<>'apps' WHEN 2 THEN a.sub<>'types' AND (b.sub='types' OR (a.sub<>'core' AND b.sub='core')) WHEN 3 THEN (a.top='internal' AND b.top='pkg') OR (a.top='cmd' AND b.top<>'cmd') ELSE false END) AS allowed,
  string_agg(b.name, ',' ORDER BY b.name) FILTER (CASE a.kind WHEN 0 THEN a.top<>'apps' AND b.top='apps' WHEN 2 THEN (a.sub='core' AND b.sub='cli') OR (a.sub='types' AND b.sub IN ('cli','core')) ELSE false END) AS forbidden
  FROM n a JOIN n b ON a.repo=b.repo GROUP BY a.repo, a.name)
SELECT repo, (kind+1)::INT AS tier, name, CASE kind WHEN 0 THEN top||'/'||sub WHEN 1 THEN 'src/modules/'||sub WHEN 2 THEN 'src/'||sub WHEN 3 THEN CASE top WHEN 'pkg' THEN 'pkg' ELSE top||'/'||sub END ELSE sub END AS root,
  CASE kind WHEN 1 THEN 'common,root,shared' ELSE coalesce(allowed,'') END AS allowed, CASE WHEN kind=3 AND top='pkg' THEN 'cmd,internal' WHEN kind=3 AND top='internal' THEN 'cmd' ELSE coalesce(forbidden,'') END AS forbidden
FROM n JOIN pairs USING (repo, name)"""


@query(_DISCOVERY_SQL)
def domain_discovery(c):
    """Documents as the files of sixty repositories, twelve of each layout."""
    from codeloom.operators.discovery import discover

    i, kind, q = F.col("doc_id"), F.col("doc_id") % 60 % 5, F.floor(F.col("doc_id") / 60)
    pick = lambda at, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    folder = (
        F.when(kind == 0, F.concat_ws("/", pick(q, "apps", "packages", "libs"), pick(F.floor(q / 3), "web", "core", "api")))
        .when(kind == 1, F.concat(F.lit("src/modules/m"), (q % 4).cast("string")))
        .when(kind == 2, F.concat(F.lit("src/"), pick(q, "core", "cli", "types", "util")))
        .when(kind == 3, pick(q, "pkg", "internal/store", "cmd/run"))
        .otherwise(pick(q, "shop", "bank"))
    )
    repo = F.concat(F.lit("r"), (i % 60).cast("string"))
    files = c.table("documents").select(repo.alias("repo"), F.concat(folder, F.lit("/f"), i.cast("string")).alias("path"), F.lit(True).alias("is_source"), kind.alias("kind"))
    repos = files.select("repo", F.when(F.col("kind") == 3, "go").otherwise("typescript").alias("language"), F.lit(None).cast("string").alias("framework"), (F.col("kind") == 0).alias("is_monorepo")).distinct()
    return discover(files, repos).select("repo", "tier", "name", "root", F.array_join("allowed", ",").alias("allowed"), F.array_join("forbidden", ",").alias("forbidden"))


@query(
    """WITH c AS (SELECT user_id, event_type AS name, event_id AS seq, event_id%3=0 AS fills, 't'||event_id%7 AS type FROM events),
s AS (SELECT user_id, name, arg_max(type, seq) FILTER (NOT fills) AS defined, arg_min(type, seq) FILTER (fills) AS filled, min(seq) AS first FROM c GROUP BY 1,2)
SELECT user_id, name, coalesce(defined, filled) AS type, (row_number() OVER (PARTITION BY user_id ORDER BY first, name))::INT AS place FROM s"""
)
def schema_fold(c):
    """Events as changes of a user's fields; every third only fills in."""
    from codeloom.operators.schema import fold

    i = F.col("event_id")
    changes = c.table("events").select("user_id", F.col("event_type").alias("name"), F.concat(F.lit("t"), (i % 7).cast("string")).alias("field"), (i % 3 == 0).alias("fills"), "event_id")
    return fold(changes, "user_id", ["event_id"]).select("user_id", "name", F.col("field").alias("type"), "place")


_MATCH_SQL = "CASE WHEN http_method='GET' AND route_uri='/en/{id}' THEN 1 WHEN http_method='GET' AND norm='/en/:param' THEN 2 WHEN route_uri='/en/{id}' THEN 3 WHEN route_name='get._en_id_' THEN 4 END"


@query(
    with_tables("slices")
    + f"""SELECT slice_id, http_method, route_uri, match_rank FROM (SELECT *, {_MATCH_SQL} AS match_rank FROM (SELECT *, regexp_replace(regexp_replace(route_uri,'\\{{[^}}]+\\}}',':param','g'),':[A-Za-z0-9_]+',':param','g') AS norm FROM slices)) WHERE match_rank IS NOT NULL ORDER BY match_rank, slice_id LIMIT 20"""
)
def slice_match(c):
    from codeloom.operators.slices import match

    return match(c.slices(), "GET /en/{id}").orderBy("match_rank", "slice_id").limit(20).select("slice_id", "http_method", "route_uri", "match_rank")


_TRACE_SQL = r""", owned AS (SELECT *, 'App\Http\Page'||slice_id%40||'Controller' AS controller_class, (['index','show','store','drop'])[slice_id%4+1] AS action_name FROM slices),
said AS (SELECT slice_id, {test} AS fits FROM owned)
SELECT slice_id, {step} AS step, {confidence} AS confidence, CASE WHEN k=1 THEN 'primary' ELSE 'alternative' END AS role FROM (SELECT *, row_number() OVER (ORDER BY slice_id) AS k FROM said WHERE fits) WHERE {kept}"""


def _traced(c, asked: str) -> DataFrame:
    from codeloom.operators.slices import trace

    i = F.col("slice_id")
    owner = F.concat(F.lit("App\\Http\\Page"), (i % 40).cast("string"), F.lit("Controller"))
    action = F.element_at(F.array(*[F.lit(a) for a in ("index", "show", "store", "drop")]), (i % 4 + 1).cast("int"))
    chain = F.array(F.struct(F.concat(owner, F.lit("::"), action).alias("symbol"), F.concat(F.lit("app/page"), (i % 40).cast("string"), F.lit(".php")).alias("file")))
    rows = c.slices().select("slice_id", "http_method", "route_uri", "route_name", owner.alias("controller_class"), action.alias("action_name"), chain.alias("chain"))
    return trace(rows, asked).select("slice_id", "step", "confidence", "role")


@query(with_tables("slices") + _TRACE_SQL.format(test="http_method='GET' AND route_uri='/en/{{id}}'", step=1, confidence="CASE WHEN count(*) OVER () > 1 THEN 'inferred' ELSE 'exact' END", kept="true").replace("{{", "{").replace("}}", "}"))
def slice_trace_route(c):
    return _traced(c, "get /en/{id}")


@query(with_tables("slices") + _TRACE_SQL.format(test=r"controller_class='App\Http\Page7Controller' AND action_name='drop'", step=5, confidence="'exact'", kept="k=1"))
def slice_trace_action(c):
    return _traced(c, "Page7Controller@drop")


@query(with_tables("slices") + _TRACE_SQL.format(test="contains('app/page'||slice_id%40||'.php', 'page3')", step=6, confidence="'inferred'", kept="k=1"))
def slice_trace_symbol(c):
    return _traced(c, "app/page3")


@query(
    with_tables("slices")
    + """SELECT slice_id, score FROM (SELECT slice_id, list_sum([CASE WHEN contains(lower(route_uri||' '||route_name), t) THEN 1 + CASE WHEN contains(lower(route_uri), t) THEN 2 ELSE 0 END + CASE WHEN contains(lower(http_method), t) THEN 2 ELSE 0 END ELSE 0 END FOR t IN ['update','html','put']])::BIGINT AS score FROM slices) WHERE score>0"""
)
def slice_token_score(c):
    from codeloom.operators.slices import token_score

    rows = c.slices().withColumn("score", token_score("Ubah the update html put", F.concat_ws(" ", "route_uri", "route_name"), F.col("route_uri"), F.col("http_method")))
    return rows.filter("score > 0").select("slice_id", "score")


@query(with_tables("slices") + """SELECT slice_id, regexp_replace(regexp_replace(route_uri,'\\{[^}]+\\}',':param','g'),':[A-Za-z0-9_]+',':param','g') AS norm, route_name FROM slices""")
def uri_normalise(c):
    return c.slices().select("slice_id", text.normalise_uri(F.col("route_uri")).alias("norm"), "route_name")


@query(
    with_tables("chain_nodes")
    + """SELECT conv_id, string_agg(stage||':'||symbol, ' > ' ORDER BY CASE stage WHEN 'ingress' THEN 1 WHEN 'validation' THEN 2 WHEN 'controller' THEN 3 WHEN 'service' THEN 4 WHEN 'entity' THEN 5 WHEN 'egress' THEN 6 WHEN 'repository' THEN 6 ELSE 99 END, seq) AS chain, count(*) AS n FROM chain_nodes GROUP BY 1"""
)
def chain_stage_order(c):
    from codeloom.operators.slices import ordered_chains

    return ordered_chains(c.chain_nodes(), "conv_id").select("conv_id", F.array_join(F.transform("chain", lambda n: F.concat(n["stage"], F.lit(":"), n["symbol"])), " > ").alias("chain"), F.size("chain").cast("bigint").alias("n"))


@query(
    with_tables("files")
    + """, old AS (SELECT path, content_hash FROM files WHERE file_id%7<>0), new AS (SELECT path, CASE WHEN file_id%5=0 THEN sha256(content_hash) ELSE content_hash END AS content_hash FROM files WHERE file_id%11<>0)
SELECT coalesce(old.path,new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'deleted' WHEN old.content_hash<>new.content_hash THEN 'modified' ELSE 'unchanged' END AS status FROM old FULL JOIN new ON old.path=new.path"""
)
def snapshot_diff(c):
    files = c.files()
    new = files.filter("file_id % 11 <> 0").withColumn("content_hash", F.when(F.col("file_id") % 5 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    return catalog.snapshot_diff(files.filter("file_id % 7 <> 0"), new, "path", "content_hash")


@query(with_tables("files") + "SELECT path, domain FROM files WHERE file_id%7<>0 AND path IN (SELECT path FROM files WHERE file_id%11<>0)")
def prune_deleted(c):
    files = c.files()
    return files.filter("file_id % 7 <> 0").join(files.filter("file_id % 11 <> 0").select("path"), "path", "left_semi").select("path", "domain")


@query(with_tables("files") + "SELECT path FROM files WHERE file_id%3<>0 AND ext<>'php' AND size_bytes<=5000")
def uncovered_files(c):
    files = c.files()
    left = files.select("path")
    for taken in (files.filter("file_id % 3 = 0"), files.filter("ext = 'php'"), files.filter("size_bytes > 5000")):
        left = left.join(taken.select("path"), "path", "left_anti")
    return left


@query(with_tables("slices") + "SELECT http_method, route_uri, max(slice_id) AS slice_id FROM slices GROUP BY 1,2")
def upsert_last_wins(c):
    return catalog.last_wins(c.slices(), ["http_method", "route_uri"], [F.desc("slice_id")]).select("http_method", "route_uri", "slice_id")


@query(
    with_tables("files", "symbols")
    + """, fresh AS (SELECT file_id, name, line_start FROM symbols WHERE file_id%10=0 AND kind='class')
SELECT file_id, name, line_start FROM symbols WHERE file_id NOT IN (SELECT file_id FROM fresh) UNION ALL SELECT * FROM fresh"""
)
def replace_file_symbols(c):
    rows = c.symbols().select("file_id", "name", "line_start", "kind")
    return catalog.replace_rows(rows, rows.filter("file_id % 10 = 0 and kind = 'class'"), "file_id").drop("kind")


@query("SELECT doc_id, sha256(text) AS content_hash, len(string_split(text, chr(10)))::INT AS line_count, strlen(text) AS size_bytes FROM documents")
def content_hash(c):
    return c.table("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.size(F.split("text", "\n")).alias("line_count"), F.octet_length("text").cast("bigint").alias("size_bytes"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*)>1")
def duplicate_content(c):
    return c.table("documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query(
    """SELECT sha256(string_agg(folder||':'||digest, ',' ORDER BY folder)) AS fingerprint FROM (
  SELECT sha256(doc_id::VARCHAR)[1:3] AS folder, sha256(string_agg(doc_id||':'||sha256(text), ',' ORDER BY doc_id||':'||sha256(text))) AS digest FROM documents GROUP BY 1)"""
)
def inventory_fingerprint(c):
    from codeloom.sources.workspace import inventory_fingerprint as of

    rows = c.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content_hash"))
    return of(rows)


@query(
    """WITH lines AS (SELECT page_id, unnest(l) AS line, unnest(range(1, len(l)+1)) AS n FROM (SELECT page_id, string_split(replace(html,'>','>'||chr(10)), chr(10)) AS l FROM pages)),
d AS (SELECT page_id, n, (length(line)-length(replace(line,'{',''))) - (length(line)-length(replace(line,'}',''))) AS delta FROM lines)
SELECT page_id, max(depth)::BIGINT AS deepest, sum(abs(delta))::BIGINT AS moves FROM (SELECT page_id, delta, sum(delta) OVER (PARTITION BY page_id ORDER BY n) AS depth FROM d) GROUP BY 1"""
)
def brace_depth(c):
    from codeloom.functions.lines import brace_depths, explode_lines

    rows = explode_lines(c.table("pages").select("page_id", F.replace("html", F.lit(">"), F.lit(">\n")).alias("content")), "page_id")
    return brace_depths(rows, "page_id").groupBy("page_id").agg(F.max("depth").alias("deepest"), F.sum(F.abs("delta")).alias("moves"))


@query("SELECT page_id, len(l) AS n_links, coalesce(array_to_string(l, ' '),'') AS targets FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS l FROM pages)")
def page_links(c):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return c.table("pages").select("page_id", F.size(links).cast("bigint").alias("n_links"), F.array_join(links, " ").alias("targets"))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, k::BIGINT AS session, count(*) AS n, epoch_us(min(ts)) AS first_us FROM s GROUP BY 1,2"""
)
def debounce_sessions(c):
    from codeloom.streaming.feed import sessions

    return sessions(c.table("events"), "user_id", "ts", 30 * 60).select("user_id", "session", "n", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"))


@query(
    """SELECT user_id, op, n FROM (SELECT user_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'manifest' ELSE 'modify' END AS op,
  count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k=1"""
)
def change_feed_latest(c):
    from codeloom.streaming.feed import coalesced, operation

    return coalesced(c.table("events").withColumn("op", operation(F.col("event_type"))), "user_id", ["ts", "event_id"]).select("user_id", "op", "n")


@query("SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(p_name||'CamelCase'||p_type,'([a-z0-9])([A-Z])','\\1 \\2','g')),'[\\s_\\-.:/]+'), lambda w: length(w)>=2), '|') AS words FROM part")
def tokenise_camel(c):
    return c.table("part").select("p_partkey", F.array_join(text.tokens(F.concat("p_name", F.lit("CamelCase"), "p_type")), "|").alias("words"))


@query()
def similarity_topk(c):
    return catalog.suggest(c.table("part"), "p_name", "red wigdet")


@query(
    """SELECT p_partkey, CASE WHEN regexp_matches(s,'[^aeiou]y$') THEN regexp_replace(s,'y$','ies') WHEN regexp_matches(s,'(s|x|z|ch|sh)$') THEN s||'es' ELSE s||'s' END AS table_name
FROM (SELECT p_partkey, lower(regexp_replace(replace(p_name,' ','')||'Entry','([a-z0-9])([A-Z])','\\1_\\2','g')) AS s FROM part)"""
)
def model_table_name(c):
    return c.table("part").select("p_partkey", text.table_name(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("Entry"))).alias("table_name"))


@query("SELECT custkey, ok FROM (SELECT c_custkey AS custkey, c_name LIKE '%7' AND ends_with(c_name,'7') AS ok FROM customer)")
def suffix_match(c):
    return c.table("customer").select(F.col("c_custkey").alias("custkey"), F.endswith("c_name", F.lit("7")).alias("ok"))


@query(
    with_tables("symbols")
    + """SELECT name, count(*) AS n, count(DISTINCT file_id) AS n_files, CASE WHEN count(DISTINCT file_id)=1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM symbols WHERE lower(name)='m101' OR ends_with(lower(name),'::m101') OR ends_with(lower(name),'::m405') GROUP BY 1"""
)
def locate_symbol(c):
    rows = c.symbols().filter(text.name_matches(F.col("name"), "m101") | text.name_matches(F.col("name"), "m405"))
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files")).withColumn("status", F.when(F.col("n_files") == 1, "resolved").otherwise("ambiguous"))


@query(
    with_tables("files", "symbols")
    + """SELECT file_id, name, line_start, line_end, least(line_end, line_start+19)::INT AS page_end, CASE WHEN line_start+19 < line_end THEN line_start+20 END::INT AS next_start_line FROM symbols"""
)
def symbol_page(c):
    from codeloom.functions.lines import page

    return page(c.symbols(), 20).select("file_id", "name", "line_start", "line_end", "page_end", "next_start_line")


@query(
    with_tables("files")
    + """, root AS (SELECT path, string_split(path,'/') AS p FROM files)
SELECT p[1] AS dir, p[2] AS sub, count(*) AS n, row_number() OVER (PARTITION BY p[2] ORDER BY p[1])::INT AS k FROM root GROUP BY 1,2"""
)
def collision_numbers(c):
    parts = F.split("path", "/")
    rows = c.files().select(F.get(parts, F.lit(0)).alias("dir"), F.get(parts, F.lit(1)).alias("sub")).groupBy("dir", "sub").agg(F.count("*").alias("n"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("sub").orderBy("dir")))


@query(
    with_tables("files")
    + """SELECT domain, count(*) AS files, count(*) FILTER (WHERE ext='py') AS python, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (WHERE size_bytes > 2097152) AS skipped FROM files GROUP BY 1"""
)
def ingestion_metrics(c):
    return c.files().groupBy("domain").agg(F.count("*").alias("files"), F.count_if(F.col("ext") == "py").alias("python"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("size_bytes") > 2 * 1024 * 1024).alias("skipped"))


@query(
    """WITH saved AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey%3=0 THEN 'VERIFIED' ELSE 'DETECTED' END AS status, s_name AS platform FROM supplier WHERE s_suppkey%2=0),
detected AS (SELECT s_suppkey AS id, 'DETECTED' AS status, 'docker '||s_name AS platform FROM supplier WHERE s_suppkey%5<>0)
SELECT coalesce(s.id,d.id) AS id, CASE WHEN s.status='VERIFIED' OR d.id IS NULL THEN s.status ELSE d.status END AS status, CASE WHEN s.status='VERIFIED' OR d.id IS NULL THEN s.platform ELSE d.platform END AS platform FROM saved s FULL JOIN detected d ON s.id=d.id"""
)
def topology_merge(c):
    from codeloom.operators.topology import merge

    supplier = c.table("supplier")
    saved = supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "VERIFIED").otherwise("DETECTED").alias("status"), F.col("s_name").alias("platform"))
    found = supplier.filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), F.lit("DETECTED").alias("status"), F.concat(F.lit("docker "), "s_name").alias("platform"))
    return merge(saved, found, "id")


@query(
    """SELECT event_id, CASE WHEN contains(s,'k8s') THEN 'kubernetes' WHEN contains(s,'docker') THEN 'docker' WHEN contains(s,'lambda') THEN 'serverless' ELSE 'unspecified' END AS tag
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'docker swarm' WHEN 'view' THEN 'AWS Lambda' WHEN 'error' THEN 'K8S' ELSE event_type END AS s0, lower(s0) AS s FROM events)"""
)
def platform_tags(c):
    spelled = F.when(F.col("event_type") == "click", "docker swarm").when(F.col("event_type") == "view", "AWS Lambda").when(F.col("event_type") == "error", "K8S").otherwise(F.col("event_type"))
    return c.table("events").select("event_id", text.platform_tag(spelled).alias("tag"))


_IMPACT_SQL = (
    with_tables("files", "symbols")
    + """, imports AS (SELECT l_orderkey % (SELECT count(*) FROM documents) AS file_id, (l_linenumber-1)*50+2 AS line_number,
  CASE WHEN l_linenumber=7 THEN 'pkg/doc_'||(l_partkey % (SELECT count(*) FROM documents))||'.py' ELSE 'lib/'||replace(p_brand,'#','') END AS target FROM lineitem JOIN part ON l_partkey=p_partkey),
owners AS (SELECT DISTINCT file_id FROM symbols WHERE name='Brand7::m101'),
found AS (SELECT DISTINCT file_id, line_number FROM imports WHERE file_id NOT IN (SELECT file_id FROM owners) AND EXISTS (SELECT 1 FROM owners)
  AND (regexp_matches(target,'\\bBrand7\\b') OR replace(split_part(target,'/',2),'.py','') IN (SELECT 'doc_'||file_id FROM owners))),
calls AS (SELECT file_id, n AS line_number FROM (SELECT doc_id AS file_id, unnest(l) AS line, unnest(range(1,len(l)+1)) AS n FROM
  (SELECT doc_id, string_split_regex(replace(text,'version','x.m101('), '\\r\\n|\\n|\\r') AS l FROM documents WHERE doc_id IN (SELECT file_id FROM found))) WHERE contains(line,'.m101(')),
places AS (SELECT file_id, line_number, bool_or(i) AS imported FROM (SELECT *, true AS i FROM found UNION ALL SELECT *, false FROM calls) GROUP BY 1,2),
callers AS (SELECT path, line_number::INT AS line, coalesce(name, path||':'||line_number) AS caller, coalesce(kind, CASE WHEN imported THEN 'import' ELSE 'call' END) AS kind, CASE WHEN imported THEN domain END AS domain FROM
  (SELECT p.*, s.name, s.kind, row_number() OVER (PARTITION BY p.file_id, line_number ORDER BY line_end-line_start, line_start, s.name, s.kind) AS k FROM places p LEFT JOIN symbols s ON s.file_id=p.file_id AND line_number BETWEEN line_start AND line_end) JOIN files USING (file_id) WHERE k=1)
"""
)


def _impact(c: Catalog) -> DataFrame:
    from codeloom.operators.impact import symbol_impact

    docs = c.table("documents")
    n = docs.count()
    box = F.replace("p_brand", F.lit("#"), F.lit(""))
    doc = F.concat(F.lit("pkg/doc_"), (F.col("l_partkey") % n).cast("string"), F.lit(".py"))
    item = c.table("lineitem").join(c.table("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    imports = item.select((F.col("l_orderkey") % n).alias("file_id"), ((F.col("l_linenumber") - 1) * 50 + 2).alias("line_number"), F.when(F.col("l_linenumber") == 7, doc).otherwise(F.concat(F.lit("lib/"), box)).alias("target"))
    contents = docs.select(F.col("doc_id").alias("file_id"), F.replace("text", F.lit("version"), F.lit("x.m101(")).alias("content"))
    return symbol_impact(c.symbols(), c.files(), imports.withColumn("statement", F.concat(F.lit("import "), "target")), "Brand7::m101", contents)


@query(_IMPACT_SQL + "SELECT * FROM callers")
def symbol_impact(c):
    return _impact(c)


@query(_IMPACT_SQL + """SELECT count(*) AS total_dependents, count(DISTINCT path) AS affected_files, count(DISTINCT domain) AS n_domains,
  CASE WHEN count(DISTINCT path)>5 OR count(DISTINCT domain)>2 THEN 'high' WHEN count(DISTINCT path)>=2 OR count(DISTINCT domain)>=2 THEN 'medium' ELSE 'low' END AS risk FROM callers""")
def symbol_impact_risk(c):
    from codeloom.operators.impact import impact_risk

    return impact_risk(_impact(c))


@query(
    with_tables("files", "symbols")
    + """, asked AS (SELECT DISTINCT replace(p_brand,'#','') AS name FROM part UNION SELECT 'Nobody'),
first AS (SELECT * FROM (SELECT s.name, s.file_id, kind, path, domain, row_number() OVER (PARTITION BY s.name ORDER BY path, line_start, kind) AS k FROM symbols s JOIN files USING (file_id) WHERE s.name IN (SELECT name FROM asked)) WHERE k=1)
SELECT a.name, coalesce(any_value(f.kind),'unknown') AS kind, any_value(path) AS path, any_value(domain) AS domain,
  coalesce(string_agg(CASE WHEN m.kind='method' THEN m.name END, ',' ORDER BY m.line_start, m.name),'') AS methods, coalesce(string_agg(CASE WHEN m.kind='property' THEN m.name END, ',' ORDER BY m.line_start, m.name),'') AS properties
FROM asked a LEFT JOIN first f ON f.name=a.name LEFT JOIN symbols m ON m.file_id=f.file_id AND starts_with(m.name, a.name||'::') GROUP BY a.name"""
)
def reuse_members(c):
    names = c.table("part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("name")).distinct()
    return catalog.reuse_members(names.unionByName(c.spark.range(1).select(F.lit("Nobody").alias("name"))), c.symbols(), c.files())


def _ranked(c: Catalog, asked: str) -> DataFrame:
    from codeloom.operators.slices import ranked, token_score

    score = token_score(asked, F.concat_ws(" ", "route_uri", "route_name"), F.col("route_uri"), F.col("http_method"))
    return ranked(c.slices(), score).select("slice_id", "score", "found", "role")


@query(
    with_tables("slices")
    + """, scored AS (SELECT slice_id, list_sum([CASE WHEN contains(lower(route_uri||' '||route_name), t) THEN 1 + CASE WHEN contains(lower(route_uri), t) THEN 2 ELSE 0 END + CASE WHEN contains(lower(http_method), t) THEN 2 ELSE 0 END ELSE 0 END FOR t IN ['update','html','put']])::BIGINT AS score FROM slices)
SELECT slice_id, score, true AS found, CASE WHEN row_number() OVER (ORDER BY score DESC, slice_id)=1 THEN 'primary' ELSE 'alternative' END AS role FROM scored WHERE score>0 ORDER BY score DESC, slice_id LIMIT 4"""
)
def slice_ranked(c):
    return _ranked(c, "Ubah the update html put")


@query(with_tables("slices") + "SELECT slice_id, 0::BIGINT AS score, false AS found, 'alternative' AS role FROM slices ORDER BY slice_id LIMIT 5")
def slice_ranked_miss(c):
    return _ranked(c, "zzyzx")


@query(
    with_tables("slices", "chain_nodes")
    + """, last AS (SELECT max_by(conv_id, slice_id) AS conv_id FROM slices WHERE contains(lower(route_uri),'en/') OR contains(lower(route_name),'en/') GROUP BY http_method, route_uri),
met AS (SELECT * FROM chain_nodes WHERE conv_id IN (SELECT conv_id FROM last))
SELECT 'touchpoint' AS kind, stage||'/'||conv_id AS value FROM met UNION SELECT 'symbol', symbol FROM met"""
)
def derived_feature(c):
    from codeloom.operators.slices import derived_feature as of

    return of(c.slices(), c.chain_nodes().withColumn("file", F.concat_ws("/", "stage", "conv_id")), "EN/")


@query("SELECT p_partkey, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS value FROM (SELECT p_partkey, map_concat(MAP {'size': p_size, p_brand: 1}, MAP {p_brand: 2, 'more': 3}) AS m FROM part)")
def merged_manifests(c):
    base = F.create_map(F.lit("size"), F.col("p_size"), F.col("p_brand"), F.lit(1))
    over = F.create_map(F.col("p_brand"), F.lit(2), F.lit("more"), F.lit(3))
    return c.table("part").select("p_partkey", F.explode(catalog.overlay(base, over)).alias("key", "value"))


@query(
    """SELECT p_partkey, '/'||r||'s'||CASE WHEN regexp_matches(lower(m),'store|create') THEN '' WHEN regexp_matches(lower(m),'show|get|find|update|edit|patch|delete|destroy|remove') THEN '/:id' ELSE '/'||m END AS uri
FROM (SELECT p_partkey, lower(replace(p_name,' ','')) AS r, (['storeAll','findOne','editIt','Destroy','export'])[p_partkey%5+1] AS m FROM part)"""
)
def inferred_routes(c):
    method = F.element_at(F.array(*[F.lit(m) for m in ("storeAll", "findOne", "editIt", "Destroy", "export")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("app/http/"), F.replace("p_name", F.lit(" "), F.lit("")), F.when(F.col("p_partkey") % 2 == 0, "Controller.php").otherwise(".ts"))
    return c.table("part").select("p_partkey", text.inferred_uri(path, method).alias("uri"))


@query(
    with_tables("policy", "domain_edges")
    + """, imports AS (SELECT src||'/api/x.py' AS file, CASE WHEN weight%3=0 THEN 'nowhere' ELSE src END AS src, dst, weight::INT AS line FROM domain_edges)
SELECT DISTINCT file, NULL::VARCHAR AS src, NULL::VARCHAR AS dst, 1 AS line, 'touchpoint_violation' AS rule FROM imports WHERE NOT (starts_with(file,'nation_1') OR file='nation_6/api/x.py')
UNION ALL SELECT DISTINCT file, NULL, NULL, 1, 'unmapped_domain' FROM imports WHERE src='nowhere'
UNION ALL SELECT file, src, dst, line, CASE WHEN forbidden THEN 'forbidden_dependency' ELSE 'disallowed_dependency' END FROM imports JOIN policy USING (src,dst) WHERE forbidden OR NOT allowed"""
)
def boundary_evaluate(c):
    src = F.when(F.col("weight") % 3 == 0, "nowhere").otherwise(F.col("src"))
    imports = c.domain_edges().select(F.concat("src", F.lit("/api/x.py")).alias("file"), src.alias("src"), "dst", F.col("weight").cast("int").alias("line"))
    return policy.evaluate(imports, c.domains(), c.policy(), "checkout", {"checkout": ["nation_1*/**/*.py", "nation_6/api/x.py"]})


@query(with_tables("policy", "domain_edges") + "SELECT src, dst, CASE WHEN forbidden THEN 'forbidden_dependency' ELSE 'disallowed_dependency' END AS rule FROM domain_edges JOIN policy USING (src,dst) WHERE (forbidden OR NOT allowed) AND (src='nation_6' OR dst='nation_6')")
def boundary_domain(c):
    return policy.of_domain(policy.audit(c.domain_edges(), c.policy()), "nation_6").select("src", "dst", "rule")


@query(
    with_tables("files", "symbols")
    + """, actual AS (SELECT path, name, kind, name||'()' AS signature, line_start, line_end, CASE WHEN file_id%2=0 THEN NULL ELSE content_hash END AS content_hash, ext AS language, file_id FROM symbols JOIN files USING (file_id)),
wanted AS (SELECT path, name, kind, signature, line_start, line_end, CASE WHEN file_id%5=0 THEN 'other' ELSE content_hash END AS content_hash, language FROM actual WHERE file_id%3=0)
SELECT file_id, name, line_start, line_end FROM actual a WHERE EXISTS (SELECT 1 FROM wanted w WHERE w.path=a.path AND w.name=a.name AND w.kind=a.kind AND w.signature=a.signature AND w.line_start=a.line_start AND w.line_end=a.line_end AND w.content_hash IS NOT DISTINCT FROM a.content_hash AND w.language=a.language)"""
)
def identity_match(c):
    hash_ = F.when(F.col("file_id") % 2 != 0, F.col("content_hash"))
    files = c.files().select("file_id", "path", hash_.alias("content_hash"), F.col("ext").alias("language"))
    actual = c.symbols().join(files, "file_id").withColumn("signature", F.concat("name", F.lit("()")))
    wanted = actual.filter("file_id % 3 = 0").withColumn("content_hash", F.when(F.col("file_id") % 5 == 0, "other").otherwise(F.col("content_hash")))
    return catalog.same_identity(actual, wanted).select("file_id", "name", "line_start", "line_end")


@query(
    """SELECT *, n_nodes>6 OR n_hosts>1 OR n_subservices>0 OR n_addresses>0 AS distributed FROM (SELECT count(*) AS n_nodes, count(*) FILTER (WHERE s_suppkey%4=0) AS n_hosts, count(*) FILTER (WHERE s_suppkey%5=0) AS n_subservices, count(*) FILTER (WHERE s_suppkey%7=0) AS n_addresses FROM supplier)"""
)
def distributed_nodes(c):
    from codeloom.operators.topology import is_distributed

    key = F.col("s_suppkey")
    return is_distributed(c.table("supplier").select(F.when(key % 4 == 0, "host").otherwise("app").alias("layer"), F.when(key % 5 == 0, key - 1).alias("parent"), F.when(key % 7 == 0, "a.b").otherwise("local").alias("address")))


#: Files of the repositories that customers stand for: (modulus, remainder, path, content).
_ENV_FILES = (
    (1, 0, "README.md", "x"),
    (3, 0, "composer.json", '{"require":{"php":"^8.2","laravel/framework":"^11"}}'),
    (4, 0, "package.json", '{"dependencies":{"@inertiajs/vue3":"1","pg":"8"},"engines":{"node":">=20"}}'),
    (4, 1, "package.json", '{"devDependencies":{"better-sqlite3":"9","@sentry/vue":"7"}}'),
    (5, 0, "go.mod", "module x\nrequire github.com/lib/pq v1"),
    (6, 0, "public/.htaccess", "RewriteEngine On"),
    (10, 0, ".htaccess", "LSCache on"),
    (7, 0, ".env", "DB_CONNECTION=MySQL\nCLOUDFLARE_KEY=x"),
    (14, 0, ".env.example", "DB_CONNECTION=pgsql\nOTEL_HOST=x"),
    (7, 1, ".env.example", "# c\nDB_PORT=5432\nREDIS_HOST='r'\nSENTRY_DSN="),
    (8, 0, "Dockerfile", "FROM x"),
    (8, 1, "fly.toml", ""),
    (9, 0, "backend/composer.json", "{}"),
    (9, 0, "frontend/package.json", "{}"),
    (9, 1, "apps/web/nginx.conf", ""),
    (9, 1, "services/pay/go.mod", ""),
    (11, 0, "nginx.conf", ""),
    (13, 0, "wrangler.toml", ""),
)
_ENV_SQL = "WITH given(m, r, path, content) AS (VALUES " + ", ".join("({}, {}, '{}', '{}')".format(m, r, p, c.replace("'", "''")) for m, r, p, c in _ENV_FILES) + """),
files AS (SELECT c_custkey AS repo, path, content FROM customer JOIN given ON c_custkey%m=r),
spots AS (SELECT repo, '' AS unit, '' AS service, 'repository' AS kind, path, content FROM files
  UNION ALL SELECT repo, 'backend', 'backend', 'backend', substr(path, 9), content FROM files WHERE starts_with(path,'backend/')
  UNION ALL SELECT repo, 'frontend', 'frontend', 'frontend', substr(path, 10), content FROM files WHERE starts_with(path,'frontend/')
  UNION ALL SELECT repo, 'apps/web', 'apps-web', 'frontend', substr(path, 10), content FROM files WHERE starts_with(path,'apps/web/')
  UNION ALL SELECT repo, 'services/pay', 'services-pay', 'service', substr(path, 14), content FROM files WHERE starts_with(path,'services/pay/')),
units AS (SELECT repo, unit, service, kind, list(path) AS p, max(content) FILTER (path='composer.json') AS composer, max(content) FILTER (path='package.json') AS package, coalesce(max(content) FILTER (path='go.mod'),'') AS gomod,
  coalesce(max(content) FILTER (path='.htaccess'),'') AS ht, coalesce(max(content) FILTER (path='.env'),'') AS env, coalesce(max(content) FILTER (path='.env.example'),'') AS example FROM spots GROUP BY 1,2,3,4),
read AS (SELECT *, chr(10)||example||chr(10)||env AS texts, CASE WHEN example<>'' THEN example ELSE env END AS shown, coalesce(contains(package,'@inertiajs/vue3'), false) AS inertia,
  lower(regexp_extract(CASE WHEN contains(env,'DB_CONNECTION') THEN env ELSE example END, 'DB_CONNECTION=(.*)', 1)) AS conn FROM units),
gateways AS (SELECT *, CASE WHEN list_contains(p,'public/.htaccess') THEN ['Apache / LiteSpeed Web Server','shared_hosting','public/.htaccess'] WHEN list_contains(p,'.htaccess') AND contains(ht,'LSCache') THEN ['LiteSpeed Web Server','shared_hosting','.htaccess']
  WHEN list_contains(p,'nginx.conf') THEN ['Nginx Reverse Proxy','vps','nginx.conf'] END AS g FROM read),
stores AS (SELECT repo, string_agg(label,' + ' ORDER BY place) FILTER (k=1) AS labels, list(DISTINCT source) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY repo, split_part(label,' ',1) ORDER BY place) AS k FROM (
  SELECT repo, 1 AS place, CASE WHEN conn='mysql' THEN 'MySQL / MariaDB' ELSE 'PostgreSQL' END AS label, '.env' AS source FROM read WHERE unit='' AND (conn IN ('mysql','pgsql') OR contains(texts,'DB_PORT=5432'))
  UNION ALL SELECT repo, 2, 'Redis (Cache & Queues)', '.env' FROM read WHERE unit='' AND contains(texts,'REDIS_HOST')
  UNION ALL SELECT repo, 3, 'PostgreSQL', 'package.json' FROM read WHERE unit='' AND contains(package,'"pg"')
  UNION ALL SELECT repo, 4, 'SQLite (Embedded / Local WAL)', 'package.json' FROM read WHERE unit='' AND contains(package,'"better-sqlite3"')
  UNION ALL SELECT repo, 5, 'PostgreSQL', 'go.mod' FROM read WHERE unit='' AND contains(gomod,'lib/pq'))) GROUP BY repo),
layers AS (
  SELECT repo, unit, service, kind, 'gateway' AS layer, coalesce(g[1],'Standard Ingress / Unknown Web Server') AS platform, coalesce(g[2],'unspecified') AS tag, CASE WHEN g IS NULL THEN 'AMBIGUOUS' ELSE 'DETECTED' END AS status, coalesce(g[3],'') AS found FROM gateways
  UNION ALL SELECT repo, unit, service, kind, 'runtime', CASE WHEN composer IS NOT NULL THEN 'PHP '||CASE WHEN contains(composer,'^8.2') THEN '^8.2' ELSE '>=8.1' END||' (FPM / FastCGI)'||CASE WHEN contains(composer,'laravel') THEN ' + Laravel' ELSE '' END||CASE WHEN inertia THEN ' + Inertia/Vue' ELSE '' END
    WHEN list_contains(p,'go.mod') THEN 'Golang (Compiled Native Binary)' WHEN package IS NOT NULL THEN 'Node.js ('||CASE WHEN contains(package,'>=20') THEN '>=20' ELSE '>=18' END||') / Bun' ELSE 'Generic Runtime' END, NULL,
    CASE WHEN composer IS NULL AND package IS NULL AND NOT list_contains(p,'go.mod') THEN 'UNRESOLVED' ELSE 'DETECTED' END, CASE WHEN composer IS NOT NULL THEN CASE WHEN inertia THEN 'composer.json,package.json' ELSE 'composer.json' END WHEN list_contains(p,'go.mod') THEN 'go.mod' WHEN package IS NOT NULL THEN 'package.json' ELSE '' END FROM gateways
  UNION ALL SELECT repo, unit, service, kind, 'edge', CASE WHEN list_contains(p,'wrangler.toml') THEN 'Cloudflare (Workers / Pages / Edge)' WHEN contains(texts,'CLOUDFLARE_') THEN 'Cloudflare (Edge Proxy, WAF & Bot Mitigation)' ELSE 'Direct Ingress / Unresolved Edge' END,
    CASE WHEN list_contains(p,'wrangler.toml') OR contains(texts,'CLOUDFLARE_') THEN 'cdn_edge' ELSE 'unspecified' END, CASE WHEN list_contains(p,'wrangler.toml') OR contains(texts,'CLOUDFLARE_') THEN 'DETECTED' ELSE 'AMBIGUOUS' END, CASE WHEN list_contains(p,'wrangler.toml') THEN 'wrangler.toml' WHEN contains(texts,'CLOUDFLARE_') THEN '.env' ELSE '' END FROM gateways WHERE unit=''
  UNION ALL SELECT repo, unit, service, kind, 'host', CASE WHEN list_contains(p,'Dockerfile') THEN 'Containerized Compute (Docker / Dedicated VPS)' WHEN list_contains(p,'fly.toml') THEN 'Fly.io MicroVMs' WHEN contains(g[3],'.htaccess') THEN 'Shared Hosting (Hostinger / cPanel) or Unmanaged VPS' ELSE 'Virtual Server / Unknown Host' END,
    CASE WHEN list_contains(p,'Dockerfile') THEN 'docker' WHEN list_contains(p,'fly.toml') THEN 'paas' WHEN contains(g[3],'.htaccess') THEN 'shared_hosting' ELSE 'unspecified' END, CASE WHEN list_contains(p,'Dockerfile') OR list_contains(p,'fly.toml') THEN 'DETECTED' WHEN contains(g[3],'.htaccess') THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END,
    CASE WHEN list_contains(p,'Dockerfile') THEN 'Dockerfile / docker-compose.yml' WHEN list_contains(p,'fly.toml') THEN 'fly.toml' WHEN contains(g[3],'.htaccess') THEN g[3] ELSE '' END FROM gateways WHERE unit=''
  UNION ALL SELECT repo, unit, service, kind, 'storage', coalesce(labels,'Relational Database / Storage'), CASE WHEN labels IS NULL THEN 'unspecified' ELSE 'managed_db' END, CASE WHEN labels IS NULL THEN 'AMBIGUOUS' ELSE 'DETECTED' END, coalesce(array_to_string(list_sort(sources),','),'') FROM gateways LEFT JOIN stores USING (repo) WHERE unit=''
  UNION ALL SELECT repo, unit, service, kind, 'telemetry', CASE WHEN contains(shown,'SENTRY_DSN') THEN 'Sentry Error & Performance Monitoring' WHEN contains(shown,'OTEL_') THEN 'OpenTelemetry Distributed Tracing' ELSE 'Application Log Files (Local / Daily)' END, NULL, 'DETECTED',
    CASE WHEN contains(shown,'SENTRY_DSN') THEN 'Sentry SDK in dependencies / .env' WHEN contains(shown,'OTEL_') THEN 'OpenTelemetry SDK' ELSE 'Standard Framework Logger' END FROM gateways WHERE unit=''),
many AS (SELECT DISTINCT repo FROM units WHERE unit<>''),
nodes AS (
  SELECT repo, layer||':primary' AS id, layer, platform, coalesce(tag,'unspecified') AS tag, NULL AS role, status, CASE layer WHEN 'gateway' THEN 'runtime:primary' WHEN 'runtime' THEN 'storage:primary' ELSE '' END AS linked FROM layers WHERE unit='' AND (layer NOT IN ('gateway','runtime') OR repo NOT IN (SELECT repo FROM many))
  UNION ALL SELECT repo, layer||':'||service, layer, platform, coalesce(tag,'unspecified'), CASE WHEN layer='runtime' THEN CASE kind WHEN 'frontend' THEN 'frontend_spa' ELSE 'web_api' END END, status, CASE WHEN layer='gateway' THEN 'runtime:'||service WHEN kind='backend' THEN 'storage:primary' ELSE 'runtime:backend' END FROM layers WHERE unit<>'' AND (layer='runtime' OR status='DETECTED')),
counted AS (SELECT repo, bool_or(tag='cdn_edge' OR contains(lower(platform),'cloudflare')) AS proxied, bool_or(tag='shared_hosting') AS shared, bool_or(coalesce(role='frontend_spa', false)) AS front, bool_or(coalesce(role='web_api', false)) AS back, count(*) AS n_nodes, count(*) FILTER (layer='runtime' AND role IS DISTINCT FROM 'frontend_spa') AS backends FROM nodes GROUP BY repo),
asked AS (SELECT repo, layer FROM nodes WHERE status IN ('AMBIGUOUS','UNRESOLVED')),
pending AS (SELECT repo, layer FROM asked UNION ALL SELECT repo, layer FROM layers WHERE unit='' AND status IN ('AMBIGUOUS','UNRESOLVED') AND (repo, layer) NOT IN (SELECT repo, layer FROM asked))
"""


def _environment(c: Catalog) -> DataFrame:
    from codeloom.operators import environment

    given = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(r).alias("r"), F.lit(p).alias("path"), F.lit(x).alias("content")) for m, r, p, x in _ENV_FILES])
    customers = c.table("customer").select(F.col("c_custkey").alias("repo"))
    # Keys are dealt before they become files: then a repository's files are together, and the files of a task are bounded.
    repos = environment.dealt(customers, customers.count())
    files = repos.select("repo", F.inline(F.filter(given, lambda g: F.col("repo") % g["m"] == g["r"]))).select("repo", "path", "content")
    return materialize(environment.layers(environment.marked(files)), "environment")


@query(_ENV_SQL + "SELECT repo, unit, layer, platform, tag, status, found FROM layers")
def environment_layers(c):
    """Customers as repositories of a few files each; the layers of all and of their services."""
    return _environment(c).select("repo", "unit", "layer", "platform", "tag", "status", F.array_join(F.array_sort("detected_from"), ",").alias("found"))


@query(_ENV_SQL + "SELECT repo, id, layer, platform, tag, role, status, linked FROM nodes")
def environment_nodes(c):
    from codeloom.operators import environment

    found = _environment(c)
    return environment.nodes(found, environment.of_repositories(found)).select("repo", "id", "layer", "platform", "tag", "role", "status", F.array_join("connected_to", ",").alias("linked"))


@query(
    _ENV_SQL
    + """SELECT repo, 'Perimeter Bot Protection & Trusted Proxy Invariant' AS rule, id FROM counted JOIN nodes USING (repo) WHERE proxied AND layer IN ('edge','runtime')
UNION ALL SELECT repo, 'Shared Hosting Background Execution Invariant', id FROM counted JOIN nodes USING (repo) WHERE (shared OR repo IN (SELECT repo FROM layers WHERE unit='' AND layer='host' AND tag='shared_hosting')) AND layer IN ('host','runtime')
UNION ALL SELECT repo, 'LiteSpeed Cache vs Inertia Dynamic State Invariant', id FROM layers g JOIN layers r USING (repo) LEFT JOIN nodes n ON n.repo=g.repo AND n.layer IN ('gateway','runtime') WHERE g.unit='' AND r.unit='' AND g.layer='gateway' AND r.layer='runtime' AND g.tag='shared_hosting' AND contains(r.platform,'Inertia')
UNION ALL SELECT repo, 'Cross-Domain Cookie & CORS Security Invariant', id FROM counted JOIN nodes USING (repo) WHERE front AND back AND layer IN ('gateway','runtime')
UNION ALL SELECT repo, 'Distributed Database Migration Concurrency Invariant', id FROM counted JOIN nodes USING (repo) WHERE backends>1 AND layer='runtime' AND role IS DISTINCT FROM 'frontend_spa'"""
)
def environment_rules(c):
    from codeloom.operators import environment

    found = _environment(c)
    own = environment.of_repositories(found)
    return environment.interplays(own, environment.nodes(found, own))


@query(
    _ENV_SQL
    + """SELECT repo, distributed, n_nodes, n_pending, overall_status, 'Architecture Plane: ['||CASE WHEN distributed THEN 'Distributed Multi-Node ('||n_nodes||' nodes)' ELSE 'Monolithic Single-Node' END||']. Pipeline: '||way||'. Status: '||overall_status||'.' AS summary FROM (
  SELECT c.repo, n_nodes>6 OR c.repo IN (SELECT repo FROM many) AS distributed, n_nodes, coalesce(k,0) AS n_pending, CASE WHEN k IS NULL THEN 'RESOLVED' ELSE 'NEEDS_CLARIFICATION' END AS overall_status, way FROM counted c LEFT JOIN (SELECT repo, count(*) AS k FROM pending GROUP BY repo) q ON q.repo=c.repo
  JOIN (SELECT repo, string_agg('['||upper(layer[1])||layer[2:]||': '||platform||']', ' ➔ ' ORDER BY layer='storage', layer='runtime', layer='host', layer='gateway') AS way FROM layers WHERE unit='' AND layer<>'telemetry' GROUP BY repo) w ON w.repo=c.repo)"""
)
def environment_summary(c):
    from codeloom.operators import environment

    found = _environment(c)
    own = environment.of_repositories(found)
    return environment.summary(own, environment.nodes(found, own), found.filter("unit <> ''").select("repo"))


#: Manifests of the repositories that suppliers stand for: (modulus, remainder, path, content).
_PROJECT_FILES = (
    (1, 0, "README.md", "x"),
    (6, 0, "composer.json", '{"require":{"symfony/symfony":"6"}}'),
    (12, 0, "artisan", ""),
    (24, 0, "resources/views/a.blade.php", ""),
    (6, 1, "go.mod", "require github.com/go-chi/chi"),
    (6, 2, "requirements.txt", "Flask==3"),
    (12, 2, "wsgi.py", ""),
    (3, 0, "package.json", '{"dependencies":{"vue":"3"}}'),
    (6, 5, "package.json", '{"dependencies":{"express":"4"},"devDependencies":{"astro":"5"}}'),
    (6, 4, "tsconfig.json", "{}"),
    (7, 0, "apps/web/a.ts", ""),
    (14, 0, "libs/util/b.ts", ""),
    (13, 0, "nx.json", ""),
)


@query(
    "WITH given(m, r, path, content) AS (VALUES " + ", ".join(f"({m}, {r}, '{p}', '{x}')" for m, r, p, x in _PROJECT_FILES) + """),
f AS (SELECT s_suppkey AS repo, list(path) AS p, coalesce(string_agg(content, ''),'') AS texts FROM supplier JOIN given ON s_suppkey%m=r GROUP BY 1),
l AS (SELECT *, CASE WHEN list_contains(p,'composer.json') OR list_contains(p,'artisan') THEN 'php' WHEN list_contains(p,'go.mod') THEN 'go' WHEN list_contains(p,'requirements.txt') THEN 'python' WHEN list_contains(p,'package.json') OR list_contains(p,'tsconfig.json') THEN 'typescript' ELSE 'generic' END AS language,
  list_contains(p,'nx.json') OR (list_contains(p,'apps/web/a.ts') AND list_contains(p,'libs/util/b.ts')) AS is_monorepo FROM f),
w AS (SELECT *, CASE language WHEN 'php' THEN CASE WHEN list_contains(p,'artisan') THEN 'laravel' WHEN contains(texts,'symfony/symfony') THEN 'symfony' ELSE 'generic-php' END WHEN 'go' THEN 'chi' WHEN 'python' THEN CASE WHEN list_contains(p,'wsgi.py') THEN 'django' ELSE 'flask' END
  WHEN 'typescript' THEN CASE WHEN contains(texts,'astro') THEN 'astro' WHEN contains(texts,'"vue"') THEN 'vue' ELSE 'generic-node' END ELSE 'generic' END AS framework FROM l)
SELECT repo, language, framework, is_monorepo, CASE WHEN is_monorepo THEN 'monorepo' WHEN framework='astro' OR (framework='laravel' AND list_contains(p,'resources/views/a.blade.php')) THEN 'fullstack' WHEN framework='vue' THEN 'frontend' WHEN language IN ('go','python','php') THEN 'backend' ELSE 'generic' END AS project_type FROM w"""
)
def project_types(c):
    """Suppliers as repositories of a few manifests each."""
    from codeloom.operators.projects import classify

    given = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(r).alias("r"), F.lit(p).alias("path"), F.lit(x).alias("content")) for m, r, p, x in _PROJECT_FILES])
    files = c.table("supplier").select(F.col("s_suppkey").alias("repo"), F.inline(F.filter(given, lambda g: F.col("s_suppkey") % g["m"] == g["r"]))).select("repo", "path", "content")
    return classify(files)

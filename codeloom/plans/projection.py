"""The driver's star tables projected onto the catalog's tables, in Spark and in SQL.

Each table is a DataFrame builder here and a CTE in :data:`SQL`, by the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARCHETYPE_DIRS = ("controllers", "services", "models", "repositories", "actions", "jobs", "listeners", "helpers")
EXTENSION = {"en": "py", "fr": "ts", "de": "go", "es": "php"}
METHODS = ("GET", "POST", "PUT", "DELETE")
STAGES = ("egress", "repository", "service", "validation", "ingress", "entity", "controller", "job")
KINDS = ("class", "method", "function", "property")
VISIBILITY = ("public", "protected", "private")


def _pick(values: tuple[str, ...], at) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


class Catalog:
    """Catalog tables of one data folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def domains(self) -> DataFrame:
        """name, root_path, nation; a region is a domain around its nations', so roots nest."""
        nation, region = self.table("nation"), self.table("region")
        top = F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))
        nations = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
        own = nations.select(F.lower("n_name").alias("name"), F.concat_ws("/", top, F.lower("n_name")).alias("root_path"), F.col("n_nationkey").alias("nation"))
        return own.unionByName(region.select(top.alias("name"), top.alias("root_path"), F.lit(None).cast("int").alias("nation")))

    def policy(self) -> DataFrame:
        """src, dst, forbidden, allowed over nation domains."""
        nation = self.table("nation").select("n_nationkey", F.lower("n_name").alias("name"))
        a, b = nation.select(F.col("n_nationkey").alias("s"), F.col("name").alias("src")), nation.select(F.col("n_nationkey").alias("d"), F.col("name").alias("dst"))
        pairs = a.join(F.broadcast(b), F.col("s") != F.col("d"))  # a fixed list of 25 nations
        forbidden = (F.col("s") * 3 + F.col("d")) % 5 == 0
        return pairs.select("src", "dst", forbidden.alias("forbidden"), (~forbidden & ((F.col("s") + F.col("d")) % 2 == 0)).alias("allowed"))

    def files(self) -> DataFrame:
        """file_id, domain, path, content_hash, line_count, size_bytes, language."""
        own = self.domains().filter("nation is not null")
        docs = self.table("documents").select("doc_id", "text", "lang")
        joined = docs.join(F.broadcast(own), docs.doc_id % 25 == own.nation)
        ext = F.coalesce(F.get(F.filter(F.array(*[F.when(F.col("lang") == k, v) for k, v in EXTENSION.items()]), lambda x: x.isNotNull()), F.lit(0)), F.lit("txt"))
        path = F.concat("root_path", F.lit("/"), _pick(ARCHETYPE_DIRS, F.col("doc_id") % 8), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
        return joined.select(
            F.col("doc_id").alias("file_id"),
            F.col("name").alias("domain"),
            path.alias("path"),
            F.sha2("text", 256).alias("content_hash"),
            F.size(F.split("text", "\n")).alias("line_count"),
            F.octet_length("text").cast("bigint").alias("size_bytes"),
            ext.alias("ext"),
        )

    def symbols(self) -> DataFrame:
        """file_id, name, container, kind, visibility, line_start, line_end, line_count, nesting_depth."""
        n = self.table("documents").count()
        item, part = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), self.table("part").select("p_partkey", "p_brand")
        box = F.replace("p_brand", F.lit("#"), F.lit(""))
        key = F.col("l_partkey").cast("string")
        kind = _pick(KINDS, F.col("l_partkey") % 4)
        name = F.when(kind == "class", box).when(kind == "method", F.concat(box, F.lit("::m"), key)).when(kind == "function", F.concat(F.lit("fn_"), key)).otherwise(F.concat(box, F.lit("::p"), key))
        start = (F.col("l_linenumber") - 1) * 50 + 1
        lines = F.col("l_quantity").cast("int")
        return item.join(part, item.l_partkey == part.p_partkey).select(
            (F.col("l_orderkey") % n).alias("file_id"),
            name.alias("name"),
            F.when(kind.isin("method", "property"), box).alias("container"),
            kind.alias("kind"),
            _pick(VISIBILITY, F.col("l_suppkey") % 3).alias("visibility"),
            start.alias("line_start"),
            (start + lines - 1).alias("line_end"),
            lines.alias("line_count"),
            (1 + F.col("l_partkey") % 6).cast("int").alias("nesting_depth"),
        )

    def dependencies(self) -> DataFrame:
        """source_id, target, line_number, is_external: the links of pages as raw imports."""
        n = self.table("documents").count()
        found = self.table("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "target"))
        return found.select((F.col("page_id") % n).alias("source_id"), "target", (F.col("pos") + 1).alias("line_number"), F.col("target").startswith("http").alias("is_external"))

    def file_edges(self) -> DataFrame:
        """src, dst, weight: the two most frequent successors of each part within orders."""
        after = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        steps = self.table("lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(after).alias("dst")).filter("dst is not null and src <> dst")
        rank = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
        return steps.groupBy("src", "dst").agg(F.count("*").alias("weight")).withColumn("k", F.row_number().over(rank)).filter("k <= 2").drop("k")

    def domain_edges(self) -> DataFrame:
        """src, dst, weight: the three most frequent supplier nations of each customer nation."""
        customer, supplier, orders, item = (self.table(t) for t in ("customer", "supplier", "orders", "lineitem"))
        nation = self.table("nation").select("n_nationkey", F.lower("n_name").alias("name"))
        buys = item.select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        pairs = buys.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        counted = pairs.filter("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("weight"))
        rank = Window.partitionBy("c_nationkey").orderBy(F.desc("weight"), "s_nationkey")
        top = counted.withColumn("k", F.row_number().over(rank)).filter("k <= 3")
        a = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("name").alias("src"))
        b = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("name").alias("dst"))
        return top.join(F.broadcast(a), "c_nationkey").join(F.broadcast(b), "s_nationkey").select("src", "dst", "weight")

    def slices(self) -> DataFrame:
        """slice_id, http_method, route_uri, route_name, conv_id."""
        convs = self.table("conversations").select("conv_id").distinct().count()
        path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
        uri = F.regexp_replace(path, "[0-9]+", "{id}")
        method = _pick(METHODS, F.col("page_id") % 4)
        name = F.concat_ws(".", F.lower(method), F.regexp_replace(uri, "[^A-Za-z0-9]+", "_"))
        return self.table("pages").select(F.col("page_id").alias("slice_id"), method.alias("http_method"), uri.alias("route_uri"), name.alias("route_name"), (F.col("page_id") % convs).alias("conv_id"))

    def chain_nodes(self) -> DataFrame:
        """conv_id, seq, stage, symbol: turns of a conversation as nodes of a chain."""
        turns = self.table("conversations").select("conv_id", "turn", "role")
        return turns.select("conv_id", F.col("turn").alias("seq"), _pick(STAGES, (F.col("conv_id") * 3 + F.col("turn")) % 8).alias("stage"), F.concat(F.col("role"), F.lit("_"), F.col("turn").cast("string")).alias("symbol"))


#: The same tables as CTEs, for the second engine.
SQL = {
    "domains": """domains AS (
  SELECT lower(n_name) AS name, lower(replace(r_name,' ','_')) || '/' || lower(n_name) AS root_path, n_nationkey AS nation FROM nation JOIN region ON n_regionkey=r_regionkey
  UNION ALL SELECT lower(replace(r_name,' ','_')), lower(replace(r_name,' ','_')), NULL FROM region)""",
    "policy": """policy AS (
  SELECT lower(a.n_name) AS src, lower(b.n_name) AS dst, (a.n_nationkey*3+b.n_nationkey)%5=0 AS forbidden,
    (a.n_nationkey*3+b.n_nationkey)%5<>0 AND (a.n_nationkey+b.n_nationkey)%2=0 AS allowed FROM nation a, nation b WHERE a.n_nationkey<>b.n_nationkey)""",
    "files": """files AS (
  SELECT doc_id AS file_id, name AS domain, root_path || '/' || (['controllers','services','models','repositories','actions','jobs','listeners','helpers'])[doc_id%8+1]
    || '/doc_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'ts' WHEN 'de' THEN 'go' WHEN 'es' THEN 'php' ELSE 'txt' END AS path,
    sha256(text) AS content_hash, len(string_split(text, chr(10)))::INT AS line_count, strlen(text) AS size_bytes,
    CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'ts' WHEN 'de' THEN 'go' WHEN 'es' THEN 'php' ELSE 'txt' END AS ext
  FROM documents JOIN domains ON doc_id%25=nation)""",
    "symbols": """symbols AS (
  SELECT l_orderkey % (SELECT count(*) FROM documents) AS file_id,
    CASE l_partkey%4 WHEN 0 THEN box WHEN 1 THEN box||'::m'||l_partkey WHEN 2 THEN 'fn_'||l_partkey ELSE box||'::p'||l_partkey END AS name,
    CASE WHEN l_partkey%4 IN (1,3) THEN box END AS container, (['class','method','function','property'])[l_partkey%4+1] AS kind,
    (['public','protected','private'])[l_suppkey%3+1] AS visibility, (l_linenumber-1)*50+1 AS line_start, (l_linenumber-1)*50+l_quantity::INT AS line_end,
    l_quantity::INT AS line_count, (1+l_partkey%6)::INT AS nesting_depth
  FROM lineitem JOIN (SELECT p_partkey, replace(p_brand,'#','') AS box FROM part) ON l_partkey=p_partkey)""",
    "dependencies": """dependencies AS (
  SELECT page_id % (SELECT count(*) FROM documents) AS source_id, target, line_number, starts_with(target,'http') AS is_external
  FROM (SELECT page_id, unnest(l) AS target, unnest(range(1, len(l)+1)) AS line_number FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages)))""",
    "file_edges": """file_edges AS (
  SELECT src, dst, weight FROM (SELECT src, dst, count(*) AS weight, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS k FROM
    (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src<>dst GROUP BY src, dst) WHERE k<=2)""",
    "domain_edges": """domain_edges AS (
  SELECT lower(a.n_name) AS src, lower(b.n_name) AS dst, weight FROM (
    SELECT c_nationkey AS s, s_nationkey AS d, count(*) AS weight, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, s_nationkey) AS k
    FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey WHERE c_nationkey<>s_nationkey GROUP BY 1,2)
  JOIN nation a ON s=a.n_nationkey JOIN nation b ON d=b.n_nationkey WHERE k<=3)""",
    "slices": """slices AS (
  SELECT page_id AS slice_id, http_method, route_uri, lower(http_method)||'.'||regexp_replace(route_uri,'[^A-Za-z0-9]+','_','g') AS route_name, page_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS conv_id
  FROM (SELECT page_id, (['GET','POST','PUT','DELETE'])[page_id%4+1] AS http_method, regexp_replace(regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1),'[0-9]+','{id}','g') AS route_uri FROM pages))""",
    "chain_nodes": """chain_nodes AS (
  SELECT conv_id, turn AS seq, (['egress','repository','service','validation','ingress','entity','controller','job'])[(conv_id*3+turn)%8+1] AS stage, role||'_'||turn AS symbol FROM conversations)""",
}
NEEDS = {"files": ("domains",)}


def with_tables(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the named tables and what they need; more CTEs may follow a comma."""
    order: list[str] = []
    for name in names:
        for need in (*NEEDS.get(name, ()), name):
            if need not in order:
                order.append(need)
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(SQL[n] for n in order)

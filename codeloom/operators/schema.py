"""Fields of entities, folded from an ordered stream of schema changes.

A migration's lines are changes; a field's last definition wins and keeps the
place of its first. Changes that only fill in what is missing (time stamps and
the like) yield to any definition. The fold needs no order of execution: a
field's state is the last of its definitions, else the first of its fillers,
and its place the least of all, each an aggregate that combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.lines import explode_lines
from codeloom.functions.text import table_name

# Calls on a table that define no column, and those that fill in columns, with what they add.
NO_COLUMN = ("index", "unique", "primary", "foreign", "dropColumn", "dropForeign")
FILLERS = {"timestamps": (("created_at", "timestamp"), ("updated_at", "timestamp")), "softDeletes": (("deleted_at", "timestamp"),), "rememberToken": (("remember_token", "string"),)}
FIELD = "struct<type:string,nullable:boolean,is_primary:boolean,is_foreign:boolean>"


def fold(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, name, field, place) of changes (key, name, field, fills and ``order``): places from 1 within a key."""
    at = F.struct(*order)
    defined = F.max_by("field", F.when(~F.col("fills"), at))
    filled = F.min_by("field", F.when(F.col("fills"), at))
    state = changes.groupBy(key, "name").agg(defined.alias("defined"), filled.alias("filled"), F.min(at).alias("first"))
    # An entity has as many rows here as fields.
    rank = F.row_number().over(Window.partitionBy(key).orderBy("first", "name"))
    return state.select(key, "name", F.coalesce("defined", "filled").alias("field"), rank.alias("place"))


def _field(type_: Column, nullable: Column, primary: Column, foreign: Column) -> Column:
    return F.struct(type_.alias("type"), nullable.alias("nullable"), primary.alias("is_primary"), foreign.alias("is_foreign")).cast(FIELD)


def migration_changes(files: DataFrame) -> DataFrame:
    """(path, line_number, at, name, field, fills) of every line of migrations (path, content) that defines columns."""
    no, yes = F.lit(False), F.lit(True)
    lines = explode_lines(files, "path").filter(F.contains("line", F.lit("$table->")))
    own_id = F.regexp_extract("line", r"\$table->id\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1)
    call = lambda i: F.regexp_extract("line", r"\$table->([a-zA-Z0-9_]+)\s*\(\s*['\"]([^'\"]+)['\"]", i)
    kind, column = call(1), call(2)
    one = lambda name, field, fills: F.array(F.struct(name.alias("name"), field.alias("field"), fills.alias("fills")))
    id_ = _field(F.lit("id"), no, yes, no)
    found = F.when(F.col("line").rlike(r"\$table->id\s*\(\s*\)"), one(F.lit("id"), id_, no)).when(own_id != "", one(own_id, id_, no))
    for name, columns in FILLERS.items():
        added = F.array(*[F.struct(F.lit(c).alias("name"), _field(F.lit(t), yes, no, no).alias("field"), yes.alias("fills")) for c, t in columns])
        found = found.when(F.col("line").rlike(rf"\$table->{name}\s*\("), added)
    primary = kind.isin("increments", "bigIncrements") | F.contains("line", F.lit("->primary()"))
    defined = _field(kind, F.contains("line", F.lit("->nullable()")), primary, kind.startswith("foreign") | column.endswith("_id"))
    found = found.when((kind != "") & ~kind.isin(*NO_COLUMN), one(column, defined, no))
    return lines.select("path", "line_number", F.posexplode(found).alias("at", "c")).select("path", "line_number", "at", "c.name", "c.field", "c.fills")


def entity_tables(entities: DataFrame) -> DataFrame:
    """(entity, table) of entities (entity, content): the model's own ``$table``, else its name in snake case and plural."""
    own = F.regexp_extract(F.coalesce("content", F.lit("")), r"protected\s+\$table\s*=\s*['\"]([^'\"]+)['\"]", 1)
    return entities.select("entity", F.when(own != "", own).otherwise(table_name(F.col("entity"))).alias("table"))


def migration_files(tables: DataFrame, files: DataFrame) -> DataFrame:
    """(entity, path, rank) of the migrations that concern each table: those that create it, then those named after it, by name; else those whose text names it."""
    stem = F.element_at(F.split("path", "/"), -1)
    parts = F.split(F.regexp_replace(stem, r"\.php\z", ""), "_")
    # Every run of words between underscores is asked for as a table's name.
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda a: F.transform(F.sequence(a, F.greatest(F.size(parts) - 1, a)), lambda b: F.array_join(F.slice(parts, a, b - a + 1), "_"))))
    named = files.filter(F.col("path").endswith(".php")).select("path", F.explode(F.array_distinct(runs)).alias("table"))
    creates = F.col("path").endswith(F.concat(F.lit("_create_"), "table", F.lit("_table.php")))
    by_name = tables.join(named, "table").select("entity", "path", F.when(creates, 0).otherwise(1).alias("rank"))
    said = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"Schema::(?:create|table)\(['\"]([^'\"]+)['\"]"), F.lit(1)))).alias("table"))
    by_text = tables.join(by_name.select("entity").distinct(), "entity", "left_anti").join(said, "table").select("entity", "path", F.lit(2).alias("rank"))
    return by_name.unionByName(by_text)


def migrated_fields(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(entity, table, name, field, place) of entities (entity, content) by the migrations (path, content); an entity without any has no rows."""
    tables = entity_tables(entities)
    own = migration_files(tables, files)
    changes = migration_changes(files.join(own.select("path").distinct(), "path", "left_semi"))
    ordered = own.join(changes, "path")
    return fold(ordered, "entity", ["rank", "path", "line_number", "at"]).join(tables, "entity").select("entity", "table", "name", "field", "place")


def prisma_fields(files: DataFrame) -> DataFrame:
    """(path, entity, table, name, field, place) of every model in Prisma schemas (path, content)."""
    pattern = r"(?m)\bmodel\s+(\w+)\s*\{([^}]+)\}"
    models = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("entity"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("body"))
    bodies = files.select("path", F.explode(models).alias("m")).select("path", "m.entity", F.posexplode(F.split("m.body", "\r\n|\n|\r")).alias("at", "raw")).withColumn("line", F.trim(F.replace("raw", F.lit("\t"), F.lit(" "))))
    words = F.split("line", r"\s+")
    kept = bodies.filter((F.col("line") != "") & ~F.col("line").startswith("//") & ~F.col("line").startswith("@@") & (F.size(words) >= 2))
    kind = F.get(words, F.lit(1))
    field = _field(F.regexp_replace(kind, r"\?\z", ""), kind.endswith("?"), F.contains("line", F.lit("@id")), F.contains("line", F.lit("@relation")))
    changes = kept.select(F.struct("path", "entity").alias("model"), F.get(words, F.lit(0)).alias("name"), field.alias("field"), F.lit(False).alias("fills"), "at")
    return fold(changes, "model", ["at"]).select("model.path", "model.entity", F.lower("model.entity").alias("table"), "name", "field", "place")

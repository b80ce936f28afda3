"""Vertical slices: the match cascade, token scores, and ordered chains."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import normalise_uri, stage_rank


def match(slices: DataFrame, query: str) -> DataFrame:
    """Slices that a query names, with the rank of the way it does: method and URI as written, with parameters alike, URI alone, route name."""
    found = re.match(r"^\s*([A-Za-z]+)\s+(\S+)\s*$", query)
    method, uri = (found[1].upper(), found[2]) if found else (None, query.strip())
    alike = F.lit(uri)
    rank = F.when((F.col("http_method") == F.lit(method)) & (F.col("route_uri") == uri), 1)
    rank = rank.when((F.col("http_method") == F.lit(method)) & (normalise_uri(F.col("route_uri")) == normalise_uri(alike)), 2)
    rank = rank.when(F.col("route_uri") == uri, 3)
    name = f"{(method or '').lower()}.{re.sub('[^A-Za-z0-9]+', '_', uri)}" if method else uri
    return slices.withColumn("match_rank", rank.when(F.col("route_name") == name, 4)).filter("match_rank is not null")


def trace(slices: DataFrame, query: str, key: str = "slice_id") -> DataFrame:
    """Slices that a query names, by the first step that names any: with ``step``, ``confidence`` and ``role``.

    Steps: method and URI, literal else with parameters alike (1); URI, literal
    else alike (2); route name (3); a trigger such as ``JOB name`` (4);
    ``Controller@action``, or a controller alone (5); a symbol or file of the
    chain, the action or the controller (6). A method with a URI looks no
    further than its step. ``slices`` has http_method, route_uri, route_name,
    controller_class, action_name and chain, an array of (symbol, file). Of
    several the least by ``key`` is ``primary``; steps 3 to 6 give that one
    alone. One pass over the slices; nothing matches null columns.
    """
    asked = query.strip()
    low = asked.lower()
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    none = F.lit(False)
    uri = F.coalesce("route_uri", F.lit(""))
    alike = lambda u: normalise_uri(uri) == normalise_uri(F.lit(u))
    verbed = re.fullmatch(r"(?i)(GET|POST|PUT|PATCH|DELETE)\s+(/\S+)", asked)
    tests: list[tuple[int, Column, Column]] = []  # step, whether it fits, whether literally
    if verbed:
        same = F.upper("http_method") == verbed[1].upper()
        tests.append((1, same & alike(verbed[2]), same & (uri == verbed[2])))
    else:
        tests.append((2, alike(asked), uri == asked))
        name = text(F.col("route_name"))
        tests.append((3, (name != "") & (name == low), name == low))
        trigger = re.fullmatch(r"(?i)(JOB|CLI|EVENT)\s+([A-Za-z0-9_:-]+)", asked)
        if trigger:
            kind, target = trigger[1], trigger[2].lower()
            names = (text(F.col("controller_class")) == target) | text(uri).isin(target, f"{kind.lower()}:{target}")
            tests.append((4, (F.upper("http_method") == kind.upper()) & names, names))
        action = re.fullmatch(r"([A-Za-z0-9_\\/.]+?)(?:(?:@|::)([A-Za-z0-9_]+))?", asked)
        if action:
            owner = re.sub(r"(?i)\.(?:php|ts|js)$", "", re.split(r"[\\/]", action[1])[-1]).lower()
            cls = text(F.col("controller_class"))
            fits = (cls == owner) | cls.endswith("\\" + owner) | cls.endswith("/" + owner)
            if action[2]:
                fits = fits & (text(F.col("action_name")) == action[2].lower())
            elif not owner.endswith("controller"):
                fits = fits & (cls == owner)
            tests.append((5, fits & (F.lit(owner) != ""), fits))
        inside = F.exists(F.coalesce("chain", F.array().cast("array<struct<symbol:string,file:string>>")), lambda n: F.contains(text(n["symbol"]), F.lit(low)) | F.contains(text(n["file"]), F.lit(low)))
        tests.append((6, ((text(F.col("action_name")) == low) | (text(F.col("controller_class")) == low) | inside) & F.lit(low != ""), none))
    # A literal match comes before one that is alike.
    place = F.coalesce(*[x for step, fits, exact in tests for x in ([F.when(fits & exact, 2 * step), F.when(fits, 2 * step + 1)])])
    met = slices.withColumn("place", place).filter("place is not null")
    least = met.agg(F.min("place").alias("place"))
    best = met.join(F.broadcast(least), "place")  # one row
    one, many = "first_" + key, "many_" + key
    facts = best.groupBy("place").agg(F.min(key).alias(one), (F.count("*") > 1).alias(many))  # one row
    step = F.floor(F.col("place") / 2).cast("int")
    # A method's URI that several slices have is no exact answer.
    exact = (F.col("place") % 2 == 0) & ~((step == 1) & F.col(many))
    shown = best.join(F.broadcast(facts), "place").withColumn("role", F.when(F.col(key) == F.col(one), "primary").otherwise("alternative")).withColumn("confidence", F.when(exact, "exact").otherwise("inferred")).withColumn("step", step)
    return shown.filter((F.col("role") == "primary") | (F.col("step") <= 2)).drop("place", one, many)


def token_score(query: str, corpus: Column, uri: Column, action: Column) -> Column:
    """One point for each word of the query in a slice's text, two more if in its URI, two more if in its action."""
    from codeloom.functions.text import STOP_WORDS

    words = re.sub(r"[^a-z0-9_]+", " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", query).lower()).split()
    total = F.lit(0)
    for w in words:
        if len(w) > 2 and w not in STOP_WORDS:
            has = lambda c: F.contains(F.lower(c), F.lit(w)).cast("int")  # noqa: B023, E731
            total = total + has(corpus) * (1 + 2 * has(uri) + 2 * has(action))
    return total.cast("bigint")


def ordered_chains(nodes: DataFrame, key: str) -> DataFrame:
    """Each chain's nodes (stage, symbol) by stage rank, then by their own order."""
    node = F.struct(stage_rank(F.col("stage")).alias("rank"), "seq", "stage", "symbol")
    return nodes.groupBy(key).agg(F.array_sort(F.collect_list(node)).alias("chain"))


def ranked(slices: DataFrame, score: Column, most: int = 4, key: str = "slice_id") -> DataFrame:
    """The slice that scores best (``primary``) and the next three (``alternative``), ties by id.

    When no slice scores, the first five by id are the alternatives and
    ``found`` is false. Both are top-k plans; neither sorts the whole table.
    """
    scored = slices.withColumn("score", score)
    best = scored.filter("score > 0").orderBy(F.desc("score"), key).limit(most).withColumn("found", F.lit(True))
    other = scored.orderBy(key).limit(5).withColumn("found", F.lit(False)).join(F.broadcast(best.select(F.lit(False).alias("found")).limit(1)), "found", "left_anti")
    first = F.row_number().over(Window.partitionBy("found").orderBy(F.desc("score"), key)) == 1
    return best.unionByName(other).withColumn("role", F.when(F.col("found") & first, "primary").otherwise("alternative"))


def derived_feature(slices: DataFrame, nodes: DataFrame, term: str, key: str = "conv_id") -> DataFrame:
    """Touchpoints and symbols of the slices whose URI or name holds ``term``: (kind, value), each once.

    A slice counts once per method and URI, the last by id. ``nodes`` is its
    chain's (key, symbol, file); null symbols and files are left out.
    """
    asked = F.lit(term.lower())
    fits = slices.filter(F.contains(F.lower("route_uri"), asked) | F.contains(F.lower("route_name"), asked))
    last = fits.groupBy("http_method", "route_uri").agg(F.max_by(key, "slice_id").alias(key))
    met = nodes.join(last.select(key).distinct(), key, "left_semi")
    each = F.explode(F.array(F.struct(F.lit("touchpoint").alias("kind"), F.col("file").alias("value")), F.struct(F.lit("symbol").alias("kind"), F.col("symbol").alias("value"))))
    return met.select(each.alias("x")).select("x.kind", "x.value").filter("value is not null").distinct()

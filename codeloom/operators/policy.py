"""Boundary policy: violations of a domain graph, touchpoints, and the three-valued verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import touchpoint_regex
from codeloom.operators.graph import strong_components


def audit(edges: DataFrame, policy: DataFrame, strict: bool = True) -> DataFrame:
    """Violations of domain edges (src, dst): forbidden first, else, when strict, not allowed."""
    met = edges.filter("src <> dst").join(policy, ["src", "dst"], "left")
    forbidden, allowed = F.coalesce("forbidden", F.lit(False)), F.coalesce("allowed", F.lit(False))
    rule = F.when(forbidden, "forbidden_dependency").when(F.lit(strict) & ~allowed, "disallowed_dependency")
    return met.withColumn("rule", rule).filter("rule is not null").drop("forbidden", "allowed")


def breakdown(violations: DataFrame) -> DataFrame:
    """Violations per "src -> dst" pair."""
    return violations.groupBy(F.concat_ws(" -> ", "src", "dst").alias("pair")).agg(F.count("*").alias("n"))


def touchpoints(paths: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """Whether each path fits one of a feature's touchpoint patterns."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | F.col(path).rlike(touchpoint_regex(p))
    return paths.withColumn("allowed", fits)


def verdict(violations: Column, incomplete: Column) -> Column:
    """Rejected with a violation; else unknown while the graph is incomplete; else approved."""
    return F.when(violations > 0, "rejected").when(incomplete > 0, "unknown").otherwise("approved")


def staged_audit(baseline: DataFrame, staged: DataFrame, policy: DataFrame, strict: bool = True) -> DataFrame:
    """Violations of a commit: the baseline's edges (file, src, dst) without the staged files', and the staged files' own.

    ``staged`` has file, status (D for deleted), src and dst; only edges of
    staged files are reported.
    """
    touched = staged.select("file").distinct()
    own = staged.filter("status <> 'D' and dst is not null").select("file", "src", "dst")
    after = baseline.select("file", "src", "dst").join(touched, "file", "left_anti").unionByName(own)
    return audit(after, policy, strict).join(touched, "file", "left_semi")


def staged_cycles(baseline: DataFrame, staged: DataFrame) -> DataFrame:
    """(src, dst, component) of domain edges on a cycle after a commit, where a staged file has the edge; arguments as in :func:`staged_audit`.

    Cycles have any length; a component is named by its least domain.
    """
    touched = staged.select("file").distinct()
    own = staged.filter("status <> 'D' and dst is not null").select("src", "dst").distinct()
    after = baseline.join(touched, "file", "left_anti").select("src", "dst").unionByName(own).filter("src <> dst").distinct()
    on = strong_components(after)
    met = own.filter("src <> dst").join(on.select(F.col("node").alias("src"), "component"), "src").join(on.select(F.col("node").alias("dst"), F.col("component").alias("there")), "dst")
    return met.filter("component = there").select("src", "dst", "component")


def proposed(imports: DataFrame, domains: DataFrame, policy: DataFrame, strict: bool = True) -> DataFrame:
    """Violations of proposed imports (file, src, dst, line): an unmapped source is one violation at line 1."""
    known = domains.select(F.col("name").alias("src"), F.lit(True).alias("mapped"))
    rows = imports.join(known, "src", "left")
    unmapped = rows.filter("mapped is null").select("file").distinct().select("file", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(1).alias("line"), F.lit("unmapped_domain").alias("rule"))
    return audit(rows.filter("mapped").drop("mapped"), policy, strict).select("file", "src", "dst", "line", "rule").unionByName(unmapped)


def touchpoint_violations(changes: DataFrame, feature: str, features: dict[str, list[str]]) -> DataFrame:
    """A violation for each changed ``file`` outside the feature's touchpoints; an unknown feature allows none."""
    known = feature in features
    rule = "touchpoint_violation" if known else "unknown_feature"
    outside = touchpoints(changes.select("file").distinct(), "file", features.get(feature, [])).filter(~F.col("allowed"))
    return outside.select("file", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(1).alias("line"), F.lit(rule).alias("rule"))


def evaluate(imports: DataFrame, domains: DataFrame, policy: DataFrame, feature: str | None = None, features: dict[str, list[str]] | None = None, strict: bool = True) -> DataFrame:
    """A change's violations: files outside a feature's touchpoints, then what its proposed imports violate."""
    found = proposed(imports, domains, policy, strict)
    return found if feature is None else touchpoint_violations(imports, feature, features or {}).unionByName(found)


def full_audit(edges: DataFrame, policy: DataFrame, cycles: DataFrame, strict: bool = True) -> DataFrame:
    """All violations of a domain graph (src, dst, rule, cycle): of the policy, and one for each cycle.

    A cycle ``a -> b -> ... -> a`` counts from its first node to its second.
    """
    own = audit(edges, policy, strict).select("src", "dst", "rule", F.lit(None).cast("string").alias("cycle"))
    nodes = F.split("cycle", " -> ")
    return own.unionByName(cycles.select(F.get(nodes, F.lit(0)).alias("src"), F.get(nodes, F.lit(1)).alias("dst"), F.lit("circular_dependency").alias("rule"), "cycle"))


def check_scope(scope: str | None = None, file: str | None = None, files: tuple[str, ...] = (), domain: str | None = None, staged: bool = False, proposed_imports: tuple[str, ...] = ()) -> str:
    """The scope of a boundary check (file, staged, domain or all); arguments that contradict it raise ``ValueError``."""
    targets = file is not None or bool(files)
    chosen = scope or ("staged" if staged else "file" if targets else "domain" if domain else "all")
    wrong = {
        "unknown scope": chosen not in ("file", "staged", "domain", "all"),
        "one file or several, not both": file is not None and bool(files),
        "blank file": any(not f.strip() for f in (*files, *([file] if file is not None else []))),
        "staged needs the scope staged": staged and chosen != "staged",
        "the scope file needs a file": chosen == "file" and not targets,
        f"the scope {chosen} takes no files": chosen != "file" and targets,
        "the scope domain needs a domain": chosen == "domain" and not domain,
        "the scope all takes no domain": chosen == "all" and bool(domain),
        "proposed imports need the scope file": chosen != "file" and bool(proposed_imports),
    }
    reasons = [reason for reason, holds in wrong.items() if holds]
    if reasons:
        raise ValueError("; ".join(reasons))
    return chosen


def of_domain(violations: DataFrame, domain: str) -> DataFrame:
    """Violations that have the domain on either side."""
    return violations.filter((F.col("src") == domain) | (F.col("dst") == domain))


def relevant(files: DataFrame, domain: str | None = None, requested: tuple[str, ...] = ()) -> DataFrame:
    """Files (path, domain) that a check of a domain and of requested files concerns; no request means all."""
    fits = F.lit(True)
    if domain is not None:
        fits = fits & (F.col("domain") == domain)
    if requested:
        fits = fits & F.col("path").isin(*requested)
    return files.filter(fits)

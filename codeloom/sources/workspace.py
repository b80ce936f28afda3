"""A tree of source files as a DataFrame: scan, admission, bounded read, fingerprints."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import is_ignored, language

#: A source file of more bytes is recorded as skipped and not read.
MAX_BYTES = 2 * 1024 * 1024


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """path (relative), language, size_bytes, mtime_ms, content, content_hash, line_count, skipped of every source file below a root.

    The listing is Spark's own, so the root may be in any store that Spark
    reads. Ignored paths and other files are dropped before the content is
    decoded; a file beyond the bound keeps its row, without content.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/+", "/", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base) + "/", "")
    rows = found.select(path.alias("path"), "length", "modificationTime", "content").withColumn("language", language(F.col("path")))
    own = rows.filter(F.col("language").isNotNull() & ~is_ignored(F.col("path"), ignore))
    fits = F.col("length") <= MAX_BYTES
    text = F.when(fits, F.decode("content", "UTF-8"))
    return own.select(
        "path",
        "language",
        F.col("length").alias("size_bytes"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
        text.alias("content"),
        F.sha2(F.when(fits, F.col("content")), 256).alias("content_hash"),
        F.size(F.split(text, "\n")).alias("line_count"),
        F.when(~fits, "file_too_large").alias("skipped"),
    )


def inventory_fingerprint(files: DataFrame) -> DataFrame:
    """One digest of a workspace: of the digests of its folders of 4,096 by the path's hash, in order.

    Each folder's digest is that of its sorted ``path:hash`` lines joined by
    commas; so no task holds all lines, and equal workspaces have equal digests.
    """
    dealt = files.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("folder")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "content_hash"))), ","), 256).alias("digest"))
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "folder", "digest")))
    return dealt.agg(F.sha2(F.array_join(lines, ","), 256).alias("fingerprint"))


def parse_env(text: str) -> dict[str, str]:
    """The variables of a ``.env`` file: no comments, quotes taken off."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = line.split("=", 1)
            value = value.strip()
            out[key.removeprefix("export ").strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def parse_json_with_comments(text: str):
    """JSON that may have ``//`` and ``/* */`` comments and trailing commas, outside strings."""
    parts = re.split(r'("(?:[^"\\]|\\.)*")', text)
    plain = [p if i % 2 else re.sub(r"//[^\n]*|/\*.*?\*/", "", p, flags=re.S) for i, p in enumerate(parts)]
    joined = "".join(plain)
    parts = re.split(r'("(?:[^"\\]|\\.)*")', joined)
    return json.loads("".join(p if i % 2 else re.sub(r",(\s*[}\]])", r"\1", p) for i, p in enumerate(parts)))


def parse_go_mod(text: str) -> tuple[str | None, list[str]]:
    """The module path and the required modules of a ``go.mod``."""
    bare = re.sub(r"//[^\n]*", "", text)
    module = re.search(r"^\s*module\s+(\S+)", bare, re.M)
    wanted = re.findall(r"^\s*require\s+([^\s(]+)\s+v", bare, re.M)
    for block in re.findall(r"^\s*require\s*\((.*?)\)", bare, re.M | re.S):
        wanted += re.findall(r"^\s*(\S+)\s+v", block, re.M)
    return (module[1] if module else None), wanted

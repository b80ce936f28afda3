"""Staged files of a git repository as a Spark data source.

``spark.dataSource.register(StagedFiles)`` and then
``spark.read.format("git_staged").load(root)`` give (path, status, size_bytes,
content): what the index adds, copies, modifies or renames with its staged
content, and what it deletes without. The driver lists names; contents are read
by tasks, a batch of files each. ``root`` may be a folder of the repository, of
which only the part below is read, with paths relative to it.

Cases: nothing staged gives no rows; bytes that are no UTF-8 are replaced; a
file of more than ``max_bytes`` (an option) has a null content and its size, and
:func:`checked` refuses it.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, status string, size_bytes bigint, content string"
MAX_BYTES, FILES = 1 << 20, 64


def _git(root: str, *args: str, given: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", root, *args], input=given, capture_output=True, check=True, timeout=300).stdout


@dataclass
class Chunk(InputPartition):
    """Names that one task reads: status, path in the repository, path shown."""

    files: list[tuple[str, str, str]]


class StagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.most, self.files = int(options.get("max_bytes", MAX_BYTES)), int(options.get("files", FILES))

    def partitions(self) -> list[Chunk]:
        prefix = _git(self.root, "rev-parse", "--show-prefix").decode().strip()
        parts = _git(self.root, "diff", "--cached", "--name-status", "-z", "--diff-filter=ACMRD").decode("utf-8", "replace").split("\0")
        found, at = [], 0
        while at + 1 < len(parts):
            status = parts[at][:1]
            moved = status in "RC"  # old and new name follow
            name = parts[at + 1 + moved]
            at += 2 + moved
            if name.startswith(prefix):
                found.append((status, name, name[len(prefix) :]))
        found.sort(key=lambda f: f[1])
        return [Chunk(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [Chunk([])]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        kept = [f for f in chunk.files if f[0] != "D"]
        asked = "".join(f":{name}\n" for _, name, _ in kept).encode()
        top = _git(self.root, "rev-parse", "--show-toplevel").decode().strip() if chunk.files else self.root
        # Sizes first, so that no large blob is read.
        sizes = [int(line.split()[-1]) for line in _git(top, "cat-file", "--batch-check", given=asked).decode().splitlines()] if kept else []
        small = [f for f, n in zip(kept, sizes, strict=True) if n <= self.most]
        data = _git(top, "cat-file", "--batch", given="".join(f":{name}\n" for _, name, _ in small).encode()) if small else b""
        contents, at = {}, 0
        for _, name, _ in small:
            head = data.index(b"\n", at)
            size = int(data[at:head].split()[-1])
            contents[name] = data[head + 1 : head + 1 + size].decode("utf-8", "replace")
            at = head + size + 2
        size_of = dict(zip([f[1] for f in kept], sizes, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[2] for f in chunk.files], pa.string()), pa.array([f[0] for f in chunk.files], pa.string()), pa.array([size_of.get(f[1]) for f in chunk.files], pa.int64()), pa.array([contents.get(f[1]) for f in chunk.files], pa.string())],
            ["path", "status", "size_bytes", "content"],
        )


class StagedFiles(DataSource):
    """The data source; its options are ``path``, ``max_bytes`` and ``files`` (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "git_staged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StagedReader:
        return StagedReader(dict(self.options))


def checked(staged: DataFrame, is_source: Column) -> DataFrame:
    """Staged rows, failing on a source that was too large to read."""
    large = is_source & (F.col("status") != "D") & F.col("content").isNull()
    return staged.withColumn("content", F.when(large, F.raise_error(F.concat(F.lit("staged source exceeds its limit: "), "path"))).otherwise(F.col("content")))

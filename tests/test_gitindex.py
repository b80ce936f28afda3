"""Staged files from a git index, and their audit with cycles."""

import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.operators import policy
from codeloom.sources.gitindex import StagedFiles, checked

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="no git here")


@pytest.fixture()
def root(tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode() if isinstance(text, str) else text)

    git("init", "-q")
    for name in ("pkg/a.py", "pkg/gone.py", "pkg/moved.py", "top.py"):
        put(name, f"# {name}\n" * 5)
    git("add", ".")
    git("commit", "-qm", "first")
    put("pkg/a.py", "import b  # staged\n")
    put("pkg/neu ü.py", "x = 1\n")
    put("pkg/big.py", "y" * 5000)
    put("pkg/raw.bin", b"\xff\xfe\n\x00")
    put("top.py", "changed\n")
    git("mv", "pkg/moved.py", "pkg/after.py")
    git("rm", "-q", "pkg/gone.py")
    git("add", ".")
    put("pkg/a.py", "not staged\n")
    return tmp_path


def test_staged_rows(spark, root):
    spark.dataSource.register(StagedFiles)
    rows = {r.path: r for r in spark.read.format("git_staged").option("max_bytes", 1000).option("files", 2).load(str(root)).collect()}
    assert {p: r.status for p, r in rows.items()} == {"pkg/a.py": "M", "pkg/neu ü.py": "A", "pkg/big.py": "A", "pkg/raw.bin": "A", "top.py": "M", "pkg/after.py": "R", "pkg/gone.py": "D"}
    assert rows["pkg/a.py"].content == "import b  # staged\n" and rows["pkg/neu ü.py"].content == "x = 1\n"
    assert (rows["pkg/big.py"].content, rows["pkg/big.py"].size_bytes) == (None, 5000) and rows["pkg/gone.py"].content is None
    below = spark.read.format("git_staged").load(str(root / "pkg"))
    assert {r.path for r in below.collect()} == {"a.py", "neu ü.py", "big.py", "raw.bin", "after.py", "gone.py"}
    with pytest.raises(Exception, match=r"exceeds its limit: pkg/big\.py"):
        checked(spark.read.format("git_staged").option("max_bytes", 1000).load(str(root)), F.col("path").endswith(".py")).collect()


def test_nothing_staged(spark, tmp_path):
    subprocess.run(["git", "-C", str(tmp_path), "init", "-q"], check=True)
    spark.dataSource.register(StagedFiles)
    assert spark.read.format("git_staged").load(str(tmp_path)).collect() == []


def test_cycles_of_a_commit(spark):
    base = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "a"), ("4", "x", "y"), ("5", "y", "x")], "file string, src string, dst string")
    staged = spark.createDataFrame([("3", "M", "c", "d"), ("6", "A", "d", "b"), ("7", "D", None, None)], "file string, status string, src string, dst string")
    assert {tuple(r) for r in policy.staged_cycles(base, staged).collect()} == {("c", "d", "b"), ("d", "b", "b")}

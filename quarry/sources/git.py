"""Version control as a Spark data source: blobs of a commit, commits, changed files and patches, read by executors in batches.

``git`` runs once for a batch of objects, never once for a file. Executors must see the repository (a shared or cloned path).
"""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


BATCH = 256
SCHEMAS = {
    "blobs": "path string, size long, content string",
    "commits": "hash string, short string, date_raw string, author string, message string, body string",
    "files": "hash string, path string, status string",
    "patches": "hash string, patch string",
}


def run_git(root: str, *args: str, data: bytes | None = None, timeout: int = 120) -> bytes:
    """Output of a git command; raises RuntimeError with its message when it fails."""
    done = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], input=data, capture_output=True, timeout=timeout)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout


def _line(root: str, *args: str) -> str | None:
    try:
        return run_git(root, *args, timeout=15).decode("utf-8", "replace").strip()
    except (RuntimeError, OSError, subprocess.TimeoutExpired):
        return None


def is_managed(root: str) -> bool:
    """Whether the folder is a tree of many repositories kept by a manifest tool."""
    return os.path.isdir(os.path.join(root, ".repo"))


def is_repo(root: str) -> bool:
    return _line(root, "rev-parse", "--git-dir") is not None or is_managed(root)


def sub_repos(root: str) -> list[str]:
    """Repositories below a managed tree; looked for before dotted folders are skipped."""
    found = []
    for at, folders, names in os.walk(root) if is_managed(root) else ():
        if at != root and (".git" in folders or ".git" in names):
            found.append(os.path.relpath(at, root))
        folders[:] = sorted(d for d in folders if not d.startswith("."))
    return found


def identity(root: str) -> dict[str, str | None]:
    """Commit, short commit, branch, exact tag, description and whether the tree differs, each null when unknown."""
    status = _line(root, "status", "--porcelain")
    return {
        "git_commit": _line(root, "rev-parse", "HEAD"), "git_short_commit": _line(root, "rev-parse", "--short", "HEAD"), "git_branch": _line(root, "rev-parse", "--abbrev-ref", "HEAD"),
        "git_tag": _line(root, "describe", "--tags", "--exact-match"), "git_describe": _line(root, "describe", "--tags", "--always"), "git_dirty": None if status is None else str(bool(status)).lower(),
    }


def resolve(root: str, ref: str) -> str:
    """The full hash of a branch, tag or expression."""
    return run_git(root, "rev-parse", "--verify", f"{ref}^{{commit}}", timeout=15).decode().strip()


def changed_files(spark: SparkSession, root: str, base: str, target: str) -> DataFrame:
    """(status, path) between two commits."""
    parts = run_git(root, "diff", "--name-status", "-z", "--no-renames", base, target).decode("utf-8", "replace").split("\0")
    return spark.createDataFrame(list(zip(parts[::2], parts[1::2], strict=False)), "status string, path string")


class _Batch(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.kind, self.ref = options["root"], options.get("kind", "blobs"), options.get("ref", "HEAD")
        self.limit = options.get("limit")
        self.batch = int(options.get("batch", BATCH))

    def partitions(self) -> list[InputPartition]:
        if self.kind == "blobs":
            names = run_git(self.root, "ls-tree", "-r", "-z", "--name-only", self.ref).decode("utf-8", "surrogateescape").split("\0")
        else:
            names = run_git(self.root, "rev-list", *([f"--max-count={self.limit}"] if self.limit else []), self.ref).decode().split("\n")
        names = [x for x in names if x]
        return [_Batch(names[i : i + self.batch]) for i in range(0, len(names), self.batch)] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        if partition.names:
            yield from getattr(self, f"_{self.kind}")(partition.names)

    def _blobs(self, names: list[str]) -> Iterator[tuple]:
        asked = "".join(f"{self.ref}:{n}\n" for n in names).encode("utf-8", "surrogateescape")
        out, at = run_git(self.root, "cat-file", "--batch", data=asked), 0
        for n in names:
            end = out.index(b"\n", at)
            head = out[at:end].split()
            if head[-1] == b"missing":
                at = end + 1
                continue
            size = int(head[-1])
            data, at = out[end + 1 : end + 1 + size], end + size + 2
            if head[-2] == b"blob" and b"\0" not in data[:8000]:
                text = data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
                yield n.encode("utf-8", "replace").decode("utf-8", "replace"), size, text

    def _log(self, form: str, names: list[str], *args: str) -> list[str]:
        data = "".join(n + "\n" for n in names).encode()
        return run_git(self.root, "log", "--no-walk=unsorted", "--stdin", f"--format={form}", *args, data=data).decode("utf-8", "replace").split("\x1e")[1:]

    def _commits(self, names: list[str]) -> Iterator[tuple]:
        for row in self._log("%x1e%H%x1f%h%x1f%aI%x1f%an%x1f%s%x1f%b", names):
            yield tuple(x.strip("\n") for x in row.split("\x1f"))

    def _files(self, names: list[str]) -> Iterator[tuple]:
        for row in self._log("%x1e%H", names, "--name-status", "-z", "--no-renames", "--diff-merges=off"):
            head, *rest = row.split("\0")
            for status, path in zip(rest[::2], rest[1::2], strict=False):
                yield head.strip("\n"), path, status.strip("\n")

    def _patches(self, names: list[str]) -> Iterator[tuple]:
        """Patches as git writes them, one commit in memory at a time."""
        args = ["git", "-C", self.root, "-c", "core.quotePath=false", "log", "--no-walk=unsorted", "--stdin", "--format=%x1e%H", "-p", "--no-renames", "--diff-merges=off"]
        with tempfile.TemporaryFile() as asked:
            asked.write("".join(n + "\n" for n in names).encode())
            asked.seek(0)
            with subprocess.Popen(args, stdin=asked, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as git:
                held: list[bytes] = []
                for line in git.stdout:
                    if line.startswith(b"\x1e") and held:
                        yield self._patch(held)
                        held = []
                    held.append(line)
                if held:
                    yield self._patch(held)
                message = git.stderr.read().decode("utf-8", "replace")
            if git.returncode:
                raise RuntimeError(message.strip())

    @staticmethod
    def _patch(lines: list[bytes]) -> tuple[str, str]:
        return lines[0][1:].decode().strip(), b"".join(lines[1:]).decode("utf-8", "replace")


class GitSource(DataSource):
    """``spark.read.format("git")`` with options root, kind (blobs, commits, files, patches), ref, limit and batch."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "blobs")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_git(spark: SparkSession, root: str, kind: str = "blobs", ref: str = "HEAD", limit: int | None = None) -> DataFrame:
    spark.dataSource.register(GitSource)
    r = spark.read.format("git").option("root", root).option("kind", kind).option("ref", ref)
    return (r.option("limit", str(limit)) if limit else r).load()


def read_commit(spark: SparkSession, root: str, ref: str = "HEAD", graph: bool = False) -> DataFrame:
    """(path, lang, size, mtime = 0, content) of the source files of a commit, without a checkout."""
    from pyspark.sql import functions as F

    from quarry.sources.tree import source_files

    return source_files(read_git(spark, root, "blobs", resolve(root, ref)).withColumn("mtime", F.lit(0).cast("long")), graph=graph)


def read_history(spark: SparkSession, root: str, ref: str = "HEAD", limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """commits, commit_files and patches (hash, patch) of a history."""
    from pyspark.sql import functions as F

    commits = read_git(spark, root, "commits", ref, limit).withColumn("date_ts", F.to_timestamp("date_raw"))
    return commits, read_git(spark, root, "files", ref, limit), read_git(spark, root, "patches", ref, limit)

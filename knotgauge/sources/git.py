"""Commits as tables: trees, diffs, blobs, revisions (s05-s09). Git runs on the driver; its output becomes DataFrames."""

from __future__ import annotations

import hashlib
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

TREE_SCHEMA = "mode string, type string, object_id string, size long, path string"
CHANGE_SCHEMA = "status string, old_path string, new_path string"
BATCH_BYTES = 64 << 20


class GitError(RuntimeError):
    """Git failed, or said what it should not."""


def _git(root: str, *args: str, data: bytes | None = None) -> bytes:
    run = subprocess.run(["git", "-C", root, *args], input=data, capture_output=True, timeout=600)
    if run.returncode:
        raise GitError(run.stderr.decode(errors="replace").strip())
    return run.stdout


def resolve(root: str, revision: str) -> str:
    if revision.startswith("-"):
        raise GitError("not a revision")
    found = _git(root, "rev-parse", "--verify", f"{revision}^{{commit}}").decode().strip()
    if not re.fullmatch("[0-9a-f]{40}|[0-9a-f]{64}", found):
        raise GitError("not a commit id")
    return found


def merge_base(root: str, a: str, b: str) -> str:
    return _git(root, "merge-base", resolve(root, a), resolve(root, b)).decode().strip()


def parse_tree(raw: bytes) -> list[tuple]:
    rows = []
    for entry in filter(None, raw.split(b"\0")):
        head, _, path = entry.partition(b"\t")
        fields = head.split()
        if len(fields) != 4 or not path:
            raise GitError("a tree entry of another form")
        mode, kind, oid, size = (x.decode() for x in fields)
        rows.append((mode, kind, oid, None if size == "-" else int(size), path.decode("utf-8", "backslashreplace")))
    return rows


def commit_tree(spark: SparkSession, root: str, commit: str) -> DataFrame:
    return spark.createDataFrame(parse_tree(_git(root, "ls-tree", "-r", "-l", "-z", resolve(root, commit))), TREE_SCHEMA)


def parse_changes(raw: bytes) -> list[tuple]:
    fields = [x.decode("utf-8", "backslashreplace") for x in raw.split(b"\0")[:-1]]
    rows, i = [], 0
    while i < len(fields):
        status = fields[i]
        two = status[:1] in "RC"
        paths = fields[i + 1 : i + 2 + two]
        if not status or len(paths) != 1 + two:
            raise GitError("a change of another form")
        rows.append((status, None if status[0] == "A" else paths[0], None if status[0] == "D" else paths[-1]))
        i += 2 + two
    return rows


def commit_changes(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    return spark.createDataFrame(parse_changes(_git(root, "diff", "--name-status", "-z", "--find-renames", resolve(root, base), resolve(root, head))), CHANGE_SCHEMA)


def blob_digest(raw: bytes, length: int = 40) -> str:
    return (hashlib.sha1 if length == 40 else hashlib.sha256)(b"blob %d\0" % len(raw) + raw).hexdigest()


def read_blobs(root: str, wanted: list[tuple[str, int]], batch_bytes: int = BATCH_BYTES) -> Iterator[tuple[str, bytes]]:
    """(id, bytes) in the order asked for, in batches of at most batch_bytes (one larger blob is a batch); ids and sizes are checked."""
    batch, size = [], 0

    def fetch(ids: list[tuple[str, int]]) -> Iterator[tuple[str, bytes]]:
        out, at = _git(root, "cat-file", "--batch", data="".join(f"{i}\n" for i, _ in ids).encode()), 0
        for oid, expected in ids:
            end = out.index(b"\n", at)
            head = out[at:end].decode().split()
            if head != [oid, "blob", str(expected)]:
                raise GitError(f"asked for {oid}, got {' '.join(head)}")
            yield oid, (body := out[end + 1 : end + 1 + expected])
            if len(body) != expected:
                raise GitError(f"{oid} is cut short")
            at = end + 2 + expected

    for oid, n in wanted:
        if batch and size + n > batch_bytes:
            yield from fetch(batch)
            batch, size = [], 0
        batch.append((oid, n))
        size += n
    if batch:
        yield from fetch(batch)


def file_at(root: str, commit: str, path: str, most_bytes: int = 1 << 30) -> bytes | None:
    """A regular file's bytes at a commit; None if absent (s08)."""
    name = path.encode()
    for mode, kind, oid, size, found in parse_tree(_git(root, "ls-tree", "-l", "-z", resolve(root, commit), "--", path)):
        if found.encode() == name and kind == "blob" and mode != "120000":
            if size is not None and size > most_bytes:
                raise GitError(f"{path} is too large")
            return next(read_blobs(root, [(oid, size or 0)]))[1]
    return None

"""A Python DataSource that reads directory trees as a snapshot table.

``spark.read.format("weighbridge_tree").load(root)`` gives one row per file
``(repo_id, rel_path, content)``: every top-level folder of ``root`` is one
repository. Unlike the ``text``/``binaryFile`` sources it keeps names that
start with ``.`` or ``_`` (``.cursorrules``, ``.github/...``, ``.mcp.json``).

Input partitions are folders, not repositories: the driver lists ``depth`` levels of
folders below each repository (default 1) and every folder at that depth is a piece of
its own, as are the files above it, so a repository with a third of all files is read by many tasks.
``partitions`` deals the pieces over that many tasks (default: one each). Executors walk
the folders, so every executor must see the storage, and yield Arrow batches of about
``BATCH_BYTES``.

``only`` = ``"audit"`` leaves out files that no audit reads (neither context nor
importable nor JSON by name) without opening them; the default ``"all"`` reads every file.
Text is decoded as UTF-8 with bad bytes replaced by U+FFFD; an unreadable file gets null
content. Symbolic links to directories are not followed.

For large trees :func:`read_tree` lists in tasks too: the driver reads the names in ``root`` alone, tasks list folders and hand
on those they leave for the next round, and the files found are dealt to tasks by bytes.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weighbridge import dims
from weighbridge.plans.ranking import rank_within
from weighbridge.session import materialize

BATCH_BYTES = 8 << 20
FOLDERS = 256  # folders that a listing task reads for each folder it was given, before it hands the rest on
PIECE_BYTES = 64 << 20
FILE_BYTES = 4096  # what opening a file counts as
COLUMNS = pa.schema([("repo_id", pa.string()), ("rel_path", pa.string()), ("content", pa.string())])
AUDITED = re.compile(r"\.(markdown|mdx|mdc|md|txt|rst|json)\Z", re.I)


class _Shard(InputPartition):
    """``pieces``: (repository, folder in it, whether folders below it belong to the piece)."""

    def __init__(self, pieces):
        super().__init__(pieces)
        self.pieces = pieces


def _folders(path: str) -> list[str]:
    try:
        return sorted(e.name for e in os.scandir(path) if e.is_dir(follow_symlinks=False))
    except PermissionError:
        return []


def _pieces(root: str, repo: str, folder: str, depth: int):
    yield repo, folder, depth == 0
    if depth:
        for name in _folders(os.path.join(root, repo, folder)):
            yield from _pieces(root, repo, os.path.join(folder, name), depth - 1)


def _audited(name: str) -> bool:
    return name in dims.EXACT_KINDS or bool(AUDITED.search(name))


def _text(path: str) -> str | None:
    try:
        with open(path, "rb") as fh:
            return fh.read().decode("utf-8", errors="replace")
    except OSError:
        return None


def _batches(rows):
    """Arrow batches of about ``BATCH_BYTES`` of ``(repo_id, rel_path, content)`` rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) + len(row[2] or "")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=COLUMNS)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=COLUMNS)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path")
        self.n_parts = int(options.get("partitions", "0") or 0)
        self.depth = int(options.get("depth", "1"))
        self.only = options.get("only", "all")
        if self.only not in ("all", "audit"):
            raise ValueError(f"only: {self.only!r} is neither 'all' nor 'audit'")

    def partitions(self):
        pieces = [p for repo in _folders(self.root) for p in _pieces(self.root, repo, "", self.depth)]
        n = self.n_parts or max(len(pieces), 1)
        shards = [pieces[i::n] for i in range(n)]
        return [_Shard(s) for s in shards if s] or [_Shard([])]

    def _rows(self, pieces):
        for repo, folder, deep in pieces:
            base = os.path.join(self.root, repo)
            for dirpath, dirnames, filenames in os.walk(os.path.join(base, folder), followlinks=False):
                if not deep:
                    dirnames.clear()
                dirnames.sort()
                for name in sorted(filenames):
                    if self.only == "audit" and not _audited(name):
                        continue
                    full = os.path.join(dirpath, name)
                    yield repo, os.path.relpath(full, base).replace(os.sep, "/"), _text(full)

    def read(self, partition):
        yield from _batches(self._rows(partition.pieces))


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "weighbridge_tree"

    def schema(self):
        return "repo_id string, rel_path string, content string"

    def reader(self, schema):
        return TreeReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(TreeSource)


def list_tree(spark: SparkSession, root: str, only: str = "all", folders: int = FOLDERS) -> DataFrame:
    """``repo_id, rel_path, bytes`` of every file below the folders in ``root``, as written tables.

    The driver lists ``root`` alone. Each round deals the folders at hand to tasks; a task walks a folder until it has read
    ``folders`` of them, and what it has not read by then is dealt anew in the next round. So the number of
    rounds grows with the logarithm of the tree, a repository with most of the files is listed by many tasks, and no task
    walks more than its folders allow.
    """
    if only not in ("all", "audit"):
        raise ValueError(f"only: {only!r} is neither 'all' nor 'audit'")
    names = ["repo_id", "rel_path", "bytes", "left"]

    def walk(batches):
        for batch in batches:
            for repo, folder in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                rows, todo = [], [folder]
                for _ in range(folders):
                    if not todo:
                        break
                    at = todo.pop()
                    try:
                        entries = list(os.scandir(os.path.join(root, repo, at)))
                    except OSError:
                        continue  # an unreadable folder has no files
                    for e in entries:
                        path = f"{at}/{e.name}" if at else e.name
                        if e.is_dir(follow_symlinks=False):
                            todo.append(path)
                        elif not e.is_dir() and (only == "all" or _audited(e.name)):
                            try:
                                size = e.stat().st_size
                            except OSError:
                                size = 0
                            rows.append((repo, path, size, False))
                rows += [(repo, path, 0, True) for path in todo]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)))

    schema = "repo_id string, rel_path string, bytes long, left boolean"
    todo = spark.createDataFrame([(repo, "") for repo in _folders(root)], "repo_id string, folder string")
    found = None
    while True:
        # each folder may take a task's whole allowance, so they are spread as widely as there are folders
        width = max(1, min(todo.count(), 4 * spark.sparkContext.defaultParallelism))
        seen = materialize(todo.repartition(width).mapInArrow(walk, schema), "tree-list")
        files = seen.where(~F.col("left")).select("repo_id", "rel_path", "bytes")
        found = files if found is None else found.unionByName(files)
        todo = seen.where("left").select("repo_id", F.col("rel_path").alias("folder"))
        if todo.isEmpty():
            return found


def read_tree(spark: SparkSession, root: str, only: str = "all", piece_bytes: int = PIECE_BYTES, folders: int = FOLDERS) -> DataFrame:
    """``repo_id, rel_path, content`` of the files below ``root``, read by tasks of about ``piece_bytes`` each.

    Files are dealt from the largest down, in turns to and fro, so pieces differ by little more than a file; a file is read whole
    by one task.
    """
    found = materialize(list_tree(spark, root, only, folders).withColumn("bytes", F.col("bytes") + FILE_BYTES), "tree-files")
    total = found.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    pieces = max(1, -(-total // piece_bytes))
    ranked = rank_within(found, [], [F.desc("bytes"), F.col("repo_id"), F.col("rel_path")], out="turn")
    turn, place = F.floor((F.col("turn") - 1) / pieces), F.pmod(F.col("turn") - 1, F.lit(pieces))
    piece = F.when(turn % 2 == 0, place).otherwise(pieces - 1 - place).cast("int")

    def read(batches):
        def rows():
            for batch in batches:
                for repo, path in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                    yield repo, path, _text(os.path.join(root, repo, path))

        yield from _batches(rows())

    dealt = ranked.select("repo_id", "rel_path", piece.alias("piece")).repartitionByRange(pieces, "piece")
    return dealt.select("repo_id", "rel_path").mapInArrow(read, "repo_id string, rel_path string, content string")

"""Python data sources: commit logs, commit texts, file trees and facts of local clones, one partition per clone.

A clone that can't be read, or a git command that fails or takes too long, gives a row with its `error` beside the rows
read before; the others finish. `routed` parts the two.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import threading
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.predicates import SKIP_DIRS
from ..operators import history
from ..schemas import CLONE_FACTS, COMMIT_LINES, COMMIT_RECORDS, FILES, LINE_COUNTS

#: Seconds that a git command may take.
GIT_SECONDS, LOG_SECONDS, COUNT_SECONDS = 300, 600, 300
SAMPLE = 40_000


def find_clones(root: str) -> list[str]:
    """Folders below the root that are git clones, in order of lower-cased path; hidden and pruned ones aren't entered."""
    found = []
    for folder, below, _ in os.walk(root):
        if ".git" in below or os.path.exists(os.path.join(folder, ".git")):
            found.append(os.path.relpath(folder, root))
            below.clear()
        below[:] = [d for d in below if not d.startswith(".") and d not in SKIP_DIRS]
    return sorted(found, key=str.lower)


def git_parts(folder: str, *args: str, seconds: float = GIT_SECONDS, end: bytes = b"\n") -> Iterator[str]:
    """What a git command prints, part by part as it comes; an OSError if it fails or takes too long."""
    with subprocess.Popen(["git", "-C", folder, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        late = threading.Event()
        clock = threading.Timer(seconds, lambda: (late.set(), run.kill()))
        said: list[bytes] = []
        reader = threading.Thread(target=lambda: said.append(run.stderr.read()), daemon=True)
        clock.start()
        reader.start()
        try:
            rest = b""
            while block := run.stdout.read1(1 << 16):
                *parts, rest = (rest + block).split(end)
                yield from (p.decode("utf-8", "replace") for p in parts)
            if rest:
                yield rest.decode("utf-8", "replace")
        finally:
            clock.cancel()
            run.kill()
            code = run.wait()
            reader.join()
        if late.is_set():
            raise TimeoutError(f"git {args[0]} took more than {seconds:g} s")
        if code:
            raise OSError(f"git {args[0]} failed: {b''.join(said).decode('utf-8', 'replace').strip()[-300:]}")


def git(folder: str, *args: str, seconds: float = GIT_SECONDS) -> str:
    """A git command's output; empty if it fails."""
    try:
        return "\n".join(git_parts(folder, *args, seconds=seconds))
    except TimeoutError:
        raise
    except OSError:
        return ""


def default_branch(folder: str) -> str:
    """The branch that a clone has checked out."""
    return git(folder, "symbolic-ref", "--short", "HEAD").strip() or "not_collected_offline"


class _Clone(InputPartition):
    def __init__(self, repo: str):
        self.repo = repo


class _Reader(DataSourceReader):
    """Reads one clone after the other; `rows` gives tuples without the repository, `width` of them."""

    width = 0

    def __init__(self, options: dict):
        self.root, self.seconds = options["path"], float(options.get("seconds", LOG_SECONDS))

    def partitions(self) -> list[InputPartition]:
        return [_Clone(r) for r in find_clones(self.root)] or [_Clone("")]

    def rows(self, folder: str) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.repo:
            return
        try:
            for row in self.rows(os.path.join(self.root, partition.repo)):
                yield partition.repo, *row, None
        except (OSError, ValueError) as e:  # the reason is data; the other clones go on
            yield partition.repo, *[None] * self.width, f"{type(self).stage}: {e}"[:500]


class CommitLogReader(_Reader):
    """Lines of the log, newest commit first, each with its commit's place; a clone without commits has none."""

    width, stage = 3, "commit log"

    def rows(self, folder: str) -> Iterator[tuple]:
        if not git(folder, "rev-parse", "-q", "--verify", "HEAD", seconds=self.seconds):
            return
        form = history.HEADER + history.FIELD.join(history.LINE_FIELDS)
        place = 0
        for n, line in enumerate(git_parts(folder, "log", "--numstat", f"--format={form}", seconds=self.seconds)):
            if line:
                place += line.startswith(history.HEADER)
                yield place, n, line


class CommitTextReader(_Reader):
    """Commits with subject and body as printed, one record each, newest first."""

    width, stage = 2, "commit texts"

    def rows(self, folder: str) -> Iterator[tuple]:
        if not git(folder, "rev-parse", "-q", "--verify", "HEAD", seconds=self.seconds):
            return
        form = history.FIELD.join(history.TEXT_FIELDS)
        yield from enumerate(git_parts(folder, "log", "-z", f"--format={form}", seconds=self.seconds, end=b"\0"), 1)


class FileTreeReader(_Reader):
    width, stage = 4, "file tree"

    def rows(self, base: str) -> Iterator[tuple]:
        failed: list[OSError] = []
        for folder, below, names in os.walk(base, onerror=failed.append):
            below[:] = sorted(d for d in below if d not in SKIP_DIRS)
            for name in sorted(names):
                path = Path(folder, name)
                if not path.is_file():  # a link to nowhere, a pipe
                    continue
                size, lines, start, block = 0, 0, b"", b"\n"
                try:
                    with path.open("rb") as file:
                        while part := file.read(1 << 20):
                            start = start or part[: 4 * SAMPLE]
                            size, lines, block = size + len(part), lines + part.count(b"\n"), part
                except OSError as e:
                    failed.append(e)
                    continue
                yield path.relative_to(base).as_posix(), size, lines + (not block.endswith(b"\n")), start.decode("utf-8", "replace")[:SAMPLE]
        if failed:
            raise OSError(f"{len(failed)} unread, first {failed[0]}")


class CloneFactsReader(_Reader):
    width, stage = 1, "clone"

    def rows(self, folder: str) -> Iterator[tuple]:
        yield (default_branch(folder),)


class LineCountReader(_Reader):
    """Lines of code by language, from a counter's JSON list; languages of the same name are added up."""

    width, stage = 2, "line counter"

    def __init__(self, options: dict):
        super().__init__(options)
        self.counter = options.get("counter", "scc")

    def rows(self, folder: str) -> Iterator[tuple]:
        if not shutil.which(self.counter):
            raise OSError(f"there is no program {self.counter}")
        try:
            run = subprocess.run([self.counter, "--format", "json", folder], capture_output=True, timeout=min(self.seconds, COUNT_SECONDS))
        except subprocess.TimeoutExpired as e:
            raise OSError(str(e)) from e
        if run.returncode:
            raise OSError((run.stderr or run.stdout or b"failed").decode("utf-8", "replace")[-500:])
        told = json.loads(run.stdout or b"[]")
        total: dict[str, int] = {}
        for x in told if isinstance(told, list) else []:
            name = x.get("Name") or x.get("name") or "Unknown"
            total[name] = total.get(name, 0) + int(x.get("Code") or x.get("code") or 0)
        yield from total.items()


class _Source(DataSource):
    """A source of one kind of rows below the folder `path`; `seconds` bounds a git command."""

    label, form, kind = "", "", _Reader

    @classmethod
    def name(cls) -> str:
        return cls.label

    def schema(self) -> str:
        return self.form

    def reader(self, schema) -> DataSourceReader:
        return self.kind(self.options)


class CommitLog(_Source):
    label, form, kind = "commit_log", COMMIT_LINES, CommitLogReader


class CommitTexts(_Source):
    label, form, kind = "commit_texts", COMMIT_RECORDS, CommitTextReader


class FileTree(_Source):
    label, form, kind = "file_tree", FILES, FileTreeReader


class CloneFacts(_Source):
    label, form, kind = "clone_facts", CLONE_FACTS, CloneFactsReader


class LineCounts(_Source):
    label, form, kind = "line_counts", LINE_COUNTS, LineCountReader


def _load(spark: SparkSession, source: type[_Source], root: str, **options: object) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.label).options(**options).load(root)


def commit_lines(spark: SparkSession, root: str, **options: object) -> DataFrame:
    return _load(spark, CommitLog, root, **options)


def commit_records(spark: SparkSession, root: str, **options: object) -> DataFrame:
    return _load(spark, CommitTexts, root, **options)


def commit_texts(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """Commits with subject and body."""
    return history.commits_of_records(commit_records(spark, root, **options).where("error is null"))


def files(spark: SparkSession, root: str, **options: object) -> DataFrame:
    return _load(spark, FileTree, root, **options)


def clone_facts(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """(repo, default_branch, error)."""
    return _load(spark, CloneFacts, root, **options)


def line_counts(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """(repo, language, code, error), by the program that the option `counter` names."""
    return _load(spark, LineCounts, root, **options)


def is_clone(folder: str) -> bool:
    """Whether a folder is a clone already."""
    return os.path.isdir(os.path.join(folder, ".git"))


def routed(rows: DataFrame, stage: int) -> tuple[DataFrame, DataFrame]:
    """The data of a reader's rows, and its errors as (repo, stage, error). Both read `rows`: write these first if it is dear."""
    bad = rows.where("error is not null").select("repo", F.lit(stage).alias("stage"), "error")
    return rows.where("error is null").drop("error"), bad

"""Doing what a plan says, as tasks: copies, reverts, moves to the trash and back, each with a row that tells what became of it.

A task may run twice, at once or again, so every step is one that can be repeated: contents go to a file of the attempt's
own name, a name is taken by a link (which is made or not) and given up by a rename to a place that only this job uses,
and a job that finds its own result there says so. Plans name each path once (operators/tables.py, collision_names).
All executors must see the files. Reads don't follow links.

Outcome rows are small; each phase's are written, so that later phases see what was done and don't do it again.
"""

from __future__ import annotations

import contextlib
import errno
import hashlib
import os
import shutil
import stat
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framehouse.operators import library
from framehouse.plans.lineage import written
from framehouse.sources.scan import CHUNK, file_identity

RETRIES, FIRST_WAIT, LONGEST_WAIT, MOST_NAMES = 5, 1.0, 10.0, 9999
#: Errors that another attempt may not meet.
PASSING = {errno.EIO, errno.EAGAIN, errno.EBUSY, errno.ETIMEDOUT, errno.EINTR, errno.ESTALE, errno.ENETDOWN, errno.ENETUNREACH}


def each_row(rows: DataFrame, columns: list[str], act: Callable[..., tuple], schema: str) -> DataFrame:
    """act(*columns) of every row gives a row of schema; written, so that it isn't acted on again when it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[part.split()[1]] for part in schema.split(", ")]
        for batch in batches:
            done = [act(*values) for values in zip(*(c.to_pylist() for c in batch.columns))]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    return written(rows.select(*columns).mapInArrow(run, schema), "outcomes")


def spread_out(rows: DataFrame, column: str = "ordinal") -> DataFrame:
    """Jobs dealt to tasks by a column, as a rule their ordinal: neighbours in a plan are often of one folder and size.

    Rows of files are few bytes and much work, so that Spark would give many of them to one task.
    """
    return rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism), column)


def _retried(act: Callable[[], None], retries: int, first_wait: float) -> None:
    for k in range(retries):
        try:
            return act()
        except OSError as error:
            if error.errno not in PASSING or k == retries - 1:
                raise
            time.sleep(min(LONGEST_WAIT, first_wait * 2**k))


def _hidden(path: str, run: str, tail: str) -> str:
    return os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{run}.{tail}")


def _copied(source: str, target: str) -> str:
    """Copy the bytes as they are now to target, on disk, and give their identity, from the bytes that were written."""
    with open(os.open(source, os.O_RDONLY | os.O_NOFOLLOW), "rb") as src, open(target, "wb") as out:
        before = os.fstat(src.fileno())
        h = hashlib.blake2b(str(before.st_size).encode())
        while part := src.read(CHUNK):
            h.update(part)
            out.write(part)
        out.flush()
        os.fsync(out.fileno())
        os.utime(target, ns=(before.st_atime_ns, before.st_mtime_ns))
    return f"{before.st_size}_{h.hexdigest()}"


def prepared(jobs: DataFrame, run: str, verify: bool = True, retries: int = RETRIES, first_wait: float = FIRST_WAIT) -> DataFrame:
    """ordinal, source, dest, identity, status, temporary, message: every job's bytes under a name of its attempt beside its dest.

    PREPARED; SKIPPED where the source can't be read or isn't what the plan knew; FAILED otherwise.
    """

    def act(ordinal: int, source: str, dest: str, identity: str | None) -> tuple:
        told = lambda status, temporary=None, message=None: (ordinal, source, dest, identity, status, temporary, message)
        now = file_identity(source)
        if now is None:
            return told("SKIPPED", message="source unreadable")
        if identity and now != identity:
            return told("SKIPPED", message="source modified since planning")
        temporary = _hidden(dest, run, f"{uuid.uuid4().hex}.tmp")
        try:
            os.makedirs(os.path.dirname(dest), exist_ok=True)
            if shutil.disk_usage(os.path.dirname(dest)).free < os.stat(source).st_size:
                raise OSError(errno.ENOSPC, "not enough space")
            made: list[str] = []
            _retried(lambda: made.append(_copied(source, temporary)), retries, first_wait)
            if made[-1] != now or verify and file_identity(temporary) != now:
                raise OSError(errno.EIO, "verification failed")
        except OSError as error:
            with contextlib.suppress(OSError):
                os.unlink(temporary)
            return told("FAILED", message=f"{error.strerror}")
        return told("PREPARED", temporary)

    return each_row(spread_out(jobs), ["ordinal", "source", "dest", "identity"], act, "ordinal long, source string, dest string, identity string, status string, temporary string, message string")


def candidates(dest: str, most: int = MOST_NAMES) -> Iterator[str]:
    stem, extension = os.path.splitext(dest)
    yield dest
    for k in range(1, most + 1):
        yield f"{stem}_collision_{k}{extension}"


def finished(jobs: DataFrame, run: str) -> DataFrame:
    """ordinal, source, dest (as named at last), identity, status, bytes, mtime, message: prepared files get their names.

    A name in use by a file of another job or of nobody is passed over for the next collision name. The mark that a job
    took a name is a link of its own beside it; a repeated task finds it and tells the same outcome.
    """

    def act(ordinal: int, source: str, dest: str, identity: str | None, status: str, temporary: str | None, message: str | None, stop: bool) -> tuple:
        told = lambda status, at=dest, size=None, mtime=None, message=message: (ordinal, source, at, identity, status, size, mtime, message)
        if status != "PREPARED":
            return told(status)
        mark = _hidden(dest, run, f"{ordinal}.done")
        if stop:
            with contextlib.suppress(OSError):
                os.unlink(temporary)
            return told("PENDING", message=None)
        try:
            with contextlib.suppress(FileExistsError, FileNotFoundError):  # the first attempt's file is the job's
                os.link(temporary, mark)
            own = os.stat(mark)
            for path in candidates(dest):
                try:
                    os.link(mark, path)
                except FileExistsError:
                    there = os.lstat(path)
                    if (there.st_dev, there.st_ino) != (own.st_dev, own.st_ino):
                        continue
                with contextlib.suppress(FileNotFoundError):
                    os.unlink(temporary)
                return told("COPIED", path, own.st_size, own.st_mtime)
            return told("FAILED", message="too many collisions")
        except OSError as error:
            return told("FAILED", message=f"{error.strerror}")

    columns = ["ordinal", "source", "dest", "identity", "status", "temporary", "message", "stop"]
    return each_row(spread_out(jobs), columns, act, "ordinal long, source string, dest string, identity string, status string, bytes long, mtime double, message string")


def dropped(first: DataFrame, run: str) -> int:
    """Remove prepared files (ordinal, dest, temporary) of a run that are left and then the marks of its jobs; how many there were."""

    def act(ordinal: int, dest: str, temporary: str) -> tuple:
        gone = 0
        for path in (temporary, _hidden(dest, run, f"{ordinal}.done")):
            with contextlib.suppress(FileNotFoundError, NotADirectoryError):
                os.unlink(path)
                gone += 1
        return ordinal, gone

    prepared_ones = spread_out(first.where("temporary IS NOT NULL"))
    return each_row(prepared_ones, ["ordinal", "dest", "temporary"], act, "ordinal long, gone long").agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]


def tidied(jobs: DataFrame, run: str) -> int:
    """Remove what a run's attempts left beside the dests of its jobs, marks last; the number of files removed.

    A folder is one task's: dropped() takes away first what is known by name, file by file in all tasks.
    """

    def act(folder: str) -> tuple:
        gone = 0
        with contextlib.suppress(FileNotFoundError, NotADirectoryError):
            for e in os.scandir(folder):
                if e.name.startswith(".") and (f".{run}." in e.name) and e.name.endswith((".tmp", ".done")):
                    with contextlib.suppress(FileNotFoundError):
                        os.unlink(e.path)
                        gone += 1
        return folder, gone

    folders = jobs.select(F.regexp_replace("dest", "/[^/]*$", "").alias("folder")).distinct()
    return each_row(folders, ["folder"], act, "folder string, gone long").agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]


def copy_files(jobs: DataFrame, run: str | None = None, verify: bool = True, retries: int = RETRIES, first_wait: float = FIRST_WAIT, most_in_a_row: int = 5, most: int = 20) -> DataFrame:
    """Copy jobs (ordinal, source, dest, identity) and give their outcomes (ordinal, source, dest, identity, status, bytes, mtime, message).

    All are prepared at once; in the order of the plan, failures in a row or in all that reach a limit stop the run, and
    what comes after stays PENDING without a file. No job sees another's name.
    """
    run = run or uuid.uuid4().hex
    first = prepared(jobs.withColumn("ordinal", F.col("ordinal").cast("long")), run, verify, retries, first_wait)
    judged = first.select(F.lit(run).alias("run"), "ordinal", F.when(F.col("status") == "PREPARED", "COPIED").otherwise(F.col("status")).alias("status"))
    stops = library.abort_points(judged, "run", most_in_a_row, most).collect()
    limit = stops[0].aborted_at if stops else None
    after = F.lit(False) if limit is None else F.col("ordinal") > limit
    done = finished(first.withColumns({"stop": after, "status": F.when(after & (F.col("status") != "PREPARED"), "PENDING").otherwise(F.col("status"))}), run)
    dropped(first, run)
    tidied(jobs, run)
    return done


def _contained(path: str, root: str) -> bool:
    """Whether the path, with all links of its folder followed, is below the root."""
    real = os.path.join(os.path.realpath(os.path.dirname(path)), os.path.basename(path))
    top = os.path.realpath(root)
    return real == top or real.startswith(top.rstrip("/") + "/")


def revert_copies(transfers: DataFrame, root: str, run: str | None = None) -> DataFrame:
    """Remove the dests of transfers (ordinal, source, dest, hash) that are below root and still what was copied.

    ordinal, dest, status: reverted, missing, or skipped with a message (outside, a link, no regular file, modified). The
    file is moved to a name of its own first, judged there, and put back where it isn't the one.
    """
    run = run or uuid.uuid4().hex

    def act(ordinal: int, dest: str, digest: str) -> tuple:
        told = lambda status, message=None: (ordinal, dest, status, message)
        held = _hidden(dest, run, f"{ordinal}.gone")
        if not _contained(dest, root):
            return told("skipped", "outside the destination")
        try:
            if not os.path.lexists(held):
                there = os.lstat(dest)
                if stat.S_ISLNK(there.st_mode):
                    return told("skipped", "a link")
                if not stat.S_ISREG(there.st_mode):
                    return told("skipped", "not a regular file")
                os.rename(dest, held)
        except FileNotFoundError:
            if not os.path.lexists(held):
                return told("missing")
        except OSError as error:
            return told("skipped", f"{error.strerror}")
        if file_identity(held) == digest:
            return told("reverted")
        try:
            os.link(held, dest)
            os.unlink(held)
        except OSError as error:
            return told("skipped", f"modified, kept as {held}: {error.strerror}")
        return told("skipped", "modified since it was copied")

    jobs = transfers.where("dest IS NOT NULL").select(F.col("ordinal").cast("long").alias("ordinal"), "dest", "hash")
    done = each_row(spread_out(jobs), ["ordinal", "dest", "hash"], act, "ordinal long, dest string, status string, message string")

    def drop(ordinal: int, dest: str) -> tuple:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(_hidden(dest, run, f"{ordinal}.gone"))
        return (ordinal,)

    each_row(spread_out(done.where("status = 'reverted'")), ["ordinal", "dest"], drop, "ordinal long")
    return done


def trash(plan: DataFrame, holding: str, run: str | None = None) -> DataFrame:
    """Move the files of a deletion plan (path, size, ..) to a folder of the run below holding, never delete them.

    originalPath, sizeBytes, trashURL (null where it failed), message. A repeated task finds its file there.
    """
    run = run or uuid.uuid4().hex
    place = F.concat(F.lit(f"{holding.rstrip('/')}/{run}/"), F.substring(F.sha2("path", 256), 1, 2), F.lit("/"), F.sha2("path", 256))

    def act(path: str, size: int | None, held: str) -> tuple:
        held = f"{held}-{os.path.basename(path)}"
        try:
            os.makedirs(os.path.dirname(held), exist_ok=True)
            if not os.path.lexists(held):
                os.rename(path, held)
        except FileNotFoundError:
            if not os.path.lexists(held):
                return path, size, None, "no such file"
        except OSError as error:
            return path, size, None, f"{error.strerror}"
        return path, size, held, None

    jobs = plan.select("path", F.col("size").cast("long").alias("size"), place.alias("held")).dropDuplicates(["path"])
    return each_row(spread_out(jobs, "path"), ["path", "size", "held"], act, "originalPath string, sizeBytes long, trashURL string, message string")


def restore(items: DataFrame, roots: list[str]) -> DataFrame:
    """Move trashed items (originalPath, sizeBytes, trashURL) back where nothing stands, inside one of the roots.

    originalPath, sizeBytes, status (restored or failed), message.
    """

    def act(path: str, size: int | None, held: str | None) -> tuple:
        told = lambda status, message=None: (path, size, status, message)
        if held is None:
            return told("failed", "never trashed")
        if not any(_contained(path, root) for root in roots):
            return told("failed", "outside the roots")
        mark = f"{held}.restored"
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with contextlib.suppress(FileNotFoundError):  # the mark tells a repeated task whose file stands there
                os.rename(held, mark)
            own = os.stat(mark)
            try:
                os.link(mark, path)
            except FileExistsError:
                there = os.lstat(path)
                if (there.st_dev, there.st_ino) != (own.st_dev, own.st_ino):
                    os.rename(mark, held)
                    return told("failed", "something stands at the original path")
        except FileNotFoundError:
            return told("failed", "no longer in the trash")
        except OSError as error:
            return told("failed", f"{error.strerror}")
        return told("restored")

    done = each_row(spread_out(items, "originalPath"), ["originalPath", "sizeBytes", "trashURL"], act, "originalPath string, sizeBytes long, status string, message string")

    def drop(held: str) -> tuple:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(f"{held}.restored")
        return (held,)

    back = items.join(done.where("status = 'restored'").select("originalPath"), "originalPath", "left_semi")
    each_row(spread_out(back, "originalPath"), ["trashURL"], drop, "held string")
    return done

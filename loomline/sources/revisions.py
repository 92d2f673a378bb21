"""Revisions of a table under one path: whole snapshots, each claimed by a file that only one writer can make.

A commit writes its snapshot to a folder of its own and then claims the next number; the claim names the folder. Claims
appear at once and whole, and only where there is none of that number, so of two writers one wins, and readers see whole
revisions only. Data of a writer that lost, or died before its claim, is never read.

Defined cases: before the first commit the revision is 0 and there is no snapshot; a change that gives None (it refuses)
writes nothing; with ``expected`` a commit onto any other revision is a revision_conflict and writes nothing that is read,
without it the change is made again on the revision that came between; every commit raises the revision by one, also
when it changes nothing; an empty snapshot is a snapshot.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


class Revisions:
    """The revisions under ``path``, in any file system of Hadoop's whose renames are atomic (and in local ones by hard links)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        top = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        self.top = self.fs.makeQualified(top).toString().rstrip("/")
        self.fs.mkdirs(self._path("claims"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")

    def current(self) -> int:
        return max((int(s.getPath().getName()) for s in self.fs.listStatus(self._path("claims")) if s.getPath().getName().isdecimal()), default=0)

    def _folder(self, revision: int) -> str:
        data = self.fs.open(self._path(f"claims/{revision:020d}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        finally:
            data.close()

    def read(self, revision: int | None = None) -> DataFrame | None:
        """The snapshot of a revision, by default of the current one."""
        revision = self.current() if revision is None else revision
        return self.spark.read.parquet(f"{self.top}/{self._folder(revision)}") if revision else None

    def commit(self, change: Callable[[DataFrame | None], DataFrame | None], expected: int | None = None) -> tuple[str, int]:
        """Status (ok, revision_conflict or refused) and the revision: the new one, or the current one where nothing was committed."""
        while True:
            now = self.current()
            if expected is not None and expected != now:
                return "revision_conflict", now
            new = change(self.read(now))
            if new is None:
                return "refused", now
            folder = f"data/{uuid.uuid4().hex}"
            new.write.parquet(f"{self.top}/{folder}")
            if self._claim(now + 1, folder):
                return "ok", now + 1
            self.fs.delete(self._path(folder), True)

    def _claim(self, revision: int, folder: str) -> bool:
        draft, claim = self._path(f"claims/.{uuid.uuid4().hex}"), self._path(f"claims/{revision:020d}")
        out = self.fs.create(draft)
        out.write(folder.encode())
        out.close()
        try:
            if self.fs.getScheme() == "file":
                os.link(*(unquote(urlparse(p.toUri().toString()).path) for p in (draft, claim)))
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(claim.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(draft, claim, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except FileExistsError:
            return False
        except Exception as failed:
            if "FileAlreadyExistsException" in str(failed):
                return False
            raise
        finally:
            self.fs.delete(draft, False)
        return True

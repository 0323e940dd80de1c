"""Numbers for loads and sessions that no two writers can both get.

A claim is a small file named by its load. It is written under another name first
and then given its own name in one step that fails if the name is taken: by a hard
link on a local disk, by a rename without overwriting elsewhere. So a claim is
there whole or not at all, and of two writers that want a number one finds it
taken, reads all claims again and takes the next. A writer that dies leaves a gap
in the numbers and nothing else. The file system must rename in one step, as HDFS
and local disks do.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Claim:
    load_id: int
    #: Sessions have the numbers from ``first_session`` on.
    first_session: int
    sessions: int
    #: The stream and its batch that the load is of.
    source: str | None = None
    batch: int | None = None

    @property
    def last_session(self) -> int:
        return self.first_session + self.sessions - 1


class Claims:
    """The claims in one folder, which the driver reads: one line for each load."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._jvm = spark._jvm
        #: A claim never changes, so each is read once.
        self._known: dict[str, Claim] = {}

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._spark._jsc.hadoopConfiguration())

    def all(self) -> list[Claim]:
        fs, found = self._fs(), []
        for status in fs.globStatus(self._path("load-*.json")) or []:
            name = status.getPath().getName()
            if name not in self._known:
                stream = fs.open(status.getPath())
                try:
                    raw = bytes(stream.readAllBytes())
                finally:
                    stream.close()
                self._known[name] = Claim(**json.loads(raw.decode()))
            found.append(self._known[name])
        return sorted(found, key=lambda c: c.load_id)

    def publish(self, claim: Claim) -> bool:
        """Write a claim; False if its load is taken."""
        fs = self._fs()
        fs.mkdirs(self._path(""))
        target, draft = self._path(f"load-{claim.load_id:012d}.json"), self._path(f".draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(asdict(claim)).encode()))
        finally:
            out.close()
        if fs.getScheme() == "file":
            names = [unquote(urlsplit(p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()).path) for p in (draft, target)]
            try:
                os.link(*names)
            except FileExistsError:
                return False
            finally:
                fs.delete(draft, False)
            return True
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._spark._jsc.hadoopConfiguration())
        rename = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self._spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(draft, target, options)
        except Exception as error:
            taken = fs.exists(target)
            fs.delete(draft, False)
            if not taken:
                raise RuntimeError(f"could not write the claim {target}") from error
            return False
        return True

    def take(self, sessions: int, least_load: int, least_session: int, source: str | None = None, batch: int | None = None) -> Claim:
        """The next load and as many session numbers as asked for, above the given ones and all that are taken."""
        while True:
            taken = self.all()
            claim = Claim(
                max([least_load, *(c.load_id + 1 for c in taken)]),
                max([least_session, *(c.last_session + 1 for c in taken)]),
                sessions,
                source,
                batch,
            )
            if self.publish(claim):
                return claim

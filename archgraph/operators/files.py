"""Small files that several writers share: created once or not at all, in any store that Hadoop reads.

On them stand a log of revisions, leases with fencing tokens, and publishers in flight.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import ArchgraphError


class Stale(RuntimeError):
    """A result was made for inputs that are no longer current."""


class Files:
    """Text files below one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self.path("").getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str | None:
        place = self.path(name)
        try:
            stream = self.fs.open(place)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileNotFoundException":
                return None
            raise
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def load(self, name: str) -> dict | None:
        found = self.read(name)
        return json.loads(found) if found else None

    def names(self, folder: str) -> list[str]:
        """What a folder holds, in order, without files that are still being written."""
        place = self.path(folder)
        if not self.fs.exists(place):
            return []
        return sorted(n for n in (x.getPath().getName() for x in self.fs.listStatus(place)) if not n.startswith("."))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, name: str, to: str) -> None:
        """Move a folder; one that is there already stays, and what was to be moved goes."""
        target = self.path(to)
        self.fs.mkdirs(target.getParent())
        if self.fs.exists(target) or not self.fs.rename(self.path(name), target):
            self.delete(name)

    def _write(self, name: str, text: str):
        folder, _, last = name.rpartition("/")
        self.fs.mkdirs(self.path(folder))
        temporary = self.path(f"{folder}/.{last}.{uuid.uuid4().hex}")
        out = self.fs.create(temporary)
        out.write(text.encode())
        out.close()
        return temporary

    def _context(self):
        return self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)

    def create(self, name: str, content: dict) -> bool:
        """A whole file under a new name; false if that is taken. Of several writers one succeeds.

        A local store links the name to the written file, others rename it to a name that isn't taken: one step in either.
        """
        temporary = self._write(name, json.dumps(content, sort_keys=True))
        try:
            if self.local:
                nio = self.jvm.java.nio.file
                nio.Files.createLink(nio.Path.of(self.path(name).toUri().getPath(), self._none()), nio.Path.of(temporary.toUri().getPath(), self._none()))
            else:
                self._context().rename(temporary, self.path(name), self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getSimpleName():
                return False
            raise
        finally:
            self.fs.delete(temporary, False)

    def _none(self):
        return self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0)

    def replace(self, name: str, content: dict) -> None:
        """Write a file beside ``name``, and rename it to that."""
        temporary = self._write(name, json.dumps(content, sort_keys=True))
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._context().rename(temporary, self.path(name), options)


class Log:
    """Numbered entries in a folder. The largest number is current; a number is given once."""

    def __init__(self, files: Files, folder: str) -> None:
        self.files, self.folder = files, folder

    def _name(self, number: int) -> str:
        return f"{self.folder}/{number:020d}.json"

    def last(self) -> int:
        """The largest number; 0 if there is none."""
        return max((int(n.removesuffix(".json")) for n in self.files.names(self.folder) if n.endswith(".json")), default=0)

    def load(self, number: int) -> dict | None:
        return self.files.load(self._name(number)) if number else None

    def append(self, after: int, content: dict) -> bool:
        """Add the entry that follows number ``after``; false if there is one, or if ``after`` is long gone."""
        if not self.files.create(self._name(after + 1), content):
            return False
        if after and not self.files.exists(self._name(after)):
            # Entries are trimmed from the first on, so this number may have been given and trimmed before.
            self.files.delete(self._name(after + 1))
            return False
        return True

    def rewrite(self, number: int, content: dict) -> None:
        self.files.replace(self._name(number), content)

    def trim(self, keep: int) -> None:
        """Delete all but the last ``keep`` entries, first ones first."""
        for name in [n for n in self.files.names(self.folder) if n.endswith(".json")][:-keep]:
            self.files.delete(f"{self.folder}/{name}")


class Lease:
    """A lock that one holder has for a limited time. Its number grows with each holder and fences earlier ones."""

    def __init__(self, files: Files, folder: str = "lock", clock=time.time) -> None:
        self.files, self.log, self.folder, self.clock = files, Log(files, folder), folder, clock
        self.token, self.holder = 0, ("", 0)

    def held_by_other(self) -> str | None:
        """What the lock is held for, if it is."""
        number = self.log.last()
        at = self.log.load(number)
        if at is None or number == self.token or at["until"] <= self.clock() or self.files.exists(f"{self.folder}/{number}.released"):
            return None
        return at["operation"]

    @contextmanager
    def hold(self, operation: str, seconds: float) -> Iterator[int]:
        """Hold the lock; inside the same operation of the same thread it is held already."""
        if self.token and self.holder == (operation, threading.get_ident()):
            yield self.token
            return
        if self.token:
            raise ArchgraphError("scheduler.unavailable", f"{operation} must wait for {self.holder[0]}")
        number = self.log.last()
        if other := self.held_by_other():
            raise ArchgraphError("scheduler.unavailable", f"{operation} must wait for {other}")
        if not self.log.append(number, {"operation": operation, "until": self.clock() + seconds}):
            raise ArchgraphError("scheduler.unavailable", f"{operation} must wait for another operation")
        self.token, self.holder = number + 1, (operation, threading.get_ident())
        try:
            yield self.token
        finally:
            self.files.create(f"{self.folder}/{self.token}.released", {})
            if number:
                self.files.delete(f"{self.folder}/{number}.released")
            self.log.trim(2)
            self.token = 0

    def check(self) -> None:
        """Raise ``Stale`` if another holder came after this one's time was over."""
        if self.token and self.log.last() != self.token:
            raise Stale("the lock has passed to another operation")

    def renew(self, operation: str, seconds: float) -> None:
        self.check()
        if self.token:
            self.log.rewrite(self.token, {"operation": operation, "until": self.clock() + seconds})


class Flights:
    """Publishers in flight, each for a limited time."""

    #: Clocks of several drivers may differ by so many seconds.
    SKEW = 60

    def __init__(self, files: Files, clock=time.time) -> None:
        self.files, self.clock = files, clock

    @contextmanager
    def flight(self, seconds: float) -> Iterator[str]:
        name = uuid.uuid4().hex
        self.files.create(f"inflight/{name}.json", {"until": self.clock() + seconds})
        try:
            yield name
        finally:
            self.files.delete(f"inflight/{name}.json")

    def check(self, name: str) -> None:
        at = self.files.load(f"inflight/{name}.json")
        if at is None or at["until"] <= self.clock():
            raise Stale("the publication took longer than its time")

    def now(self) -> list[str]:
        """Those that may still commit."""
        out = []
        for name in self.files.names("inflight"):
            at = self.files.load(f"inflight/{name}")
            if at is not None and at["until"] + self.SKEW > self.clock():
                out.append(name.removesuffix(".json"))
        return out

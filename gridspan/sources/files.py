"""Small metadata files in whatever store Spark's paths lead to."""

from __future__ import annotations

import json
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

LOCK = "_meta/lock"


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._path("")
        self.fs = path.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(path).toUri(), conf)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        self.over = spark.sparkContext._gateway.new_array(kind, 1)
        self.over[0] = kind.OVERWRITE

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Write beside the place, then move there in one step: readers see the old file or the new one, never none."""
        temporary = self._path(f"{name}.{uuid.uuid4()}.tmp")
        self._create(temporary, True, value)
        place = self.fs.makeQualified
        self.context.rename(place(temporary), place(self._path(name)), self.over)

    def _create(self, path, overwrite: bool, value: dict) -> None:
        stream = self.fs.create(path, overwrite)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def names(self, folder: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    @contextmanager
    def lock(self, patience: float = 60.0, lease: float = 60.0) -> Iterator[Lock]:
        """One writer at a time, by a file that only one can create.

        The file names its owner and the end of its lease, which is renewed while the block runs. A lock whose lease is over
        belonged to a writer that died; it is moved away, which only one of those who wait can do.
        """
        lock, end = Lock(self, lease), time.time() + patience
        while not lock.take():
            if time.time() > end:
                raise TimeoutError(f"{self.root} is locked by another writer")
            time.sleep(0.1)
        stop = threading.Event()
        renew = threading.Thread(target=lock.renew, args=(stop,), daemon=True)
        renew.start()
        try:
            yield lock
        finally:
            stop.set()
            renew.join()
            if lock.held():
                self.delete(LOCK)


class Lock:
    def __init__(self, files: Files, lease: float) -> None:
        self.files, self.lease, self.owner = files, lease, str(uuid.uuid4())

    def _state(self) -> dict:
        return {"owner": self.owner, "until": time.time() + self.lease}

    def _seen(self) -> dict:
        try:
            return self.files.read(LOCK)
        except Exception:  # just removed, or just created and not yet written
            return {}

    def take(self) -> bool:
        try:
            self.files._create(self.files._path(LOCK), False, self._state())
        except Exception:
            # An unreadable lock is given the time that writing it may take.
            seen = self._seen() or (time.sleep(1.0), self._seen())[1]
            if seen.get("until", time.time() + 1) < time.time():
                gone = f"{LOCK}.{uuid.uuid4()}.gone"
                if self.files.fs.rename(self.files._path(LOCK), self.files._path(gone)):
                    self.files.delete(gone)
            return False
        return self.held()

    def held(self) -> bool:
        return self._seen().get("owner") == self.owner

    def check(self) -> None:
        """To be called before a commit: a writer that lost its lock must not go on."""
        if not self.held():
            raise TimeoutError(f"{self.files.root}: the lock was lost to another writer")

    def renew(self, stop: threading.Event) -> None:
        while not stop.wait(self.lease / 3):
            if self.held():
                self.files.write(LOCK, self._state())


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below the session's checkpoint folder; a temporary one on a single machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared}/tables-{uuid.uuid4()}" if shared else tempfile.mkdtemp(prefix="tables")

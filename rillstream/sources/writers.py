"""Open files of one task: a bounded number, the least recently used closed first, idle ones after a while.

Files are written under hidden names that no other attempt of any task uses; publish() gives them their real names once
all tasks have ended well, so that a task that is run again leaves nothing behind that a reader sees.
"""

from __future__ import annotations

import gzip
import os
import socket
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from rillstream.plans.scratch import staged

MANIFEST = "hidden string, file string, rows long"


def qualified(spark: SparkSession, base: str) -> str:
    """base as a URI: a bare path belongs to the default file system of the cluster, not to the machine of a task."""
    if "://" not in base and not base.startswith("file:"):
        at = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()
    if base.startswith("file:/") and not base.startswith("file://"):
        base = f"file://{base[5:]}"
    return base


def opened(base: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path of base in it."""
    return pafs.FileSystem.from_uri(quote(base, safe="/:@%?=&"))


@dataclass
class Writer:
    raw: pa.NativeFile
    sink: object
    hidden: str
    name: str
    rows: int
    last: float


class WriterCache:
    """Writers by path. `{suffix}` in a path becomes host_time_number, which grows; a path without it is opened once.

    max_open: files open at once, 0 for any number; ttl_s: a file that got nothing for so long is closed at the next write.
    """

    def __init__(self, base: str, zipped: bool = False, max_open: int = 0, ttl_s: float = 0, clock: Callable[[], float] = time.monotonic):
        self.files, self.root = opened(base)
        self.zipped, self.max_open, self.ttl_s, self.clock = zipped, max_open, ttl_s, clock
        self.token, self.created = uuid.uuid4().hex, 0
        self.open: OrderedDict[str, Writer] = OrderedDict()
        self.names: set[str] = set()
        self.before_close: list[Callable[[str], None]] = []
        self.after_close: list[Callable[[str], None]] = []
        self.done: list[tuple[str, str, int]] = []

    def requires_new(self, path: str) -> bool:
        return path not in self.open

    def free(self) -> int:
        """How many more files may be opened; 1 where there is no limit."""
        return self.max_open - len(self.open) if self.max_open else 1

    def write(self, path: str, line: bytes) -> None:
        now = self.clock()
        while self.ttl_s and self.open and now - next(iter(self.open.values())).last >= self.ttl_s:
            self.close_path(next(iter(self.open)))
        writer = self.open.get(path) or self._create(path)
        self.open.move_to_end(path)
        writer.sink.write(line)
        writer.rows += 1
        writer.last = now

    def _create(self, path: str) -> Writer:
        while self.max_open and len(self.open) >= self.max_open:
            self.close_path(next(iter(self.open)))
        name = path.replace("{suffix}", f"{socket.gethostname()}_{int(time.time())}_{self.token[:8]}{self.created:04d}")
        name += ".gz" if self.zipped and not name.endswith(".gz") else ""
        if name in self.names:
            raise ValueError(f"{path} was closed and has no {{suffix}} to be opened again")
        self.names.add(name)
        folder, own = os.path.split(f"{self.root.rstrip('/')}/{name}")
        self.files.create_dir(folder, recursive=True)
        hidden = f"{os.path.dirname(name)}/.{self.token}-{self.created}.part".lstrip("/")
        raw = self.files.open_output_stream(f"{self.root.rstrip('/')}/{hidden}", compression=None)
        self.created += 1
        self.open[path] = Writer(raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.zipped else raw, hidden, name, 0, self.clock())
        return self.open[path]

    def close_path(self, path: str) -> None:
        """Closes one file; nothing happens where it is not open."""
        writer = self.open.pop(path, None)
        if writer is None:
            return
        for hook in self.before_close:
            hook(path)
        writer.sink.close()
        if not writer.raw.closed:
            writer.raw.close()
        self.done.append((writer.hidden, writer.name, writer.rows))
        for hook in self.after_close:
            hook(path)

    def close(self) -> None:
        for path in list(self.open):
            self.close_path(path)

    def finished(self) -> pa.RecordBatch:
        """What was closed since the last call: hidden name, name and rows."""
        done, self.done = self.done, []
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["hidden", "file", "rows"])


def publish(manifest: DataFrame, base: str) -> DataFrame:
    """Names the files of a manifest; a file of that name is replaced. Done again it finds its work done. file and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(base)
        for batch in batches:
            for hidden, name in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                old, new = (f"{root.rstrip('/')}/{x}" for x in (hidden, name))
                kinds = [i.type for i in files.get_file_info([old, new])]
                if kinds[0] == pafs.FileType.NotFound and kinds[1] == pafs.FileType.File:
                    continue
                if kinds[1] == pafs.FileType.File:
                    files.delete_file(new)
                files.move(old, new)
            yield pa.RecordBatch.from_arrays([batch[1], batch[2]], names=["file", "rows"])

    return staged(staged(manifest, "hidden-files").mapInArrow(run, "file string, rows long"), "files")

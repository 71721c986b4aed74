"""What producers push, as data sources of their own: requests with documents, and blobs by their digest.

``lectern_requests`` reads logs of requests, one JSON object a line, as a table or a stream: tasks
take ranges of bytes, a stream's offsets are the bytes read of each file, and a request that breaks a
rule comes as a row that says so, so nothing is decided on the driver. ``lectern_blobs`` writes files
named by their content: a task stages what it gets, checks digest and size, and shows it when all of
it is there. What became of each blob is said when the job ends, by one attempt of each task.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lectern.plans import shipping

#: Documents in one request, and bytes of a range.
MOST, RANGE = 500, 32 << 20
FIELDS = ("doc_id", "course_id", "kind", "title", "text", "timemodified")
REQUIRED = ("doc_id", "kind")
REQUESTS = "request string, sync_id string, doc_id string, course_id string, kind string, title string, text string, timemodified long, rejected string"


def _files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    found = fs.get_file_info(pafs.FileSelector(at)) if fs.get_file_info(at).type == pafs.FileType.Directory else [fs.get_file_info(at)]
    return fs, sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class _Range(InputPartition):
    """Lines that begin in [start, end) of a file."""

    file: str
    start: int
    end: int


def _lines(fs: pafs.FileSystem, r: _Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the range; the first begins after a line feed, the last may end behind the range."""
    with io.BufferedReader(fs.open_input_file(r.file), 1 << 20) as f:
        at = r.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        f.seek(at)
        while at < r.end:
            line = f.readline()
            if not line:
                return
            yield at, line
            at += len(line)


def _documents(place: str, line: bytes, most: int) -> Iterator[tuple]:
    """A row for each document of a request, or one that says why there is none."""
    def refused(why: str, sync_id=None, doc_id=None) -> tuple:
        return (place, sync_id, doc_id, None, None, None, None, None, why)

    try:
        body = json.loads(line)
    except ValueError:
        yield refused("not JSON")
        return
    items, sync_id = (body, None) if isinstance(body, list) else (body.get("documents"), body.get("sync_id")) if isinstance(body, dict) else (None, None)
    if not isinstance(items, list):
        yield refused("no documents", sync_id)
    elif len(items) > most:
        yield refused(f"at most {most} documents per request", sync_id)
    else:
        for d in items:
            missing = [f for f in REQUIRED if not isinstance(d, dict) or d.get(f) in (None, "")]
            if missing:
                yield refused(f"{missing[0]} is missing", sync_id, str(d["doc_id"]) if isinstance(d, dict) and d.get("doc_id") not in (None, "") else None)
            else:
                own = [None if d.get(f) is None else str(d[f]) for f in FIELDS[:-1]]
                when = d.get("timemodified")
                yield (place, sync_id, *own, when if isinstance(when, int) else None, None)


class _Reading:
    def __init__(self, options: dict):
        self.path, self.most, self.range = options["path"], int(options.get("mostdocuments", MOST)), int(options.get("rangebytes", RANGE))

    def _ranges(self, file: str, start: int, end: int) -> list[_Range]:
        return [_Range(file, a, min(a + self.range, end)) for a in range(start, end, self.range)]

    def read(self, partition: _Range):
        fs, _ = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        for at, line in _lines(fs, partition):
            if line.strip():
                yield from _documents(f"{partition.file.rsplit('/', 1)[-1]}:{at}", line, self.most)


class _Table(_Reading, DataSourceReader):
    def partitions(self):
        return [r for f in _files(self.path)[1] for r in self._ranges(f.path, 0, f.size)]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Of each file the bytes up to its last line feed: a line that is being written waits."""
        fs, files = _files(self.path)
        return {f.path: self._whole(fs, f) for f in files}

    @staticmethod
    def _whole(fs: pafs.FileSystem, f: pafs.FileInfo, block: int = 1 << 16) -> int:
        end = f.size
        with fs.open_input_file(f.path) as s:
            while end:
                start = max(0, end - block)
                s.seek(start)
                at = s.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict):
        return [r for f, to in end.items() for r in self._ranges(f, start.get(f, 0), to)]

    def commit(self, end: dict) -> None:
        pass  # the logs stay


class Requests(DataSource):
    """Options: path, mostDocuments (in a request), rangeBytes (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "lectern_requests"

    def schema(self) -> str:
        return REQUESTS

    def reader(self, schema):
        return _Table(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def outputs(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, what was rejected and why) of what the source reads."""
    return requests.where("rejected IS NULL").drop("rejected"), requests.where("rejected IS NOT NULL").select("request", "sync_id", "doc_id", "rejected")


# Blobs

MOST_BYTES = 25 << 20


@dataclass
class _Written(WriterCommitMessage):
    stored: int
    present: int
    refused: int
    outcomes: str | None = None


def blob_path(root: str, sha256: str) -> str:
    return f"{root}/{sha256[:2]}/{sha256}"


class _Blobs(DataSourceWriter):
    def __init__(self, options: dict):
        self.uri = options["path"] if "://" in options["path"] else f"file://{options['path']}"
        self.most, self.job = int(options.get("mostbytes", MOST_BYTES)), uuid.uuid4().hex

    def _open(self) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        return fs, root.rstrip("/")

    def write(self, iterator) -> _Written:
        """Stages each new blob and says what became of it; shown are they when the task has read all its rows."""
        fs, root = self._open()
        task, name = TaskContext.get(), uuid.uuid4().hex
        part = f"{root}/_staging/{self.job}/{task.partitionId() if task else 0}"
        own, said, outcomes = f"{part}/{name}", [], None
        staged = []
        fs.create_dir(own)
        for row in iterator:
            sha, content = row["sha256"], bytes(row["content"] or b"")
            if len(content) > self.most:
                said.append((sha, "too large"))
            elif hashlib.sha256(content).hexdigest() != sha:
                said.append((sha, "digest differs"))
            elif fs.get_file_info(blob_path(root, sha)).type != pafs.FileType.NotFound:
                said.append((sha, "present"))
            else:
                with fs.open_output_stream(f"{own}/{sha}") as out:
                    out.write(content)
                staged.append(sha)
                said.append((sha, "stored"))
        # Told before any is shown: to another attempt of this task they are what the job stored, not what was there.
        with fs.open_output_stream(f"{part}/{name}.shown") as out:
            out.write("".join(s + "\n" for s in staged).encode())
        for sha in staged:
            fs.create_dir(f"{root}/{sha[:2]}")
            fs.move(f"{own}/{sha}", blob_path(root, sha))
        earlier = set()
        for f in fs.get_file_info(pafs.FileSelector(part)):
            if f.base_name.endswith(".shown") and f.base_name != f"{name}.shown":
                with fs.open_input_stream(f.path) as shown:
                    earlier.update(shown.read().decode().split())
        said = [(s, "stored" if o == "present" and s in earlier else o) for s, o in said]
        if said:
            outcomes = f"{part}/{name}.json"
            with fs.open_output_stream(outcomes) as out:
                out.write("".join(json.dumps({"sha256": s, "outcome": o}) + "\n" for s, o in said).encode())
        fs.delete_dir(own)
        said = Counter(o for _, o in said)
        return _Written(said["stored"], said["present"], said["too large"] + said["digest differs"], outcomes)

    def _clear(self) -> None:
        fs, root = self._open()
        if fs.get_file_info(f"{root}/_staging/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_staging/{self.job}")

    def commit(self, messages) -> None:
        fs, root = self._open()
        fs.create_dir(f"{root}/_outcomes/{self.job}")
        for said in (m.outcomes for m in messages if m and m.outcomes):
            fs.move(said, f"{root}/_outcomes/{self.job}/{said.rsplit('/', 1)[-1]}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()


class Blobs(DataSource):
    """Rows (sha256, content) as files by digest below ``path``; option mostBytes (of one)."""

    @classmethod
    def name(cls) -> str:
        return "lectern_blobs"

    def schema(self) -> str:
        return "sha256 string, content binary"

    def writer(self, schema, overwrite: bool):
        return _Blobs(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Requests)
    spark.dataSource.register(Blobs)


def put_blobs(blobs: DataFrame, path: str, most_bytes: int = MOST_BYTES) -> None:
    """Stores blobs (sha256, content) that are not there yet; each digest is written by one task, and other contents under it are refused."""
    register(blobs.sparkSession)
    blobs = blobs.select("sha256", F.coalesce("content", F.lit(b"")).alias("content")).withColumn("own", F.sha2("content", 256))
    blobs.dropDuplicates(["sha256", "own"]).drop("own").write.format("lectern_blobs").option("mostBytes", most_bytes).mode("append").save(path)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, outcome) of all that was offered: stored, present, too large, digest differs."""
    return spark.read.schema("sha256 string, outcome string").option("recursiveFileLookup", "true").json(f"{path}/_outcomes")


def blob_sizes(spark: SparkSession, path: str, empty: bool = False) -> DataFrame:
    """(sha256, bytes) of the blobs that are there, the empty one if ``empty``; contents are not read.

    Tasks list the folders and keep what they find: a reader of files would send each one's status to the driver.
    """
    shipping.ship(spark)
    options = {"path": path}

    def run(arrived):
        fs, root = _Blobs(options)._open()
        for batch in arrived:
            for n in batch.column("id").to_pylist():
                found = fs.get_file_info(pafs.FileSelector(f"{root}/{n:02x}", allow_not_found=True))
                found = [f for f in found if f.type == pafs.FileType.File and (f.size or empty)]
                yield pa.RecordBatch.from_arrays([pa.array([f.base_name for f in found], pa.string()), pa.array([f.size for f in found], pa.int64())], ["sha256", "bytes"])

    return spark.range(0, 256, 1, 64).mapInArrow(run, "sha256 string, bytes long")

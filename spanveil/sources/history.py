"""The store of past runs as a data source: a folder for each run, read by run and by call, and written the same way.

A run's folder (run-YYYYMMDD-HHMMSS-xxxx) has ``run.json``, and under ``calls`` a NNNN.json for each call and
NNNN-img-K files for its images. Views:

* ``runs``: run_id, prompt, started_at, finished_at, status and the number of calls (counted from the listing: no call is opened);
* ``run``: run_id and the whole record; ``calls``: run_id, call_id and the record without request and response;
* ``call``: run_id, call_id and the whole record; ``images``: run_id, call_id, image, media_type and content.

Filters on run_id and call_id are pushed down: other runs are not opened, nor listed where the ids are named. Records that do
not parse are left out, and so are folders of other names. Paths may be of any store that Arrow's file systems open.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage

# Names of run folders, and endings of images by media type.
RUN_ID = r"^run-[0-9]{8}-[0-9]{6}-[0-9a-f]{4}$"
SUFFIXES = {"image/png": ".png", "image/jpeg": ".jpg", "image/webp": ".webp"}
OTHER = ".bin"

VIEWS = {
    "runs": "run_id string, prompt string, started_at double, finished_at double, status string, calls long",
    "run": "run_id string, record string",
    "calls": "run_id string, call_id long, record string",
    "call": "run_id string, call_id long, record string",
    "images": "run_id string, call_id long, image int, media_type string, content binary",
}
#: Runs that one task reads.
RUNS = 64
LARGE = ("request", "response")


def _store(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if re.match(r"^[a-z0-9+.-]+:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _listed(store, path: str) -> list[str]:
    from pyarrow import fs

    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def _bytes(store, path: str) -> bytes | None:
    try:
        with store.open_input_stream(path) as f:
            return f.read()
    except OSError:
        return None


def _object(store, path: str) -> dict | None:
    raw = _bytes(store, path)
    try:
        value = json.loads(raw) if raw is not None else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


@dataclass
class _Runs(InputPartition):
    ids: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, view: str) -> None:
        self.path, self.view = path, view
        self.runs: set[str] | None = None
        self.calls: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo | EqualNullSafe) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("run_id",):
                self.runs = values if self.runs is None else self.runs & values
            elif values is not None and f.attribute == ("call_id",):
                self.calls = values if self.calls is None else self.calls & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        names = sorted(x for x in self.runs if x) if self.runs is not None else _listed(store, root)
        names = [n for n in names if re.match(RUN_ID, n)]
        return [_Runs(tuple(names[i : i + RUNS])) for i in range(0, len(names), RUNS)] or [_Runs(())]

    def _calls(self, store, folder: str, ending: str) -> Iterator[tuple[int, str]]:
        if self.calls is not None and ending == r"\.json":  # named: nothing is listed
            yield from ((c, f"{c:04d}.json") for c in sorted(x for x in self.calls if x is not None and x >= 1))
            return
        for name in _listed(store, folder):
            m = re.match(rf"^([0-9]+){ending}$", name)
            if m and int(m[1]) >= 1 and (self.calls is None or int(m[1]) in self.calls):
                yield int(m[1]), name

    def read(self, partition: _Runs) -> Iterator[tuple]:
        store, root = _store(self.path)
        for run in partition.ids:
            folder = f"{root}/{run}/calls"
            if self.view in ("runs", "run"):
                record = _object(store, f"{root}/{run}/run.json")
                if record is None:
                    continue
                if self.view == "run":
                    yield run, json.dumps(record)
                    continue
                at = [None if not isinstance(record.get(k), int | float) else float(record[k]) for k in ("started_at", "finished_at")]
                text = [None if record.get(k) is None else str(record[k]) for k in ("prompt", "status")]
                yield run, text[0], *at, text[1], sum(n.endswith(".json") for n in _listed(store, folder))
            elif self.view == "images":
                for call, name in self._calls(store, folder, r"-img-[0-9]+\.[a-z]+"):
                    number, ending = re.match(r"^[0-9]+-img-([0-9]+)(\.[a-z]+)$", name).groups()
                    kind = {v: k for k, v in SUFFIXES.items()}.get(ending, "application/octet-stream")
                    yield run, call, int(number), kind, _bytes(store, f"{folder}/{name}")
            else:
                for call, name in self._calls(store, folder, r"\.json"):
                    record = _object(store, f"{folder}/{name}")
                    if record is not None:
                        yield run, call, json.dumps({k: v for k, v in record.items() if self.view == "call" or k not in LARGE})


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    """Each file is written under another name and moved, so no reader meets half of one; a task that runs again writes the same files."""

    def __init__(self, path: str, view: str, columns: list[str]) -> None:
        self.path, self.view, self.columns = path, view, columns

    def _name(self, r: dict) -> tuple[str, bytes]:
        if not re.match(RUN_ID, r["run_id"] or ""):
            raise ValueError("a run's name is run-YYYYMMDD-HHMMSS-xxxx")
        if self.view == "run":
            return "run.json", json.dumps(json.loads(r["record"]), indent=1).encode()
        if (r["call_id"] or 0) < 1:
            raise ValueError("calls are numbered from 1")
        if self.view == "call":
            return f"calls/{r['call_id']:04d}.json", json.dumps(json.loads(r["record"]), indent=1).encode()
        return f"calls/{r['call_id']:04d}-img-{r['image']}{SUFFIXES.get(r['media_type'], OTHER)}", bytes(r["content"])

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        n = 0
        for row in iterator:
            r = row.asDict()
            name, content = self._name(r)
            store.create_dir(f"{root}/{r['run_id']}/calls", recursive=True)
            full = f"{root}/{r['run_id']}/{name}"
            part = f"{full}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write(content)
            store.move(part, full)
            n += 1
        return _Written(n)


class RunHistory(DataSource):
    """spark.read.format("run_history").option("view", "calls").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "run_history"

    def _view(self) -> str:
        view = self.options.get("view", "runs")
        if view not in VIEWS:
            raise ValueError(f"no view {view}; there are {', '.join(VIEWS)}")
        return view

    def schema(self) -> str:
        return VIEWS[self._view()]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].rstrip("/"), self._view())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if self._view() not in ("run", "call", "images"):
            raise ValueError("runs, calls and images are written by the views run, call and images")
        return _Writer(self.options["path"].rstrip("/"), self._view(), schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunHistory)


def view(spark: SparkSession, folder: str, name: str = "runs") -> DataFrame:
    """A view of a store."""
    register(spark)
    return spark.read.format("run_history").option("view", name).load(folder)


def save(rows: DataFrame, folder: str, name: str) -> None:
    """Writes runs (``run``), calls (``call``) or images; a record that is there is replaced."""
    register(rows.sparkSession)
    columns = [c.split()[0] for c in VIEWS[name].split(", ")]
    rows.select(*columns).write.format("run_history").option("view", name).mode("append").save(folder)

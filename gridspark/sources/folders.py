"""Experiment folders as a data source of Spark: ``spark.read.format("experiments")`` and a sink for observations.

A folder is named name-power-heat-gas-mes-density and holds performance.csv and, if there were faults, failure.csv and
repair.csv, each a file or a folder of part files.  Filters on what the name says choose folders before their files
are listed.  Paths are those that pyarrow's file systems can open on the driver and on the executors alike.
"""

from __future__ import annotations

import csv
import io
import json
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

DESCRIPTORS = ("power_impact", "heat_impact", "gas_impact", "mes_impact")
_EVENTS = "ordinal long, step long, node string, type string, id long"
TABLES = {"performance": "step long, c0 double, c1 double, c2 double, id long", "failure": _EVENTS, "repair": _EVENTS}
#: Columns of the files that have another name in the table; the one without a name is the row's place in its flush.
NAMES = {"performance": {"": "step", "0": "c0", "1": "c1", "2": "c2"}, "failure": {"": "ordinal"}, "repair": {"": "ordinal"}}
OBSERVATIONS = "experiment string, id long, key string, position long, value string"
#: Bytes of a file that one task reads.
RANGE = 64 << 20
#: Rows of one part file of the sink.
FLUSH = 50_000


def described(folder: str) -> dict[str, object] | None:
    """What a folder's name says, None if it is not one of an experiment."""
    parts = folder.split("-")
    try:
        density = float(parts[5])
    except (IndexError, ValueError):
        return None
    return {"experiment": f"data/results/{folder}", **dict(zip(DESCRIPTORS, parts[1:5], strict=True)), "cp_density": density}


def _rank(x: object) -> tuple[bool, object]:
    """Spark's order: NaN is equal to itself and greater than all other numbers."""
    nan = isinstance(x, float) and math.isnan(x)
    return nan, 0.0 if nan else x


def holds(f: ds.Filter, values: dict[str, object]) -> bool | None:
    """Whether a folder passes a filter; None if the name does not tell."""
    if isinstance(f, ds.Not):
        inner = holds(f.child, values)
        return None if inner is None else not inner
    if len(f.attribute) != 1 or f.attribute[0] not in values:
        return None
    x = values[f.attribute[0]]
    if isinstance(f, ds.IsNull | ds.IsNotNull):
        return isinstance(f, ds.IsNotNull)
    if isinstance(f, ds.In):
        return any(v is not None and _rank(v) == _rank(x) for v in f.value)
    if f.value is None:
        return None
    a, b = _rank(x), _rank(f.value)
    tests = {ds.EqualTo: a == b, ds.EqualNullSafe: a == b, ds.GreaterThan: a > b, ds.GreaterThanOrEqual: a >= b, ds.LessThan: a < b, ds.LessThanOrEqual: a <= b}
    if isinstance(x, str):
        tests |= {ds.StringStartsWith: x.startswith(f.value), ds.StringEndsWith: x.endswith(f.value), ds.StringContains: f.value in x}
    return tests.get(type(f))


@dataclass
class Range(ds.InputPartition):
    """Bytes of one file: the lines that begin within them."""

    file: str | None
    begin: int
    end: int
    said: tuple[tuple[str, object], ...]


class ExperimentReader(ds.DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType) -> None:
        self.path, self.table, self.schema, self.filters = path, table, schema, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        probe = described("x-0-0-0-0-0") or {}
        for f in filters:
            if holds(f, probe) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Range]:
        """One for each range of each file of the folders that pass the filters."""
        system, root = fs.FileSystem.from_uri(self.path)
        chosen = []
        for info in system.get_file_info(fs.FileSelector(root)):
            said = described(info.base_name) if info.type == fs.FileType.Directory else None
            if said and all(holds(f, said) for f in self.filters):
                chosen.append((info.path, tuple(said.items())))
        chosen.sort()
        out = []
        for (folder, said), info in zip(chosen, system.get_file_info([f"{path}/{self.table}.csv" for path, _ in chosen]), strict=True):
            if info.type == fs.FileType.NotFound and self.table == "performance":
                raise FileNotFoundError(f"{folder} has no {self.table}.csv")
            files = [info] if info.type == fs.FileType.File else [] if info.type == fs.FileType.NotFound else sorted((x for x in system.get_file_info(fs.FileSelector(info.path)) if x.type == fs.FileType.File and x.extension == "csv"), key=lambda x: x.path)
            out += [Range(x.path, begin, min(x.size, begin + RANGE), said) for x in files for begin in range(0, x.size, RANGE)]
        return out or [Range(None, 0, 0, ())]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file is None:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.file) as f:
            header = next(csv.reader([_line(f).decode()]))
            f.seek(max(f.tell(), partition.begin - 1 if partition.begin else 0))
            if partition.begin > 0 and f.tell() == partition.begin - 1:
                _line(f)  # of the range before
            data = f.read(max(0, partition.end - f.tell()))
            if data and not data.endswith(b"\n"):
                data += _line(f)
        names = [NAMES[self.table].get(h, h) for h in header]
        target, own = to_arrow_schema(self.schema), {c.split()[0] for c in TABLES[self.table].split(", ")}
        types = {x.name: x.type for x in target if x.name in own}
        if not data:
            return
        convert = pyarrow.csv.ConvertOptions(column_types={n: types.get(n, pa.string()) for n in names}, null_values=["", "NaN", "nan"], strings_can_be_null=True)
        table = pyarrow.csv.read_csv(io.BytesIO(data), read_options=pyarrow.csv.ReadOptions(column_names=names, use_threads=False), convert_options=convert)
        said = dict(partition.said)
        for batch in table.to_batches():
            column = {n: batch.column(n) for n in names if n in types}
            yield pa.RecordBatch.from_arrays([column[x.name] if x.name in column else pa.array([said.get(x.name)] * batch.num_rows, x.type) for x in target], schema=target)


def _line(f: pa.NativeFile) -> bytes:
    """What is left of the current line."""
    out = b""
    while True:
        at, part = f.tell(), f.read(4096)
        end = part.find(b"\n")
        if end >= 0:
            f.seek(at + end + 1)
            return out + part[: end + 1]
        if not part:
            return out
        out += part


@dataclass
class Written(ds.WriterCommitMessage):
    """Staged files of a task and where they go."""

    files: list[tuple[str, str]]


class _Sink:
    """Each task writes files of its own beside the table; they get their names when the job, or the batch, is committed.

    What a task that failed, or was run twice, has written is never published.  A map gives a row with its columns, a
    list one with columns by place, a single value none; the run's id is added.
    """

    def __init__(self, path: str, name: str = "stream") -> None:
        self.path, self.name, self.token = path, name, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(self.path)
        context, files, groups, held = TaskContext.get(), [], {}, 0
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, uuid.uuid4().hex)

        def flush() -> None:
            for (experiment, key), rows in groups.items():
                columns = list(dict.fromkeys(c for _, row in rows for c in row))
                text = io.StringIO()
                out = csv.writer(text, lineterminator="\n")
                out.writerow(["", *columns])
                out.writerows([place, *(row.get(c) for c in columns)] for place, row in rows)
                staged = f"{root}/_staging/{self.token}/{attempt}-{len(files)}.csv"
                system.create_dir(staged.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(staged) as f:
                    f.write(text.getvalue().encode())
                files.append((staged, f"{root}/{experiment}/{key}.csv/part-{{}}-{part:05d}-{len(files):03d}.csv"))
            groups.clear()

        for row in iterator:
            value = json.loads(row["value"]) if row["value"] is not None else None
            if isinstance(value, list):
                value = {str(i): v for i, v in enumerate(value)}
            if isinstance(value, dict):
                names = (row["experiment"].rstrip("/").rsplit("/", 1)[-1], row["key"].replace("/", ""))
                groups.setdefault(names, []).append((row["position"], {**value, "id": row["id"]}))
                held += 1
                if held % FLUSH == 0:
                    flush()
        flush()
        return Written(files)

    def _publish(self, messages: list[Written | None], mark: str) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for staged, place in message.files if message else ():
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                system.move(staged, place.format(mark))
        self._clear(system, root)

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        staging = f"{root}/_staging/{self.token}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)

class ObservationWriter(_Sink, ds.DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._publish(messages, self.token)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))


class ObservationStreamWriter(_Sink, ds.DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        """A batch that was published before, but not known to be, is not published again."""
        system, root = fs.FileSystem.from_uri(self.path)
        done = f"{root}/_batches/{self.name}-{batchId}"
        if system.get_file_info(done).type == fs.FileType.NotFound:
            self._publish(messages, f"{self.name}-{batchId}")
            system.create_dir(f"{root}/_batches", recursive=True)
            system.open_output_stream(done).close()
        else:
            self._clear(system, root)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._clear(*fs.FileSystem.from_uri(self.path))


class Experiments(ds.DataSource):
    """Options: path, table (performance, failure or repair); of a stream that is written also name."""

    @classmethod
    def name(cls) -> str:
        return "experiments"

    def _table(self) -> str:
        table = self.options.get("table", "performance")
        if table not in TABLES:
            raise ValueError(f"{table} is none of {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return f"{TABLES[self._table()]}, experiment string, {', '.join(f'{c} string' for c in DESCRIPTORS)}, cp_density double"

    def reader(self, schema: StructType) -> ExperimentReader:
        return ExperimentReader(self.options["path"], self._table(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ObservationWriter:
        if overwrite:
            raise ValueError("observations are appended")
        return ObservationWriter(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> ObservationStreamWriter:  # noqa: N802
        return ObservationStreamWriter(self.options["path"], self.options.get("name", "stream"))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and has Spark hand filters to sources of this kind."""
    spark.dataSource.register(Experiments)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of all experiments under path; performance rows that lack a value are left out."""
    df = spark.read.format("experiments").option("table", table).load(path)
    return df.na.drop("any", subset=["step", "c0", "c1", "c2", "id"]) if table == "performance" else df


def append(observations: DataFrame, path: str) -> None:
    """Observations (experiment, id, key, position, value as JSON) as files of their experiments' folders."""
    observations.select(*(c.split()[0] for c in OBSERVATIONS.split(", "))).write.format("experiments").mode("append").save(path)

"""Day files: one Arrow (feather) file per day, as ``root/yyyy/yyyymmdd.feather``.

A data source for ``spark.read.format("day_files")`` and ``df.write.format("day_files")``.
Every file is one input partition, of which only the columns of the schema are read, batch
by batch.  Filters on ``date`` are answered from the names, so other files are not opened.
Names that are not eight digits, and folders that are not a year, are skipped.

Writing has two phases: tasks write complete files into a staging folder, and the commit
moves them to their places, day by day; what a killed task or job leaves behind is never
read.  The files may be in any store that ``pyarrow.fs`` can open.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_DAY, _YEAR = re.compile(r"([0-9]{8})\.feather"), re.compile(r"[0-9]{4}")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder and the folder's path in it."""
    if re.match(r"file:/[^/]", path):
        path = path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def years(store: pafs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in found if x.type == pafs.FileType.Directory and _YEAR.fullmatch(x.base_name))


def days_of(store: pafs.FileSystem, year: str) -> list[tuple[int, str]]:
    found = ((_DAY.fullmatch(x.base_name), x) for x in store.get_file_info(pafs.FileSelector(year)) if x.type == pafs.FileType.File)
    return sorted((int(m[1]), x.path) for m, x in found if m)


@dataclass
class DayFile(InputPartition):
    date: int | None
    path: str


@dataclass
class YearFolder(InputPartition):
    path: str


_TESTS = {EqualTo: lambda d, v: d == v, GreaterThan: lambda d, v: d > v, GreaterThanOrEqual: lambda d, v: d >= v, LessThan: lambda d, v: d < v, LessThanOrEqual: lambda d, v: d <= v, In: lambda d, v: d in v}


class DayReader(DataSourceReader):
    """Rows of the day files, with ``date`` from the name."""

    def __init__(self, root: str, schema: StructType):
        self.root, self.schema, self.tests = root, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("date",):
                self.tests.append((type(f), f.value))
            elif not (type(f).__name__ == "IsNotNull" and f.attribute == ("date",)):
                yield f

    def wanted(self, date: int) -> bool:
        return all(_TESTS[kind](date, value) for kind, value in self.tests)

    def partitions(self) -> list[DayFile]:
        store, root = opened(self.root)
        return [DayFile(d, p) for year in years(store, root) for d, p in days_of(store, year) if self.wanted(d)] or [DayFile(None, "")]

    def read(self, partition: DayFile) -> Iterator[pa.RecordBatch]:
        if partition.date is None:
            return
        store, _ = opened(self.root)
        target = to_arrow_schema(self.schema)
        with store.open_input_file(partition.path) as file:
            there = pa.ipc.open_file(file).schema
            names = [n for n in target.names if n != "date" and n in there.names]
            options = pa.ipc.IpcReadOptions(included_fields=[there.get_field_index(n) for n in names])
            batches = pa.ipc.open_file(file, options=options)
            for k in range(batches.num_record_batches):
                batch = batches.get_batch(k)
                yield pa.RecordBatch.from_arrays([_column(batch, f, partition.date) for f in target], schema=target)


def _column(batch: pa.RecordBatch, f: pa.Field, date: int) -> pa.Array:
    """A column of the batch in the wanted type; the date from the file's name; NULLs where the file has no such column."""
    if f.name == "date":
        return pa.repeat(pa.scalar(date, f.type), batch.num_rows)
    return batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type)


class CalendarReader(DataSourceReader):
    """Date and path of each day file, from the names alone; one input partition a year."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[YearFolder]:
        return [YearFolder(y) for y in years(*opened(self.root))] or [YearFolder("")]

    def read(self, partition: YearFolder) -> Iterator[tuple]:
        if partition.path:
            yield from days_of(opened(self.root)[0], partition.path)


@dataclass
class Staged(WriterCommitMessage):
    """Days that a task wrote, and where."""

    days: list[tuple[int, str]] = field(default_factory=list)


class DayWriter(DataSourceArrowWriter):
    """Streams rows, which come ordered by date, into one file per day."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.run = root, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = opened(self.root)
        done, date = Staged(), None
        with ExitStack() as file:
            for batch in iterator:
                dates = batch.column("date").to_pylist()
                rows = batch.drop_columns(["date"])
                starts = [k for k in range(len(dates)) if not k or dates[k] != dates[k - 1]]
                for start, end in zip(starts, [*starts[1:], len(dates)]):
                    if dates[start] != date:
                        file.close()
                        date = dates[start]
                        if not _DAY.fullmatch(f"{date}.feather"):
                            raise ValueError(f"{date} is not a date yyyymmdd")
                        if any(d == date for d, _ in done.days):
                            raise ValueError("rows of a day must come together: repartition and sort by date")
                        store.create_dir(f"{root}/_staging-{self.run}", recursive=True)
                        done.days.append((date, f"{root}/_staging-{self.run}/{date}-{uuid.uuid4().hex}"))
                        sink = file.enter_context(store.open_output_stream(done.days[-1][1]))
                        writer = file.enter_context(pa.ipc.new_file(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")))
                    writer.write_batch(rows.slice(start, end - start))
        return done

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = opened(self.root)
        days = [d for m in messages if m for d in m.days]
        if len({d for d, _ in days}) < len(days):
            self.abort(messages)
            raise ValueError("two tasks wrote the same day: repartition by date")
        there = {d for y in years(store, root) for d, _ in days_of(store, y)} & {d for d, _ in days}
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{len(there)} days are there already")
        for date, path in days:
            store.create_dir(f"{root}/{date // 10000}", recursive=True)
            store.move(path, f"{root}/{date // 10000}/{date}.feather")
        self.abort(messages)  # nothing but the empty folder, or files of tasks that ran twice

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = opened(self.root)
        folder = f"{root}/_staging-{self.run}"
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


class DayFiles(DataSource):
    """``path`` is the root; with the option ``names`` only dates and paths are read.

    Without a schema, that of the first file is taken.  A column that a file lacks is NULL.
    """

    @classmethod
    def name(cls) -> str:
        return "day_files"

    def _names_only(self) -> bool:
        return str(self.options.get("names", "false")).lower() == "true"

    def schema(self) -> StructType:
        if self._names_only():
            return StructType([StructField("date", IntegerType()), StructField("path", StringType())])
        store, root = opened(self.options["path"])
        for year in years(store, root):
            for _, path in days_of(store, year):
                with store.open_input_file(path) as file:
                    inside = from_arrow_schema(pa.ipc.open_file(file).schema, prefer_timestamp_ntz=True)
                return StructType([StructField("date", IntegerType()), *[f for f in inside if f.name != "date"]])
        raise ValueError(f"no day file below {root}")

    def reader(self, schema: StructType) -> DataSourceReader:
        return CalendarReader(self.options["path"]) if self._names_only() else DayReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DayWriter:
        if "date" not in schema.names:
            raise ValueError("day files need a column date")
        return DayWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it push filters to Python sources."""
    spark.dataSource.register(DayFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_days(spark: SparkSession, root: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of all day files; ``schema`` names the columns to read."""
    register(spark)
    reader = spark.read.format("day_files")
    return (reader.schema(schema) if schema is not None else reader).load(root)


def calendar(spark: SparkSession, root: str) -> DataFrame:
    """Dates that have a file."""
    register(spark)
    return spark.read.format("day_files").option("names", "true").load(root).select("date")


def write_days(rows: DataFrame, root: str, order: list[str], replace: bool = False) -> None:
    """One file for each date of ``rows``, in the order of the columns given."""
    register(rows.sparkSession)
    dealt = rows.repartition("date").sortWithinPartitions("date", *order)
    dealt.write.format("day_files").mode("overwrite" if replace else "append").save(root)


def day_of(ts) -> F.Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")

"""A sink for evaluation reports: ``df.write.format("report")`` makes JSON detail and a Markdown summary.

Each task writes its rows as lines of JSON in a file of its own and returns, for each label, how many rows and which sums it has seen.
The driver's commit adds these up, one row for each label and task, and writes the Markdown table and a summary; a report counts only
once its ``summary.json`` is there. A task copies its file to the report when it has all rows, and takes it back if the job has ended by
then; a job that fails leaves neither its files nor a summary. Any file system that Arrow opens by its
path will do.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import NumericType, StructType


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its file and for each label the rows, and the sum and number of each metric."""

    file: str
    rows: dict = field(default_factory=dict)
    sums: dict = field(default_factory=dict)


def _plain(value):
    if isinstance(value, Row):
        return value.asDict(True)
    return float(value) if isinstance(value, decimal.Decimal) else value.isoformat() if isinstance(value, dt.date) else str(value)


class ReportWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.title, self.label = options["path"].rstrip("/"), options.get("title", "Report"), options["label"]
        self.digits, self.notes = int(options.get("digits", 3)), options.get("notes", "")
        names = [n.strip() for n in options.get("metrics", "").split(",") if n.strip()]
        self.metrics = names or [f.name for f in schema if isinstance(f.dataType, NumericType) and f.name != self.label]
        self.job = uuid.uuid4().hex  # made before the writer is sent to the tasks
        if missing := {self.label, *self.metrics} - set(schema.names):
            raise ValueError(f"no columns {sorted(missing)}")
        system, root = self._open()
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{self._mark()}"):
            pass

    def _mark(self) -> str:
        """A file that is there while the job runs, so that a task which outlives it takes its own file back."""
        return f"_running-{self.job}"

    def _ended(self, system: fs.FileSystem, root: str) -> bool:
        return system.get_file_info(f"{root}/{self._mark()}").type == fs.FileType.NotFound

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Part:
        system, root = self._open()
        context = TaskContext.get()
        part = Part(f"detail/{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}.json")
        values: dict = {}
        with tempfile.TemporaryFile() as own:  # a task that is killed has put nothing into the report
            for row in iterator:
                d = row.asDict(True)
                own.write((json.dumps(d, default=_plain, ensure_ascii=False) + "\n").encode())
                label = str(d[self.label])
                part.rows[label] = part.rows.get(label, 0) + 1
                for m in self.metrics:
                    if d[m] is not None and not math.isnan(d[m]):
                        total = values.setdefault((label, m), [0.0, 0])
                        total[0], total[1] = total[0] + float(d[m]), total[1] + 1
            own.seek(0)
            system.create_dir(f"{root}/detail", recursive=True)
            file, early = f"{root}/{part.file}", f"{root}/{part.file}.part"
            with system.open_output_stream(early) as out:
                shutil.copyfileobj(own, out, 1 << 20)
        if not self._ended(system, root):
            system.move(early, file)
            early = file
        if self._ended(system, root):
            if system.get_file_info(early).type != fs.FileType.NotFound:
                system.delete_file(early)
            raise RuntimeError("the job of this report has ended")
        part.sums = values
        return part

    def commit(self, messages: list[Part | None]) -> None:
        system, root = self._open()
        rows: dict = {}
        sums: dict = {}
        for m in (m for m in messages if m is not None):
            for label, n in m.rows.items():
                rows[label] = rows.get(label, 0) + n
            for key, (total, n) in m.sums.items():
                sums.setdefault(key, []).append((total, n))
        mean = {k: math.fsum(t for t, _ in parts) / sum(n for _, n in parts) for k, parts in sums.items()}
        files = sorted(m.file for m in messages if m is not None)
        lines = [f"# {self.title}", "", *([self.notes, ""] if self.notes else []), f"| {self.label} | rows | " + " | ".join(self.metrics) + " |", "|" + "---|" * (2 + len(self.metrics))]
        for label in sorted(rows):
            lines.append(f"| {label} | {rows[label]} | " + " | ".join("—" if (label, m) not in mean else f"{mean[label, m]:.{self.digits}f}" for m in self.metrics) + " |")
        summary = {"title": self.title, "files": files, "rows": rows, "means": {label: {m: mean.get((label, m)) for m in self.metrics} for label in sorted(rows)}}
        for name, text in (("report.md", "\n".join(lines) + "\n"), ("summary.json", json.dumps(summary, ensure_ascii=False, indent=1))):  # the summary last
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(text.encode())
        system.delete_file(f"{root}/{self._mark()}")

    def abort(self, messages: list[Part | None]) -> None:
        system, root = self._open()
        if not self._ended(system, root):
            system.delete_file(f"{root}/{self._mark()}")
        for f in system.get_file_info(fs.FileSelector(f"{root}/detail", allow_not_found=True)):  # those of tasks that sent no message too
            if f.base_name.startswith(self.job):
                system.delete_file(f.path)


class ReportSource(DataSource):
    """Options: path (a new folder), label (the column that rows are summed up by), metrics (comma-joined; all numbers by default), title, notes, digits."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        if overwrite:
            raise ValueError("a report is written to a new folder")
        return ReportWriter(schema, self.options)


def write_report(rows: DataFrame, path: str, label: str, **options: str) -> None:
    """Writes ``rows`` as a report to a new folder."""
    rows.sparkSession.dataSource.register(ReportSource)
    writer = rows.write.format("report").mode("append").option("path", path).option("label", label)
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.save()


def read_detail(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of a report that was committed, from the files that its summary names."""
    summary = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/summary.json").collect()))
    if not summary["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/{f}" for f in summary["files"]])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the Markdown table of a report, without its head."""
    return spark.read.text(f"{path}/report.md").where("value LIKE '| %'").where("value NOT LIKE '% rows | %'").withColumnRenamed("value", "line")

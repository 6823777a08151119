"""A Spark data source for CSV members of zip archives on the shared store, and its counterpart that writes them."""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from riskloom.sources.shared_files import create, files_in, open_seekable

BATCH_ROWS = 8_192


class ZipMember(InputPartition):
    def __init__(self, archive: str, member: str):
        super().__init__((archive, member))
        self.archive, self.member = archive, member


class ZippedCsvReader(DataSourceReader):
    def __init__(self, names: list[str], options: dict[str, str]):
        self.names = names
        self.archives = json.loads(options["archives"])
        self.pattern = options.get("member", r".*\.csv")
        self.strict = options.get("strict", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        """A member is one stream, hence one task; only the archives' indexes are read here."""
        members = []
        for place in self.archives:
            for path in files_in(place, ".zip"):
                with open_seekable(path) as raw, zipfile.ZipFile(raw) as archive:
                    members += [ZipMember(path, n) for n in sorted(archive.namelist()) if re.fullmatch(self.pattern, n)]
        if not members:
            raise FileNotFoundError(f"no member like {self.pattern} in {', '.join(self.archives)}")
        return members

    def read(self, partition: ZipMember) -> Iterator[pa.RecordBatch]:
        with open_seekable(partition.archive) as file, zipfile.ZipFile(file) as archive, archive.open(partition.member) as raw:
            rows = csv.reader(io.TextIOWrapper(raw, encoding="utf-8", newline=""))
            header = next(rows, [])
            file_names = [n for n in self.names if n != "member"]
            if self.strict and header != file_names:
                raise ValueError(f"log columns do not match\nexpected: {file_names}\nfound:    {header}")
            batch: list[list[str]] = []
            for row in rows:
                if not row:
                    continue
                batch.append(row)
                if len(batch) == BATCH_ROWS:
                    yield self._batch(batch, header, partition.member)
                    batch = []
            if batch:
                yield self._batch(batch, header, partition.member)

    def _batch(self, rows: list[list[str]], header: list[str], member: str) -> pa.RecordBatch:
        at = {name: i for i, name in enumerate(header)}
        columns = []
        for name in self.names:
            i = at.get(name, len(header))
            values = [member] * len(rows) if name == "member" else [r[i] if i < len(r) else "" for r in rows]
            columns.append(pa.array(values, pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=self.names)


class ZippedCsvSource(DataSource):
    """``zipped_csv``: one partition per archive member that matches ``member``.

    ``archives`` is a JSON list of archives, or folders of them, on any store that the workers can
    open (``shared_files``). Columns come from the header of each member; a requested column ``member``
    holds the member's name.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        raise ValueError("zipped_csv needs an explicit schema")

    def reader(self, schema) -> DataSourceReader:
        return ZippedCsvReader([f.name for f in schema.fields], dict(self.options))


def write_zipped_csv(df: DataFrame, folder: str, member: str = "log.csv") -> DataFrame:
    """Write one zip archive with one CSV member per task: (path, rows) of the archives. Only those count; an
    attempt that failed leaves files that the result does not name. Nulls become empty."""
    header = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, rows = f"{folder}/{uuid.uuid4().hex}.zip", 0
        with create(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(member, "w", force_zip64=True) as raw:
            text = io.TextIOWrapper(raw, encoding="utf-8", newline="")
            lines = csv.writer(text)
            lines.writerow(header)
            for batch in batches:
                lines.writerows(zip(*(c.to_pylist() for c in batch.columns)))
                rows += batch.num_rows
            text.flush()
            text.detach()
        yield pa.RecordBatch.from_pydict({"path": [path], "rows": [rows]})

    return df.mapInArrow(work, "path string, rows bigint")

"""Tables whose replaces are seen whole or not at all.

A table is a folder of partitions, each of which holds one folder for every time it
was written, and a row of numbered versions.  A version is a small file that
names the folder of each partition.  A replace writes new folders beside the old
ones, which no reader looks at, and then puts the next version in place by one
rename; readers take the highest version.  A job that dies in between has changed
nothing, and its rerun starts from the old state.

    table/batchid=5/created_date=2024-01-03/written=4f…/part-….parquet
    table/_versions/000000000007/folders.json

The driver holds one entry for each partition, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zealmark.functions.columns import moment
from zealmark.sources.claims import claim, claimed, read_text
from zealmark.sources.files import filesystem, hadoop_path, partition_folders
from zealmark.sources.state import CREATED_DATE, sized_files

VERSIONS, STAGING, MARK = "_versions", "_staging", "written"
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"

# values of the partition columns, as in the folder names
Values = tuple[str, ...]


class ReplaceConflict(RuntimeError):
    """Another writer has put a version in place since this replace began; run it again."""


class Snapshot(NamedTuple):
    """A version: its number and the folder of each partition. Number 0 is the empty table."""

    number: int
    folders: dict[Values, str]


class Prepared(NamedTuple):
    """What a replace has written and will put in place."""

    base: int
    folders: dict[Values, str]


class VersionedTable:
    """Table at ``path``, split by ``parts``; ``day_of`` names the time whose day is the last of them."""

    def __init__(self, spark: SparkSession, path: str, parts: Sequence[str], day_of: str | None = None):
        self.spark, self.path, self.day_of = spark, path.rstrip("/"), day_of
        self.parts = (*parts, CREATED_DATE) if day_of else tuple(parts)
        self._fs = filesystem(spark, self.path)

    # --- reading -----------------------------------------------------------------------

    def current(self) -> Snapshot:
        number = max(claimed(self.spark, f"{self.path}/{VERSIONS}"), default=0)
        return self.snapshot(number)

    def snapshot(self, number: int) -> Snapshot:
        if number == 0:
            return Snapshot(0, {})
        listed = json.loads(read_text(self.spark, f"{self.path}/{VERSIONS}", number))
        return Snapshot(number, {tuple(values): folder for *values, folder in listed})

    def read(self, schema: T.StructType, wanted: Callable[[Values], bool] | None = None, at: Snapshot | None = None) -> DataFrame:
        """Rows of the newest version (or of ``at``) in the columns of ``schema``; only the partitions ``wanted`` are opened."""
        snapshot = at or self.current()
        folders = [f"{self.path}/{folder}" for values, folder in snapshot.folders.items() if wanted is None or wanted(values)]
        if not folders:
            return self.spark.createDataFrame([], schema)
        kinds = {field.name: field for field in schema}
        extra = [T.StructField(p, T.DateType() if p == CREATED_DATE else T.StringType()) for p in self.parts if p not in kinds]
        full = T.StructType([*schema.fields, *extra, T.StructField(MARK, T.StringType())])
        return self.spark.read.schema(full).option("basePath", self.path).parquet(*folders).select([f.name for f in schema])

    def read_after(self, schema: T.StructType, after: datetime | None) -> DataFrame:
        """Rows later than ``after`` by the table's time; older days are not opened."""
        if after is None or self.day_of is None:
            return self.read(schema)
        day = after.date().isoformat()
        return self.read(schema, lambda values: _is_day(values[-1]) and values[-1] >= day).where(F.col(self.day_of) > moment(after))

    def last_day(self) -> datetime | None:
        days = [values[-1] for values in self.current().folders if _is_day(values[-1])]
        return datetime.fromisoformat(max(days)) if days else None

    # --- replacing ---------------------------------------------------------------------

    def prepare(self, rows: DataFrame, gone: Callable[[Values], bool], base: Snapshot | None = None) -> Prepared:
        """Write ``rows`` beside the table: the next version has them, and of the old partitions those that are neither ``gone`` nor rewritten.

        The plan of ``rows`` runs once; which partitions it made is read from the folders it left.
        """
        base = base or self.current()
        mark = uuid.uuid4().hex
        if self.day_of:
            rows = rows.withColumn(CREATED_DATE, F.col(self.day_of).cast("date"))
        staging = f"{self.path}/{STAGING}/{mark}"
        sized_files(rows, *self.parts).write.partitionBy(*self.parts).parquet(staging)
        fresh: dict[Values, str] = {}
        for values, folder in partition_folders(self.spark, staging, self.parts):
            place = "/".join(f"{part}={value}" for part, value in zip(self.parts, values))
            self._fs.mkdirs(hadoop_path(self.spark, f"{self.path}/{place}"))
            if not self._fs.rename(folder, hadoop_path(self.spark, f"{self.path}/{place}/{MARK}={mark}")):
                raise OSError(f"cannot move {folder}")
            fresh[values] = f"{place}/{MARK}={mark}"
        self._fs.delete(hadoop_path(self.spark, staging), True)
        kept = {values: folder for values, folder in base.folders.items() if not gone(values)}
        return Prepared(base.number, kept | fresh)

    def commit(self, prepared: Prepared) -> int:
        """Put a prepared version in place by one rename; from then on readers see it."""
        number = prepared.base + 1
        text = json.dumps([[*values, folder] for values, folder in sorted(prepared.folders.items())])
        if not claim(self.spark, f"{self.path}/{VERSIONS}", number, text):
            raise ReplaceConflict(f"{self.path}: version {number} is there already")
        return number

    def replace_batches(self, rows: DataFrame, batches: Sequence[int] | None = None) -> int:
        """Replace ``batches`` (without them those in ``rows``) whole: days and rows that they have lost go as well."""
        base = self.current()
        if batches is not None:
            named = {str(batch) for batch in batches}
            return self.commit(self.prepare(rows, lambda values: values[0] in named, base))
        written = self.prepare(rows, lambda values: False, base)
        held = {values[0] for values, folder in written.folders.items() if base.folders.get(values) != folder}
        left = {v: f for v, f in written.folders.items() if v[0] not in held or base.folders.get(v) != f}
        return self.commit(Prepared(base.number, left))

    def prepare_window(self, rows: DataFrame, cut: datetime) -> Prepared:
        """Replace all rows after ``cut``: older days are neither read nor written, and the day of the cut keeps its earlier rows."""
        base, edge = self.current(), cut.date().isoformat()
        kept = self.read(rows.schema, lambda values: values[-1] == edge, base).where(F.col(self.day_of) <= moment(cut))
        return self.prepare(kept.unionByName(rows), lambda values: _is_day(values[-1]) and values[-1] >= edge, base)

    def replace_window(self, rows: DataFrame, cut: datetime) -> int:
        return self.commit(self.prepare_window(rows, cut))

    def drop_batches(self, batches: Sequence[int | str]) -> int:
        base, named = self.current(), {str(batch) for batch in batches}
        return self.commit(Prepared(base.number, {v: f for v, f in base.folders.items() if v[0] not in named}))

    def vacuum(self, keep: int = 3) -> int:
        """Delete folders that none of the newest ``keep`` versions names; returns how many.

        Not to be run beside a writer of the same table: what that one has written has no version yet.
        """
        numbers = sorted(claimed(self.spark, f"{self.path}/{VERSIONS}"))[-keep:]
        used = {folder for number in numbers for folder in self.snapshot(number).folders.values()}
        gone = 0
        for _, folder in partition_folders(self.spark, self.path, self.parts):
            for status in self._fs.listStatus(folder):
                name = f"{self._relative(folder)}/{status.getPath().getName()}"
                if name not in used:
                    self._fs.delete(status.getPath(), True)
                    gone += 1
        self._fs.delete(hadoop_path(self.spark, f"{self.path}/{STAGING}"), True)
        return gone

    # --- folders -----------------------------------------------------------------------

    def _relative(self, folder) -> str:
        return "/".join(folder.toUri().getPath().split("/")[-len(self.parts) :])


def _is_day(value: str) -> bool:
    return value != NULL_PARTITION

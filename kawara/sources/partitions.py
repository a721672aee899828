"""A Parquet dataset whose partitions are replaced whole: what a change doesn't touch keeps its files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a file of a compacted batch has at most, about.
FILE = 128 << 20


@dataclass(frozen=True)
class Partitioned:
    """A dataset in ``path``, partitioned by ``by``, the first of which is batch (a number; -1 is what was there first).

    ``replace`` writes the new rows beside the dataset, and then a list of the batches that they stand for; only then
    dynamic partition overwrite puts them in place. A run that dies before the list is whole has changed nothing, one
    that dies after it is ended by ``finish``, which everything that changes the dataset begins with. One writer at a
    time; readers see all of a change once it has returned.
    """

    spark: SparkSession
    path: str
    schema: str
    by: tuple[str, ...] = ("batch",)

    def read(self) -> DataFrame:
        """All rows with their partition's columns."""
        return self.spark.read.option("basePath", self.path).schema(self._empty(self.by).schema).parquet(self.path)

    def fitted(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the dataset's columns, in its types and order."""
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in self._empty(self.by).schema.fields])

    def put(self, rows: DataFrame) -> None:
        """The partitions that ``rows`` (with partition columns) has, in place of what they held."""
        self.fitted(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.by).parquet(self.path)

    def put_batch(self, rows: DataFrame, batch: int, **rest: int) -> None:
        """One partition in place of what it held, even if there are no rows."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self._empty().schema.fields])
        rows.write.mode("overwrite").parquet("/".join([self.path, f"batch={batch}", *[f"{c}={v}" for c, v in rest.items()]]))

    def replace(self, rows: DataFrame, batches: list[int]) -> None:
        """``rows`` (with partition columns) in place of all that ``batches`` hold; emptied partitions go."""
        self.finish()
        self._delete(self._pending)
        self.fitted(rows).write.partitionBy(*self.by).parquet(f"{self._pending}/rows")
        self.spark.createDataFrame([(b,) for b in batches], "batch long").coalesce(1).write.parquet(f"{self._pending}/batches")
        self.finish()

    def finish(self) -> None:
        """End a change that was written whole but not put in place."""
        if not self._exists(f"{self._pending}/batches/_SUCCESS"):
            return
        batches = {r.batch for r in self.spark.read.schema("batch long").parquet(f"{self._pending}/batches").collect()}  # a row a batch
        staged = set(self._leaves(f"{self._pending}/rows"))
        if staged:
            self.put(Partitioned(self.spark, f"{self._pending}/rows", self.schema, self.by).read())
        for leaf in set(self._leaves(self.path)) - staged:
            part = {c: int(v) for c, v in (x.split("=") for x in leaf.split("/"))}
            if part["batch"] == -1 and -1 in batches:  # stays, so that there is always something to read
                self.put_batch(self._empty(), **part)
            elif part["batch"] in batches:
                self._delete(f"{self.path}/{leaf}")
        self._delete(self._pending)

    def sizes(self) -> dict[int, int]:
        """Bytes by batch."""
        out: dict[int, int] = {}
        for leaf, size in self._leaves(self.path).items():
            batch = int(leaf.split("/")[0].removeprefix("batch="))
            out[batch] = out.get(batch, 0) + size
        return out

    def _empty(self, more: tuple[str, ...] = ()) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join([self.schema, *[f"{c} long" for c in more]]))

    @property
    def _pending(self) -> str:
        folder, _, name = self.path.rpartition("/")
        return f"{folder}/_pending/{name}"

    def _leaves(self, path: str) -> dict[str, int]:
        """Partitions (as paths below ``path``) with their bytes."""
        fs, at = self._at("/".join([path, *[f"{c}=*" for c in self.by]]))
        found = {s.getPath().toString(): fs.getContentSummary(s.getPath()).getLength() for s in (fs.globStatus(at) or [])}
        return {"/".join(p.rsplit("/", len(self.by))[1:]): n for p, n in found.items()}

    def _at(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def _delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)


def bins(sizes: dict[int, int], target: int, least: int) -> list[list[int]]:
    """Neighbouring small batches (under half of ``target``) to be made one, each bin of at most ``target`` bytes.

    Nothing while fewer than ``least`` are small, so a batch is written again once for about ``least`` that come.
    """
    small = sorted(b for b, n in sizes.items() if n < target // 2)
    if len(small) < least:
        return []
    out, held = [[]], 0
    for b in small:
        if held + sizes[b] > target:
            out.append([])
            held = 0
        out[-1].append(b)
        held += sizes[b]
    return [x for x in out if len(x) > 1]


def tier(sizes: dict[int, int], least: int) -> list[list[int]]:
    """The batches to be made one, if there are ``least``: all but those larger than all that are smaller together.

    A batch that is written again is then part of one at least twice as large, so rows are written again as often as
    the table has doubled, and the batches left out double in size from one to the next, so they are few.
    """
    by_size = sorted(sizes, key=lambda b: (sizes[b], b))
    while len(by_size) > 1 and sizes[by_size[-1]] > sum(sizes[b] for b in by_size[:-1]):
        by_size.pop()
    return [sorted(by_size)] if len(by_size) >= max(2, least) else []

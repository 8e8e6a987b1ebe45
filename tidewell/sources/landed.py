"""A Python data source over the landing folder: a batch or a stream of datagrams with offsets, in place of listing files.

The landing daemon names each file by its first arrival, and arrivals only rise, so an offset is an arrival: all
datagrams below it were read. A micro-batch is the arrivals from one offset to the next, bounded by a number of files; each
file is a partition, read on an executor as Arrow batches. A restarted stream goes on from its checkpoint's offset, whatever files have been deleted behind it.

    spark.dataSource.register(LandedSource)
    spark.readStream.format("landed").option("path", folder).load()

The folder is on a file system that the driver and the executors mount, as the daemon writes there.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "exporter binary, received_at timestamp, arrival bigint, payload binary"
#: Digits of an arrival in a file's name.
DIGITS = 20
MOST_FILES = 100


def files_of(folder: str) -> list[tuple[int, str]]:
    """First arrival and path of each whole file, in order; a file being written begins with _."""
    names = sorted(n for n in os.listdir(folder) if n.endswith(".parquet") and n[:DIGITS].isdigit()) if os.path.isdir(folder) else []
    return [(int(n[:DIGITS]), os.path.join(folder, n)) for n in names]


class Landed(InputPartition):
    """A file's datagrams with arrivals from first on."""

    def __init__(self, path: str, first: int):
        super().__init__(path)
        self.path, self.first = path, first


def read_file(part: Landed) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    wanted = pa.schema([("exporter", pa.binary()), ("received_at", pa.timestamp("us", tz="UTC")), ("arrival", pa.int64()), ("payload", pa.binary())])
    for batch in pq.ParquetFile(part.path).iter_batches():
        kept = batch.filter(pc.greater_equal(batch["arrival"], part.first))
        if kept.num_rows:
            yield pa.RecordBatch.from_arrays([kept[f.name].cast(f.type) for f in wanted], schema=wanted)


class LandedReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Landed]:
        return [Landed(path, 0) for _, path in files_of(self.folder)]

    def read(self, partition: Landed) -> Iterator:
        # without files Spark asks for one empty partition
        return read_file(partition) if isinstance(partition, Landed) else iter(())


class LandedStream(DataSourceStreamReader):
    """Offsets are {"arrival": the first one that isn't read}."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.told = folder, most, None

    def initialOffset(self) -> dict:
        return {"arrival": 0}

    def latestOffset(self) -> dict:
        """The end of the next `most` files behind what was told last."""
        files = [f for f in files_of(self.folder) if self.told is None or f[0] >= self.told][: self.most]
        if files:
            import pyarrow.compute as pc
            import pyarrow.parquet as pq

            self.told = max(self.told or 0, pc.max(pq.read_table(files[-1][1], columns=["arrival"])["arrival"]).as_py() + 1)
        return {"arrival": self.told or 0}

    def partitions(self, start: dict, end: dict) -> list[Landed]:
        self.told = max(self.told or 0, end["arrival"])
        return [Landed(path, start["arrival"]) for first, path in files_of(self.folder) if start["arrival"] <= first < end["arrival"]]

    def read(self, partition: Landed) -> Iterator:
        return read_file(partition)

    def commit(self, end: dict) -> None:
        """Files stay: the landing folder's own retention deletes them."""


class LandedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LandedReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LandedStream(self.options["path"], int(self.options.get("mostFiles", MOST_FILES)))

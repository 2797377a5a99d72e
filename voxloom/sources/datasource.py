"""``spark.read.format("camera_sequence")``: frames of recorded sequence folders.

A folder holds rgb.txt, depth.txt and the images they name.  Reading gives the
index entries, a partition for each sequence; ``option("kind", "depth")`` picks
the depth index.  Paths are local or mounted; inputs in other stores go through
``sources.sequence``, which uses Spark's own readers.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxloom.schemas import INDEX_ENTRY


class SequenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "camera_sequence"

    def schema(self) -> str:
        return INDEX_ENTRY

    def reader(self, schema) -> DataSourceReader:
        return SequenceReader(self.options)


class SequenceReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path")
        self.kind = options.get("kind", "rgb")
        if not self.root or self.kind not in ("rgb", "depth"):
            raise ValueError("give a path, and rgb or depth as the kind")

    def partitions(self) -> list[InputPartition]:
        index = f"{self.kind}.txt"
        if os.path.exists(os.path.join(self.root, index)):
            return [InputPartition(self.root)]
        found = sorted(e.path for e in os.scandir(self.root) if e.is_dir() and os.path.exists(os.path.join(e.path, index)))
        if not found:
            raise FileNotFoundError(f"no {index} below {self.root}")
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder = partition.value
        seq, place = os.path.basename(os.path.normpath(folder)), 0
        with open(os.path.join(folder, f"{self.kind}.txt"), encoding="utf-8") as lines:
            for line in map(str.strip, lines):
                if line and not line.startswith("#"):
                    t, path = line.split(" ")[:2]
                    yield seq, place, float(t), path
                    place += 1


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SequenceSource)

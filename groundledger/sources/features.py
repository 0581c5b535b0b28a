"""A Spark data source of map features: folders of GeoJSON lines, one folder a village.

`spark.read.format("ledger_features").load(folder)` reads what write_features() wrote:
folders village_id=..., whose files hold a feature a line. Equalities and lists on
village_id are pushed into the listing, so other villages' folders are not opened;
those on id leave lines out before they become rows. All filters come back to Spark
as well, which checks every row again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FORMAT = "ledger_features"
SCHEMA = "village_id string, id string, geometry string, properties string"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Features of one batch.
LINES = 4096
_NONE = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class _Part(InputPartition):
    path: str
    village: str | None


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder
        #: Values that may occur, by column; a column without an entry is free.
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("village_id",), ("id",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.only[name] = self.only.get(name, values) & values
            yield f

    def _files(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder)
        return system, path, fs

    def partitions(self) -> list[InputPartition]:
        system, path, fs = self._files()
        parts: list[InputPartition] = []
        for folder in system.get_file_info(fs.FileSelector(path)):
            name, _, value = folder.base_name.partition("=")
            if folder.type != fs.FileType.Directory or name != "village_id":
                continue
            village = None if value == _NONE else unquote(value)
            if "village_id" in self.only and village not in self.only["village_id"]:
                continue
            files = system.get_file_info(fs.FileSelector(folder.path, recursive=True))
            parts += [_Part(f.path, village) for f in files if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._"]
        return parts or [_Part("", None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _, _ = self._files()
        wanted, rows = self.only.get("id"), []
        with system.open_input_stream(partition.path) as file:
            for line in _lines(file):
                feature = json.loads(line)
                key = None if feature.get("id") is None else str(feature["id"])
                if wanted is not None and key not in wanted:
                    continue
                told = [None if (x := feature.get(k)) is None else json.dumps(x, ensure_ascii=False) for k in ("geometry", "properties")]
                rows.append((partition.village, key, *told))
                if len(rows) == LINES:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _lines(file) -> Iterator[bytes]:
    """Lines of a stream, of which one and a piece are held."""
    rest = b""
    while piece := file.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["village_id", "id", "geometry", "properties"])


class FeatureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register_features(spark: SparkSession) -> None:
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(FeatureSource)


def features(spark: SparkSession, folder: str, villages: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """The features of the folder, of the villages and ids asked for."""
    register_features(spark)
    rows = spark.read.format(FORMAT).load(folder)
    for name, values in (("village_id", villages), ("id", ids)):
        rows = rows if values is None else rows.where(F.col(name).isin(*values))
    return rows


def write_features(rows: DataFrame, folder: str, village: Column, key: Column, geometry: Column, properties: Column) -> None:
    """Features a line in a folder for each village; geometry and properties are structs, or null."""
    feature = F.struct(F.lit("Feature").alias("type"), key.cast("string").alias("id"), geometry.alias("geometry"), properties.alias("properties"))
    lines = rows.select(village.cast("string").alias("village_id"), F.to_json(feature).alias("value"))
    # A village's rows meet in a few files, however many tasks they come from; a large one is split by size.
    lines.hint("rebalance", "village_id").write.mode("overwrite").partitionBy("village_id").text(folder)

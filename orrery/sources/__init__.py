"""Readers: folders, JSON indexes and mappings, stored arrays, meshes, images, frames; and the mapping sinks."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orrery.operators.pairing import last_wins
from orrery.sources import glb


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it; a plain path is a local one."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _folders(path: str) -> list[str]:
    fs, root = _at(path)
    found = fs.get_file_info(pafs.FileSelector(root))  # raises if the folder is missing
    return sorted(i.base_name for i in found if i.type == pafs.FileType.Directory)


class FolderSource(DataSource):
    """(parent, name, path) of the folders two levels below ``path``; a partition is one folder of the first level."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return "parent string, name string, path string"

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader(self.options["path"].rstrip("/"))


class _FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in _folders(self.root)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        parent = partition.value
        names = _folders(f"{self.root}/{parent}") if parent is not None else []
        columns = [pa.array([parent] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([f"{self.root}/{parent}/{n}" for n in names], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["parent", "name", "path"])


def scan_folders(spark: SparkSession, root: str) -> DataFrame:
    """(parent, name, path) of the folders two levels below ``root``, links followed; plain files are skipped, a missing root raises."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folders").load(root)


def scan_tasks(spark: SparkSession, root: str) -> DataFrame:
    """(i, folder, src_path) of an image tree."""
    return scan_folders(spark, root).select(F.col("parent").alias("i"), F.col("name").alias("folder"), F.col("path").alias("src_path"))


def scan_clouds(spark: SparkSession, root: str) -> DataFrame:
    """(parent, object_id, path) of a cloud tree."""
    return scan_folders(spark, root).withColumnRenamed("name", "object_id")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below ``folder`` of a name, contents unread; local paths come without their scheme."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), "length")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, glb_path) of a JSON object; of a repeated key the last value counts; malformed JSON raises."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    return last_wins(text.select(F.posexplode(parsed).alias("pos", "key", "glb_path")), "key", "glb_path", "pos").drop("n_dups")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, src, dst) of a JSON array; malformed JSON raises."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "array<struct<src:string,dst:string>>", {"mode": "FAILFAST"})
    return text.select(F.posexplode(parsed).alias("ordinal", "item")).select(F.col("ordinal").cast("long").alias("ordinal"), "item.src", "item.dst")


def write_mapping(mapping: DataFrame, path: str, order: str = "ordinal", indent: int = 2) -> int:
    """One JSON array of src and dst in ``order``, row by row through the driver; folders are made, a file is replaced. The number of rows."""
    fs, at = _at(path)
    fs.create_dir(at.rpartition("/")[0] or ".", recursive=True)
    n = 0
    with fs.open_output_stream(at) as out:
        out.write(b"[")
        for row in mapping.orderBy(order).select("src", "dst").toLocalIterator():
            item = json.dumps({"src": row.src, "dst": row.dst}, indent=indent).replace("\n", "\n" + " " * indent)
            out.write((("," if n else "") + "\n" + " " * indent + item).encode())
            n += 1
        out.write(b"\n]" if n else b"]")
    return n


def write_mapping_lines(mapping: DataFrame, path: str) -> None:
    """JSON lines in part files, written by all tasks; ``ordinal`` stays, since files have no common order."""
    mapping.write.mode("overwrite").json(path)


_CLOUD = "path string, rendering int, point_id long, x double, y double, z double, r double, g double, b double, label double, error string"


def read_clouds(spark: SparkSession, folder: str, rendering: int | None = 0) -> DataFrame:
    """Points of all .npy files below ``folder``: path, rendering, point_id, x, y, z, r, g, b, label, error; all renderings if None is asked for.

    Rank 3 arrays hold renderings in a last or first axis of length 5; four channels are coordinates and a label, six or
    more coordinates and colours. Other layouts and broken or pickled files give one row with an error, arrays without points none.
    """
    names = [c.split()[0] for c in _CLOUD.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, _CLOUD.split(", "))])

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=fields)

    def layers(a: np.ndarray) -> list[tuple[int, np.ndarray]]:
        if a.ndim == 3 and 5 in (a.shape[2], a.shape[0]):
            every = [(i, a[:, :, i] if a.shape[2] == 5 else a[i]) for i in range(5)]
            return every if rendering is None else [every[rendering]]
        if a.ndim != 2:
            raise ValueError(f"unsupported shape {a.shape}")
        return [(0, a)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    found = [(i, a.astype(float)) for i, a in layers(np.load(io.BytesIO(content.as_py()), allow_pickle=False))]
                    channels = found[0][1].shape[1]
                    if channels != 4 and channels < 6:
                        raise ValueError(f"unsupported channels {channels}")
                except (ValueError, TypeError, EOFError, OSError) as broken:
                    yield rows(1, path=[path], error=[str(broken) or type(broken).__name__])
                    continue
                at = {"x": 0, "y": 1, "z": 2} | ({"label": 3} if channels == 4 else {"r": 3, "g": 4, "b": 5})
                for i, a in found:
                    n = len(a)
                    yield rows(n, path=[path] * n, rendering=[i] * n, point_id=np.arange(n), **{k: np.ascontiguousarray(a[:, c]) for k, c in at.items()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInArrow(decode, _CLOUD)


def read_meshes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, triangles, errors) of all .glb files below ``folder``: (mesh_id, vid, x, y, z), (mesh_id, tid, a, b, c), (mesh_id, error).

    ``mesh_id`` is the path; the parts of a file's scene form one mesh.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.glb").option("recursiveFileLookup", True).load(folder).select("path", "content")

    def decoder(what: str):
        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for path, content in zip(batch["path"], batch["content"]):
                    try:
                        points, corners = glb.parse(content)
                    except (ValueError, KeyError, IndexError, TypeError) as broken:
                        if what == "error":
                            yield pd.DataFrame({"mesh_id": [path], "error": [f"{type(broken).__name__}: {broken}"]})
                        continue
                    if what != "error":
                        values, names, nth = (points, "xyz", "vid") if what == "points" else (corners, "abc", "tid")
                        yield pd.DataFrame({"mesh_id": path, nth: np.arange(len(values))} | {n: values[:, i] for i, n in enumerate(names)})

        return decode

    return (
        files.mapInPandas(decoder("points"), "mesh_id string, vid long, x double, y double, z double"),
        files.mapInPandas(decoder("corners"), "mesh_id string, tid long, a long, b long, c long"),
        files.mapInPandas(decoder("error"), "mesh_id string, error string"),
    )


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(origin, height, width, rgb) of the images below ``folder``; files that can't be decoded are left out."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    return images.select("image.origin", "image.height", "image.width", to_rgb(F.col("image.nChannels"), F.col("image.data")).alias("rgb"))


def to_rgb(channels: Column, data: Column) -> Column:
    """Bytes in the order red, green, blue of pixels that are grey, blue-green-red, or those with an alpha channel, which goes."""

    @F.pandas_udf("binary")
    def convert(n: pd.Series, pixels: pd.Series) -> pd.Series:
        def one(k: int, b: bytes) -> bytes | None:
            if b is None or k not in (1, 3, 4):
                return None
            a = np.frombuffer(b, np.uint8).reshape(-1, k)
            return (np.repeat(a, 3, axis=1) if k == 1 else a[:, 2::-1]).tobytes()

        return pd.Series([one(k, b) for k, b in zip(n, pixels)], dtype=object)

    return convert(channels, data)


def read_frames(spark: SparkSession, image_folder: str, mask_folder: str, list_file: str, pattern: str = "*") -> DataFrame:
    """(video, frame, image_path, mask_path) of the videos named, a line each, in ``list_file``; a frame without a mask has a null one."""

    def frames(folder: str, out: str) -> DataFrame:
        parts = F.split("path", "/")
        return list_files(spark, folder, pattern).select(
            F.element_at(parts, -2).alias("video"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*\z", "").alias("frame"), F.col("path").alias(out)
        )

    named = spark.read.text(list_file).select(F.trim("value").alias("video")).filter("video <> ''").distinct()
    return frames(image_folder, "image_path").join(named, "video", "left_semi").join(frames(mask_folder, "mask_path"), ["video", "frame"], "left")

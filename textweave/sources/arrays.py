"""Vectors as .npy files: a distributed reader in row ranges, a writer with a manifest, and a cache that checks shapes."""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "_manifest.json"
#: Bytes of vectors that one task reads, or that a written file holds.
RANGE_BYTES = 32 << 20


def npy_source() -> type[DataSource]:
    """The format "npy": (file, row, id, embedding) of two-dimensional arrays of numbers.

    A folder with a manifest is read by it alone, so files of failed attempts do not count; without one all .npy files of a
    folder, or a single file, are read, and `id` is null. The manifest holds rows and offsets, so that planning opens no file. Ranges of rows are read by a task each, by offset. Files of unlike
    width or element type, in column order or of another kind are an error. The path is one that all executors share.

    The class is made here so that it travels with its code, wherever a worker starts.
    """
    manifest, range_bytes = MANIFEST, RANGE_BYTES
    element = {"float32": "float", "float64": "double", "int32": "int", "int64": "long"}

    def opened(path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)

    def header(fs: pafs.FileSystem, name: str) -> tuple[tuple[int, ...], str, int]:
        """Shape, element type and the offset of the first value."""
        with fs.open_input_file(name) as f:
            start = io.BytesIO(f.read(1 << 16))
        version = np.lib.format.read_magic(start)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, dtype = read(start)
        if len(shape) != 2 or (by_column and min(shape) > 1) or dtype.byteorder == ">" or dtype.name not in element:
            raise ValueError(f"{name}: no row-wise table of numbers (shape {shape}, type {dtype})")
        return shape, dtype.name, start.tell()

    def parts(path: str) -> list[tuple[str, str | None, int, int, str, int, int]]:
        """(vectors, ids, rows, width, element type, offset, offset of ids) of each file."""
        fs, root = opened(path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            names = [root]
        elif fs.get_file_info(f"{root}/{manifest}").type == pafs.FileType.File:
            with fs.open_input_file(f"{root}/{manifest}") as f:
                m = json.loads(f.read())
            return [(f"{root}/{n}.npy", f"{root}/{n}.ids.npy", rows, m["width"], m["type"], at, ids_at) for n, rows, at, ids_at in m["parts"]]
        else:
            infos = fs.get_file_info(pafs.FileSelector(root))
            names = sorted(i.path for i in infos if i.path.endswith(".npy"))
        found = [(n, *header(fs, n)) for n in names]
        kinds = {(shape[1], kind) for _, shape, kind, _ in found}
        if len(kinds) > 1:
            raise ValueError(f"{path}: files of unlike width or element type: {sorted(kinds)}")
        return [(n, None, shape[0], shape[1], kind, at, 0) for n, shape, kind, at in found]

    class Range(InputPartition):
        def __init__(self, name: str, ids: str | None, begin: int, end: int, width: int, kind: str, offset: int, ids_at: int):
            self.name, self.ids, self.begin, self.end, self.width, self.kind, self.offset, self.ids_at = name, ids, begin, end, width, kind, offset, ids_at

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def partitions(self) -> list[InputPartition]:
            out = []
            for name, ids, rows, width, kind, at, ids_at in parts(self.path):
                step = max(1, range_bytes // max(1, width * np.dtype(kind).itemsize))
                out += [Range(name, ids, k, min(rows, k + step), width, kind, at, ids_at) for k in range(0, rows, step)]
            return out or [Range("", None, 0, 0, 0, "float32", 0, 0)]

        def read(self, p: Range):
            if p.begin == p.end:
                return
            fs, _ = opened(self.path)

            def values(name: str, kind: str, offset: int, width: int) -> np.ndarray:
                size = np.dtype(kind).itemsize * width
                with fs.open_input_file(name) as f:
                    f.seek(offset + p.begin * size)
                    raw = f.read((p.end - p.begin) * size)
                if len(raw) != (p.end - p.begin) * size:
                    raise ValueError(f"{name} ends early")
                return np.frombuffer(raw, kind)

            n = p.end - p.begin
            flat = pa.array(values(p.name, p.kind, p.offset, p.width))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.width), flat)
            ids = pa.nulls(n, pa.int64()) if p.ids is None else pa.array(values(p.ids, "int64", p.ids_at, 1))
            place = pa.array(np.arange(p.begin, p.end, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([p.name.rsplit("/", 1)[-1]] * n, pa.string()), place, ids, vectors], ["file", "row", "id", "embedding"])

    class Written(WriterCommitMessage):
        def __init__(self, saved: list[tuple[str, int, int, int]]):
            self.saved = saved

    class Writer(DataSourceArrowWriter):
        """Rows (id, embedding) as files of vectors and of ids; the manifest, written last, makes them count at once."""

        def __init__(self, path: str, width: int, kind: str):
            self.path, self.width, self.kind = path, width, kind

        def save(self, fs: pafs.FileSystem, root: str, ids: list[np.ndarray], vectors: list[np.ndarray]) -> tuple[str, int, int, int]:
            name, offsets = f"part-{uuid.uuid4().hex}", []
            for end, array in ((".npy", np.concatenate(vectors).reshape(-1, self.width)), (".ids.npy", np.concatenate(ids)[:, None])):
                out = io.BytesIO()
                np.save(out, array)
                offsets.append(out.tell() - array.nbytes)
                with fs.open_output_stream(f"{root}/{name}{end}") as f:
                    f.write(out.getbuffer())
            return name, len(array), *offsets

        def write(self, batches):
            fs, root = opened(self.path)
            fs.create_dir(root, recursive=True)
            saved, ids, vectors, held = [], [], [], 0
            for batch in batches:
                column = batch.column(1)
                if batch.column(0).null_count or column.null_count:
                    raise ValueError("an id or a vector is null")
                flat = column.flatten()
                if flat.null_count or len(flat) != len(column) * self.width or set(column.value_lengths().unique().to_pylist()) - {self.width}:
                    raise ValueError(f"a vector has not {self.width} values")
                ids.append(batch.column(0).to_numpy().astype("int64"))
                vectors.append(flat.to_numpy().astype(self.kind))
                held += vectors[-1].nbytes
                if held >= range_bytes:
                    saved.append(self.save(fs, root, ids, vectors))
                    ids, vectors, held = [], [], 0
            if ids:
                saved.append(self.save(fs, root, ids, vectors))
            return Written(saved)

        def commit(self, messages) -> None:
            fs, root = opened(self.path)
            fs.create_dir(root, recursive=True)
            done = {"parts": sorted(n for m in messages if m is not None for n in m.saved), "width": self.width, "type": self.kind}
            with fs.open_output_stream(f"{root}/{manifest}") as f:
                f.write(json.dumps(done).encode())

        def abort(self, messages) -> None:
            """Nothing to undo: without their names in a manifest the files do not count."""

    class Npy(DataSource):
        @classmethod
        def name(cls) -> str:
            return "npy"

        def schema(self) -> str:
            found = parts(self.options["path"])
            kind = element[found[0][4]] if found else "float"
            return f"file string, row long, id long, embedding array<{kind}>"

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(self.options["path"])

        def writer(self, schema: T.StructType, overwrite: bool):
            return Writer(self.options["path"], int(self.options["width"]), self.options.get("type", "float32"))

    return Npy


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, id, embedding) of .npy files, see npy_source()."""
    spark.dataSource.register(npy_source())
    return spark.read.format("npy").load(path)


def write_npy(rows: DataFrame, path: str, id_col: str, vector: str, width: int, kind: str = "float32") -> None:
    """Vectors of one width under whole-number ids. Only what the manifest names counts; a second write replaces it."""
    rows.sparkSession.dataSource.register(npy_source())
    rows.select(F.col(id_col).cast("long"), F.col(vector)).write.format("npy").mode("overwrite").option("width", width).option("type", kind).save(path)


def cached_vectors(inputs: DataFrame, id_col: str, compute, path: str, width: int, kind: str = "float32") -> tuple[DataFrame, bool]:
    """((id, embedding), whether they were kept): the cache at a path, or `compute(inputs)` (id_col, embedding) written there.

    The cache is kept only if its width and element type are those wanted and it holds exactly the ids of the inputs, each as
    often. A cache of other rows, width or type, none, or one that cannot be read is computed again.
    """
    spark = inputs.sparkSession
    ids = inputs.select(F.col(id_col).cast("long").alias("id"))

    def of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("id").cast("decimal(38,0)"))).first())

    try:
        old = read_npy(spark, path)
        field = old.schema["embedding"].dataType.elementType.typeName()
        fits = field == {"float32": "float", "float64": "double"}[kind] and old.where(F.size("embedding") != width).isEmpty()
        if fits and of(old) == of(ids):
            return old.select("id", "embedding"), True
    except Exception as error:  # none yet, files of unlike shape, or a torn one
        if not any(t in str(error) for t in ("FileNotFoundError", "ValueError", "PATH_NOT_FOUND", "EOFError")):
            raise
    write_npy(compute(inputs), path, id_col, "embedding", width, kind)
    return read_npy(spark, path).select("id", "embedding"), False

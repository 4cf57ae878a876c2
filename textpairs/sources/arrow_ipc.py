"""Arrow IPC / Feather files as a Spark data source (read and write).

Spark has no built-in Arrow file source. This Python data source plans one
input partition per file and yields Arrow record batches (no per-row Python).
Each file is opened as an IPC *file* (Feather v2) and, failing that, as an IPC
*stream*, so both kinds of ``*.arrow`` files read. Files are listed and opened
through ``pyarrow.fs``, so local, HDFS and object-store URIs work alike.

Options (read): ``path`` (file, directory or glob), ``columns`` (comma list to
keep; the source does not prune by itself), ``rowNo`` ("true" adds ``row_no``
= file position << 32 | row index: the stored order), ``errorColumn`` ("true":
an unreadable file yields one row with ``_error`` set instead of failing).
Writes: one IPC file per task, committed by the driver (a retried task's
file replaces the failed attempt's; an aborted job removes its files).
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader,
                                    InputPartition, WriterCommitMessage)
from pyspark.sql.types import StructType

_TYPE = {"string": "string", "large_string": "string", "int64": "bigint", "int32": "int",
         "int16": "smallint", "int8": "tinyint", "double": "double", "float": "float",
         "bool": "boolean", "date32[day]": "date", "binary": "binary"}


def _spark_type(t) -> str:
    import pyarrow as pa
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"array<{_spark_type(t.value_type)}>"
    if pa.types.is_timestamp(t):
        return "timestamp"
    return _TYPE.get(str(t), "string")


def _fs_and_path(path: str):
    from pyarrow import fs
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _list_files(path: str) -> list[str]:
    from pyarrow import fs
    filesystem, p = _fs_and_path(path)
    has_glob = any(ch in p for ch in "*?[")
    base = p.rsplit("/", 1)[0] if has_glob else p
    info = filesystem.get_file_info(base)
    if info.type == fs.FileType.File:
        files = [base]
    elif info.type == fs.FileType.Directory:
        sel = fs.FileSelector(base, recursive=False)
        files = [i.path for i in filesystem.get_file_info(sel) if i.type == fs.FileType.File
                 and not i.base_name.startswith(("_", "."))]
    else:
        files = []
    if has_glob:
        files = [f for f in files if fnmatch.fnmatch(f, p)]
    elif info.type == fs.FileType.Directory:
        files = [f for f in files if f.endswith((".arrow", ".feather", ".ipc"))]
    prefix = path.split("://", 1)[0] + "://" if "://" in path else ""
    return sorted(prefix + f if prefix and not f.startswith(prefix) else f for f in files)


def _open_table(path: str):
    import pyarrow.ipc as ipc
    filesystem, p = _fs_and_path(path)
    try:
        with filesystem.open_input_file(p) as f:
            return ipc.open_file(f).read_all()
    except Exception:  # noqa: BLE001 - not an IPC file: try the stream format
        with filesystem.open_input_stream(p) as f:
            return ipc.open_stream(f).read_all()


class _FilePartition(InputPartition):
    def __init__(self, path: str, index: int):
        self.path, self.index = path, index


class _Reader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self):
        return [_FilePartition(p, i) for i, p in enumerate(_list_files(self.options["path"]))]

    def read(self, partition: _FilePartition) -> Iterator:
        import pyarrow as pa
        names = [f.name for f in self.schema.fields]
        try:
            table = _open_table(partition.path)
            err = None
        except Exception as e:  # noqa: BLE001
            if self.options.get("errorColumn", "false") != "true":
                raise
            table, err = None, f"{partition.path}: {type(e).__name__}: {e}"
        if table is None:
            cols = {n: pa.nulls(1) for n in names}
            cols["_error"] = pa.array([err])
            yield pa.RecordBatch.from_pydict({n: cols[n] for n in names})
            return
        offset = 0
        for batch in table.to_batches(max_chunksize=4096):
            cols = {}
            for n in names:
                if n == "row_no":
                    cols[n] = pa.array([(partition.index << 32) + offset + i for i in range(batch.num_rows)],
                                       pa.int64())
                elif n == "_error":
                    cols[n] = pa.nulls(batch.num_rows, pa.string())
                else:
                    cols[n] = batch.column(n)
            offset += batch.num_rows
            yield pa.RecordBatch.from_pydict(cols)


class _Commit(WriterCommitMessage):
    def __init__(self, tmp: str, final: str):
        self.tmp, self.final = tmp, final


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex[:12]
        filesystem, p = _fs_and_path(self.path)
        filesystem.create_dir(p, recursive=True)
        if overwrite:
            for f in _list_files(self.path):
                fs2, fp = _fs_and_path(f)
                fs2.delete_file(fp)

    def write(self, iterator) -> _Commit:
        import pyarrow.ipc as ipc
        from pyspark import TaskContext
        ctx = TaskContext.get()
        pid, attempt = ctx.partitionId(), ctx.attemptNumber()
        tmp = f"{self.path}/_tmp-{self.job}/part-{pid:05d}-{attempt}.arrow"
        final = f"{self.path}/part-{pid:05d}-{self.job}.arrow"
        filesystem, p = _fs_and_path(tmp)
        filesystem.create_dir(p.rsplit("/", 1)[0], recursive=True)
        writer = None
        with filesystem.open_output_stream(p) as sink:
            for batch in iterator:
                if writer is None:
                    writer = ipc.new_file(sink, batch.schema)
                writer.write_batch(batch)
            if writer is not None:
                writer.close()
        return _Commit(tmp, final)

    def commit(self, messages) -> None:
        for m in messages:
            if m is None:
                continue
            filesystem, src = _fs_and_path(m.tmp)
            _fs, dst = _fs_and_path(m.final)
            if filesystem.get_file_info(src).size:
                filesystem.move(src, dst)
        filesystem, p = _fs_and_path(f"{self.path}/_tmp-{self.job}")
        filesystem.delete_dir(p)

    def abort(self, messages) -> None:
        filesystem, p = _fs_and_path(f"{self.path}/_tmp-{self.job}")
        try:
            filesystem.delete_dir(p)
        except Exception:  # noqa: BLE001
            pass


class ArrowIPCDataSource(DataSource):
    """``spark.read.format("arrow_ipc").load(path)`` / ``df.write.format("arrow_ipc")``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> str:
        files = _list_files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Arrow files at {self.options['path']}")
        fields = None
        for f in files:
            try:
                fields = _open_table(f).schema
                break
            except Exception:  # noqa: BLE001 - a broken file: try the next one
                continue
        if fields is None:
            raise ValueError(f"no readable Arrow file at {self.options['path']}")
        keep = self.options.get("columns")
        wanted = [c.strip() for c in keep.split(",")] if keep else [f.name for f in fields]
        cols = [f"`{f.name}` {_spark_type(f.type)}" for f in fields if f.name in wanted]
        if self.options.get("rowNo", "false") == "true":
            cols.append("row_no bigint")
        if self.options.get("errorColumn", "false") == "true":
            cols.append("_error string")
        return ", ".join(cols)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(ArrowIPCDataSource)

"""A Python data source that reads every file of a tree whose relative path matches a pattern, one row per file.

Spark's own file listing leaves out files whose names start with `_` or `.` and files without bytes; the contract sources
hold both. The tree is listed once when the scan is planned and cut into partitions of about PARTITION_BYTES; every
task opens its own files, through the file system that the path's scheme names (a path without one is local or on a mounted
share). A path whose scheme only Spark can open is read by Spark's listing instead, see `files.whole_files`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes and files of a partition, and bytes of texts in one Arrow batch.
PARTITION_BYTES, PARTITION_FILES, BATCH_BYTES = 64 << 20, 10_000, 8 << 20

SCHEMA = "path string, text string"
_ARROW = pa.schema([("path", pa.string()), ("text", pa.string())])


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path on it, and what to put before a path for the full name. ValueError for an unknown scheme."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path, ""
    path = re.sub(r"^file:/(?!//)", "file:///", path)
    try:
        fs, base = pafs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise ValueError(f"no file system for {path}") from e
    return fs, base, path[:len(path) - len(base)] if path.endswith(base) else ""


def exists(path: str) -> bool:
    fs, base, _ = opened(path)
    return fs.get_file_info(base.rstrip("/")).type != pafs.FileType.NotFound


def matcher(pattern: str) -> re.Pattern:
    """`*` is any run inside a name, hidden names included; `**/` any folders, also none."""
    parts = re.split(r"(\*\*/|\*)", pattern)
    return re.compile("".join({"**/": "(?:[^/]+/)*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts) + r"\Z")


@dataclass
class Files(InputPartition):
    paths: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"].rstrip("/"), options.get("pattern", "**/*")

    def partitions(self) -> list[InputPartition]:
        fs, base, before = opened(self.root)
        if fs.get_file_info(base).type != pafs.FileType.Directory:
            return []
        wanted, out, size = matcher(self.pattern), [[]], 0
        deep = "**" in self.pattern or "/" in self.pattern
        found = fs.get_file_info(pafs.FileSelector(base, recursive=deep))
        for info in sorted(found, key=lambda i: i.path):
            if info.type == pafs.FileType.File and wanted.match(info.path[len(base):].lstrip("/")):
                if out[-1] and (size + info.size > PARTITION_BYTES or len(out[-1]) >= PARTITION_FILES):
                    out.append([])
                    size = 0
                out[-1].append(before + info.path)
                size += info.size
        return [Files(paths) for paths in out if paths]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        paths, texts, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], schema=_ARROW)

        for path in partition.paths if partition else []:  # Spark reads one empty partition where there are none
            fs, base, _ = opened(path)
            with fs.open_input_stream(base, compression=None) as f:
                text = f.read().decode("utf-8", "replace")
            paths.append(path)
            texts.append(text.replace("\r\n", "\n").replace("\r", "\n"))
            size += len(text)
            if size >= BATCH_BYTES:
                yield batch()
                paths, texts, size = [], [], 0
        if paths:
            yield batch()


class TreeSource(DataSource):
    """Options: `path`, the folder; `pattern`, of the paths below it. A folder that is not there gives no rows."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

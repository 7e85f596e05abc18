"""``spark.read.format("textgrid")`` and ``format("wts")``, in batches and in streams: aligner files read lazily, a block a task.

``register(spark)`` makes both known. Options: the path of a file or folder (of any file system that Arrow knows), ``block_bytes`` for
word lists, which are cut into blocks at line borders, and ``files_per_task`` for TextGrids, whose tiers need their file from the
start. Both give what is passed over with its reason, as the scans of ``sources.textgrid`` do, and read line by line.
A stream takes the files that are new since its last offset, a time of change and a path.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_ROWS = 4096
_SCHEMA = "path string, at long, text string, start_s double, end_s double, problem string"
_ARROW = pa.schema([("path", pa.string()), ("at", pa.int64()), ("text", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("problem", pa.string())])
_WTS = re.compile(r"\[(\d+)\]\s*-->\s*\[(\d+)\]\s+(.+)")


@dataclass
class _Block(InputPartition):
    files: tuple[tuple[str, int, int], ...]  # path, first byte, byte behind the last


def _listed(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    files, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = files.get_file_info(at)
    found = [info] if info.is_file else files.get_file_info(fs.FileSelector(at, recursive=True))
    return files, sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


def _lines(files: fs.FileSystem, path: str, first: int, last: int) -> Iterator[tuple[int, str]]:
    """Lines that begin in a range of bytes, with the byte they begin at."""
    with io.BufferedReader(files.open_input_file(path), 1 << 20) as f:
        at = first
        if first:  # the line that the byte before belongs to is the last block's
            f.seek(first - 1)
            at = first - 1 + len(f.readline())
        else:
            f.seek(0)
        while at < last:
            line = f.readline()
            if not line:
                return
            yield at, line.decode("utf-8", "replace").strip()
            at += len(line)


def _word_list(lines: Iterator[tuple[int, str]]) -> Iterator[tuple]:
    for at, line in lines:
        found = _WTS.match(line)
        if found:
            yield at, found[3].strip(), int(found[1]) / 1000.0, int(found[2]) / 1000.0, None
        else:
            yield at, None, None, None, "pattern" if line else "blank"


def _seconds(line: str) -> float | None:
    try:
        return float(line.split("=")[1])
    except ValueError:
        return None


def _intervals(lines: Iterator[tuple[int, str]]) -> Iterator[tuple]:
    inside = False
    for at, line in lines:
        if 'name = "words"' in line:
            inside = True
        elif inside and 'name = "phones"' in line:
            return
        elif inside and line.startswith("intervals ["):
            own = [x for _, x in zip(range(3), (x for _, x in lines))]
            if any('name = "phones"' in x for x in own) or len(own) < 3:
                yield at, None, None, None, "cut_off"
                if len(own) == 3:
                    return
                continue
            problem = next((name for name, x in zip(("xmin", "xmax", "text"), own) if "=" not in x), None)
            start, end = (None, None) if problem else (_seconds(own[0]), _seconds(own[1]))
            if problem or start is None or end is None:
                yield at, None, None, None, problem or "number"
            else:
                yield at, own[2].split("=", 1)[1].strip().strip('"'), start, end, None


class _Files:
    """What readers of both kinds share: the files, their blocks, and the rows of a block as Arrow batches."""

    def __init__(self, kind: str, options: dict[str, str]) -> None:
        self.kind, self.path = kind, options["path"]
        self.block, self.together = int(options.get("block_bytes", 64 << 20)), int(options.get("files_per_task", 16))

    def blocks(self, found: list[fs.FileInfo]) -> list[_Block]:
        if self.kind == "wts":
            return [_Block(((f.path, a, min(a + self.block, f.size)),)) for f in found for a in range(0, f.size, self.block)]
        return [_Block(tuple((f.path, 0, f.size) for f in found[a : a + self.together])) for a in range(0, len(found), self.together)]

    def rows(self, block: _Block) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), None)
        for path, first, last in block.files:
            lines, held = _lines(files, path, first, last), []
            for row in (_word_list if self.kind == "wts" else _intervals)(lines):
                held.append((path, *row))
                if len(held) == _ROWS:
                    yield self._batch(held)
                    held = []
            if held:
                yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, files: _Files) -> None:
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return self.files.blocks(_listed(self.files.path)[1]) or [_Block(())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.files.rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, files: _Files) -> None:
        self.files = files

    @staticmethod
    def _place(f: fs.FileInfo) -> list:
        return [f.mtime_ns, f.path]

    def initialOffset(self) -> dict:
        return {"last": json.dumps([0, ""])}

    def latestOffset(self) -> dict:
        return {"last": json.dumps(max(map(self._place, _listed(self.files.path)[1]), default=[0, ""]))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, to = json.loads(start["last"]), json.loads(end["last"])
        return self.files.blocks([f for f in _listed(self.files.path)[1] if after < self._place(f) <= to])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.files.rows(partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class TextGridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textgrid"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Files(self.name(), self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Files(self.name(), self.options))


class WordListSource(TextGridSource):
    @classmethod
    def name(cls) -> str:
        return "wts"


def register(spark: SparkSession) -> None:
    for source in (TextGridSource, WordListSource):
        spark.dataSource.register(source)

"""A streaming source of the lines that are appended to log files, across rotation and truncation.

``spark.readStream.format("log_tail").option("path", pattern).load()`` gives (file, line). Files are named by their inode, so a file
that is renamed goes on where it was, and a new one of the same name starts at its first byte; a file that has become shorter is
read again from the beginning. Only whole lines are taken. Logs lie on the machine, or in a folder that all machines share.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads, about.
CHUNK = 32 << 20


class Piece(InputPartition):
    def __init__(self, path: str, inode: int, start: int, end: int):
        self.path, self.inode, self.start, self.end = path, inode, start, end


def _files(pattern: str) -> dict[str, str]:
    """Path of each inode that the pattern finds."""
    return {str(os.stat(p).st_ino): p for p in sorted(glob.glob(pattern)) if os.path.isfile(p)}


def _last_line_end(path: str, start: int) -> int:
    """Where the last whole line behind ``start`` ends."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > start:
            lo = max(start, at - (1 << 16))
            f.seek(lo)
            found = f.read(at - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            at = lo
    return start


class LogTailReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern.removeprefix("file://")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_: object) -> dict:
        """Bytes of whole lines of each file, by inode: [size, times it was cut]."""
        held, now = getattr(self, "held", {}), {}
        for inode, path in _files(self.pattern).items():
            size, cut = held.get(inode, [0, 0])
            if os.path.getsize(path) < size:
                size, cut = 0, cut + 1
            now[inode] = [_last_line_end(path, size), cut]
        self.held = {**held, **now}
        return dict(self.held)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.held = {**end, **getattr(self, "held", {})}
        paths, out = _files(self.pattern), []
        for inode, (size, cut) in end.items():
            before, was_cut = start.get(inode, [0, 0])
            at = before if cut == was_cut else 0
            while at < size and inode in paths:
                out.append(Piece(paths[inode], int(inode), at, min(size, at + CHUNK)))
                at += CHUNK
        return out

    def read(self, piece: Piece) -> Iterator[tuple[str, str]]:
        """Lines that begin in the piece."""
        path = piece.path
        if os.stat(path).st_ino != piece.inode:  # renamed since
            path = _files(self.pattern)[str(piece.inode)]
        with open(path, "rb") as f:
            f.seek(max(0, piece.start - 1))
            if piece.start and f.read(1) != b"\n":
                f.readline()  # begins before the piece
            while f.tell() < piece.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    break
                yield os.path.basename(piece.path), line.rstrip(b"\r\n").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, line string"

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(self.options["path"])


def read_log_stream(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, line) of the lines appended to the files of ``pattern``, as a stream."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", pattern).load()

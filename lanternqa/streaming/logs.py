"""A streaming source over logs that are appended to: each closed block of each file once.

An offset holds, for each file, the byte up to which its blocks are closed. So a
file that has grown since the last batch gives just its new blocks, and a block
that is still being written waits until it is closed. Large ranges are read in
pieces by many tasks; a block belongs to the piece in which it begins.

Files are read by byte ranges through Arrow's file systems, which know local
paths and the common object stores by their URL. An offset has about a hundred
bytes a file, so logs should roll by size, not by the minute.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lanternqa.sources.files import store_of

PIECE_BYTES = 64 << 20
STEP_BYTES = 1 << 20


@dataclass
class Piece(InputPartition):
    """Blocks of `file` that begin in [start, stop); the range of this batch is [first, end)."""

    file: str
    first: int
    start: int
    stop: int
    end: int


def closed_until(stream: pa.NativeFile, mark: bytes, known: int, size: int) -> int:
    """The end of the last mark between `known` and `size`, searched from the end; `known` if there is none."""
    stop = size
    while stop > known:
        start = max(known, stop - STEP_BYTES)
        stream.seek(start)
        # A mark may lie across two steps.
        body = stream.read(min(size, stop + len(mark) - 1) - start)
        at = body.rfind(mark)
        if at >= 0:
            return start + at + len(mark)
        stop = start
    return known


def blocks(stream: pa.NativeFile, mark: bytes, piece: Piece, step: int = STEP_BYTES) -> Iterator[bytes]:
    """The blocks that begin in a piece, without their marks."""
    at = piece.start
    held = b""
    if at > piece.first:
        # Up to the first block that begins at or after the start; its mark may end just there.
        at = max(piece.first, at - len(mark))
        stream.seek(at)
        while True:
            body = stream.read(min(step, piece.end - at - len(held)))
            held += body
            found = held.find(mark)
            if found >= 0:
                at, held = at + found + len(mark), held[found + len(mark) :]
                break
            if not body:
                return
            done = max(0, len(held) - len(mark) + 1)
            at, held = at + done, held[done:]
    stream.seek(at + len(held))
    looked = 0
    while at < piece.stop:
        found = held.find(mark, looked)
        if found >= 0:
            yield held[:found]
            at, held, looked = at + found + len(mark), held[found + len(mark) :], 0
            continue
        body = stream.read(min(max(step, len(held)), piece.end - at - len(held)))
        if not body:
            return
        looked = max(0, len(held) - len(mark) + 1)
        held += body


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, path: str, mark: str, piece_bytes: int) -> None:
        self.path, self.mark, self.piece_bytes = path, mark.encode(), piece_bytes
        self.closed: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        store, root = store_of(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for file in found:
            name = file.base_name
            if file.type != fs.FileType.File or not file.size or name.startswith(("_", ".")):
                continue
            known = self.closed.get(file.path, 0)
            if file.size > known:
                with store.open_input_file(file.path) as stream:
                    self.closed[file.path] = closed_until(stream, self.mark, known, file.size)
        return {"files": {path: byte for path, byte in sorted(self.closed.items()) if byte}}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        pieces = []
        for file, stop in end["files"].items():
            first = start["files"].get(file, 0)
            if stop < first:
                raise ValueError(f"{file} has lost blocks that were read before: a log is only appended to")
            for at in range(first, stop, self.piece_bytes):
                pieces.append(Piece(file, first, at, min(at + self.piece_bytes, stop), stop))
        return pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        held, size = [], 0
        with store.open_input_file(piece.file) as stream:
            for block in blocks(stream, self.mark, piece):
                held.append(block.decode("utf-8", "replace"))
                size += len(block)
                if size > STEP_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])


class GrowingLog(DataSource):
    """Options: `path`, a file or a folder; `mark`, the text that closes a block; `pieceBytes`."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader(self.options["path"], self.options["mark"], int(self.options.get("pieceBytes", PIECE_BYTES)))

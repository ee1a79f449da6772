"""A data source of mail exports: folders of JSON lines, a mail a line, read in batch or as a stream.

``spark.dataSource.register(MailExport)``, then format ``mail_export`` with a
path.  Exports are read in the order of their names.  A file is parted into
ranges of bytes, and a range has the lines that begin in it.  The offset of a
stream is the name of the last export and how far it was read, up to the end of
a line, so lines that are appended later are read with the next batch, and a
half-written line waits.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from draftmill.sources.files import MAIL

SCHEMA = MAIL + ", file STRING, unreadable STRING"
#: Bytes of a partition, and of what is searched at once for the end of the last whole line.
RANGE, BACK = 64 << 20, 1 << 16


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def exports(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the exports of a folder by name."""
    files, root = _open(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def ranges(path: str, first: str, skip: int, last: str | None, end: int | None) -> list[Range]:
    """The parts of all exports after byte ``skip`` of the first up to byte ``end`` of the last."""
    out = []
    for name, size in exports(path):
        if name < first or (last is not None and name > last):
            continue
        begin, stop = skip if name == first else 0, end if name == last and end is not None else size
        out += [Range(f"{path.rstrip('/')}/{name}", k, min(k + RANGE, stop)) for k in range(begin, stop, RANGE)]
    return out


def whole(path: str, name: str, size: int) -> int:
    """Where the last whole line of an export ends."""
    files, at = _open(f"{path.rstrip('/')}/{name}")
    with files.open_input_file(at) as f:
        end = size
        while end > 0:
            start = max(0, end - BACK)
            if (k := f.read_at(end - start, start).rfind(b"\n")) >= 0:
                return start + k + 1
            end = start
    return 0


def mails(part: Range) -> Iterator[tuple]:
    """The mails of the lines that begin in a range; a line that is no mail is handed on as it is."""
    files, at = _open(part.file)
    with io.BufferedReader(files.open_input_file(at)) as f:
        f.seek(max(0, part.start - 1))
        if part.start:
            f.readline()  # belongs to the range before, or is the newline that ends it
        while f.tell() < part.end and (line := f.readline()):
            text = line.decode("utf-8", "replace").strip()
            if text:
                yield _row(text, part.file.rsplit("/", 1)[-1])


def _row(text: str, file: str) -> tuple:
    def string(x: object) -> str | None:
        return x if x is None or isinstance(x, str) else json.dumps(x)

    try:
        mail = json.loads(text)
        attached = [(string(a.get("filename")), string(a.get("content_type"))) for a in mail.get("attachments") or []]
        return (*(string(mail.get(k)) for k in ("uid", "sender", "subject", "received", "message_id")), attached, file, None)
    except (ValueError, AttributeError, TypeError):
        return None, None, None, None, None, None, file, text


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        return ranges(self.path, "", 0, None, None) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return mails(partition) if partition.file else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"export": "", "bytes": 0}

    def latestOffset(self) -> dict:
        found = exports(self.path)
        if not found:
            return self.initialOffset()
        name, size = found[-1]
        return {"export": name, "bytes": whole(self.path, name, size)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(self.path, start["export"], start["bytes"], end["export"], end["bytes"])

    def read(self, partition: Range) -> Iterator[tuple]:
        return mails(partition)


class MailExport(DataSource):
    """Mails with their attachments as listed, the export's name, and lines that are no mail; ``files.attachments`` makes a row a usable attachment."""

    @classmethod
    def name(cls) -> str:
        return "mail_export"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"])

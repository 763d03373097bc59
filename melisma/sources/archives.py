"""Packs: members in tar archives, read by their places and held against a manifest.

A pack is a folder. Every task of a write leaves one tar archive and beside it a list of its members with their places, sizes and fixities; the pack's index names the
archives of the tasks that ended well, one line each, and is written last. What failed tasks leave behind is in no index, and so in no pack. A read opens each archive
at several places at once, and checks every member's header, size and fixity before it gives it out.
"""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

INDEX, FORMAT = "index.json", 1
#: Bytes of members that a task of a read takes, about.
SPLIT = 32 << 20
SCHEMA = "name string, content binary"


class PackError(ValueError):
    """A pack that is not what its manifest says."""


def filesystem(path: str):
    """The file system that a path is on, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def safe(name: str) -> bool:
    """Whether a member stays within the folder it is unpacked to."""
    return bool(name) and not name.startswith("/") and "\\" not in name and "\0" not in name and all(p not in ("", ".", "..") for p in name.split("/"))


@dataclass
class Written(WriterCommitMessage):
    archive: str
    members: int
    size: int
    manifest: str


@dataclass
class Range(InputPartition):
    archive: str
    manifest: str
    first: int
    last: int


def header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.GNU_FORMAT, "utf-8", "surrogateescape")


class PackWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        archive, at, lines = f"{uuid.uuid4().hex}.tar", 0, []
        with fs.open_output_stream(f"{root}/{archive}") as out:
            for row in rows:
                name, content = row["name"], bytes(row["content"] or b"")
                if name is None or not safe(name):
                    raise PackError(f"a member can't be named {name!r}")
                head = header(name, len(content))
                out.write(head)
                out.write(content)
                out.write(bytes(-len(content) % tarfile.BLOCKSIZE))
                lines.append(json.dumps([name, at, len(head), len(content), hashlib.sha256(content).hexdigest()]))
                at += len(head) + len(content) + -len(content) % tarfile.BLOCKSIZE
            out.write(bytes(2 * tarfile.BLOCKSIZE))
        text = "\n".join(lines).encode()
        with fs.open_output_stream(f"{root}/{archive}.members") as out:
            out.write(text)
        return Written(archive, len(lines), at, hashlib.sha256(text).hexdigest())

    def commit(self, messages: list[Written]) -> None:
        fs, root = filesystem(self.path)
        old = [] if self.overwrite else read_index(self.path, missing=[])
        new = [{"archive": m.archive, "members": m.members, "size": m.size, "manifest": m.manifest} for m in messages if m is not None and m.members]
        with fs.open_output_stream(f"{root}/{INDEX}") as out:
            out.write(json.dumps({"format": FORMAT, "archives": old + new}).encode())

    def abort(self, messages: list[Written]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None:
                for name in (m.archive, f"{m.archive}.members"):
                    fs.delete_file(f"{root}/{name}")


def read_index(path: str, missing: list | None = None) -> list[dict]:
    """One entry an archive."""
    fs, root = filesystem(path)
    try:
        with fs.open_input_stream(f"{root}/{INDEX}") as f:
            got = json.loads(f.read())
    except FileNotFoundError:
        if missing is not None:
            return missing
        raise PackError(f"{path} is no pack: it has no {INDEX}") from None
    if got.get("format") != FORMAT:
        raise PackError(f"a pack of format {got.get('format')} can't be read")
    return got["archives"]


class PackReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        out = []
        for a in read_index(self.path):
            parts = max(1, min(a["members"], -(-a["size"] // self.split)))
            ends = [a["members"] * k // parts for k in range(parts + 1)]
            out += [Range(a["archive"], a["manifest"], x, y) for x, y in zip(ends, ends[1:], strict=False)]
        return out or [Range("", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple[str, bytes]]:
        if not partition.archive:
            return
        fs, root = filesystem(self.path)
        with fs.open_input_stream(f"{root}/{partition.archive}.members") as f:
            text = f.read()
        if hashlib.sha256(text).hexdigest() != partition.manifest:
            raise PackError(f"the member list of {partition.archive} is not the one that was written")
        lines = text.split(b"\n")
        with fs.open_input_file(f"{root}/{partition.archive}") as f:
            for line in lines[partition.first : partition.last]:
                name, at, head, size, fixity = json.loads(line)
                f.seek(at)
                got = f.read(head + size)
                if len(got) < head + size:
                    raise PackError(f"{partition.archive} ends within {name!r}")
                try:
                    with tarfile.open(fileobj=io.BytesIO(got + bytes(2 * tarfile.BLOCKSIZE + -size % tarfile.BLOCKSIZE))) as t:
                        info = t.next()
                except tarfile.TarError as e:
                    raise PackError(f"{name!r} has no header at byte {at} of {partition.archive}") from e
                content = got[head:]
                if info is None or not info.isreg() or info.name != name or info.size != size or not safe(name):
                    raise PackError(f"the header at byte {at} of {partition.archive} is not that of {name!r}")
                if hashlib.sha256(content).hexdigest() != fixity:
                    raise PackError(f"{name!r} in {partition.archive} is damaged")
                yield name, content


class PackSource(DataSource):
    """spark.read.format("pack").load(folder) and df.write.format("pack").mode("overwrite" or "append").save(folder), of columns name and content. Option split: bytes of members a task."""

    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackReader:
        return PackReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> PackWriter:
        if schema.fieldNames() != ["name", "content"]:
            raise PackError("a pack has the columns name and content")
        return PackWriter(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(PackSource)
    return spark

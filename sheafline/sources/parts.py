"""A source and sink of bundle parts through Spark's Python data source API.

Each task writes its parts under names of its own into a staging folder; only when all tasks have ended does the driver
move them to their final names, and an aborted or failed write leaves nothing. Tasks that run twice, or are lost, leave
files that no message names, and these go with the staging folder. Paths may be of any file system that pyarrow opens;
driver and executors must see the same one.

    spark.dataSource.register(parts.BundleParts)
    table.select("bundle_id", "name", "content").write.format("bundle-parts").mode("append").save(folder)
    spark.read.format("bundle-parts").load(folder)

Written columns are bundle_id, name and content (strings). A part's content is one row and fits a task; nothing larger is
held. Names that could leave the folder, two parts of one name, and parts that are there already fail the write.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "bundle_id string, name string, content string, sha256 string"
STAGING = "_staging-"
#: Bytes of parts that one task reads.
READ_BYTES = 64 << 20


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _checked(*names: str) -> None:
    for name in names:
        if not name or name in (".", "..") or name.startswith("_") or "/" in name or "\\" in name or "\0" in name:
            raise ValueError(f"no name of a part or bundle: {name!r}")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, str]]  # bundle, name, staged path


@dataclass
class Group(InputPartition):
    files: list[tuple[str, str, str]]  # bundle, name, path


class PartsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f"{STAGING}{uuid.uuid4().hex}"
        fs, root = _opened(path)
        fs.create_dir(f"{root}/{self.staging}")

    def write(self, iterator) -> Written:
        fs, root = _opened(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        done = []
        for at, row in enumerate(iterator):
            _checked(row.bundle_id, row.name)
            if not at:  # fails where the write was aborted meanwhile, so that a late task leaves nothing
                fs.create_dir(folder, recursive=False)
            with fs.open_output_stream(f"{folder}/{at}") as out:
                out.write(row.content.encode())
            done.append((row.bundle_id, row.name, f"{folder}/{at}"))
        return Written(done)

    def commit(self, messages) -> None:
        from pyarrow.fs import FileType

        fs, root = _opened(self.path)
        staged = [f for m in messages if m is not None for f in m.files]
        targets = [f"{root}/{b}/{n}" for b, n, _ in staged]
        if len(set(targets)) < len(targets):
            raise ValueError("two parts have one name")
        if self.overwrite:
            for info in fs.get_file_info(_listing(root)):
                if not info.base_name.startswith(STAGING):
                    fs.delete_dir(info.path) if info.type == FileType.Directory else fs.delete_file(info.path)
        elif held := [i.path for i in fs.get_file_info(targets) if i.type != FileType.NotFound]:
            raise ValueError(f"the part is there already: {held[0]}")
        for folder in {t.rsplit("/", 1)[0] for t in targets}:
            fs.create_dir(folder)
        for (_, _, path), target in zip(staged, targets, strict=True):
            fs.move(path, target)
        self._clear(fs, root)

    def abort(self, messages) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/{self.staging}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class PartsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Group]:
        from pyarrow.fs import FileType

        fs, root = _opened(self.path)
        groups, size = [[]], 0
        for info in sorted(fs.get_file_info(_listing(root, recursive=True)), key=lambda i: i.path):
            inside = info.path[len(root.rstrip("/")) + 1 :].split("/")
            if info.type != FileType.File or len(inside) != 2 or inside[0].startswith("_"):
                continue
            if size + info.size > READ_BYTES and groups[-1]:
                groups.append([])
                size = 0
            groups[-1].append((*inside, info.path))
            size += info.size
        return [Group(g) for g in groups]

    def read(self, partition: Group):
        fs, _ = _opened(self.path)
        for bundle, name, path in partition.files:
            with fs.open_input_stream(path) as f:
                data = f.read()
            yield bundle, name, data.decode(), hashlib.sha256(data).hexdigest()


def _listing(root: str, recursive: bool = False):
    from pyarrow.fs import FileSelector

    return FileSelector(root, recursive=recursive, allow_not_found=True)


class BundleParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle-parts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PartsReader:
        return PartsReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        if missing := {"bundle_id", "name", "content"} - set(schema.names):
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return PartsWriter(self.options["path"], overwrite)

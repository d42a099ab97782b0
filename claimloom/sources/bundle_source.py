"""Bundle files as a data source ``claim_bundles``: read in partitions of even size, written in tasks, published by a commit.

Files are reached through Arrow file systems, so a path may be local, on HDFS or
in an object store; it must be the same for all executors.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import bundle

MEMBERS = "path string, bundle_cid string, member_cid string, body string, error string"
DIGEST = re.compile("[0-9a-f]{128}")
STAGING = "_staging-"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


class BundleReader(DataSourceReader):
    """Members of all files below a folder that end in ``suffix``; a file's name is its trust root.

    Files are taken in the order of their paths, as many as ``maxpartitionbytes`` allows a
    task, at least one. A folder that is not there has no rows. Folders of writes that were not committed are passed over.
    """

    def __init__(self, options: dict):
        self.root, self.suffix, self.most = options["path"], options.get("suffix", ".proof"), int(options.get("maxpartitionbytes", 64 << 20))

    def partitions(self) -> list[Files]:
        where, root = opened(self.root)
        found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        named = [f for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and f"/{STAGING}" not in f.path[len(root) :]]
        out, size = [], 0
        for f in sorted(named, key=lambda f: f.path):
            if not out or size + f.size > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out or [Files([])]

    def read(self, partition: Files):
        where, _ = opened(self.root)
        for path in partition.paths:
            stem = path.rpartition("/")[2][: -len(self.suffix)]
            if not DIGEST.fullmatch(stem):
                yield path, None, None, None, "file name is not a digest"
                continue
            with where.open_input_stream(path) as f:
                rows = bundle.explode_bundle(f.read(), f"blake3-512:{stem}")
            for r in rows:
                yield path, r["bundle_cid"], r["member_cid"], r["body"], r["error"]


@dataclass
class Staged(WriterCommitMessage):
    """Folder of the files that a task has written."""

    folder: str


class BundleWriter(DataSourceWriter):
    """Rows (bundle_cid, content) as files named by digest.

    A task writes to a folder of its own attempt. Only when all tasks are done are the
    files of their successful attempts moved to their places, each whole; a
    job that fails leaves none. Equal bundles have one name and are one file.
    """

    def __init__(self, options: dict):
        self.root, self.suffix, self.job = options["path"], options.get("suffix", ".proof"), uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{opened(self.root)[1].rstrip('/')}/{STAGING}{self.job}"

    def write(self, iterator) -> Staged:
        where, _ = opened(self.root)
        task = TaskContext.get()
        folder = f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}"
        where.create_dir(folder, recursive=True)
        for row in iterator:
            stem = (row["bundle_cid"] or "").rpartition(":")[2]
            if not DIGEST.fullmatch(stem) or row["content"] is None:
                raise ValueError(f"no bundle: {row['bundle_cid']!r}")
            with where.open_output_stream(f"{folder}/{stem}{self.suffix}") as out:
                out.write(bytes(row["content"]))
        return Staged(folder)

    def commit(self, messages: list) -> None:
        where, root = opened(self.root)
        move = lambda f: where.move(f.path, f"{root.rstrip('/')}/{f.base_name}")
        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m is not None:
                    list(pool.map(move, where.get_file_info(fs.FileSelector(m.folder))))
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        where, _ = opened(self.root)
        if where.get_file_info(self.staging).type == fs.FileType.Directory:
            where.delete_dir(self.staging)


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "claim_bundles"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> BundleReader:
        return BundleReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        if overwrite:
            raise ValueError("bundles are named by content; append them")
        if not {"bundle_cid", "content"} <= set(schema.fieldNames()):
            raise ValueError("rows need bundle_cid and content")
        return BundleWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BundleSource)

"""Files that several machines read: archives and shards under a shared folder."""

from __future__ import annotations

import json
import re
import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from cadence.runtime import qualified, staging_path


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, with the scheme of its file system."""
    return qualified(spark, staging_path(spark, label))


class Folder:
    """A folder by URI (``file:``, ``hdfs:``, ``s3:``, ``gs:``).

    A path without a scheme belongs to Spark's default file system, which only the driver knows;
    it qualifies such paths before tasks see them (``cadence.runtime.qualified``).  Here an
    absolute path without a scheme is a local one.

    A writing task puts its file under a name of its own, so attempts never meet; the driver
    lists the files that count in a manifest once all tasks ended.  Files of lost or repeated
    attempts are not listed, hence never read.
    """

    MANIFEST = "_manifest.json"

    def __init__(self, path: str):
        uri = re.sub(r"^file:/*", "/", path)
        if uri.startswith("/"):
            self.fs, self.path = pafs.LocalFileSystem(), uri
        else:
            self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.path = self.path.rstrip("/")

    def new_name(self, part: int, ending: str) -> str:
        return f"part-{part:06d}-{uuid.uuid4().hex}{ending}"

    def create(self, name: str):
        self.fs.create_dir(self.path, recursive=True)
        return self.fs.open_output_stream(f"{self.path}/{name}", compression=None)

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")

    def delete(self, names: list[str]) -> None:
        for name in names:
            if self.fs.get_file_info(f"{self.path}/{name}").type == pafs.FileType.File:
                self.fs.delete_file(f"{self.path}/{name}")

    def write_manifest(self, files: list[dict]) -> None:
        temporary = f"{self.MANIFEST}.{uuid.uuid4().hex}"
        with self.create(temporary) as out:
            out.write(json.dumps({"files": files}).encode())
        self.fs.move(f"{self.path}/{temporary}", f"{self.path}/{self.MANIFEST}")

    def manifest(self) -> list[dict]:
        with self.open(self.MANIFEST) as file:
            return json.loads(file.read())["files"]

    def has_manifest(self) -> bool:
        info = self.fs.get_file_info(f"{self.path}/{self.MANIFEST}")
        return info.type == pafs.FileType.File

    def listed(self, ending: tuple[str, ...]) -> list[tuple[str, int]]:
        """Names and sizes of files: those of the manifest, else all with such an ending."""
        if self.has_manifest():
            return [(f["name"], f["size"]) for f in self.manifest()]
        found = self.fs.get_file_info(pafs.FileSelector(self.path))
        files = [f for f in found if f.type == pafs.FileType.File]
        return sorted((f.base_name, f.size) for f in files if f.base_name.endswith(ending))

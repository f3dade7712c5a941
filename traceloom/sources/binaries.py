"""A sink for files: one binary file a row, all or none of a job's."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.texts import sanitize_filename, split_extension
from ..plans.dims import FORMATS

STAGED = "_staged"


def cleaned_name(name: Column, format_: Column) -> Column:
    """{base}-clean.{ext}: the name without what file systems refuse, and the extension of the real format (that of the name where it is unknown)."""
    safe = sanitize_filename(name)
    base, ext = split_extension(safe)
    real = F.element_at(F.create_map(*[F.lit(x) for f in FORMATS for x in (f[0], f[3])]), F.coalesce(format_, F.lit("")))
    ext = F.coalesce(real, F.nullif(ext, F.lit("")))
    return F.concat(base, F.lit("-clean"), F.coalesce(F.concat(F.lit("."), ext), F.lit("")))


def numbered_name(name: str, taken: dict[str, int]) -> str:
    """The last part of a name, or with -2, -3... before its extension where it is taken; names that differ in case alone clash."""
    name = re.split(r"[/\\]", name)[-1]
    name = "file" if name in ("", ".", "..") else name
    base, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
    n, candidate = taken.get(name.lower(), 1), name
    while candidate.lower() in taken:
        n += 1
        candidate = f"{base}-{n}{dot}{ext}"
    taken[name.lower()] = n
    taken.setdefault(candidate.lower(), 1)
    return candidate


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class FolderWriter(DataSourceArrowWriter):
    """Tasks write into folders of their own below _staged; a commit moves those of the tasks that count, a folder a task, an abort takes them away.

    The job's folder is made on the driver, and tasks don't make it again: those that are still at work when their job is aborted then fail.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        system, root = self._folder()
        system.create_dir(f"{root}/{STAGED}/{self.job}")

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Staged:
        system, root = self._folder()
        folder = f"{root}/{STAGED}/{self.job}/{uuid.uuid4().hex}"
        taken: dict[str, int] = {}
        for batch in iterator:
            for name, content in zip(batch.column(batch.schema.get_field_index("name")).to_pylist(), batch.column(batch.schema.get_field_index("content"))):
                if name is None or not content.is_valid:
                    continue
                if not taken:
                    system.create_dir(folder, recursive=False)
                with system.open_output_stream(f"{folder}/{numbered_name(name, taken)}") as out:
                    out.write(content.as_py())
        return Staged(folder, len(taken))

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = self._folder()
        if self.overwrite:
            from pyarrow import fs

            for old in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.base_name.startswith("part-"):
                    system.delete_dir(old.path)
        for k, message in enumerate(m for m in messages if m is not None and m.files):
            system.move(message.folder, f"{root}/part-{self.job[:8]}-{k:05d}")
        self._sweep(system, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._sweep(*self._folder())

    def _sweep(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{STAGED}/{self.job}").type == fs.FileType.Directory:
            # tasks may still add files, which a deletion can miss or fail at; none are added where no task looks
            system.move(f"{root}/{STAGED}/{self.job}", f"{root}/{STAGED}/{self.job}-ended")
            system.delete_dir(f"{root}/{STAGED}/{self.job}-ended")
        if not system.get_file_info(fs.FileSelector(f"{root}/{STAGED}", allow_not_found=True)) and system.get_file_info(f"{root}/{STAGED}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{STAGED}")


class FolderOfFiles(DataSource):
    """df.write.format("folder_of_files"): columns name and content (binary), further ones are not written."""

    @classmethod
    def name(cls) -> str:
        return "folder_of_files"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("name and content are needed")
        return FolderWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """Write name and content of each row as a file below a folder that the driver and all executors share.

    Rows with a null name or content are left out. Files of a task share a folder, in which names that clash, in case
    alone too, get -2, -3...; a failed job leaves nothing behind.
    """
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(FolderOfFiles)
    files.select("name", "content").write.format("folder_of_files").mode(mode).save(path)

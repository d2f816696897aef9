"""A sink for raw blocks: tasks write files, the driver only commits them.

Each row (block, content) becomes a file part-<block>.bin of a folder. A task writes it into a folder of its own attempt beside the others; on commit the driver
moves the files of the attempts that count to their names, and takes the attempts' folder away. A failed attempt removes what it wrote, and an aborted write all
of it, so readers see whole files or none. What a lost executor leaves is in the attempts' folder, which Spark's readers pass over and the next write removes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: The folder of attempts, within the target's.
ATTEMPTS = "_attempts"


def file_system(path: str):
    """(file system, path there) of a path or URI that tasks and driver share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def name_of(block: int) -> str:
    return f"part-{block:08d}.bin"


@dataclass
class Written(WriterCommitMessage):
    """What an attempt has written: its folder and the blocks in it."""

    attempt: str
    blocks: list[int]


class RawWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        system, root = file_system(self.path)
        attempt = f"{root}/{ATTEMPTS}/{uuid.uuid4().hex}"
        blocks: list[int] = []
        system.create_dir(attempt, recursive=True)
        try:
            for row in rows:
                with system.open_output_stream(f"{attempt}/{name_of(row['block'])}") as out:
                    out.write(bytes(row["content"]))
                blocks.append(row["block"])
        except BaseException:
            system.delete_dir(attempt)
            raise
        return Written(attempt, blocks)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        for m in messages:
            for block in m.blocks if m else []:
                system.move(f"{m.attempt}/{name_of(block)}", f"{root}/{name_of(block)}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    @staticmethod
    def _clear(system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{ATTEMPTS}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{ATTEMPTS}")


class RawBlocks(DataSource):
    """df (block bigint, content binary).write.format("raw_blocks").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "raw_blocks"

    def schema(self) -> str:
        return "block bigint, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RawWriter(self.options["path"])


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Rows (block, content) as the files of a folder, whose earlier content goes first."""
    from pyarrow import fs

    system, root = file_system(path)
    if system.get_file_info(root).type != fs.FileType.NotFound:
        system.delete_dir(root)
    system.create_dir(root, recursive=True)
    blocks.sparkSession.dataSource.register(RawBlocks)
    blocks.select("block", "content").write.format("raw_blocks").mode("append").option("path", path).save()

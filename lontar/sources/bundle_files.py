"""Translation files as data sources: bundles of JSON to read, and files of any format to write.

`lontar_bundles` reads a folder of <locale>.json or <project>/<locale>.json as one long table, a partition for some
BYTES of files. `lontar_files` writes rows (file, pos, text), sorted by file and pos: each task writes its pieces of files to
a pending folder of the job, and only the commit puts them in their places; a job that fails leaves no file there. (Tasks
that are killed after the job was given up may leave pieces in the pending folder, which no reader looks at.)
Folders are paths or addresses that pyarrow knows (file, s3, gs, hdfs), on storage that all machines share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..ship import ship
from .bundles import flatten

#: Files that a partition reads, by their bytes.
BYTES = 16 << 20


def _folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        system, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        return system, inner.rstrip("/")
    return pyarrow.fs.LocalFileSystem(), path.rstrip("/")


@dataclass
class Files(InputPartition):
    paths: list[str]


class BundleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.message_rule = options["path"], options.get("messagerule", "true").lower() == "true"

    def partitions(self) -> list[Files]:
        system, inner = _folder(self.path)
        out, size = [Files([])], 0
        for found in sorted(system.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True)), key=lambda f: f.path):
            name = found.path[len(inner) + 1 :]
            if found.type != pyarrow.fs.FileType.File or not name.endswith(".json") or any(part.startswith(("_", ".")) for part in name.split("/")):
                continue
            if size + found.size > BYTES and out[-1].paths:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(name)
            size += found.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, inner = _folder(self.path)
        for name in partition.paths:
            with system.open_input_stream(f"{inner}/{name}") as stream:
                body = stream.read()
            try:
                body = body.decode("utf-8")
                bundle = json.loads(body)
                if not isinstance(bundle, dict):
                    raise ValueError("it holds no object")
            except ValueError as error:
                raise ValueError(f"bundle {name} is not valid JSON: {error}") from None
            del body  # the file's text isn't held beside its keys
            project, _, locale = name.removesuffix(".json").rpartition("/")
            for row in flatten(bundle, self.message_rule):
                yield (project or None, locale, *row)


class Bundles(DataSource):
    """(project, locale, key, register, plural, value, ord, is_flat) of a folder of bundles; a malformed file fails with its name."""

    @classmethod
    def name(cls) -> str:
        return "lontar_bundles"

    def schema(self) -> str:
        return "project string, locale string, key string, register string, plural string, value string, ord int, is_flat boolean"

    def reader(self, schema) -> BundleReader:
        return BundleReader(dict(self.options))


@dataclass
class Pieces(WriterCommitMessage):
    task: int
    files: list[str]
    folder: str


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Pieces:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, inner = _folder(self.path)
        pending = f"{inner}/_pending-{self.job}/{task.partitionId():06d}-{task.taskAttemptId()}"
        files: list[str] = []
        stream = None
        try:
            for row in rows:
                if not files or files[-1] != row["file"]:
                    if stream is not None:
                        stream.close()
                    if row["file"] in files or any(part in ("", ".", "..") for part in row["file"].split("/")):
                        raise ValueError(f"rows of {row['file']!r} are not together, or it is no name of a file")
                    files.append(row["file"])
                    system.create_dir(f"{pending}/{row['file']}".rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(f"{pending}/{row['file']}")
                stream.write((row["text"] or "").encode("utf-8"))
        except BaseException:
            if system.get_file_info(pending).type == pyarrow.fs.FileType.Directory:
                system.delete_dir(pending)
            raise
        finally:
            if stream is not None:
                stream.close()
        return Pieces(task.partitionId(), files, pending)

    def commit(self, messages: list[Pieces | None]) -> None:
        """Pieces go where they belong; those of a file that several tasks wrote are put together in their order."""
        system, inner = _folder(self.path)
        pieces: dict[str, list[str]] = {}
        for message in sorted(filter(None, messages), key=lambda m: m.task):
            for name in message.files:
                pieces.setdefault(name, []).append(f"{message.folder}/{name}")
        if self.overwrite:
            for found in system.get_file_info(pyarrow.fs.FileSelector(inner, allow_not_found=True)):
                if not found.base_name.startswith("_pending-"):
                    (system.delete_dir if found.type == pyarrow.fs.FileType.Directory else system.delete_file)(found.path)
        for name, own in pieces.items():
            system.create_dir(f"{inner}/{name}".rpartition("/")[0], recursive=True)
            if len(own) > 1:
                whole = f"{own[0]}.whole"
                with system.open_output_stream(whole) as out:
                    for piece in own:
                        with system.open_input_stream(piece) as stream:
                            while block := stream.read(1 << 20):
                                out.write(block)
                own = [whole]
            system.move(own[0], f"{inner}/{name}")
        self._clear(system, inner)

    def abort(self, messages: list[Pieces | None]) -> None:
        self._clear(*_folder(self.path))

    def _clear(self, system: pyarrow.fs.FileSystem, inner: str) -> None:
        pending = f"{inner}/_pending-{self.job}"
        if system.get_file_info(pending).type == pyarrow.fs.FileType.Directory:
            system.delete_dir(pending)


class TextFiles(DataSource):
    """Rows (file, pos, text) written as files, each the texts of its rows in the order they come in."""

    @classmethod
    def name(cls) -> str:
        return "lontar_files"

    def schema(self) -> str:
        return "file string, pos string, text string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    ship(spark)
    spark.dataSource.register(Bundles)
    spark.dataSource.register(TextFiles)


def read_bundle_files(spark: SparkSession, folder: str, message_rule: bool = True):
    """The long table of a folder of bundles. A key stored flat wins over the same one stored in namespaces."""
    from pyspark.sql import functions as F

    register(spark)
    found = spark.read.format("lontar_bundles").option("messageRule", str(message_rule).lower()).load(folder)
    # Keys in namespaces hold a point, so only flat ones with a point are looked for among them.
    flat = found.where(F.col("is_flat") & F.contains("key", F.lit("."))).select(F.col("project").alias("p"), F.col("locale").alias("l"), F.col("key").alias("k")).distinct()
    same = ~F.col("is_flat") & F.col("project").eqNullSafe(F.col("p")) & (F.col("locale") == F.col("l")) & (F.col("key") == F.col("k"))
    return found.join(flat.hint("merge"), same, "left_anti").drop("is_flat")

"""A data source of text files: `spark.read.format("text_folder")` and `df.write.format("text_folder")`, after register().

Reading. Options: path, include and exclude (globs, comma-separated), mostBytes (of a file; a longer one is read up to a whole
character within the bound and marked as truncated), mostFiles (of the listing, in order of path; if there are more, one row
without a path is marked as truncated). The files are dealt to partitions of about partitionBytes; a partition opens its
files one by one and never holds more than a batch of them.

Writing. Rows of path, text, encoding (utf-8, utf-8-bom, ms949) and eol (lf, crlf) become files below an empty folder or one
that this source has written; null text is an empty file. A path must be relative and stay below the folder, and a text must
fit its encoding, else the job fails. Tasks write to a staging folder and report their files; the driver moves them to their
places when all tasks have succeeded, or deletes the staging folder if one has not, so no half result is ever seen. (A task
that is killed late may leave a staging folder; its name begins with a dot, so it is never listed.)

Files are reached through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quarrylens.session import ship_code
from quarrylens.sources.text_files import SKIPPED, decode, glob_pattern

SCHEMA = "path string, text string, encoding string, eol string, bytes long, truncated boolean"
#: The file that marks a folder as written by this source, and the staging folder's name; neither is ever listed.
MARK, STAGING = ".text-folder", ".staging-"
CODECS = {"utf-8": "utf-8", "utf-8-bom": "utf-8", "ms949": "cp949"}
BOM = b"\xef\xbb\xbf"


def store_of(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def encoded(text: str | None, encoding: str, eol: str) -> bytes:
    """The bytes of a text; an unknown encoding or line end, or a character that the encoding lacks, is an error."""
    if encoding not in CODECS or eol not in ("lf", "crlf"):
        raise ValueError(f"no such encoding or line end: {encoding}, {eol}")
    body = (text or "").replace("\r\n", "\n").replace("\n", "\r\n" if eol == "crlf" else "\n").encode(CODECS[encoding])
    return BOM + body if encoding == "utf-8-bom" else body


def safe_path(path: str | None) -> str:
    rel = (path or "").replace("\\", "/").strip()
    if not rel or rel.startswith("/") or re.match("[A-Za-z]:", rel) or {"..", "."} & set(rel.split("/")) or rel.split("/")[0].startswith(STAGING) or rel == MARK:
        raise ValueError(f"not a relative path: {path!r}")
    return rel


def cut(data: bytes, most: int) -> bytes:
    """At most so many bytes, ending with a whole character if they are UTF-8 or MS949."""
    data = data[:most]
    for end in range(len(data), max(len(data) - 4, 0), -1):
        try:
            data[:end].decode("utf-8")
            return data[:end]
        except UnicodeDecodeError as error:
            if error.start < end - 4:
                break
    try:
        data.decode("cp949")
    except UnicodeDecodeError as error:
        return data[: error.start] if error.start == len(data) - 1 else data
    return data


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)
    more: bool = False


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.root = self.options["path"].rstrip("/")
        self.most_bytes = int(self.options.get("mostbytes", 10 << 20))

    def _kept(self, rel: str) -> bool:
        globs = lambda key: [g.strip() for g in self.options.get(key, "").split(",") if g.strip()]
        hit = lambda g: re.search(glob_pattern(g), rel) or not g.startswith("**/") and "/" not in g and re.search(glob_pattern("**/" + g), rel)
        parts = rel.split("/")
        hidden = any(p.startswith(".") or p in SKIPPED for p in parts)
        return not hidden and (not globs("include") or any(map(hit, globs("include")))) and not any(map(hit, globs("exclude")))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = store_of(self.root)
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((f.path[len(base) :].lstrip("/"), f.size) for f in found if f.type == fs.FileType.File)
        files = [f for f in files if self._kept(f[0])]
        most, share = int(self.options.get("mostfiles", len(files))), int(self.options.get("partitionbytes", 32 << 20))
        out, held = [], 0
        for rel, size in files[:most]:
            if not out or held > share:
                out.append(Files())
                held = 0
            out[-1].paths.append(rel)
            held += min(size, self.most_bytes) + 4096
        if len(files) > most:
            out.append(Files(more=True))
        return out or [Files()]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, base = store_of(self.root)
        names, kinds = zip(*(c.split(" ") for c in SCHEMA.split(", ")))
        kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[k] for k in kinds]
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], list(names))
        for rel in partition.paths:
            with store.open_input_stream(f"{base}/{rel}") as f:
                data = f.read(self.most_bytes + 1)
            longer = len(data) > self.most_bytes
            text, encoding, eol = decode(cut(data, self.most_bytes) if longer else data)
            size = store.get_file_info(f"{base}/{rel}").size if longer else len(data)
            rows.append((rel, text, encoding, eol, size, longer))
            held += len(data)
            if held > 8 << 20:
                yield batch()
                rows, held = [], 0
        if partition.more:
            rows.append((None, None, None, None, None, True))
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    folder: str
    paths: list[str]


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.root = {k.lower(): v for k, v in options.items()}["path"].rstrip("/")
        self.staging = f"{STAGING}{uuid.uuid4().hex}"
        missing = {"path", "text", "encoding", "eol"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import fs

        store, base = store_of(self.root)
        self._check(store, base, fs)
        folder, paths = f"{self.staging}/{uuid.uuid4().hex}", []
        made = set()
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("path", "text", "encoding", "eol")]
            for path, text, encoding, eol in zip(*columns):
                rel = safe_path(path.as_py())
                target = f"{base}/{folder}/{rel}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(target) as out:
                    out.write(encoded(text.as_py(), encoding.as_py(), eol.as_py()))
                paths.append(rel)
        return Written(folder, paths)

    @staticmethod
    def _check(store, base: str, fs) -> None:
        """The folder must be empty, absent, or marked as this source's."""
        if store.get_file_info(f"{base}/{MARK}").type != fs.FileType.NotFound:
            return
        there = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        if any(not f.base_name.startswith(STAGING) for f in there):
            raise ValueError("the folder holds files that this source has not written")

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = store_of(self.root)
        self._check(store, base, fs)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{MARK}") as out:
            out.write(b"written by text_folder\n")
        seen, made = set(), set()
        for m in filter(None, messages):
            for rel in m.paths:
                if rel in seen:
                    raise ValueError(f"two rows have the path {rel}")
                seen.add(rel)
        for m in filter(None, messages):
            for rel in m.paths:
                parent = f"{base}/{rel}".rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                store.move(f"{base}/{m.folder}/{rel}", f"{base}/{rel}")
        self._unstage(store, base, fs)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        self._unstage(*store_of(self.root), fs)

    def _unstage(self, store, base: str, fs) -> None:
        if store.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.staging}")


class TextFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    ship_code(spark)
    spark.dataSource.register(TextFolder)

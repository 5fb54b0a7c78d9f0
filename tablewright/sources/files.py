"""Sink of many small files: a file for each guide, or zip archives, named only when whole.

A task writes its files below a part of its own name, which no other attempt shares; when
all tasks have ended the driver writes the manifest that names the finished parts. So a
task that failed, or ran twice, leaves no half or double file behind the manifest, and no
file passes the driver. Files of one name in a part are numbered.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "_parts.json"
SCHEMA = "folder string, file string, text string"


def _place(path: str):
    """(file system, path in it) of a path or uri, as driver and executors both see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    files: int


class Files(DataSource):
    """Data source "named_files": rows of SCHEMA to files below path; with form=zip to one archive a task."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite):
        return FilesWriter(self.options["path"], self.options.get("form", "files"))


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, form: str):
        self.path, self.form = path.rstrip("/"), form

    def write(self, rows) -> Part:
        place, root = _place(self.path)
        name = f"part-{uuid.uuid4().hex}"
        taken: dict[str, int] = {}

        def named(row) -> str:
            whole = f"{row.folder}/{row.file}"
            n = taken[whole] = taken.get(whole, 0) + 1
            stem, dot, end = whole.rpartition(".")
            return whole if n == 1 else f"{stem}-{n}{dot}{end}"

        if self.form == "zip":
            name += ".zip"
            place.create_dir(root, recursive=True)
            with place.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for row in rows:
                    archive.writestr(named(row), row.text)
        else:
            for row in rows:
                file = f"{root}/{name}/{named(row)}"
                place.create_dir(file.rpartition("/")[0], recursive=True)
                with place.open_output_stream(file) as out:
                    out.write(row.text.encode())
        return Part(name, sum(taken.values()))

    def commit(self, messages) -> None:
        place, root = _place(self.path)
        held = parts_of(self.path)
        held += [{"name": m.name, "files": m.files} for m in messages if m and m.files]
        place.create_dir(root, recursive=True)
        made = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with place.open_output_stream(made) as out:
            out.write(json.dumps(held, indent=1).encode())
        place.move(made, f"{root}/{MANIFEST}")
        for m in messages:
            if m and not m.files:
                _drop(place, f"{root}/{m.name}")

    def abort(self, messages) -> None:
        place, root = _place(self.path)
        for m in messages:
            if m:
                _drop(place, f"{root}/{m.name}")


def _drop(place, path: str) -> None:
    from pyarrow.fs import FileType

    kind = place.get_file_info(path).type
    if kind == FileType.Directory:
        place.delete_dir(path)
    elif kind == FileType.File:
        place.delete_file(path)


def parts_of(path: str) -> list[dict]:
    """The finished parts below path: name and number of files."""
    from pyarrow.fs import FileType

    place, root = _place(path.rstrip("/"))
    manifest = f"{root}/{MANIFEST}"
    if place.get_file_info(manifest).type != FileType.File:
        return []
    with place.open_input_stream(manifest) as f:
        return json.loads(f.read())


def write_files(files: DataFrame, path: str, form: str = "files") -> None:
    """Add rows of SCHEMA to the files below path, a folder that driver and executors share.

    form zip gives one archive for each partition of files; coalesce(1) makes it one.
    """
    files.sparkSession.dataSource.register(Files)
    files.select("folder", "file", "text").write.format("named_files").mode("append").options(path=path, form=form).save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of SCHEMA that the finished parts below path hold, archives included."""
    parts = [f"{path.rstrip('/')}/{p['name']}" for p in parts_of(path)]
    folders, archives = [p for p in parts if not p.endswith(".zip")], [p for p in parts if p.endswith(".zip")]
    out = spark.createDataFrame([], SCHEMA)
    if folders:
        place = F.split(F.col("_metadata.file_path"), "/")
        text = spark.read.text(folders, wholetext=True, recursiveFileLookup=True)
        out = out.unionByName(text.select(F.url_decode(F.element_at(place, -2)).alias("folder"), F.url_decode(F.element_at(place, -1)).alias("file"), F.col("value").alias("text")))
    if archives:

        def opened(batches):
            for batch in batches:
                for raw in batch["content"]:
                    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                        names = [n.rpartition("/") for n in archive.namelist()]
                        yield pd.DataFrame({"folder": [n[0] for n in names], "file": [n[2] for n in names], "text": [archive.read(n).decode() for n in archive.namelist()]})

        out = out.unionByName(spark.read.format("binaryFile").load(archives).select("content").mapInPandas(opened, SCHEMA))
    return out

"""Files as a sink with commit: rows of a name and bytes, whole or not at all.

    sinks.register(spark)
    rows.write.format("files").mode("append").save("/out")   # name string, data binary, note string

Tasks write below a staging folder of their own beside the target, one that a
repeated attempt does not share; the commit moves what the successful ones
have written to its name and notes (``NOTES``) what each file's row said of it,
and an abort removes the staging folder, after which no task can write. The driver sees names and notes, never
bytes. The target is a folder that the driver and all executors have mounted.
Names are relative; those of one job are different; a file that is there is
replaced.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "name string, data binary, note string"
NOTES = "_notes.json"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its folder, and (name, note) of each file."""

    folder: str
    files: list[tuple[str, str | None]]


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")
        self.staging = os.path.join(self.path, f"_staging-{uuid.uuid4().hex}")
        # Tasks don't make this folder: what still runs after an abort finds it gone and leaves nothing.
        os.makedirs(self.staging)

    def write(self, iterator: Iterator[Row]) -> Written:
        folder, files = os.path.join(self.staging, uuid.uuid4().hex), []
        os.mkdir(folder)
        for row in iterator:
            if os.path.isabs(row["name"]) or ".." in row["name"].split("/"):
                raise ValueError(f"{row['name']} is no name below the target")
            place = os.path.join(folder, row["name"])
            for at in (i for i, c in enumerate(place) if c == "/" and i > len(folder)):
                with contextlib.suppress(FileExistsError):
                    os.mkdir(place[:at])
            with open(place, "wb") as f:
                f.write(row["data"])
            files.append((row["name"], row["note"]))
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m]
        names = [name for m in done for name, _ in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one name")
        for m in done:
            for name, _ in m.files:
                place = os.path.join(self.path, name)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                os.replace(os.path.join(m.folder, name), place)
        notes = {name: note for m in done for name, note in m.files if note is not None}
        if notes:
            part = os.path.join(self.staging, NOTES)
            with open(part, "w", encoding="utf-8") as f:
                json.dump(notes, f)
            os.replace(part, os.path.join(self.path, NOTES))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        # Under another name nothing comes to it any more while it is removed.
        gone = f"{self.staging}-gone"
        with contextlib.suppress(FileNotFoundError):
            os.rename(self.staging, gone)
        shutil.rmtree(gone, ignore_errors=True)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)

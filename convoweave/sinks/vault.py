"""Writes notes and pages as files below a folder, each under another name first and moved when whole."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Files:
    """One file at a time, in a folder that all executors reach by a URI."""

    def __init__(self, target: str):
        from pyarrow import fs

        self.system, self.folder = fs.FileSystem.from_uri(target)
        self.path, self.out, self.partial = None, None, ""

    def begin(self, path: str) -> None:
        self.end()
        folder = f"{self.folder}/{path}".rpartition("/")[0]
        self.system.create_dir(folder, recursive=True)
        self.path, self.partial = path, f"{folder}/.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.partial)

    def end(self) -> None:
        if self.out is not None:
            self.out.close()
            self.system.move(self.partial, f"{self.folder}/{self.path}")
            self.out = None


def write_notes(notes: DataFrame, target: str) -> int:
    """Writes (path, content, pos); of equal paths the row of the greatest ``pos``. Returns the number of files."""
    last = notes.groupBy("path").agg(F.max_by("content", "pos").alias("content"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = Files(target)
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                files.begin(path)
                files.out.write(content.encode())
            files.end()
            yield pd.DataFrame({"n": [len(b)]})

    return last.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_pages(page_lines: DataFrame, target: str) -> DataFrame:
    """(path, lines, bytes) of the written pages. Lines stream to their file in order, so a page may have any length."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path, n, size = Files(target), None, 0, 0
        for b in batches:
            done = []
            for p, line in zip(b["path"], b["line"], strict=True):
                if p != path:
                    if path is not None:
                        done.append((path, n, size))
                    files.begin(p)
                    path, n, size = p, 0, 0
                data = (line + "\n").encode()
                files.out.write(data)
                n, size = n + 1, size + len(data)
            if done:
                yield pd.DataFrame(done, columns=["path", "lines", "bytes"])
        files.end()
        if path is not None:
            yield pd.DataFrame([(path, n, size)], columns=["path", "lines", "bytes"])

    dealt = page_lines.where("line IS NOT NULL").repartition("path").sortWithinPartitions("path", "section", "a", "b", "c", "line")
    return dealt.select("path", "line").mapInPandas(write, "path string, lines long, bytes long")

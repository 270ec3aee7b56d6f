"""A Python data source that lists a directory tree: files and directories, empty ones too."""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Subtree(InputPartition):
    def __init__(self, top: str, deep: bool):
        self.top, self.deep = top, deep


class TreeSource(DataSource):
    """spark.read.format("path_tree").option("root", ...).

    Options: below, a directory in the root to list instead of all (its depth still counts from the root); depth
    (0: no limit); exclude (directory names, by commas); suffixes (of files to leave out, by commas); split (how
    many levels of directories are listed on the driver to make partitions, 2 by default). kind is "file",
    "directory" or "unreadable", a row for each directory that couldn't be listed; cut: a directory that isn't
    entered for its depth.
    """

    @classmethod
    def name(cls) -> str:
        return "path_tree"

    def schema(self) -> str:
        return "relative_path string, kind string, cut boolean"

    def reader(self, schema) -> DataSourceReader:
        listed = lambda o: [x.strip().lower() for x in self.options.get(o, "").split(",") if x.strip()]
        suffixes = tuple(x if x.startswith(".") else "." + x for x in listed("suffixes"))
        return TreeReader(self.options["root"], self.options.get("below", "").strip("/"), int(self.options.get("depth", "0")), set(listed("exclude")), suffixes, int(self.options.get("split", "2")))


class TreeReader(DataSourceReader):
    """A partition lists one directory, or all below one. Links to directories are listed, not followed."""

    def __init__(self, root: str, below: str, depth: int, exclude: set[str], suffixes: tuple[str, ...], split: int):
        self.root, self.below, self.depth, self.exclude, self.suffixes, self.split = root, below, depth, exclude, suffixes, split

    def listed(self, at: str):
        """Rows of a directory's entries, and which of them are entered."""
        try:
            entries = sorted(os.scandir(os.path.join(self.root, at)), key=lambda e: e.name)
        except OSError:
            return [(at, "unreadable", False)], []
        rows, inner = [], []
        for e in entries:
            path, directory = f"{at}/{e.name}" if at else e.name, e.is_dir()
            if e.name.lower() in self.exclude if directory else e.name.lower().endswith(self.suffixes):
                continue
            follow = directory and not e.is_symlink()
            last = self.depth > 0 and path.count("/") + 1 >= self.depth
            rows.append((path, "directory" if directory else "file", follow and last))
            if follow and not last:
                inner.append(path)
        return rows, inner

    def partitions(self):
        out, level = [], [self.below]
        for _ in range(self.split):
            out += [Subtree(at, False) for at in level]
            level = [path for at in level for path in self.listed(at)[1]]
        return out + [Subtree(at, True) for at in level]

    def read(self, part: Subtree):
        waiting = [part.top]
        while waiting:
            rows, inner = self.listed(waiting.pop())
            yield from rows
            if part.deep:
                waiting += inner

"""Source trees as a table: a data source that lists on the driver and reads on executors.

Files are ordered by relative path; the position is the corpus order that breaks
ties everywhere. Spark's own file readers skip names that begin with `_` or `.`,
which this one must not.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "corpus_index int, rel_path string, path string, text string, error string"
FILES_PER_PARTITION = 256


@dataclass(frozen=True)
class FileRule:
    """Which files of a tree belong to a language."""

    suffixes: tuple[str, ...]
    any_case: bool = False
    skip_names: tuple[str, ...] = ()
    skip_suffixes: tuple[str, ...] = ()
    skip_dirs: tuple[str, ...] = ()

    def takes(self, name: str) -> bool:
        if name in self.skip_names or name.endswith(self.skip_suffixes or ("\0",)):
            return False
        return (os.path.splitext(name)[1].lower() in self.suffixes) if self.any_case else name.endswith(self.suffixes)


# Suffixes and folders by language.
RULES = {
    "java": FileRule((".java",), skip_names=("module-info.java",)),
    "python": FileRule((".py",), skip_dirs=("__pycache__",)),
    "javascript": FileRule(
        (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"), any_case=True, skip_suffixes=(".d.ts",),
        skip_dirs=("node_modules", ".git", "dist", "build", ".next", "coverage", ".nyc_output", "__pycache__"),
    ),
}


def list_files(root: str, rule: FileRule) -> list[str]:
    """Relative paths with slashes, ascending."""
    found = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in rule.skip_dirs]
        found += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names if rule.takes(n)]
    return sorted(found)


@dataclass
class _Chunk(InputPartition):
    first: int
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"]
        self.rule = RULES[options.get("language", "java")]

    def partitions(self) -> list[InputPartition]:
        paths = list_files(self.root, self.rule)
        return [_Chunk(k, paths[k : k + FILES_PER_PARTITION]) for k in range(0, len(paths), FILES_PER_PARTITION)] or [_Chunk(0, [])]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        if partition.paths and not os.path.isdir(self.root):
            raise FileNotFoundError(f"{self.root} is not a folder that this executor sees; sources have to lie where driver and executors do")
        for k, rel in enumerate(partition.paths):
            path, text, error = os.path.join(self.root, rel), None, None
            try:
                with open(path, encoding="utf-8", errors="replace") as f:
                    text = f.read()
            except OSError as e:
                error = str(e)
            yield partition.first + k, rel, path, text, error


class SourceTree(DataSource):
    """spark.read.format("source_tree").option("root", ...).option("language", ...)"""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def source_files(spark: SparkSession, root: str, language: str) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("root", os.path.abspath(root)).option("language", language).load()

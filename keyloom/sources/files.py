"""File trees as tables: pruning by path, scannable names, text only."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.text import any_contains, path_glob_regex

# Paths that are never scanned.
ALWAYS_EXCLUDED = [
    ".git/", "node_modules/", "target/", "dist/", "build/", ".env.example", ".env.sample", ".env.template",
]
# Extensions of text files worth scanning, and bare names.
SCANNABLE_EXTENSIONS = [
    "env", "txt", "sh", "bash", "zsh", "py", "js", "ts", "rs", "go", "java", "rb", "php",
    "yml", "yaml", "json", "toml", "xml", "conf", "config", "ini", "properties",
]
SCANNABLE_NAMES = ["Dockerfile", "Makefile"]


def file_name(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column | str) -> Column:
    """Text after the last dot of the name; a leading dot does not count. Null if none."""
    name = file_name(path)
    return F.when(name.rlike(r"(?s)\A.+\."), F.substring_index(name, ".", -1))


def is_excluded(path: Column | str, patterns: list[str] | None = None) -> Column:
    """Globs match the whole path, other patterns any part of it. Malformed globs are ignored."""
    path = F.col(path) if isinstance(path, str) else path
    patterns = patterns or []
    out = any_contains(path, ALWAYS_EXCLUDED + [p for p in patterns if "*" not in p])
    globs = [path_glob_regex(p) for p in patterns if "*" in p]
    for regex in filter(None, globs):
        out = out | path.rlike(regex)
    return out


def is_scannable(path: Column | str, dotenv_variants: bool = False) -> Column:
    """``.env.local`` has the extension ``local`` and is left out unless ``dotenv_variants``."""
    path = F.col(path) if isinstance(path, str) else path
    name, ext = file_name(path), extension(path)
    bare = ext.isNull() & (name.startswith(".env") | name.isin(SCANNABLE_NAMES))
    out = F.coalesce(F.lower(ext).isin(SCANNABLE_EXTENSIONS), F.lit(False)) | bare
    return out | name.startswith(".env.") if dotenv_variants else out


def scan_targets(
    files: DataFrame, exclude: list[str] | None = None, dotenv_variants: bool = False
) -> DataFrame:
    return files.filter(~is_excluded("path", exclude) & is_scannable("path", dotenv_variants))


def is_text(raw: Column | str) -> Column:
    """Valid UTF-8 without a NUL byte."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    as_text = raw.cast("string")
    return F.is_valid_utf8(as_text) & ~as_text.contains("\x00")


def find_files(files: DataFrame, part: str) -> DataFrame:
    return files.filter(F.col("path").contains(part))


# Rows of file content per Arrow batch end at this many bytes.
_BATCH_BYTES = 32 << 20


def _children(folder: str) -> Iterator[tuple[str, bool]]:
    """(path, is_folder) of what lies directly in a folder, or of the path itself if it is a file.

    Linked folders are not entered. A folder that cannot be listed fails the task.
    """
    from pyarrow import fs

    if "://" not in folder:
        if os.path.isfile(folder):
            yield folder, False
            return
        with os.scandir(folder) as entries:
            for entry in sorted(entries, key=lambda e: e.name):
                if entry.is_dir(follow_symlinks=False) or entry.is_file():
                    yield os.path.join(folder, entry.name), entry.is_dir(follow_symlinks=False)
        return
    plain, _, options = folder.partition("?")
    system, base = fs.FileSystem.from_uri(folder)
    before = plain.removesuffix(base)  # scheme and authority, as they were given
    after = f"?{options}" if options else ""
    info = system.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base))
    for child in found:
        yield f"{before}{child.path}{after}", child.type == fs.FileType.Directory


def _list_once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One level down: folders become their children, files stay."""
    for frame in frames:
        for path, folder in zip(frame["path"], frame["folder"], strict=True):
            found = list(_children(path)) if folder else [(path, False)]
            yield pd.DataFrame(found, columns=["path", "folder"]).astype({"path": "object", "folder": "bool"})


def _list_below(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All files of a folder's tree."""
    for frame in frames:
        pending = [*zip(frame["path"], frame["folder"], strict=True)]
        found: list[str] = []
        while pending:
            path, folder = pending.pop()
            if folder:
                pending.extend(_children(path))
            else:
                found.append(path)
            if len(found) == 10_000 or not pending:
                yield pd.DataFrame({"path": found}, dtype="object")
                found = []


def _read_bytes(path: str) -> bytes:
    from pyarrow import fs

    if "://" not in path:
        with open(path, "rb") as handle:
            return handle.read()
    system, base = fs.FileSystem.from_uri(path)
    with system.open_input_stream(base) as handle:
        return handle.read()


def _read_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole texts; a file that is not UTF-8 is left out, one that cannot be read fails the task."""
    for frame in frames:
        paths, texts, size = [], [], 0
        for path in frame["path"]:
            raw = _read_bytes(path)
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            paths.append(path)
            texts.append(text)
            size += len(raw)
            if size >= _BATCH_BYTES:
                yield pd.DataFrame({"path": paths, "content": texts})
                paths, texts, size = [], [], 0
        yield pd.DataFrame({"path": paths, "content": texts}, dtype="object")


def list_files(spark: SparkSession, paths: list[str], widen: int = 2) -> DataFrame:
    """Every file below the given folders.

    The first ``widen`` levels are listed one by one and dealt out to all tasks, which
    then list the trees below them. Spark's own file sources skip names that start with
    a dot, which are the very files wanted here, so the tasks list the folders themselves.
    """
    found = spark.createDataFrame([(p, True) for p in paths], "path string, folder boolean")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(widen):
        found = found.repartition(width, "path").mapInPandas(_list_once, "path string, folder boolean")
    return found.repartition(width, "path").mapInPandas(_list_below, "path string")


def read_files(
    spark: SparkSession,
    paths: str | list[str],
    exclude: list[str] | None = None,
    scannable_only: bool = True,
    dotenv_variants: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """``(file_id, path, content)`` of the text files below ``paths``.

    Path rules run on the listing, so excluded files are never opened; the remaining
    paths are spread evenly before reading, wherever they were found.
    """
    listing = list_files(spark, [paths] if isinstance(paths, str) else paths)
    keep = ~is_excluded("path", exclude)
    if scannable_only:
        keep = keep & is_scannable("path", dotenv_variants)
    width = tasks or spark.sparkContext.defaultParallelism
    read = listing.filter(keep).repartition(width).mapInPandas(_read_batches, "path string, content string")
    return read.select(F.col("path").alias("file_id"), "path", "content")

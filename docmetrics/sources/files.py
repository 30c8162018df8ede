"""Source trees as a table of files."""

from __future__ import annotations

import errno
import os
import re
import shutil
import stat
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmetrics.session import scratch_dir

# File names that hold no documentable code.
SKIPPED_NAMES = ["__init__.py", "setup.py", "conftest.py", "manage.py"]
MIGRATION_NAME = r"^[0-9a-f]{12}_.*\.py$"
_PUBLIC = r"[^_].*\.py|\.py"  # Python files whose name is not private


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def module_of(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_documentable(path: Column) -> Column:
    """False for migrations, caches, tests, package markers, set-up and private files."""
    name = file_name(path)
    return ~(
        F.lower(path).contains("migration")
        | name.rlike(MIGRATION_NAME)
        | path.contains("__pycache__")
        | (path.contains("/tests/") & name.startswith("test_"))
        | name.isin(SKIPPED_NAMES)
        | name.startswith("_")
    )


def _named(files: DataFrame, root: str, project: str, snapshot_id: str) -> DataFrame:
    # Spark reports file: URIs; strip scheme and root to get the project-relative path.
    path = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    prefix = root.rstrip("/")
    rel = F.when(
        path.startswith(prefix + "/"), F.substr(path, F.lit(len(prefix) + 2))
    ).otherwise(file_name(path))
    return files.select(
        F.lit(project).alias("project"),
        F.lit(snapshot_id).alias("snapshot_id"),
        path.alias("file_path"),
        rel.alias("rel_path"),
        module_of(path).alias("module"),
        *[c for c in ("content",) if c in files.columns],
    )


def _as_text(files: DataFrame) -> DataFrame:
    """Decode to text with line feeds only; undecodable files get a null source."""
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), F.regexp_replace(raw, "\r\n?", "\n"))
    return files.withColumn("source", text).drop("content")


def _hidden(name: str) -> bool:
    """Names that Spark's file scan passes over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listed(folders: DataFrame, pattern: str) -> DataFrame:
    """path, length, is_dir of what lies right in local folders (path): folders, and files that match and hold a byte."""
    match = re.compile(pattern, re.DOTALL).fullmatch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, bool]] = []
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                with os.scandir(folder) as found:
                    for entry in found:
                        if _hidden(entry.name):
                            continue
                        try:
                            at = entry.stat()
                        except FileNotFoundError:  # gone since it was listed
                            continue
                        below = stat.S_ISDIR(at.st_mode)
                        if below or (at.st_size and match(entry.name)):
                            rows.append((f"{folder}/{entry.name}", 0 if below else at.st_size, below))
                        if len(rows) >= 10000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "length", "is_dir"])
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "length", "is_dir"])

    return folders.mapInArrow(run, "path string, length long, is_dir boolean")


def _walked(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path and length of the files below a local folder, listed by the executors.

    The lists of each depth are written to the scratch folder; the driver learns only whether
    there are folders below.
    """
    base, tasks = f"{scratch_dir(spark)}/listing-{uuid.uuid4().hex}", 3 * spark.sparkContext.defaultParallelism
    schema = "path string, length long, is_dir boolean"
    folders, depth = spark.createDataFrame([(root,)], "path string"), 0
    while True:
        _listed(folders, pattern).write.parquet(f"{base}/depth={depth}")
        folders = spark.read.schema(schema).parquet(f"{base}/depth={depth}").where("is_dir").select("path")
        if not folders.head(1):
            break
        folders, depth = folders.repartition(tasks), depth + 1
    return spark.read.schema(schema).parquet(*[f"{base}/depth={d}" for d in range(depth + 1)]).where("not is_dir").select("path", "length")


def _text_of(path: str, archive: str | None) -> bytes:
    """A file's bytes; with archive, of the one moved there if it was (it may be moved meanwhile)."""
    places = [archive + path, path, archive + path] if archive else [path]
    for i, place in enumerate(places):
        try:
            with open(place, "rb") as f:
                return f.read()
        except FileNotFoundError:
            if i == len(places) - 1:
                raise
    raise AssertionError


def _opened(paths: DataFrame, archive: str | None = None) -> DataFrame:
    """path and content of local files (path), opened by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, size = [], [], 0
            for path in batch.column("path").to_pylist():
                texts.append(_text_of(path, archive))
                paths.append(path)
                size += len(texts[-1])
                if size >= 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], names=["path", "content"])
                    paths, texts, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary())], names=["path", "content"])

    return paths.mapInArrow(run, "path string, content binary")


def _local(root: str) -> str | None:
    """The path of a local or mounted folder as the executors open it; None for other schemes and globs."""
    path = re.sub(r"^file:/+", "/", root).rstrip("/")
    return os.path.normpath(path) if path.startswith("/") and not re.search(r"[*?\[\]{}\\%]", path) else None


def read_sources(
    spark: SparkSession,
    root: str,
    project: str,
    snapshot_id: str = "latest",
    documentable_only: bool = True,
    exclude: Sequence[str] = (),
    max_bytes: int | None = None,
    also: Sequence[str] = (),
) -> DataFrame:
    """All Python files below `root`, or `root` itself if it is one file.

    Private names are dropped while listing and oversized files by their length, so neither
    is opened. `exclude` names path parts to leave out. As Spark's file scan does, this passes
    over files of no bytes, which hold nothing to document, and over names that begin with
    `_` or `.`. Such files are not documentable; name such folders below `root` in `also`
    (globs are allowed) to read them.

    A local or mounted folder is listed by the executors, so no list of all files comes to the
    driver; other schemes, globs and `also` go through Spark's file scan.
    """
    local = _local(root)
    walk = local is not None and not root.endswith(".py") and os.path.isdir(local)
    folders = [f"{root.rstrip('/')}/{part}" for part in also]
    found = []
    if walk:
        files = _walked(spark, local, _PUBLIC if documentable_only else r".*\.py")
        if max_bytes is not None:
            files = files.where(F.col("length") <= max_bytes)
        found.append(_opened(files.select("path").repartition(3 * spark.sparkContext.defaultParallelism)))
    if folders or not walk:
        reader = spark.read.format("binaryFile")
        if not root.endswith(".py"):
            reader = reader.option("recursiveFileLookup", True).option(
                "pathGlobFilter", "[!_]*.py" if documentable_only else "*.py"
            )
        files = reader.load(folders if walk else [root, *folders])
        if max_bytes is not None:
            files = files.filter(F.col("length") <= max_bytes)
        found.append(files.select("path", "content"))
    files = found[0].union(found[1]) if len(found) > 1 else found[0]
    return _as_text(_kept(_named(files, root, project, snapshot_id), documentable_only, exclude))


def _kept(files: DataFrame, documentable_only: bool, exclude: Sequence[str]) -> DataFrame:
    if documentable_only:
        files = files.filter(is_documentable(F.col("file_path")))
    for part in exclude:
        files = files.filter(~F.concat(F.lit("/"), F.col("rel_path")).contains(f"/{part}/"))
    return files


def read_landed(
    spark: SparkSession, directory: str, project: str, snapshot_id: str = "latest"
) -> DataFrame:
    """Uploaded files in a landing directory, sub-directories kept."""
    return read_sources(spark, directory, project, snapshot_id)


def write_tree(sources: DataFrame, root: str) -> None:
    """Each source as a file root/rel_path, written by the executors; a task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        made: set[str] = set()
        for batch in batches:
            for name, text in zip(*(batch.column(c).to_pylist() for c in ("rel_path", "source")), strict=True):
                folder, _, last = f"{path}/{name}".rpartition("/")
                if folder not in made:
                    at.create_dir(folder, recursive=True)
                    made.add(folder)
                # Under a name that no reader takes, until it is whole.
                temp = f"{folder}/_{uuid.uuid4().hex}"
                with at.open_output_stream(temp, compression=None) as out:
                    out.write((text or "").encode())
                at.move(temp, f"{folder}/{last}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    sources.select("rel_path", "source").mapInArrow(run, "files long").agg(F.sum("files")).collect()


def _seen(spark: SparkSession, listed: str) -> DataFrame:
    """path of the files in a table of list_landed()."""
    try:
        return spark.read.schema("path string").parquet(listed)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string")
        raise


def _to_archive(paths: DataFrame, archive: str) -> None:
    """Move local files to their path below archive, by the executors. One whose path is there already stays, as does one that is gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = 0
            for path in batch.column("path").to_pylist():
                to = archive + path
                if os.path.exists(to):
                    continue
                os.makedirs(os.path.dirname(to), exist_ok=True)
                try:
                    os.rename(path, to)
                except FileNotFoundError:  # by a task that ran before
                    continue
                except OSError as e:
                    if e.errno != errno.EXDEV:
                        raise
                    whole = f"{os.path.dirname(to)}/_{uuid.uuid4().hex}"
                    shutil.copy2(path, whole)
                    os.replace(whole, to)
                    os.unlink(path)
                moved += 1
            yield pa.RecordBatch.from_arrays([pa.array([moved], pa.int64())], names=["files"])

    paths.mapInArrow(run, "files long").agg(F.sum("files")).collect()


def _listable(directory: str, archive: str | None) -> bool:
    """Whether executors can list a landing directory and move its files."""
    local = _local(directory)
    return local is not None and os.path.isdir(local) and (archive is None or _local(archive) is not None)


def list_landed(spark: SparkSession, directory: str, listed: str, per_part: int = 10000, archive: str | None = None, take: bool = True) -> None:
    """Add the files that have landed in a local directory and are not in the table `listed` yet to it.

    Each path is listed once, also if a file lands under it again. Executors list, compare and
    write; a part of the table has at most `per_part` paths. With `archive`, files that were listed
    before are moved there. With take=False nothing is added, only moved. Nothing is done where
    stream_sources() goes through Spark's file stream.
    """
    tasks, root = 3 * spark.sparkContext.defaultParallelism, _local(directory)
    if not _listable(directory, archive):
        return
    if archive and f"{_local(archive)}/".startswith(f"{root}/"):
        raise ValueError("the archive is a part of the landing directory")
    lying = _walked(spark, root, _PUBLIC).select("path")
    # Paths that are small on disk are not small in memory: they are never sent whole to each machine.
    seen = _seen(spark, listed).hint("merge")
    if archive:
        _to_archive(lying.join(seen, "path", "left_semi").repartition(tasks), _local(archive))
    if take:
        lying.join(seen, "path", "left_anti").repartition(tasks).write.mode("append").option("maxRecordsPerFile", per_part).parquet(listed)


def stream_sources(
    spark: SparkSession,
    directory: str,
    project: str,
    snapshot_id: str = "latest",
    max_files_per_trigger: int = 10000,
    archive: str | None = None,
    listed: str | None = None,
) -> DataFrame:
    """The landing directory as a stream of files.

    With `archive`, files that have been taken are moved there once a later batch is done, so the
    directory does not grow with what has landed.

    Spark's file stream keeps every file's name on the driver. With `listed`, a folder that goes
    with the stream's checkpoint, the driver holds one name per many files: list_landed() adds what lies in
    a local or mounted directory now to the table there, and the stream reads this table and opens the files.
    What lands later is taken once list_landed() runs or the stream is defined again; files listed
    before are moved to the archive then, and are opened there. max_files_per_trigger then holds for a
    part of the table, and a batch has up to three parts a core.
    """
    if listed and _listable(directory, archive):
        list_landed(spark, directory, listed, max_files_per_trigger, archive)
        parts = spark.readStream.schema("path string").option("maxFilesPerTrigger", 3 * spark.sparkContext.defaultParallelism).parquet(listed)
        files = _opened(parts, _local(archive) if archive else None)
        return _as_text(_kept(_named(files, directory, project, snapshot_id), True, ()))
    reader = spark.readStream.format("binaryFile")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = (
        reader
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "[!_]*.py")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .load(directory)
    )
    return _as_text(_kept(_named(files, directory, project, snapshot_id), True, ()))


def list_files(sources: DataFrame) -> DataFrame:
    """Name, relative path and full path of every file; reads no text on a table source."""
    return sources.select(
        "project",
        file_name(F.col("file_path")).alias("name"),
        F.col("rel_path").alias("path"),
        F.col("file_path").alias("full_path"),
    )


def changed_sources(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files that are new or whose text differs from the previous snapshot."""
    digest = F.sha2(F.coalesce(F.col("source"), F.lit("")), 256)
    seen = previous.select("project", "rel_path", digest.alias("_digest"))
    # Small on disk is not small in memory: a digest per file is never sent whole to each machine.
    return (
        current.withColumn("_digest", digest)
        .join(seen.hint("merge"), ["project", "rel_path", "_digest"], "left_anti")
        .drop("_digest")
    )

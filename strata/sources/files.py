"""File sources and sinks: CSV / JSON / Parquet ingest into a layer, exports,
text-corpus loading, JSON record stores and content-hash manifests.

Ingest counts come from the write itself (``Observation``), never from a
second scan. Directory listings are metadata calls on the driver; the data is
read by executors.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.catalog import Lake, check_identifier


def list_files(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, full_path, is_dir) for the direct children of ``path`` (any Hadoop FS)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        out.append((st.getPath().getName(), st.getPath().toString(), bool(st.isDirectory())))
    return sorted(out)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def _has_quoted_newlines(spark: SparkSession, path: str, quote: str = '"') -> bool:
    """Whether some line of a CSV leaves a quote open: then a record goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool | None = None,
    sampling_ratio: float = 1.0,
) -> DataFrame:
    """Header CSV. Records with quoted newlines need ``multi_line``, which makes
    files unsplittable; by default one pass over the lines finds out whether
    there are any (it stops at the first; pass False or True to save it).
    Without a schema, types are inferred from a ``sampling_ratio`` share of the
    rows (one extra pass over that share); very large inputs should pass a
    schema or a small ratio."""
    if multi_line is None:
        multi_line = _has_quoted_newlines(spark, path)
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True).option("samplingRatio", sampling_ratio)
    return reader.csv(path)


def _looks_like_json_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0][0].lstrip().startswith("[")


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool | None = None,
    sampling_ratio: float = 1.0,
) -> DataFrame:
    """Newline-delimited JSON, or a JSON array file when ``multi_line``.

    ``multi_line=None`` peeks at the first non-blank line to choose.
    """
    if multi_line is None:
        multi_line = _looks_like_json_array(spark, path)
    reader = spark.read.option("multiLine", bool(multi_line))
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("samplingRatio", sampling_ratio)
    return reader.json(path)


def read_any(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """``options``: schema, multi_line and sampling_ratio of CSV and JSON."""
    if fmt == "csv":
        return read_csv(spark, path, **options)
    if fmt == "json":
        return read_json(spark, path, **options)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported format: {fmt}")


def ingest(lake: Lake, table: str, path: str, fmt: str, mode: str = "overwrite",
           partition_by: list[str] | None = None, **options) -> int:
    """Create-or-replace ``bronze.table`` from a file; returns the row count.

    ``partition_by`` lays the table out in folders (e.g. by ingest date), so
    later filters on those columns prune whole folders. ``options`` (schema,
    multi_line, sampling_ratio) go to the CSV or JSON reader.
    """
    check_identifier(table)
    df = read_any(lake.spark, path, fmt, **options)
    return lake.write(df, "bronze", table, mode=mode, partition_by=partition_by)


def ingest_csv(lake: Lake, table: str, path: str, **options) -> int:
    return ingest(lake, table, path, "csv", **options)


def ingest_json(lake: Lake, table: str, path: str, **options) -> int:
    return ingest(lake, table, path, "json", **options)


def ingest_strict(lake: Lake, table: str, path: str, fmt: str = "csv", **options) -> int:
    """Like ``ingest`` but fails when the table already exists."""
    return ingest(lake, table, path, fmt, mode="errorifexists", **options)


_SUFFIXES = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


def ingest_all(lake: Lake, directory: str, max_parallel: int = 8,
               partition_by: dict[str, list[str]] | None = None) -> dict[str, int]:
    """Ingest every ``*.csv``/``*.json``/``*.parquet`` entry of a folder; table = file stem.

    Files are ingested concurrently (one Spark job per file, submitted from a
    small driver thread pool), so many small files keep the executors busy.
    """
    jobs: dict[str, list[tuple[str, str]]] = {}
    for name, full, _is_dir in list_files(lake.spark, directory):
        for suffix, fmt in _SUFFIXES.items():
            if name.endswith(suffix):
                jobs.setdefault(name[: -len(suffix)], []).append((full, fmt))
    lake.prepare("bronze")

    def of_table(stem: str) -> int:
        # files of one stem replace each other in order: CSV, JSON, Parquet
        rows = 0
        for full, fmt in sorted(jobs[stem], key=lambda job: list(_SUFFIXES.values()).index(job[1])):
            rows = ingest(lake, stem, full, fmt, "overwrite", (partition_by or {}).get(stem))
        return rows

    with ThreadPoolExecutor(max_workers=max(1, min(max_parallel, len(jobs) or 1))) as pool:
        return dict(zip(jobs, pool.map(of_table, jobs), strict=True))


def export_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Parquet export, or CSV with a header for any other format."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


# A path that holds one of these is not loaded as a document.
SKIP_PATHS = (".venv", "__pycache__")
# Names anywhere in a path, and paths from the root, that a manifest leaves out.
IGNORED_NAMES = (".venv", "__pycache__", ".git", ".gitignore", ".mypy_cache", ".pytest_cache")
IGNORED_FILES = ("uv.lock", ".harness_state.json", ".template-info.json")


def _tree_tasks(pattern: str):
    """Task functions, self-contained so that executors need no copy of the package: the children
    of a folder, the files below each entry, the contents of each file, and files written."""

    def store_of(path):
        from pyarrow import fs

        scheme, colon, rest = path.partition(":")
        if not colon or scheme == "file":
            return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
        authority, _, key = rest.lstrip("/").partition("/")
        store, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
        return store, base.rstrip("/") + "/" + key

    def listed(path, recursive):
        from pyarrow import fs

        store, base = store_of(path)
        found = store.get_file_info(fs.FileSelector(base.rstrip("/") or "/", recursive=recursive, allow_not_found=True))
        cut = len(base.rstrip("/"))
        return [(f.path[cut:], f.type == fs.FileType.Directory) for f in found if f.type != fs.FileType.NotFound]

    def children(root):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    found = listed(root, False)
                    for k in range(0, len(found), 10_000):
                        part = found[k:k + 10_000]
                        names = [name.lstrip("/") for name, _ in part]
                        yield pa.RecordBatch.from_arrays([pa.array([f"{root.rstrip('/')}/{n}" for n in names], pa.string()), pa.array(names, pa.string()),
                                                          pa.array([d for _, d in part], pa.bool_())], names=["path", "name", "is_dir"])

        return run

    def below(batches):
        from fnmatch import fnmatchcase

        import pyarrow as pa

        for batch in batches:
            paths, rels = [], []
            for path, name, is_dir in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = [f for f, folder in listed(path, True) if not folder] if is_dir else [""]
                found = [f for f in found if fnmatchcase((name + f).rsplit("/", 1)[-1], pattern)]
                paths += [path + f for f in found]
                rels += [name + f for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(rels, pa.string())], names=["path", "rel"])

    def contents(batches):
        import pyarrow as pa

        limit = 16 << 20  # file contents handed over at a time

        def rows(paths, rels, raw):
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(rels, pa.string()), pa.array(raw, pa.binary())], names=["path", "rel", "content"])

        for batch in batches:
            paths, rels, raw, size = [], [], [], 0
            for path, rel in zip(batch.column("path").to_pylist(), batch.column("rel").to_pylist(), strict=True):
                store, base = store_of(path)
                with store.open_input_stream(base, compression=None) as f:
                    raw.append(f.read())
                paths.append(path)
                rels.append(rel)
                size += len(raw[-1])
                if size >= limit:
                    yield rows(paths, rels, raw)
                    paths, rels, raw, size = [], [], [], 0
            yield rows(paths, rels, raw)

    def put(root):
        def run(batches):
            import pyarrow as pa

            made = set()
            for batch in batches:
                for rel, raw in zip(batch.column("rel").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    store, base = store_of(f"{root.rstrip('/')}/{rel}")
                    folder = base.rsplit("/", 1)[0]
                    if folder not in made:
                        store.create_dir(folder, recursive=True)
                        made.add(folder)
                    with store.open_output_stream(base, compression=None) as f:
                        f.write(raw or b"")
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        return run

    return children, below, contents, put


def list_tree(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """(path, rel) of every file below ``directory`` whose name matches; none where it does not exist.

    No name is hidden: Spark's own file sources pass over names that start with
    a dot or an underscore. One task lists the folder's direct children, which
    are dealt to all tasks; each lists what is below its share. The driver sees
    no name.
    """
    children, below, _, _ = _tree_tasks(pattern)
    width = 4 * spark.sparkContext.defaultParallelism
    tops = spark.range(0, 1, 1, 1).mapInArrow(children(directory), "path string, name string, is_dir boolean")
    return tops.repartition(width, "path").mapInArrow(below, "path string, rel string")


def read_files(files: DataFrame) -> DataFrame:
    """(path, rel, content) of listed files; a folder's files are dealt over all tasks."""
    width = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "rel").repartition(width, "path").mapInArrow(_tree_tasks("*")[2], "path string, rel string, content binary")


def write_tree(files: DataFrame, directory: str) -> int:
    """Write every row (rel, content binary) as the file ``rel`` below ``directory``; returns how many.

    Tasks write the files themselves, also a task that runs again: it puts the
    same bytes into the same place. Null contents are empty files.
    """
    put = _tree_tasks("*")[3](directory)
    return files.select("rel", "content").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]


def load_documents(spark: SparkSession, directory: str, pattern: str = "*.md") -> DataFrame:
    """Recursive text-file load: one row per file (path, text).

    Bytes that are not UTF-8 are replaced. Files in hidden folders count; paths
    that hold ``.venv`` or ``__pycache__`` do not. A folder that is not there
    has no documents. Tasks read the files through pyarrow's file systems
    (local, HDFS, S3, GCS).
    """
    files = list_tree(spark, directory, pattern)
    for part in SKIP_PATHS:
        files = files.where(~F.col("path").contains(part))
    return read_files(files).select("path", F.expr("make_valid_utf8(CAST(content AS STRING))").alias("text"))


def write_documents(df: DataFrame, directory: str, key: str, text: str = "text") -> str:
    """Write one text file per ``key`` value (folder ``key=value``)."""
    (
        df.select(F.col(key), F.col(text))
        .repartition(F.col(key))
        .write.mode("overwrite")
        .partitionBy(key)
        .option("lineSep", "\n")
        .text(directory)
    )
    return directory


def strip_final_newline(c):
    """The text sink ends each record with a newline; remove exactly one."""
    return F.when(c.endswith("\n"), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)


def read_records(
    spark: SparkSession, path: str, schema: T.StructType | str, category: str | None = None
) -> DataFrame:
    """JSON record store scan; malformed records are dropped, not fatal.

    The store is partitioned by category, so a category filter prunes folders.
    """
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if category is not None:
        df = df.where(F.col("category") == category)
    return df


def write_records(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("category").json(path)


def file_manifest(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of every file below ``directory`` (binary content), hidden ones too,
    without the ignored names and files."""
    files = list_tree(spark, directory, pattern)
    ignored = F.arrays_overlap(F.split("rel", "/"), F.array(*[F.lit(n) for n in IGNORED_NAMES]))
    files = files.where(~ignored & ~F.col("rel").isin(*IGNORED_FILES))
    return read_files(files).select("path", F.sha2("content", 256).alias("sha256"))


def text_manifest(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """Manifest of a table of texts: (path, sha256 of the UTF-8 text)."""
    return df.select(F.col(path_col).alias("path"), F.sha2(F.col(text_col), 256).alias("sha256"))

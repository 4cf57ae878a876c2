"""Registry-driven multi-source read (S1), declared-schema read (S3), split
resolution (S4), fault-isolated load with a report (S5), profile (S6) and
corpus scan (S7)."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textpairs.operators.pairs import ColumnMappingError, canonicalise, concat_sources, require_columns
from textpairs.session import broadcast_bounded, cut_lineage

log = logging.getLogger(__name__)

SPLITS = ("train", "validation", "test")
# fixed values: split maps of the sources
IDENTITY_SPLITS = {"train": "train", "validation": "validation", "test": "test"}
# requested split -> stored split, for sources that have no validation files
VALIDATION_FROM_TEST = {"train": "train", "validation": "test", "test": "test"}


@dataclass(frozen=True)
class SourceSpec:
    """One registered source.

    Stored rows come either from files (``path`` + ``format``; stored splits are
    sub-directories named in ``split_dirs`` or values of ``split_col``) or from
    ``loader(spark)``, a DataFrame that already has ``stored_split`` and
    ``row_no``. ``row_no`` is the stored position ("first n" means by it).
    """

    name: str
    document_col: str | None
    summary_col: str | None
    split_map: Mapping[str, str] = field(default_factory=lambda: dict(IDENTITY_SPLITS))
    path: str | None = None
    format: str = "parquet"
    split_dirs: Mapping[str, str] | None = None
    split_col: str | None = None
    order_col: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    schema: StructType | None = None
    loader: Callable[[SparkSession], DataFrame] | None = None


def declared_schema(document_col: str, summary_col: str) -> StructType:
    return StructType([StructField(document_col, StringType()), StructField(summary_col, StringType())])


def read_with_schema(spark: SparkSession, paths: Sequence[str], schema: StructType,
                     fmt: str = "parquet", options: Mapping[str, str] | None = None) -> DataFrame:
    """S3: many files to one table under a declared schema.

    Each path's own schema is read first (file footers, no job over the rows):
    a declared column that is missing or has another type is an error, where a
    plain read would give nulls.
    """
    if fmt == "parquet":
        for path in paths:
            found = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields}
            wrong = [f.name for f in schema.fields if found.get(f.name) != f.dataType]
            if wrong:
                raise ColumnMappingError(f"'{path}' lacks declared columns {wrong} or has them with another type; "
                                         f"found {sorted(found)}")
    reader = spark.read.format(fmt).schema(schema).options(**(options or {}))
    if fmt == "parquet":
        reader = reader.option("mergeSchema", "false")
    return reader.load(list(paths))


def path_exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    st = fs.globStatus(hpath)
    return st is not None and len(st) > 0


#: Options of a read that skips files it cannot read; ``lost_files`` says which.
SKIP_BROKEN = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


def _skipping(spark: SparkSession, fmt: str, path: str, schema: StructType | None, options: Mapping[str, str]) -> DataFrame:
    """``path`` read without the files that cannot be read. Where the file that Spark would take the
    schema from is one of them, the schema comes from the footers of all files."""
    reader = spark.read.format(fmt).options(**dict(options), **SKIP_BROKEN)
    if schema is not None:
        return reader.schema(schema).load(path)
    try:
        return reader.load(path)
    except AnalysisException:
        return reader.option("mergeSchema", "true").load(path)


def _stored_rows(spark: SparkSession, spec: SourceSpec, wanted: set[str],
                 warnings: list | None = None, skip_broken: bool = False) -> DataFrame:
    """Rows of the stored splits this source needs, with ``stored_split`` and ``row_no``."""
    if spec.loader is not None:
        df = spec.loader(spark)
        return df.filter(F.col("stored_split").isin(sorted(wanted)))
    if spec.path is None:
        raise ValueError(f"source '{spec.name}': neither path nor loader")
    base = spec.path.rstrip("/")

    def load(path: str) -> DataFrame:
        if skip_broken:
            return _skipping(spark, spec.format, path, spec.schema, spec.options)
        r = spark.read.format(spec.format).options(**dict(spec.options))
        return (r.schema(spec.schema) if spec.schema is not None else r).load(path)

    if spec.split_dirs:
        parts = []
        for stored in sorted(wanted):
            sub = spec.split_dirs.get(stored)
            if sub is None:
                continue
            pattern = f"{base}/{sub}"
            if not path_exists(spark, pattern):
                msg = f"source '{spec.name}': no files for split '{stored}' at {pattern}"
                log.warning(msg)
                if warnings is not None:
                    warnings.append((spec.name, stored, msg))
                continue
            parts.append(load(pattern).withColumn("stored_split", F.lit(stored)))
        if not parts:
            raise FileNotFoundError(f"source '{spec.name}': no split files under {base}")
        df = concat_sources(parts)
    else:
        df = load(base)
        if spec.split_col is None:
            raise ValueError(f"source '{spec.name}': give split_dirs or split_col")
        df = df.withColumnRenamed(spec.split_col, "stored_split") \
            .filter(F.col("stored_split").isin(sorted(wanted)))
    if "row_no" not in df.columns:
        if spec.order_col is None:
            raise ValueError(f"source '{spec.name}': give order_col (stored position)")
        df = df.withColumn("row_no", F.col(spec.order_col).cast("bigint"))
    return df


def split_mapping(spark: SparkSession, specs: Sequence[SourceSpec],
                  splits: Sequence[str] = SPLITS) -> DataFrame:
    """(source, split, stored_split) rows of the registry: a few rows per source."""
    rows = [(s.name, split, s.split_map[split]) for s in specs for split in splits
            if split in s.split_map]
    return spark.createDataFrame(rows, "source string, split string, stored_split string")


def resolve_splits(stored: DataFrame, mapping: DataFrame, n_rows_bound: int) -> DataFrame:
    """Requested split <- stored split. One stored row may serve two splits
    (validation and test from one test file): it then becomes two rows."""
    return stored.join(broadcast_bounded(mapping, n_rows_bound), ["source", "stored_split"])


def canonical_source(spark: SparkSession, spec: SourceSpec,
                     splits: Sequence[str] = SPLITS, warnings: list | None = None, skip_broken: bool = False) -> DataFrame:
    """One source as canonical stored rows (before split resolution)."""
    wanted = {spec.split_map[s] for s in splits if s in spec.split_map}
    stored = _stored_rows(spark, spec, wanted, warnings, skip_broken)
    require_columns(stored, spec.name, spec.document_col, spec.summary_col)
    return (canonicalise(stored, spec.document_col, spec.summary_col,
                         keep=["stored_split", "row_no"])
            .withColumn("source", F.lit(spec.name)))


def _finish(resolved: DataFrame) -> DataFrame:
    return resolved.select(
        "source", "split", "row_no",
        F.concat_ws(":", "source", F.col("row_no").cast("string")).alias("row_key"),
        "input_text", "target_text")


def read_sources(spark: SparkSession, specs: Sequence[SourceSpec],
                 splits: Sequence[str] = SPLITS) -> DataFrame:
    """Read every registered source into one canonical DataFrame
    ``source, split, row_no, row_key, input_text, target_text``. Errors raise."""
    frames = [canonical_source(spark, s, splits) for s in specs]
    mapping = split_mapping(spark, specs, splits)
    return _finish(resolve_splits(concat_sources(frames), mapping, len(specs) * len(splits)))


def lost_files(spark: SparkSession, specs: Sequence[SourceSpec], splits: Sequence[str] = SPLITS) -> DataFrame:
    """``source, stored_split, file, problem, rows_stored, rows_read`` of every Parquet file that a read
    which skips broken files loses in part or whole.

    The files a read plans (their listing) are compared with those that give rows
    (``_metadata.file_path``). A scan without columns counts a file's rows from its footer; the same
    scan with the needed columns decodes them, and reads fewer rows where pages are damaged.
    A file that gives no rows at all is opened once more by itself, which tells an empty file (not
    reported) from an unreadable one. Sources of other formats or with a loader have no row counts
    of their own and are not checked."""
    out = None
    for spec in specs:
        if spec.path is None or spec.format != "parquet" or not spec.split_dirs:
            continue
        for stored in sorted({spec.split_map[s] for s in splits if s in spec.split_map}):
            sub = spec.split_dirs.get(stored)
            pattern = f"{spec.path.rstrip('/')}/{sub}"
            if sub is None or not path_exists(spark, pattern):
                continue
            planned = spark.read.format("binaryFile").load(pattern).select(F.col("_metadata.file_path").alias("file"))
            needed = [c for c in (spec.document_col, spec.summary_col, spec.order_col) if c]
            fields = spec.schema or StructType([StructField(c, StringType()) for c in needed])
            try:
                rows = _skipping(spark, "parquet", pattern, None, {})
                needed = [c for c in needed if c in rows.columns]
            except Exception:  # noqa: BLE001 - no file has a readable schema
                rows, needed = spark.createDataFrame([], fields).withColumn("_metadata", F.struct(F.lit("").alias("file_path"))), []
            path = F.col("_metadata.file_path").alias("file")
            stored_rows = rows.select(path).groupBy("file").agg(F.count(F.lit(1)).alias("rows_stored"))
            decoded = [F.max(F.xxhash64(c)).alias(f"_d{i}") for i, c in enumerate(needed)]
            read = rows.select(path, *needed).groupBy("file").agg(F.count(F.lit(1)).alias("rows_read"), *decoded)
            # (the result depends on the decoded columns, so that the scan has to read them)
            undecoded = " or ".join(["false", *[f"_d{i} is null" for i in range(len(needed))]])
            seen = (planned.join(stored_rows, "file", "left").join(read, "file", "left")
                    .select("file", "rows_stored", F.expr(f"if({undecoded}, 0, coalesce(rows_read, 0))").cast("bigint").alias("rows_read")))
            short = seen.filter(F.col("rows_stored") > F.col("rows_read")).withColumn("problem", F.lit("cut short"))
            bad = [(r["file"], None, 0, "unreadable") for r in seen.filter("rows_stored is null").select("file").toLocalIterator()
                   if not _readable(spark, r["file"])]
            whole = spark.createDataFrame(bad, "file string, rows_stored bigint, rows_read bigint, problem string")
            found = (short.unionByName(whole).withColumn("source", F.lit(spec.name)).withColumn("stored_split", F.lit(stored))
                     .select("source", "stored_split", "file", "problem", "rows_stored", "rows_read"))
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "source string, stored_split string, file string, problem string, rows_stored bigint, rows_read bigint")
    return cut_lineage(out)


def _readable(spark: SparkSession, file: str) -> bool:
    try:
        spark.read.parquet(file).count()
    except Exception:  # noqa: BLE001 - any failure makes the file unreadable
        return False
    return True


def load_with_report(spark: SparkSession, specs: Sequence[SourceSpec],
                     splits: Sequence[str] = SPLITS) -> tuple[DataFrame, DataFrame]:
    """A failing source or file is reported and skipped; all failing is an error, and so is a
    registry in which no source has train files.

    Returns (pairs, report). ``report`` has one row per (source, split): ``status`` is ok,
    missing (split absent, warned), damaged (``lost_files`` files of it could not be read whole;
    ``lost_files()`` names them) or error (source failed, with the message), and
    ``rows`` counts the rows that split received. Schema problems are found here, on the driver, before
    any job runs; damaged files when the report is made."""
    ok_specs, frames, errors, warnings = [], [], [], []
    for spec in specs:
        try:
            frames.append(canonical_source(spark, spec, splits, warnings, skip_broken=True))
            ok_specs.append(spec)
        except Exception as e:  # noqa: BLE001 - isolate any failing source
            log.error("failed to load source %s: %s", spec.name, e)
            errors.append((spec.name, str(e)))
    if not ok_specs:
        raise RuntimeError(f"every source of {[n for n, _ in errors]} failed: " + "; ".join(m for _, m in errors))
    missing = {(s, st) for s, st, _ in warnings}
    if "train" in splits and all("train" not in s.split_map or (s.name, s.split_map["train"]) in missing for s in ok_specs):
        raise RuntimeError(f"none of {[s.name for s in ok_specs]} has train files")
    mapping = split_mapping(spark, ok_specs, splits)
    bound = len(specs) * len(splits)
    pairs = _finish(resolve_splits(concat_sources(frames), mapping, bound))
    counts = pairs.groupBy("source", "split").agg(F.count(F.lit(1)).alias("rows"))
    lost = (lost_files(spark, ok_specs, splits).groupBy("source", "stored_split")
            .agg(F.count(F.lit(1)).alias("lost_files"), F.coalesce(F.sum(F.col("rows_stored") - F.col("rows_read")), F.lit(0)).alias("cut"))
            .join(broadcast_bounded(mapping, bound), ["source", "stored_split"]).select("source", "split", "lost_files", "cut"))
    expected = spark.createDataFrame(
        [(s.name, sp, (s.name, s.split_map[sp]) in missing)
         for s in ok_specs for sp in splits if sp in s.split_map],
        "source string, split string, missing boolean")
    ok_rows = (expected.join(broadcast_bounded(counts, bound), ["source", "split"], "left")
               .join(broadcast_bounded(lost, bound), ["source", "split"], "left")
               .select("source", "split",
                       F.when(F.col("missing"), "missing").when(F.col("lost_files") > 0, "damaged").otherwise("ok").alias("status"),
                       # (a count reads footers only, so it holds the rows behind a damaged page)
                       (F.coalesce(F.col("rows"), F.lit(0)) - F.coalesce(F.col("cut"), F.lit(0))).cast("bigint").alias("rows"),
                       F.coalesce(F.col("lost_files"), F.lit(0)).cast("bigint").alias("lost_files"),
                       F.lit(None).cast("string").alias("error")))
    err_rows = spark.createDataFrame(
        [(name, sp, "error", 0, 0, msg) for name, msg in errors for sp in splits],
        "source string, split string, status string, rows bigint, lost_files bigint, error string")
    return pairs, ok_rows.unionByName(err_rows)


def profile(df: DataFrame) -> DataFrame:
    """Rows and mean lengths per (split, source), with split and grand totals
    (``rollup``), plus each source's share of its split."""
    agg = (df.rollup("split", "source")
           .agg(F.count(F.lit(1)).alias("rows"),
                F.avg(F.length("input_text")).alias("avg_input_chars"),
                F.avg(F.length("target_text")).alias("avg_target_chars")))
    split_tot = agg.filter(F.col("source").isNull() & F.col("split").isNotNull()) \
        .select("split", F.col("rows").alias("split_rows"))
    return (agg.join(F.broadcast(split_tot), "split", "left")
            .withColumn("share", F.when(F.col("source").isNotNull(),
                                        F.col("rows") / F.col("split_rows")))
            .drop("split_rows"))


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet",
                text_col: str = "text", id_col: str | None = "doc_id") -> DataFrame:
    """A text corpus with an id and a text column (parquet, json or text)."""
    if fmt == "text":
        df = spark.read.text(path).withColumnRenamed("value", text_col)
        return df.withColumn("doc_id", F.monotonically_increasing_id()) if id_col else df
    return spark.read.format(fmt).load(path)

"""Bulk CSV ingestion: semicolon files, two encodings, banner
lines, repeated headers, per-state parts, drifting column names.

Every reader takes an explicit all-text schema (or the header's own names,
never type inference); types are applied afterwards with ``try_`` casts so a
bad line becomes nulls instead of a failed job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from civitas.functions._util import col
from civitas.session import plain_names

# Null spellings found in the bulk files.
NULL_TOKENS = ("", "N/A", "-", "#NULO#")


def text_schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType(), True) for n in names])


def scan_csv_bulk(spark: SparkSession, paths, schema: StructType | None = None,
                  sep: str = ";", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """``;``-separated text with an explicit all-text schema (or, when
    ``schema`` is None, the header's names as text columns).  Short lines are
    padded with nulls (PERMISSIVE)."""
    r = (spark.read.option("sep", sep).option("quote", '"').option("escape", '"')
         .option("encoding", encoding).option("header", str(header).lower())
         .option("mode", "PERMISSIVE").option("inferSchema", "false"))
    if schema is not None:
        r = r.schema(schema)
    return r.csv(paths)


def null_tokens(df: DataFrame, cols: Sequence[str] | None = None,
                tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """The reader has one ``nullValue``; the files use several spellings."""
    cols = list(cols or df.columns)
    return df.select(*[(F.when(F.trim(F.col(c)).isin(*tokens), F.lit(None))
                        .otherwise(F.col(c))).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def scan_csv_skip_banner(spark: SparkSession, paths, names: Sequence[str],
                         banner_prefix: str, sep: str = ";",
                         encoding: str = "ISO-8859-1",
                         header_values: Sequence[str] = ()) -> DataFrame:
    """Files whose first line is a banner and second the header, concatenated
    so headers may repeat mid-file: read positionally without a header, then
    drop rows that are a banner or a header (by content, not by position, so
    it does not matter how the lines were split over tasks)."""
    df = scan_csv_bulk(spark, paths, text_schema(names), sep, encoding, header=False)
    first = F.col(names[0])
    is_banner = F.coalesce(first.startswith(banner_prefix), F.lit(False))
    spellings = {names[0].upper(), *[h.upper() for h in header_values]}
    is_header = F.coalesce(F.upper(F.trim(first)).isin(*sorted(spellings)), F.lit(False))
    return df.where(~is_banner & ~is_header)


def clean_header_expr(c) -> Column:
    """Column form of ``clean_header_name`` (for header rows read as data)."""
    t = F.translate(col(c), "\ufeff", "")
    return F.upper(F.trim(F.regexp_replace(F.trim(t), '^"|"$', "")))


def scan_csv_headered(spark: SparkSession, paths, mapping: Mapping[str, Sequence[str]],
                      sep: str = ";", encoding: str = "UTF-8",
                      exclude_pattern: str | None = None) -> DataFrame:
    """scan_csv_multi_part: many files whose headers differ (BOM, quotes, renamed
    columns): ``mapping`` is target -> raw spellings, first present wins.

    A header line is a line of which the first cell is a known spelling and no
    cell but known ones repeats the mapping: at least half of the targets are
    named in it.  The first pass reads lines as text and gives one header per
    file, from which the number of columns follows; rows are then read by
    position and joined with their file's header.  A file without a known
    header fails the job with its path instead of losing its values."""
    spellings = {t: [x.upper() for x in ([r] if isinstance(r, str) else r)]
                 for t, r in mapping.items()}
    known = sorted({x for r in spellings.values() for x in r})
    need = max(1, (len(spellings) + 1) // 2)

    def header_test(cells: Column) -> Column:
        named = F.size(F.array_intersect(cells, F.array(*[F.lit(k) for k in known])))
        return F.coalesce(F.element_at(cells, 1).isin(*known) & (named >= need), F.lit(False))

    def cleaned(cells: Column) -> Column:
        return F.transform(cells, clean_header_expr)

    lines = spark.read.option("encoding", encoding).text(paths).withColumn("__file", file_path())
    if exclude_pattern:
        lines = lines.where(~F.col("__file").rlike(exclude_pattern))
    def unquoted(x: Column) -> Column:
        inner = F.replace(F.regexp_replace(x, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))
        return F.when(x.rlike(r'^\s*".*"\s*$'), inner).otherwise(x)

    # header names hold no separator
    cells = cleaned(F.transform(F.split("value", "\\Q" + sep + "\\E"), unquoted))
    headers = lines.withColumn("__hdr", cells).where(header_test(F.col("__hdr"))) \
        .groupBy("__file").agg(F.max("__hdr").alias("__hdr"))  # repeated headers are equal
    width = headers.agg(F.max(F.size("__hdr"))).first()[0] or 1

    names = [f"_c{i}" for i in range(width)]
    raw = scan_csv_bulk(spark, paths, text_schema(names), sep, encoding, header=False)
    raw = raw.withColumn("__file", file_path())
    if exclude_pattern:
        raw = raw.where(~F.col("__file").rlike(exclude_pattern))
    vals = F.array(*[F.col(n) for n in names])
    data = raw.where(~header_test(cleaned(vals))).join(headers, "__file", "left")
    found = F.coalesce("__hdr", F.raise_error(F.concat(
        F.lit("no known header in "), F.col("__file"))).cast("array<string>"))
    data = data.withColumn("__hdr", found)
    out = []
    for target, raws in spellings.items():
        at = [F.array_position("__hdr", r).cast("int") for r in raws]
        out.append(F.coalesce(*[F.when(a > 0, F.get(vals, a - 1)) for a in at]).alias(target))
    return data.select(*out, "__file")


def clean_header_name(name: str) -> str:
    return name.replace("﻿", "").strip().strip('"').strip().upper()


def bom_header_clean(df: DataFrame) -> DataFrame:
    """Strip BOM, spaces and quotes from header names, upper-case them."""
    return df.toDF(*[clean_header_name(c) for c in df.columns])


def rename_if_present(df: DataFrame, mapping: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """``target -> raw name(s)``: the first raw name present wins (list them
    newest first); absent targets are left for ``conform_schema``.  When
    several raw names are present they are coalesced in that order."""
    have = set(df.columns)
    out = []
    for target, raws in mapping.items():
        raws = [raws] if isinstance(raws, str) else list(raws)
        present = [r for r in raws if r in have]
        if present:
            out.append(F.coalesce(*[F.col(r) for r in present]).alias(target))
    return df.select(*out)


def conform_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Add missing columns as typed nulls, cast, order as the schema."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None))
                       .cast(f.dataType).alias(f.name) for f in schema.fields])


def file_path() -> Column:
    return F.col("_metadata.file_path")


def path_value(key: str, path: Column | None = None) -> Column:
    """``key=value`` folder of the file a row came from (inject_context)."""
    p = file_path() if path is None else path
    raw = F.nullif(F.regexp_extract(p, rf"{key}=([^/]+)", 1), F.lit(""))
    return F.nullif(F.url_decode(raw), F.lit("__HIVE_DEFAULT_PARTITION__"))


def exclude_files(df: DataFrame, pattern: str) -> DataFrame:
    """Skip aggregate files (e.g. ``*_BRASIL*``) by a
    predicate on the file path, evaluated before any row is parsed."""
    return df.where(~file_path().rlike(pattern))


def inject_period(df: DataFrame, year: str = "ano", from_col=None, yyyymm=None) -> DataFrame:
    """Add the period when absent: from a date column or from ``YYYYMM`` text."""
    if year in df.columns:
        return df
    if yyyymm is not None:
        return df.withColumn(year, F.left(col(yyyymm), F.lit(4)).try_cast("int"))
    return df.withColumn(year, F.year(col(from_col)))


def route_files_by_kind(readers: Mapping[str, callable]) -> DataFrame:
    """One branch per file kind (each kind has its own reader options),
    stacked with a ``kind`` label; columns may differ (diagonal union)."""
    out = None
    for kind, read in readers.items():
        part = read().withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_seed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """scan_csv_seed: small typed CSV with a header."""
    return spark.read.option("header", "true").schema(schema).csv(path)


def inspect_csv_files(spark: SparkSession, paths, sep: str = ";", encoding: str = "UTF-8",
                      min_columns: int = 2, required: Sequence[str] = (),
                      max_bad_rate: float = 0.0) -> DataFrame:
    """file, lines, columns, bad_width, undecodable, ok, reason: EVERY file of
    ``paths`` on its own, every line of it, in one pass over the text.

    The first line is the header; the other lines should have as many cells
    (separators inside quotes do not count).  ``undecodable`` lines hold bytes
    that are not text in ``encoding`` (UTF-8, or one with a byte per letter), or
    control characters.  Reasons, in this order: 'encoding', 'separator' (fewer
    than ``min_columns``), 'header' (a ``required`` name is missing), 'no rows',
    'ragged' (more than ``max_bad_rate`` of the lines).  Files without any line
    give no row here: see ``split_csv_files``."""
    # the text source hands over the file's bytes as they are
    utf8 = encoding.upper().replace("-", "") == "UTF8"
    value = F.col("value") if utf8 else F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.text(paths).select(
        value.alias("value"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    bare = F.regexp_replace("value", '"[^"]*"', "")
    odd = ~F.is_valid_utf8("value") | F.col("value").rlike("[\\x00-\\x08\\x0E-\\x1F\uFFFD]")
    # the lines of a file come down to one row per width on the map side
    widths = lines.select("file", "at", "value", F.size(F.split(bare, "\\Q" + sep + "\\E")).alias("width"),
                          odd.cast("int").alias("odd")) \
        .groupBy("file", "width").agg(
            F.count(F.lit(1)).alias("n"), F.sum("odd").alias("odd"),
            F.min(F.struct("at", F.col("value").alias("line"))).alias("first"))
    heads = widths.groupBy("file").agg(F.min(F.struct("first", "width")).alias("h")).select(
        "file", F.col("h.first.line").alias("line"), F.col("h.width").alias("columns"))
    each = widths.join(heads, "file").groupBy("file", "columns", "line").agg(
        F.sum("n").alias("lines"), F.sum("odd").alias("undecodable"),
        F.sum(F.when(F.col("width") != F.col("columns"), F.col("n")).otherwise(0)).alias("bad_width"))
    names = F.transform(F.split("line", "\\Q" + sep + "\\E"), clean_header_expr)
    need = F.array(*[F.lit(r.upper()) for r in required]).cast("array<string>")
    reason = (F.when(F.col("undecodable") > 0, "encoding")
              .when(F.col("columns") < min_columns, "separator")
              .when(F.size(F.array_except(need, names)) > 0, "header")
              .when(F.col("lines") < 2, "no rows")
              .when(F.col("bad_width") > F.lit(max_bad_rate) * F.col("lines"), "ragged"))
    return each.withColumn("reason", reason).select(
        "file", "lines", "columns", "bad_width", "undecodable", F.col("reason").isNull().alias("ok"), "reason")


def split_csv_files(spark: SparkSession, paths, **kw) -> tuple[list[str], dict[str, str]]:
    """(files fit to load, bad file -> reason) of ``inspect_csv_files``; files
    without a line are bad ('empty').  Lists of files, as every scan has them."""
    rows = inspect_csv_files(spark, paths, **kw).collect()
    seen = dict(zip(plain_names(spark, [r.file for r in rows]), [r.reason for r in rows]))
    every = plain_names(spark, spark.read.text(paths).inputFiles())
    bad = {f: seen.get(f, "empty") for f in every if seen.get(f, "empty")}
    return [f for f in every if f not in bad], bad


def schema_sniff_validate(spark: SparkSession, paths, sep: str = ";", encoding: str = "UTF-8",
                          sample_rows: int = 10, min_columns: int = 2,
                          max_corrupt_rate: float = 0.0) -> dict:
    """Bounded input check before a load: read the first ``sample_rows`` lines
    with the header's columns plus a corrupt-record column and require at
    least ``min_columns`` columns, rows present and at most
    ``max_corrupt_rate`` malformed lines; and no file of ``paths`` may be bad by
    ``inspect_csv_files`` (``bad_files``: path -> reason)."""
    head = scan_csv_bulk(spark, paths, None, sep, encoding, header=True)
    names = head.columns
    schema = text_schema(names).add("_corrupt_record", StringType())
    sample = (spark.read.option("sep", sep).option("header", "true").option("encoding", encoding)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
              .schema(schema).csv(paths).limit(sample_rows).collect())
    corrupt = sum(1 for r in sample if r["_corrupt_record"] is not None)
    rate = corrupt / len(sample) if sample else 1.0
    _, bad = split_csv_files(spark, paths, sep=sep, encoding=encoding, min_columns=min_columns,
                             max_bad_rate=max_corrupt_rate)
    ok = len(names) >= min_columns and len(sample) > 0 and rate <= max_corrupt_rate and not bad
    return {"ok": ok, "columns": len(names), "rows_sampled": len(sample), "corrupt_rate": rate,
            "bad_files": bad}

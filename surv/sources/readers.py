"""Readers.

All readers return lazy DataFrames with explicit options; no pandas, no
driver-side parsing of data.  Raw notification extracts are read as text
(all ``StringType``) so the conform step decides types (B10).
"""

from __future__ import annotations

import os
import re
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: dialect candidates and file-name patterns ----------------
CSV_DIALECTS = ((";", "iso-8859-1"), (";", "utf-8"), (",", "iso-8859-1"), (",", "utf-8"))  # latin1 = iso-8859-1
LOAD_LOG_PATTERN = r"Arquivo concluido:\s*(\d+)\s*linhas carregadas \(DENGBR(\d{2})\.json\)"
RESOURCE_YEAR_PATTERN = r"(?i)dengue[^\d]*(\d{4})"
FACILITY_FILE_PATTERN = r"(?i)BASE_DE_DADOS_CNES_(\d{6})\.ZIP$"
SOURCE_KINDS = ("api", "json", "csv", "xml")


def read_csv(spark: SparkSession, path: str | Sequence[str], encoding: str = "utf-8", sep: str = ",",
             schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header, encoding and separator; text columns unless a
    schema is given (no inference pass over the data)."""
    r = spark.read.option("header", True).option("encoding", encoding).option("sep", sep)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def header_columns(spark: SparkSession, path: str, encoding: str, sep: str) -> list[str]:
    """Column names of a CSV under one dialect (reads the header only)."""
    return read_csv(spark, path, encoding, sep).columns


def read_csv_dialect(spark: SparkSession, path: str, key_candidates: Iterable[str],
                     dialects: Sequence[tuple[str, str]] = CSV_DIALECTS) -> DataFrame:
    """Try ``;``/latin1, ``;``/utf-8, ``,``/latin1, ``,``/utf-8 and keep
    the first dialect whose header contains one of the key columns."""
    from surv.operators.conform import ascii_snake
    keys = {ascii_snake(k) for k in key_candidates}
    for sep, enc in dialects:
        cols = header_columns(spark, path, enc, sep)
        if keys & {ascii_snake(c) for c in cols}:
            return read_csv(spark, path, enc, sep)
    raise ValueError(f"no dialect exposes a key column {sorted(keys)} in {path}")


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to ``a<sep>b`` columns (recursively); arrays kept."""
    def walk(dt: T.StructType, prefix: list[str]) -> list[Column]:
        out = []
        for f in dt.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, path)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)))
        return out
    return df.select(*walk(df.schema, []))


def read_json(spark: SparkSession, path: str | Sequence[str], normalize: bool = True,
              multiline: bool = True, schema: T.StructType | str | None = None) -> DataFrame:
    """A whole JSON document (multi-line) or JSON lines, optionally
    flattened (A04).  A document's records are found by block (``json_split``),
    so one huge file is read by many tasks."""
    if multiline:
        from surv.sources.json_split import read_json_split
        df = read_json_split(spark, path, schema=schema)
    else:
        df = (spark.read.schema(schema) if schema is not None else spark.read).json(path)
    return flatten(df) if normalize else df


def json_records(df: DataFrame, envelope: str = "parametros") -> DataFrame:
    """Records of a top-level array (Spark already yields one row per
    element) or of the ``parametros`` envelope (exploded); non-object
    elements are skipped."""
    if envelope in df.columns and isinstance(df.schema[envelope].dataType, T.ArrayType):
        el = df.schema[envelope].dataType.elementType
        x = df.select(F.explode(envelope).alias("_r"))
        if isinstance(el, T.StructType):
            return x.select("_r.*")
        return x.select(F.col("_r").alias("value")).filter("false")  # no objects inside
    return df


def read_json_records(spark: SparkSession, path: str | Sequence[str], envelope: str = "parametros",
                      schema: T.StructType | str | None = None) -> DataFrame:
    """A05 from files, each read by as many tasks as it has blocks
    (``json_split``), whatever its size and wherever its line ends are."""
    from surv.sources.json_split import read_json_split
    return read_json_split(spark, path, envelope, schema)


def parse_json_column(df: DataFrame, col: str, schema: T.StructType | str | None = None,
                      prefix: str | None = None) -> DataFrame:
    """A04 on a JSON text column: parse with ``from_json`` (schema given, or
    inferred over all rows: a field of any row counts) and
    flatten the fields into ``<prefix>.<field>`` columns."""
    if schema is None:
        ddl = df.select(F.schema_of_variant_agg(F.try_parse_json(F.col(col)))).first()[0]
        # variant names to SQL types; a field that is null everywhere or mixed is text
        schema = "struct<>" if not ddl or not ddl.startswith("OBJECT<") else re.sub(
            r"\b(VOID|VARIANT)\b", "STRING", ddl.replace("OBJECT<", "STRUCT<"))
    p = prefix or col
    parsed = df.withColumn("_json", F.from_json(F.col(col), schema))
    st = parsed.schema["_json"].dataType
    others = [F.col(f"`{c}`") for c in df.columns]
    return parsed.select(*others, *[F.col(f"_json.`{f.name}`").alias(f"{p}.{f.name}") for f in st.fields])


def read_xml(spark: SparkSession, path: str | Sequence[str], row_tag: str = "row") -> DataFrame:
    """Children of each ``row_tag`` element become text columns
    (built-in XML source, no type inference; values are trimmed)."""
    return (spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False)
            .option("ignoreSurroundingSpaces", True).load(path))


def namespace_prefixes(spark: SparkSession, path: str | Sequence[str], uri: str) -> list[str]:
    """Prefixes that the documents bind to a name space ('' for the default one):
    a scan of the text cut at ``>``, so a large file is many tasks."""
    tags = spark.read.option("lineSep", ">").text(path).filter(F.col("value").contains("xmlns") & F.col("value").contains(uri))
    bound = F.regexp_extract_all("value", F.lit(r"xmlns(:[\w.-]+)?\s*=\s*[\"']" + re.escape(uri) + r"[\"']"), 1)
    return sorted(r[0].lstrip(":") for r in tags.select(F.explode(bound)).distinct().collect())


def read_xml_nodes(spark: SparkSession, path: str | Sequence[str], node_path: str, namespaces: dict[str, str] | None = None) -> DataFrame:
    """A06 by path: the child elements of every node that ``node_path`` selects.

    ``//name`` selects at any depth, ``//a/name`` below any ``a``, ``root/a/name``
    from the outermost element down.  With ``namespaces`` (prefix of the path to
    URI), a prefixed step selects the elements of that name space whatever prefix a
    document uses; without, steps compare local names.  The first step is the row
    tag of Spark's reader, which streams a file through one task, node by node: its
    memory does not grow with a document, its time does.  A file is one document."""
    steps = [x for x in node_path.lstrip(".").split("/") if x]
    if not steps:
        raise ValueError("an empty path selects nothing")

    def names(step: str) -> list[str]:
        prefix, _, local = step.rpartition(":")
        if not namespaces or not prefix:
            return [local if not namespaces else step]
        return [f"{p}:{local}" if p else local for p in namespace_prefixes(spark, path, namespaces[prefix])]

    def children(df: DataFrame, wanted: list[str]) -> list[DataFrame]:
        out = []
        for name in wanted:
            if name not in df.columns:
                continue
            kind, col = df.schema[name].dataType, F.col(f"`{name}`")
            x = df.select((F.explode(col) if isinstance(kind, T.ArrayType) else col).alias("_n")).filter("_n IS NOT NULL")
            out.append(x.select("_n.*") if isinstance(x.schema["_n"].dataType, T.StructType) else x.select(F.col("_n").alias("_VALUE")))
        return out

    read = lambda tag: (spark.read.format("xml").option("rowTag", tag).option("inferSchema", False).option("ignoreNamespace", not namespaces)
                        .option("ignoreSurroundingSpaces", True).load(path))
    found = [read(tag) for tag in names(steps[0])]
    for step in steps[1:]:
        wanted = names(step)
        found = [c for df in found for c in children(df, wanted)]
    out = None
    for df in found:
        plain = df.select(*[F.col(f"`{c}`").alias(c.rpartition(":")[2]) for c in df.columns if not c.startswith("_")])
        if plain.columns:
            out = plain if out is None else out.unionByName(plain, allowMissingColumns=True)
    return spark.createDataFrame([], "value string") if out is None else out


def read_source(spark: SparkSession, kind: str, path: str | Sequence[str], **opts) -> DataFrame:
    """Dispatch by source kind; unknown kinds are an error."""
    k = kind.lower()
    if k == "json":
        return read_json(spark, path, **opts)
    if k == "csv":
        return read_csv(spark, path, **opts)
    if k == "xml":
        return read_xml(spark, path, **opts)
    if k == "api":
        raise NotImplementedError("HTTP API sources are not built (see README)")
    raise ValueError(f"unknown source kind {kind!r}; expected one of {SOURCE_KINDS}")


def latest_snapshot(spark: SparkSession, base: str, fmt: str = "csv", **opts) -> DataFrame:
    """Rows of the greatest ``period=`` folder under ``base``.  The folder is
    chosen from the listing; no other period's files are opened."""
    from surv.sources.metadata import greatest_partition
    period = greatest_partition(spark, base, "period")
    if period is None:
        raise ValueError(f"no period=... folders under {base}")
    return spark.read.format(fmt).options(header=True, **opts).option("basePath", base).load(f"{base.rstrip('/')}/period={period}")


def read_year_range(spark: SparkSession, base: str, y0: int, y1: int, fmt: str = "parquet",
                    year_col: str = "year") -> DataFrame:
    """A10: year-partitioned files of a range; the ``BETWEEN`` on the
    partition column prunes directories before any file is opened."""
    df = spark.read.format(fmt).load(base)
    return df.filter(F.col(year_col).between(y0, y1))


def parse_load_log(lines: DataFrame, line_col: str = "value", order_col: str | Column = "line_no") -> DataFrame:
    """(year, loaded rows) from load-log lines; the last line per year
    wins, by ``order_col``."""
    o = F.col(order_col) if isinstance(order_col, str) else order_col
    x = lines.select(F.col(line_col).alias("line"), o.alias("_ord"))
    x = x.filter(F.col("line").rlike(LOAD_LOG_PATTERN))
    x = x.select(F.regexp_extract("line", LOAD_LOG_PATTERN, 1).cast("bigint").alias("rows"),
                 (F.lit(2000) + F.regexp_extract("line", LOAD_LOG_PATTERN, 2).cast("int")).alias("year"),
                 "_ord")
    return x.groupBy("year").agg(F.max_by("rows", "_ord").alias("loaded_rows"))


def decoded_text(content: Column) -> Column:
    """Text of a small file: by its byte-order mark (UTF-16 either way, UTF-8),
    else UTF-8 where it is valid, else Latin-1."""
    mark = lambda n: F.hex(F.substring(content, 1, n))
    return (F.when(mark(2) == "FFFE", F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE"))
             .when(mark(2) == "FEFF", F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE"))
             .when(mark(3) == "EFBBBF", F.decode(F.substring(content, 4, 1 << 30), "UTF-8"))
             .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
             .otherwise(F.decode(content, "ISO-8859-1")))


def read_log_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of load logs with their place: file (by modification time, then
    name) and line number.  Logs are small; each is one row before the split."""
    f = spark.read.format("binaryFile").load(path)
    x = f.select("modificationTime", "path", F.posexplode(F.split(decoded_text(F.col("content")), "\r\n|\n|\r")).alias("n", "value"))
    return x.select("value", F.struct("modificationTime", "path", "n").alias("line_no"))


def read_load_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A16 from text files in any of the encodings a log may have."""
    return parse_load_log(read_log_lines(spark, path))


def year_from_name(name: Column, pattern: str = RESOURCE_YEAR_PATTERN) -> Column:
    """Year (or period) captured from a resource / file name; NULL when
    the name does not match."""
    v = F.regexp_extract(name, pattern, 1)
    return F.when(v != "", v.cast("int"))


def with_source_file(df: DataFrame, out: str = "source_file") -> DataFrame:
    """The file each row came from (file metadata column)."""
    return df.withColumn(out, F.col("_metadata.file_path"))


def with_file_order(df: DataFrame, out: str = "file_order") -> DataFrame:
    """Place of each row of a file read: file name, start of its block, and
    row inside the block (a block is read by one task, in order), as a value
    that sorts in file order whatever partitions Spark packs together."""
    return df.select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                   F.monotonically_increasing_id().alias("row")).alias(out))


def column_set(df: DataFrame) -> set[str]:
    """The frame's column names (metadata)."""
    return set(df.columns)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Catalog table existence."""
    return spark.catalog.tableExists(name)


def relation_exists(spark: SparkSession, name_or_path: str) -> bool:
    """A catalog table/view, or a storage path."""
    if spark.catalog.tableExists(name_or_path):
        return True
    from surv.operators.cubes import path_exists
    return os.path.sep in name_or_path and path_exists(spark, name_or_path)


def run_sql(spark: SparkSession, sql: str, **params) -> DataFrame:
    """Parameterised SQL with named markers (``:name``)."""
    return spark.sql(sql, args=params)

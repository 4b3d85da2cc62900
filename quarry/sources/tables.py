"""Sources with declared schemas, and sinks. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TUPLES = "`#select` struct<tuples: array<array<string>>>"
PLACE = "file_name:string,byte_start:int,byte_end:int,line_start:int,line_end:int,column_start:int,column_end:int,is_primary:boolean,label:string"
#: How many expansions a span's chain has room for; what lies deeper comes as its text in the last one's `expansion`.
EXPANSIONS = 3


def span_type(depth: int = EXPANSIONS) -> str:
    """A span with its chain of macro expansions; the innermost keeps anything deeper as JSON text."""
    inner = f"struct<macro_decl_name:string,span:{span_type(depth - 1)},def_site_span:struct<{PLACE}>>" if depth else "string"
    return f"struct<{PLACE},expansion:{inner}>"


SPAN = span_type()
BUILD_EVENT = f"reason string, package_id string, manifest_path string, success boolean, message struct<message:string,level:string,rendered:string,code:struct<code:string,explanation:string>,spans:array<{SPAN}>,children:array<struct<message:string,level:string,spans:array<{SPAN}>>>>"

HEADERS = ("h", "hpp", "hh", "hxx")
SOURCES = {"c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tuples(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a query's JSON result file, positional strings, repeats removed."""
    rows = spark.read.schema(TUPLES).json(path, multiLine=True).select(F.explode(F.col("#select.tuples")).alias("t"))
    return rows.select(*[F.get("t", F.lit(k)).alias(c) for k, c in enumerate(columns)]).distinct()


def build_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events of newline-delimited JSON; strict fails on a malformed line, else it's null."""
    return spark.read.schema(BUILD_EVENT).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ftype, language) of headers and sources below a folder; only their listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    language = F.coalesce(*[F.when(suffix == s, F.lit(x)) for s, x in SOURCES.items()], F.when(suffix == "h", "unknown").when(suffix.isin(*HEADERS), "cpp"))
    return files.select("path", F.when(suffix.isin(*HEADERS), "Header").otherwise("Source").alias("ftype"), language.alias("language")).where("language is not null")


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), start, end - start + 1), "\n")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def build_script(files: DataFrame, command: str = "clang -c") -> DataFrame:
    """(path, line): a command for each file with its distinct include folders; files: path, include_dir."""
    dirs = F.array_sort(F.collect_set("include_dir"))
    flags = F.array_join(F.transform(dirs, lambda d: F.concat(F.lit("-I"), d)), " ")
    return files.groupBy("path").agg(F.trim(F.concat_ws(" ", F.lit(command), flags, F.col("path"))).alias("line"))

"""Sources and sinks: CSV with and without index column, JSON per binary, word lists, text corpora, binaries on disk, repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, index_column: bool = False) -> DataFrame:
    """CSV files with a header each, one behind the other. With index_column, a first column without a name is dropped. Lines that repeat the header
    inside a file, and lines that do not fit the schema, are left out."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = T.StructType([*([T.StructField("_index", T.StringType())] if index_column else []), *(T.StructField(f.name, T.StringType()) for f in schema.fields)])
    rows = spark.read.schema(text).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(paths)
    repeated = F.lit(True)
    for f in schema.fields:
        repeated = repeated & F.equal_null(F.col(f.name), F.lit(f.name))
    return rows.where(~repeated).select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields))


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of CSV files with one header each; appending adds files and never repeats a header inside one."""
    df.write.mode("append" if append else "errorifexists").option("header", True).option("escape", '"').options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def without_header_rows(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Rows whose `column` is the column's own name are headers that were read as data."""
    return df.where(~F.equal_null(F.trim(column), F.lit(name or column)))


def read_functions_json(spark: SparkSession, path: str) -> DataFrame:
    """idb_path, arch, fva, function (VARIANT) of a folder of JSON files, one object {binary: {arch, fva: {...}}} each; a file with
    several binaries gives all of them. Files that are not complete JSON give nothing."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.expr("try_parse_json(value)").alias("v")).where("v is not null")
    files.createOrReplaceTempView("__json_files")
    binaries = spark.sql("SELECT b.key AS idb_path, b.value AS v FROM __json_files, LATERAL variant_explode(v) b")
    binaries.createOrReplaceTempView("__json_binaries")
    return spark.sql("SELECT idb_path, try_variant_get(v, '$.arch', 'string') AS arch, f.key AS fva, f.value AS function FROM __json_binaries, LATERAL variant_explode(v) f WHERE f.key <> 'arch'")


def read_selection(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """idb_path, address of JSON files {binary: [addresses]}; with `lines`, of files with such an object on each line, as `selection_json` gives them."""
    spark.read.text(path, wholetext=not lines).select(F.from_json("value", "map<string,array<bigint>>").alias("m")).createOrReplaceTempView("__selection")
    return spark.sql("SELECT idb_path, explode(addresses) AS address FROM (SELECT explode(m) AS (idb_path, addresses) FROM __selection)")


def selection_json(df: DataFrame, path: str = "idb_path", address: str = "address") -> DataFrame:
    """One JSON text {binary: [addresses]} per binary, as a sink of text lines; a binary's addresses are sorted and distinct."""
    grouped = df.groupBy(path).agg(F.array_sort(F.collect_set(address)).alias("a"))
    return grouped.select(F.to_json(F.map_from_arrays(F.array(path), F.array("a"))).alias("value"))


def write_corpus(df: DataFrame, tokens: str, path: str) -> None:
    """A text file with one function per line, tokens parted by blanks."""
    df.select(F.array_join(tokens, " ").alias("value")).write.text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word of a text file with one per line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def write_words(df: DataFrame, path: str, column: str = "word") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, vector of an embedding matrix kept as Parquet."""
    return spark.read.parquet(path).select("id", F.col("vector").cast("array<float>").alias("vector"))


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("id", F.col("vector").cast("array<float>").alias("vector")).write.parquet(path)


def files_below(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, sha256 of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def from_file(ending: str) -> Column:
    """Whether a row comes from a file whose name ends so."""
    return F.col("_metadata.file_name").endswith(ending)


def pending(requested: DataFrame, done: DataFrame, keys: list[str], retry: Column | None = None) -> DataFrame:
    """Requested work without a result. Results for which `retry` holds do not count as done."""
    return requested.join((done if retry is None else done.where(~retry)).select(*keys).distinct(), keys, "left_anti")


def selection_total(selection: DataFrame) -> DataFrame:
    """binaries, functions: how many functions a selection (idb_path, address) names, in how many binaries."""
    return selection.agg(F.count_distinct("idb_path").alias("binaries"), F.count("*").alias("functions"))

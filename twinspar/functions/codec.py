"""Arrays, sparse matrices and histograms as delimited text and back; hexadecimal, base64, bytes and hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(text: Column, sep: str = ";", kind: str = "bigint") -> Column:
    """The numbers of a delimited list; empty parts are left out, null stays null."""
    return F.transform(F.filter(F.split(text, sep), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast(kind))


def joined(values: Column, sep: str = ";") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


def histogram(text: Column) -> Column:
    """`bucket:count;...` as a map of numbers."""
    return F.map_from_entries(F.transform(F.filter(F.split(text, ";"), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("int"), F.split_part(x, F.lit(":"), F.lit(2)).cast("bigint"))))


def histogram_text(counts: Column) -> Column:
    """A map of numbers as `bucket:count;...`, in order of buckets."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ";")


def coo_text(rows: Column, cols: Column, values: Column, n_row: Column, n_col: Column) -> Column:
    """A sparse matrix as `r;r::c;c::v;v::rows::columns`."""
    return F.concat_ws("::", joined(rows), joined(cols), joined(values), n_row.cast("string"), n_col.cast("string"))


def coo(text: Column) -> Column:
    """The struct of a sparse matrix text. An empty matrix stays empty; see `identity_if_empty`."""
    p = lambda i: F.split_part(text, F.lit("::"), F.lit(i))
    return F.struct(numbers(p(1)).alias("rows"), numbers(p(2)).alias("cols"), numbers(p(3)).alias("vals"), p(4).try_cast("int").alias("n_row"), p(5).try_cast("int").alias("n_col"))


def identity_if_empty(matrix: Column) -> Column:
    """An adjacency matrix without entries counts as the identity."""
    n = F.greatest(matrix["n_col"], F.lit(0))
    diagonal = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array()).cast("array<bigint>")
    empty = F.size(matrix["rows"]) == 0
    one = F.transform(diagonal, lambda _: F.lit(1).cast("bigint"))
    return F.struct(F.when(empty, diagonal).otherwise(matrix["rows"]).alias("rows"), F.when(empty, diagonal).otherwise(matrix["cols"]).alias("cols"), F.when(empty, one).otherwise(matrix["vals"]).alias("vals"), matrix["n_row"].alias("n_row"), matrix["n_col"].alias("n_col"))


def block_rows(text: Column) -> Column:
    """`a;b::c` as an array of arrays of numbers, one for each block."""
    return F.transform(F.split(text, "::"), lambda b: numbers(b))


def block_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, joined), "::")


def hex_text(number: Column) -> Column:
    """0x and lower-case hexadecimal digits."""
    return F.concat(F.lit("0x"), F.lower(F.hex(number)))


def strand_bucket(expression: Column, bits: int = 10) -> Column:
    """The bucket of an expression's text: the first two bytes of its MD5, the second being the higher one, cut to `bits`."""
    m = F.md5(expression)
    return F.conv(F.concat(F.substring(m, 3, 2), F.substring(m, 1, 2)), 16, 10).cast("int").bitwiseAND((1 << bits) - 1)


def as_int8(count: Column) -> Column:
    """A count as an 8-bit signed number holds it, wrapping around."""
    return (F.pmod(count + 128, F.lit(256)) - 128).cast("smallint")


def base64_text(data: Column) -> Column:
    """Bytes as base64 on one line, as exports hold them; the inverse of `unbase64`."""
    return F.regexp_replace(F.base64(data), r"\s", "")

"""What a symbol name, a path, a split label, a digest or an address stands for, as built-in column expressions.

All of them return null for null input and never raise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What tools put before and after a source-level name.
_PREFIXES = r"^(?:\.|j_|__imp_|thunk_|_(?!ZL?[\dN]))+"
_SUFFIXES = r"(?:\.(?:cold|isra|constprop|part|lto_priv|llvm|clone)(?:\.\d+)*|\.\d+|@plt|@{1,2}[A-Za-z_][A-Za-z0-9_.]*)+$"
_MADE_UP = (
    r"^_*(?:sub|FUN|fcn|fun|loc|locret|nullsub|off|unk|byte|unknown_libname|func|thunk_FUN|case|j_sub)"
    r"[_.](?:[0-9A-F]+|[0-9a-f]*[0-9][0-9a-f]*)(?:_\d+)?" + _SUFFIXES[:-2] + "*$"
)
_COUNTER = r"_\d{1,2}$"
# Spellings of the three splits.
SPLITS = {"train": "training", "training": "training", "val": "validation", "valid": "validation", "validation": "validation", "dev": "validation", "test": "testing", "testing": "testing"}


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def source_name(name: Column) -> Column:
    """The source-level name: without thunk, import, versioning, clone and duplicate marks and without C++ mangling.

    Scopes of C++ stay, joined by '::'; constructors, operators and templates, whose names no length introduces, stay mangled. Null for null or
    empty names and for placeholder names that a disassembler made up (`sub_4010`, `fcn.00401390`, ...). A placeholder is told by
    the name as it is, before any suffix goes: the digits of `fcn.00401390` are no suffix.
    """
    whole = F.regexp_replace(_trim(name), _PREFIXES, "")
    bare = F.regexp_replace(whole, _SUFFIXES, "")
    inner = F.when(~bare.startswith("_Z"), bare).when(bare.startswith("_ZN"), _scoped(bare)).otherwise(F.coalesce(_counted(F.regexp_replace(bare, "^_ZL?(?=\\d)", "\u0001"))["word"], bare))
    inner = F.regexp_replace(inner, _PREFIXES, "")
    out = F.regexp_replace(inner, _COUNTER, "")
    return F.when(whole.rlike(_MADE_UP) | inner.rlike(_MADE_UP) | (out == ""), F.lit(None).cast("string")).otherwise(out)


def _counted(text: Column) -> Column:
    """word and rest of a text that goes on with \\u0001, a length and so many characters (or what is left of them); a null word if it does not."""
    digits = F.regexp_extract(text, r"^\u0001(\d{1,4})", 1)
    n = digits.try_cast("int")
    there = (n > 0) & (F.length(text) > F.length(digits) + 1)
    return F.struct(F.when(there, F.substr(text, F.length(digits) + 2, n)).alias("word"), F.when(there, F.substr(text, F.length(digits) + 2 + n)).alias("rest"))


def _scoped(bare: Column) -> Column:
    """`a::b` of `_ZN1a1bE...`; the name as it is if one of its parts has no length before it."""
    start = F.struct(F.array().cast("array<string>").alias("words"), F.regexp_replace(bare, "^_ZN[rVK]*", "").alias("rest"))

    def step(state: Column, _: Column) -> Column:
        one = _counted(F.concat(F.lit("\u0001"), state["rest"]))
        return F.when(one["word"].isNull(), state).otherwise(F.struct(F.concat(state["words"], F.array(one["word"])).alias("words"), one["rest"].alias("rest")))

    end = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(bare), F.lit(1))), start, step)
    return F.when(end["rest"].startswith("E") & (F.size(end["words"]) > 0), F.array_join(end["words"], "::")).otherwise(bare)


def clean_path(path: Column) -> Column:
    """A path with '/' between parts, no doubled '/' and no outer white space."""
    return F.regexp_replace(F.translate(_trim(path), "\\", "/"), "/+", "/")


def project_of(path: Column) -> Column:
    """The project of a binary, in lower case: the folder below Dataset-1 or Dataset-Vulnerability, or in Dataset-2
    the first word of `<project>-<version>-<opt>` in the file name. Null where the path has neither form."""
    p = F.lower(clean_path(path))
    folder = F.regexp_extract(p, r"(?:^|/)dataset-(?:1|vulnerability)/([^/]+)/", 1)
    word = F.regexp_extract(p, r"(?:^|/)dataset-2/[^/_]*_([^/_-]+)-", 1)
    return F.when(folder != "", folder).when(word != "", word)


def dataset_of(path: Column) -> Column:
    """The dataset named in a path (`Dataset-1`, ...), in its usual spelling; null where there is none."""
    d = F.regexp_extract(clean_path(path), r"(?i)(?:^|/)dataset-(1|2|vulnerability)(?:/|$)", 1)
    return F.when(d != "", F.concat(F.lit("Dataset-"), F.initcap(d)))


def split_of(label: Column) -> Column:
    """training, validation or testing for any known spelling, else null."""
    known = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    return F.try_element_at(known, F.lower(_trim(label)))


def digest_of(digest: Column) -> Column:
    """A SHA-256 digest as 64 lower-case hexadecimal characters; null if it is none."""
    d = F.regexp_replace(F.lower(_trim(digest)), r"^(?:sha-?256:|0x)", "")
    return F.when(d.rlike("^[0-9a-f]{64}$"), d)


def hex_number(text: Column) -> Column:
    """The number of hexadecimal text with or without 0x, as BIGINT (two's complement above 2^63); null if it is none."""
    t = F.regexp_replace(F.lower(_trim(text)), "^0x", "")
    return F.when(t.rlike("^[0-9a-f]{1,16}$"), F.conv(t, 16, -10).try_cast("bigint"))

"""Variables that are spelled out in file paths and labels, as built-in column expressions.

Parts that are missing give null; nothing raises unless it is said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import clean_path

#: The variables of a compiled function, in the order in which tasks speak of them.
VARIABLES = ("project", "library", "arch", "bit", "compiler", "version", "optimizations")


def part(c: Column, sep: str, i: int) -> Column:
    """The i-th part (from 0; from the end if negative), null if there is none."""
    return F.try_element_at(F.split(c, sep), F.lit(i + 1 if i >= 0 else i))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(?:i64|idb)$", "")


def variables_folder_scheme(path: Column) -> dict[str, Column]:
    """`.../<project>/<arch>-<compiler>-<version>-<opt>_<library>.i64`. The library is the second word at '_'; 'x86' and '32' mean 32 bits;
    gcc versions are told apart from clang's by `gcc_`."""
    p = clean_path(path)
    name = part(p, "/", -1)
    build = part(name, "_", 0)
    arch, compiler, version = part(build, "-", 0), part(build, "-", 1), part(build, "-", 2)
    return {
        "project": part(p, "/", -2),
        "library": without_extension(part(name, "_", 1)),
        "arch": F.regexp_replace(arch, "32|64|86", ""),
        "bit": F.when(F.regexp_replace(arch, "86", "32").contains("32"), "32").otherwise("64"),
        "compiler": compiler,
        "version": F.when(compiler == "gcc", F.concat(F.lit("gcc_"), version)).otherwise(version),
        "optimizations": part(build, "-", 3),
    }


def variables_file_scheme(path: Column) -> dict[str, Column]:
    """`.../<arch>-<bit>_<project>-<version>-<opt>_<name>.i64`; one compiler built all of them."""
    name = part(clean_path(path), "/", -1)
    machine, build = part(name, "_", 0), part(name, "_", 1)
    words = F.split(build, "-")
    return {
        "project": F.get(words, F.lit(0)),
        "library": F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), "-"),
        "arch": part(machine, "-", 0),
        "bit": part(machine, "-", 1),
        "compiler": F.lit("gcc"),
        "version": F.lit("7.5"),
        "optimizations": F.try_element_at(words, F.lit(-1)),
    }


def variables(path: Column) -> dict[str, Column]:
    """The variables in whichever scheme the dataset of the path has."""
    flat = F.lower(clean_path(path)).rlike("(?:^|/)dataset-2/")
    a, b = variables_folder_scheme(path), variables_file_scheme(path)
    return {k: F.when(flat, b[k]).otherwise(a[k]) for k in VARIABLES}


def side_file(path: Column, suffix: str, folder: str) -> Column:
    """The name of a file that goes with a binary: its base name with another ending in another folder."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), without_extension(part(clean_path(path), "/", -1)), F.lit(suffix))


def arch_suffix(path: Column) -> Column:
    """What stands between the last '_' and the following '.' of a name such as `libcrypto_arm32.i64`."""
    return part(part(path, "_", -1), r"\.", 0)


def machine(processor: Column, bits: Column) -> Column:
    """`x86-64`, `arm-32`, ... of a processor's name and width; null for an unknown processor."""
    p = F.lower(processor)
    family = F.when(p.rlike("^(?:metapc|x86|pc|80|i[3-6]86)"), "x86").when(p.startswith("arm") | p.startswith("aarch"), "arm").when(p.startswith("mips"), "mips")
    return F.when(family.isNotNull() & bits.isin(32, 64), F.concat_ws("-", family, bits.cast("string")))


def trace_machine(name: Column) -> Column:
    """The name of a machine in traces: the family, and for x86 the width (x86, x64). Raises for an unknown one."""
    family = part(name, "-", 0)
    known = name.isin("arm-32", "arm-64", "mips-32", "mips-64", "x86-32", "x86-64")
    return F.when(name == "x86-64", "x64").when(known, family).otherwise(F.raise_error(F.concat(F.lit("unknown machine "), F.coalesce(name, F.lit("null")))))


def renamed(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """A chain of literal replacements, in order."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text

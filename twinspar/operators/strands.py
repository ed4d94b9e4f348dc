"""Strands: the expressions that a block computes, by backward slices of its statements.

A statement writes `out` by `op` on `args`; `effect` marks what is visible outside (a register that is kept, a store, an exit). The strand of an effect is its whole
expression over the block's inputs. Names of inputs are replaced by their order of first use, and two inputs of a commutative operation
are put in order, so equal computations on other registers give the same text. A block of any length is sliced once: values are texts that are
built as statements go by; a text that would pass `longest` characters is replaced by a digest that does not depend on the names of its inputs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .graph import per_graph

# Operations whose two operands may change places.
COMMUTATIVE = frozenset("add and or xor mul imul eor orr test xchg".split())
_NUMBER = re.compile(r"-?(?:0x[0-9a-fA-F]+|[0-9]+)")
_INPUT = re.compile(r"\bin:[^\s(),]+")


def strands_of(statements: list, longest: int = 4000) -> Iterator[str]:
    """The strand texts of a block, in order of its effects."""
    value: dict[str, str] = {}
    out = []
    for s in statements or []:
        if not s or not s["op"]:
            continue
        args = []
        for a in s["args"] or []:
            if a is not None:
                args.append(value.get(a, a if _NUMBER.fullmatch(a) else f"in:{a}"))
        if s["op"] in COMMUTATIVE and len(args) == 2 and all("(" not in a for a in args):
            args.sort()
        text = f"{s['op']}({','.join(args)})"
        if len(text) > longest:
            text = _digest(text)
        if s["out"] is not None:
            value[s["out"]] = text
        if s["effect"]:
            out.append(text)
    for text in out:
        names: dict[str, str] = {}
        yield _INPUT.sub(lambda m, n=names: n.setdefault(m.group(), f"r{len(n)}"), text)


def _digest(text: str) -> str:
    """A short text for a long one: the digest of its form with numbered inputs, and these inputs in order. Equal computations over renamed inputs keep equal forms."""
    names: dict[str, str] = {}
    form = _INPUT.sub(lambda m: names.setdefault(m.group(), f"r{len(names)}"), text)
    return f"d{hashlib.md5(form.encode()).hexdigest()}({','.join(names)})"


def strands(df: DataFrame, key: str, statements: str) -> DataFrame:
    """key, strand of every effect. statements: ARRAY<STRUCT<out STRING, op STRING, args ARRAY<STRING>, effect BOOLEAN>>."""

    def compute(rows: list) -> Iterator[tuple]:
        for t in strands_of(rows):
            yield (t,)

    return per_graph_text(df, key, compute, statements)


def per_graph_text(df: DataFrame, key: str, compute, column: str) -> DataFrame:  # noqa: ANN001
    from pyspark.sql import functions as F

    packed = per_graph(df, key, lambda rows: [([t for (t,) in compute(rows)],)], [("strands", "array<string>")], (column,))
    return packed.select(key, F.explode("strands").alias("strand"))

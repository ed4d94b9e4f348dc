"""Instructions as tokens: splitting, generalising, positions, operands in normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters at which an instruction's text is split.
SPLIT_AT = r"[#,{}+\-*\\\[\]:()\s]"


def plain_tokens(instruction: Column) -> Column:
    """The lower-case parts between punctuation and white space."""
    return F.filter(F.split(F.lower(instruction), SPLIT_AT), lambda x: x != "")


def trace_tokens(instruction: Column) -> Column:
    """Words and punctuation marks as tokens of their own; '#' and '$' go, a minus stands apart from its number."""
    t = F.regexp_replace(instruction, r"([,\[\]:*(){}!])", " $1 ")
    t = F.regexp_replace(F.regexp_replace(t, r"[#$]", ""), r"-([0-9a-fA-F]+)", "- $1")
    return F.filter(F.split(t, r"\s+"), lambda x: x != "")


def general(token: Column) -> Column:
    """hexvar for anything with 0x, num for digits, else the token in lower case."""
    t = F.lower(token)
    return F.when(t.contains("0x"), "hexvar").when(t.rlike("^[0-9]+$"), "num").otherwise(t)


def trace(instructions: Column, most: int = 512) -> Column:
    """STRUCT of three arrays, cut to `most` tokens: general tokens, the instruction of each, and its place in the instruction."""
    split = F.transform(instructions, lambda i, n: F.transform(trace_tokens(i), lambda t, k: F.struct(general(t).alias("code"), n.alias("inst"), k.alias("pos"))))
    rows = F.slice(F.flatten(split), 1, most)
    return F.struct(*(F.transform(rows, _field(f)).alias(f) for f in ("code", "inst", "pos")))


def _field(name: str):  # noqa: ANN202
    return lambda r: r[name]


def cut_and_padded(ids: Column, width: int) -> Column:
    """The first `width` numbers, filled up with zeros."""
    kept = F.slice(ids, 1, width)
    return F.concat(kept, F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size(kept)))


def capped_size(ids: Column, most: int) -> Column:
    return F.least(F.size(ids), F.lit(most))


def immediate(operand: Column) -> Column:
    """The hexadecimal immediate of an operand `#0x..` or `#-0x..`, null for any other operand."""
    digits = F.regexp_extract(operand, r"^#-?0[xX]([0-9a-fA-F]{1,16})$", 1)
    value = F.conv(F.when(digits != "", digits), 16, -10).try_cast("bigint")
    return F.when(operand.startswith("#-"), -value).otherwise(value)


def immediates(instruction: Column) -> Column:
    """The immediate operands of an instruction's text, in order: numbers that are operands of their own, in decimal or hexadecimal, with or without '#'
    and a minus. What stands in brackets or braces, or before a bracket, is no immediate. Null for null."""
    operands = F.regexp_replace(F.regexp_replace(F.lower(instruction), r"^\s*\S+\s*", ""), r"-?[0-9a-fx]*\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", "?")
    words = F.transform(F.split(operands, ","), lambda x: F.regexp_replace(F.trim(x), "^#", ""))
    found = F.filter(words, lambda x: x.rlike("^-?(?:0x[0-9a-f]{1,16}|[0-9]{1,18})$"))

    def value(x: Column) -> Column:
        digits = F.regexp_replace(x, "^-", "")
        n = F.when(digits.startswith("0x"), F.conv(F.substring(digits, 3, 16), 16, -10)).otherwise(digits).try_cast("bigint")
        return F.when(x.startswith("-"), -n).otherwise(n)

    return F.transform(found, value)


def small_immediates(values: Column, most: int = 4096) -> Column:
    """Immediates that are no addresses: at most `most`, negative ones included."""
    return F.filter(values, lambda x: x <= most)


def operand_text(kind: Column, register: Column, number: Column, base: Column, scale: Column, limit: int = 5000) -> Column:
    """An operand in normal form. kind: 'reg', 'imm' or 'mem'.

    Registers by name; immediates in hexadecimal if within the limit, else HIMM; memory as [base+d] or [base*scale+d] with any displacement, [MEM] without a base.
    """
    magnitude = F.concat(F.when(number < 0, "-0x").otherwise("0x"), F.lower(F.hex(F.abs(number))))
    memory = F.concat(F.lit("["), base, F.when(scale > 1, F.concat(F.lit("*"), scale.cast("string"))).otherwise(""), F.lit("+"), F.coalesce(number, F.lit(0)).cast("string"), F.lit("]"))
    memory = F.replace(memory, F.lit("+-"), F.lit("-"))
    return F.when(kind == "reg", register).when((kind == "imm") & (F.abs(number) <= limit), magnitude).when(kind == "imm", "HIMM").when(base.isNull(), "[MEM]").otherwise(memory)


def _number(sign: Column, digits: Column) -> Column:
    n = F.when(digits.startswith("0x"), F.conv(F.substring(digits, 3, 16), 16, -10)).otherwise(digits).try_cast("bigint")
    return F.when(sign == "-", -n).otherwise(n)


def normalised(instruction: Column, limit: int = 5000) -> Column:
    """A disassembled instruction in one word, its operands in the normal form of `operand_text`. Sizes before memory operands go; an operand of any other form stays as it is. Null for null."""
    text = F.trim(F.regexp_replace(F.lower(instruction), r"\b(?:byte|[dqtxyz]?(?:mm)?word|tbyte) ptr ", ""))

    def operand(part: Column) -> Column:
        get = lambda pattern, i: F.regexp_extract(part, pattern, i)
        memory = r"^(.*?)\[(\w+)(?:\*(\d+))?(?:\s*([+-])\s*(0x[0-9a-f]+|\d+))?\]$"
        nowhere = r"^(.*?)\[(?:0x[0-9a-f]+|\d+)\]$"
        plain = r"^(.*?\s|)#?(-?)(0x[0-9a-f]{1,16}|\d{1,18})$"
        m = operand_text(F.lit("mem"), F.lit(None).cast("string"), F.coalesce(_number(get(memory, 4), get(memory, 5)), F.lit(0).cast("bigint")), get(memory, 2), F.coalesce(get(memory, 3).try_cast("int"), F.lit(1)))
        i = operand_text(F.lit("imm"), F.lit(None).cast("string"), _number(get(plain, 2), get(plain, 3)), F.lit(None).cast("string"), F.lit(1), limit)
        return F.when(part.rlike(nowhere), F.concat(get(nowhere, 1), F.lit("[MEM]"))).when(part.rlike(memory), F.concat(get(memory, 1), m)).when(part.rlike(plain), F.concat(get(plain, 1), i)).otherwise(part)

    parts = F.transform(F.split(text, r",\s*"), operand)
    return F.lower(F.regexp_replace(F.array_join(parts, ", "), r"\s", "_"))


def instruction_text(mnemonic: Column, operands: Column) -> Column:
    """A mnemonic and its operands in one word: lower case, operands parted by `,_`."""
    return F.lower(F.replace(F.concat_ws(" ", mnemonic, F.when(F.size(operands) > 0, F.array_join(operands, ", "))), F.lit(" "), F.lit("_")))

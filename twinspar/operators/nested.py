"""Deeply nested records to related flat tables, by Arrow buffers.

A list column is three buffers: validity, offsets and child values. Its child table is those values as they
lie; the keys of the parents are taken by a parent index that comes from the offsets. No row is visited, at
any depth, and nothing is shuffled: each task turns its own record batches into child batches.

`flatten` does this for one path of a schema, `related_tables` for all paths. `shred_functions` turns JSON
payloads of disassembler exports, whose layouts differ, into one nested Arrow type, so that the same kernels apply.

Defined results. Null and empty lists or maps have no children. A null element gives a child row of nulls. Rows
come out once per element, repeated elements too. An empty input gives an empty table of the same schema. Texts
have no length limit. Child fields that would have the name of a key or ordinal get a trailing underscore.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- kernels ---------------------------------------------------------------------------------------------------


def as_list(array: pa.Array) -> pa.Array:
    """A map as the list of structs (key, value) that it is; lists as they are."""
    if not pa.types.is_map(array.type):
        return array
    entries = pa.StructArray.from_arrays([array.keys, array.items], names=["key", "value"])
    return pa.ListArray.from_arrays(array.offsets, entries, mask=array.is_null() if array.null_count else None) if not array.offset else pa.ListArray.from_arrays(pa.array(array.offsets), entries)


def child_index(array: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The child values of a list array, and the parent row and the ordinal of each."""
    offsets = np.asarray(array.offsets)
    sizes = np.diff(offsets)
    if array.null_count:
        sizes = np.where(np.asarray(array.is_valid()), sizes, 0)
    parent = np.repeat(np.arange(len(array)), sizes)
    first = np.cumsum(sizes) - sizes
    ordinal = np.arange(len(parent)) - np.repeat(first, sizes)
    take = np.repeat(offsets[:-1], sizes) + ordinal
    values = array.values
    whole = len(take) == len(values) and (not len(take) or (take[0] == 0 and take[-1] == len(values) - 1))
    return (values if whole else values.take(pa.array(take))), parent, ordinal


def _field(array: pa.Array, name: str) -> pa.Array:
    """A struct's field, null where the struct is null."""
    return array.flatten()[array.type.get_field_index(name)]


def descend(batch: pa.RecordBatch, keys: list[str], path: list[str]) -> tuple[pa.Array, list[pa.Array], list[np.ndarray]]:
    """The elements at `path`, the keys taken down to them, and the ordinals at each list on the way."""
    here: pa.Array = batch.column(batch.schema.get_field_index(path[0]))
    taken = [batch.column(batch.schema.get_field_index(k)) for k in keys]
    ordinals: list[np.ndarray] = []
    rest = path[1:]
    while True:
        while pa.types.is_list(here.type) or pa.types.is_map(here.type):
            here, parent, ordinal = child_index(as_list(here))
            taken = [k.take(pa.array(parent)) for k in taken]
            ordinals = [o[parent] for o in ordinals] + [ordinal]
        if not rest:
            return here, taken, ordinals
        here, rest = _field(here, rest[0]), rest[1:]


# --- one path ----------------------------------------------------------------------------------------------------


def _walk(kind: T.DataType, path: list[str]) -> tuple[T.DataType, int]:
    """The element type at the end of a path below a column of type `kind`, and the number of lists passed."""
    depth, rest = 0, list(path)
    while True:
        while isinstance(kind, T.ArrayType | T.MapType):
            depth += 1
            kind = kind.elementType if isinstance(kind, T.ArrayType) else T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        if not rest:
            return kind, depth
        if not isinstance(kind, T.StructType) or rest[0] not in kind.fieldNames():
            raise ValueError(f"no field {rest[0]!r} in {kind.simpleString()}")
        kind, rest = kind[rest[0]].dataType, rest[1:]


def _flat_fields(kind: T.DataType) -> list[tuple[str, list[str], T.DataType]]:
    """Name, steps and type of the scalars of an element that are not inside a further list."""
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                out += [(f"{f.name}_{n}" if n else f.name, [f.name, *s], t) for n, s, t in _flat_fields(f.dataType)]
            elif not isinstance(f.dataType, T.ArrayType | T.MapType):
                out.append((f.name, [f.name], f.dataType))
        return out
    return [("value", [], kind)]


def _unclash(names: list[str], taken: set[str]) -> list[str]:
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def flatten(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """One row for each element at `path` (dots between steps): `keys`, an ordinal for each list on the way
    (`pos_1`, `pos_2`, ...), and the element's scalars, structs in it spread out. Maps count as lists of (key, value).

    The ordinals of a child begin with those of its parent, so (keys, pos_1..pos_n) joins to (keys, pos_1..pos_n-1).
    """
    steps = path.split(".")
    kind, depth = _walk(df.schema[steps[0]].dataType, steps[1:])
    if not depth:
        raise ValueError(f"{path} is in no list")
    fields = _flat_fields(kind)
    names = _unclash([*keys, *(f"pos_{i + 1}" for i in range(depth)), *(n for n, _, _ in fields)], set())
    types = [df.schema[k].dataType for k in keys] + [T.LongType()] * depth + [t for _, _, t in fields]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
    field_steps = [s for _, s, _ in fields]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            element, taken, ordinals = descend(batch, keys, steps)
            columns = taken + [pa.array(o, pa.int64()) for o in ordinals]
            for s in field_steps:
                leaf = element
                for step in s:
                    leaf = _field(leaf, step)
                columns.append(leaf)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*dict.fromkeys([*keys, steps[0]])).mapInArrow(kernel, schema)


def list_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All paths of a schema that end in a list or map, parents first."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in list_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return [at, *_below(kind.elementType, at)]
    if isinstance(kind, T.MapType):
        return [at, *list_paths(kind.valueType, f"{at}.value")]
    return []


def _below(kind: T.DataType, at: str) -> list[str]:
    return [p for p in list_paths(kind, at) if p != at]


def related_tables(df: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The flat table of each list in the schema, by its path, and at "" the records' own scalars.

    `keys` must name a record; every child table holds them and the ordinals of its parents.
    """
    flat = [(n, s) for n, s, t in _flat_fields(df.schema) if n not in keys]
    names = _unclash([n for n, _ in flat], {k.lower() for k in keys})
    top = df.select(*keys, *[F.col(".".join(f"`{x}`" for x in s)).alias(n) for n, (_, s) in zip(names, flat, strict=True)])
    return {"": top} | {p: flatten(df, keys, p) for p in list_paths(df.schema) if p.split(".")[0] not in keys}


# --- payloads of disassembler exports ------------------------------------------------------------------------------

_I64 = 1 << 64


def _address(x: object) -> int | None:
    """An address written as a number, decimal text or hexadecimal text with 0x; two's complement above 2^63."""
    if isinstance(x, str):
        t = x.strip().lower().replace("_", "")
        try:
            x = int(t, 16) if t.startswith("0x") else int(t)
        except ValueError:
            try:
                x = int(t.removesuffix("h"), 16)
            except ValueError:
                return None
    elif isinstance(x, float):
        x = int(x) if x.is_integer() else None
    if not isinstance(x, int) or isinstance(x, bool) or not -(1 << 63) <= x < _I64:
        return None
    return x - _I64 if x >= 1 << 63 else x


def _items(x: object) -> list:
    return x if isinstance(x, list) else []


def _pairs(x: object) -> list[tuple]:
    """Edges as pairs: [[src, dst]], [{src, dst}] or {src: [dst]}."""
    if isinstance(x, dict):
        return [(s, d) for s, ds in x.items() for d in (ds if isinstance(ds, list) else [ds])]
    out = []
    for e in _items(x):
        if isinstance(e, dict):
            out.append((e.get("src"), e.get("dst")))
        elif isinstance(e, list) and len(e) >= 2:
            out.append((e[0], e[1]))
    return out


def _gather(f: dict, nodes: list, edges: list, blocks: list) -> None:
    """Nodes, edges and blocks of a function or a chunk of it, and of the chunks inside, without recursion."""
    todo = [f]
    while todo:
        part = todo.pop()
        for n in _items(part.get("nodes")):
            if isinstance(n, dict):
                at = n.get("addr", n.get("id"))
                nodes.append(at)
                block = n.get("block")
                block = block if isinstance(block, dict) else n
                if any(k.startswith("bb_") for k in block):
                    blocks.append((at, block))
                edges.extend((at, d) for d in _items(n.get("succ")))
            else:
                nodes.append(n)
        edges.extend(_pairs(part.get("edges")))
        listed = part.get("basic_blocks")
        if isinstance(listed, dict):
            blocks.extend((a, b) for a, b in listed.items() if isinstance(b, dict))
        todo.extend(c for c in _items(part.get("chunks")) if isinstance(c, dict))


def _functions(record: object) -> Iterator[tuple[str | None, str | None, object, dict]]:
    """Path, architecture, address and body of each function of a payload, in any of the four layouts."""
    if not isinstance(record, dict):
        return
    if "functions" in record:
        head = record.get("binary")
        head = head if isinstance(head, dict) else {}
        meta = head.get("meta")
        path = record.get("idb_path", head.get("path"))
        arch = record.get("arch", meta.get("arch") if isinstance(meta, dict) else None)
        fs = record["functions"]
        for address, body in fs.items() if isinstance(fs, dict) else ((f.get("fva"), f) for f in _items(fs) if isinstance(f, dict)):
            if isinstance(body, dict):
                yield path, arch, address, body
        return
    for path, fs in record.items():
        if isinstance(fs, dict):
            for address, body in fs.items():
                if isinstance(body, dict):
                    yield path, fs.get("arch"), address, body


#: One nested type for all layouts.
FUNCTION = pa.struct(
    [
        ("path", pa.string()),
        ("arch", pa.string()),
        ("func_addr", pa.int64()),
        ("nodes", pa.list_(pa.int64())),
        ("edges", pa.list_(pa.struct([("src", pa.int64()), ("dst", pa.int64())]))),
        ("blocks", pa.list_(pa.struct([("addr", pa.int64()), ("bb_len", pa.int64()), ("instructions", pa.list_(pa.struct([("head", pa.int64()), ("mnem", pa.string()), ("norm", pa.string())])))]))),
    ]
)
FUNCTIONS_DDL = (
    "array<struct<path:string,arch:string,func_addr:bigint,nodes:array<bigint>,edges:array<struct<src:bigint,dst:bigint>>,"
    "blocks:array<struct<addr:bigint,bb_len:bigint,instructions:array<struct<head:bigint,mnem:string,norm:string>>>>>>"
)


def _lists(values: pa.Array, ends: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def shred(payloads: pa.Array, blocks: bool = True) -> pa.Array:
    """JSON payloads as a list array of FUNCTION, written buffer by buffer. Null, incomplete and foreign payloads give an empty list."""
    path, arch, addr, node, src, dst, b_addr, b_len, head, mnem, norm = ([] for _ in range(11))
    f_end, n_end, e_end, b_end, i_end = [], [], [], [], []
    for text in payloads:
        try:
            record = json.loads(text.as_py() or "null")
        except (ValueError, RecursionError):
            record = None
        for p, a, at, body in _functions(record):
            if (number := _address(at)) is None:
                continue
            path.append(_text(p))
            arch.append(_text(a))
            addr.append(number)
            ns, es, bs = [], [], []
            _gather(body, ns, es, bs)
            node.extend(x for x in map(_address, ns) if x is not None)
            n_end.append(len(node))
            for s, d in es:
                s, d = _address(s), _address(d)
                if s is not None and d is not None:
                    src.append(s)
                    dst.append(d)
            e_end.append(len(src))
            if blocks:
                for where, b in bs:
                    b_addr.append(_address(where))
                    b_len.append(b["bb_len"] if isinstance(b.get("bb_len"), int) else None)
                    parts = [_items(b.get(k)) for k in ("bb_heads", "bb_mnems", "bb_norm")]
                    for i in range(max(map(len, parts))):
                        h, m, n = (x[i] if i < len(x) else None for x in parts)
                        head.append(_address(h))
                        mnem.append(_text(m))
                        norm.append(_text(n))
                    i_end.append(len(head))
            b_end.append(len(b_addr))
        f_end.append(len(addr))
    made = pa.StructArray.from_arrays
    ints = lambda x: pa.array(x, pa.int64())
    strings = lambda x: pa.array(x, pa.string())
    instruction = made([ints(head), strings(mnem), strings(norm)], names=["head", "mnem", "norm"])
    block = made([ints(b_addr), ints(b_len), _lists(instruction, i_end)], names=["addr", "bb_len", "instructions"])
    edge = made([ints(src), ints(dst)], names=["src", "dst"])
    f = made([strings(path), strings(arch), ints(addr), _lists(ints(node), n_end), _lists(edge, e_end), _lists(block, b_end)], names=[x.name for x in FUNCTION])
    return _lists(f, f_end)


#: Bytes of payload that are shredded at once.
_SLICE_BYTES = 4 << 20


def slices(array: pa.Array, most: int = _SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Start and length of runs of a text array with about `most` bytes each, so that long texts do not pile up."""
    if not len(array):
        return
    end = np.cumsum(np.asarray(pa.compute.binary_length(array).fill_null(0), dtype=np.int64))
    start = 0
    while start < len(array):
        stop = int(np.searchsorted(end, (end[start - 1] if start else 0) + most, side="right"))
        stop = max(stop, start + 1)
        yield start, stop - start
        start = stop


def shred_functions(df: DataFrame, key: str, payload: str) -> DataFrame:
    """`key` and `functions`, the payload's functions in one nested type whatever the exporter's layout.

    Null payloads and payloads that are not complete JSON have an empty list.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), shred(batch.column(1).slice(at, n))], names=[key, "functions"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, payload).mapInArrow(kernel, f"`{key}` {kind}, functions {FUNCTIONS_DDL}")


def known_edges(key: pa.Array, functions: pa.Array) -> pa.RecordBatch:
    """key, func_addr, src, dst of the distinct edges whose two ends are nodes of their function."""
    f, record, _ = child_index(functions)
    addr = np.asarray(_field(f, "func_addr"))
    node, node_of, _ = child_index(_field(f, "nodes"))
    edge, edge_of, _ = child_index(_field(f, "edges"))
    src, dst = (np.asarray(_field(edge, n), dtype=np.int64) for n in ("src", "dst"))
    values, code = np.unique(np.concatenate([np.asarray(node, dtype=np.int64), src, dst]), return_inverse=True)
    n, m = len(node), len(src)
    width = max(1, len(values))
    has = np.unique(node_of * width + code[:n])
    inside = np.isin(edge_of * width + code[n : n + m], has) & np.isin(edge_of * width + code[n + m :], has)
    _, first = np.unique(np.stack([record[edge_of], addr[edge_of], src, dst], axis=1)[inside], axis=0, return_index=True)
    at = np.flatnonzero(inside)[first]
    return pa.RecordBatch.from_arrays([key.take(pa.array(record[edge_of[at]])), *(pa.array(x, pa.int64()) for x in (addr[edge_of[at]], src[at], dst[at]))], names=["key", "func_addr", "src", "dst"])


def function_edges(df: DataFrame, key: str, payload: str) -> DataFrame:
    """The distinct edges between known nodes of each function in JSON payloads: key, func_addr, src, dst.

    All of a function lies in one payload, so this is one pass without a shuffle. Payloads delivered twice count under each key.
    A key name that clashes with func_addr, src or dst is refused.
    """
    if key in ("func_addr", "src", "dst"):
        raise ValueError("the key's name clashes with a result column")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1)):
                out = known_edges(batch.column(0).slice(at, n), shred(batch.column(1).slice(at, n), blocks=False))
                yield pa.RecordBatch.from_arrays(out.columns, names=[key, "func_addr", "src", "dst"])

    return df.select(key, payload).mapInArrow(kernel, f"`{key}` {df.schema[key].dataType.simpleString()}, func_addr bigint, src bigint, dst bigint")

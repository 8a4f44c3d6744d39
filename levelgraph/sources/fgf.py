"""Binary property graphs (format FGF version 1): typed nodes and edges with named properties, big-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .xs1 import _open

# Fixed values of the format.
MAGIC, COUNTS, ATTRIBUTES, NODE, EDGE, END = b"FGF1", b"CNTS", b"ATTR", b"NODE", b"EDGE", b"ENDG"
SHORT_BLOCK, LONG_BLOCK, WIDE = 0x77, 0x7A, 0xFF
STREAM_MAGIC = 0xACED0005
#: Type codes: how a value is stored, and its Spark type.
TYPES = {
    0x1: (None, "string"),
    0x10: (">?", "boolean"),
    0x11: (">h", "smallint"),
    0x12: (">i", "int"),
    0x13: (">q", "bigint"),
    0x20: (">f", "float"),
    0x21: (">d", "double"),
}
_CODES = {name: code for code, (_, name) in TYPES.items()}
_ARROW = {
    "string": pa.string(), "boolean": pa.bool_(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(),
    "float": pa.float32(), "double": pa.float64(),
}


class _Blocks:
    """The bytes inside an object stream's blocks; beyond the last one the file's own bytes follow."""

    def __init__(self, file):
        self.file, self.left = file, 0
        if struct.unpack(">I", _exactly(file, 4))[0] != STREAM_MAGIC:
            raise ValueError("not an object stream")

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if not self.left:
                kind = _exactly(self.file, 1)[0]
                if kind == SHORT_BLOCK:
                    self.left = _exactly(self.file, 1)[0]
                elif kind == LONG_BLOCK:
                    self.left = struct.unpack(">I", _exactly(self.file, 4))[0]
                else:
                    raise ValueError(f"unknown block {kind:#x}")
                continue
            got = _exactly(self.file, min(n - len(out), self.left))
            self.left -= len(got)
            out += got
        return out


def _exactly(file, n: int) -> bytes:
    got = file.read(n)
    if len(got) != n:
        raise ValueError("the file ends too early")
    return bytes(got)


def _u64(take) -> int:
    return struct.unpack(">Q", take(8))[0]


def _string(take) -> str:
    return take(struct.unpack(">H", take(2))[0]).decode()


def _word(take) -> int:
    first = take(1)[0]
    return _u64(take) if first == WIDE else first


def _value(take, code: int):
    form = TYPES[code][0]
    return _string(take) if form is None else struct.unpack(form, take(struct.calcsize(form)))[0]


def _header(file) -> dict:
    take = lambda n: _exactly(file, n)
    if take(4) != MAGIC:
        raise ValueError("not a graph file of version 1")
    size = _u64(take)
    first_node = _u64(take) if size >= 8 else 0
    first_edge = _u64(take) if size >= 16 else 0
    if size > 16:
        take(size - 16)
    if take(4) != COUNTS:
        raise ValueError("the counts are missing")
    n_properties = _u64(take)
    node_types = [(_string(take), _u64(take)) for _ in range(_u64(take))]
    edge_types = [(_string(take), _u64(take)) for _ in range(_u64(take))]
    if take(4) != ATTRIBUTES:
        raise ValueError("the attributes are missing")
    properties = [(_string(take), struct.unpack(">H", take(2))[0]) for _ in range(n_properties)]
    for name, code in properties:
        if code not in TYPES:
            raise ValueError(f"property {name} is of the unsupported type {code:#x}")
    return {"first_node": first_node, "first_edge": first_edge, "nodes": node_types, "edges": edge_types, "properties": properties}


def _rows(file, want: str) -> Iterator[dict]:
    """Nodes or edges one by one; the format can only be read from its beginning."""
    head = _header(file)
    names = head["properties"]

    def properties(take) -> dict:
        out = {}
        for _ in range(_word(take)):
            name, code = names[_word(take)]
            out[name] = _value(take, code)
        return out

    number = head["first_node"]
    if head["nodes"]:
        blocks = _Blocks(file)
        for kind, n in head["nodes"]:
            if blocks.take(4) != NODE or _string(blocks.take) != kind:
                raise ValueError("the nodes are out of order")
            for _ in range(n):
                row = properties(blocks.take)
                if want == "nodes":
                    yield {"id": number, "node_kind": kind, **row}
                number += 1
    if want == "nodes":
        return
    number = head["first_edge"]
    for kind, n in head["edges"]:
        blocks = _Blocks(file)
        if blocks.take(4) != EDGE or _string(blocks.take) != kind:
            raise ValueError("the edges are out of order")
        for _ in range(n):
            to, start = _u64(blocks.take), _u64(blocks.take)
            yield {"src": start, "dst": to, "file_edge": number, "edge_kind": kind, **properties(blocks.take)}
            number += 1
    if _exactly(file, 4) != END:
        raise ValueError("the end is missing")


def read_fgf(spark: SparkSession, address: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a file, each read by one task from the start, as the format has no index.

    edges: src, dst, file_edge, edge_kind and all properties; nodes: id, node_kind and all properties; a property that a
    row doesn't set is null. ValueError for a damaged file.
    """
    fs, path = _open(address)
    with fs.open_input_stream(path) as f:
        head = _header(f)
    props = [(n, TYPES[c][1]) for n, c in head["properties"]]
    schema = lambda own: ", ".join(f"`{n}` {t}" for n, t in own + props)
    shapes = {
        "edges": [("src", "bigint"), ("dst", "bigint"), ("file_edge", "bigint"), ("edge_kind", "string")],
        "nodes": [("id", "bigint"), ("node_kind", "string")],
    }

    def reader(want: str):
        columns = shapes[want] + props

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for place in b.column(0).to_pylist():
                    where, inside = _open(place)
                    with where.open_input_stream(inside) as f:
                        rows = _rows(f, want)
                        while held := list(islice(rows, 50_000)):
                            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], _ARROW[t]) for n, t in columns], names=[n for n, _ in columns])

        return read

    one = spark.createDataFrame([(address,)], "path string")
    return tuple(one.mapInArrow(reader(w), schema(shapes[w])) for w in ("edges", "nodes"))


def write_fgf(edges: pd.DataFrame, nodes: pd.DataFrame, types: dict[str, str], address: str) -> None:
    """Writes a small graph: nodes in order of id from 0; ``types`` names the Spark type of each property column."""
    names = list(types)

    def word(n: int) -> bytes:
        return bytes([n]) if n < WIDE else bytes([WIDE]) + struct.pack(">Q", n)

    def string(s: str) -> bytes:
        return struct.pack(">H", len(s.encode())) + s.encode()

    def value(name: str, v) -> bytes:
        form = TYPES[_CODES[types[name]]][0]
        return string(v) if form is None else struct.pack(form, v)

    def properties(row) -> bytes:
        own = [(i, n) for i, n in enumerate(names) if n in row and row[n] is not None and not (isinstance(row[n], float) and np.isnan(row[n]))]
        return word(len(own)) + b"".join(word(i) + value(n, row[n]) for i, n in own)

    def stream(body: bytes) -> bytes:
        out = struct.pack(">I", STREAM_MAGIC)
        for lo in range(0, len(body), 1024):
            block = body[lo : lo + 1024]
            out += (bytes([SHORT_BLOCK, len(block)]) if len(block) < 256 else bytes([LONG_BLOCK]) + struct.pack(">I", len(block))) + block
        return out

    u64 = lambda n: struct.pack(">Q", n)
    kinds = {"nodes": list(dict.fromkeys(nodes["node_kind"])) if len(nodes) else [], "edges": list(dict.fromkeys(edges["edge_kind"])) if len(edges) else []}
    if list(nodes["node_kind"]) != [k for k in kinds["nodes"] for _ in range(int((nodes["node_kind"] == k).sum()))]:
        raise ValueError("nodes of a kind must be consecutive")
    out = MAGIC + u64(16) + u64(0) + u64(0) + COUNTS + u64(len(names))
    for what, df, col in (("nodes", nodes, "node_kind"), ("edges", edges, "edge_kind")):
        out += u64(len(kinds[what])) + b"".join(string(k) + u64(int((df[col] == k).sum())) for k in kinds[what])
    out += ATTRIBUTES + b"".join(string(n) + struct.pack(">H", _CODES[types[n]]) for n in names)
    if kinds["nodes"]:
        out += stream(b"".join(NODE + string(k) + b"".join(properties(r) for r in nodes[nodes["node_kind"] == k].to_dict("records")) for k in kinds["nodes"]))
    for k in kinds["edges"]:
        rows = edges[edges["edge_kind"] == k].to_dict("records")
        out += stream(EDGE + string(k) + b"".join(u64(r["dst"]) + u64(r["src"]) + properties(r) for r in rows))
    fs, path = _open(address)
    with fs.open_output_stream(path) as f:
        f.write(out + END)

"""Reading protobuf messages by a table of their fields; what the table does not name is passed over. Spark's own from_protobuf is a package of its own, which plain
installations lack."""

from __future__ import annotations

from typing import Any

#: A field: name, kind (int, text, packed integers, or the name of a message), and whether there are several.
Field = tuple[str, str, bool]


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: memoryview):
    """(number, value) of a message's fields: integers, and the bytes of what has a length."""
    at, end = 0, len(data)
    while at < end:
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            if at + n > end:
                raise ValueError("the message ends within a field")
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + n], "little"), at + n
        else:
            raise ValueError(f"wire type {kind} is not known")
        yield tag >> 3, value


def signed32(n: int) -> int:
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def decoded(data: memoryview, message: str, tables: dict[str, dict[int, Field]]) -> dict[str, Any]:
    """A message as a dict: missing texts are empty, missing numbers 0, missing messages None."""
    table = tables[message]
    out: dict[str, Any] = {name: [] if many else {"int": 0, "text": ""}.get(kind) for name, kind, many in table.values()}
    for number, value in fields(data):
        if number not in table:
            continue
        name, kind, many = table[number]
        if kind == "packed" and isinstance(value, memoryview):
            at = 0
            while at < len(value):
                n, at = varint(value, at)
                out[name].append(signed32(n))
            continue
        made = signed32(value) if kind in ("int", "packed") else str(value, "utf-8", "replace") if kind == "text" else decoded(value, kind, tables)
        if many:
            out[name].append(made)
        else:
            out[name] = made
    return out

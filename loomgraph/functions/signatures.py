"""Signatures and call arguments, from one pass of a tokeniser over the text, in vectorised Python helpers."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

#: Quoted text, the operators that hold an angle bracket without being one, brackets, commas and colons.
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|=>|->|[<>!=]=|[()\[\]{}<>,:]""")
_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: How much of a call is looked at and shown.
LINES, WIDTH = 10, 80


class Mark(NamedTuple):
    at: int
    text: str
    depth: int


def marks(text: str, angles: bool = True) -> list[Mark]:
    """The tokens with the depth at which they stand: a bracket stands outside of what it opens. A closing bracket that fits none is skipped."""
    out, open_ = [], []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t in _CLOSING and (angles or t != "<"):
            out.append(Mark(m.start(), t, len(open_)))
            open_.append(_CLOSING[t])
        elif open_ and t == open_[-1]:
            open_.pop()
            out.append(Mark(m.start(), t, len(open_)))
        else:
            out.append(Mark(m.start(), t, len(open_)))
    return out


def _cut(text: str, at: list[int]) -> list[str]:
    parts = [text[a + 1 : b].strip() for a, b in zip([-1, *at], [*at, len(text)])]
    return [p for p in parts if p]


def split_top(text: str) -> list[str]:
    """Parts between commas that stand in no brackets and no quotes."""
    return _cut(text, [m.at for m in marks(text) if m.text == "," and not m.depth])


def group(text: str, kind: str, found: list[Mark]) -> tuple[str, int] | None:
    """What the first bracket of that kind at the top holds, and where the text goes on; None if it does not close."""
    begin = next((m.at for m in found if m.text == kind and not m.depth), None)
    end = next((m.at for m in found if begin is not None and m.at > begin and m.text == _CLOSING[kind] and not m.depth), None)
    return None if begin is None or end is None else (text[begin + 1 : end], end + 1)


def parsed(signature: str) -> tuple[list[str], str | None, list[str]]:
    """Types of the parameters, type returned, type parameters."""
    found = marks(signature)
    round_, angle = group(signature, "(", found), group(signature, "<", found)
    first = next((m.at for m in found if m.text == "(" and not m.depth), len(signature))
    # type parameters stand before the parameters, or without any
    generics = split_top(angle[0]) if angle and signature.find("<") < first else []
    if round_ is None:
        return [], None, generics
    types = []
    for p in split_top(round_[0]):
        colon = next((m.at for m in marks(p) if m.text == ":" and not m.depth), None)
        if colon is not None:
            types.append(p[colon + 1 :].strip())
    after = signature[round_[1] :].strip()
    sign = next((s for s in ("=>", "->", ":") if after.startswith(s)), None)
    return types, (after[len(sign) :].strip() or None) if sign else None, generics


_INFO = StructType([StructField("param_types", ArrayType(StringType())), StructField("return_type", StringType()), StructField("is_generic", BooleanType()), StructField("type_params", ArrayType(StringType()))])


@F.pandas_udf(_INFO)
def signature_info(signature: pd.Series) -> pd.DataFrame:
    made = signature.fillna("").map(parsed)
    return pd.DataFrame({"param_types": made.str[0], "return_type": made.str[1], "is_generic": made.str[2].map(bool), "type_params": made.str[2]})


def arguments(text: str, callee: str) -> list[str] | None:
    """The arguments of the first call of callee; None without a call, or without arguments."""
    shown = "\n".join(text.splitlines()[:LINES])
    for m in re.finditer(re.escape(callee), shown):
        rest = shown[m.end() :]
        call = re.match(r"\s*(?:<[^>]*>\s*)?(?=\()", rest)
        if call:
            inside = group(rest[call.end() :], "(", marks(rest[call.end() :], angles=False))
            found = _cut(inside[0], [x.at for x in marks(inside[0], angles=False) if x.text == "," and not x.depth]) if inside else []
            return [a if len(a) <= WIDTH else a[: WIDTH - 3] + "..." for a in found] or None
    return None


@F.pandas_udf(ArrayType(StringType()))
def call_arguments(lines: pd.Series, callee: pd.Series) -> pd.Series:
    """The arguments of the first call of callee in the text from its line on (LINES at most), each WIDTH characters at most."""
    return pd.Series([arguments(t, n) if t and n else None for t, n in zip(lines, callee)], dtype=object)

"""Symbol indexes: binary files of documents with their symbols, occurrences and diagnostics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import symbol_id
from .wire import Field, decoded, fields

#: The format's fields by number.
TABLES: dict[str, dict[int, Field]] = {
    "document": {1: ("relative_path", "text", False), 2: ("occurrences", "occurrence", True), 3: ("symbols", "symbol", True), 4: ("language", "text", False)},
    "occurrence": {1: ("range", "packed", True), 2: ("symbol", "text", False), 3: ("symbol_roles", "int", False), 6: ("diagnostics", "diagnostic", True)},
    "symbol": {1: ("symbol", "text", False), 3: ("documentation", "text", True), 4: ("relationships", "relationship", True), 7: ("signature_documentation", "signature", False)},
    "relationship": {1: ("symbol", "text", False), 2: ("is_reference", "int", False), 3: ("is_implementation", "int", False), 4: ("is_type_definition", "int", False)},
    "signature": {5: ("text", "text", False)},
    "diagnostic": {1: ("severity", "int", False), 2: ("code", "text", False), 3: ("message", "text", False)},
}
DOCUMENTS, EXTERNAL = 2, 3
_SYMBOL = "struct<symbol:string,signature:string,documentation:array<string>,relationships:array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean>>>"
SCHEMA = f"""relative_path string, language string, external boolean,
    occurrences array<struct<symbol:string,range:array<int>,symbol_roles:int,diagnostics:array<struct<severity:int,code:string,message:string>>>>, symbols array<{_SYMBOL}>"""
#: Documents of a batch.
ROWS = 200


def _symbol(s: dict) -> dict:
    flags = ("is_reference", "is_implementation", "is_type_definition")
    rel = [{"symbol": r["symbol"], **{f: bool(r[f]) for f in flags}} for r in s["relationships"]]
    return {"symbol": s["symbol"], "signature": (s["signature_documentation"] or {}).get("text"), "documentation": s["documentation"], "relationships": rel}


def _rows(data: memoryview) -> Iterator[dict]:
    """A row for each document, as it is met, and one for each symbol from elsewhere."""
    for number, value in fields(data):
        if number == DOCUMENTS:
            d = decoded(value, "document", TABLES)
            yield {**d, "external": False, "symbols": [_symbol(s) for s in d["symbols"]]}
        elif number == EXTERNAL:
            yield {"relative_path": None, "language": None, "external": True, "occurrences": [], "symbols": [_symbol(decoded(value, "symbol", TABLES))]}


def read(spark: SparkSession, path: str) -> DataFrame:
    """relative_path, language, external, occurrences, symbols of all index files at path; an empty file has no documents. A file is one task's, its documents go on in batches."""
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                held = []
                for row in _rows(memoryview(content.as_py())):
                    held.append(row)
                    if len(held) == ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def widened(range_: Column) -> Column:
    """start line, start column, end line, end column; three numbers mean one line."""
    return F.when(F.size(range_) == 3, F.array(range_[0], range_[1], range_[0], range_[2])).otherwise(range_)


def occurrences(documents: DataFrame) -> DataFrame:
    """path, symbol, line (from 1), roles, and the symbol's own file, name and container. documents: relative_path, occurrences."""
    o = documents.select(F.col("relative_path").alias("path"), F.explode("occurrences").alias("o")).select("path", "o.symbol", widened(F.col("o.range")).alias("r"), "o.symbol_roles")
    file, name, container = symbol_id(F.col("symbol"))
    return o.select("path", "symbol", (F.col("r")[0] + 1).alias("line"), F.col("symbol_roles").alias("roles"), file.alias("def_path"), name.alias("name"), container.alias("container"))


def references(found: DataFrame) -> DataFrame:
    """Occurrences that neither define nor import."""
    return found.filter(F.col("roles").bitwiseAND(3) == 0)


def diagnostics(documents: DataFrame) -> DataFrame:
    """path, line, end_line (from 1), severity, code, message of what occurrences carry."""
    o = documents.select(F.col("relative_path").alias("path"), F.explode("occurrences").alias("o")).select("path", widened(F.col("o.range")).alias("r"), F.explode("o.diagnostics").alias("d"))
    return o.select("path", (F.col("r")[0] + 1).alias("line"), (F.col("r")[2] + 1).alias("end_line"), "d.severity", "d.code", "d.message")


def symbol_table(documents: DataFrame) -> DataFrame:
    """symbol, path (null if it is from elsewhere), name, signature, documentation: each symbol of the files once, the first of a path's by order of the path."""
    s = documents.select(F.col("relative_path").alias("path"), F.explode("symbols").alias("s")).select("path", "s.symbol", "s.signature", "s.documentation")
    one = s.groupBy("symbol").agg(F.min(F.struct(F.col("path").isNull().alias("away"), "path", "signature", "documentation")).alias("f"))
    return one.select("symbol", "f.path", symbol_id(F.col("symbol"))[1].alias("name"), "f.signature", "f.documentation")

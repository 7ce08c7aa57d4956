"""Schemas of the stored tables, in one place."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 5

# fixed values: the enumerations of the data model
CHUNK_TYPES = ("fact", "constraint", "instruction", "code", "log", "background", "summary", "diff", "reference")
TIERS = ("hot", "warm", "cold", "compressed")
EDGE_TYPES = ("references", "defines", "depends_on", "contains", "overrides", "summarizes")
SYMBOL_KINDS = ("function", "class", "interface", "type", "method", "variable", "constant", "enum", "struct", "trait", "module", "import")
REFERENCE_KINDS = ("import", "export", "call", "inheritance", "type", "module", "reference")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

CHUNKS = _struct(("id", S), ("source", S), ("type", S), ("text", S), ("timestamp", TS), ("path", S), ("language", S), ("tokensEstimate", L), ("parentId", S), ("metadata", S))
DEPENDENCIES = _struct(("fromId", S), ("toId", S), ("type", S), ("weight", D))
SYMBOLS = _struct(("chunkId", S), ("path", S), ("language", S), ("name", S), ("normalizedName", S), ("kind", S), ("signature", S), ("startLine", L), ("endLine", L), ("isExported", B))
REFERENCES = _struct(("chunkId", S), ("path", S), ("language", S), ("target", S), ("normalizedTarget", S), ("kind", S), ("startLine", L), ("endLine", L))
EMBEDDINGS = _struct(("chunkId", S), ("embedding", T.ArrayType(T.FloatType())), ("model", S), ("dimensions", T.IntegerType()), ("timestamp", TS))
ROUTING = _struct(("id", L), ("chunkId", S), ("tier", S), ("score", D), ("reasons", S), ("taskText", S), ("timestamp", TS))
COMPRESSION = _struct(("id", S), ("taskText", S), ("summary", S), ("retainedFacts", S), ("retainedConstraints", S), ("sourceChunkIds", S), ("timestamp", TS))

POSTINGS = _struct(("chunkId", S), ("term", S), ("tf", L))
LENGTHS = _struct(("chunkId", S), ("dl", L))

TABLES = {"chunks": CHUNKS, "dependencies": DEPENDENCIES, "code_symbols": SYMBOLS, "code_references": REFERENCES, "chunk_embeddings": EMBEDDINGS, "routing_history": ROUTING, "compression_cache": COMPRESSION, "postings": POSTINGS, "text_lengths": LENGTHS}

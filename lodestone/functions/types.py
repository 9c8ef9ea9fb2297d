"""Tables are declared by a string of type codes, one letter for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import TypeMismatchError

# The type codes, and the bytes that a short string or byte string may take.
CODES: dict[str, tuple[T.DataType, int | None]] = {
    "b": (T.ByteType(), None),
    "i": (T.ShortType(), None),
    "I": (T.IntegerType(), None),
    "l": (T.LongType(), None),
    "d": (T.DoubleType(), None),
    "s": (T.StringType(), 255),
    "S": (T.StringType(), None),
    "a": (T.BinaryType(), 255),
    "A": (T.BinaryType(), None),
}
MAX_COLUMNS = 127
MAX_KEY_COLUMNS = 16
MAX_NAME_BYTES = 127


def parse_types(codes: str) -> T.StructType:
    """The schema that type codes name: columns c0, c1 and so on, all nullable."""
    if not 0 < len(codes) <= MAX_COLUMNS:
        raise TypeMismatchError(f"a table has 1 to {MAX_COLUMNS} columns, not {len(codes)}")
    fields = []
    for n, code in enumerate(codes):
        if code not in CODES:
            raise TypeMismatchError(f"no type has the code {code!r}")
        kind, size = CODES[code]
        fields.append(T.StructField(f"c{n}", kind, True, {"code": code} | ({"max_bytes": size} if size else {})))
    return T.StructType(fields)


def type_codes(schema: T.StructType) -> str:
    """The codes of a schema; columns without one get that of their Spark type, unlimited in size."""
    plain = {type(kind): code for code, (kind, size) in CODES.items() if size is None}
    try:
        return "".join(f.metadata.get("code") or plain[type(f.dataType)] for f in schema.fields)
    except KeyError as e:
        raise TypeMismatchError(f"no type code for {e.args[0].__name__}") from None


def too_long(schema: T.StructType) -> Column:
    """Whether a row has a value with more bytes than its column takes."""
    tests = [F.octet_length(f.name) > f.metadata["max_bytes"] for f in schema.fields if "max_bytes" in f.metadata]
    found = F.lit(False)
    for t in tests:
        found = found | F.coalesce(t, F.lit(False))
    return found


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` by position as ``schema``: missing trailing columns become null, and a value that does not fit fails the job."""
    if len(df.columns) > len(schema):
        raise TypeMismatchError(f"{len(df.columns)} columns for a table of {len(schema)}")
    given = df.toDF(*(f.name for f in schema.fields[: len(df.columns)]))
    return given.select(*(fitted(F.col(f.name) if n < len(df.columns) else F.lit(None), f) for n, f in enumerate(schema.fields)))


def fitted(value: Column, f: T.StructField) -> Column:
    """``value`` as a column of type ``f``; bytes beyond its limit fail the job."""
    value = value.cast(f.dataType)
    if "max_bytes" in f.metadata:
        message = F.lit(f"{f.name} takes {f.metadata['max_bytes']} bytes at most")
        value = F.when(F.octet_length(value) > f.metadata["max_bytes"], F.raise_error(message).cast(f.dataType)).otherwise(value)
    return value.alias(f.name, metadata=f.metadata)


def check_row(row: tuple, schema: T.StructType) -> tuple:
    """``row`` padded with nulls to the schema's length, after a check that its values fit."""
    if len(row) > len(schema):
        raise TypeMismatchError(f"{len(row)} values for a table of {len(schema)} columns")
    out = list(row) + [None] * (len(schema) - len(row))
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
    for n, (v, f) in enumerate(zip(out, schema.fields, strict=True)):
        if v is None:
            continue
        kind = type(f.dataType)
        if kind in bits:
            if isinstance(v, bool) or not isinstance(v, int) or not -(1 << bits[kind] - 1) <= v < 1 << bits[kind] - 1:
                raise TypeMismatchError(f"{v!r} does not fit column {f.name}")
        elif kind is T.DoubleType:
            if not isinstance(v, int | float):
                raise TypeMismatchError(f"{v!r} does not fit column {f.name}")
            out[n] = float(v)
        else:
            raw = v.encode() if kind is T.StringType and isinstance(v, str) else v if kind is T.BinaryType and isinstance(v, bytes | bytearray) else None
            if raw is None or len(raw) > f.metadata.get("max_bytes", len(raw)):
                raise TypeMismatchError(f"a value does not fit column {f.name}")
            out[n] = v if isinstance(v, str) else bytearray(v)
    return tuple(out)

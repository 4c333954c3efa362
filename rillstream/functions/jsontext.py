"""Rows as lines of JSON: keys sorted, nulls kept, < > & escaped if wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted(col: Column, kind: T.DataType) -> Column:
    """The same value with the fields of every struct in the order of their names."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        return F.when(col.isNotNull(), F.struct(*[_sorted(col[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _sorted(x, kind.elementType))
    return col


def json_line(df: DataFrame, html_escape: bool = True) -> Column:
    """The JSON text of a row of df, without a line end."""
    fields = sorted(df.schema.fields, key=lambda f: f.name.encode())
    row = F.struct(*[_sorted(df[f"`{f.name}`"], f.dataType).alias(f.name) for f in fields])
    line = F.to_json(row, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    if html_escape:  # these characters only stand inside strings
        for c, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
            line = F.replace(line, F.lit(c), F.lit(code))
    return line


def line_bytes(line: Column) -> Column:
    """Bytes of a line with its line end."""
    return F.octet_length(line) + 1

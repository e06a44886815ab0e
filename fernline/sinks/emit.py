"""Result rows as text: NDJSON, JSON, CSV, TSV and a table; and as files."""

from __future__ import annotations

import datetime
import decimal
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.types import VariantVal

from ..lang.format import number
from ..plans.lower import Lowered

PREVIEW = 80


def plain(value: object) -> object:
    """A value of a collected row as JSON data."""
    if isinstance(value, VariantVal):
        return plain(value.toPython())
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    if isinstance(value, bytes | bytearray):
        return value.hex()
    return value


def text(value: object) -> str:
    """JSON text of a value, numbers written as the language writes them."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int | float):
        return "null" if isinstance(value, float) and (value != value or abs(value) == float("inf")) else number(value)
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(text, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def values(lowered: Lowered, limit: int | None = None) -> Iterator[object]:
    """The rows of a result as JSON data, fetched partition by partition (at once where rows are observed, which Spark reports
    of whole runs only). An aggregate without keys emits one value per item."""
    df = lowered.df if limit is None or lowered.shape == "items" else lowered.df.limit(limit)
    left = limit
    for row in df.collect() if lowered.observations else df.toLocalIterator():
        if lowered.shape == "items":
            out: Iterable = [plain(v) for v in row]
        elif lowered.shape == "value":
            out = [plain(row[0])]
        else:
            out = [{k: plain(v) for k, v in zip(row.__fields__, row, strict=True)}]
        for x in out:
            if left is not None:
                if left <= 0:
                    return
                left -= 1
            yield x


def kind(value: object) -> str:
    if value is None or isinstance(value, bool):
        return "null" if value is None else "bool"
    return "number" if isinstance(value, int | float) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def preview(value: object, most: int = PREVIEW) -> str:
    """At most ``most`` bytes of a value's text."""
    raw = text(value).encode()
    return raw.decode() if len(raw) <= most else raw[: most - 3].decode("utf-8", "ignore") + "..."


def ndjson(rows: Iterable[object]) -> Iterator[str]:
    return (text(v) + "\n" for v in rows)


def json_array(rows: Iterable[object]) -> Iterator[str]:
    first = True
    for v in rows:
        yield ("[\n  " if first else ",\n  ") + text(v)
        first = False
    yield "[]\n" if first else "\n]\n"


def _csv(cell: str) -> str:
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in '",\r\n') else cell


def csv(rows: Iterable[object]) -> Iterator[str]:
    yield "path,type,preview\n"
    for i, v in enumerate(rows):
        yield ",".join(map(_csv, (f"[{i}]", kind(v), preview(v)))) + "\n"


def tsv(rows: Iterable[object]) -> Iterator[str]:
    yield "path\ttype\tpreview\n"
    for i, v in enumerate(rows):
        yield "\t".join(c.translate({9: " ", 10: " ", 13: " "}) for c in (f"[{i}]", kind(v), preview(v))) + "\n"


def table(rows: Iterable[object], unicode: bool = False, path_width: int = 40, value_width: int = 80) -> str:
    """A grid with the columns path and value."""

    def cut(s: str, n: int) -> str:
        return s if len(s) <= n else s[: n - 1] + ("…" if unicode else ".")

    cells = [("path", "value"), *((cut(f"[{i}]", path_width), cut(text(v).replace("\n", " "), value_width)) for i, v in enumerate(rows))]
    w = [max(len(c[i]) for c in cells) for i in (0, 1)]
    h, v, corners = ("─", "│", ("┌┬┐", "├┼┤", "└┴┘")) if unicode else ("-", "|", ("+++",) * 3)

    def rule(c: str) -> str:
        return c[0] + h * (w[0] + 2) + c[1] + h * (w[1] + 2) + c[2]

    lines = [f"{v} {a:<{w[0]}} {v} {b:<{w[1]}} {v}" for a, b in cells]
    return "\n".join([rule(corners[0]), lines[0], rule(corners[1]), *lines[1:], rule(corners[2])]) + "\n"


FORMATS = {"ndjson": ndjson, "json": json_array, "csv": csv, "tsv": tsv}


def export(lowered: Lowered, path: str, form: str = "ndjson", limit: int | None = None) -> int:
    """Write a result to one local file; returns the number of rows."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    n = 0

    def counted() -> Iterator[object]:
        nonlocal n
        for x in values(lowered, limit):
            n += 1
            yield x

    with open(path, "w", encoding="utf-8") as f:
        f.writelines(FORMATS[form](counted()))
    return n


def write_distributed(df: DataFrame, path: str, form: str = "json") -> None:
    """Write a result from the executors: json (one object per line), csv, parquet or orc, in parts."""
    writer = df.write
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        getattr(writer, form)(path)

"""Operations from lines of text, as column expressions.

A parser maps a line to struct(skip, op, key, value, error): skipped lines are blank or headers; error says what is
wrong, or is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.errors import UnreadableSourceError
from tidelog.schema import DELETE, GET, PUT

OPERATIONS = (PUT, DELETE, GET)
#: Nesting that a JSON line may have.
DEPTH = 8


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used; keeps generated code small."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, "^[ \\t\\n\\r\\x0B\\x00]+|[ \\t\\n\\r\\x0B\\x00]+$", "")


def _checked(skip: Column, kind: Column, key: Column, value: Column, broken: Column) -> Column:
    """Adds what every format asks for: a known operation, a key, a value for a put."""
    op = F.lower(_trim(kind))
    error = (
        F.when(skip, None)
        .when(broken.isNotNull(), broken)
        .when(~op.isin(*OPERATIONS), F.concat(F.lit("unknown operation "), op))
        .when(key == "", F.lit("the key is empty"))
        .when((op == PUT) & value.isNull(), F.lit("a put needs a value"))
    )
    return F.struct(F.coalesce(skip, F.lit(False)).alias("skip"), op.alias("op"), key.alias("key"), F.when(op == PUT, value).alias("value"), error.alias("error"))


def _scalar(variant: Column) -> Column:
    """A scalar as text: true is 1, false is empty, a whole number has no fraction; objects, arrays and null are null."""
    kind, text = F.schema_of_variant(variant), F.try_variant_get(variant, "$", "string")
    number = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole = F.try_variant_get(variant, "$", "double")
    floating = F.when((whole == F.floor(whole)) & (F.abs(whole) < 1e15), F.floor(whole).cast("string")).otherwise(number)
    return F.when(kind.isin("STRING", "BIGINT"), text).when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise("")).when(kind.startswith("DECIMAL"), F.when(text.contains("."), number).otherwise(text)).when(kind.isin("DOUBLE", "FLOAT"), floating)


def _too_deep(line: Column) -> Column:
    """Whether brackets outside strings nest deeper than DEPTH; a line with no more brackets than that can't, and isn't looked at closely."""
    left = F.regexp_replace(F.regexp_replace(line, r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    for _ in range(DEPTH):
        left = F.regexp_replace(left, r"\{\}|\[\]", "")
    opened = F.length(line) - F.length(F.translate(line, "[{", ""))
    return F.when(opened <= DEPTH, False).otherwise(F.length(left) > 0)


def json_line(line: Column) -> Column:
    """{"type": ..., "key": ..., "value": ...}; the key isn't trimmed.  A line is parsed once; a plain text needs no second look."""

    def field(variant: Column, name: str) -> Column:
        return _let(F.try_variant_get(variant, f"$.{name}", "variant"), lambda v: F.when(v.isNotNull(), _scalar(v)))

    def fields(text: Column, variant: Column) -> Column:
        return F.struct(text.alias("text"), variant.isNull().alias("broken"), *[field(variant, n).alias(n) for n in ("type", "key", "value")])

    def judged(p: Column) -> Column:
        broken = F.when(p["broken"], F.lit("not valid JSON")).when(_too_deep(p["text"]), F.lit("nested too deeply")).when(p["type"].isNull() | p["key"].isNull(), F.lit("type and key are needed"))
        return _let(F.struct((p["text"] == "").alias("skip"), broken.alias("broken")), lambda q: _checked(q["skip"], p["type"], p["key"], p["value"], q["broken"]))

    return _let(_trim(line), lambda text: _let(F.try_parse_json(text), lambda variant: _let(fields(text, variant), judged)))


def separated_line(separator: str) -> Callable[[Column], Column]:
    """type, key, value; quotes enclose, a doubled quote is one, nothing escapes.  A line whose type is "type" is a header."""

    def parse(line: Column) -> Column:
        options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}

        def judged(p: Column) -> Column:
            skip = (_trim(p["text"]) == "") | F.coalesce(p["type"] == "type", F.lit(False))
            broken = F.when(p["type"].isNull(), F.lit("the type is missing")).when(p["key"].isNull() | (p["key"] == ""), F.lit("the key is missing"))
            return _let(F.struct(skip.alias("skip"), broken.alias("broken")), lambda q: _checked(q["skip"], p["type"], p["key"], F.when(p["value"] != "", p["value"]), q["broken"]))

        def fields(text: Column) -> Column:
            parsed = F.from_csv(text, "type string, key string, value string, rest string", options)
            return _let(parsed, lambda f: _let(F.struct(text.alias("text"), F.lower(_trim(f["type"])).alias("type"), _trim(f["key"]).alias("key"), f["value"].alias("value")), judged))

        return _let(F.regexp_replace(line, r"[\r\n]+$", ""), fields)

    return parse


#: Formats by extension.
PARSERS: dict[str, Callable[[Column], Column]] = {"jsonl": json_line, "ndjson": json_line, "json": json_line, "csv": separated_line(","), "tsv": separated_line("\t")}


def parser_for(path: str) -> Callable[[Column], Column]:
    """By the path's extension, in any case."""
    extension = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if extension not in PARSERS:
        raise UnreadableSourceError(f"no parser for {path}; there are parsers for {', '.join(PARSERS)}")
    return PARSERS[extension]

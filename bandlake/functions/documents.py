"""Strict JSON documents over VARIANT: a whole text is parsed, and a description of its kind names the first thing that is wrong.

A kind is a function from a VARIANT column to a text column: what is wrong, null if nothing is. Kinds nest, so a document
is walked once. Numbers keep their kind: 1.0 is no whole number, "1" is no number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Kind = Callable[[Column], Column]
#: JSON as its standard has it.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
LONG = (1 << 63) - 1


def whole_document(text: Column) -> Column:
    """The text as VARIANT; null if it isn't exactly one JSON document, or an object in it has a key twice.

    Parsers stop behind the first document, so the text is set before a key that it can't hold itself: its own digest.
    """
    wrapped = F.concat(F.lit('{"v":'), text, F.lit(',"'), F.sha2(text, 256), F.lit('":true}'))
    found = F.from_json(wrapped, "map<string,variant>", _STRICT)
    return F.when((F.size(found) == 2) & F.map_contains_key(found, F.sha2(text, 256)), F.try_element_at(found, F.lit("v")))


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _unless(right: Column, expected: str) -> Column:
    return F.when(~F.coalesce(right, F.lit(False)), F.lit(f"expected {expected}"))


def string(v: Column) -> Column:
    return _unless(_type(v) == "STRING", "a string")


def anything(v: Column) -> Column:
    return F.lit(None).cast("string")


def number(v: Column) -> Column:
    kind = _type(v)
    return _unless((kind == "BIGINT") | F.startswith(kind, F.lit("DECIMAL")) | ((kind == "DOUBLE") & (F.abs(F.try_variant_get(v, "$", "double")) < float("inf"))), "a number")


def whole(low: int = 0, high: int = LONG) -> Kind:
    """Whole numbers of a range; they must fit a BIGINT."""
    return lambda v: _unless((_type(v) == "BIGINT") & F.try_variant_get(v, "$", "bigint").between(low, high), f"a whole number from {low} to {high}")


def array(of: Kind, length: int | None = None) -> Kind:
    def kind(v: Column) -> Column:
        items = F.try_variant_get(v, "$", "array<variant>")
        first = F.get(F.filter(F.transform(items, of), lambda e: e.isNotNull()), F.lit(0))
        wrong = F.when(items.isNull(), F.lit("expected an array"))
        if length is not None:
            wrong = wrong.when(F.size(items) != length, F.lit(f"expected {length} values"))
        return wrong.otherwise(F.when(first.isNotNull(), F.concat(F.lit("[] "), first)))

    return kind


def numbers(low: int, high: int) -> Kind:
    """An array of whole numbers of a range, checked by its merged type, so that long ones stay cheap."""

    def kind(v: Column) -> Column:
        items = F.try_variant_get(v, "$", "array<bigint>")
        sound = _type(v).isin("ARRAY<BIGINT>", "ARRAY<VOID>") & F.forall(items, lambda x: F.coalesce(x.between(low, high), F.lit(False)))
        return _unless(sound, f"an array of whole numbers from {low} to {high}")

    return kind


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def fields(required: dict[str, Kind] | None = None, default: dict[str, Kind] | None = None, optional: dict[str, Kind] | None = None, more: Kind | None = None) -> Kind:
    """An object: ``default`` fields may be absent, ``optional`` ones may be null, too; others may be there. ``more`` is asked last, of the whole object."""

    def kind(v: Column) -> Column:
        wrong = [F.when(F.try_variant_get(v, "$", "map<string,variant>").isNull(), F.lit("expected an object"))]
        named = lambda name, error: F.when(error.isNotNull(), F.concat(F.lit(f"{name}: "), error))
        for name, of in (required or {}).items():
            x = field(v, name)
            wrong.append(F.when(x.isNull(), F.lit(f"{name}: missing")).otherwise(named(name, of(x))))
        for name, of in (default or {}).items():
            x = field(v, name)
            wrong.append(F.when(x.isNotNull(), named(name, of(x))))
        for name, of in (optional or {}).items():
            x = field(v, name)
            wrong.append(F.when(x.isNotNull() & ~F.is_variant_null(x), named(name, of(x))))
        if more:
            wrong.append(more(v))
        return F.coalesce(*wrong) if len(wrong) > 1 else wrong[0]

    return kind


def either(*kinds: Kind) -> Kind:
    """Any of the kinds; the last one's message is given."""
    return lambda v: F.when(F.array_contains(F.transform(F.array(*[k(v) for k in kinds]), lambda e: e.isNull()), True), None).otherwise(kinds[-1](v))


def tagged(tag: str, kinds: dict[str, Kind]) -> Kind:
    """An object whose string field ``tag`` says what else it must have; other tags ask for nothing."""

    def kind(v: Column) -> Column:
        name = field(v, tag)
        wrong = F.when(name.isNull(), F.lit(f"{tag}: missing")).when(_type(name) != "STRING", F.lit(f"{tag}: expected a string"))
        value = F.try_variant_get(v, f"$.{tag}", "string")
        for known, of in kinds.items():
            wrong = wrong.when(value == known, of(v))
        return wrong

    return kind


def problem(text: Column, kind: Kind) -> Column:
    """What is wrong with a text as a document of a kind, null if nothing is."""
    v = whole_document(text)
    return F.when(v.isNull(), F.lit("not a JSON document")).otherwise(kind(v))

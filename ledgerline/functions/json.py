"""JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PERSON_ARRAY = "array<struct<name:string,age:int,dob:date>>"


def last_named(items: Column, name: str) -> Column:
    """The last object called ``name`` in an array of objects, or NULL."""
    return F.try_element_at(F.filter(items, lambda item: item["name"] == name), F.lit(-1))


def base64_text(data: Column) -> Column:
    """UTF-8 text of base64 data; NULL when it is not base64 or its bytes are not UTF-8."""
    return F.try_validate_utf8(F.try_to_binary(data, F.lit("base64")).cast("string"))

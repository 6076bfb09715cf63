"""Nested documents: rows to JSON text and back. An absent field means NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nested lists are written in parts of about this many elements, so that no group
# of rows has to fit into one document.
PART_SIZE = 500


def document(*fields: Column | str) -> Column:
    """JSON text of the fields; NULL fields are left out."""
    return F.to_json(F.struct(*fields))


def part_number(position: Column) -> Column:
    """Document part of an element from its position within its owner."""
    return F.floor(position / PART_SIZE)


def shred_lists(documents: DataFrame, schema: str, name: str) -> DataFrame:
    """Elements of the array ``name`` of each document as rows, with the owner fields."""
    parsed = documents.select(F.from_json("document", schema).alias("d"))
    fields = parsed.select("d.*")
    owner = [c for c in fields.columns if c != name]
    return fields.select(*owner, F.explode(name).alias("e")).select(*owner, "e.*")

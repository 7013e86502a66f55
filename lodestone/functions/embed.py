"""Embedders: the protocol of a model, and a deterministic stand-in."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import code_tokens, normalised, query_prefix


class Embedder(Protocol):
    """A model as column expressions (built-in ones, or a pandas UDF for a real model)."""

    name: str
    dim: int

    def documents(self, text: Column) -> Column: ...

    def queries(self, text: Column) -> Column: ...


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Counts of tokens by crc32 bucket, at length 1; a text without tokens is the first unit vector."""
    buckets = F.transform(code_tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.crc32(t), F.lit(dim)).cast("int"))
    counts = F.aggregate(
        buckets,
        F.array_repeat(F.lit(0.0), dim),
        lambda v, b: F.transform(v, lambda x, i: F.when(i == b, x + 1.0).otherwise(x)),
    )
    first = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    return F.when(F.size(buckets) > 0, normalised(counts)).otherwise(first)


class HashEmbedder:
    """:func:`hash_embedding` of documents and queries alike."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hash-{dim}", dim

    def documents(self, text: Column) -> Column:
        return hash_embedding(text, self.dim)

    queries = documents


class PrefixedEmbedder:
    """An embedding function (column to column) whose queries come with the instruction its model wants."""

    def __init__(self, name: str, dim: int, function):
        self.name, self.dim, self.function = name, dim, function

    def documents(self, text: Column) -> Column:
        return normalised(self.function(text))

    def queries(self, text: Column) -> Column:
        return self.documents(F.concat(query_prefix(F.lit(self.name)), text))


def checked(vector: Column, dim: int) -> Column:
    """The vector; an error where it isn't ``dim`` long."""
    said = F.concat(F.lit(f"a vector of another length than {dim}: "), F.size(vector).cast("string"))
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(said))

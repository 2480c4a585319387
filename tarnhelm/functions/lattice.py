"""The five-step action lattice as ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Actions from weakest to strongest.
LATTICE = ("allow", "warn", "tokenize", "mask", "block")


def rank(action: Column) -> Column:
    """0-4; an action outside the lattice is an error, never a silent null."""
    out = F.when(action.isNull(), F.lit(None).cast("int"))
    for i, name in enumerate(LATTICE):
        out = out.when(action == name, F.lit(i))
    return out.otherwise(
        F.raise_error(F.concat(action, F.lit(" is not on the action lattice"))).cast("int")
    )


def action_of(rank_col: Column) -> Column:
    """Name of a rank, null for null. (``element_at`` on a literal array does not return
    null for a null index, so this is a CASE.)"""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, name in enumerate(LATTICE):
        out = out.when(rank_col == i, name)
    return out


def strongest(*actions: Column) -> Column:
    return action_of(F.greatest(*[rank(a) for a in actions]))


def is_weaker(candidate: Column, floor: Column) -> Column:
    return rank(candidate) < rank(floor)

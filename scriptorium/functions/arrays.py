"""Array, map and JSON functions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import squeeze


def inverted(c: Column) -> Column:
    """map of word -> places from 0."""
    words = F.split(squeeze(c), " ")
    return F.map_from_arrays(F.array_distinct(words), F.transform(F.array_distinct(words), lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())))


def from_inverted(m: Column) -> Column:
    """The text whose words stand at the places that the map gives."""
    pairs = F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def keep_places(items: Column, places: list[int], judged: int | None = None) -> Column:
    """Items at the given places (from 1) among the first `judged`, then all items behind those unjudged."""
    wanted = F.array(*[F.lit(p) for p in places])
    if judged is None:
        return F.filter(items, lambda _, i: F.array_contains(wanted, i + 1))
    return F.filter(items, lambda _, i: (i >= judged) | F.array_contains(wanted, i + 1))


def one_or_many(json: Column, element: str) -> Column:
    """A JSON value that is an object or a list of objects, as a list of structs; null for anything else."""
    return F.when(F.trim(json).startswith("["), F.from_json(json, f"array<{element}>")).when(F.trim(json).startswith("{"), F.array(F.from_json(json, element)))


def enveloped(json: Column, name: str) -> Column:
    """What the envelope `name` holds, or the whole value where there is none."""
    return F.coalesce(F.get_json_object(json, f"$.{name}"), json)

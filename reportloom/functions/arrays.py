"""Array helpers shared by the per-document operators.

A document is one row, so everything that happens inside a document (lines,
sections, sentences, chunks) is expressed with array functions on that row. The
plans stay narrow: no shuffle, no Python, any number of documents in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    The optimizer may inline a projected expression into every place that uses it,
    including the body of a lambda, where it would run once per element. A lambda
    variable is always a plain value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions_where(items: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """1-based positions of the elements for which ``keep(element, index0)`` holds."""
    return F.array_compact(F.transform(items, lambda x, i: F.when(keep(x, i), i + 1)))


def slice_runs(items: Column, starts: Column, build: Callable[[Column, Column], Column]) -> Column:
    """Cut ``items`` at the 1-based ``starts``; ``build(run, index0)`` makes each output."""
    return F.transform(
        starts,
        lambda s, i: let(
            F.slice(items, s, F.coalesce(F.get(starts, i + 1), F.size(items) + 1) - s), lambda run: build(run, i)),
    )


def cut_and_join(items: Column, starts: Column, sep: str) -> Column:
    return slice_runs(items, starts, lambda run, _i: F.array_join(run, sep))


def grouped_counts(items: Column) -> Column:
    """``array<struct<item, n>>`` for an array of sortable items, ordered by item."""
    return let(
        F.array_sort(items),
        lambda a: let(
            positions_where(a, lambda x, i: (i == 0) | (F.get(a, i - 1) != x)),
            lambda starts: F.transform(
                starts,
                lambda s, i: F.struct(
                    F.get(a, s - 1).alias("item"),
                    (F.coalesce(F.get(starts, i + 1), F.size(a) + 1) - s).alias("n"))),
        ),
    )


def sorted_concat(rows: Column, field: str, sep: str) -> Column:
    """Join one field of an array of structs whose first field is the order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r[field]), sep)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])

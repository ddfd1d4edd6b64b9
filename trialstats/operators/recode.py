"""Row-wise recodes: condition labels, flags, trial numbers.

Every function returns a Column, so recodes fuse into the surrounding stage.
Assignments follow the data-frame rule of the original analysis: a write whose
condition is NULL is skipped, later writes win, unassigned rows stay NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Region labels per task, and their short forms.
UNDER = "Under-Constrained"
OVER = "Over-Constrained"
HARD_EASY = {
    "knapsack": ("Phase Transition - Hard", "Phase Transition - Easy"),
    "sat": ("Phase Transition - HARD", "Phase Transition - EASY"),
    "tsp": ("Phase Transition - hard", "Phase Transition - easy"),
}
SHORT_LABELS = {UNDER: "Under", "Phase Transition": "PT", OVER: "Over"}
# Trials that precede each block.
BLOCK_OFFSETS = {
    "knapsack": {1: 0, 2: 12},
    "sat": {1: 0, 2: 8, 3: 16},
    "tsp": {1: 0, 2: 9},
}


def assign(writes: Iterable[tuple[Column, Any]]) -> Column:
    """Sequential conditional writes to one new column, last write winning."""
    result = None
    for condition, value in reversed(list(writes)):
        result = F.when(condition, value) if result is None else result.when(condition, value)
    if result is None:
        raise ValueError("no writes given")
    return result


def in_phase_transition(kind: Column, inside: Iterable[float] = (3, 4)) -> Column:
    """"Yes" for instance types inside the transition, "No" otherwise and for NULL."""
    return F.when(kind.isin(*[float(k) for k in inside]), "Yes").otherwise("No")


def region(kind: Column, task: str = "knapsack") -> Column:
    """Region of an instance type: 3-4 hard, up to 2 easy, 5 over, 6 under."""
    hard, easy = HARD_EASY[task]
    return assign(
        [
            (kind.isin(3.0, 4.0), hard),
            (kind <= 2, easy),
            (kind == 5, OVER),
            (kind == 6, UNDER),
        ]
    )


def trimmed_region(kind: Column) -> Column:
    """Region rule of the re-analysis without outlier instances (half steps allowed)."""
    return assign(
        [
            (kind.isin(4.0, 4.5), "Phase Transition"),
            (kind.isin(3.0, 3.5), UNDER),
            (kind.isin(5.0, 5.5), OVER),
        ]
    )


def is_transition(label: Column, match: str = "canonical") -> Column:
    """Does a region label mean the phase transition?

    ``canonical`` accepts both sub-labels and the short form; ``exact`` compares
    with the bare label, which selects nothing once sub-labels are in use.
    """
    if match == "exact":
        return label == "Phase Transition"
    return label.startswith("Phase Transition") | (label == "PT")


def relabel(label: Column, match: str = "canonical", mapping: Mapping[str, str] = SHORT_LABELS) -> Column:
    """Short region labels; labels outside the mapping are kept."""
    if match == "exact":
        table = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
        return F.coalesce(table[label], label)
    plain = {k: v for k, v in mapping.items() if k != "Phase Transition"}
    return F.when(is_transition(label), mapping["Phase Transition"]).otherwise(
        relabel(label, "exact", plain)
    )


def difficulty(label: Column, match: str = "canonical") -> Column:
    """Under 1, Over 2, phase transition 3."""
    return assign(
        [
            (label.isin(UNDER, "Under"), 1.0),
            (label.isin(OVER, "Over"), 2.0),
            (is_transition(label, match), 3.0),
        ]
    )


def dummy(column: Column, value: Any) -> Column:
    """1 where equal, 0 where different, NULL where NULL."""
    return (column == value).cast("int")


def binary_map(column: Column, codes: Mapping[Any, int]) -> Column:
    """Listed values to their codes, everything else to NULL."""
    return assign([(column == value, code) for value, code in codes.items()])


def postgrad(years: Column) -> Column:
    """1 above three years of study, then 0 below four: 3.5 years ends as 0."""
    return assign([(years > 3, 1), (years < 4, 0)])


def multiple_strategies(total: Column) -> Column:
    """1 for more than one reported strategy, 0 otherwise, NULL for NULL."""
    return assign([(total <= 1, 0), (total > 1, 1)])


def trial_number(block: Column, trial: Column, offsets: Mapping[int, int]) -> Column:
    """Trial counter across blocks; NULL for a block without an offset."""
    return assign([(block == b, trial + F.lit(k)) for b, k in offsets.items()])


def learning_block(trial: Column, edges: tuple[int, int] = (6, 12)) -> Column:
    """Thirds of a session: trials up to the first edge, up to the second, later."""
    first, second = edges
    return assign([(trial > second, 3), ((trial > first) & (trial <= second), 2), (trial <= first, 1)])


def demographic_flags() -> dict[str, Column]:
    """The model covariates derived from the raw demographic columns."""
    c = F.col
    return {
        "Sex_Female": binary_map(c("Gender"), {"Female": 1, "Male": 0}),
        "PostGrad": postgrad(c("Years_of_study")),
        "Commerce": dummy(c("Degree"), "Commerce"),
        "Early_Afternoon": dummy(c("Time_of_day"), "Early_Afternoon"),
        "Late_Afternoon": dummy(c("Time_of_day"), "Late_Afternoon"),
        "MultipleStrategies": multiple_strategies(c("Total")),
    }

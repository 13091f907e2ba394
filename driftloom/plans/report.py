"""Results for people and files: tables of text, JSON, CSV and figures, from small collected results.

A result is a dictionary of individuals and of their day pairs. Tables are laid out from lists of
fields, so what a table says is data: a heading, where the value comes from, and how it is written.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.plans.analysis import Analysis, AnalysisConfig, per_bird_drift
from driftloom.sources.files import read_text, write_text

Field = tuple[str, Callable[[dict], Any], str]


def standardised(x: float | None, scale: float | None) -> float | None:
    return None if x is None or not scale else x / scale


#: Measures of a day pair: its value, the individual's floor for it, and the types over that floor.
MEASURES: dict[str, tuple[str, Callable[[dict], float | None], str]] = {
    "centroid": ("centroid_drift_standardised", lambda b: standardised(b["centroid_floor"], b["within_type_variance"]), "n_types_exceeding_centroid_floor"),
    "dispersion": ("dispersion_drift", lambda b: b["dispersion_floor"], "n_types_exceeding_dispersion_floor"),
    "syntax": ("syntax_divergence", lambda b: b["syntax_floor"], "syntax_exceeds_floor"),
}
INDIVIDUALS: tuple[Field, ...] = (
    ("individual", lambda b: b["bird"], "s"),
    ("renditions", lambda b: b["n_syllables"], "d"),
    ("bouts", lambda b: b["n_bouts"], "d"),
    ("days", lambda b: b["n_days"], "d"),
    ("types", lambda b: len(b["types"]), "d"),
    *((f"{name} floor", floor, ".4f") for name, (_, floor, _) in MEASURES.items()),
)
PAIRS: tuple[Field, ...] = (
    ("individual", lambda p: p["bird"], "s"),
    ("from", lambda p: str(p["day_a"]), "s"),
    ("to", lambda p: str(p["day_b"]), "s"),
    ("types", lambda p: p["n_types"], "d"),
    *((heading, (lambda p, c=column: p[c]), form) for name, (value, _, over) in MEASURES.items()
      for heading, column, form in ((name, value, "+.4f"), ("over", over, "d"))),
)
COMPARISON: tuple[Field, ...] = tuple(
    (heading, (lambda c, k=key: c.get(k)), form)
    for heading, key, form in (
        ("treated", "n_treated", "d"), ("control", "n_control", "d"), ("difference", "observed_difference", "+.4f"), ("from", "ci_low", "+.4f"),
        ("to", "ci_high", "+.4f"), ("p", "p_value", ".4f"), ("alternative", "alternative", "s"), ("sd between", "between_sd", ".4f"),
        ("sd within", "within_sd", ".4f"), ("limit", "limiting_factor", "s"),
    )
)


def written(x: Any, form: str) -> str:
    return "-" if x is None or isinstance(x, float) and math.isnan(x) else format(int(x) if form == "d" else x, form)


def laid_out(rows: Iterable[dict], fields: Sequence[Field]) -> str:
    """A table in columns, numbers to the right."""
    cells = [[heading for heading, _, _ in fields], *([written(get(r), form) for _, get, form in fields] for r in rows)]
    widths = [max(map(len, column)) for column in zip(*cells)]
    lines = ("  ".join(c.ljust(w) if form == "s" else c.rjust(w) for c, w, (_, _, form) in zip(row, widths, fields)) for row in cells)
    return "\n".join(line.rstrip() for line in lines)


def collected(analysis: Analysis, config: AnalysisConfig) -> dict:
    """{config, birds: {name: fields and day_pairs}}: one entry per individual and day pair.

    What comes to the driver is a result to be read: as many rows as individuals have pairs of days.
    For a table of many individuals write ``analysis.pairs`` instead.
    """
    birds = {r["bird"]: {**r.asDict(recursive=True), "day_pairs": []} for r in analysis.birds.orderBy("bird").collect()}
    for r in analysis.pairs.orderBy("bird", "day_a", "day_b").toLocalIterator():
        pair = r.asDict()
        birds[pair.pop("bird")]["day_pairs"].append(pair)
    return {"config": config.to_dict(), "birds": birds}


def summary(result: dict) -> str:
    """The individuals with their floors, then their day pairs."""
    pairs = ({"bird": name, **p} for name, b in result["birds"].items() for p in b["day_pairs"])
    return laid_out(({"bird": name, **b} for name, b in result["birds"].items()), INDIVIDUALS) + "\n\n" + laid_out(pairs, PAIRS)


def comparison_text(comparison: dict) -> str:
    return laid_out([comparison], COMPARISON)


def write_json(result: dict | list, path: str, spark: SparkSession | None = None) -> None:
    write_text(json.dumps(result, indent=1, default=str), path, spark)


def read_json(path: str, spark: SparkSession | None = None) -> dict | list:
    """A result as ``write_json`` left it; dates are texts."""
    return json.loads(read_text(path, spark))


def study_rows(study: DataFrame, most: int = 100_000) -> list[dict]:
    """The rows of a study for its JSON file; a study of more rows than ``most`` is an error, and belongs in a table."""
    rows = study.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write the study as a table")
    return [r.asDict(recursive=True) for r in rows]


def write_drift(analysis: Analysis, path: str, spark: SparkSession | None = None) -> None:
    """A CSV of bird and drift, one row per individual."""
    rows = per_bird_drift(analysis).orderBy("bird").toLocalIterator()
    write_text("bird,drift\n" + "".join(f"{r['bird']},{'' if r['drift'] is None else r['drift']}\n" for r in rows), path, spark)


def with_groups(drift: DataFrame, groups: DataFrame) -> DataFrame:
    """Per-individual drift with each one's group, which the comparison needs."""
    return drift.join(groups.select("bird", "group").distinct(), "bird")


def over_floor(pairs: DataFrame, individuals: DataFrame) -> DataFrame:
    """bird, day_a, day_b, measure, value, floor, over: the day pairs in long form, for tables and figures of any size."""
    scale = F.nullif(F.col("within_type_variance"), F.lit(0.0))
    floors = {"centroid": F.col("centroid_floor") / scale, "dispersion": F.col("dispersion_floor"), "syntax": F.col("syntax_floor")}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(MEASURES[m][0]).alias("value"), f.alias("floor")) for m, f in floors.items()]))
    rows = pairs.join(individuals.select("bird", "within_type_variance", "centroid_floor", "dispersion_floor", "syntax_floor"), "bird")
    rows = rows.select("bird", "day_a", "day_b", each.alias("e")).select("bird", "day_a", "day_b", "e.*")
    # a change of dispersion may go either way; a distance over its floor is one that is larger
    size = F.when(F.col("measure") == "dispersion", F.abs("value")).otherwise(F.col("value"))
    return rows.withColumn("over", size > F.col("floor"))


def _panels(n: int) -> list:
    import matplotlib.pyplot as plt

    columns = min(3, n)
    grid = plt.subplots(-(-n // columns), columns, squeeze=False, sharey=True, layout="constrained", figsize=(3.2 * columns, 2.4 * -(-n // columns)))[1]
    return list(grid.flat)


def draw_drift(result: dict, measure: str = "centroid", panels: Callable[[int], list] = _panels) -> list:
    """A small panel for each individual: its day pairs as spans from day to day at their value, and the band within the floor."""
    if measure not in MEASURES:
        raise ValueError(f"no measure is called {measure!r}; there are {', '.join(MEASURES)}")
    value, floor, _ = MEASURES[measure]
    axes = panels(max(1, len(result["birds"])))
    for ax, (name, b) in zip(axes, result["birds"].items()):
        band = floor(b)
        both = measure == "dispersion"  # the only one that may change either way
        if band is not None:
            ax.axhspan(-band if both else 0, band, alpha=0.2)
        for p in b["day_pairs"]:
            if p[value] is not None:
                over = band is not None and (abs(p[value]) if both else p[value]) > band
                ax.plot([str(p["day_a"]), str(p["day_b"])], [p[value]] * 2, "-" if over else ":")
        ax.set_title(f"{name}: {measure}")
    return axes


def draw_least(least: dict[str, dict[int, float | None]], panels: Callable[[int], list] = _panels) -> list:
    """A panel for each measure: a bar for the least effect that so many bouts would show; none where no effect is reached."""
    if not any(least.values()):
        raise ValueError("there is no effect to draw")
    axes = panels(len(least))
    for ax, (name, by_bouts) in zip(axes, least.items()):
        shown = {n: e for n, e in sorted(by_bouts.items()) if e is not None}
        ax.bar([str(n) for n in shown], list(shown.values()))
        ax.set_title(f"{name}: least effect by bouts")
    return axes


def draw_curves(rows: Iterable[dict], panel: str, series: str, x: str, y: str, panels: Callable[[int], list] = _panels) -> list:
    """A panel for each value of ``panel``, in it a line for each value of ``series``: ``y`` over ``x`` in order.

    For what changes with a number: the least effect by bouts, the distance to a reference by day, a rank
    correlation by dimensions. Rows are those of a study (``study_rows``); rows without x or y are left out.
    """
    lines: dict[Any, dict[Any, list]] = {}
    for r in rows:
        of = lines.setdefault(r[panel], {}).setdefault(r[series], [])
        if r[x] is not None and r[y] is not None:
            of.append((r[x], r[y]))
    if not any(of for each in lines.values() for of in each.values()):
        raise ValueError(f"no row has {x} and {y}")
    axes = panels(len(lines))
    for ax, name in zip(axes, sorted(lines, key=str)):
        for key in sorted(lines[name], key=str):
            points = sorted(lines[name][key])
            if points:
                ax.plot([a for a, _ in points], [b for _, b in points], "o-", label=str(key))
        ax.set_title(str(name))
        ax.set_xlabel(x)
        ax.set_ylabel(y)
        ax.legend()
    return axes


def day_square(day_pairs: Iterable[dict], value: str) -> tuple[list[str], list[list[float]]]:
    """The days in order, and the value of each pair of days as a symmetric square; not a number where there is none, as on the diagonal."""
    pairs = {(str(p["day_a"]), str(p["day_b"])): p[value] for p in day_pairs}
    days = sorted({d for pair in pairs for d in pair})

    def at(a: str, b: str) -> float:
        found = pairs.get((a, b), pairs.get((b, a)))
        return math.nan if found is None else found

    return days, [[at(a, b) for b in days] for a in days]


def draw_matrices(result: dict, measure: str = "centroid", panels: Callable[[int], list] = _panels) -> list:
    """A panel for each individual: the square of its days, each pair's value as a colour, with the floor in the title."""
    if measure not in MEASURES:
        raise ValueError(f"no measure is called {measure!r}; there are {', '.join(MEASURES)}")
    value, floor, _ = MEASURES[measure]
    axes = panels(max(1, len(result["birds"])))
    for ax, (name, b) in zip(axes, result["birds"].items()):
        days, square = day_square(b["day_pairs"], value)
        if days:
            ax.imshow(square)
            ax.set_xticks(range(len(days)), days, rotation=90)
            ax.set_yticks(range(len(days)), days)
        ax.set_title(f"{name}: {measure}, floor {written(floor(b), '.4f')}")
    return axes

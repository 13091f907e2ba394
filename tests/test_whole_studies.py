"""Studies see all days, with the operators' own numbers of draws."""

import inspect

import pytest

from driftloom.operators import groups
from driftloom.plans import analysis, catalogue, studies
from driftloom.plans import tables as T

SF = "/root/testdata/sf0.001"


class Called(Exception):
    pass


def call(monkeypatch, spark, module, function, name):
    """The arguments that the query ``name`` gives ``function``, defaults among them."""
    of = inspect.signature(getattr(module, function))
    seen = {}

    def spy(*args, **more):
        bound = of.bind(*args, **more)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Called

    monkeypatch.setattr(module, function, spy)
    with pytest.raises(Called):
        catalogue.QUERIES[name](spark, SF)
    return seen


def days(df):
    return {r[0] for r in df.select("day").distinct().collect()}


@pytest.mark.parametrize(
    "module,function,name",
    [(studies, "sensitivity", "sensitivity_table"), (studies, "dispersion_sensitivity", "dispersion_sensitivity_table"),
     (analysis, "analyse_points", "drift_against_floors")],
)
def test_all_days_and_draws(monkeypatch, spark, module, function, name):
    seen = call(monkeypatch, spark, module, function, name)
    assert days(seen["points"]) == days(T.events(spark, SF))
    if "n_draws" in seen:
        assert seen["n_draws"] == 400 and seen.get("n_subsets", 5) == 5
    else:
        config = next(x for x in seen.values() if isinstance(x, analysis.AnalysisConfig))
        assert (config.n_boot, config.n_null) == (400, 300)


def test_birds_needed_simulates_all(monkeypatch, spark):
    seen = call(monkeypatch, spark, groups, "power_by_size", "birds_needed")
    assert (seen["max_n"], seen["n_simulations"], seen["n_permutations"]) == (40, 400, 2000)

"""Registered queries: models written as formulas, with interactions."""

from __future__ import annotations

from trialstats.models import formula
from trialstats.plans import bindings as b
from trialstats.plans import sqltext
from trialstats.plans.queries_models import LEVELS, mixed_table, model_frame, tidy
from trialstats.plans.registry import query

PT = "InPhaseTransitionYes"
# name: (formula, family, terms in SQL)
FORMULAS = {
    "formula_ols_interaction": ("TimeOnTask ~ InPhaseTransition * propagations", "gaussian", [PT, "propagations", f"{PT}:propagations"]),
    "formula_ols_powers": (
        "TimeOnTask ~ (InPhaseTransition + TrialNumber + correct)^2 - TrialNumber:correct", "gaussian",
        [PT, "TrialNumber", "correct", f"{PT}:TrialNumber", f"{PT}:correct"],
    ),
    "formula_logit_interaction": ("correct ~ InPhaseTransition * TrialNumber", "binomial", [PT, "TrialNumber", f"{PT}:TrialNumber"]),
    "formula_lmm_interaction": (
        "TimeOnTask ~ InPhaseTransition * TrialNumber + (1 | participant_id)", "gaussian", [PT, "TrialNumber", f"{PT}:TrialNumber"],
    ),
}


def _register() -> None:
    for name, (text, family, terms) in FORMULAS.items():
        spec = formula.parse(text, name, family)
        if spec.group:
            sql = sqltext.lmm(name, b.SQL_ANALYSIS, spec.outcome, spec.group, terms)
        else:
            sql = (sqltext.ols if family == "gaussian" else sqltext.logit)(name, b.SQL_ANALYSIS, spec.outcome, terms)

        def run(spark, d, name=name, text=text, family=family, spec=spec):
            fits = formula.fit(model_frame(spark, d, [spec]), {name: text}, family, LEVELS)
            return mixed_table(spark, fits) if spec.group else tidy(spark, fits)

        query(name, sql)(run)


_register()

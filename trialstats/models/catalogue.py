"""The regression models of the analysis, as specifications.

Each family is a main predictor combined with named sets of controls.  The sets
differ by task only where the tasks record different strategies or where a
hand-picked mix was used.
"""

from __future__ import annotations

from trialstats.models.spec import ModelSpec

PARTICIPANT = "participant_id"

# Predictors of each control set, per task.
DEMOGRAPHICS = ("Sex_Female", "Age", "PostGrad", "Commerce", "Early_Afternoon", "Late_Afternoon")
STRATEGIES = {
    "knapsack": ("Greedy", "Feasible", "Large_Items", "Prioritising_Properties"),
    "sat": ("Process_Elimination", "Brute_Force", "Uniform_Signs"),
    "tsp": ("Convex_Hull", "Nearest_Neighbour"),
}
ACCURACY_SIG = {
    "knapsack": ("Greedy", "Prioritising_Properties", "MultipleStrategies", "Sex_Female", "PostGrad"),
    "sat": ("MultipleStrategies", "TrialNumber", "Sex_Female", "Early_Afternoon", "Late_Afternoon"),
    "tsp": ("MultipleStrategies", "Age"),
}
ACCURACY_ALL = {
    "knapsack": ("Greedy", "Prioritising_Properties", "MultipleStrategies", *DEMOGRAPHICS),
    "sat": ("MultipleStrategies", "TrialNumber", *DEMOGRAPHICS),
    "tsp": ("MultipleStrategies", *DEMOGRAPHICS),
}
TIME_SIG = {
    "knapsack": (
        "Greedy", "MultipleStrategies", "TrialNumber", "Commerce", "Early_Afternoon", "Late_Afternoon", "PostGrad",
    ),
    "sat": (
        "Process_Elimination", "Brute_Force", "MultipleStrategies", "TrialNumber", "Early_Afternoon",
        "Late_Afternoon", "PostGrad",
    ),
}
TIME_ALL = {
    "knapsack": ("Greedy", "MultipleStrategies", "TrialNumber", *DEMOGRAPHICS),
    "sat": ("MultipleStrategies", "Process_Elimination", "Brute_Force", "TrialNumber", *DEMOGRAPHICS),
    "tsp": ("MultipleStrategies", "Convex_Hull", "TrialNumber", *DEMOGRAPHICS),
}
# The mixed time models use shorter mixes.
TIME_MIXED_SIG = {"knapsack": ("MultipleStrategies", "TrialNumber")}
TIME_MIXED_ALL = {
    "knapsack": ("MultipleStrategies", "TrialNumber", *DEMOGRAPHICS),
    "sat": ("MultipleStrategies", "TrialNumber", *DEMOGRAPHICS),
    "tsp": ("Convex_Hull", "MultipleStrategies", "TrialNumber", *DEMOGRAPHICS),
}
TIME_SLOPE_ALL = {
    "knapsack": ("MultipleStrategies", "TrialNumber", *DEMOGRAPHICS),
    "sat": ("MultipleStrategies", "TrialNumber", *DEMOGRAPHICS),
    "tsp": ("MultipleStrategies", "Convex_Hull", "TrialNumber", *DEMOGRAPHICS),
}
TIME_DIFFICULTY_ALL = {
    "knapsack": ("MultipleStrategies", "TrialNumber", *DEMOGRAPHICS),
    "sat": ("MultipleStrategies", "TrialNumber", "Brute_Force", *DEMOGRAPHICS),
    "tsp": ("MultipleStrategies", "TrialNumber", "Convex_Hull", *DEMOGRAPHICS),
}
DECISIONS_SIG = (*STRATEGIES["knapsack"], "MultipleStrategies", "Sex_Female", "PostGrad")
DECISIONS_ALL = (*STRATEGIES["knapsack"], "MultipleStrategies", *DEMOGRAPHICS)

SHORT = {
    "InPhaseTransition": "PT",
    "propagations": "prop",
    "Difficulty": "type",
    "decisions": "dec",
    "TimeOnTask": "time",
}
MAIN = {short: main for main, short in SHORT.items()}
TASKS = ("knapsack", "sat", "tsp")


def controls(task: str, outcome: str, kind: str, main: str) -> dict[str, tuple[str, ...]]:
    """Control sets that apply to one family of models; ``kind`` is fe, me or mes."""
    strategies = STRATEGIES[task]
    # Some families add the number of strategies to the strategy flags.
    joint = (
        main in ("Difficulty", "decisions")
        or (task == "knapsack" and kind == "fe")
        or (task != "knapsack" and kind == "me")
    )
    accuracy = outcome == "correct"
    sets: dict[str, tuple[str, ...]] = {
        "": (),
        "learn": ("TrialNumber",),
        "strat": (*strategies, "MultipleStrategies") if joint else strategies,
        "mstrat": ("MultipleStrategies",),
        "dem": DEMOGRAPHICS,
    }
    if main == "decisions" and accuracy:
        sets["sig"], sets["all"] = DECISIONS_SIG, DECISIONS_ALL
    elif accuracy:
        sets["sig"], sets["all"] = ACCURACY_SIG[task], ACCURACY_ALL[task]
    elif kind == "fe":
        sets["sig"], sets["all"] = TIME_SIG.get(task, ()), TIME_ALL[task]
    elif kind == "me":
        sets["sig"], sets["all"] = TIME_MIXED_SIG.get(task, ()), TIME_MIXED_ALL[task]
    else:
        sets["all"] = (TIME_DIFFICULTY_ALL if main == "Difficulty" else TIME_SLOPE_ALL)[task]
    return {k: v for k, v in sets.items() if v or not k}


def spec(task: str, outcome: str, kind: str, main: str, control: str = "") -> ModelSpec:
    """One model: outcome acc or time, kind fe / me / mes, main predictor, control set."""
    column = "correct" if outcome == "acc" else "TimeOnTask"
    extra = controls(task, column, kind, main)[control]
    name = "_".join(x for x in (outcome, kind, SHORT[main], control) if x)
    return ModelSpec(
        name=name,
        outcome=column,
        fixed=(main, *extra),
        family="binomial" if outcome == "acc" else "gaussian",
        group=None if kind == "fe" else PARTICIPANT,
        slope=main if kind == "mes" else None,
    )


# Which models each task fits, as
# (outcome, kind, main predictor): the control sets.
NONE_LEARN_STRAT_MSTRAT = ("", "learn", "strat", "mstrat")
EVERY = (*NONE_LEARN_STRAT_MSTRAT, "dem", "sig", "all")
FAMILIES = {
    "knapsack": {
        ("acc", "fe", "PT"): ("", "learn", "strat", "dem", "sig", "all"),
        ("acc", "me", "PT"): EVERY,
        ("acc", "mes", "PT"): EVERY,
        ("acc", "mes", "type"): ("", "learn", "strat", "dem", "sig", "all"),
        ("acc", "me", "prop"): NONE_LEARN_STRAT_MSTRAT,
        ("acc", "mes", "prop"): ("dem", "sig", "all"),
        ("acc", "mes", "dec"): ("", "learn", "strat", "dem", "sig", "all"),
        ("time", "fe", "PT"): ("", "learn", "strat", "dem", "sig", "all"),
        ("time", "me", "PT"): EVERY,
        ("time", "mes", "PT"): ("", "learn", "strat", "mstrat", "dem", "all"),
        ("time", "mes", "type"): ("", "learn", "strat", "dem", "all"),
        ("time", "me", "prop"): NONE_LEARN_STRAT_MSTRAT,
        ("time", "mes", "prop"): ("dem", "all"),
        ("time", "mes", "dec"): ("", "learn", "strat", "dem", "all"),
    },
    "sat": {
        ("acc", "fe", "PT"): ("", "learn", "strat", "mstrat", "dem", "all"),
        ("acc", "fe", "prop"): ("", "strat", "mstrat"),
        ("acc", "me", "PT"): ("", "learn", "strat", "dem", "sig", "all"),
        ("acc", "mes", "PT"): EVERY,
        ("acc", "mes", "type"): ("", "learn", "strat", "dem", "sig", "all"),
        ("time", "fe", "PT"): ("", "learn", "strat", "mstrat", "sig", "all"),
        ("time", "fe", "prop"): ("", "strat", "mstrat"),
        ("time", "me", "PT"): ("", "learn", "strat", "dem", "all"),
        ("time", "mes", "PT"): ("", "learn", "strat", "mstrat", "dem", "all"),
        ("time", "mes", "type"): ("", "learn", "strat", "dem", "all"),
    },
    "tsp": {
        ("acc", "fe", "PT"): EVERY,
        ("acc", "fe", "prop"): NONE_LEARN_STRAT_MSTRAT,
        ("acc", "me", "PT"): ("", "learn", "strat", "dem", "sig", "all"),
        ("acc", "mes", "PT"): EVERY,
        ("acc", "mes", "type"): ("", "learn", "strat", "dem", "sig", "all"),
        ("time", "fe", "PT"): ("", "learn", "strat", "mstrat", "dem", "all"),
        ("time", "fe", "prop"): NONE_LEARN_STRAT_MSTRAT,
        ("time", "me", "PT"): ("", "learn", "strat", "dem", "all"),
        ("time", "mes", "PT"): ("", "learn", "strat", "mstrat", "dem", "all"),
        ("time", "mes", "type"): ("", "learn", "strat", "dem", "all"),
    },
}
# Models of accuracy on time, on subsets of the trials.
TIME_SUBSETS = {
    "knapsack": ("Yes", "No", "all", "Under", "Over", "PT"),
    "sat": ("Yes", "No", "all", "Under", "Over", "PT"),
    "tsp": ("Yes", "No", "Under", "Over", "PT"),
}
# Models fitted only on the trials after the sixth.
POST_LEARNING = {"sat": ("acc_mes_PT",), "tsp": ("time_mes_PT_dem", "time_mes_PT_all")}
ACCURACY_ON_TIME = ModelSpec("acc_time", "correct", ("TimeOnTask",), "binomial")


def specs(task: str) -> list[ModelSpec]:
    """All models of a task on the full trial table."""
    out = []
    for (outcome, kind, short), sets in FAMILIES[task].items():
        out += [spec(task, outcome, kind, MAIN[short], control) for control in sets]
    return out

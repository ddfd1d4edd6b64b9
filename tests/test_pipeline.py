"""Log folders to analysis table to summaries, tests and models, for all three tasks."""

import pytest
from pyspark.sql import functions as F

from trialstats.inference import significance as sig
from trialstats.models.glmm import fit_glmm
from trialstats.models.logit import fit_logit
from trialstats.models.ols import fit_ols
from trialstats.models.spec import ModelSpec
from trialstats.operators import recode, summaries
from trialstats.plans import pipeline
from trialstats.plans.pipeline import Experiment

PEOPLE = ("p01", "p02", "p03", "p04")
BLOCKS = {"knapsack": 2, "sat": 3, "tsp": 2}
TRIALS = 3


def instance(person, block, trial):
    return 1 + (PEOPLE.index(person) + 2 * block + trial) % 6


def answer(person, block, trial):
    return (PEOPLE.index(person) * block + trial * trial) % 3 != 0


def seconds(person, block, trial):
    return 2.0 + PEOPLE.index(person) + 0.5 * block + 0.25 * trial


def write_logs(folder, task):
    """One participant's last event is a trial, so that trial has no duration."""
    for person in PEOPLE:
        info = ["session notes", "block;trial;instanceNumber;correct;extra;randomYes(1=Left No/Right Yes)"]
        clock, times = 0.0, ["session", "notes"]
        times.append("block;trial;instanceNumber;eventType;elapsedTime" if task == "sat" else "block;trial;eventType;elapsedTime")
        for block in range(1, BLOCKS[task] + 1):
            for trial in range(1, TRIALS + 1):
                number = instance(person, block, trial)
                info.append(f"{block};{trial};{number};{int(answer(person, block, trial))};x;{number % 2}")
                times.append(f"{block};{trial};Trial;{clock}")
                clock += 1000 * seconds(person, block, trial)
                times.append(f"{block};{trial};Rest;{clock}")
                clock += 700
        if person == "p04":
            times.pop()
        instances = ["notes", "instanceNumber;type;size"] + [f"{k};{k};10" for k in range(1, 7)]
        for name, lines in (("TrialInfo", info), ("TimeStamps", times), ("InstancesInfo", instances)):
            (folder / f"{person}_{task}_{name}.txt").write_text("\n".join(lines) + "\n\n")


def write_tables(folder, task):
    strategies = pipeline.STRATEGY_HEADERS[task].values()
    lines = [",".join(["Total", "ParticipantID", "Gender", "Age", "Years_of_study", "Degree", "Time_of_day", *strategies])]
    for i, person in enumerate(PEOPLE):
        flags = [str((i >> k) & 1) for k, _ in enumerate(strategies)]
        lines.append(
            ",".join([str(i), person, ["Female", "Male"][i % 2], str(20 + i), str(2 + i), ["Commerce", "Arts"][i // 2], ["Early_Afternoon", "Late_Afternoon", "Morning", "NA"][i], *flags])
        )
    (folder / "Demographics.csv").write_text("\n".join(lines) + "\n")
    (folder / "Complexity.csv").write_text(
        "instanceNumber,propagations,decisions\n" + "".join(f"{k},{k * 100},{k * 7}\n" for k in range(1, 7))
    )


@pytest.fixture(scope="module", params=["knapsack", "sat", "tsp"])
def built(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp(request.param)
    write_logs(folder, request.param)
    write_tables(folder, request.param)
    e = Experiment(request.param, str(folder), str(folder / "Demographics.csv"), str(folder / "Complexity.csv"))
    return request.param, pipeline.analysis(spark, e).persist()


def test_analysis_table(built):
    task, df = built
    rows = {(r["participant_id"], r["block"], r["trial"]): r for r in df.collect()}
    assert len(rows) == df.count() == len(PEOPLE) * BLOCKS[task] * TRIALS
    hard, easy = recode.HARD_EASY[task]
    region = {1: easy, 2: easy, 3: hard, 4: hard, 5: "Over-Constrained", 6: "Under-Constrained"}
    last = ("p04", BLOCKS[task], TRIALS)
    for (person, block, trial), r in rows.items():
        number = instance(person, block, trial)
        assert (r["instanceNumber"], r["type"]) == (number, float(number))
        assert r["correct"] == float(answer(person, block, trial)) and r["randomYes"] == number % 2
        if (person, block, trial) == last:
            assert r["TimeOnTask"] is None
        else:
            assert r["TimeOnTask"] == pytest.approx(seconds(person, block, trial))
        assert (r["propagations"], r["decisions"]) == (number * 100, number * 7)
        assert r["Region"] == region[number] and r["InPhaseTransition"] == ("Yes" if number in (3, 4) else "No")
        assert r["Difficulty"] == {5: 2.0, 6: 1.0}.get(number, 3.0)
        assert r["TrialNumber"] == trial + recode.BLOCK_OFFSETS[task][block]


def test_participant_covariates(built):
    task, df = built
    people = {r["participant_id"]: r for r in df.dropDuplicates(["participant_id"]).collect()}
    assert [people[p]["Sex_Female"] for p in PEOPLE] == [1, 0, 1, 0]
    assert [people[p]["PostGrad"] for p in PEOPLE] == [0, 0, 1, 1]
    assert [people[p]["Commerce"] for p in PEOPLE] == [1, 1, 0, 0]
    assert [people[p]["Early_Afternoon"] for p in PEOPLE] == [1, 0, 0, None]
    assert [people[p]["MultipleStrategies"] for p in PEOPLE] == [0, 0, 1, 1]
    first = next(iter(pipeline.STRATEGY_HEADERS[task]))
    assert [people[p][first] for p in PEOPLE] == [0, 1, 0, 1]


def test_summaries_and_models_run_on_it(built):
    _, df = built
    done = df.filter(F.col("TimeOnTask").isNotNull())
    groups = {r["InPhaseTransition"]: r for r in summaries.group_summary(done, ["InPhaseTransition"], "correct").collect()}
    yes = [r["correct"] for r in done.filter("InPhaseTransition = 'Yes'").collect()]
    assert groups["Yes"]["n"] == len(yes) and groups["Yes"]["mean"] == pytest.approx(sum(yes) / len(yes))
    assert sig.chi2_test(done.filter("type <= 4"), "InPhaseTransition", "correct").first()["n"] > 0
    (ols,) = fit_ols(df, [ModelSpec("time", "TimeOnTask", ("InPhaseTransition", "TrialNumber"))])
    assert ols.n == done.count() and ols.terms[1] == "InPhaseTransitionYes"
    (logit,) = fit_logit(df, [ModelSpec("acc", "correct", ("InPhaseTransition",), "binomial")])
    mixed = fit_glmm(df, ModelSpec("acc", "correct", ("InPhaseTransition",), "binomial", group="participant_id"))
    assert mixed.stats["loglik"] >= logit.stats["loglik"] - 1e-6

"""From a folder of participant logs to the analysis table of one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.operators import recode
from trialstats.operators.joins import natural_join, trials_with_instances
from trialstats.operators.timing import time_on_task
from trialstats.sources import delimited, tables

TRIAL_EVENT = "Trial"

# Header names in the logs and the questionnaire.
RANDOM_YES = "randomYes.1.Left.No.Right.Yes."
STRATEGY_HEADERS = {
    "knapsack": {
        "Greedy": "Greedy",
        "Feasible": "Feasible.with.all.Items",
        "Large_Items": "Large.Items..money.",
        "Prioritising_Properties": "Prioritising.one.property",
    },
    "sat": {
        "Process_Elimination": "Mode.literal...Elimination",
        "Brute_Force": "Brute.Force",
        "Uniform_Signs": "All..ve..ve",
    },
    "tsp": {"Convex_Hull": "Convex.Hull", "Nearest_Neighbour": "Nearest.Neighbour"},
}

TRIALS = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("trial", T.IntegerType()),
        T.StructField("instanceNumber", T.LongType()),
        T.StructField("correct", T.DoubleType()),
        T.StructField("randomYes", T.IntegerType()),
    ]
)
INSTANCES = T.StructType([T.StructField("instanceNumber", T.LongType()), T.StructField("type", T.DoubleType())])
TIMES = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("trial", T.IntegerType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("elapsedTime", T.DoubleType()),
    ]
)
# Logs of the sat task name one column too many: events sit under
# instanceNumber and times under eventType.
SHIFTED_TIMES = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("trial", T.IntegerType()),
        T.StructField("instanceNumber", T.StringType()),
        T.StructField("eventType", T.DoubleType()),
    ]
)
SHIFTS = {"eventType": "elapsedTime", "instanceNumber": "eventType"}


@dataclass(frozen=True)
class Experiment:
    """Where one task's files are and how its labels and logs are laid out.

    ``folder`` holds all logs, or names a folder for each kind of log.
    """

    task: str
    folder: str | dict[str, str]
    demographics: str | None = None
    complexity: str | None = None

    @property
    def shifted_header(self) -> bool:
        return self.task == "sat"


def _logs(spark: SparkSession, e: Experiment, kind: str, schema: T.StructType, mapping=None) -> DataFrame:
    path = delimited.log_glob(e.folder if isinstance(e.folder, str) else e.folder[kind], kind)
    return delimited.read_delimited(spark, path, schema, skip=delimited.PREAMBLE[kind], mapping=mapping)


def durations(spark: SparkSession, e: Experiment) -> DataFrame:
    """Seconds spent on each trial, from the time-stamp logs."""
    if e.shifted_header:
        events = delimited.repair_header(_logs(spark, e, "times", SHIFTED_TIMES), SHIFTS)
    else:
        events = _logs(spark, e, "times", TIMES)
    timed = time_on_task(events).filter(F.col("eventType") == TRIAL_EVENT)
    return timed.select("participant_id", "block", "trial", "TimeOnTask")


def trials(spark: SparkSession, e: Experiment) -> DataFrame:
    """One row per trial with its instance type, duration and, if known, complexity."""
    info = _logs(spark, e, "trials", TRIALS, {"randomYes": RANDOM_YES}).drop("path", "line_no")
    instances = _logs(spark, e, "instances", INSTANCES).select("instanceNumber", "type")
    out = natural_join(trials_with_instances(info, instances), durations(spark, e).dropDuplicates())
    if e.complexity:
        out = natural_join(out, tables.load_complexity(spark, e.complexity))
    return out


def participants(spark: SparkSession, e: Experiment) -> DataFrame:
    """Model covariates per participant from the questionnaire."""
    strategies = STRATEGY_HEADERS[e.task]
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in ("ParticipantID", "Gender", "Degree", "Time_of_day")]
        + [T.StructField(c, T.DoubleType()) for c in ("Age", "Years_of_study", "Total", *strategies.values())]
    )
    raw = tables.read_csv(spark, e.demographics, schema)
    flags = recode.demographic_flags()
    renamed = raw.withColumns(flags).withColumnsRenamed({h: n for n, h in strategies.items()})
    return renamed.select(F.col("ParticipantID").alias("participant_id"), "Age", *flags, *strategies)


def analysis(spark: SparkSession, e: Experiment) -> DataFrame:
    """The table all summaries, tests and models of a task start from."""
    out = trials(spark, e)
    kind = F.col("type")
    out = out.withColumns(
        {
            "TrialNumber": recode.trial_number(F.col("block"), F.col("trial"), recode.BLOCK_OFFSETS[e.task]),
            "InPhaseTransition": recode.in_phase_transition(kind),
            "Region": recode.region(kind, e.task),
        }
    ).withColumn("Difficulty", recode.difficulty(F.col("Region")))
    if e.demographics:
        out = natural_join(out, participants(spark, e))
    return out

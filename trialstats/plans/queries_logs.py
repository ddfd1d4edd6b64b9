"""Registered queries that go through files: the tables laid out as an experiment's logs, and written summaries.

events become the time-stamp and trial logs of their users, part the instance logs
and the complexity table, customer the questionnaire.  The k-th event of a user is
trial k // 3 + 1 of block k % 3 + 1, so trials are told apart however many there are.
Everything is written below the shared folder, one folder for each run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialstats import runtime
from trialstats.operators import summaries
from trialstats.plans import bindings as b
from trialstats.plans import pipeline
from trialstats.plans.queries_data import _SQL_SUMMARY, rounded
from trialstats.plans.registry import query
from trialstats.sources import delimited, sink

# Logs that the instances are dealt over.
INSTANCE_LOGS = 16
# Trials are about the first instances, as every size of the tables has these.
INSTANCES_SEEN = 200
SOLVED_FROM = 25.0
RANDOM_YES_HEADER = "randomYes(1=Left No/Right Yes)"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{runtime.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _log_name(owner, kind: str):
    return F.concat(owner.cast("string"), F.lit(f"_{b.TASK}_{delimited.LOG_KINDS[kind]}"))


def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the block and trial that their place in the user's log gives them."""
    place = F.row_number().over(W.partitionBy("participant_id").orderBy("line_no")) - 1
    values = b.table(spark, d, "events").select(F.col("event_id").alias("line_no"), "value")
    events = b.time_stamps(spark, d).join(values, "line_no")
    return events.withColumn("__k", place).withColumns(
        {"block": F.col("__k") % 3 + 1, "trial": F.floor(F.col("__k") / 3) + 1}
    ).drop("__k")


def write_instance_logs(spark: SparkSession, d: str, path: str) -> str:
    instances = b.instance_info(spark, d)
    named = instances.withColumn("file", _log_name(F.concat(F.lit("i"), F.col("instanceNumber") % INSTANCE_LOGS), "instances"))
    header = {"instanceNumber": "instanceNumber", "type": "type"}
    sink.write_logs(named, path, "file", ["instanceNumber"], header, delimited.PREAMBLE["instances"])
    return sink.folder_of(path)


def write_time_logs(events: DataFrame, path: str) -> str:
    """Time stamps with the header of the task, which has a name too many."""
    kind = F.when(F.col("eventType") == b.EVENT_OF_TRIAL, pipeline.TRIAL_EVENT).otherwise(F.col("eventType"))
    named = events.select(_log_name(F.col("participant_id"), "times").alias("file"), "line_no", "block", "trial", kind.alias("kind"), "elapsedTime")
    header = {"block": "block", "trial": "trial", "kind": "instanceNumber", "elapsedTime": "eventType;elapsedTime"}
    sink.write_logs(named, path, "file", ["line_no"], header, delimited.PREAMBLE["times"])
    return sink.folder_of(path)


def write_trial_logs(events: DataFrame, path: str) -> str:
    number = F.col("line_no")
    trials = events.filter(F.col("eventType") == b.EVENT_OF_TRIAL).select(
        _log_name(F.col("participant_id"), "trials").alias("file"), "line_no", "block", "trial",
        (number % INSTANCES_SEEN).alias("instanceNumber"),
        F.when(F.col("value") >= SOLVED_FROM, 1).otherwise(0).alias("correct"),
        (number % 2).alias("randomYes"),
    )
    header = {c: c for c in ("block", "trial", "instanceNumber", "correct")} | {"randomYes": RANDOM_YES_HEADER}
    sink.write_logs(trials, path, "file", ["line_no"], header, delimited.PREAMBLE["trials"])
    return sink.folder_of(path)


def write_questionnaire(spark: SparkSession, d: str, path: str) -> str:
    headers = {"participant_id": "ParticipantID"} | pipeline.STRATEGY_HEADERS[b.TASK]
    sink.write_summary(b.demographics(spark, d).withColumnsRenamed(headers), path, "csv")
    return sink.folder_of(path)


def experiment(spark: SparkSession, d: str) -> pipeline.Experiment:
    """The tables as files; each kind of log has a folder of its own."""
    root = _folder(spark, "experiment")
    events = runtime.stored(numbered_events(spark, d), "events")
    sink.write_summary(b.complexity(spark, d), f"{root}/complexity", "csv")
    folders = {
        "instances": write_instance_logs(spark, d, f"{root}/instances"),
        "trials": write_trial_logs(events, f"{root}/trials"),
        "times": write_time_logs(events, f"{root}/times"),
    }
    return pipeline.Experiment(b.TASK, folders, write_questionnaire(spark, d, f"{root}/people"), sink.folder_of(f"{root}/complexity"))


_SQL_LOGGED = f"""
SELECT participant_id, CAST(k % 3 + 1 AS INTEGER) AS block, CAST(k // 3 + 1 AS INTEGER) AS trial, line_no % {INSTANCES_SEEN} AS instanceNumber,
       CASE WHEN value >= {SOLVED_FROM} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct, CAST(line_no % 2 AS INTEGER) AS randomYes,
       (following - elapsedTime) / 1000 AS TimeOnTask
FROM (SELECT t.participant_id, t.line_no, t.eventType, t.elapsedTime, e.value,
             lead(t.elapsedTime) OVER w AS following, row_number() OVER w - 1 AS k
      FROM ({b.SQL_EVENTS}) t JOIN events e ON e.event_id = t.line_no
      WINDOW w AS (PARTITION BY t.participant_id ORDER BY t.line_no))
WHERE eventType = '{b.EVENT_OF_TRIAL}'"""
_STRATEGIES = list(pipeline.STRATEGY_HEADERS[b.TASK])
_SQL_FLAGS_OF = "Age, Sex_Female, PostGrad, Commerce, Early_Afternoon, Late_Afternoon, MultipleStrategies"


@query(
    "analysis_from_logs",
    f"""SELECT CAST(t.participant_id AS VARCHAR) AS participant_id, t.* EXCLUDE (participant_id, TimeOnTask), round(TimeOnTask, 6) AS TimeOnTask,
               i.type, c.propagations, c.decisions,
               CASE block WHEN 1 THEN trial WHEN 2 THEN trial + 8 WHEN 3 THEN trial + 16 END AS TrialNumber,
               CASE WHEN type IN (3, 4) THEN 'Yes' ELSE 'No' END AS InPhaseTransition, {b.SQL_REGION} AS Region,
               CAST(CASE WHEN type = 6 THEN 1 WHEN type = 5 THEN 2 WHEN type <= 4 THEN 3 END AS DOUBLE) AS Difficulty,
               {_SQL_FLAGS_OF}, {', '.join(f'CAST({s} AS DOUBLE) AS {s}' for s in _STRATEGIES)}
        FROM ({_SQL_LOGGED}) t JOIN ({b.SQL_INSTANCES}) i USING (instanceNumber) JOIN ({b.SQL_COMPLEXITY}) c USING (instanceNumber)
             JOIN ({b.SQL_FLAGS}) p ON p.participant_id = t.participant_id""",
)
def analysis_from_logs(spark, d):
    """From log files with preambles and a shifted header, and two CSV tables, to the analysis table."""
    return rounded(pipeline.analysis(spark, experiment(spark, d)))


_HEAD = "session notes 1\ninstanceNumber;type\n"


@query(
    "list_instance_logs",
    f"""SELECT participant_id, participant_id || '_{b.TASK}_{delimited.LOG_KINDS["instances"]}' AS name, {len(_HEAD)} + sum(bytes)::BIGINT AS length
        FROM (SELECT 'i' || (instanceNumber % {INSTANCE_LOGS}) AS participant_id, length(CAST(instanceNumber AS VARCHAR)) + length(CAST(type AS VARCHAR)) + 2 AS bytes
              FROM ({b.SQL_INSTANCES})) GROUP BY 1""",
)
def list_instance_logs(spark, d):
    listed = delimited.list_inputs(spark, write_instance_logs(spark, d, _folder(spark, "instances")), "instances")
    return listed.select("participant_id", delimited.base_name(F.col("path")).alias("name"), "length")


def _read_back(fmt: str):
    def run(spark, d):
        path = _folder(spark, "summary")
        summary = summaries.group_summary(b.analysis(spark, d), ["instanceNumber", "Region"], "correct")
        sink.write_summary(summary, path, fmt)
        return rounded(sink.read_summary(spark, path))

    return run


for _fmt in ("csv", "parquet"):
    query(
        f"summary_read_back_{_fmt}",
        f"SELECT instanceNumber, Region, {_SQL_SUMMARY.format(v='correct')} FROM ({b.SQL_ANALYSIS}) GROUP BY 1, 2",
    )(_read_back(_fmt))


@query("summary_verified", f"SELECT count(*)::BIGINT AS n_rows, TRUE AS verified FROM ({b.SQL_TRIALS})")
def summary_verified(spark, d):
    """The trials written in parts; every part's bytes are read again and digested."""
    path = _folder(spark, "trials")
    sink.write_summary(b.trial_info(spark, d, participant=True), path)
    return sink.verify(spark, path).agg(F.sum("rows").alias("n_rows"), F.every("verified").alias("verified"))

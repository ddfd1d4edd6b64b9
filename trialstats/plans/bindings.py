"""The logical schema of an experiment, read from the retail test tables.

lineitem rows play the trials, parts the problem instances, customers the
participants and events the time-stamp logs.  Frames are built from only the
tables a query needs; Catalyst prunes the columns.  Each binding has its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.operators import recode
from trialstats.operators.joins import natural_join, star_join

TASK = "sat"
# Task behind each order status.
TASK_OF_STATUS = {"F": "KS", "O": "TSP", "P": "3-SAT"}
EVENT_OF_TRIAL = "click"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def instance_info(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("instanceNumber"),
        ((F.col("p_size") - 1) % 6 + 1).cast("double").alias("type"),
    )


def complexity(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("instanceNumber"),
        F.col("p_retailprice").alias("propagations"),
        F.col("p_size").cast("double").alias("decisions"),
    )


def trial_info(spark: SparkSession, folder: str, participant: bool = False) -> DataFrame:
    """Trials; the participant and the task come from orders and cost a join."""
    trials = _trials(spark, folder)
    if not participant:
        return trials.drop("session")
    return natural_join(trials, sessions(spark, folder), null_safe=False).drop("session")


def _trials(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("session"),
        (F.col("l_orderkey") % 3 + 1).cast("int").alias("block"),
        F.col("l_linenumber").alias("trial"),
        F.col("l_partkey").alias("instanceNumber"),
        F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0).alias("correct"),
        F.col("l_quantity").alias("TimeOnTask"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("randomYes"),
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Participant and task of each session."""
    status = F.create_map(*[F.lit(v) for pair in TASK_OF_STATUS.items() for v in pair])
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("session"),
        F.col("o_custkey").alias("participant_id"),
        status[F.col("o_orderstatus")].alias("task"),
    )


def demographics(spark: SparkSession, folder: str) -> DataFrame:
    """Raw demographic columns, one row per participant."""
    nations = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey")
    )
    nation = F.col("c_nationkey")
    people = natural_join(table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), nations, null_safe=False)
    return people.select(
        F.col("c_custkey").alias("participant_id"),
        F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("Gender"),
        (F.floor(F.col("c_acctbal") / 100) % 50 + 18).cast("double").alias("Age"),
        F.floor(F.col("c_acctbal") / 1000).cast("double").alias("Years_of_study"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Commerce").otherwise(F.col("c_mktsegment")).alias("Degree"),
        F.when(F.col("n_regionkey") <= 1, "Early_Afternoon")
        .when(F.col("n_regionkey") == 2, "Late_Afternoon")
        .otherwise("Morning")
        .alias("Time_of_day"),
        (nation % 3).alias("Total"),
        *[F.getbit(nation, F.lit(bit)).cast("int").alias(name) for name, bit in STRATEGY_BITS.items()],
    )


# Reported strategies, one 0/1 column each, read from the bits of the nation key.
STRATEGY_BITS = {
    "Greedy": 0,
    "Feasible": 1,
    "Large_Items": 2,
    "Prioritising_Properties": 3,
    "Process_Elimination": 0,
    "Brute_Force": 1,
    "Uniform_Signs": 2,
    "Convex_Hull": 2,
    "Nearest_Neighbour": 3,
}


def analysis(
    spark: SparkSession,
    folder: str,
    participant: bool = False,
    with_complexity: bool = False,
    with_demographics: bool = False,
) -> DataFrame:
    """The trial-level table every summary and model starts from.

    Instance properties are joined with each other, and participants with their
    sessions, before either meets the trials: the large table is joined at most
    twice.  All join keys are primary keys of one side, so none is NULL there, and
    part holds one row per instance, so it needs no de-duplication.
    """
    instances = instance_info(spark, folder)
    if with_complexity:
        instances = natural_join(instances, complexity(spark, folder), null_safe=False)
    dimensions = [instances]
    if participant or with_demographics:
        people = sessions(spark, folder)
        if with_demographics:
            flags = recode.demographic_flags()
            covariates = demographics(spark, folder).withColumns(flags)
            people = natural_join(people, covariates.select("participant_id", "Age", *flags, *STRATEGY_BITS), null_safe=False)
        dimensions.append(people)
    return derive(star_join(_trials(spark, folder), *dimensions, null_safe=False).drop("session"))


def derive(df: DataFrame, task: str = TASK) -> DataFrame:
    kind = F.col("type")
    return df.withColumns(
        {
            "TrialNumber": recode.trial_number(F.col("block"), F.col("trial"), recode.BLOCK_OFFSETS[task]),
            "InPhaseTransition": recode.in_phase_transition(kind),
            "Region": recode.region(kind, task),
        }
    ).withColumn("Difficulty", recode.difficulty(F.col("Region")))


def time_stamps(spark: SparkSession, folder: str) -> DataFrame:
    """Event log: elapsed milliseconds, independent of the session time zone."""
    seconds = "cast(cast(ts - timestamp_ntz'2024-01-01 00:00:00' as interval second) as decimal(20, 6))"
    return table(spark, folder, "events").select(
        F.col("user_id").alias("participant_id"),
        F.col("event_id").alias("line_no"),
        F.col("event_type").alias("eventType"),
        F.expr(f"cast({seconds} * 1000 as double)").alias("elapsedTime"),
    )


# --- the same frames in SQL ---------------------------------------------------

SQL_INSTANCES = "SELECT p_partkey AS instanceNumber, CAST((p_size - 1) % 6 + 1 AS DOUBLE) AS type FROM part"
SQL_COMPLEXITY = (
    "SELECT p_partkey AS instanceNumber, p_retailprice AS propagations, CAST(p_size AS DOUBLE) AS decisions FROM part"
)
SQL_TRIALS = """
SELECT o_custkey AS participant_id,
       CASE o_orderstatus WHEN 'F' THEN 'KS' WHEN 'O' THEN 'TSP' WHEN 'P' THEN '3-SAT' END AS task,
       CAST(l_orderkey % 3 + 1 AS INTEGER) AS block, l_linenumber AS trial, l_partkey AS instanceNumber,
       CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct,
       l_quantity AS TimeOnTask, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS randomYes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
_SQL_STRATEGIES = ", ".join(f"CAST((c_nationkey >> {bit}) & 1 AS INTEGER) AS {name}" for name, bit in STRATEGY_BITS.items())
SQL_DEMOGRAPHICS = f"""
SELECT c_custkey AS participant_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS Gender,
       CAST(CAST(floor(c_acctbal / 100) AS BIGINT) % 50 + 18 AS DOUBLE) AS Age,
       CAST(floor(c_acctbal / 1000) AS DOUBLE) AS Years_of_study,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'Commerce' ELSE c_mktsegment END AS Degree,
       CASE WHEN n_regionkey <= 1 THEN 'Early_Afternoon' WHEN n_regionkey = 2 THEN 'Late_Afternoon'
            ELSE 'Morning' END AS Time_of_day,
       c_nationkey % 3 AS Total,
       {_SQL_STRATEGIES}
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
SQL_FLAGS = f"""
SELECT participant_id, Age,
       CASE WHEN Gender = 'Female' THEN 1 WHEN Gender = 'Male' THEN 0 END AS Sex_Female,
       CASE WHEN Years_of_study < 4 THEN 0 WHEN Years_of_study > 3 THEN 1 END AS PostGrad,
       CAST(Degree = 'Commerce' AS INTEGER) AS Commerce,
       CAST(Time_of_day = 'Early_Afternoon' AS INTEGER) AS Early_Afternoon,
       CAST(Time_of_day = 'Late_Afternoon' AS INTEGER) AS Late_Afternoon,
       CASE WHEN Total > 1 THEN 1 WHEN Total <= 1 THEN 0 END AS MultipleStrategies,
       {', '.join(STRATEGY_BITS)}
FROM ({SQL_DEMOGRAPHICS})"""
SQL_REGION = """CASE WHEN type = 6 THEN 'Under-Constrained' WHEN type = 5 THEN 'Over-Constrained'
            WHEN type <= 2 THEN 'Phase Transition - EASY'
            WHEN type IN (3, 4) THEN 'Phase Transition - HARD' END"""
SQL_ANALYSIS = f"""
SELECT t.*, i.type, c.propagations, c.decisions,
       CASE block WHEN 1 THEN trial WHEN 2 THEN trial + 8 WHEN 3 THEN trial + 16 END AS TrialNumber,
       CASE WHEN type IN (3, 4) THEN 'Yes' ELSE 'No' END AS InPhaseTransition,
       {SQL_REGION} AS Region,
       CASE WHEN type = 6 THEN 1.0 WHEN type = 5 THEN 2.0 WHEN type <= 4 THEN 3.0 END AS Difficulty
FROM ({SQL_TRIALS}) t JOIN ({SQL_INSTANCES}) i USING (instanceNumber)
     JOIN ({SQL_COMPLEXITY}) c USING (instanceNumber)"""
SQL_WITH_PEOPLE = f"SELECT a.*, d.* EXCLUDE (participant_id) FROM ({SQL_ANALYSIS}) a JOIN ({SQL_FLAGS}) d USING (participant_id)"
SQL_EVENTS = """
SELECT user_id AS participant_id, event_id AS line_no, event_type AS eventType,
       (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000.0 AS elapsedTime
FROM events"""

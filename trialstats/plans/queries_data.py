"""Registered queries: sources, recodes, joins, summaries, windows, stacking."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.operators import recode, relational, summaries
from trialstats.operators.joins import natural_join, trials_with_instances
from trialstats.operators.orderstats import qq_grid, qq_points
from trialstats.operators.permute import shuffle_column
from trialstats.operators.timing import time_on_task
from trialstats.plans import bindings as b
from trialstats.plans.registry import query
from trialstats.sources import delimited

PLACES = 6


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Round every double column, for comparison across engines."""
    return df.select(
        *[F.round(f.name, places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema]
    )


# --- sources ------------------------------------------------------------------


@query(
    "participant_from_path",
    """SELECT CAST(user_id AS VARCHAR) AS participant_id, count(*)::BIGINT AS n FROM events GROUP BY 1""",
)
def participant_from_path(spark, d):
    paths = b.table(spark, d, "events").select(
        F.concat(F.lit("/logs/"), "user_id", F.lit("_"), "event_id", F.lit("_TrialInfo.txt")).alias("path")
    )
    ids = paths.select(delimited.participant_from_path(F.col("path")).alias("participant_id"))
    return ids.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n"))


def _log_path(kind: str):
    return F.concat(F.lit("/logs/"), F.col("participant_id"), F.lit(f"_s1_{delimited.LOG_KINDS[kind]}"))


def _as_log(events: DataFrame, path, columns: list[str], header: list[str], skip: int) -> DataFrame:
    """Event rows written out as log lines, one file per path."""
    body = events.select(
        path.alias("path"),
        (F.col("line_no") + skip + 1).alias("line_no"),
        F.concat_ws(";", *[F.col(c).cast("string") for c in columns]).alias("value"),
    )
    text = F.when(F.col("line_no") == skip, ";".join(header)).otherwise("recorded by the task program")
    preamble = body.select("path").distinct().select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(skip).cast("long"))).alias("line_no"))
    return body.unionByName(preamble.withColumn("value", text))


@query(
    "parse_delimited",
    """SELECT CAST(user_id AS VARCHAR) AS participant_id, event_id, event_type AS "eventType", value
       FROM events""",
)
def parse_delimited(spark, d):
    events = b.table(spark, d, "events").withColumns({"participant_id": F.col("user_id"), "line_no": F.col("event_id")})
    columns = ["event_id", "event_type", "value"]
    lines = _as_log(events, _log_path("times"), columns, ["event id", "eventType", "2 value"], skip=2)
    schema = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("eventType", T.StringType()), T.StructField("value", T.DoubleType())]
    )
    parsed = delimited.parse_lines(lines, schema, skip=2, mapping={"event_id": "event.id", "value": "X2.value"})
    return parsed.select(delimited.participant_from_path(F.col("path")).alias("participant_id"), *schema.names)


@query(
    "bind_rows_by_name",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN value END AS value,
              CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END AS "eventType" FROM events""",
)
def bind_rows_by_name(spark, d):
    """Two file layouts: (event_id, value) and (eventType, event_id)."""
    events = b.table(spark, d, "events").withColumn("line_no", F.col("event_id"))
    viewing = F.col("event_type").isin("click", "view")
    first = _as_log(events.filter(viewing), F.lit("/logs/a_TrialInfo.txt"), ["event_id", "value"], ["event_id", "value"], 1)
    second = _as_log(
        events.filter(~viewing), F.lit("/logs/b_TrialInfo.txt"), ["event_type", "event_id"], ["eventType", "event_id"], 1
    )
    schema = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("eventType", T.StringType())]
    )
    return delimited.parse_lines(first.unionByName(second), schema).select(*schema.names)


@query(
    "repair_header",
    """SELECT event_id AS block, event_type AS "eventType", value AS "elapsedTime" FROM events""",
)
def repair_header(spark, d):
    """Logs whose header has one name more than the lines have values."""
    events = b.table(spark, d, "events").withColumns({"participant_id": F.col("user_id"), "line_no": F.col("event_id")})
    lines = _as_log(
        events, _log_path("times"), ["event_id", "event_type", "value"], ["block", "instanceNumber", "eventType", "elapsedTime"], 2
    )
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("instanceNumber", T.StringType()),
            T.StructField("eventType", T.DoubleType()),
            T.StructField("elapsedTime", T.DoubleType()),
        ]
    )
    parsed = delimited.parse_lines(lines, schema, skip=2).drop("path", "line_no")
    return delimited.repair_header(parsed, {"eventType": "elapsedTime", "instanceNumber": "eventType"}).select(
        "block", "eventType", "elapsedTime"
    )


# --- projections, filters, recodes ---------------------------------------------


@query("select_cols", b.SQL_INSTANCES)
def select_cols(spark, d):
    return relational.select_cols(b.instance_info(spark, d), ["instanceNumber", "type"])


@query("drop_cols", f"SELECT * EXCLUDE (randomYes, block) FROM ({b.SQL_TRIALS})")
def drop_cols(spark, d):
    return relational.drop_cols(b.trial_info(spark, d, participant=True), ["randomYes", "block"])


@query(
    "rename_cols",
    f"""SELECT participant_id, Process_Elimination AS "Elimination", Brute_Force AS "Exhaustive"
        FROM ({b.SQL_DEMOGRAPHICS})""",
)
def rename_cols(spark, d):
    names = {"Process_Elimination": "Elimination", "Brute_Force": "Exhaustive"}
    return relational.rename(b.demographics(spark, d), names).select("participant_id", *names.values())


@query("filter_event", f"SELECT * FROM ({b.SQL_EVENTS}) WHERE eventType = '{b.EVENT_OF_TRIAL}'")
def filter_event(spark, d):
    return b.time_stamps(spark, d).filter(F.col("eventType") == b.EVENT_OF_TRIAL)


_SQL_SUMMARY = "round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS sd, count(*)::BIGINT AS n, round(stddev_samp({v}) / sqrt(count(*)), 6) AS se"


@query(
    "split_yes_no",
    f"""SELECT CASE WHEN randomYes = 1 THEN 'Yes' ELSE 'No' END AS solution, {_SQL_SUMMARY.format(v="correct")}
        FROM ({b.SQL_TRIALS}) WHERE randomYes IN (0, 1) GROUP BY 1""",
)
def split_yes_no(spark, d):
    tagged = relational.split_yes_no(b.trial_info(spark, d), "randomYes")
    return rounded(summaries.group_summary(tagged, ["solution"], "correct"))


@query(
    "region_subset",
    f"""WITH a AS ({b.SQL_ANALYSIS})
        SELECT 'Under' AS subset, instanceNumber, block, trial, correct FROM a WHERE Region = 'Under-Constrained'
        UNION ALL SELECT 'Over', instanceNumber, block, trial, correct FROM a WHERE Region = 'Over-Constrained'
        UNION ALL SELECT 'PT', instanceNumber, block, trial, correct FROM a WHERE Region LIKE 'Phase Transition%'
        UNION ALL SELECT 'PT exact', instanceNumber, block, trial, correct FROM a WHERE Region = 'Phase Transition'""",
)
def region_subset(spark, d):
    """The three region subsets, and the transition subset by literal label (empty)."""
    label = F.col("Region")
    member = F.array(
        F.when(label == recode.UNDER, "Under"),
        F.when(label == recode.OVER, "Over"),
        F.when(recode.is_transition(label), "PT"),
        F.when(recode.is_transition(label, "exact"), "PT exact"),
    )
    return b.analysis(spark, d).select(
        F.explode(F.array_compact(member)).alias("subset"), "instanceNumber", "block", "trial", "correct"
    )


@query("phase_transition_trials", f"SELECT instanceNumber, block, trial, type, correct FROM ({b.SQL_ANALYSIS}) WHERE type <= 4")
def phase_transition_trials(spark, d):
    return b.analysis(spark, d).filter(F.col("type") <= 4).select("instanceNumber", "block", "trial", "type", "correct")


@query(
    "post_learning_trials",
    f"SELECT instanceNumber, TrialNumber, correct, TimeOnTask FROM ({b.SQL_ANALYSIS}) WHERE TrialNumber > 6",
)
def post_learning_trials(spark, d):
    late = b.analysis(spark, d).filter(relational.in_range(F.col("TrialNumber"), above=6))
    return late.select("instanceNumber", "TrialNumber", "correct", "TimeOnTask")


@query(
    "region_pair",
    f"""SELECT Region AS region, {_SQL_SUMMARY.format(v='"TimeOnTask"')} FROM ({b.SQL_ANALYSIS})
        WHERE Region LIKE 'Phase Transition%' OR Region = 'Under-Constrained' GROUP BY 1""",
)
def region_pair(spark, d):
    pair = region_pair_rows(b.analysis(spark, d), recode.UNDER)
    return rounded(summaries.group_summary(pair.withColumnRenamed("Region", "region"), ["region"], "TimeOnTask"))


@query(
    "region_pair_over",
    f"""SELECT Region AS region, {_SQL_SUMMARY.format(v='"TimeOnTask"')} FROM ({b.SQL_ANALYSIS})
        WHERE Region LIKE 'Phase Transition%' OR Region = 'Over-Constrained' GROUP BY 1""",
)
def region_pair_over(spark, d):
    pair = region_pair_rows(b.analysis(spark, d), recode.OVER)
    return rounded(summaries.group_summary(pair.withColumnRenamed("Region", "region"), ["region"], "TimeOnTask"))


def region_pair_rows(df: DataFrame, other: str) -> DataFrame:
    """Rows of the phase transition and of one other region."""
    return df.filter(recode.is_transition(F.col("Region")) | (F.col("Region") == other))


# The outlier instances of the re-analysis.
OUTLIERS = [3, 7]


@query(
    "trim_instances",
    f"SELECT instanceNumber, block, trial, type, correct FROM ({b.SQL_ANALYSIS}) WHERE instanceNumber NOT IN (3, 7)",
)
def trim_instances(spark, d):
    return relational.trim_instances(b.analysis(spark, d), "instanceNumber", OUTLIERS).select(
        "instanceNumber", "block", "trial", "type", "correct"
    )


_SQL_TRIMMED = f"""SELECT CASE WHEN type IN (5, 5.5) THEN 'Over' WHEN type IN (3, 3.5) THEN 'Under'
                   WHEN type IN (4, 4.5) THEN 'PT' END AS region,
             CASE WHEN type IN (4, 4.5) THEN 'Yes' ELSE 'No' END AS in_pt, correct, TimeOnTask
      FROM ({b.SQL_ANALYSIS}) WHERE instanceNumber NOT IN (3, 7)"""


def _trimmed(spark, d) -> DataFrame:
    kept = relational.trim_instances(b.analysis(spark, d), "instanceNumber", OUTLIERS)
    return kept.select(
        recode.relabel(recode.trimmed_region(F.col("type"))).alias("region"),
        recode.in_phase_transition(F.col("type"), (4, 4.5)).alias("in_pt"),
        "correct",
        "TimeOnTask",
    )


def _register_trimmed() -> None:
    """The four summaries of the main analysis, on the trimmed trials."""
    for label, value in (("acc", "correct"), ("time", "TimeOnTask")):
        for suffix, column in (("region", "region"), ("pt", "in_pt")):
            sql = f"SELECT {column}, {_SQL_SUMMARY.format(v=value)} FROM ({_SQL_TRIMMED}) GROUP BY 1"

            def run(spark, d, value=value, column=column):
                return rounded(summaries.group_summary(_trimmed(spark, d), [column], value))

            query(f"trimmed_{label}_by_{suffix}", sql)(run)


_register_trimmed()


@query(
    "trimmed_with_demographics",
    f"""SELECT participant_id, instanceNumber, block, trial, correct, Sex_Female, Age
        FROM ({b.SQL_WITH_PEOPLE}) WHERE instanceNumber NOT IN (3, 7)""",
)
def trimmed_with_demographics(spark, d):
    trials = relational.trim_instances(b.trial_info(spark, d, participant=True), "instanceNumber", OUTLIERS)
    people = b.demographics(spark, d).withColumns(recode.demographic_flags()).select("participant_id", "Sex_Female", "Age")
    return natural_join(trials, people).select("participant_id", "instanceNumber", "block", "trial", "correct", "Sex_Female", "Age")


@query(
    "in_phase_transition",
    f"SELECT instanceNumber, type, CASE WHEN type IN (3, 4) THEN 'Yes' ELSE 'No' END AS in_pt FROM ({b.SQL_INSTANCES})",
)
def in_phase_transition(spark, d):
    return b.instance_info(spark, d).withColumn("in_pt", recode.in_phase_transition(F.col("type")))


@query("region_label", f"SELECT instanceNumber, type, {b.SQL_REGION} AS region FROM ({b.SQL_INSTANCES})")
def region_label(spark, d):
    return b.instance_info(spark, d).withColumn("region", recode.region(F.col("type"), b.TASK))


@query(
    "relabel_region",
    f"""SELECT CASE WHEN Region LIKE 'Phase Transition%' THEN 'PT' WHEN Region = 'Under-Constrained' THEN 'Under'
               WHEN Region = 'Over-Constrained' THEN 'Over' ELSE Region END AS short,
          CASE Region WHEN 'Under-Constrained' THEN 'Under' WHEN 'Phase Transition' THEN 'PT'
               WHEN 'Over-Constrained' THEN 'Over' ELSE Region END AS exact,
          {_SQL_SUMMARY.format(v='"TimeOnTask"')}
        FROM ({b.SQL_ANALYSIS}) GROUP BY Region""",
)
def relabel_region(spark, d):
    """Time summary by region with short labels, by meaning and by literal text."""
    summary = summaries.group_summary(b.analysis(spark, d), ["Region"], "TimeOnTask")
    label = F.col("Region")
    labelled = summary.withColumns({"short": recode.relabel(label), "exact": recode.relabel(label, "exact")})
    return rounded(labelled.drop("Region"))


@query(
    "difficulty",
    f"""SELECT instanceNumber, CASE WHEN type = 6 THEN 1.0::DOUBLE WHEN type = 5 THEN 2.0::DOUBLE WHEN type <= 4 THEN 3.0::DOUBLE END AS difficulty,
               CASE WHEN type = 6 THEN 1.0::DOUBLE WHEN type = 5 THEN 2.0::DOUBLE END AS exact FROM ({b.SQL_INSTANCES})""",
)
def difficulty(spark, d):
    label = recode.region(F.col("type"), b.TASK)
    return b.instance_info(spark, d).select(
        "instanceNumber", recode.difficulty(label).alias("difficulty"), recode.difficulty(label, "exact").alias("exact")
    )


_FLAG_COLUMNS = ["Sex_Female", "Commerce", "Early_Afternoon", "Late_Afternoon"]


@query("dummy_vars", f"SELECT participant_id, {', '.join(_FLAG_COLUMNS)} FROM ({b.SQL_FLAGS})")
def dummy_vars(spark, d):
    flags = recode.demographic_flags()
    return b.demographics(spark, d).select("participant_id", *[flags[c].alias(c) for c in _FLAG_COLUMNS])


@query("threshold_flags", f"SELECT participant_id, PostGrad, MultipleStrategies FROM ({b.SQL_FLAGS})")
def threshold_flags(spark, d):
    flags = recode.demographic_flags()
    return b.demographics(spark, d).select(
        "participant_id", *[flags[c].alias(c) for c in ("PostGrad", "MultipleStrategies")]
    )


@query(
    "trial_number",
    f"""SELECT block, trial, CASE block WHEN 1 THEN trial WHEN 2 THEN trial + 12 END AS ks,
               CASE block WHEN 1 THEN trial WHEN 2 THEN trial + 8 WHEN 3 THEN trial + 16 END AS sat,
               CASE block WHEN 1 THEN trial WHEN 2 THEN trial + 9 END AS tsp FROM ({b.SQL_TRIALS})""",
)
def trial_number(spark, d):
    names = {"ks": "knapsack", "sat": "sat", "tsp": "tsp"}
    return b.trial_info(spark, d).select(
        "block",
        "trial",
        *[
            recode.trial_number(F.col("block"), F.col("trial"), recode.BLOCK_OFFSETS[task]).alias(name)
            for name, task in names.items()
        ],
    )


@query(
    "shuffle_column",
    """WITH rows AS (SELECT event_id, user_id, row_number() OVER (ORDER BY md5(event_id || ':rows:7'), event_id) AS k FROM events),
            vals AS (SELECT event_type, row_number() OVER (ORDER BY md5(event_id || ':values:7'), event_id) AS k FROM events)
       SELECT event_id, user_id, event_type FROM rows JOIN vals USING (k)""",
)
def shuffle(spark, d):
    events = b.table(spark, d, "events").select("event_id", "user_id", "event_type")
    return shuffle_column(events, "event_id", "event_type", seed=7)


# --- joins ----------------------------------------------------------------------


@query("natural_join", "SELECT n_regionkey, n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_natural(spark, d):
    regions = b.table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return natural_join(b.table(spark, d, "nation"), regions)


@query(
    "trials_with_instances",
    f"SELECT DISTINCT t.*, i.type FROM ({b.SQL_TRIALS}) t JOIN (SELECT DISTINCT * FROM ({b.SQL_INSTANCES})) i USING (instanceNumber)",
)
def join_instances(spark, d):
    return trials_with_instances(b.trial_info(spark, d, participant=True), b.instance_info(spark, d))


_SQL_DURATIONS = f"""SELECT participant_id, line_no, eventType, elapsedTime,
       (lead(elapsedTime) OVER (PARTITION BY participant_id ORDER BY line_no) - elapsedTime) / 1000 AS TimeOnTask
FROM ({b.SQL_EVENTS})"""


@query(
    "trials_with_times",
    f"""SELECT participant_id, line_no, e.event_type AS kind, e.value, round(TimeOnTask, 6) AS TimeOnTask
        FROM events e JOIN (SELECT participant_id, line_no, TimeOnTask FROM ({_SQL_DURATIONS}) WHERE eventType = 'click') t
        ON e.user_id = participant_id AND e.event_id = line_no""",
)
def join_times(spark, d):
    """Trials and their durations: a shuffled join on participant and line."""
    trials = b.table(spark, d, "events").select(
        F.col("user_id").alias("participant_id"),
        F.col("event_id").alias("line_no"),
        F.col("event_type").alias("kind"),
        "value",
    )
    durations = time_on_task(b.time_stamps(spark, d)).filter(F.col("eventType") == b.EVENT_OF_TRIAL)
    return rounded(natural_join(trials, durations.select("participant_id", "line_no", "TimeOnTask")))


@query(
    "analysis_with_demographics",
    f"""SELECT participant_id, instanceNumber, block, trial, correct, TimeOnTask, InPhaseTransition, Age, Sex_Female, PostGrad,
               Commerce, Early_Afternoon, Late_Afternoon, MultipleStrategies FROM ({b.SQL_WITH_PEOPLE})""",
)
def join_demographics(spark, d):
    return b.analysis(spark, d, with_demographics=True).select(
        "participant_id", "instanceNumber", "block", "trial", "correct", "TimeOnTask", "InPhaseTransition", "Age", *recode.demographic_flags()
    )


@query(
    "complexity_join",
    f"SELECT instanceNumber, block, trial, correct, propagations, decisions FROM ({b.SQL_ANALYSIS})",
)
def join_complexity(spark, d):
    trials = b.trial_info(spark, d).select("instanceNumber", "block", "trial", "correct")
    return natural_join(trials, b.complexity(spark, d))


# --- aggregations ----------------------------------------------------------------


def _register_summaries() -> None:
    for label, value in (("acc", "correct"), ("time", "TimeOnTask")):
        for suffix, column in (("pt", "InPhaseTransition"), ("region", "Region")):
            sql = f"SELECT {column}, {_SQL_SUMMARY.format(v=value)} FROM ({b.SQL_ANALYSIS}) GROUP BY 1"

            def run(spark, d, value=value, column=column):
                return rounded(summaries.group_summary(b.analysis(spark, d), [column], value))

            query(f"{label}_by_{suffix}", sql)(run)


_register_summaries()

_SQL_ACC_TIME = "round(avg(correct), 6) AS accuracy, round(stddev_samp(correct), 6) AS std_dev, round(avg(TimeOnTask), 6) AS time"


@query("instance_summary", f"SELECT instanceNumber, {_SQL_ACC_TIME} FROM ({b.SQL_ANALYSIS}) GROUP BY 1")
def instance_summary(spark, d):
    return rounded(summaries.accuracy_and_time(b.trial_info(spark, d), ["instanceNumber"]))


@query("participant_summary", f"SELECT participant_id, {_SQL_ACC_TIME} FROM ({b.SQL_ANALYSIS}) GROUP BY 1")
def participant_summary(spark, d):
    return rounded(summaries.accuracy_and_time(b.trial_info(spark, d, participant=True), ["participant_id"]))


@query(
    "trial_summary",
    f"""SELECT TrialNumber, round(avg(correct), 6) AS accuracy, round(avg(TimeOnTask), 6) AS time
        FROM ({b.SQL_ANALYSIS}) GROUP BY 1""",
)
def trial_summary(spark, d):
    return rounded(summaries.accuracy_and_time(b.analysis(spark, d), ["TrialNumber"], with_sd=False))


@query(
    "learning_curve",
    f"""SELECT participant_id, CASE WHEN TrialNumber <= 6 THEN 1 WHEN TrialNumber <= 12 THEN 2 ELSE 3 END AS learning,
               round(avg(correct), 6) AS mean FROM ({b.SQL_ANALYSIS}) WHERE TrialNumber IS NOT NULL GROUP BY 1, 2""",
)
def learning_curve(spark, d):
    trials = b.trial_info(spark, d, participant=True)
    number = recode.trial_number(F.col("block"), F.col("trial"), recode.BLOCK_OFFSETS[b.TASK])
    blocks = trials.withColumn("learning", recode.learning_block(number))
    return rounded(summaries.learning_curve(blocks, "participant_id", "learning"))


@query(
    "multi_mean_by_type",
    f"""SELECT type, round(avg(correct), 6) AS mean_correct, round(avg(TimeOnTask), 6) AS "mean_TimeOnTask"
        FROM ({b.SQL_ANALYSIS}) WHERE type IS NOT NULL GROUP BY 1""",
)
def multi_mean_by_type(spark, d):
    return rounded(summaries.multi_mean(b.analysis(spark, d), "type", ["correct", "TimeOnTask"]))


@query("contingency", f"SELECT InPhaseTransition, correct, count(*)::BIGINT AS n FROM ({b.SQL_ANALYSIS}) WHERE type <= 4 GROUP BY 1, 2")
def contingency(spark, d):
    return summaries.contingency(b.analysis(spark, d).filter(F.col("type") <= 4), "InPhaseTransition", "correct")


@query(
    "contingency_wide",
    f"""SELECT Region, count(*) FILTER (correct = 0)::BIGINT AS wrong, count(*) FILTER (correct = 1)::BIGINT AS solved
        FROM ({b.SQL_ANALYSIS}) GROUP BY 1""",
)
def contingency_wide(spark, d):
    outcome = F.when(F.col("correct") == 1, "solved").otherwise("wrong")
    return summaries.contingency_wide(b.analysis(spark, d).withColumn("outcome", outcome), "Region", "outcome", ["wrong", "solved"])


@query("distinct_rows", f"SELECT DISTINCT block, trial, TimeOnTask, correct FROM ({b.SQL_TRIALS})")
def distinct_rows(spark, d):
    return relational.distinct_rows(b.trial_info(spark, d).select("block", "trial", "TimeOnTask", "correct"))


@query(
    "error_band",
    f"""SELECT Region, round(mean, 6) AS mean, round(sd, 6) AS sd, n, round(se, 6) AS se, round(mean - se, 6) AS lower,
               round(mean + se, 6) AS upper, CAST(CAST(round(round(mean, 2) * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS label
        FROM (SELECT Region, avg(correct) AS mean, stddev_samp(correct) AS sd, count(*)::BIGINT AS n,
                     stddev_samp(correct) / sqrt(count(*)) AS se FROM ({b.SQL_ANALYSIS}) GROUP BY 1)""",
)
def error_band(spark, d):
    summary = summaries.group_summary(b.analysis(spark, d), ["Region"], "correct")
    return rounded(summaries.error_band(summary))


# --- windows, order, stacking -------------------------------------------------------


@query(
    "time_on_task",
    f"""SELECT participant_id, line_no, round(TimeOnTask, 6) AS TimeOnTask FROM ({_SQL_DURATIONS})
        WHERE eventType = '{b.EVENT_OF_TRIAL}'""",
)
def durations(spark, d):
    timed = time_on_task(b.time_stamps(spark, d)).filter(F.col("eventType") == b.EVENT_OF_TRIAL)
    return rounded(timed.select("participant_id", "line_no", "TimeOnTask"))


QQ_POINTS = 49
_QQ_VALUES = ", ".join(f"({p!r}::DOUBLE, {NormalDist().inv_cdf(p)!r}::DOUBLE)" for p in qq_grid(QQ_POINTS))


@query(
    "qq_points",
    f"""SELECT round(p, 6) AS prob, round(z, 6) AS normal_quantile, round(q, 6) AS sample_quantile
        FROM (SELECT unnest(quantile_cont(l_extendedprice, [{", ".join(repr(p) + "::DOUBLE" for p in qq_grid(QQ_POINTS))}])) AS q,
                     unnest([{", ".join(repr(p) + "::DOUBLE" for p in qq_grid(QQ_POINTS))}]) AS p FROM lineitem)
        JOIN (VALUES {_QQ_VALUES}) AS v(vp, z) ON vp = p""",
)
def qq(spark, d):
    return rounded(qq_points(b.table(spark, d, "lineitem"), "l_extendedprice", QQ_POINTS))


@query("arrange", f"SELECT participant_id, block, trial, instanceNumber, correct FROM ({b.SQL_TRIALS})")
def arrange(spark, d):
    trials = b.trial_info(spark, d, participant=True).select("participant_id", "block", "trial", "instanceNumber", "correct")
    return relational.arrange(trials, ["participant_id", "block", "trial"])


def _register_stacks() -> None:
    for suffix, column in (("pt", "InPhaseTransition"), ("region", "Region")):
        sql = f"""SELECT task AS category, {column}, {_SQL_SUMMARY.format(v="correct")}
                  FROM ({b.SQL_ANALYSIS}) GROUP BY 1, 2"""

        def run(spark, d, column=column):
            """One pass grouped by task; the stacked per-task summaries are its rows."""
            trials = b.analysis(spark, d, participant=True).withColumnRenamed("task", "category")
            return rounded(summaries.group_summary(trials, ["category", column], "correct"))

        query(f"acc_by_task_{suffix}", sql)(run)


_register_stacks()


@query(
    "stack_tasks",
    f"""SELECT task AS category, InPhaseTransition, {_SQL_SUMMARY.format(v="correct")}
        FROM ({b.SQL_ANALYSIS}) GROUP BY 1, 2""",
)
def stack_tasks(spark, d):
    """The same summary of every task, stacked."""
    trials = b.analysis(spark, d, participant=True)
    return rounded(summaries.stacked_summary(trials, "task", ["InPhaseTransition"], "correct"))

"""The event log read as a stream."""

from pyspark.sql import functions as F

from searchloom.functions.dates import instant_of
from searchloom.plans import sqltext as q
from searchloom.plans.ledger_queries import MOVES
from searchloom.plans.registry import query
from searchloom.streaming import stateful, windows

WEEK = 7 * 86_400


# events of the budgets: keys are users, seven addresses, some events without one
ADDRESS = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'address-' || (user_id % 7) END"


def _windows(name: str, source: str, owner: str) -> str:
    """SQL for fixed windows opened by an owner's first event after the last one; ``<name>`` has the rank inside each."""
    return f"""{name}_w(owner, start_us) AS (SELECT {owner}, min(us) FROM {source} GROUP BY {owner}
      UNION ALL SELECT owner, (SELECT min(us) FROM {source} e WHERE e.{owner} = owner AND e.us >= start_us + {WEEK}000000) FROM {name}_w WHERE start_us IS NOT NULL),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY {owner}, start_us ORDER BY us, event_id) AS k FROM (
      SELECT e.*, (SELECT max(start_us) FROM {name}_w w WHERE w.owner = e.{owner} AND start_us <= e.us) AS start_us FROM {source} e) p)"""


WAIT = f"greatest(1, ceil((start_us + {WEEK}000000 - us) / 1000000.0))"


@query(
    "l1_request_budget",
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, {ADDRESS} AS address, (epoch_us(ts))::BIGINT AS us FROM events),
    {_windows("first", "e", "user_id")},
    passed AS (SELECT event_id, user_id, address, us FROM first WHERE k <= 6 AND address IS NOT NULL),
    {_windows("second", "passed", "address")}
    SELECT f.user_id::VARCHAR AS key, f.address, f.event_id, f.k <= 6 AND coalesce(s.k <= 20, TRUE) AS allowed,
      (CASE WHEN f.k > 6 THEN {WAIT.replace("start_us", "f.start_us").replace(" us)", " f.us)")} WHEN s.k > 20 THEN {WAIT.replace("start_us", "s.start_us").replace(" us)", " f.us)")} ELSE 0 END)::INT AS retry_after,
      CASE WHEN f.k > 6 THEN 'key' WHEN s.k > 20 THEN 'address' END AS refused_by
    FROM first f LEFT JOIN second s ON s.event_id = f.event_id""",
)
def l1(spark, sf):
    """Six events per user, then twenty per address, in windows of a week, so that both limits bind on this event rate."""
    events = windows.read_table_stream(spark, sf, "events").withColumn("address", F.expr(ADDRESS))
    return windows.run_to_end(stateful.request_budget(events, "user_id", "address", window_seconds=WEEK), "budget")


@query(
    "l2_streaming_metrics",
    f"""SELECT day, page, clicks, impressions, rows, {q.r10("clicks / impressions")} AS ctr, {q.r10("pos / weight")} AS position FROM (
      SELECT strftime(ts, '%Y-%m-%d') AS day, 'page-' || (user_id % 40) AS page, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::DOUBLE AS clicks, count(*)::DOUBLE AS impressions, count(*) AS rows,
        sum(CASE WHEN event_type <> 'error' THEN event_id % 50 + 1 END)::DOUBLE AS pos, count(CASE WHEN event_type <> 'error' THEN 1 END)::DOUBLE AS weight
      FROM events GROUP BY ALL) t""",
)
def l2(spark, sf):
    events = windows.read_table_stream(spark, sf, "events")
    rows = events.select(
        instant_of(F.col("ts")).alias("ts"),
        F.concat(F.lit("page-"), (F.col("user_id") % 40).cast("string")).alias("page"),
        (F.col("event_type") == "click").cast("int").cast("double").alias("clicks"),
        F.lit(1.0).alias("impressions"),
        F.when(F.col("event_type") != "error", (F.col("event_id") % 50 + 1).cast("double")).alias("position"),
    )
    return windows.run_windows_to_end(windows.daily_metrics(rows), "metrics", ["day", "page"])


STATUS = """CASE event_type WHEN 'view' THEN 'planned' WHEN 'click' THEN 'implemented' WHEN 'signup' THEN 'artifact_verified' WHEN 'purchase' THEN 'outcome_pending'
  ELSE CASE event_id % 5 WHEN 0 THEN 'implementation_failed' WHEN 1 THEN 'rolled_back' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'reviewed' ELSE 'shipped' END END"""


@query(
    "l3_streaming_transitions",
    f"""SELECT * FROM (SELECT project_id, change_id, sequence, previous_status, status, CASE WHEN previous_status IS NULL THEN CASE WHEN status <> 'planned' THEN 'first_status_not_planned' END
        WHEN (previous_status, status) NOT IN ({MOVES}) THEN 'transition_not_allowed' END AS issue FROM (
      SELECT *, lag(status) OVER (PARTITION BY project_id, change_id ORDER BY sequence) AS previous_status FROM (
        SELECT 'project-' || (user_id % 3) AS project_id, 'change-' || user_id AS change_id, event_id AS sequence, {STATUS} AS status FROM events) c) l) t WHERE issue IS NOT NULL""",
)
def l3(spark, sf):
    events = windows.read_table_stream(spark, sf, "events")
    records = events.select(
        F.concat(F.lit("project-"), (F.col("user_id") % 3).cast("string")).alias("project_id"),
        F.concat(F.lit("change-"), F.col("user_id").cast("string")).alias("change_id"),
        F.col("event_id").alias("sequence"),
        F.expr(STATUS).alias("status"),
        "ts",
    )
    return windows.run_timed_to_end(records, stateful.transition_check, "transitions")

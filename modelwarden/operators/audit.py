"""Queries over the decision, trace and event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from modelwarden.functions.numbers import pct
from modelwarden.functions.text import decision_line, display_label
from modelwarden.operators.gates import reward
from modelwarden.operators.ordered import SLICE_ROWS, pages, running_map, scan
from modelwarden.session import materialise

MAX_STAGES = 20
PAGE_ROWS = 1000


def by_trace(decisions: DataFrame, trace_id) -> DataFrame:
    """Decisions of one trace, oldest first."""
    return decisions.where(F.col("trace_id") == trace_id).orderBy("timestamp", "id")


def by_agent(decisions: DataFrame, agent: str, limit: int = 50) -> DataFrame:
    return recent(decisions.where(F.col("agent_name") == agent), limit)


def recent(decisions: DataFrame, limit: int = 20) -> DataFrame:
    """Newest decisions first; equal times are ordered by id."""
    return decisions.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def display(decisions: DataFrame) -> DataFrame:
    """Columns of the audit listing: label, whole-percent confidence, short conclusion, three observations."""
    return decisions.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"),
        "agent_name", "action",
        display_label(F.col("approved"), F.col("escalate_to_human")).alias("decision"),
        pct(F.col("reasoning.confidence")).alias("confidence"),
        F.substring("reasoning.conclusion", 1, 60).alias("conclusion"),
        F.slice("reasoning.observations", 1, 3).alias("observations"),
        "escalation_reason",
    )


def trace_rollup(decisions: DataFrame) -> DataFrame:
    """Per trace: stages, approved (not escalated), rejected, escalated, latest agent/action."""
    approved, escalated = F.col("approved"), F.col("escalate_to_human")
    at = F.struct("timestamp", "id")
    return decisions.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("stages"),
        F.count_if(approved & ~escalated).alias("approved"),
        F.count_if(~approved).alias("rejected"),
        F.count_if(escalated).alias("escalated"),
        F.max_by(F.concat("agent_name", F.lit("/"), "action"), at).alias("last_action"),
        F.max("timestamp").alias("last_ts"),
    )


def recent_status(decisions: DataFrame, last: int = 50, traces: int = 10) -> DataFrame:
    """The most recent traces among the last decisions."""
    return trace_rollup(recent(decisions, last)).orderBy(F.desc("last_ts"), F.desc("trace_id")).limit(traces)


def trace_outcome(decisions: DataFrame, max_stages: int = MAX_STAGES) -> DataFrame:
    """Status per trace: escalated, else failed (stage limit reached or anything rejected), else completed.

    A run ends at its first escalation or at the stage limit, in time order; what comes later is not looked at.
    """
    per = capped(decisions, max_stages).groupBy("trace_id").agg(
        F.max("stage_no").cast("bigint").alias("_n"), F.bool_and("approved").alias("_all"),
        F.min(F.when(F.col("escalate_to_human"), F.col("stage_no"))).cast("bigint").alias("_esc"))
    stages = F.coalesce("_esc", "_n")
    status = (
        F.when(F.col("_esc").isNotNull(), "escalated").when((F.col("_n") >= max_stages) | ~F.col("_all"), "failed")
        .otherwise("completed")
    )
    return per.select("trace_id", stages.alias("stages_executed"), stages.alias("decisions"), status.alias("status"))


def completion_events(outcomes: DataFrame) -> DataFrame:
    """Completion event per finished trace; an escalated trace emits none."""
    kind = F.when(F.col("status") == "completed", "pipeline.completed").otherwise("pipeline.failed")
    payload = F.to_json(F.struct("status", "stages_executed", "decisions"))
    return outcomes.where("status <> 'escalated'").select(
        kind.alias("type"), F.lit("orchestrator").alias("source"), "trace_id", payload.alias("payload"))


def start_events(traces: DataFrame, pipeline: str) -> DataFrame:
    """The event that opens a run, from traces (trace_id, entry_stage)."""
    payload = F.to_json(F.struct(F.lit(pipeline).alias("pipeline"), "entry_stage"))
    return traces.select(F.lit("pipeline.started").alias("type"), F.lit("orchestrator").alias("source"), "trace_id",
                         payload.alias("payload"))


def capped(decisions: DataFrame, max_stages: int = MAX_STAGES) -> DataFrame:
    """The first max_stages decisions of each trace. Tasks drop the rest before the shuffle."""
    w = W.partitionBy("trace_id").orderBy("timestamp", "id")
    return decisions.withColumn("stage_no", F.row_number().over(w)).where(F.col("stage_no") <= max_stages)


def positions(decisions: DataFrame, stage: str = "agent_name", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Position in the trace, previous stage and previous decision id."""
    return scan(decisions, ["trace_id"], ["timestamp", "id"], position="position",
                prev={"previous_stage": stage, "previous_decision_id": "id"}, slice_rows=slice_rows)


def nested(decisions: DataFrame, page_rows: int = PAGE_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Decisions nested per trace in time order, in pages of at most page_rows.

    A trace of ordinary length is one row (page 0); a very long trace is several, none cut off.
    """
    fields = [c for c in decisions.columns if c != "trace_id"]
    paged = pages(decisions, ["trace_id"], ["timestamp", "id"], page_rows, slice_rows=slice_rows)
    entry = F.struct("position", *fields)
    return paged.groupBy("trace_id", "page").agg(F.array_sort(F.collect_list(entry)).alias("decisions"))


def pipeline_traces(
    headers: DataFrame, decisions: DataFrame, page_rows: int = PAGE_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Headers with their decision pages. A header alone has an empty list; decisions alone get a
    made-up header with empty name and status `running`.

    The full join is a left join from the pages, whose skew Spark can split, and the headers without
    decisions.
    """
    paged = nested(decisions, page_rows, slice_rows)
    alone = headers.join(decisions.select("trace_id").distinct(), "trace_id", "left_anti")
    joined = paged.join(headers, "trace_id", "left").unionByName(alone, allowMissingColumns=True)
    empty = F.array().cast(paged.schema["decisions"].dataType)
    return joined.select(
        "trace_id",
        F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("pipeline_name", F.lit("")).alias("pipeline_name"),
        "started_at", "completed_at",
        F.coalesce("status", F.lit("running")).alias("status"),
        F.coalesce("decisions", empty).alias("decisions"),
    )


def trace_text(decisions: DataFrame, outcomes: DataFrame, page_rows: int = PAGE_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Text summary per trace page: a header line and one line per decision."""
    line = decision_line(F.col("agent_name"), F.col("action"), F.col("approved"), F.col("reasoning.confidence"),
                         F.col("escalate_to_human"))
    lines = decisions.select("trace_id", "timestamp", "id", F.concat(F.lit("  "), line).alias("line"))
    paged = pages(lines, ["trace_id"], ["timestamp", "id"], page_rows, slice_rows=slice_rows)
    body = paged.groupBy("trace_id", "page").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("_l"))
    head = F.concat(F.lit("Trace: "), F.col("trace_id").cast("string"), F.lit(" ("), "status", F.lit(")"))
    text = F.array_join(F.concat(F.array(head), F.transform("_l", lambda x: x["line"])), "\n")
    return body.join(outcomes.select("trace_id", "status"), "trace_id").select("trace_id", "page", text.alias("summary"))


def bounded_history(events: DataFrame, n: int = 1000) -> DataFrame:
    """The newest n events."""
    return events.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def reward_signals(decisions: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Mean reward and counts per agent."""
    conf = confidence if confidence is not None else F.col("reasoning.confidence")
    return decisions.groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if("approved").alias("successes"),
        F.avg(reward(F.col("approved"), conf)).alias("mean_reward"),
    )


def reward_trend(decisions: DataFrame, confidence: Column | None = None, days: Sequence[int] = (7, 30)) -> DataFrame:
    """Mean reward over trailing days per agent and day.

    Days are summed first, so the window runs over one row per agent and day.
    """
    conf = confidence if confidence is not None else F.col("reasoning.confidence")
    daily = decisions.groupBy("agent_name", F.to_date("timestamp").alias("day")).agg(
        F.sum(reward(F.col("approved"), conf)).alias("_s"), F.count(F.lit(1)).alias("decisions"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    out = daily
    for d in days:
        w = W.partitionBy("agent_name").orderBy(number).rangeBetween(-(d - 1), 0)
        out = out.withColumn(f"reward_{d}d", F.sum("_s").over(w) / F.sum("decisions").over(w))
    return out.drop("_s")


def carry_forward(decisions: DataFrame, columns: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Payload accumulated along a trace: the latest non-null value of each key so far, later wins."""
    kept = decisions.select("trace_id", "timestamp", "id", *columns)
    return scan(kept, ["trace_id"], ["timestamp", "id"], last={f"payload_{c}": c for c in columns}, slice_rows=slice_rows)


def running_payload(entries: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(trace_id, timestamp, id, payload map) with `carried`: all that the run has written so far, under any keys, later wins."""
    kept = entries.select("trace_id", "timestamp", "id", "payload")
    return running_map(kept, ["trace_id"], ["timestamp", "id"], "payload", "carried", slice_rows)


def final_payload(entries: DataFrame) -> DataFrame:
    """Final payload map per trace from (trace_id, timestamp, id, payload map): newest value per key."""
    exploded = entries.select("trace_id", "timestamp", "id", F.explode("payload").alias("k", "v"))
    newest = exploded.groupBy("trace_id", "k").agg(F.max_by("v", F.struct("timestamp", "id")).alias("v"))
    return newest.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("payload"))


def lineage_pairs(decisions: DataFrame) -> DataFrame:
    """Each decision with the decision it followed, by `previous_decision_id`."""
    parent = decisions.select(
        F.col("id").alias("previous_decision_id"), F.col("agent_name").alias("previous_agent"),
        F.col("approved").alias("previous_approved"))
    return decisions.join(parent, "previous_decision_id")


def lineage_roots(links: DataFrame) -> DataFrame:
    """(id, parent) to (id, root, depth, cyclic), one row per input row, by pointer doubling.

    Chains of length n take log2(n) rounds; only rows that have not met their root are carried on, by one join a round. Where a
    row is left whose chain ends, one at the very distance of this round meets its root. So a round in which none does leaves
    only rows that lie on a cycle or lead into one: cyclic, without root and depth.
    """
    known = links.select(F.col("id").alias("parent"), F.lit(True).alias("_known")).distinct()
    start = materialise(links.join(known, "parent", "left").select(
        "id", F.when(F.col("_known"), F.col("parent")).alias("ptr")), "lineage")
    done = start.where("ptr IS NULL").select("id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("depth"))
    pending = start.where("ptr IS NOT NULL").select("id", "ptr", F.lit(1).cast("bigint").alias("depth"))
    while not pending.isEmpty():
        ahead = done.select(F.col("id").alias("ptr"), F.col("root").alias("_p"), F.col("depth").alias("_d"), F.lit(True).alias("met")).union(
            pending.select(F.col("id").alias("ptr"), F.col("ptr").alias("_p"), F.col("depth").alias("_d"), F.lit(False)))
        moved = materialise(pending.join(ahead, "ptr").select(
            "id", F.col("_p").alias("ptr"), (F.col("depth") + F.col("_d")).alias("depth"), "met"), "lineage")
        met = moved.where("met").select("id", F.col("ptr").alias("root"), "depth")
        pending = moved.where("NOT met").drop("met")
        if met.isEmpty():
            break
        done = done.union(met)
    lost = pending.select("id", F.lit(None).cast(done.schema["root"].dataType).alias("root"),
                          F.lit(None).cast("bigint").alias("depth"), F.lit(True).alias("cyclic"))
    return done.withColumn("cyclic", F.lit(False)).union(lost)

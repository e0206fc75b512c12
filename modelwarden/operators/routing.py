"""Event routing, authority checks, stage graphs and delegations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from modelwarden.functions.patterns import glob_match, glob_tokens, scope_match
from modelwarden.operators.ordered import latest_by
from modelwarden.session import materialise, work_dir

#: Marks of the ends of a name and of a wildcard in a pattern's fixed text; groups in which patterns without fixed text meet names.
BEGIN, END, GAP = "\x02", "\x03", "\x01"
SALTS = 64
OUTCOMES = ["on_success", "on_failure", "on_drift", "on_degradation", "on_sufficient_feedback"]


def active_subscriptions(log: DataFrame) -> DataFrame:
    """Subscriptions in force from a log (pattern, handler, op, seq).

    An unsubscribe removes every earlier registration of that handler under that pattern; a handler
    registered twice receives an event twice.
    """
    off = log.where("op = 'unsubscribe'").groupBy("pattern", "handler").agg(F.max("seq").alias("_off"))
    on = log.where("op = 'subscribe'").join(off, ["pattern", "handler"], "left")
    return on.where(F.coalesce(F.col("seq") > F.col("_off"), F.lit(True))).select("pattern", "handler", "seq")


def _grams(text: str, size: int) -> str:
    """SQL of all stretches of `size` characters of a text; a shorter one gives itself."""
    return f"transform(sequence(1, greatest(length({text}) - {size - 1}, 1)), i -> substr({text}, i, {size}))"


def name_keys(names: DataFrame) -> DataFrame:
    """(type, key): the name, its stretches of one to three characters with the marks of its ends, and its group."""
    grams = ", ".join(_grams("t", n) for n in (1, 2, 3))
    marked = names.selectExpr("type", f"concat('{BEGIN}', type, '{END}') AS t")
    return marked.selectExpr("type", f"""explode(array_append(array_distinct(concat(array(t), {grams})),
        concat('{GAP}', pmod(xxhash64(type), {SALTS})))) AS key""")


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """(pattern, every, key): a matching name has all keys of a pattern if `every`, else one of them.

    A pattern without wildcards has itself as its key. One with fixed text has the three-character stretches of that text, or its
    two- or one-character pieces; the ends of a name count as characters. One without, that begins with a set, has the first
    characters allowed. A pattern that fixes nothing (`*`, `?*`) has all groups of names as keys.
    """
    tokens = patterns.where("pattern is not null").select("pattern", glob_tokens(F.col("pattern")).alias("t"))
    fixed = tokens.selectExpr("pattern", "get(t, 0) AS head", f"""concat('{BEGIN}', array_join(transform(t, x -> CASE
        WHEN x IN ('*', '?') OR length(x) > 1 AND startswith(x, '[') THEN '{GAP}' ELSE x END), ''), '{END}') AS text""")
    pieces = fixed.selectExpr("*", f"filter(split(text, '{GAP}'), p -> p NOT IN ('', '{BEGIN}', '{END}')) AS pieces")
    sized = pieces.selectExpr("*", "least(coalesce(array_max(transform(pieces, p -> length(p))), 0), 3) AS n")
    return sized.selectExpr("pattern", f"n > 0 AND contains(text, '{GAP}') AS every", rf"""explode(CASE
        WHEN NOT contains(text, '{GAP}') THEN array(text)
        WHEN n > 0 THEN array_distinct(flatten(transform(filter(pieces, p -> length(p) >= n),
            p -> transform(sequence(1, length(p) - n + 1), i -> substr(p, i, n)))))
        WHEN head RLIKE r'\A\[[^!\]-][^\]-]*\]\z' THEN transform(
            filter(split(substr(head, 2, length(head) - 2), ''), c -> c <> ''), c -> concat('{BEGIN}', c))
        ELSE transform(sequence(0, {SALTS - 1}), i -> concat('{GAP}', i)) END) AS key""")


def matching(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(type, pattern) of distinct names and distinct patterns that match.

    An index of character stretches: every pattern is looked up by the one stretch of its fixed text that fewest names hold, so
    only names with that stretch are tried. A pattern that fixes nothing matches all names of some length; it
    meets the names in SALTS groups, which costs no more than its matches.
    """
    held, wanted = name_keys(names.where("type is not null")), pattern_keys(patterns)
    common = held.groupBy("key").agg(F.count(F.lit(1)).alias("names"))
    # A stretch that no name holds has no count: its pattern matches nothing, and looks that stretch up.
    ranked = wanted.join(common, "key", "left").withColumn("place", F.row_number().over(
        W.partitionBy("pattern").orderBy(F.col("names").asc_nulls_first(), "key")))
    tried = held.join(ranked.where("place = 1 OR NOT every"), "key").select("type", "pattern").distinct()
    return tried.where(glob_match(F.col("type"), F.col("pattern")))


def routes(types: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The rows of `types` (distinct types) and `subscriptions` whose type and pattern match."""
    found = matching(types.select("type"), subscriptions.select("pattern").distinct())
    return types.join(found, "type").join(subscriptions, "pattern").select(*types.columns, *subscriptions.columns)


def delivery_counts(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(type, pattern, handler, deliveries): both sides are counted first, so no event meets a registration."""
    types = events.groupBy("type").agg(F.count(F.lit(1)).alias("_events"))
    subs = subscriptions.groupBy("pattern", "handler").agg(F.count(F.lit(1)).alias("_times"))
    return routes(types, subs).select("type", "pattern", "handler", (F.col("_events") * F.col("_times")).alias("deliveries"))


def route_events(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per event and matching registration.

    Patterns are matched once per distinct type; events then join on the type.
    """
    table = routes(events.select("type").distinct(), subscriptions).select("type", "pattern", "handler")
    return events.join(table, "type")


def route_static(events: DataFrame, subscriptions: list[tuple[str, str]]) -> DataFrame:
    """Routing with plan-time subscriptions: stateless columns, usable on streams."""
    hits = [
        F.when(glob_match(F.col("type"), p), F.struct(F.lit(p).alias("pattern"), F.lit(h).alias("handler")))
        for p, h in subscriptions
    ]
    return events.withColumn("_h", F.explode(F.array_compact(F.array(*hits)))).select(*events.columns, "_h.*")


def _allowed_pairs(decisions: DataFrame, scopes: DataFrame, agent: str, action: str) -> DataFrame:
    """Distinct (agent, action) pairs that a scope allows; agents without scopes are not restricted."""
    pairs = decisions.select(F.col(agent).alias("_agent"), F.col(action).alias("_action")).distinct()
    joined = pairs.join(scopes.select(F.col("agent_name").alias("_agent"), "scope"), "_agent", "left")
    ok = F.col("scope").isNull() | scope_match(F.col("_action"), F.col("scope"))
    return joined.where(ok).select("_agent", "_action").distinct()


def authorised(decisions: DataFrame, scopes: DataFrame, agent: str = "agent_name", action: str = "action") -> DataFrame:
    allowed = _allowed_pairs(decisions, scopes, agent, action)
    on = (F.col(agent) == F.col("_agent")) & (F.col(action) == F.col("_action"))
    return decisions.join(allowed, on, "left_semi")


def violations(decisions: DataFrame, scopes: DataFrame, agent: str = "agent_name", action: str = "action") -> DataFrame:
    allowed = _allowed_pairs(decisions, scopes, agent, action)
    on = (F.col(agent) == F.col("_agent")) & (F.col(action) == F.col("_action"))
    return decisions.join(allowed, on, "left_anti")


def stage_edges(stages: DataFrame) -> DataFrame:
    """(stage, outcome, pos, target) from a stage table with one array per outcome."""
    present = [c for c in OUTCOMES if c in stages.columns]
    long = stages.select("stage", F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in present]), F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in present])
    )).alias("outcome", "targets"))
    return long.select("stage", "outcome", F.posexplode("targets").alias("pos", "target"))


def dangling(edges: DataFrame, stages: DataFrame) -> DataFrame:
    """Edges whose target is not a stage."""
    names = stages.select(F.col("stage").alias("target")).distinct()
    return edges.join(names, "target", "left_anti")


def next_stage(decisions: DataFrame, stages: DataFrame, stage: str = "stage") -> DataFrame:
    """Executed decisions with the first success or failure target; escalation ends the run."""
    cfg = stages.select(F.col("stage").alias(stage), F.get("on_success", F.lit(0)).alias("_s"),
                        F.get("on_failure", F.lit(0)).alias("_f"))
    target = F.when(F.col("escalate_to_human"), F.lit(None).cast("string")).otherwise(
        F.when(F.col("approved"), F.col("_s")).otherwise(F.col("_f")))
    return decisions.join(cfg, stage).withColumn("next_stage", target).drop("_s", "_f")


def observed_transitions(positions: DataFrame) -> DataFrame:
    """Transitions between stages seen in traces, with counts."""
    return positions.where("previous_stage IS NOT NULL").groupBy(
        F.col("previous_stage").alias("stage"), F.col("agent_name").alias("target")
    ).agg(F.count(F.lit(1)).alias("n"))


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, target, depth) with the smallest depth, over a possibly cyclic graph of (stage, target).

    Goes on until a round finds nothing new. Each round is written to the shared work folder, so the plan does not grow.
    """
    spark = edges.sparkSession
    folder = work_dir(spark, "reach")
    edges = materialise(edges.select("stage", "target").distinct(), "edges")
    seen = roots.select(F.col("stage").alias("root"), F.col("stage").alias("target"), F.lit(0).alias("depth")).distinct()
    schema, depth = seen.schema, 0
    seen.write.parquet(f"{folder}/depth-0")
    while True:
        seen = spark.read.schema(schema).parquet(*[f"{folder}/depth-{i}" for i in range(depth + 1)])
        last = seen.where(F.col("depth") == depth).select("root", F.col("target").alias("stage"))
        fresh = last.join(edges, "stage").select("root", "target").distinct().join(
            seen.select("root", "target"), ["root", "target"], "left_anti")
        depth += 1
        fresh.withColumn("depth", F.lit(depth)).write.parquet(f"{folder}/depth-{depth}")
        if spark.read.schema(schema).parquet(f"{folder}/depth-{depth}").isEmpty():
            return seen


#: Steps along edges that one written round takes.
STEPS = 4


def _contracted(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, core) of a graph of distinct edges (stage, target) without loops.

    A round takes out stages with at most one successor or at most one predecessor whose turn (a hash) comes before that of all
    their neighbours, and links their predecessors straight to their successors. What the others reach of one another stays,
    and each stage taken out costs at least an edge. Chains and rings get shorter by about a third a round, so rounds grow with
    the logarithm of their length. The core has the edges where every stage has two and more on both sides; a graph without
    cycles has none.

    A round's table is its edges with `goes`: whether the edge's stage, or `comes`: its target was taken out.
    """
    rounds, number, before = [], 0, edges.count()
    while before:
        turn = f"xxhash64({{}}, {number})"
        ends = edges.selectExpr("stage", f"struct({turn.format('target')} AS h, target AS s) AS other", "1 AS follow", "0 AS lead").union(
            edges.selectExpr("target", f"struct({turn.format('stage')}, stage)", "0", "1"))
        counts = ends.groupBy("stage").agg(F.sum("follow").alias("follow"), F.sum("lead").alias("lead"), F.min("other").alias("other"))
        light = counts.where("least(follow, lead) < 2")
        chosen = light.where(f"struct({turn.format('stage')}, stage) < other").select("stage", F.lit(True).alias("goes"))
        tagged = edges.join(chosen, "stage", "left").join(chosen.toDF("target", "comes"), "target", "left").select(
            "stage", "target", F.coalesce("goes", F.lit(False)).alias("goes"), F.coalesce("comes", F.lit(False)).alias("comes"))
        tagged = materialise(tagged, "tagged")
        kept = tagged.where("NOT goes AND NOT comes").select("stage", "target")
        bridged = _taken(tagged).where("before <> after").select("before", "after")
        left = Observation()
        edges = materialise(kept.union(bridged).distinct().observe(left, F.count(F.lit(1)).alias("n")), "edges")
        now, number = left.get["n"], number + 1
        if now < before:
            rounds.append(tagged)
        elif light.isEmpty():
            break
        before = now
    return rounds, edges


def _taken(tagged: DataFrame) -> DataFrame:
    """(before, stage, after): predecessors and successors of the stages that a round took out."""
    into = tagged.where("comes").select(F.col("stage").alias("before"), F.col("target").alias("stage"))
    return into.join(tagged.where("goes").select("stage", F.col("target").alias("after")), "stage").select("before", "stage", "after")


def _first_ancestors(edges: DataFrame) -> DataFrame:
    """(stage, label): of the stages from which each stage can be reached, itself included, the first by hash and name."""
    stages = edges.select("stage").union(edges.select("target")).distinct()
    labels = materialise(stages.withColumn("label", F.struct(F.xxhash64("stage").alias("h"), "stage")), "labels")
    while True:
        new = labels
        for _ in range(STEPS):
            passed = edges.join(new, "stage").select(F.col("target").alias("stage"), "label")
            new = new.union(passed).groupBy("stage").agg(F.min("label").alias("label"))
        new = materialise(new, "labels")
        if new.join(labels, ["stage", "label"], "left_anti").isEmpty():
            return new
        labels = new


def _parts_of_core(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stage, part) of the parts that this round finds, and the edges where others may be.

    Every stage gets the first stage that reaches it as its label. The stages that reach the one named by their label, within
    that label, form a strongly connected part. No part crosses labels, so edges between labels go as well: names are in no
    order (by hash), hence rounds grow with the logarithm of the number of parts in a row.
    """
    labels = _first_ancestors(live)
    inner = (live.join(labels, "stage").join(labels.select(F.col("stage").alias("target"), F.col("label").alias("_to")), "target")
             .where("label = _to").select("stage", "target"))
    inner = materialise(inner, "inner")
    part = materialise(labels.where("stage = label.stage").select("stage"), "part")
    while True:
        new = part
        for _ in range(STEPS):
            new = new.union(inner.join(new.withColumnRenamed("stage", "target"), "target").select("stage")).distinct()
        new = materialise(new, "part")
        if new.count() == part.count():
            break
        part = new
    ends = part.withColumnRenamed("stage", "target")
    own = inner.join(part, "stage", "left_semi").join(ends, "target", "left_semi").select("stage").distinct()
    own = materialise(own.join(labels, "stage").select("stage", F.col("label.stage").alias("part")), "own")
    rest = inner.join(part, "stage", "left_anti").join(ends, "target", "left_anti").select("stage", "target")
    return own, materialise(rest, "edges")


def cycle_parts(edges: DataFrame) -> DataFrame:
    """(stage, part) of the stages that can reach themselves, found without listing what reaches what.

    `part` is the smallest stage of the strongly connected part. The graph is contracted, which leaves the parts of the other
    stages as they are; parts of a core are found by labels, and what they leave is contracted again. Then rounds are undone
    from the last to the first: a stage taken out belongs to a part if a predecessor and a successor are in the same one.
    """
    spark, folder = edges.sparkSession, work_dir(edges.sparkSession, "parts")
    links = materialise(edges.select("stage", "target").where("stage IS NOT NULL AND target IS NOT NULL").distinct(), "edges")
    rounds, live = _contracted(links.where("stage <> target"))
    schema = links.select("stage", F.col("stage").alias("part")).schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/core-0")
    paths = [f"{folder}/core-0"]
    while not live.isEmpty():
        own, rest = _parts_of_core(live)
        paths.append(f"{folder}/core-{len(paths)}")
        own.write.parquet(paths[-1])
        more, live = _contracted(rest)
        rounds += more
    for number, tagged in reversed(list(enumerate(rounds))):
        known = spark.read.schema(schema).parquet(*paths)
        sides = _taken(tagged).join(known.toDF("before", "first"), "before", "left").join(known.toDF("after", "last"), "after", "left")
        met = sides.withColumn("part", F.coalesce("first", "before")).where(F.col("part") == F.coalesce("last", "after"))
        paths.append(f"{folder}/round-{number}")
        met.select("stage", "part").distinct().write.parquet(paths[-1])
    known = spark.read.schema(schema).parquet(*paths)
    loops = links.where("stage = target").select("stage").join(known, "stage", "left_anti").select("stage", F.col("stage").alias("part"))
    members = known.union(known.select("part", "part")).union(loops).distinct()
    names = members.groupBy("part").agg(F.min("stage").alias("least"))
    return materialise(members.join(names, "part").select("stage", F.col("least").alias("part")), "parts")


def on_cycle(edges: DataFrame) -> DataFrame:
    """Stages that can reach themselves."""
    return cycle_parts(edges).select("stage")


def reach_counts(edges: DataFrame) -> DataFrame:
    """(stage, part, n_reachable): for every stage the number of stages it can reach, itself included.

    Strongly connected parts reach the same stages, so each becomes one node (named by its smallest stage) of a graph without
    cycles, which is contracted until no edge is left. What a node reaches is kept as bitmaps of 32,768 stages, only for the
    blocks of stages that it reaches at all. Going through the rounds, a node taken out hands what it holds to its
    predecessors; going back, it gets what its successors reach. No (stage, target) pairs are listed, and there are as many
    rounds as the logarithm of the longest path has.
    """
    spark, folder = edges.sparkSession, work_dir(edges.sparkSession, "reach")
    edges = materialise(edges.select("stage", "target").where("stage IS NOT NULL AND target IS NOT NULL").distinct(), "edges")
    stages = edges.select("stage").union(edges.select("target")).distinct()
    parts = stages.join(cycle_parts(edges), "stage", "left").withColumn("part", F.coalesce("part", "stage"))
    # Ids are dense inside a task and begin at a block of their own; written, so that they stay.
    parts = materialise(parts.orderBy("part").withColumn("id", F.monotonically_increasing_id()), "parts")
    ends = parts.select(F.col("stage").alias("target"), F.col("part").alias("to"))
    steps = edges.join(parts.select("stage", "part"), "stage").join(ends, "target").where("part <> to")
    rounds, _ = _contracted(materialise(steps.select(F.col("part").alias("stage"), F.col("to").alias("target")).distinct(), "steps"))

    held: list[str] = []
    bitmaps = spark.createDataFrame([], parts.select("part").schema).selectExpr("part", "0L AS block", "X'' AS bits").schema

    def holding(nodes: DataFrame) -> DataFrame:
        """Bitmaps of the nodes (part) themselves and of what was handed to them."""
        own = parts.join(nodes, "part", "left_semi").groupBy("part", F.bitmap_bucket_number("id").alias("block")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        return own.union(spark.read.schema(bitmaps).parquet(*held).join(nodes, "part", "left_semi")) if held else own

    def merged(rows: DataFrame, path: str) -> str:
        rows.groupBy("part", "block").agg(F.bitmap_or_agg("bits").alias("bits")).write.parquet(path)
        return path

    gone = [t.where("goes").select(F.col("stage").alias("part")).union(t.where("comes").select("target")).distinct() for t in rounds]
    for number, (tagged, nodes) in enumerate(zip(rounds, gone)):
        into = tagged.where("comes").select("stage", F.col("target").alias("part"))
        held.append(merged(holding(nodes).join(into, "part").select(F.col("stage").alias("part"), "block", "bits"),
                           f"{folder}/held-{number}"))
    last = parts.select("part").distinct()
    for nodes in gone:
        last = last.join(nodes, "part", "left_anti")
    reached = [merged(holding(materialise(last, "last")), f"{folder}/reached-last")]
    for number, (tagged, nodes) in reversed(list(enumerate(zip(rounds, gone)))):
        onward = tagged.where("goes").select(F.col("stage").alias("from"), F.col("target").alias("part"))
        passed = spark.read.schema(bitmaps).parquet(*reached).join(onward, "part").select(F.col("from").alias("part"), "block", "bits")
        reached.append(merged(holding(nodes).union(passed), f"{folder}/reached-{number}"))
    counts = spark.read.schema(bitmaps).parquet(*reached).groupBy("part").agg(F.sum(F.bitmap_count("bits")).alias("n_reachable"))
    return parts.select("stage", "part").join(counts, "part").select("stage", "part", "n_reachable")


def delegations(agents: DataFrame, scopes: dict[str, list[str]], orchestrator: str, hours: int = 24) -> DataFrame:
    """One row per (grantor, agent, scope) from agents (agent_name, granted_at), with expiry."""
    table = F.create_map(*[x for a, s in scopes.items() for x in (F.lit(a), F.array(*[F.lit(v) for v in s]))])
    return agents.select(
        F.lit(orchestrator).alias("grantor_name"), "agent_name", "granted_at",
        F.explode(F.try_element_at(table, F.col("agent_name"))).alias("scope"),
    ).withColumn("expires_at", F.col("granted_at") + F.expr(f"INTERVAL {int(hours)} HOURS"))


def active_delegations(rows: DataFrame, at: Column) -> DataFrame:
    live = rows.where((F.col("granted_at") <= at) & (F.col("expires_at") > at))
    return latest_by(live, ["agent_name", "scope"], ["granted_at"])


# Platform job states.
JOB_STATES = {
    "JOB_STATE_QUEUED": "pending", "JOB_STATE_PENDING": "pending", "JOB_STATE_RUNNING": "running",
    "JOB_STATE_SUCCEEDED": "succeeded", "JOB_STATE_FAILED": "failed", "JOB_STATE_CANCELLED": "cancelled",
    "JOB_STATE_CANCELLING": "running", "JOB_STATE_PAUSED": "running", "JOB_STATE_EXPIRED": "failed",
}


def job_status(state: Column, unknown: str = "running") -> Column:
    table = F.create_map(*[F.lit(x) for kv in JOB_STATES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, state), F.lit(unknown))

"""Alert and derived-event rules over the event log.

All windowed rules share one scan: matches are counted per (rule, grid cell),
which leaves at most one row per rule and step of time. Windows then come from
running totals over the grid, so their cost does not depend on their length.

A cell ``g`` of step ``s`` holds events in (g*s - s, g*s]; a window of m steps that
ends at ``g*s`` is closed at both ends, so events exactly on its start count too.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavetrail.functions.scalars import fixed
from wavetrail.operators.filters import Filter, all_of, resolve_field
from wavetrail.operators.ordered import NS
from wavetrail.operators.spacing import spaced_rows
from wavetrail.sources.work import stored

EPSILON = 2.220446049250313e-16
COMPARE = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "eq": lambda a, b: F.abs(a - b) < EPSILON,
    "ne": lambda a, b: F.abs(a - b) >= EPSILON,
}
MAX_CHAIN_DEPTH = 3


@dataclass(frozen=True)
class Rule:
    """A rule as data. ``kind`` is one of threshold, absence, rate_change,
    cardinality, new_value, correlation, every, first_occurrence."""

    id: int
    name: str
    kind: str
    filters: tuple[Filter, ...] = ()
    window_sec: int = 0
    op: str = "gte"
    value: float = 0.0
    percent: float = 0.0
    baseline_sec: int = 0
    field: str = ""
    second: tuple[Filter, ...] = ()
    history_filter: str = "all"
    group_by: tuple[str, ...] = ()
    cooldown_sec: int = 60
    event_type: str = "system.alert.fired"
    body_template: str = ""
    severity: int = 9
    chain_depth: int = 0
    enabled: bool = True
    priority: str = "MEDIUM"
    actions: tuple[str, ...] = ("log",)

    def to_row(self) -> dict:
        """The rule as one row: filters and condition are JSON documents."""
        condition = {
            k: getattr(self, k)
            for k in ("kind", "window_sec", "op", "value", "percent", "baseline_sec", "field", "history_filter")
        }
        condition["second"] = [json.loads(f.to_json()) for f in self.second]
        rest = {k: getattr(self, k) for k in ("event_type", "body_template", "severity", "chain_depth", "priority")}
        return {
            "id": self.id, "name": self.name, "enabled": self.enabled, "cooldown_sec": self.cooldown_sec,
            "filter_json": json.dumps([json.loads(f.to_json()) for f in self.filters]),
            "condition_json": json.dumps(condition), "output_json": json.dumps(rest),
        }

    @staticmethod
    def from_row(row) -> "Rule":
        c, o = json.loads(row["condition_json"]), json.loads(row["output_json"])
        second = tuple(Filter.from_json(x) for x in c.pop("second", ()))
        filters = tuple(Filter.from_json(x) for x in json.loads(row["filter_json"]))
        return Rule(row["id"], row["name"], filters=filters, second=second, enabled=row["enabled"], cooldown_sec=row["cooldown_sec"], **c, **o)


RULE_SCHEMA = "id int, name string, enabled boolean, cooldown_sec int, filter_json string, condition_json string, output_json string"


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([r.to_row() for r in rules], RULE_SCHEMA)


def load_rules(table: DataFrame) -> list[Rule]:
    """Enabled rules of a rule table; a table of rules is tens of rows."""
    return [Rule.from_row(r.asDict()) for r in table.where("enabled").orderBy("id").collect()]


# --- matching --------------------------------------------------------------


def matches(log: DataFrame, rules: list[Rule], second: bool = False) -> DataFrame:
    """Every event once per rule it matches, in one pass over the log."""
    test = lambda r: all_of(r.second if second else r.filters)
    ids = F.array(*[F.when(test(r), F.lit(r.id)) for r in rules])
    return log.withColumn("rule_id", F.explode(F.filter(ids, lambda i: i.isNotNull())))


def with_cell(df: DataFrame, step_s: int) -> DataFrame:
    step = step_s * NS
    return df.withColumn("cell", F.expr(f"(timestamp_ns + {step - 1}L) div {step}L")).withColumn(
        "edge", (F.col("timestamp_ns") % step == 0).cast("long")
    )


def grid(spark: SparkSession, rules: list[Rule], step_s: int, start_s: int, end_s: int) -> DataFrame:
    """Evaluation times start..end of every rule, with room for its longest look back."""
    back = {r.id: -(-max(r.window_sec, r.baseline_sec, 1) // step_s) for r in rules}
    longest = max(back.values())
    cells = spark.range(start_s // step_s - longest, end_s // step_s + 1).withColumnRenamed("id", "cell")
    return cells.withColumn("rule_id", F.explode(F.array(*[F.lit(r.id) for r in rules])))


def _per_rule(rules: list[Rule], value) -> Column:
    out = F.lit(None)
    for r in rules:
        out = F.when(F.col("rule_id") == r.id, F.lit(value(r))).otherwise(out)
    return out


def window_counts(log: DataFrame, rules: list[Rule], step_s: int, start_s: int, end_s: int) -> DataFrame:
    """For every rule and evaluation time: matches in the window and before it.

    ``current`` counts the closed window; ``older`` the closed span from the start
    of the baseline to the start of the window.
    """
    lo = (start_s - max(max(r.window_sec, r.baseline_sec) for r in rules) - step_s) * NS
    hit = matches(log.where(F.col("timestamp_ns").between(lo, end_s * NS)), rules)
    cells = with_cell(hit.select("rule_id", "timestamp_ns"), step_s).groupBy("rule_id", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("edge").alias("edges")
    )
    upto = Window.partitionBy("rule_id").orderBy("cell")
    totals = (
        grid(log.sparkSession, rules, step_s, start_s, end_s).join(cells, ["rule_id", "cell"], "left").fillna(0, ["n", "edges"])
        .withColumn("run", F.sum("n").over(upto)).select("rule_id", "cell", "run", "edges")
    )
    window = lambda r: max(r.window_sec // step_s, 1)
    baseline = lambda r: max(r.baseline_sec // step_s, window(r))
    # the grid has every cell of every rule, so a cell m steps back is the m-th row before
    here = F.struct("run", "edges")
    seen = totals.withColumn("w", _steps_back(here, rules, window, upto)).withColumn("b", _steps_back(here, rules, baseline, upto))
    return seen.where(F.col("cell") >= start_s // step_s).select(
        "rule_id", (F.col("cell") * step_s).alias("at_s"),
        (F.col("run") - F.col("w.run") + F.col("w.edges")).alias("current"),
        (F.col("w.run") - F.col("b.run") + F.col("b.edges")).alias("older"),
    )


def _steps_back(value: Column, rules: list[Rule], steps, ordered) -> Column:
    """A value as many rows before as the row's rule looks back."""
    out = F.lit(None)
    for n in sorted({steps(r) for r in rules}):
        out = F.when(F.col("rule_id").isin([r.id for r in rules if steps(r) == n]), F.lag(value, n).over(ordered)).otherwise(out)
    return out


def counted_firings(log: DataFrame, rules: list[Rule], step_s: int, start_s: int, end_s: int) -> DataFrame:
    """Threshold, absence and rate-change rules at every evaluation time."""
    seen = window_counts(log, rules, step_s, start_s, end_s)
    current = F.col("current").cast("double")
    tests = []
    for r in rules:
        mine = F.col("rule_id") == r.id
        if r.kind == "threshold":
            tests.append(mine & COMPARE[r.op](current, F.lit(float(r.value))))
        elif r.kind == "absence":
            tests.append(mine & (current == 0))
        elif r.kind == "rate_change":
            scale = r.window_sec / (r.baseline_sec - r.window_sec) if r.baseline_sec > r.window_sec else 1.0
            base = F.col("older") * F.lit(scale)
            tests.append(mine & (base >= 1) & (F.abs((current - base) / base * 100) >= r.percent))
        else:
            raise ValueError(f"rule {r.name} does not count a window")
    return seen.where(reduce(lambda a, b: a | b, tests)).select("rule_id", "at_s", F.col("current").alias("match_count"))


def distinct_firings(log: DataFrame, rules: list[Rule], step_s: int, start_s: int, end_s: int) -> DataFrame:
    """Cardinality rules: distinct values of a field in the window.

    Each value covers the evaluation times its cells can be seen from; the
    covers of a value are cut so they do not overlap, and the number of values
    seen is the running total of covers begun less covers ended.
    """
    lo = (start_s - max(r.window_sec for r in rules) - step_s) * NS
    hit = matches(log.where(F.col("timestamp_ns").between(lo, end_s * NS)), rules)
    value = reduce(lambda acc, r: F.when(F.col("rule_id") == r.id, resolve_field(r.field)[0].cast("string")).otherwise(acc), rules, F.lit(None).cast("string"))
    by = max(rules, key=lambda r: len(r.group_by)).group_by
    group = F.concat_ws("|", *[resolve_field(g)[0].cast("string") for g in by]) if by else F.lit("")
    cells = (
        with_cell(hit.select("rule_id", "timestamp_ns", group.alias("grp"), value.alias("val")).where(F.col("val").isNotNull()), step_s)
        .groupBy("rule_id", "grp", "val", "cell").agg(F.max("edge").alias("edge"))
    )
    m = _per_rule(rules, lambda r: max(r.window_sec // step_s, 1)).cast("long")
    nxt = F.lead("cell").over(Window.partitionBy("rule_id", "grp", "val").orderBy("cell"))
    covers = cells.withColumn("stop", F.least(F.col("cell") + m + F.col("edge"), F.coalesce(nxt, F.lit(2**62))))
    steps = covers.select(
        "rule_id", "grp",
        F.inline(F.array(F.struct(F.col("cell").alias("cell"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("cell"), F.lit(-1).alias("d")))),
    ).groupBy("rule_id", "grp", "cell").agg(F.sum("d").alias("d"))
    # The count holds from one change to the next, so only spans that fire are spelled out.
    w = Window.partitionBy("rule_id", "grp").orderBy("cell")
    spans = (
        steps.withColumn("n", F.sum("d").over(w))
        .withColumn("from", F.greatest(F.col("cell"), F.lit(start_s // step_s)))
        .withColumn("to", F.least(F.lead("cell").over(w) - 1, F.lit(end_s // step_s)))
        .where((F.col("n") > 0) & (F.col("from") <= F.col("to")))
    )
    fires = reduce(lambda a, b: a | b, [(F.col("rule_id") == r.id) & COMPARE[r.op](F.col("n").cast("double"), F.lit(float(r.value))) for r in rules])
    at = F.explode(F.sequence("from", "to"))
    return spans.where(fires).select("rule_id", "grp", at.alias("at"), F.col("n").alias("match_count")).select(
        "rule_id", "grp", (F.col("at") * step_s).alias("at_s"), "match_count"
    )


def new_value_firings(log: DataFrame, rule: Rule, step_s: int, start_s: int, end_s: int) -> DataFrame:
    """Values seen in the last step but not in the look-back before it."""
    lo = (start_s - rule.baseline_sec - step_s) * NS
    value = resolve_field(rule.field)[0].cast("string")
    span = log.where(F.col("timestamp_ns").between(lo, end_s * NS))
    mine = F.coalesce(all_of(rule.filters), F.lit(False))
    if rule.history_filter == "rule":
        span = span.where(mine)
    cells = (
        with_cell(span.select("timestamp_ns", value.alias("val"), mine.alias("mine")).where(F.col("val").isNotNull()), step_s)
        .groupBy("val", "cell").agg(F.max("edge").alias("edge"), F.max(F.col("mine").cast("int")).alias("mine"))
    )
    w = Window.partitionBy("val").orderBy("cell")
    back = rule.baseline_sec // step_s
    seen = cells.withColumn("pc", F.lag("cell").over(w)).withColumn("pe", F.lag("edge").over(w))
    known = (F.col("pc") > F.col("cell") - back) | ((F.col("pc") == F.col("cell") - back) & (F.col("pe") == 1))
    fresh = seen.where((F.col("mine") == 1) & ~F.coalesce(known, F.lit(False)) & F.col("cell").between(start_s // step_s, end_s // step_s))
    return fresh.groupBy((F.col("cell") * step_s).alias("at_s")).agg(F.count(F.lit(1)).alias("match_count")).withColumn("rule_id", F.lit(rule.id))


def correlation_firings(log: DataFrame, rule: Rule, step_s: int, start_s: int, end_s: int) -> DataFrame:
    """Times at which both streams carry the same value of the join field.

    Counts per (value, cell) are spread over the windows they belong to; the
    spread is of summaries, at most one per value and step.
    """
    m = max(rule.window_sec // step_s, 1)
    lo = (start_s - rule.window_sec - step_s) * NS
    value = resolve_field(rule.field)[0].cast("string")
    first, second = (F.coalesce(all_of(f), F.lit(False)) for f in (rule.filters, rule.second))
    rows = log.where(F.col("timestamp_ns").between(lo, end_s * NS) & (first | second)).select(
        "timestamp_ns", value.alias("val"), first.cast("long").alias("a"), second.cast("long").alias("b")
    )
    cells = with_cell(rows, step_s).groupBy("val", "cell").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"),
        F.sum(F.col("a") * F.col("edge")).alias("ae"), F.sum(F.col("b") * F.col("edge")).alias("be"),
    )
    spread = cells.withColumn("late", F.explode(F.sequence(F.lit(0), F.lit(m)))).where(
        (F.col("late") < m) | (F.col("ae") > 0) | (F.col("be") > 0)
    )
    full = F.col("late") < m
    per_value = spread.groupBy("val", (F.col("cell") + F.col("late")).alias("cell")).agg(
        F.sum(F.when(full, F.col("a")).otherwise(F.col("ae"))).alias("a"), F.sum(F.when(full, F.col("b")).otherwise(F.col("be"))).alias("b")
    )
    # Every primary event counts; secondary events only where their value was seen as primary.
    shared = F.col("val").isNotNull() & (F.col("a") > 0) & (F.col("b") > 0)
    out = per_value.where(F.col("cell").between(start_s // step_s, end_s // step_s)).groupBy("cell").agg(
        F.sum("a").alias("primary"), F.sum(F.when(shared, F.col("b")).otherwise(0)).alias("secondary")
    )
    return out.where(F.col("secondary") > 0).select(
        F.lit(rule.id).alias("rule_id"), (F.col("cell") * step_s).alias("at_s"), (F.col("primary") + F.col("secondary")).alias("match_count")
    )


# --- firing ----------------------------------------------------------------


def after_cooldown(candidates: DataFrame, rules: list[Rule], time: str = "at_s", unit: int = 1) -> DataFrame:
    """Firings left when each rule rests after every firing.

    Candidates of a rule at one time are one firing. ``unit`` is the number of
    ``time`` ticks per second.
    """
    parts = []
    for rest in sorted({r.cooldown_sec for r in rules}):
        ids = [r.id for r in rules if r.cooldown_sec == rest]
        part = candidates.where(F.col("rule_id").isin(ids)).select("rule_id", time)
        if rest > 0:
            part = spaced_rows(part, "rule_id", time, rest * unit)
        parts.append(part.distinct())
    return reduce(DataFrame.unionByName, parts)


def firing_log(firings: DataFrame, log: DataFrame, rules: list[Rule], step_s: int) -> DataFrame:
    """Firings with their rule's name and the newest matching event as sample."""
    hit = with_cell(matches(log, [r for r in rules if r.kind != "absence"]).select("rule_id", "id", "timestamp_ns"), step_s)
    newest = hit.groupBy("rule_id", "cell").agg(F.max(F.struct("timestamp_ns", "id")).alias("last"))
    m = _per_rule(rules, lambda r: max(r.window_sec // step_s, 1)).cast("int")
    wanted = firings.select("rule_id", "at_s").withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), m), lambda i: (F.col("at_s") / step_s).cast("long") - i)))
    found = wanted.join(newest, ["rule_id", "cell"], "left").where(
        F.col("last").isNull() | (F.col("last.timestamp_ns") >= F.col("at_s") * NS - _per_rule(rules, lambda r: r.window_sec * NS).cast("long"))
    )
    sample = found.groupBy("rule_id", "at_s").agg(F.max("last").alias("last"))
    named = firings.join(sample, ["rule_id", "at_s"], "left")
    return named.select(
        "rule_id", _per_rule(rules, lambda r: r.name).alias("rule_name"), (F.col("at_s") * NS).alias("fired_ns"), "match_count",
        F.col("last.id").alias("sample_event_id"), F.lit(False).alias("acknowledged"),
    )


def context(events: DataFrame, keys: list[str]) -> DataFrame:
    """What a set of events per key has in common, for texts and derived events.

    Values are counted before they are listed, so a list is as long as the
    number of different values. Lists run from frequent to rare (ties by value);
    radios in order of last appearance; the first values are the newest event's.
    """
    text = F.array(
        F.struct(F.lit("freqs").alias("f"), fixed(F.col("freq_mhz"), 4).alias("v")),
        F.struct(F.lit("talkgroups").alias("f"), F.col("talkgroup").cast("string").alias("v")),
        F.struct(F.lit("bands").alias("f"), F.col("band").alias("v")),
        F.struct(F.lit("uids").alias("f"), F.col("source_unit").cast("string").alias("v")),
    )
    newest = F.struct("timestamp_ns", "id")
    seen = (
        events.select(*keys, "timestamp_ns", "id", F.explode(text).alias("p")).where(F.col("p.v").isNotNull())
        .groupBy(*keys, "p.f", "p.v").agg(F.count(F.lit(1)).alias("n"), F.max(newest).alias("at"))
    )
    rank = F.when(F.col("f") == "uids", F.struct((-F.col("at.timestamp_ns")).alias("a"), (-F.col("at.id")).alias("b"), "v")).otherwise(
        F.struct((-F.col("n")).alias("a"), F.lit(0).cast("long").alias("b"), "v")
    )
    lists = seen.groupBy(*keys).agg(*[
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("f") == f, rank))), lambda s: s["v"]), ", ").alias(f)
        for f in ("freqs", "talkgroups", "uids", "bands")
    ] + [F.min_by("v", F.when(F.col("f") == "talkgroups", F.struct(-F.col("n"), F.col("v")))).cast("long").alias("primary_talkgroup")])
    first = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), newest))
    totals = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), first("freq_mhz").alias("primary_freq"), first("band").alias("primary_band")
    )
    return totals.join(lists, keys, "left")


def render(template: Column, ctx: dict[str, Column]) -> Column:
    """Fill ``{{name}}`` places of a template."""
    out = template
    for name, value in ctx.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return out


def derived_events(firings: DataFrame, log: DataFrame, rules: list[Rule], step_s: int) -> DataFrame:
    """The event each firing writes, from the events of its window."""
    hit = with_cell(matches(log, rules).select("rule_id", "id", "timestamp_ns", "freq_mhz", "talkgroup", "band", "source_unit"), step_s)
    m = _per_rule(rules, lambda r: max(r.window_sec // step_s, 1)).cast("int")
    cells = firings.withColumn("late", F.explode(F.sequence(F.lit(0), m))).withColumn(
        "cell", (F.col("at_s") / step_s).cast("long") - F.col("late")
    ).withColumn("_m", m)
    inside = hit.join(cells.select("rule_id", "at_s", "cell", "late", "_m"), ["rule_id", "cell"]).where(
        (F.col("late") < F.col("_m")) | (F.col("edge") == 1)
    )
    inside = stored(inside.select("rule_id", "at_s", "id", "timestamp_ns", "freq_mhz", "talkgroup", "band", "source_unit"), "inside")
    ctx = firings.join(context(inside, ["rule_id", "at_s"]), ["rule_id", "at_s"], "left")
    return _event_rows(ctx, rules, F.col("match_count"), F.col("at_s") * NS)


def every_events(log: DataFrame, rules: list[Rule], depth: int = 0) -> DataFrame:
    """One derived event per matching event; derived events feed deeper rules."""
    live = [r for r in rules if r.chain_depth <= depth < MAX_CHAIN_DEPTH]
    hit = matches(log, live)
    ctx = hit.select(
        "rule_id", "id", "timestamp_ns", F.lit(1).cast("long").alias("count"), fixed(F.col("freq_mhz"), 4).alias("freqs"),
        F.col("talkgroup").cast("string").alias("talkgroups"), F.col("source_unit").cast("string").alias("uids"), F.col("band").alias("bands"),
        F.col("freq_mhz").alias("primary_freq"), F.col("talkgroup").alias("primary_talkgroup"), F.col("band").alias("primary_band"),
    )
    rows = _event_rows(ctx, live, F.col("count"), F.col("timestamp_ns"), extra=["id"])
    return rows.withColumnRenamed("id", "source_event_id")


#: Columns of a log row that a derived event carries; filters on others do not match it.
_CARRIED = {"event_type": "string", "source": "int", "severity": "int", "timestamp_ns": "long", "body": "string", "freq_mhz": "double", "talkgroup": "long", "band": "string"}


def chain_events(log: DataFrame, rules: list[Rule], deepest: int = MAX_CHAIN_DEPTH) -> DataFrame:
    """Derived events of derived events, to the fixpoint.

    Each pass applies the rules to what the pass before added, never to older rows again. An event of the log has depth 0, a derived one
    the depth of its source plus one; nothing at depth ``deepest`` is looked at, which ends cycles of rules. A rule with a
    ``chain_depth`` starts at that depth. ``event_key`` names an event by the log event at its root and the rules that led to it,
    ``source_key`` the event it was derived from; both are the same in every run. One pass over the log for each depth, no shuffle.
    """
    names = ["id", *_CARRIED]
    rest = [f for f in log.schema.fields if f.name not in names]
    known = log.select("id", *[F.col(c).cast(t).alias(c) for c, t in _CARRIED.items()], *[f.name for f in rest])
    front = known.withColumn("event_key", F.col("id").cast("string"))
    out = None
    for depth in range(deepest):
        live = [r for r in rules if r.enabled and r.chain_depth <= depth]
        if not live:
            continue
        hit = matches(front, live)
        ctx = hit.select(
            "rule_id", "id", "timestamp_ns", "event_key", F.lit(1).cast("long").alias("count"), fixed(F.col("freq_mhz"), 4).alias("freqs"),
            F.col("talkgroup").cast("string").alias("talkgroups"),
            (F.col("source_unit").cast("string") if any(f.name == "source_unit" for f in rest) else F.lit(None).cast("string")).alias("uids"),
            F.col("band").alias("bands"), F.col("freq_mhz").alias("primary_freq"), F.col("talkgroup").alias("primary_talkgroup"), F.col("band").alias("primary_band"),
        )
        rows = _event_rows(ctx, live, F.col("count"), F.col("timestamp_ns"), extra=["id", "event_key"])
        added = rows.select(
            F.concat("event_key", F.lit(">"), F.col("rule_id").cast("string")).alias("event_key"), F.col("event_key").alias("source_key"),
            F.col("id").alias("root_id"), F.lit(depth + 1).alias("depth"), "rule_id", *_CARRIED,
        )
        out = added if out is None else out.unionByName(added)
        # the next pass sees the new events only, as rows of the log without the columns they do not carry
        front = added.select(F.col("root_id").alias("id"), *_CARRIED, *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest], "event_key")
    if out is None:
        raise ValueError("no enabled rule starts within the depth")
    return out


def _event_rows(ctx: DataFrame, rules: list[Rule], count: Column, ns: Column, extra: list[str] = []) -> DataFrame:
    names = {n: F.col(n) for n in ("freqs", "talkgroups", "uids", "bands")}
    body = render(_per_rule(rules, lambda r: r.body_template), {"count": count.cast("string"), **names})
    facts = F.struct(
        F.col("rule_id"), _per_rule(rules, lambda r: r.name).alias("rule_name"), count.alias("match_count"),
        _per_rule(rules, lambda r: r.chain_depth).alias("chain_depth"),
    )
    return ctx.select(
        *extra, "rule_id", _per_rule(rules, lambda r: r.event_type).alias("event_type"), F.lit(5).alias("source"),
        _per_rule(rules, lambda r: r.severity).alias("severity"), ns.alias("timestamp_ns"), body.alias("body"),
        F.col("primary_freq").alias("freq_mhz"), F.col("primary_talkgroup").alias("talkgroup"), F.col("primary_band").alias("band"),
        F.to_json(facts).alias("attributes"),
    )


def source_links(firings: DataFrame, log: DataFrame, rules: list[Rule], step_s: int) -> DataFrame:
    """Which events stand behind each firing, one row per event.

    A list inside the derived event would have no bound.
    """
    hit = with_cell(matches(log, rules).select("rule_id", "id", "timestamp_ns"), step_s)
    m = _per_rule(rules, lambda r: max(r.window_sec // step_s, 1)).cast("int")
    cells = firings.withColumn("_m", m).withColumn("late", F.explode(F.sequence(F.lit(0), m))).withColumn(
        "cell", (F.col("at_s") / step_s).cast("long") - F.col("late")
    )
    inside = hit.join(cells.select("rule_id", "at_s", "cell", "late", "_m"), ["rule_id", "cell"])
    return inside.where((F.col("late") < F.col("_m")) | (F.col("edge") == 1)).select("rule_id", "at_s", F.col("id").alias("event_id"))

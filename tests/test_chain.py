"""Chained rules: depth, links, cycles."""

from pyspark.sql import functions as F

from wavetrail.operators import filters as P
from wavetrail.operators.rules import Rule, chain_events

A = Rule(1, "a", "every", (P.Eq("type", "spectrum.detect"),), event_type="x.a", body_template="A {{bands}}")
B = Rule(2, "b", "every", (P.Eq("type", "x.a"),), event_type="x.b")
LOOP = Rule(3, "loop", "every", (P.Eq("type", "x.b"),), event_type="x.a")


def test_two_rules_in_a_chain_and_links(views):
    n = views.hits.count()
    got = chain_events(views.ev, [A, B])
    assert {(r.depth, r.rule_id): r["count"] for r in got.groupBy("depth", "rule_id").count().collect()} == {(1, 1): n, (2, 2): n}
    links = got.where("depth = 2").select(F.col("source_key").alias("event_key")).join(got, "event_key")
    assert links.where("depth = 1").count() == n
    assert got.select("event_key").distinct().count() == 2 * n


def test_a_cycle_ends_at_the_depth(views):
    n = views.hits.count()
    got = chain_events(views.ev, [A, B, LOOP])
    assert {r.depth: r["count"] for r in got.groupBy("depth").count().collect()} == {1: n, 2: n, 3: n}
    deep = chain_events(views.ev, [A, B, LOOP], 6)
    assert deep.groupBy("depth").count().count() == 6 and deep.count() == 6 * n


def test_rules_start_at_their_depth_and_may_be_off(views):
    n = views.hits.count()
    late = Rule(4, "late", "every", (P.Exists("type"),), event_type="x.late", chain_depth=1)
    off = Rule(5, "off", "every", (P.Exists("type"),), enabled=False)
    got = chain_events(views.ev, [A, late, off], 2)
    assert {(r.depth, r.rule_id): r["count"] for r in got.groupBy("depth", "rule_id").count().collect()} == {(1, 1): n, (2, 4): n}


def test_columns_a_derived_event_does_not_carry_never_match(views):
    more = Rule(6, "more", "every", (P.Exists("uid"),), event_type="x.more", chain_depth=1)
    assert chain_events(views.ev, [A, more]).where("rule_id = 6").isEmpty()
    assert chain_events(views.ev.limit(0), [A, B]).isEmpty()

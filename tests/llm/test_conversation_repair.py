import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from check import compare, connect
from support import SF, sha

from wavetrail.llm import conversation_repair as cr
from wavetrail.llm.registry import ORACLES, QUERIES

MESSAGES = "conv_id long, turn long, role string, text string, place int, kind string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def test_query_equals_sql(spark):
    state, note = compare(spark, connect(SF), "op11_conversation_repair", SF, QUERIES, ORACLES)
    assert state == "ok", note


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired): forward over states, keeping the least (cost, audit) of each."""
    turn = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for s, (cost, audit, wrote) in list(out.items()):
                t, role = turn[s]
                new = (cost + 3, audit + "I", (*wrote, f"{role}:"))
                out[t] = min(out.get(t, new), new)
        return out

    best = {0: (0, "", ())}
    for (role, text), fault in zip(rows, found):
        nxt = {}
        extra = 3 if fault == "truncated" else 0

        def offer(state, new):
            nxt[state] = min(nxt.get(state, new), new)

        # paths, not states: an insert before a row must not hide the path without it
        for s, (cost, audit, wrote) in best.items():
            for inserts in range(3):
                offer(s, (cost + 4, audit + "D", wrote))
                if fault not in ("blank", "duplicate"):
                    t, name = turn[s]
                    offer(t, (cost + 3 + extra, audit + "R", (*wrote, f"{name}:{text}")))
                    if (role[:1], s) in keep:
                        offer(keep[role[:1], s], (cost + extra, audit + "K", (*wrote, f"{role}:{text}")))
                t, name = turn[s]
                s, cost, audit, wrote = t, cost + 3, audit + "I", (*wrote, f"{name}:")
        best = nxt
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def row(conv, rows):
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {t for t, _, _ in rows if t is not None}
    plain = [(r, x) for _, r, x in rows]
    found = faults(plain)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
    cost, audit, wrote = cheapest(plain, found)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(wrote)))


def check(spark, messages, parts=3):
    df = spark.createDataFrame([(*m, 1, "x") for m in messages], MESSAGES).repartition(parts)
    own = defaultdict(list)
    for conv, *rest in messages:
        own[conv].append(rest)
    got = sorted(repr(tuple(r)) for r in cr.repair(df).collect())
    assert got == sorted(repr(row(c, r)) for c, r in own.items())


def conversation(rnd, conv, n):
    odd = rnd.random()
    roles = ["user", "assistant", "system", "tool", None, ""] if odd < 0.6 else ["user", "assistant"] if odd < 0.9 else ["user"]
    texts = ["a.", "b!", "c", "", " \t", None, "d? ", "e. "] if rnd.random() < 0.6 else [f"{i}." for i in range(99)]
    return [(conv, rnd.choice([i, i, i + 1, None]), rnd.choice(roles), rnd.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("chunk,fixups", [(4096, 3), (4, 50), (4, 0), (2, 2)])
def test_made_conversations_equal_brute_force(spark, monkeypatch, chunk, fixups):
    """Also cut into small chunks, where passes converge or the rest is folded."""
    monkeypatch.setattr(cr, "CHUNK", chunk)
    monkeypatch.setattr(cr, "FIXUPS", fixups)
    rnd = random.Random(chunk + fixups)
    messages = [m for conv in range(120) for m in conversation(rnd, conv, rnd.randrange(1, 14))]
    messages += conversation(rnd, None, 9) + [(500, i, "user", f"{i}.") for i in range(41)] + [(501, i, "x", f"{i}.") for i in range(40)]
    messages += [(502, 7, "user", "same.")] * 30 + [(503, i, ["user", "assistant"][i % 2], f"{i}.") for i in range(60)]
    check(spark, messages)


def test_damage(spark):
    messages = [(c, t, r, f"Is {c} at {t}? Yes. No!") for c in range(40) for t, r in enumerate(["system", "user", "assistant"])] + [(None, None, None, None), (7, None, "user", None)]
    got = sorted(repr(tuple(r)) for r in cr.damage(spark.createDataFrame([(*m, 1, "x") for m in messages], MESSAGES)).collect())
    want = []
    for c, t, r, x in messages:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        want += [repr((c, t, "user" if kind == 4 else r, x))] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want)


def test_empty_and_missing(spark):
    none = spark.createDataFrame([], MESSAGES)
    assert cr.repair(none).count() == 0
    ids = spark.createDataFrame([(5,), (None,), (5,)], "conv_id long")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(repr, map(tuple, cr.repair(none, ids).collect()))) == sorted(repr((c, 0, 0, 0, 0, 0, 0, "", empty)) for c in (5, None))


def test_long_conversation(spark):
    """One conversation in many chunks, one of them of a kind that never converges."""
    messages = [(1, i, "user", f"{i}.") for i in range(9000)] + [(2, i, ["user", "assistant"][i % 2], f"{i % 4500}.") for i in range(9000)] + [(3, 0, "user", "long " * 300_000)]
    own = {r.conv_id: r for r in cr.repair(spark.createDataFrame([(*m, 1, "x") for m in messages], MESSAGES)).collect()}
    assert own[1].cost == 3 * 4500 and own[1].audit == "KR" * 4500
    assert own[2].duplicate == 4500 and own[2].audit == "K" * 4500 + "D" * 4500
    assert own[3].audit == "D" and own[3].truncated == 1

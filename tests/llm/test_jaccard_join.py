import random
import re

import pytest
from support import SF, WORD, documents, given_documents

from wavetrail.llm import jaccard_join as jj
from wavetrail.llm.components import components
from wavetrail.llm.registry import QUERIES


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    distinct = sorted({frozenset(s) for s in sets if s}, key=len)
    linked = {s: 0 for s in distinct}
    number = {s: [] for s in distinct}
    for i, s in enumerate(sets):
        if s:
            number[frozenset(s)].append(i)
    for own in number.values():
        for i in own:
            parent[root(i)] = root(own[0])
    for x, a in enumerate(distinct):
        for b in distinct[x + 1 :]:
            if 100 * len(a) < 80 * len(b):
                break
            o = len(a & b)
            if 100 * o >= 80 * (len(a) + len(b) - o):
                linked[a] += 1
                linked[b] += 1
                parent[root(number[a][0])] = root(number[b][0])
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(repr((doc, len(s), least.get(root(i)) if s else doc, linked[frozenset(s)] if s else 0)) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.n_links)) for r in df.collect())


def families(rnd):
    rows = []
    for f in range(12):
        base = [rnd.choice("abcdefghij") + str(rnd.randrange(40)) for _ in range(rnd.choice([3, 5, 7, 30, 120]))]
        for _ in range(rnd.choice([1, 2, 9, 30])):
            text = list(base)
            for _ in range(rnd.randrange(1 + len(text) // 12)):
                text[rnd.randrange(len(text))] = "edit" + str(rnd.randrange(50))
            if rnd.random() < 0.3:
                text += ["Common", "passage", "that", "many", "share", "in", "all", "its", "words"] * 2
            rows.append((rnd.randrange(900), " ".join(text)))
    return rows + [(901, None), (902, ""), (903, " \n"), (None, rows[0][1]), (None, "one of a kind"), (905, "A b"), (906, "a  B"), (907, "a b c"), (7, "same id"), (7, "same id"), (7, "other text")]


@pytest.mark.parametrize("block", [1024, 4])
def test_families(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    monkeypatch.setattr(jj, "FRAGMENT", 16)
    rows = families(random.Random(6))
    assert got(jj.join_similar(documents(spark, rows).withColumnRenamed("n_chars", "node"))) == brute(rows)


def test_thresholds_are_exact():
    sets = [list(range(n)) for n in (4, 5, 80, 99, 100, 101, 125, 126)]
    import numpy as np

    linked = jj.compare([np.array(s) for s in sets], None)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert linked[i, j] == (i != j and 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b)))


def test_demand_holds_for_every_pair_of_sizes():
    import numpy as np

    sizes = np.arange(1, 400)
    reach, demand = jj.reach(sizes), jj.demand(sizes)
    assert demand.min() == 1 and (demand[jj.EVERY_SIZE :] == (reach - sizes // 5)[jj.EVERY_SIZE :]).all()
    tight = set()
    for n in range(1, 132):
        for m in range(n, 5 * n // 4 + 1):
            for o in range(-(-80 * (n + m) // 180), n + 1):
                # extra shingles have the smallest hashes, on one side or on both
                for a, b in ((n - o, m - o), (n - o, 0), (0, m - o)):
                    first = set(range(min(reach[n - 1] - a, o))) if a else set(range(min(reach[n - 1], o)))
                    common = len(first & set(range(min(reach[m - 1] - b, o))))
                    assert common >= demand[n - 1] and common >= demand[m - 1], (n, m, o)
                    tight |= {x for x in (n, m) if common == demand[x - 1]}
    assert tight >= set(range(4, 100))


def test_one_word_more_at_an_end(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(60):
        text = [f"w{k}x{rnd.randrange(10**9)}" for _ in range(8 if k % 2 else 9)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([f"first{k}", *text] if k % 3 else [*text, f"last{k}"]))]
    want = brute(rows)
    assert sum(eval(r)[3] for r in want) == 120
    assert got(jj.join_similar(documents(spark, rows))) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys([*range(41), 100], 0), 200: 200, 201: 200, 202: 200}


def test_empty_table_and_query(spark):
    assert jj.join_similar(documents(spark, [(1, "x")]).limit(0)).count() == 0
    assert got(QUERIES["op4_jaccard_join"](spark, SF)) == brute(given_documents())


def test_a_common_passage_ties_no_bundles_and_blocks_are_not_copied(spark):
    rnd = random.Random(9)
    passage = " ".join(f"common{i}" for i in range(14))
    rows = []
    for f in range(40):
        base = [f"w{f}x{i}" for i in range(60)]
        for k in range(3):
            text = list(base)
            text[rnd.randrange(60)] = f"edit{f}x{k}"
            rows.append((3 * f + k, " ".join([*text, passage])))
    docs = documents(spark, rows).selectExpr("doc_id", "xxhash64(text) row_key", "text")
    nodes = jj.survey(docs).selectExpr("node", "size AS n", "doc_id AS chosen")
    sets = jj.member_sets(docs.join(nodes.selectExpr("chosen AS doc_id", "node"), "doc_id").select("text", "node"))
    shared = jj.shared_sets(sets, nodes)
    sizes = [r["count"] for r in jj.bundles(shared).groupBy("component").count().collect()]
    assert sizes == [3] * 40
    stored = spark.createDataFrame([], "bundle long, block long, nodes binary, sizes binary, ends binary, numbers binary")
    plan = jj.links_across(stored)._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_shuffle_files_go_with_their_step(spark):
    import time
    from pathlib import Path

    from wavetrail.llm.work import CLEANUP, materialise

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [Path(str(d)) for d in env.blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*")}
    before = files()
    out = materialise(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "released")
    assert spark.conf.get(CLEANUP) == "false"
    for _ in range(50):
        left = {f for f in files() - before if f.stat().st_size}
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 7

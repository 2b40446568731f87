import random
import re

import pytest
from pyspark.sql import functions as F

from cumulus.llm import chosen_path
from cumulus.llm.staging import connected_components


def brute(rows, words, percent=80):
    """(n, component) of every id, from all pairs."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        n = min(words, len(w))
        sets.setdefault(i, []).append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set())
    root = {i: i for i in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    flat = [(i, s) for i, several in sets.items() if i is not None for s in several if s]
    for a, x in flat:
        for b, y in flat:
            if a < b and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((i, len(s), None if i is None else find(i)) for i, several in sets.items() for s in several
                  if i is not None) + sorted((None, len(s), None) for s in sets.get(None, []))


def got(out):
    rows = out.collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    named = sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None)
    return named + sorted((None, r.n_shingles, r.component_id) for r in rows if r.doc_id is None)


def near_copies(draw, base, count, changes):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(draw.randint(0, changes)):
            w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 60))) for _ in range(60)]
    for size, changes in ((2, 2), (5, 8), (40, 6)):
        texts += near_copies(draw, draw.choices(vocabulary, k=100), size, changes)
    texts += ["one", "ONE", "one ", "two words", "Two\tWords", None, "", "   ", None, "É x", "é x", texts[0], texts[0]]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return rows + [(0, texts[0]), (None, texts[1]), (None, None), (6, texts[70])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, component_id string")


@pytest.mark.parametrize("words", [2, 5])
def test_all_pairs(spark, corpus, words):
    assert got(chosen_path.components(frame(spark, corpus), words=words)) == brute(corpus, words)


@pytest.mark.parametrize("depths", [(3, 4), (1,)])
def test_large_nodes_branch_on_and_end_in_blocks(spark, corpus, monkeypatch, depths):
    monkeypatch.setattr(chosen_path, "SMALL_NODE", 2)
    monkeypatch.setattr(chosen_path, "DEPTHS", depths)
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    assert got(chosen_path.components(frame(spark, corpus), words=2)) == brute(corpus, 2)


def test_rows_compared_grow_with_the_group(spark, monkeypatch):
    """(documents, rows beside pairs of blocks, blocks) of a group of which many link with nothing, and of one four times as large."""
    seen = []
    links = chosen_path._links_in_blocks

    def counted(docs, pairs, similarity):
        ends = pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        seen.append((docs.count(), ends.join(docs, "block").count(), docs.select("block").distinct().count()))
        return links(docs, pairs, similarity)

    monkeypatch.setattr(chosen_path, "_links_in_blocks", counted)
    monkeypatch.setattr(chosen_path, "SMALL_NODE", 8)
    monkeypatch.setattr(chosen_path, "DEPTHS", (3,))
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    draw = random.Random(5)
    texts = near_copies(draw, [f"w{i}" for i in range(100)], 600, 16)
    for size in (150, 600):
        rows = list(enumerate(texts[:size]))
        assert got(chosen_path.components(frame(spark, rows), words=2)) == brute(rows, 2)
    (few, few_rows, _), (many, many_rows, blocks) = seen
    assert few > 100 and many > 3.5 * few
    assert many_rows <= 1.25 * few_rows * many / few and many_rows <= 12 * many
    monkeypatch.setattr(chosen_path, "BLOCK_BYTES", 16_000)  # the same in more tasks, when sets are large
    assert got(chosen_path.components(frame(spark, rows), words=2)) == brute(rows, 2)
    assert seen[2][0] == many and seen[2][2] > 2 * blocks


def test_empty_table(spark):
    out = chosen_path.components(spark.createDataFrame([], "doc_id long, text string"), words=2)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_trees_reach_the_recall():
    assert chosen_path.miss_chance(1, 0.8) == pytest.approx(0.16)
    trees = chosen_path.trees_for(1 - 1e-7, 3, 0.8)
    assert chosen_path.miss_chance(3, 0.8) ** trees <= 1e-7 < chosen_path.miss_chance(3, 0.8) ** (trees - 1)


def test_very_long_text_and_long_word(spark):
    text = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, text), (2, text + " tail"), (3, "x" * 3_000_000), (4, "x" * 3_000_000)]
    assert got(chosen_path.components(frame(spark, rows), words=2)) == brute(rows, 2)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201)]
    out = {r.id: r.component_id for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_no_task_runs_two_python_functions(spark):
    base = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, "f"), (None, "g")], "id long, text string")
    texts, mask = chosen_path._needed_texts(base, spark.range(1, 4, 2))  # small enough for a broadcast
    sets = chosen_path._sets(texts, 2)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    steps = [s for s in re.findall(r"MapInArrow|BroadcastExchange|Exchange", plan) if s != "BroadcastExchange"]
    first, last = (f(k for k, s in enumerate(steps) if s == "MapInArrow") for f in (min, max))
    assert first < last and "Exchange" in steps[first:last] and "Broadcast" not in plan
    assert sorted((r.id, len(r.members) // 8) for r in sets.collect()) == [(1, 2), (3, 1)]
    mask.destroy()

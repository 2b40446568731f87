from pyspark.sql import functions as F

from cumulus.llm import preference

TURNS = "array<struct<role:string,text:string>>"


def test_prompt_and_masks(spark):
    same = [("user", "hi"), ("assistant", "hello")]
    rows = [
        (1, same + [("user", "é日"), ("assistant", "A")], same + [("user", "é日"), ("assistant", "B"), ("user", "more")]),
        (2, same, same), (3, same, []), (4, None, same), (5, same, same[:1]),
        (6, [("user", "x")], [("system", "x")]), (7, same[:1], same[:1] + [("assistant", "")]),
    ]
    pairs = spark.createDataFrame(rows, f"id long, chosen {TURNS}, rejected {TURNS}").selectExpr("*", "'z' AS prompt_note")
    out = {r.id: r for r in preference.format_pairs(pairs).collect()}
    assert [out[i].prompt_turns for i in range(1, 8)] == [3, 2, 0, 0, 1, 0, 1]
    assert out[1].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\né日<|end|>\n"
    assert out[1].chosen == "<|assistant|>\nA<|end|>\n" and out[1].prompt_note == "z"
    assert out[2].chosen == out[2].rejected == "" and out[2].chosen_spans == []
    for r in out.values():
        for text, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
            for s in spans:
                cut = text[s.start:s.start + s.length]
                assert cut.endswith("<|end|>\n") and text[:s.start].endswith("<|assistant|>\n")
            assert sum(s.length for s in spans) == sum(
                len(p.split("\n", 1)[1]) + len("<|end|>\n") for p in text.split("<|end|>\n")[:-1]
                if p.startswith("<|assistant|>"))


def test_turns_with_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "x"),
            (2, 0, "user", "b"), (2, 0, "user", "a")]
    out = {r.id: [(t.role, t.text) for t in r.turns] for r in preference.turns_of(spark.createDataFrame(
        [(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, id string")).collect()}
    assert out == {1: [("user", "a"), ("assistant", "b"), ("", "")], 2: [("user", "a"), ("user", "b")]}


def test_partners_and_own_answers(spark):
    def talk(i, *texts):
        return [(i, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)]

    rows = talk(1, "q", "x") + talk(2, "other", "y", "again", "z") + talk(3, "q", "w") + talk(70, "q", "v") + talk(4, "lone")
    rows += talk(63, "q", "a") + talk(64, "q", "b") + talk(700, "q", "c")
    out = {r.conv_id: r for r in preference.pairs_of(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {i: r.rejected_id for i, r in out.items()} == {1: 3, 2: None, 3: 63, 63: 64, 64: 70, 70: 700, 700: None, 4: None}
    assert [t.text for t in out[1].rejected] == ["q", "w"]
    assert [t.text for t in out[2].rejected] == ["other", "y", "again", "y"]
    assert [t.text for t in out[700].rejected] == ["q", ""] and [t.text for t in out[4].rejected] == ["lone"]


def test_a_hot_opening_over_many_partitions(spark):
    """Every conversation gets the next of its opening, whatever the layout, and no task holds the hot opening."""
    ids = spark.range(0, 60_000, 1, 8).selectExpr("id * 7919 % 1000003 AS id").selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('o', id % 5000) END AS opening")
    held: dict[str, list[int]] = {}
    for r in ids.collect():
        held.setdefault(r.opening, []).append(r.id)
    want = {(a, b) for v in held.values() for a, b in zip(sorted(v), sorted(v)[1:])}
    for parts in (1, 16):
        assert {tuple(r) for r in preference.partners(ids.repartition(parts)).collect()} == want


def test_clashing_names_and_a_long_text(spark):
    long = "é x" * 400_000
    pairs = spark.createDataFrame([(1, [("user", long), ("assistant", "a")], [("user", long), ("assistant", long)])],
                                  f"id long, chosen {TURNS}, rejected {TURNS}")
    names = ["__c", "__r", "__k", "__p", "other_0", "x.y"]
    out = preference.format_pairs(pairs.select("*", *[F.lit(n).alias(n) for n in [*names, "prompt"]]))
    assert out.columns == ["id", *names, *preference.OUTPUT]
    row = out.collect()[0]
    assert row[1:7] == tuple(names) and row.prompt == f"<|user|>\n{long}<|end|>\n"
    assert row.rejected_spans[0].length == len(long) + len("<|end|>\n")


def test_no_python_in_the_plan(spark):
    talks = spark.createDataFrame([(1, 0, "user", "q"), (2, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    plan = preference.format_pairs(preference.pairs_of(talks))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.format_pairs(preference.pairs_of(none)).count() == 0

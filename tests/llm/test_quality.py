import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulus.llm import quality
from cumulus.llm.queries import op5_quality_rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_of_odd_texts(spark):
    draw = random.Random(8)
    texts = [None, "", " \n\t ", "one", "a b c a b c", "a a a a", "x\ny\n\nx\n \nx ", "é日 #*$%&|<> \x0b\x0c\r z", "ab a b",
             " ".join(draw.choices("ab", k=3000)), " ".join(f"w{i % 900}" for i in range(30_000)), "long" * 100_000]
    texts += [" ".join(draw.choices("abcdef", k=draw.randint(0, 40))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    out = quality.statistics(docs.drop("n_words")).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_verdicts_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in op5_quality_rules(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == len(docs)
    for d in docs:
        r, c = out[d.doc_id], counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r.base_failed and r.kept)
    judged = [(labels[i], r.kept) for i, r in out.items() if i in labels and not r.base_failed]
    assert sum(q != k for q, k in judged) <= 0.01 * len(judged)


def reference(x, floors):
    """The concentration steps in numpy for one group that is its own language."""
    d = x.shape[1]
    share, near = quality.SHARE, quality.chi_square_quantile(quality.SHARE, d)
    factor = share / quality.chi_square_share(near, d + 2)

    def moments(rows):
        scatter = (rows - rows.mean(0)).T @ (rows - rows.mean(0))
        return rows.mean(0), (scatter + quality.PRIOR * scatter / len(rows)) / (len(rows) + quality.PRIOR) + np.diag(floors**2)

    middle = np.quantile(x, 0.5, axis=0, method="inverted_cdf")
    spread = np.quantile(np.abs(x - middle), 0.5, axis=0, method="inverted_cdf")
    ends = []
    for m, s in [(middle, np.diag(2.2 * spread**2 + floors**2)), moments(x)]:
        for _ in range(quality.STEPS):
            d2 = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m)
            m, s = moments(x[d2 <= np.quantile(d2, share, method="inverted_cdf")])
        ends.append((np.linalg.slogdet(s)[1], m, s))
    _, m, s = min(ends, key=lambda e: e[0])
    return m, np.linalg.inv(s) / factor


def test_estimates_match_numpy(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(400, 3)) @ np.array([[1.0, 0.4, 0.0], [0.0, 0.7, 0.2], [0.0, 0.0, 0.5]])
    x[:80] += 12
    features = {"a": ("a", 0.1), "b": ("b", 0.2), "c": ("c", 0.05)}
    rows = spark.createDataFrame([("en", "s", i % quality.SALTS, *map(float, v)) for i, v in enumerate(x)],
                                 "g_lang string, g_source string, salt int, a double, b double, c double")
    got = quality.estimates(rows, features).collect()
    assert len(got) == 1
    m, p = reference(x, np.array([0.1, 0.2, 0.05]))
    # Spark's quantiles may be off by 1 / ACCURACY in rank, that is one row here at most.
    assert np.allclose([got[0][f"m_{i}"] for i in range(3)], m, atol=0.02)
    assert np.allclose([got[0][f"p_{i}_{j}"] for i in range(3) for j in range(i + 1)],
                       [p[i, j] for i in range(3) for j in range(i + 1)], rtol=0.05, atol=0.05)
    assert np.abs(m).max() < 0.5


def test_chi_square():
    assert quality.chi_square_quantile(0.95, 5) == pytest.approx(11.07, abs=0.05)
    assert quality.chi_square_share(11.07, 5) == pytest.approx(0.95, abs=0.002)


def test_nulls_repeats_and_clashing_names(spark):
    draw = random.Random(1)
    vocabulary = [f"word{i}" for i in range(500)]
    good = [" ".join(draw.choices(vocabulary, k=80)) for _ in range(60)]
    bad = " ".join(w + "###" for w in draw.choices(vocabulary, k=80))
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", i, "k") for i, t in enumerate(good)]
    rows += [(90, bad, "en", "s", 1, "k"), (91, None, None, None, 1, "k"), (92, "", "fr", "s", 1, "k"), (None, good[1], "en", "s", 1, "k"),
             (1, good[1], "en", None, 1, "k"), (93, good[3], "xx", "only", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, g_lang string")
    out = quality.judge(docs).collect()
    assert len(out) == len(rows) and out[0].g_lang == "k"
    verdict = {r.doc_id: r.kept for r in out}
    assert [verdict[i] for i in (90, 91, 92)] == [False] * 3
    assert all(v for i, v in verdict.items() if i not in (90, 91, 92))
    assert quality.judge(docs.limit(0)).count() == 0
    assert quality.judge(docs.where(F.col("text").isNull())).first().kept is False


def test_every_statistic_alone_can_reject(spark):
    draw = random.Random(4)
    vocabulary = [f"word{i:03}" for i in range(900)]

    def lines(n):
        return [" ".join(draw.sample(vocabulary, 10)) for _ in range(n)]

    passage = " ".join(lines(4))
    texts = [("good", "\n".join(lines(draw.randint(6, 12)))) for _ in range(200)]
    texts += [("x_words", "\n".join(lines(1500))), ("x_length", "\n".join(lines(8)).replace("word", "longerlongword")),
              ("x_symbols", "\n".join(lines(8)).replace("word1", "wor#1").replace("word2", "wor#2")),
              ("x_lines", "\n".join(f"{x}\nRead more" for x in lines(20))),
              ("x_repeats", "\n".join([passage + " a", *lines(8), passage + " b c d e"]))]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in texts], "name string, text string, lang string, source string")
    out = quality.judge(docs, keep=["name"]).collect()
    assert not any(r.base_failed for r in out)
    assert {r.name for r in out if not r.kept} == {*quality.FEATURES} and sum(not r.kept for r in out) == 5

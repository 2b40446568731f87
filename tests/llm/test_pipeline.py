import re

import corpus_pipeline
from cumulus.llm import queries as Q
from tests.llm.test_chosen_path import brute
from tests.llm.test_packing import check_pieces

SF = "/root/testdata/sf0.001"


def test_stages_in_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near duplicates", "pii", "packing"]


def test_stages_by_hand(spark):
    docs = Q.table(spark, SF, "documents")
    columns = docs.columns
    labels = {r.doc_id: r for r in Q.table(spark, SF, "labels").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    everything = {r.doc_id: r for r in Q.table(spark, SF, "documents").collect()}
    toxic_gone = everything.keys() - kept["toxicity"].keys()
    assert toxic_gone and all(labels[i].toxic for i in toxic_gone if i in labels)
    # Groups of two or three documents measure little; test_quality has the larger table.
    low = [[i for i in kept[k] if i in labels and not labels[i].quality] for k in ("toxicity", "quality rules")]
    assert len(low[1]) < len(low[0])
    rows = [(i, r.text) for i, r in sorted(kept["quality rules"].items())]
    assert kept["near duplicates"].keys() == {i for i, _, c in brute(rows, 5) if i == c}
    assert kept["pii"].keys() == kept["near duplicates"].keys()
    for i, r in kept["pii"].items():
        assert r.n_chars == len(r.text)
        for v in re.findall(r"[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}", kept["near duplicates"][i].text):
            assert v not in r.text
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_pieces(pieces, {i: r.text for i, r in kept["pii"].items()})


def test_odd_documents_pass_all_stages(spark, tmp_path):
    Q.table(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    text = Q.table(spark, SF, "documents").where("doc_id = 7").first().text
    rows = [(1, text, "en", "s", len(text), "a"), (1, text, "en", "s", len(text), "a"), (2, text, None, None, None, "b"), (3, None, "en", "s", 0, "c"),
            (4, "", "en", "s", 0, "d"), (None, text + " tail", "en", "s", 1, "e"), (5, (text + " ") * 300, "en", "s", 1, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    ids = sorted((r.doc_id is None, r.doc_id) for r in docs.collect())
    assert ids == [(False, 1), (True, None)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 2
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0

from __future__ import annotations

from edge_tables import edge, no_docs, table  # noqa: F401
import corpus_pipeline as P
from spendlens.llm import secrets as S
from spendlens.llm.common import stored
from test_ngram_join import brute as components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_their_own_input(spark, table):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "source_mixing"]
    docs = table("documents")
    seen = {}
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, sf))
        seen[name] = (docs, out)
        if name != "source_mixing":
            assert out.columns == COLUMNS
        docs = out
    before, after = (x.toPandas() for x in seen["ngram_jaccard_join"])
    comp = components(list(zip(before.doc_id, before.text)))
    assert sorted(after.doc_id) == sorted({c for _, _, c in comp})
    before, after = (x.toPandas().set_index("doc_id") for x in seen["secret_scans"])
    assert list(before.index.sort_values()) == list(after.index.sort_values())
    for i, t in before.text.items():
        assert after.text[i] == S.redact(t) and not S.scan(after.text[i])[1]
    bench = [" ".join(r.text.lower().split()) for r in table("benchmark").collect()]
    _, after = (x.toPandas() for x in seen["benchmark_decontamination"])
    assert not any(b in " ".join(t.lower().split()) for t in after.text for b in bench)
    assert set(P.run(spark, sf).select("doc_id").toPandas().doc_id) == set(docs.select("doc_id").toPandas().doc_id)


def test_odd_rows(spark, edge, no_docs):
    for docs in (edge, no_docs):
        for _, stage in P.STAGES:
            docs = stored(stage(spark, docs, "/root/testdata/sf0.001"))

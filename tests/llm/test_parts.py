"""Similar documents whose elements are dealt into many parts."""

from tallyloom.llm import jaccard
from tests.llm.test_documents import brute_components


def test_many_parts_and_small_batches_lose_no_link(spark, docs, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[: 40 + i % 20] + [f"x{i // 4}"] * (i % 3))) for i in range(48)] + [(90, None), (91, "alone")]
    monkeypatch.setattr(jaccard, "ROWS", 20)
    dealt, real = [], jaccard.JaccardJoin._dealt

    def watched(frame, count):
        out = real(frame, count)
        dealt.append(out.rdd.getNumPartitions() if count else 0)
        return out

    monkeypatch.setattr(jaccard.JaccardJoin, "_dealt", staticmethod(watched))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.JaccardJoin(docs(rows), width=5, num=80, den=100).members().collect()}
    want = brute_components(rows, 5, 80, 100)
    assert all(got[i][1] == want[i][1] for i, t in rows if t)
    assert max(dealt) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024

"""The pipeline against its stages done plainly."""

import corpus_pipeline
from tallyloom.llm import pii
from tests.llm.conftest import SF
from tests.llm.test_documents import ODD, brute_components


def test_pipeline_equals_its_stages_done_plainly(spark):
    from sentencepiece import SentencePieceProcessor

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: t for i, t in rows.items() if any(map(str.isalpha, t or ""))}
    groups = brute_components(list(kept.items()), 5, 80, 100)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    kept = {i: t for i, t in kept.items() if not any(x in " ".join(t.split()) for x in items)}
    library = SentencePieceProcessor(model_file=f"{corpus_pipeline.TOKENIZERS}/piece_bpe_32k.model")
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(kept)
    assert all(got[i] == library.encode(pii.redact(t, pii.scan(t))) for i, t in kept.items())


def test_stages_keep_columns_and_take_odd_rows(spark, docs):
    for rows in (ODD, []):
        frame = docs(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.columns == docs([]).columns, name
        corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()

"""The pipeline's last stage decodes what it encodes."""

from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import bpe


def test_last_stage_decodes(spark, sf_dir):
    library = Tokenizer.from_file(bpe.word_bpe_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)

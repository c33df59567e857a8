import public_tokenizers

from gridloom.llm.tokencount import frequent_lengths


def test_every_document_counts(spark):
    """A pre-token is ranked by all documents, of which there are more than a sample held; once only some were counted, by the hash of their text."""
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('piece ', translate(cast(id as string), '0123456789', 'qrstuvwxyz')) as text")
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        got = frequent_lengths(docs, f.read())
    assert len(got) == 30_001

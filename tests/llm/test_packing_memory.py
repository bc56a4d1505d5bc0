"""Workers that pack in the pipeline hold little text at a time."""

import corpus_pipeline
from ledgerloom.llm import packing


def test_the_pipeline_packs_small_pieces_of_text(spark, monkeypatch):
    sizes = []
    real = packing._cut

    def cut(*args, **kwargs):
        run = real(*args, **kwargs)
        sizes.append(run.__closure__[[*run.__code__.co_freevars].index("text_bytes")].cell_contents)
        return run

    monkeypatch.setattr(packing, "_cut", cut)
    rows = [(i, "one two, three " * (i % 7 * 40)) for i in range(50)] + [(50, None), (50, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.packing(spark, docs, "")
    assert sizes == [1 << 20]
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    plain = packing.pack(docs, corpus_pipeline.public_tokenizers.path(corpus_pipeline.WORD_TOKENIZER), text_bytes=500)
    assert sorted(map(str, found.select(key).collect())) == sorted(map(str, plain.select(key).collect()))

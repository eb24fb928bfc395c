"""Cases of the third round's findings."""

import tracemalloc

import public_tokenizers

from trackfields.llm import byte_bpe, line_dedup

from .test_operators import words


def test_encoding_a_batch_takes_little_memory():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = [words(500, i) for i in range(600)]
    byte_bpe.encode_texts(texts[:1], path)  # loads tables
    assert sum(map(len, texts)) > 1_500_000
    tracemalloc.start()
    for part in byte_bpe._chunks(texts):
        byte_bpe.encode_texts(part, path)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000


def test_lines_of_a_word_in_some_hundred_sets_meet_in_one_step(spark, monkeypatch):
    written, saved = [], line_dedup.saved
    monkeypatch.setattr(line_dedup, "saved", lambda df, name: written.append(name) or saved(df, name))
    base = words(40, 8).split()
    texts = [" ".join([*base[:19], f"end{i}"]) for i in range(400)] + [" ".join([base[0], *words(15, i).split()]) for i in range(50)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup(d).where("n_removed = 1").collect()}
    sets = [set(t.split()) for t in texts]
    assert gone == {i for i, s in enumerate(sets) if any(len(s & o) >= 0.8 * len(s | o) for o in sets[:i])} >= set(range(1, 400))
    assert "line-hot" in written and "line-crowd" not in written

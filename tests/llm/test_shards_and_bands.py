"""Shards with hot and missing ids and very many empty texts; images summed by bands."""

import numpy as np
import pytest

from lexiloom.llm import media, token_files, tokens


def test_one_id_for_all_rows_is_more_than_one_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_ROWS", 50)
    monkeypatch.setattr(token_files, "INDEX_ROWS", 7)
    rows = [(None if i % 2 else 5, f"text number {i}" if i % 3 else "") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shards = token_files.write_token_files(df, f"file://{tmp_path}/s", tokens.tokenizer_path("word_bpe_49k.json"), "space", 2)
    found = shards.collect()
    assert len(found) > 6 and sum(r.n_docs for r in found) == 600 and max(r.n_docs for r in found) < 400
    read = sorted(token_files.read_token_files(shards).collect(), key=lambda r: r.start)
    assert [r.start for r in read] == [0, *np.cumsum([r.n_tokens for r in read])[:-1].tolist()]
    assert [r.doc_id for r in read] == [None] * 300 + [5] * 300


def test_no_documents(spark, tmp_path):
    shards = token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/s", tokens.tokenizer_path("word_bpe_49k.json"), "space", 2)
    assert shards.count() == 0 and token_files.read_token_files(shards).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (3, 2), (8, 9), (37, 64), (500, 64), (9, 700), (64, 64, 3), (5, 3, 1)])
def test_bands_give_the_whole_images_means(shape, monkeypatch):
    image = np.random.default_rng(2).integers(0, 256, shape).astype(np.uint8)
    gray = image.astype(float).mean(axis=2) if image.ndim == 3 else image.astype(float)
    h, w = gray.shape
    fine = np.repeat(np.repeat(gray, 8, 0), 9, 1)  # every pixel in parts that cells hold whole
    want = fine.reshape(8, h, 9, w).mean(axis=(1, 3))
    for most in (1, 100, 1 << 18):
        monkeypatch.setattr(media, "SUMMED", most)
        assert np.allclose(media.area_resize(image, 8, 9), want)

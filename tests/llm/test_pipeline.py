"""The pipeline against a plain version of each stage."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import quality, token_counts
from tests.llm.test_dedup import brute_components, brute_exact


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    words = ["lamp", "river", "house,", "green.", "of", "the", "stone", "walks"]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, text(40)) for i in range(150)] + [(i, text(30).upper().replace(" ", "!! ")) for i in range(150, 220)]
    rows += [(300 + i, rows[i][1].replace(" ", "\n", i)) for i in range(20)]  # exact copies but for white space
    long = text(3000)
    rows += [(400, long), (401, long + " more"), (402, long.replace("lamp", "Lamp")), (403, None), (404, "")]
    where = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(i < 150), 0) for i in range(0, 220, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows, labels


def good_rows(rows, labels):
    texts = dict(rows)
    known = sorted((i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5)
    model = quality.bradley_terry(np.array([quality.features(texts[i] or "") for i, _ in known]), np.array([q == 1 for _, q in known]))
    strength = lambda t: float(np.dot(quality.features(t or ""), model.weights))
    return [(i, t) for i, t in rows if model.slope * (strength(t) - model.threshold) >= 0]


def test_stages(spark, folder):
    where, rows, labels = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    good = good_rows(rows, labels)
    assert {i for i, _ in good} >= set(range(150)) and not {i for i, _ in good} & set(range(150, 220))
    apart = {i for i, keep, *_ in brute_exact(good) if i == keep}
    kept = [(i, t) for i, t in good if i in apart]
    single = {i for i, _, component in brute_components(kept) if i == component}
    for (_, stage), want in zip(corpus_pipeline.STAGES, ({i for i, _ in good}, apart, single)):
        docs = stage(spark, docs, where)
        assert docs.columns == columns
        assert sorted(r["doc_id"] for r in docs.collect()) == sorted(want)
    packed = corpus_pipeline.run(spark, where).collect()
    library = token_counts.load_tokenizer("byte_bpe_50k.json")
    texts = dict(rows)
    lengths = {i: len(library.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in single}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == lengths
    used = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(lengths.values()) // 2048) + 1

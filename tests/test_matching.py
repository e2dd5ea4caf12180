"""Index against the full product, matches and lessons, vocabularies that grow with a stream, states of jobs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import learning, matching
from quire.streaming import learning as streamed


def vectors(n, seed, dims=8, kinds=5):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(kinds)]
    return [[x + rng.gauss(0, 0.4) for x in middles[i % kinds]] for i in range(n)]


def test_index_equals_the_full_product(spark):
    variants = spark.createDataFrame([(f"c{i % 40:02d}", v) for i, v in enumerate(vectors(400, 1))] + [("null", None)], "canon string, vector array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(vectors(150, 2) + vectors(30, 3) + [[0.0] * 8])] + [(999, None)], "id long, vector array<double>")
    full = {tuple(r["vector"]): (r["canon"], r["similarity"]) for r in learning.best_similar(queries, variants, -2.0).where("vector is not null").collect()}
    index = matching.CellIndex(variants)
    got = {tuple(r["vector"]): (r["canon"], r["similarity"]) for r in index.best(queries).collect()}
    assert got == full
    # without the exact second look, most of the 20 cells have to be searched for most of the answers
    near = {tuple(r["vector"]): (r["canon"], r["similarity"]) for r in index.best(queries, probes=12, exact=False).collect()}
    assert sum(near[v] == full[v] for v in full) / len(full) >= 0.9


def test_index_passes_over_far_cells(spark):
    variants = spark.createDataFrame([(f"c{i}", v) for i, v in enumerate(vectors(900, 4, 16, 30))], "canon string, vector array<double>")
    index = matching.CellIndex(variants)
    asked = spark.createDataFrame([(v,) for v in vectors(60, 4, 16, 30)], "vector array<double>")
    found = index.best(asked)
    met = index._cells(asked.distinct(), True, 2).count() + index._cells(found.select("vector", "similarity"), False, 2).count()
    assert met < 0.8 * 60 * len(index.centres)


def test_index_of_no_variants(spark):
    none = spark.createDataFrame([], "canon string, vector array<double>")
    assert matching.CellIndex(none).best(spark.createDataFrame([([1.0],)], "vector array<double>")).count() == 0


VOCAB = [("Experience", "work experience"), ("Experience", "employment history"), ("Skills", "skills"), ("Skills", "technical skills"), ("Education", "education")]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(VOCAB, "canon string, variant string")


def test_exact_before_similar(spark, vocab):
    rows = [("  SKILLS ",), ("skill set",), ("zzzz",), (None,), ("",), ("Work  Experiences",), ("skills",)]
    got = {r["heading"]: r for r in matching.match_sections(spark.createDataFrame(rows, "heading string"), vocab).collect()}
    assert (got["  SKILLS "]["canon"], got["  SKILLS "]["confidence"], got["  SKILLS "]["match"]) == ("Skills", 1.0, "exact")
    assert (got["Work  Experiences"]["canon"], got["Work  Experiences"]["match"]) == ("Experience", "similar") and got["Work  Experiences"]["confidence"] > 0.9
    assert got["zzzz"]["canon"] is None and got["zzzz"]["confidence"] < 0.75
    assert got[None]["canon"] is None and got[""]["confidence"] == 0.0
    assert len(got) == 7
    again = {r["heading"]: r for r in matching.match_sections(spark.createDataFrame(rows, "heading string"), vocab, once=True).collect()}
    assert again == got


def test_covered_proposals_and_lessons(spark, vocab):
    stats = spark.createDataFrame([("technical skillss", 4), ("qqq zzz", 5)], "heading string, freq long")
    got = {r["heading"]: (r["verdict"], r["similar_to"]) for r in matching.new_sections(stats, vocab).collect()}
    assert got == {"technical skillss": ("covered", "Skills"), "qqq zzz": ("new", None)}
    lines = [("Unknown Sections", "my key skills"), ("Unknown Sections", "skills"), ("Unknown Sections", "I worked there, and skills."), ("Unknown Sections", "skillss"), ("Educations", None), ("Education", None), ("Unknown Sections", None)]
    taught = {tuple(r) for r in matching.lessons(spark.createDataFrame(lines, "section string, text string"), vocab).collect()}
    sure = {r["heading"]: r["confidence"] for r in matching.match_sections(spark.createDataFrame([("my key skills",), ("skillss",), ("Educations",)], "heading string"), vocab).collect()}
    assert 0.65 <= sure["my key skills"] < 0.85 <= min(sure["skillss"], sure["Educations"])
    assert taught == {("Skills", "my key skills"), ("Education", "educations")}


def test_batch_two_matches_what_batch_one_taught(spark, vocab, tmp_path):
    store, source, out = f"{tmp_path}/store", f"{tmp_path}/in", f"{tmp_path}/out"
    streamed.start_store(vocab, store)
    schema = "doc_id long, section string, text string"
    stream = spark.readStream.schema(schema).parquet(f"{source}/*")

    def work(batch, known):
        return batch.join(known.withColumnRenamed("variant", "v"), F.lower("text") == F.col("v"), "left").select("doc_id", "text", "canon")

    def run():
        streamed.learn_batches(stream, store, out, f"{tmp_path}/checkpoint", work, matching.lessons).awaitTermination()

    spark.createDataFrame([(1, "Unknown Sections", "my key skills")], schema).write.parquet(f"{source}/a")
    run()
    spark.createDataFrame([(2, "Unknown Sections", "My Key Skills"), (3, "Unknown Sections", "skills")], schema).write.parquet(f"{source}/b")
    run()
    got = {(r["doc_id"], r["canon"], r["batch"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, None, 0), (2, "Skills", 1), (3, "Skills", 1)}
    assert {tuple(r) for r in streamed.as_of(spark, store, 9).where("version > 0").collect()} == {("Skills", "my key skills", 1)}
    # a version written again holds the same rows, and later ones are not seen
    streamed.append_version(spark.createDataFrame([("Skills", "my key skills"), ("Skills", "skills")], "canon string, variant string"), store, 1)
    assert streamed.as_of(spark, store, 1).count() == len(VOCAB) + 1 and streamed.as_of(spark, store, 0).count() == len(VOCAB)
    asked = spark.createDataFrame([("My Key Skills", 0), ("my key skills", 1), ("education", 0)], "heading string, version int")
    assert {tuple(r) for r in streamed.match_as_of(asked, store).collect()} == {("My Key Skills", 0, None), ("my key skills", 1, "Skills"), ("education", 0, "Education")}


def test_states_of_jobs(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "job_id string, status string, ts timestamp"
    source = f"{tmp_path}/events"
    seen = {}

    def keep(batch, number):
        seen[number] = {r["job_id"]: (r["status"], r["n_events"], r["n_failed"], r["updated"]) for r in batch.collect()}

    def run():
        streamed.job_status(spark.readStream.schema(schema).parquet(f"{source}/*")).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([("a", "queued", at(1)), ("a", "running", at(2)), ("b", "failed", at(1)), (None, "x", at(1)), ("c", "x", None)], schema).write.parquet(f"{source}/1")
    run()
    spark.createDataFrame([("a", "failed", at(1)), ("a", "done", at(9)), ("b", "running", at(0))], schema).write.parquet(f"{source}/2")
    run()
    first, second = [seen[n] for n in sorted(seen) if seen[n]]
    assert first == {"a": ("running", 2, 0, at(2)), "b": ("failed", 1, 1, at(1))}
    assert second == {"a": ("done", 4, 1, at(9)), "b": ("failed", 2, 1, at(1))}

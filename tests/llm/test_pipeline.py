import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from sepet.llm.near_sets import shingle_set
from sepet.llm.simhash import fingerprint

import __spark_entry__ as entry

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture
def folder(spark, docs_of, tmp_path):
    """A small corpus with a kind of bad documents, boilerplate, near copies, odd rows and labels."""
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    rows = []
    for k in range(120):
        text = f"Site menu {k % 2}\n{prose(90)}\n{prose(20)}"
        if k % 4 == 0:
            text = " ".join(f"{w}###" for w in prose(80).split())
        rows.append((k, text, f"s{k % 2}"))
    rows += [(200 + k, rows[1][1], "s1") for k in range(3)] + [(1, rows[1][1], "s1"), (300, None, "s0"), (301, "", None), (None, f"Site menu 0\n{prose(90)}\n{prose(20)}", "s0")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(k, int(k % 4 != 0), 0) for k in range(120)] + [(None, 1, 0), (5, None, None), (7, 1, 0)]
    spark.createDataFrame(marks, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    out = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out[name] = docs
        assert name == "pieces" or docs.columns == columns
    kept = {r["doc_id"] for r in out["quality_rules"].collect()}
    want = {None, *(k for k in range(120) if k % 4), *range(200, 203)}
    assert kept == want, kept ^ want
    texts = {r["doc_id"]: r for r in out["line_dedup"].collect()}
    assert all("Site menu" not in r["text"] and r["n_chars"] == len(r["text"]) for r in texts.values())
    one = sorted(r["doc_id"] for r in out["simhash_dedup"].filter("doc_id is not null").collect())
    assert one == [k for k in range(120) if k % 4] and out["simhash_dedup"].filter("doc_id is null").count() == 1
    sizes = {r["doc_id"]: len(r["text"].split()) for r in out["simhash_dedup"].collect()}
    mixed = out["mixing"].collect()
    assert abs(sum(len(r["text"].split()) for r in mixed) - 1.5 * sum(sizes.values())) <= 2
    whole = {r["doc_id"]: r["text"] for r in out["simhash_dedup"].collect()}
    assert all(whole[r["doc_id"]].startswith(r["text"]) for r in mixed)
    assert out["pieces"].count() == len(mixed) and out["pieces"].filter("not restored").count() == 0


def test_run_and_registration(spark, folder):
    found = pipeline.run(spark, folder)
    assert found.count() > 0 and "ids" in found.columns
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "mixing", "pieces"]


def test_empty_tables(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40).withColumns({c: F.lit("x") for c in ("n_words", "kept", "size", "target", "taken", "ident")})
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs, folder).agg(F.count_if(F.col("n_words") != "x"), F.count_if(F.col("taken") != "x")).first()[:] == (0, 0), name


def test_names_of_a_stage_do_not_clash(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    names = ("_kept", "_Lines", "_dropped", "_digest", "_doc", "_id", "_size", "_epoch", "row", "node", "component")
    docs = docs.withColumns({c: F.lit("x") for c in names})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.filter(" or ".join(f"`{c}` is distinct from 'x'" for c in names)).isEmpty(), name


def test_different_texts_of_one_id_stay(spark, docs_of, folder):
    rng = random.Random(7)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    one, two, three = prose(), prose(), prose()
    docs = docs_of([(5, one, "s"), (5, two, "s"), (5, two, "s"), (6, three, "s"), (9, three + " end", "s")])
    out = pipeline.simhash_dedup(spark, docs, folder).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted([(5, one), (5, two), (6, three)])


def test_near_copies_by_fingerprint_and_by_sets(spark, docs_of, folder):
    """Texts that repeat one passage very often share a fingerprint though their sets differ; others share most of their sets
    though their fingerprints differ."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    chorus, verse = words(9), words(100)
    sung = [" ".join(chorus * 200 + words(20)) for _ in range(2)]
    told = [" ".join(verse), " ".join([*verse[:50], "other", *verse[51:96], "word", *verse[97:]])]
    near = [shingle_set(t.encode()) for t in (*sung, *told)]
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    apart = lambda a, b: ((fingerprint(a.encode(), 5) ^ fingerprint(b.encode(), 5)) & (2**64 - 1)).bit_count()
    assert jaccard(*near[:2]) < 0.5 and apart(*sung) <= 3 and jaccard(*near[2:]) >= 0.8 and apart(*told) > 3
    rows = [(k, t, "s") for k, t in enumerate([*sung, *told, " ".join(words(100))])]
    out = pipeline.simhash_dedup(spark, docs_of(rows), folder).collect()
    assert sorted(r["doc_id"] for r in out) == [0, 2, 4]


@pytest.mark.parametrize("before, want", [("10000", 1_000), ("0", 1_000), ("300", 300)])
def test_python_gets_few_whole_texts_at_once(spark, docs_of, folder, before, want):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    sizes = lambda batches: (b.from_arrays([[b.num_rows]], ["n"]) for b in batches)
    docs = docs_of([]).unionByName(spark.range(3_000).selectExpr("id AS doc_id", "'a b' AS text", "'en' AS lang", "'s' AS source", "3L AS n_chars"))
    try:
        for stage in (pipeline.simhash_dedup, pipeline.pieces):
            spark.conf.set(key, before)
            stage(spark, docs if stage is pipeline.pieces else docs.limit(3), folder)
            got = [r["n"] for r in docs.coalesce(1).mapInArrow(sizes, "n bigint").collect()]
            assert max(got) == want and sum(got) == 3_000
    finally:
        spark.conf.set(key, kept)

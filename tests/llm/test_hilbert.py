import itertools
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sepet.llm.hilbert import curve_index, curve_shards, curve_states, write_shards


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_the_grid(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"c{k} int" for k in range(dims)))
    found = {r["at"]: tuple(r[:dims]) for r in df.withColumn("at", curve_index([F.col(f"c{k}") for k in range(dims)], bits)).collect()}
    assert sorted(found) == list(range(len(cells)))
    steps = [sum(abs(a - b) for a, b in zip(found[k], found[k + 1])) for k in range(len(cells) - 1)]
    assert set(steps) == {1}


def walk(levels, bits):
    digits, after = curve_states(len(levels))
    index = state = 0
    for bit in reversed(range(bits)):
        at = state << len(levels) | sum((level >> bit & 1) << k for k, level in enumerate(levels))
        index, state = index << len(levels) | digits[at], after[at]
    return index


def plain(rows, shards, bits, law):
    """(doc_id, size, crc) -> set of (shard, slot), by sorting it all."""
    total = len(rows)
    below = lambda x, k: sum(1 for r in rows if (r[k] is not None and x is not None and r[k] < x) or (r[k] is None and x is not None))
    keyed = sorted(
        (walk([below(r[k], k) * (1 << bits) // total for k in (0, 1, 2)], bits), r[3], r[4] is not None, r[4] or 0, r[2]) for r in rows
    )
    bytes_, before, first, out = sum(k[4] for k in keyed), 0, {}, []
    for place, key in enumerate(keyed):
        shard = place * shards // total if law == "rows" else before * shards // bytes_
        before += key[4]
        out.append((key[3] if key[2] else None, key[4], key[1], key[0], shard, place - first.setdefault(shard, place)))
    return sorted(out, key=repr)


def light(df):
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select("*", (F.octet_length(text) + 1).alias("bytes"), F.crc32(text).alias("crc"))


def run(df, **options):
    return curve_shards(light(df), ["source", "lang", "bytes"], F.col("bytes"), ["crc", "doc_id"], **options)


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_against_sorting_it_all(spark, docs_of, odd_texts, law):
    rng = random.Random(3)
    texts = odd_texts + ["w " * rng.randrange(40) for _ in range(150)]
    rows = [(None if k % 29 == 0 else k // 2, t, None if k % 7 == 0 else f"s{k % 5}") for k, t in enumerate(texts)]
    rows += rows[20:60]  # repeated rows
    df = docs_of(rows, clash=True).withColumn("place", F.lit(1)).withColumn("Shard", F.lit(2)).withColumn("row", F.lit(3))
    got = run(df, shards=4, bits=3, law=law, task_rows=10).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = plain([(s, "en", size(t), zlib.crc32((t or "").encode()), i) for i, t, s in rows], 4, 3, law)
    assert sorted(((r["row"]["doc_id"], r["row"]["bytes"], r["row"]["crc"], r["curve"], r["shard"], r["slot"]) for r in got), key=repr) == want
    assert all(r["row"]["Shard"] == 2 and r["row"]["target"] == "x" for r in got)
    counts = [sum(r["shard"] == s for r in got) for s in range(4)]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))


def test_equal_bytes_when_all_rows_share_a_cell(spark):
    df = spark.range(4_000).select(F.lit(1).alias("doc_id"), F.lit("x" * 9).alias("text"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"))
    counts = [r["count"] for r in run(df, task_rows=100).groupBy("shard").count().collect()]
    assert counts == [250] * 16


def test_empty_table_and_few_rows(docs_of):
    assert run(docs_of([])).collect() == []
    assert [(r["shard"], r["slot"]) for r in run(docs_of(["a", "bb"])).collect()] == [(0, 0), (6, 0)]


def test_written_shards_are_narrow_in_every_dimension(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, f"s{rng.randrange(64):02d}", rng.randrange(10_000), "t" * rng.randrange(50)) for k in range(8_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, day int, text string").withColumn("shard", F.lit("own"))
    path = str(tmp_path / "shards")
    write_shards(df, path, ["source", "day"], F.octet_length("text"), tie=["doc_id"])
    back = spark.read.parquet(path)
    assert back.select(df.columns).exceptAll(df).isEmpty() and back.count() == 8_000
    touched = {"source": 0, "day": 0}
    files = list(tmp_path.glob("shards/_shard=*/*.parquet"))
    assert len(files) == 16
    for file in files:
        meta = pq.ParquetFile(file).metadata.row_group(0)
        least = {meta.column(c).path_in_schema: meta.column(c).statistics for c in range(meta.num_columns)}
        touched["source"] += least["source"].min <= "s10" <= least["source"].max
        touched["day"] += least["day"].min <= 1_234 <= least["day"].max
    # A reader of one source, or of one day, opens about a quarter of the files.
    assert max(touched.values()) <= 6

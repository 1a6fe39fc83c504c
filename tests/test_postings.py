"""The token index of stored masters gives what reading all of them gives."""

import random

from plain_rules import score
from pyspark.sql import functions as F
from test_match import as_listings, as_masters, items
from test_store import DAY1, DAY2, feeds, tables  # noqa: F401

from sepet.operators import match, postings
from sepet.plans.ingest import ingest_into
from sepet.plans.store import TableStore


def test_index_built_in_parts_equals_the_loop(spark):
    rng = random.Random(8)
    rows, stored = items(rng, 120, 3, 6, 0.05), items(rng, 90, 4, 6, 0.03)
    masters = as_masters(spark, stored)
    index = dict.fromkeys(postings.TABLES)
    for part in range(3):
        own = masters.filter(F.pmod(F.xxhash64("master_key"), F.lit(3)) == part)
        index = postings.merge_index(index, postings.index_masters(own))
    found = postings.best_match_indexed(as_listings(spark, rows), index)
    got = {r["own_key"]: (r["master_key"], r["score"]) for r in found.collect()}
    for b, i, t in rows:
        best = (None, 0.0)
        for c, j, m in stored:
            s = score(m, t, True)
            if b == c and s > best[1]:
                best = (f"m{j}", s)
        assert got[f"k{i}"] == (best if best[1] >= 0.7 else (None, None))


def test_runs_keep_the_index_and_probes_read_no_titles(spark, tmp_path, tables):  # noqa: F811
    store = TableStore(spark, str(tmp_path), buckets=4)
    ingest_into(store, 1, feeds(spark, "2024-01-01", DAY1[:20]), *tables)
    ingest_into(store, 2, feeds(spark, "2024-01-02", [*DAY2, (90, "Doğa Bitki Çayı 20 Gr", "marka5", "Çay"), (91, "Kahve", "x", None)]), *tables)
    masters = match.prepare_masters(store.read("masters"))
    assert masters.count() == 22
    fresh = postings.index_masters(masters)
    kept = {name: store.read(name) for name in postings.TABLES}
    for name in postings.TABLES:
        assert sorted(map(str, kept[name].select(sorted(kept[name].columns)).collect())) == sorted(map(str, fresh[name].select(sorted(kept[name].columns)).collect())), name
    listings = as_listings(spark, [("marka7", 1, ["urun7"]), ("none", 2, ["a"])])
    found = postings.best_match_indexed(listings, kept)
    read = set(found.inputFiles())
    plan = found._jdf.queryExecution().toString()
    assert "canonical_title" not in plan and f"{tmp_path}/masters" not in plan
    assert all("/masters/" not in file for file in read)

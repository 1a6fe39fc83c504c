import collections
import random
import re

from pyspark.sql import functions as F

from sepet.llm.decision_list import STATISTICS, apply_rules, learn_rules, text_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        sum("A" <= c <= "Z" for c in text), len(set(w)), len(lines),
    )


def test_statistics(docs_of, odd_texts):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c # A|B é\n".split(" ")) for _ in range(rng.randrange(30))) for _ in range(150)]
    texts += odd_texts
    rows = text_statistics(docs_of(texts, clash=True), "text").select("doc_id", *STATISTICS).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == {k: brute(t) for k, t in enumerate(texts)}


def labelled(spark, rows):
    names = [*STATISTICS, "bad", "k"]
    return spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))


def test_learns_thresholds_and_keeps_the_rest(spark):
    rng = random.Random(3)
    rows = []
    for k in range(900):
        bad = k % 3 == 0
        symbols = rng.randrange(40, 90) if bad and k % 2 else 0
        repeats = rng.randrange(60, 90) if bad and not k % 2 else rng.randrange(0, 10)
        rows.append((100, 500, symbols, 0, repeats, 3, 70, 5, int(bad), k))
    df = labelled(spark, rows)
    rules = learn_rules(df, "bad", F.xxhash64("k"))
    assert 1 <= len(rules) <= 4
    out = apply_rules(df, rules).withColumn("wrong", F.when((F.col("rule") > 0) != (F.col("bad") == 1), 1).otherwise(0))
    assert out.agg(F.sum("wrong")).first()[0] <= 9


def test_one_class_null_labels_and_no_rows(spark):
    row = (60, 300, 0, 0, 0, 0, 50, 3)
    assert learn_rules(labelled(spark, [(*row, 0, k) for k in range(30)]), "bad", F.xxhash64("k")) == []
    assert learn_rules(labelled(spark, [(*row, None, k) for k in range(30)]), "bad", F.xxhash64("k")) == []
    assert learn_rules(labelled(spark, []), "bad", F.xxhash64("k")) == []


def test_base_rule(docs_of):
    good = " ".join(f"w{k}" for k in range(50))
    texts = [good, good[:-4], "a b c " * 40, None]
    out = apply_rules(text_statistics(docs_of(texts), "text"), []).orderBy("doc_id").collect()
    assert [(r["base_failed"], r["kept"]) for r in out] == [(False, True), (True, False), (True, False), (True, False)]


def test_names_do_not_clash(docs_of):
    df = docs_of(["a b", None, "A b\nc"])
    for name in ("N_Words", "_dl_words", "_DL_TEXT", "_dl_lines", "Kept"):
        df = df.withColumn(name, F.lit("x"))
    out = apply_rules(text_statistics(df, "text"), [])
    assert {r["doc_id"]: (r["n_words"], r["n_lines"], r["kept"], r["_dl_words"], r["_DL_TEXT"]) for r in out.collect()} == {
        0: (2, 1, False, "x", "x"), 1: (0, 0, False, "x", "x"), 2: (3, 2, False, "x", "x"),
    }

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sepet.functions import display, keys, similarity, size, text


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


SIZES = [
    ("12 x 500 Ml", "500", "ML", 12),
    ("6X200 CC", "200", "ML", 6),
    ("2 Gr 25'li", "2", "G", 25),
    ("48'li", "48", "ADET", 1),
    ("Su 1,5 Lt", "1500", "ML", 1),
    ("1.000 ml", "1", "ML", 1),
    ("12. gr", "12", "G", 1),
    ("Peynir 1 KG", "1000", "G", 1),
    ("Yumurta 30 Adet", "30", "ADET", 1),
    ("Yumurta 30'LÜ", "30", "ADET", 1),
    ("500 gr 2 kg", "500", "G", 1),
    ("5 gül", None, None, 1),
    ("Su", None, None, 1),
    (None, None, None, 1),
]


def test_extract_size(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(SIZES)], "i int, x string")
    rows = df.select("i", size.extract_size(F.col("x")).alias("y")).collect()
    for i, got in rows:
        title, value, unit, pack = SIZES[i]
        want = (None if value is None else Decimal(value), unit, pack)
        assert (got["size_value"], got["size_unit"], got["pack_quantity"]) == want, title
        assert got["size_ok"], title


def test_count_beyond_int_is_flagged(spark):
    assert not one(spark, "2 gr 99999999999'li", size.extract_size)["size_ok"]


def test_normalize_is_idempotent(spark):
    raws = ["ÇAY Şişe ĞÜÖIı", "İçecek", "  ", "", None, "Zeytinyağı 5 Lt", " \t"]
    once = text.normalize_text(F.col("x"))
    df = spark.createDataFrame([(r,) for r in raws], "x string").select("x", once.alias("y"), text.normalize_text(once).alias("z"))
    got = {r["x"]: r["y"] for r in df.collect() if r["y"] == r["z"]}
    assert len(got) == len(raws)
    assert got["İçecek"] == "icecek" and got[" \t"] == "" and got[None] == ""


def test_tokenize(spark):
    assert one(spark, "Çay, çay! 12 a 3x 😀kek-un", text.tokenize) == ["cay", "3x", "kek", "un"]
    got = one(spark, "Erikli Su Pet Şişe 5 L", lambda c: text.tokenize_title(c, F.lit("Erikli")))
    assert got == []
    got = one(spark, "KALEM Makarna 500 gr Kalemlik", lambda c: text.tokenize_title(c, F.lit("Dr. Oetker")))
    assert got == ["penne", "rigate", "makarna", "kalemlik"]


def test_slug(spark):
    assert one(spark, "Doğa Su - 5 Lt!", text.slug) == "doga-su-5-lt"


PAIRS = [
    ("cay", "cayi", True),
    ("spaghetti", "spagetti", True),
    ("su", "sut", True),
    ("su", "sulama", False),
    ("kalem", "kelam", False),
    ("makarna", "makarma", True),
    ("abcdefg", "abcdefgh", True),
    ("abcd", "abce", False),
]


def test_tokens_agree(spark):
    df = spark.createDataFrame([(a, b, e) for a, b, e in PAIRS] + [(b, a, e) for a, b, e in PAIRS], "a string, b string, e boolean")
    got = df.select("a", "b", "e", similarity.tokens_agree(F.col("a"), F.col("b")).alias("y")).collect()
    assert [tuple(r) for r in got if r["e"] != r["y"]] == []


def test_score(spark):
    def score(first, second, flag):
        df = spark.createDataFrame([(first, second)], "a array<string>, b array<string>")
        return df.select(similarity.token_set_score(F.col("a"), F.col("b"), flag).alias("y")).first()["y"]

    assert score([], [], True) == score([], [], False) == 1.0
    assert score([], ["a1"], True) == 1.0 and score(["a1"], [], False) == 0.0
    assert score(["spaghetti", "su", "cayi"], ["spagetti", "cay", "limon"], True) == 0.5
    assert score(["cay", "cayi"], ["cayi", "cay"], True) == 1.0
    # Greedy: here "su" takes "sutlu" first and leaves nothing for "sutlub".
    assert score(["su", "sutlub"], ["sutlu", "su"], True) == pytest.approx(1 / 3)
    assert score(["sutlub", "su"], ["sutlu", "su"], True) == 1.0


def test_unit_price(spark):
    df = spark.createDataFrame(
        [(Decimal(90), Decimal(500), "ML", 12), (Decimal(96), Decimal(48), "ADET", 1), (Decimal(9), None, None, 1), (Decimal(9), Decimal(0), "G", 1)],
        "p decimal(18,2), s decimal(18,4), u string, n int",
    )
    got = [r[0] for r in df.select(size.unit_price(*map(F.col, "psun"))).collect()]
    assert got[0] == 15 and got[1] == 2 and got[2] is None and got[3] is None
    assert [r[0] for r in df.select(size.unit_label(F.col("u"))).collect()] == ["L", "adet", "adet", "kg"]


def test_display(spark):
    df = spark.createDataFrame([(Decimal("1234.5"), 0.525)], "p decimal(18,2), s double")
    got = df.select(display.price_display(F.col("p")), display.percent_display(F.col("s"))).first()
    assert tuple(got) == ("₺1.234,50", "53%")


def test_stable_key(spark):
    import hashlib
    import struct

    for raw in ["1A2B", "", "çay", "x" * 50]:
        expected = struct.unpack("<q", hashlib.md5(raw.encode()).digest()[:8])[0]
        assert one(spark, raw, keys.stable_key_md5) == expected

import pytest
from pyspark.sql import functions as F

from sepet.llm.line_dedup import drop_boilerplate_lines, html_lines, url_host


def kept(df, **options):
    rows = drop_boilerplate_lines(df, "source", "text", **options).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()
    return {r[0]: tuple(r)[1:] for r in rows}


def brute(rows, ratio, least):
    by_host, pages = {}, {}
    for _, text, host in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")} - {""}:
            by_host[host, line] = by_host.get((host, line), 0) + 1
    out = {}
    for i, text, host in rows:
        if text is None:
            out[i] = (None, 0, 0)
            continue
        lines = text.split("\n")
        bad = [
            (n := by_host.get((host, x.strip(" \t\n\x0b\x0c\r")), 0)) >= least and n > ratio * pages[host] for x in lines
        ]
        out[i] = ("\n".join(x for x, b in zip(lines, bad) if not b), sum(x.strip() != "" for x in lines), sum(bad))
    return out


def test_against_brute_force(docs_of):
    rows = [(k, f"Menu\n own {k}\n\n{'half' if k % 2 else 'other'}\nMenu ", "a" if k < 20 else None) for k in range(30)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "Menu", "b"), (103, "\n\n", "b")]
    for ratio, least in ((0.1, 3), (0.45, 3), (0.5, 1), (0.9, 5)):
        assert kept(docs_of(rows), ratio=ratio, least_pages=least) == brute(rows, ratio, least)


def test_repeated_rows_count_as_pages(docs_of):
    rows = [(1, "once", "a")] * 4 + [(2, "own", "a")]
    out = kept(docs_of(rows), ratio=0.5, least_pages=3)
    assert out == {1: ("", 1, 1), 2: ("own", 1, 0)}


def test_odd_texts_and_clashing_columns(docs_of, odd_texts):
    rows = [(k, t, "s") for k, t in enumerate(odd_texts)]
    df = docs_of(rows, clash=True)
    out = drop_boilerplate_lines(df, "source", "text")
    assert set(df.columns) < set(out.columns) and out.count() == len(rows)
    assert kept(docs_of(rows)) == brute(rows, 0.1, 3)


def test_empty(docs_of):
    assert kept(docs_of([])) == {}


@pytest.mark.parametrize(
    ("url", "host"),
    [("https://A.example.org/x?y", "a.example.org"), ("http://u:p@b.c:80/", "b.c"), ("nothing", ""), (None, None)],
)
def test_host(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(url_host(F.col("u"))).first()[0] == host


def test_html_lines(spark):
    page = "<head><title>t</title></head><body><script>if (a<b) x</script><p class=a>one <b>two</b></p><pre>x</pre><!-- c --><li>three"
    text = spark.createDataFrame([(page,), (None,)], "h string").select(html_lines(F.col("h"))).collect()
    assert [x for x in text[0][0].split("\n") if x.strip()] == ["one two", "x", "three"] and text[1][0] is None


def test_names_do_not_clash(docs_of):
    rows = [(k, f"Menu\nown {k}", "a") for k in range(30)]
    df = docs_of(rows)
    for name in ("_bl_lines", "_BL_HOST", "_bl_left", "Kept_Text", "h", "d", "n", "pages", "th"):
        df = df.withColumn(name, F.lit("x"))
    out = drop_boilerplate_lines(df, "source", "text")
    assert kept(df) == brute(rows, 0.1, 3)
    # The new column stands in the place of the one of its name.
    assert [c for c in out.columns if c.lower() == "kept_text"] == ["kept_text"]
    assert out.filter("_bl_lines <> 'x' or _BL_HOST <> 'x' or _bl_left <> 'x' or h <> 'x'").isEmpty()

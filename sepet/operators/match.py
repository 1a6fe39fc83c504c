"""Entity matching: blocking, best match, and assignment of listings to masters.

Listings are handled in order inside blocks of equal brand, size, unit and pack. Each joins the best
master so far that scores at least the threshold, or founds a new one. Blocks never interact.

What is compared are *shapes*, the distinct token sets of a block. Appearances fold into distinct
titles before a title is parsed, and titles fold into shapes before anything is compared. The outcome
for a shape is a short list of *records*: the masters that were, at their founding, better for it
than every older one. A listing takes the last record founded no later than itself.

Blocks with few shapes are folded in one task each (``fold``). Larger ones, whatever their size, go through
joins over agreeing tokens, so that no block is ever gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MATCH_THRESHOLD
from ..functions.similarity import sizes_can_reach, token_set_score, tokens_agree
from ..functions.size import extract_size
from ..functions.text import brand_key, default_brand, tokenize_title
from ..session import bound_splits, settle, settle_partitions
from .category import distinct_texts, false_positive_filter, guess_texts, open_texts, resolve_category, resolve_texts
from .fold import fold_rows
from .fuzzy import fuzzy_token_join
from .maintain import PRODUCT_KEY, fill_category_once
from .skew import TASK_ROWS, broadcast_if_small, salted_join

# Bytes of a table that a task reads: of 30 or so a listing, which take eight times that where they are sorted.
SPLIT_BYTES = 32 << 20
# Bytes of the shapes of a block that is folded in one task.
FOLD_BYTES = 128_000
# A key of agreeing tokens is widened until it finds about this many leaders, to so many tokens at most.
FEW, MOST_WIDTH = 16, 3
# Edges between shapes that a task goes through, in the first round and at most.
TASK_EDGES, MOST_EDGES = 100_000, 2_000_000
COVERED, FOUNDER, UNKNOWN = 0, 1, -1
FIRST_BATCH = 256
BATCH_GROWTH = 8
# Shapes of one block scored against an array of masters in one task.
BLOCK_SHAPES = 20_000

TITLE = ["title", "brand"]
SHAPE = ["block", "sig"]
SIZE = ["size_value", "size_unit", "pack_quantity"]
# Columns of listings that are matched; the search term besides tells their category.
MATCHED = [*PRODUCT_KEY, "run_ts", "seq", "title", "brand", "source_category"]


def block_key(brand: Column, size_value: Column, size_unit: Column, pack_quantity: Column) -> Column:
    """One text for (pack, size, unit, brand) with nulls equal; brand case and end spaces do not count."""
    return F.concat_ws(
        "|",
        pack_quantity.cast("string"),
        F.coalesce(size_value.cast("decimal(18,4)").cast("string"), F.lit("")),
        F.coalesce(size_unit, F.lit("")),
        brand_key(brand),
    )


def order_key(is_new: int, run_ts: Column, seq: Column) -> Column:
    """Stored masters come before all listings of a run."""
    return F.struct(
        F.lit(is_new).alias("is_new"),
        run_ts.cast("timestamp").alias("run_ts"),
        seq["term_pos"].cast("int").alias("term_pos"),
        seq["source_pos"].cast("int").alias("source_pos"),
        seq["pos"].cast("bigint").alias("pos"),
    )


def founder_key() -> Column:
    """Master key out of the founding appearance; no global counter is needed."""
    return F.concat_ws(
        ":",
        "source",
        F.col("external_id").cast("string"),
        F.date_format("run_ts", "yyyyMMddHHmmssSSSSSS"),
        F.col("seq.term_pos").cast("string"),
        F.col("seq.source_pos").cast("string"),
        F.col("seq.pos").cast("string"),
    )


def _tokens(sig: Column) -> Column:
    return F.when(sig == "", F.array().cast("array<string>")).otherwise(F.split(sig, " "))


def _sig(title: Column, brand: Column) -> Column:
    return F.array_join(tokenize_title(title, brand), " ")


def prepare_listings(listings: DataFrame) -> DataFrame:
    """Default brand, order and founder key for each appearance."""
    return (
        listings.withColumn("title", F.coalesce("title", F.lit("")))
        .withColumn("brand", default_brand(F.col("brand")))
        .withColumn("ord", order_key(1, F.col("run_ts"), F.col("seq")))
        .withColumn("own_key", founder_key())
    )


def parse_titles(listings: DataFrame) -> DataFrame:
    """Distinct (title, brand) of prepared listings: first appearance, count, size, block, token set.

    Map-side combine leaves one row per title and task, so a title is parsed once however often it
    is listed.
    """
    titles = settle(
        listings.groupBy(*TITLE).agg(
            F.min(F.struct("ord", F.col("own_key").alias("key"))).alias("first"), F.count(F.lit(1)).alias("n")
        )
    )
    return (
        titles.withColumn("_size", extract_size(F.col("title")))
        .select(*TITLE, "first", "n", "_size.*")
        .withColumn("block", block_key(*map(F.col, ("brand", *SIZE))))
        .withColumn("sig", _sig(F.col("title"), F.col("brand")))
    )


def with_shape(masters: DataFrame) -> DataFrame:
    """Masters with their block and token set: as they are stored, or made from brand, size and title."""
    if set(SHAPE) <= set(masters.columns):
        return masters
    return masters.withColumns(
        {"block": block_key(*map(F.col, ("brand", *SIZE))), "sig": _sig(F.col("canonical_title"), F.col("brand"))}
    )


def prepare_masters(masters: DataFrame) -> DataFrame:
    """Block, token set and order of stored masters; needs ``founded_order`` (run_ts, seq)."""
    return with_shape(masters).select(
        "master_key",
        *SHAPE,
        order_key(0, F.col("founded_order.run_ts"), F.col("founded_order.seq")).alias("ord"),
    )


def _by_title(listings: DataFrame, titles: DataFrame, columns: list[str], task_rows: int) -> DataFrame:
    """Bring columns of the parsed titles back to the appearances; titles listed often are salted."""
    hot = titles.filter(F.col("n") > task_rows).select(
        *TITLE, F.ceil(F.col("n") / task_rows).cast("int").alias("_salts")
    )
    return salted_join(listings, titles.select(*TITLE, *columns), TITLE, "left", hot=hot)


def candidate_blocking(listings: DataFrame, masters: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Number of candidate masters and the oldest one for each prepared listing.

    Candidates stay counted per block; pairs are never written out.
    """
    per_block = masters.groupBy("block").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.min_by("master_key", "ord").alias("oldest_master")
    )
    titles = parse_titles(listings).join(per_block, "block", "left").withColumn(
        "n_candidates", F.coalesce("n_candidates", F.lit(0))
    )
    return _by_title(listings, settle(titles), ["n_candidates", "oldest_master"], task_rows)


def _combinations(rows: DataFrame, items: str, k: int) -> DataFrame:
    """``rows`` once for every ``k`` of the array ``items``, in its order, as the array ``chosen``."""
    rows = rows.withColumns({"chosen": F.slice(items, 1, 0), "rest": F.col(items)})
    for _ in range(k):
        rows = rows.select(*[c for c in rows.columns if c != "rest"], F.posexplode("rest").alias("_at", "_item"), "rest").withColumns(
            {"chosen": F.array_append("chosen", F.col("_item")), "rest": F.slice("rest", F.col("_at") + 2, F.size("rest"))}
        ).drop("_at", "_item")
    return rows.drop("rest")


def _needed(n: Column, l_n: Column, threshold: float) -> Column:
    """Agreeing tokens without which sets of these sizes cannot reach the threshold; errs on the side of fewer."""
    return F.ceil((n + l_n) * (threshold / (1 + threshold)) - 1e-9).cast("int")


def _width(terms: Column, n: Column, needed: Column, leaders: Column, most_width: int) -> Column:
    """How many agreeing tokens make a key, up to ``most_width`` and to what is needed.

    The least that is expected to find no more than ``FEW`` leaders for a probe, else what is expected to find fewest. The
    expectation takes the probe's first n - needed + k terms for alike and independent.
    """

    def expected(k: int) -> Column:
        first = F.slice(terms, F.lit(1), n - needed + k)
        mean = F.aggregate(first, F.lit(0.0), lambda x, t: x + t["weight"]) / F.size(first)
        ways = reduce(lambda x, i: x * (F.size(first) - i) / (i + 1), range(k), F.lit(1.0))
        return ways * mean**k / leaders ** (k - 1)

    widths = range(1, most_width + 1)
    possible = F.array(*[F.struct(expected(k).alias("cost"), F.lit(k).alias("k")) for k in widths])
    possible = F.filter(possible, lambda x: x["k"] <= needed)
    enough = F.filter(possible, lambda x: x["cost"] <= FEW)
    return F.coalesce(F.get(enough, F.lit(0))["k"], F.array_min(possible)["k"])


def file_leaders(held: DataFrame, k: int) -> DataFrame:
    """Leaders (with ``l_tokens``, sorted) under every ``k`` of their tokens, in ``key``."""
    return _combinations(held, "l_tokens", k).drop("l_tokens").withColumnRenamed("chosen", "key")


def candidates_among(
    probes: DataFrame,
    posted: DataFrame,
    sizes: DataFrame,
    filed: Callable[[int, DataFrame], DataFrame],
    threshold: float,
    most_width: int = MOST_WIDTH,
) -> DataFrame | None:
    """Rows of ``filed`` with the ``sig`` of a probe, one for each key they share; None where no probe can match.

    ``posted`` counts the leaders of a block that have a token (block, token_b, posts), ``sizes`` all of them (block,
    n_leaders). ``filed(k, wanted)`` gives leaders (block, l_n, key, ...) under every k of their tokens, for the blocks and
    sizes wanted. See ``candidate_pairs``.
    """
    probes = probes.select(*SHAPE).filter(F.col("sig") != "")
    terms = probes.withColumn("token", F.explode(_tokens(F.col("sig"))))
    agreeing = settle(
        fuzzy_token_join(terms, posted.withColumnRenamed("token_b", "token"), by=["block"]).join(
            posted, ["block", "token_b"]
        )
    )
    weights = agreeing.groupBy("block", F.col("token_a").alias("token")).agg(F.sum("posts").alias("weight"))
    ranked = (
        terms.join(weights, ["block", "token"], "left")
        .groupBy(*SHAPE)
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("weight", F.lit(0)).alias("weight"), "token"))).alias("terms"))
        .withColumn("n", F.size("terms"))
        .join(sizes, "block")
    )
    # Bounds err on the side of more candidates; the score decides.
    slack = 1e-9
    least = F.ceil(F.lit(threshold) * F.col("n") - slack).cast("int")
    most = F.floor(F.col("n") / threshold + slack).cast("int")
    needed = _needed(F.col("n"), F.col("l_n"), threshold)
    asked = settle(
        ranked.withColumn("l_n", F.explode(F.sequence(F.greatest(least, F.lit(1)), most)))
        .withColumn("k", _width(F.col("terms"), F.col("n"), needed, F.col("n_leaders"), most_width))
        .withColumn("first", F.slice("terms", F.lit(1), F.col("n") - needed + F.col("k")))
        .select(*SHAPE, "l_n", "k", F.transform(F.filter("first", lambda t: t["weight"] > 0), lambda t: t["token"]).alias("first"))
        .filter(F.size("first") >= F.col("k"))
    )
    found = []
    for (k,) in sorted(asked.select("k").distinct().collect()):
        mine = asked.filter(F.col("k") == k)
        keys = _combinations(mine.select(*SHAPE, "l_n", "first"), "first", k).drop("first")
        for i in range(k):
            step = agreeing.select("block", F.col("token_a").alias(f"a{i}"), F.col("token_b").alias(f"b{i}"))
            keys = keys.withColumn(f"a{i}", F.get("chosen", F.lit(i))).join(step, ["block", f"a{i}"])
        sought = F.array_sort(F.array_distinct(F.array(*[f"b{i}" for i in range(k)])))
        keys = keys.withColumn("key", sought).filter(F.size("key") == k).select("block", "l_n", "key", "sig")
        found.append(keys.join(filed(k, mine.select("block", "l_n").distinct()), ["block", "l_n", "key"]))
    return reduce(DataFrame.unionByName, found) if found else None


def candidate_pairs(leaders: DataFrame, probes: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Distinct (block, l_sig, sig) of non-empty sets among which are all that reach the threshold.

    A pair that reaches it has at least ``a`` tokens of the probe that agree, one to one, with tokens of the leader. So of
    any n - a + k tokens of the probe, k do. The probe is looked up by every k of those n - a + k of its tokens that are
    agreed with least often, through all tokens that agree with them; a leader is filed under every k of its tokens. The
    sizes of both sets are part of the key, and a match after the probe's last token looked at is never needed. k is
    one where tokens are rare, more where all are common (see ``_width``), so that keys stay selective.
    """
    leaders = leaders.select("block", F.col("sig").alias("l_sig")).filter(F.col("l_sig") != "")
    held = leaders.withColumn("l_tokens", F.array_sort(_tokens(F.col("l_sig")))).withColumn("l_n", F.size("l_tokens"))
    posted = held.select("block", F.explode("l_tokens").alias("token_b")).groupBy("block", "token_b").agg(F.count(F.lit(1)).alias("posts"))
    sizes = leaders.groupBy("block").agg(F.count(F.lit(1)).alias("n_leaders"))

    def filed(k: int, wanted: DataFrame) -> DataFrame:
        return file_leaders(held.join(wanted, ["block", "l_n"], "left_semi"), k)

    found = candidates_among(probes, posted, sizes, filed, threshold)
    if found is None:
        return leaders.join(probes.select(*SHAPE), "block").limit(0).select("block", "l_sig", "sig")
    return found.select("block", "l_sig", "sig").distinct()


def match_pairs(leaders: DataFrame, probes: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """All (block, l_sig, sig, score) with non-empty sets and score >= threshold, exactly. Both sides are given by
    (block, sig)."""
    return (
        candidate_pairs(leaders, probes, threshold)
        .withColumn("score", token_set_score(_tokens(F.col("l_sig")), _tokens(F.col("sig")), True))
        .filter(F.col("score") >= threshold)
    )


def _score_if_reachable(leader: Column, shape: Column, threshold: float) -> Column:
    """The score, or 0 where cheap tests rule the threshold out.

    Sizes must allow it; and of any n - a + 1 tokens, a being the matches needed, one must agree.
    """
    n1, n2 = F.size(leader), F.size(shape)
    needed = F.ceil((n1 + n2) * (threshold / (1 + threshold)) - 1e-9).cast("int")
    some_agree = F.exists(
        F.slice(shape, F.lit(1), F.greatest(n2 - needed + 1, F.lit(0))),
        lambda t: F.exists(leader, lambda o: tokens_agree(o, t)),
    )
    possible = (n1 == 0) | (n2 == 0) | (sizes_can_reach(n1, n2, threshold) & some_agree)
    return F.when(possible, token_set_score(leader, shape, True)).otherwise(0.0)


def _rising(scored: Column) -> Column:
    """Of (ord, key, score) in order, those with a score above all before."""
    none = F.slice(scored, 1, 0)
    return F.aggregate(
        scored,
        none,
        lambda kept, r: F.when(
            (F.size(kept) == 0) | (r["score"] > F.get(kept, F.size(kept) - 1)["score"]), F.array_append(kept, r)
        ).otherwise(kept),
    )


def _records(leaders: Column, tokens: Column, threshold: float) -> Column:
    """Records of a token set against an ordered array of leaders."""
    scored = F.transform(
        leaders,
        lambda l: F.struct(
            l["ord"].alias("ord"), l["key"].alias("key"), _score_if_reachable(l["tokens"], tokens, threshold).alias("score")
        ),
    )
    return _rising(F.filter(scored, lambda r: r["score"] >= threshold))


def _by_block(df: DataFrame) -> DataFrame:
    """Partition by block. Few bytes but much work: a fixed number of partitions is not merged at runtime."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * 4)
    return df.repartition(tasks, "block")


def _fold_blocks(shapes: DataFrame, threshold: float) -> DataFrame:
    """Records of the shapes asked for, of blocks that a task holds at once; blocks stream through it in order."""
    record = f"struct<ord:{shapes.schema['ord'].dataType.simpleString()},key:string,score:double>"
    rows = shapes.select(*SHAPE, F.col("sig").cast("binary").alias("tokens"), "ord", "key", "fixed", "asked")
    ordered = _by_block(rows).sortWithinPartitions("block", "ord", "key", "sig")
    return ordered.mapInArrow(fold_rows(threshold), f"block string, sig string, records array<{record}>")


def _numbered(batch: DataFrame) -> DataFrame:
    """(block, sig, id): ids grow with the order inside each block."""
    tasks = max(1, math.ceil(batch.count() / TASK_ROWS))
    ranged = batch.select(*SHAPE, "ord").repartitionByRange(tasks, "block", "ord").sortWithinPartitions("block", "ord")
    return settle_partitions(ranged).select(*SHAPE, F.monotonically_increasing_id().alias("id"))


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Go through edges (v, u, state of u) sorted by v, and decide every v that can be: covered by a founder, or
    founder because all before it are covered. The order of v makes a chain inside the task one pass."""
    known: dict[int, int] = {}
    at, founder, open_ = None, False, False
    for batch in batches:
        done = []
        for v, u, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if v != at:
                if at is not None and (founder or not open_):
                    known[at] = COVERED if founder else FOUNDER
                    done.append(at)
                at, founder, open_ = v, False, False
            state = known.get(u, UNKNOWN) if state == UNKNOWN else state
            founder |= state == FOUNDER
            open_ |= state == UNKNOWN
        yield pa.RecordBatch.from_pydict({"id": pa.array(done, pa.int64()), "found": pa.array([known[v] for v in done], pa.int32())})
    if at is not None and (founder or not open_):
        yield pa.RecordBatch.from_pydict({"id": pa.array([at], pa.int64()), "found": pa.array([COVERED if founder else FOUNDER], pa.int32())})


def _independent(batch: DataFrame, threshold: float, task_edges: int = TASK_EDGES) -> DataFrame:
    """Founders among a batch of shapes: in order, those that match no earlier founder of the batch.

    Edges are dealt to tasks in ranges of the order. A round decides whatever its tasks can from what is known and from
    the edges at hand, so that a chain inside a range takes one round, however long. What is left goes through
    ranges of twice as many edges, up to a bound that fits a task: rounds grow with the logarithm of a chain.
    """
    nodes = batch.select(*SHAPE)
    pairs = match_pairs(nodes, nodes, threshold).filter("l_sig <> sig").select("block", "l_sig", "sig")
    numbered = _numbered(batch)
    earlier = numbered.select("block", F.col("sig").alias("l_sig"), F.col("id").alias("u"))
    edges = settle(
        pairs.join(numbered.withColumnRenamed("id", "v"), SHAPE).join(earlier, ["block", "l_sig"]).filter("u < v").select("v", "u")
    )
    later = edges.select(F.col("v").alias("u")).distinct().withColumn("open", F.lit(UNKNOWN))
    edges = settle(edges.join(later, "u", "left").select("v", "u", F.coalesce("open", F.lit(FOUNDER)).alias("state")))
    covered = []
    while left := edges.count():
        ranged = edges.repartitionByRange(math.ceil(left / task_edges), "v").sortWithinPartitions("v")
        found = settle(ranged.mapInArrow(_decide, "id bigint, found int"))
        covered.append(found.filter(F.col("found") == COVERED).select("id"))
        known = edges.join(found.select(F.col("id").alias("v")), "v", "left_anti").join(found.withColumnRenamed("id", "u"), "u", "left")
        edges = settle(known.select("v", "u", F.coalesce("found", "state").alias("state")))
        task_edges = min(2 * task_edges, max(MOST_EDGES, task_edges))
    founders = reduce(lambda df, gone: df.join(gone, "id", "left_anti"), covered, numbered)
    return settle(founders.select(*SHAPE))


def _greedy_founders(stored: DataFrame, undecided: DataFrame, threshold: float, first_batch: int) -> DataFrame:
    """Shapes that found a master, (block, sig), by rounds over growing batches.

    A round takes the next shapes of every block, finds the founders among them, and drops all later
    shapes that match one. Most copies of a large group thus leave in the first rounds, and pairs are
    only formed with founders. The batch ends at the latest of the first shapes of ``buckets`` random
    buckets, about buckets * log(buckets) shapes however many there are.
    """
    founders = undecided.select(*SHAPE).limit(0)
    undecided = settle(undecided.join(match_pairs(stored, undecided, threshold).select(*SHAPE).distinct(), SHAPE, "left_anti"))
    buckets = first_batch
    while not undecided.isEmpty():
        ends = (
            undecided.groupBy("block", F.pmod(F.xxhash64("sig"), F.lit(buckets)).alias("bucket"))
            .agg(F.min("ord").alias("first"))
            .groupBy("block")
            .agg(F.max("first").alias("end"))
        )
        marked = undecided.join(broadcast_if_small(settle(ends)), "block")
        batch = settle(marked.filter(F.col("ord") <= F.col("end")).drop("end"))
        found = _independent(batch, threshold)
        founders = founders.unionByName(found)
        rest = settle(marked.filter(F.col("ord") > F.col("end")).drop("end"))
        undecided = settle(rest.join(match_pairs(found, rest, threshold).select(*SHAPE).distinct(), SHAPE, "left_anti"))
        buckets *= BATCH_GROWTH
    return settle(founders)


def _join_blocks(shapes: DataFrame, threshold: float, first_batch: int) -> DataFrame:
    """Records of the shapes asked for, of blocks of any size, by joins."""
    heads = shapes.groupBy("block").agg(
        F.min(F.struct("ord", "key", "sig")).alias("head"),
        # A block has one shape without tokens at most; it matches everything.
        F.min(F.when(F.col("sig") == "", F.struct("ord", "key", "fixed"))).alias("blank"),
    )
    leads = F.col("blank.fixed") | (F.col("head.sig") == "")
    heads = broadcast_if_small(
        settle(heads.select("block", "head", F.when(F.coalesce(leads, F.lit(False)), F.col("blank")).alias("blank")))
    )
    full = settle(shapes.filter(F.col("sig") != "").join(heads.select("block", "blank"), "block"))
    stored = full.filter("fixed").select(*SHAPE)
    open_shapes = full.filter(~F.col("fixed") & (F.col("blank").isNull() | (F.col("ord") < F.col("blank.ord"))))
    founders = _greedy_founders(stored, open_shapes.select(*SHAPE, "ord"), threshold, first_batch)
    leaders = full.select(*SHAPE, "ord", "key").join(stored.unionByName(founders), SHAPE, "left_semi")
    wanted = full.filter("asked")
    by_shape = match_pairs(leaders, wanted, threshold).join(
        leaders.withColumnRenamed("sig", "l_sig"), ["block", "l_sig"]
    ).select(*SHAPE, "score", "ord", "key")
    by_blank = wanted.filter(F.col("blank").isNotNull()).select(
        *SHAPE, F.lit(1.0).alias("score"), "blank.ord", "blank.key"
    )
    # The oldest leader per score is enough, which bounds the list by the number of scores.
    records = (
        by_shape.unionByName(by_blank)
        .groupBy(*SHAPE, "score")
        .agg(F.min(F.struct("ord", "key")).alias("oldest"))
        .groupBy(*SHAPE)
        .agg(F.array_sort(F.collect_list(F.struct("oldest.ord", "oldest.key", "score"))).alias("scored"))
        .select(*SHAPE, _rising(F.col("scored")).alias("records"))
    )
    # A shape without tokens takes the oldest leader of its block: nothing scores above 1.
    first_record = F.struct("head.ord", "head.key", F.lit(1.0).alias("score"))
    blanks = shapes.filter("asked").filter(F.col("sig") == "").join(heads, "block").select(*SHAPE, F.array(first_record).alias("records"))
    return records.unionByName(blanks)


def _split(shapes: DataFrame, fold_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(shapes of blocks of up to ``fold_bytes``, shapes of larger ones or None)."""
    # A shape is its tokens, once as a text and once as an array, its key and its order.
    own = 2 * F.octet_length("sig") + F.octet_length("key") + 40
    large = settle(shapes.groupBy("block").agg(F.sum(own).alias("bytes")).filter(F.col("bytes") > fold_bytes))
    if large.isEmpty():
        return shapes, None
    large = broadcast_if_small(large.select("block"))
    return shapes.join(large, "block", "left_anti"), shapes.join(large, "block", "left_semi")


def _with_master(listings: DataFrame, titles: DataFrame, records: DataFrame, task_rows: int) -> DataFrame:
    """Give each listing the last record founded no later than itself, and its title's size."""
    known = settle(titles.join(records, SHAPE, "left"))
    # The order is made of two other columns: rows are shuffled without it.
    joined = _by_title(listings.drop("ord"), known, [*SIZE, "size_ok", *SHAPE, "records"], task_rows)
    joined = joined.withColumn("ord", order_key(1, F.col("run_ts"), F.col("seq")))
    last = F.filter("records", lambda r: r["ord"] <= F.col("ord"))
    return joined.withColumn("_best", F.get(last, F.size(last) - 1)).drop("records")


def best_match(
    listings: DataFrame,
    masters: DataFrame,
    threshold: float = MATCH_THRESHOLD,
    fold_bytes: int = FOLD_BYTES,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Best stored master of each prepared listing and its score; null below the threshold.

    The master's tokens are set 1; the oldest master wins ties.
    """
    leaders = settle(
        masters.groupBy(*SHAPE).agg(F.min("ord").alias("ord"), F.min_by("master_key", "ord").alias("key"))
    )
    titles = settle(parse_titles(listings))
    shapes = settle(titles.filter("size_ok").select(*SHAPE).distinct())
    few, many = _split(leaders, fold_bytes)
    entry = F.struct("ord", "key", _tokens(F.col("sig")).alias("tokens"))
    arrays = _by_block(few).groupBy("block").agg(F.array_sort(F.collect_list(entry)).alias("leaders"))
    records = salted_join(_by_block(shapes), arrays, ["block"], task_rows=BLOCK_SHAPES).select(
        *SHAPE, _records(F.col("leaders"), _tokens(F.col("sig")), threshold).alias("records")
    )
    if many is not None:
        asked = shapes.join(broadcast_if_small(many.select("block").distinct()), "block", "left_semi")
        records = records.unionByName(_lookup_blocks(many, asked, threshold))
    return with_best_master(listings, titles, records, task_rows)


def _lookup_blocks(stored: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """Records of shapes against stored masters only, by joins."""
    heads = broadcast_if_small(
        settle(
            stored.groupBy("block").agg(
                F.min(F.struct("ord", "key")).alias("head"),
                F.min(F.when(F.col("sig") == "", F.struct("ord", "key"))).alias("blank"),
            )
        )
    )
    every = settle(asked.join(heads, "block"))
    by_shape = match_pairs(stored, every, threshold).join(
        stored.select("block", F.col("sig").alias("l_sig"), "ord", "key"), ["block", "l_sig"]
    ).select(*SHAPE, "score", F.struct("ord", "key").alias("at"))
    one = F.lit(1.0).alias("score")
    by_blank = every.filter((F.col("sig") != "") & F.col("blank").isNotNull()).select(*SHAPE, one, F.col("blank").alias("at"))
    blanks = every.filter(F.col("sig") == "").select(*SHAPE, one, F.col("head").alias("at"))
    return best_records(by_shape.unionByName(by_blank).unionByName(blanks))


def best_records(scored: DataFrame) -> DataFrame:
    """Records of shapes out of (block, sig, score, at) with the order and key of a leader in ``at``."""
    return (
        scored.groupBy(*SHAPE, "score")
        .agg(F.min("at").alias("at"))
        .groupBy(*SHAPE)
        .agg(F.array_sort(F.collect_list(F.struct("at.ord", "at.key", "score"))).alias("scored"))
        .select(*SHAPE, _rising(F.col("scored")).alias("records"))
    )


def with_best_master(listings: DataFrame, titles: DataFrame, records: DataFrame, task_rows: int) -> DataFrame:
    """Each listing's best stored master and its score, out of the records of its token set."""
    matched = _with_master(listings, titles, records, task_rows)
    return matched.withColumn("master_key", F.col("_best.key")).withColumn("score", F.col("_best.score")).drop("_best")


def assign_masters(
    listings: DataFrame,
    masters: DataFrame | None = None,
    threshold: float = MATCH_THRESHOLD,
    fold_bytes: int = FOLD_BYTES,
    first_batch: int = FIRST_BATCH,
    task_rows: int = TASK_ROWS,
    titles: DataFrame | None = None,
) -> DataFrame:
    """Prepared listings with size, ``master_key`` and ``founds`` (true where a listing founds its master).

    Titles whose numbers do not fit get no master. Otherwise equal to handling the appearances one after the other
    in order. Of stored masters only those in blocks of these listings are compared, and only the listings' own
    token sets are looked up, so the work follows the listings and not the masters. ``titles`` are the parsed titles of the
    listings, where they are at hand.
    """
    titles = settle(parse_titles(listings)) if titles is None else titles
    found = titles.filter("size_ok").select(*SHAPE, "first.ord", "first.key", F.lit(True).alias("asked"))
    if masters is not None:
        touched = broadcast_if_small(settle(found.select("block").distinct()))
        stored = masters.join(touched, "block", "left_semi")
        found = stored.select(*SHAPE, "ord", F.col("master_key").alias("key"), F.lit(False).alias("asked")).unionByName(found)
    shapes = settle(
        found.groupBy(*SHAPE)
        .agg(F.min(F.struct("ord", "key")).alias("first"), F.max("asked").alias("asked"))
        .select(*SHAPE, "first.ord", "first.key", (F.col("first.ord.is_new") == 0).alias("fixed"), "asked")
    )
    few, many = _split(shapes, fold_bytes)
    records = _fold_blocks(few, threshold)
    if many is not None:
        records = records.unionByName(_join_blocks(many, threshold, first_batch))
    return (
        _with_master(listings, titles, records, task_rows)
        .withColumn("master_key", F.col("_best.key"))
        .withColumn("founds", F.coalesce(F.col("_best.ord") == F.col("ord"), F.lit(False)))
        .drop("_best")
    )


def new_masters(assigned: DataFrame) -> DataFrame:
    """Masters founded in this run, carrying the founder's title, brand, size, category, block and token set."""
    return assigned.filter("founds").select(
        "master_key",
        F.col("title").alias("canonical_title"),
        "brand",
        "size_value",
        "size_unit",
        "pack_quantity",
        F.col("category_id").cast("int").alias("category_id"),
        F.struct("run_ts", "seq").alias("founded_order"),
        *SHAPE,
    )


def last_links(assigned: DataFrame) -> DataFrame:
    """The link that stands for each product: the one of its last appearance."""
    return assigned.groupBy(*PRODUCT_KEY).agg(F.max_by("master_key", "ord").alias("master_key"))


def _placed(prepared: DataFrame, columns: Sequence[str] | None, **options) -> DataFrame:
    """``assign_masters``, written without what it reads back or makes anew, and with the title, size and token set of founders
    alone unless all columns are wanted."""
    if columns is None:
        return settle(assign_masters(prepared, **options))
    carried = dict.fromkeys([*PRODUCT_KEY, "run_ts", "seq", "category_id", *columns])
    placed = assign_masters(prepared.select(*dict.fromkeys([*carried, *TITLE, "ord"])), **options)
    of_founders = [F.when(F.col("founds"), F.col(c)).alias(c) for c in (*TITLE, *SIZE, *SHAPE) if c not in carried]
    light = settle(placed.select(*carried, "size_ok", "master_key", "founds", *of_founders))
    return light.withColumn("ord", order_key(1, F.col("run_ts"), F.col("seq")))


def match_products(
    listings: DataFrame,
    masters: DataFrame | Callable[[DataFrame], DataFrame | None] | None,
    categories: DataFrame,
    keyword_map: DataFrame,
    raw_map: DataFrame,
    queue: DataFrame,
    memo: DataFrame | None = None,
    columns: Sequence[str] | None = None,
    **options,
) -> dict[str, DataFrame]:
    """The whole matching step of a run. ``masters`` may be a function that gives those of the blocks it is asked for;
    only these come back then. ``columns`` are those of listings that are wanted in ``assigned``, ``dropped`` and ``unmatched``
    besides product, order and category (not given: all). Listings are written and shuffled with these and what matching
    needs alone, and titles, sizes and token sets stay with founders.

    Returns: ``assigned`` (kept listings with master), ``dropped`` (false positives), ``unmatched``
    (numbers in the title that do not fit), ``masters`` (old and new, categories filled in), ``founded`` (the new ones),
    ``links`` (product to master), ``texts`` (resolved raw categories, for raw map and queue) and ``guesses`` (``memo``, the
    guesses of earlier runs, with those of this one).
    """
    bound_splits(listings.sparkSession, SPLIT_BYTES)
    asked = settle(distinct_texts(listings))
    guesses = settle(guess_texts(open_texts(asked, raw_map, queue), categories, memo))
    texts = settle(resolve_texts(asked, categories, raw_map, queue, guesses))
    if columns is not None:
        listings = listings.select(*dict.fromkeys([*MATCHED, "search_term", *columns]))
    resolved = resolve_category(listings, keyword_map, texts)
    if columns is not None and "search_term" not in columns:
        resolved = resolved.drop("search_term")
    kept, dropped = false_positive_filter(settle(resolved))
    prepared = prepare_listings(kept)
    titles = settle(parse_titles(prepared))
    if callable(masters):
        masters = masters(titles.select("block").distinct())
    stored = prepare_masters(masters) if masters is not None else None
    placed = _placed(prepared, columns, masters=stored, titles=titles, **options)
    assigned = placed.filter("size_ok")
    founded = new_masters(assigned)
    every = founded if masters is None else with_shape(masters).select(*founded.columns).unionByName(founded)
    joined = assigned.filter(~F.col("founds")).select("master_key", "category_id", "run_ts", "seq")
    return {
        "assigned": assigned,
        "dropped": dropped,
        "unmatched": placed.filter(~F.col("size_ok")),
        "masters": fill_category_once(every, joined),
        "founded": founded,
        "links": last_links(assigned),
        "texts": texts,
        "guesses": guesses if memo is None else guesses.unionByName(memo.join(guesses.select("raw_text"), "raw_text", "left_anti")),
    }

"""Building blocks of the check SQL: the sample views and text rules in DuckDB's dialect."""

from __future__ import annotations

FOLD = "translate(lower(replace({x}, 'İ', 'i')), 'ığüşöç', 'igusoc')"


def norm(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR NOT regexp_matches({x}, '\\S') THEN '' ELSE {FOLD.format(x=x)} END)"


def words(x: str, min_length: int = 2, exclude: str = "[]::VARCHAR[]") -> str:
    """Token list with duplicates; wrap in ``first_seen`` for a set."""
    clean = f"regexp_replace({norm(x)}, '[^\\p{{L}}\\p{{Nd}}\\s]', ' ', 'g')"
    return (
        f"list_filter(string_split({clean}, ' '), lambda w: length(w) >= {min_length} "
        f"AND NOT regexp_full_match(w, '\\p{{Nd}}+') AND NOT list_contains({exclude}, w))"
    )


def first_seen(column: str) -> str:
    """Distinct values of a list column in first-seen order."""
    return f"list_filter({column}, lambda w, i: list_position({column}, w) = i)"


def alias_words(x: str) -> str:
    return f"regexp_replace({x}, '\\bkalem\\b', 'penne rigate', 'gi')"


def title_words(title: str, brand: str) -> str:
    fixed = "['ml','lt','l','g','gr','kg','adet','cc','pet','sise','su','dogal','kaynak','sade']"
    return words(alias_words(title), 3, f"list_concat({fixed}, string_split({norm(brand)}, ' '))")


def agree(a: str, b: str) -> str:
    return (
        f"({a} = {b} OR (starts_with({a}, {b}) AND length({a}) - length({b}) <= 3) "
        f"OR (starts_with({b}, {a}) AND length({b}) - length({a}) <= 3) "
        f"OR (least(length({a}), length({b})) >= 5 AND abs(length({a}) - length({b})) <= 2 AND levenshtein({a}, {b}) <= "
        f"CASE WHEN least(length({a}), length({b})) <= 7 THEN 1 ELSE 2 END))"
    )


def score(first: str, second: str, empty: str) -> str:
    hits = f"list_filter(acc.free, lambda o: {agree('t', 'o')})"
    matched = (
        f"list_reduce({first}, lambda acc, t: CASE WHEN len({hits}) > 0 THEN "
        f"{{'m': acc.m + 1, 'free': list_filter(acc.free, lambda p: p <> {hits}[1])}} ELSE acc END, "
        f"{{'m': 0, 'free': {second}}}).m"
    )
    return (
        f"(CASE WHEN len({first}) = 0 AND len({second}) = 0 THEN 1.0::DOUBLE "
        f"WHEN len({first}) = 0 OR len({second}) = 0 THEN {empty}::DOUBLE "
        f"ELSE {matched}::DOUBLE / (len({first}) + len({second}) - {matched}) END)"
    )


NOUN = "split_part(p_name, ' ', 2)"
STEP = "(p_size % 5 + 1)"
SIZE_TEXT = f"""(CASE p_partkey % 6 WHEN 0 THEN ' ' || {STEP} * 100 || ' gr' WHEN 1 THEN ' ' || {STEP} || ',5 lt'
 WHEN 2 THEN ' 12 x ' || {STEP} * 100 || ' Ml' WHEN 3 THEN ' ' || {STEP} * 100 || ' Gr 25''li'
 WHEN 4 THEN ' ' || {STEP} * 100 || ' adet' ELSE '' END)"""
BRAND = "(CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE p_brand END)"
SAFE_BRAND = "(CASE WHEN p_partkey % 50 = 0 THEN 'Unknown' ELSE p_brand END)"


def spelling(which: str) -> str:
    return (
        f"(CASE {which} WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' WHEN 2 THEN replace(p_name, 'i', 'y') "
        f"WHEN 3 THEN p_name || ' ' || lower(p_type) ELSE upper(p_name) || ' Classic' END)"
    )


TITLES = f"""titles AS (SELECT p_partkey, {spelling('p_partkey % 5')} || {SIZE_TEXT} AS title, {BRAND} AS brand,
 p_type AS raw_category FROM part)"""

LISTING = f"""listing AS (SELECT 'shop_' || l_suppkey AS source, l_partkey AS external_id,
 upper(left({NOUN}, 1)) || substr({NOUN}, 2) AS search_term, l_shipdate AS run_ts, l_suppkey AS source_pos,
 list_position(['anvil','bolt','gear','gizmo','plate','ring','rod','widget'], {NOUN}) - 1 AS term_pos,
 (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey AS pos,
 {spelling('l_suppkey % 5')} || {SIZE_TEXT} AS title, {BRAND} AS brand, {SAFE_BRAND} AS safe_brand,
 'http://img/' || l_partkey || '/' || l_suppkey AS image_url,
 (CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) / 100.0::DOUBLE AS price,
 (CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) / 50.0::DOUBLE AS regular_price,
 CASE l_partkey % 7 WHEN 0 THEN p_type WHEN 1 THEN p_type || ' ' || {NOUN} WHEN 2 THEN p_type || ' ' || p_name
  WHEN 3 THEN '  ' WHEN 4 THEN {NOUN} WHEN 5 THEN '  ' || upper({NOUN}) || ' ' END AS source_category,
 'http://shop/' || l_suppkey || '?o=' || l_orderkey AS product_url
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

ARRIVAL = "run_ts, term_pos, source_pos, pos"


def latest(source: str, where: str = "true") -> str:
    """Newest state per key, with the first url."""
    return (
        f"(SELECT * EXCLUDE (rn) REPLACE (first_url AS product_url) FROM (SELECT *, "
        f"row_number() OVER (PARTITION BY source, external_id ORDER BY run_ts DESC, term_pos DESC, source_pos DESC, pos DESC) AS rn, "
        f"first_value(product_url) OVER (PARTITION BY source, external_id ORDER BY {ARRIVAL}) AS first_url "
        f"FROM {source} WHERE {where}) WHERE rn = 1)"
    )


PRODUCTS = f"""products AS (SELECT *, CAST(external_id AS VARCHAR) AS master_key FROM {latest('listing')})"""

CATEGORIES = """categories AS (SELECT * FROM (VALUES (1, 'Economy', 'economy', 'e', NULL, 3), (2, 'Small', 'small', 's', NULL, 1),
 (3, 'Medium', 'medium', NULL, NULL, 2), (4, 'Promo', 'promo', 'p', NULL, 6), (5, 'Standard', 'standard', 't', NULL, 5),
 (6, 'Large', 'large', NULL, NULL, 4), (7, 'Economy Bolt', 'economy-bolt', 'b', 1, 7), (8, 'Unused', 'unused', 'u', NULL, 8))
 AS t(id, name, slug, icon, parent_id, display_order))"""
KEYWORDS = """keyword_map AS (SELECT * FROM (VALUES ('widget', 1), ('gizmo', 2), ('bolt', 3), ('gear', 4), ('ring', 5), ('rod', 6)) AS t(keyword, category_id))"""
RAW_MAP = """raw_map AS (SELECT * FROM (VALUES ('ring', 5), ('bolt', 3), ('plate', 2)) AS t(raw_text, category_id))"""
QUEUE = """queue AS (SELECT * FROM (VALUES (901, 'gear', NULL, 0.5::DOUBLE, 'Rejected'), (902, 'economy rod', 1, 0.5::DOUBLE, 'Rejected'),
 (903, 'small gizmo', 2, 0.5::DOUBLE, 'Pending')) AS t(id, raw_text, suggested_id, score, status))"""

_UNIT = "(gr|g|kg|ml|cc|lt|l)\\b"
_NUM = "(\\d+[.,]?\\d*)"
_PACK = f"(\\d+)\\s*x\\s*{_NUM}\\s*{_UNIT}"
_SIZE = f"{_NUM}\\s*{_UNIT}"
_COUNT = "(\\d+)\\s*''?\\s*(?:li|lı|lu|lü|adet)\\b"


def sized(source: str, title: str) -> str:
    """``source`` with size_value, size_unit and pack_quantity read from ``title``."""
    ex = lambda p, g: f"regexp_extract({title}, '{p}', {g}, 'i')"
    number = "CAST(replace({0}, ',', '.') AS DOUBLE) * CASE WHEN lower({1}) IN ('kg','lt','l') THEN 1000 ELSE 1 END"
    unit = "CASE WHEN lower({0}) IN ('gr','g','kg') THEN 'G' ELSE 'ML' END"
    return f"""(SELECT * EXCLUDE (a1, a2, a3, b1, b2, c1),
 CASE WHEN a1 <> '' THEN {number.format('a2', 'a3')} WHEN b1 <> '' THEN {number.format('b1', 'b2')} WHEN c1 <> '' THEN CAST(c1 AS DOUBLE) END AS size_value,
 CASE WHEN a1 <> '' THEN {unit.format('a3')} WHEN b1 <> '' THEN {unit.format('b2')} WHEN c1 <> '' THEN 'ADET' END AS size_unit,
 CASE WHEN a1 <> '' THEN CAST(a1 AS INT) WHEN b1 <> '' AND c1 <> '' THEN CAST(c1 AS INT) ELSE 1 END AS pack_quantity
 FROM (SELECT *, {ex(_PACK, 1)} AS a1, {ex(_PACK, 2)} AS a2, {ex(_PACK, 3)} AS a3, {ex(_SIZE, 1)} AS b1, {ex(_SIZE, 2)} AS b2,
  {ex(_COUNT, 1)} AS c1 FROM {source}))"""


MASTERS = f"""masters AS (SELECT master_key, canonical_title, brand, size_value, size_unit, pack_quantity, category_id FROM
 {sized(f"(SELECT CAST(p_partkey AS VARCHAR) AS master_key, p_name || {SIZE_TEXT} AS canonical_title, {SAFE_BRAND} AS brand, lower(p_type) AS kind FROM part)", 'canonical_title')}
 LEFT JOIN (SELECT lower(name) AS kind, id AS category_id FROM categories) USING (kind))"""

DEAL_OFFERS = """offers AS (SELECT *, CASE WHEN size_unit IN ('G','ML') THEN 'weight_or_volume' ELSE 'count' END AS family,
 size_value * pack_quantity AS total_size,
 price / (size_value * pack_quantity / CASE WHEN size_unit IN ('G','ML') THEN 1000 ELSE 1 END) AS price_per_unit
 FROM (SELECT m.*, p.source, p.external_id, p.price, p.image_url, p.product_url FROM masters m JOIN products p USING (master_key))
 WHERE category_id IS NOT NULL AND size_value <> 0)"""
DEAL_STATS = """counts AS (SELECT category_id, count(*) FILTER (family = 'weight_or_volume') AS n_weight,
 count(*) FILTER (family = 'count') AS n_count FROM offers GROUP BY ALL),
 families AS (SELECT *, CASE WHEN n_weight >= n_count THEN 'weight_or_volume' ELSE 'count' END AS primary_unit FROM counts),
 ordered AS (SELECT category_id, primary_unit, n_weight, n_count, total_size, row_number() OVER (PARTITION BY category_id ORDER BY total_size) - 1 AS idx
  FROM offers JOIN families USING (category_id) WHERE family = primary_unit),
 stats AS (SELECT category_id, primary_unit, n_weight, n_count, total_size AS median_size, total_size * 3 AS cap FROM ordered
  WHERE idx = greatest(n_weight, n_count) // 2)"""
DEAL_SECTIONS = """sections AS (SELECT offers.*, primary_unit, CASE WHEN family = primary_unit THEN 'primary' ELSE 'other' END AS section,
 round(price_per_unit, 9) AS unit_key FROM offers JOIN stats USING (category_id)
 WHERE family <> primary_unit OR cap = 0 OR total_size <= cap)"""

CATALOG = ", ".join([LISTING, PRODUCTS, CATEGORIES, MASTERS])
DEALS = ", ".join([CATALOG, DEAL_OFFERS, DEAL_STATS, DEAL_SECTIONS])

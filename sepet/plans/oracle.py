"""Check SQL for the registered queries, in DuckDB's dialect."""

from __future__ import annotations

from . import oracle_parts as p

SQL: dict[str, str] = {}


def _with(parts: str, body: str) -> str:
    return f"WITH {parts} {body}"


# Catalogue

_SEARCH = """SELECT master_key, canonical_title, masters.brand AS brand, min(price) AS lowest_price, count(*) AS offer_count,
 max(image_url) AS image_url FROM masters JOIN (SELECT master_key, price, image_url FROM products) USING (master_key) {where}
 GROUP BY master_key, canonical_title, masters.brand {having}"""


def _search(where: str = "", having: str = "") -> str:
    return _with(p.CATALOG, _SEARCH.format(where=where, having=having))


SQL["brands"] = _with(p.CATALOG, "SELECT DISTINCT brand FROM masters WHERE master_key IN (SELECT master_key FROM products) AND brand <> '' ORDER BY brand")
SQL["product_offers"] = _with(
    p.CATALOG,
    "SELECT master_key, canonical_title, source, external_id, price, image_url, product_url FROM masters JOIN (SELECT * EXCLUDE (brand) FROM products) USING (master_key)",
)
SQL["product_search"] = _search()
SQL["search_text_filter"] = _search("WHERE contains(lower(canonical_title), 'widget') OR contains(lower(masters.brand), 'widget')")
SQL["search_brand_filter"] = _search("WHERE masters.brand = 'Brand#7'")
SQL["search_price_having"] = _search(having="HAVING min(price) >= 200 AND min(price) <= 900.5")
SQL["search_sort"] = _with(
    p.CATALOG,
    "SELECT master_key, canonical_title, min(price) AS lowest_price FROM masters JOIN (SELECT master_key, price FROM products) USING (master_key) "
    "WHERE contains(lower(canonical_title), 'gear') OR contains(lower(brand), 'gear') GROUP BY ALL ORDER BY lowest_price DESC, master_key",
)
for _sort, _keys in {
    "price_asc": "lowest_price, master_key",
    "price_desc": "lowest_price DESC, master_key",
    "name_asc": "canonical_title, master_key",
    "name_desc": "canonical_title DESC, master_key",
}.items():
    SQL[f"search_order_{_sort}"] = (
        f"SELECT master_key, canonical_title, lowest_price, row_number() OVER (ORDER BY {_keys}) AS place FROM ({_search()})"
    )
SQL["category_counts"] = _with(
    f"{p.CATEGORIES}, {p.MASTERS}",
    "SELECT id, name, slug, icon, count(master_key) AS product_count FROM categories LEFT JOIN masters ON category_id = id "
    "WHERE parent_id IS NULL GROUP BY id, name, slug, icon, display_order HAVING count(master_key) > 0 ORDER BY display_order",
)
_QUEUE = """review AS (SELECT doc_id AS id, 'text ' || doc_id AS raw_text, CASE WHEN doc_id % 9 > 0 THEN doc_id % 9 END AS suggested_id,
 (doc_id % 46 + 40) / 100.0::DOUBLE AS score, CASE WHEN quality = 0 THEN 'Rejected' WHEN toxic = 1 THEN 'Approved' ELSE 'Pending' END AS status FROM labels)"""
SQL["review_pending"] = _with(
    f"{p.CATEGORIES}, {_QUEUE}",
    "SELECT review.id, raw_text, score, name AS suggested_category, suggested_id FROM review LEFT JOIN categories c ON c.id = suggested_id "
    "WHERE status = 'Pending' ORDER BY score DESC, review.id",
)
SQL["cheapest_offer_flag"] = _with(
    f"{p.LISTING}, {p.PRODUCTS}",
    "SELECT master_key, source, external_id, price, row_number() OVER (PARTITION BY master_key ORDER BY price, source, external_id) = 1 AS is_cheapest FROM products",
)

SQL["cheapest_offer_flag_salted"] = SQL["cheapest_offer_flag"]

# Unit prices and deals

_OFFER = "category_id, source, external_id, canonical_title, brand, price, size_unit, total_size, round(price_per_unit, 6) AS price_per_unit"
SQL["unit_price"] = _with(p.DEALS, "SELECT source, external_id, total_size, round(price_per_unit, 6) AS price_per_unit FROM offers")
SQL["unit_label"] = _with(
    f"{p.CATEGORIES}, {p.MASTERS}",
    "SELECT master_key, CASE size_unit WHEN 'ML' THEN 'L' WHEN 'G' THEN 'kg' ELSE 'adet' END AS unit_label FROM masters",
)
SQL["price_display"] = _with(
    f"{p.LISTING}, {p.PRODUCTS}, {_QUEUE}",
    "SELECT source || '/' || external_id AS item, '₺' || translate(format('{:,}', CAST(round(price * 100) AS BIGINT) // 100), ',', '.') || ',' || "
    "lpad(CAST(CAST(round(price * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS shown FROM products "
    "UNION ALL SELECT 'review/' || id, (id % 46 + 40) || '%' FROM review",
)
SQL["deals_offers"] = _with(p.DEALS, f"SELECT {_OFFER}, master_key, image_url, product_url FROM offers")
SQL["deals_by_text"] = _with(f"{p.DEALS}, {p.KEYWORDS}", f"SELECT {_OFFER} FROM offers WHERE category_id IN (SELECT category_id FROM keyword_map WHERE keyword = lower('Gizmo'))")
SQL["deals_family_split"] = _with(p.DEALS, "SELECT category_id, primary_unit, n_weight, n_count FROM families")
SQL["deals_median_cap"] = _with(p.DEALS, "SELECT category_id, median_size, cap FROM stats")
_RANK = "row_number() OVER (PARTITION BY category_id ORDER BY unit_key, source, external_id) AS rank"
SQL["deals_ranked"] = _with(p.DEALS, f"SELECT {_OFFER}, {_RANK} FROM sections WHERE section = 'primary'")
SQL["deals_other_units"] = _with(p.DEALS, f"SELECT {_OFFER} FROM sections WHERE section = 'other'")
SQL["deals_by_category"] = _with(
    p.DEALS,
    f"SELECT {_OFFER}, section, primary_unit, {_RANK} FROM sections WHERE section = 'primary' "
    f"UNION ALL SELECT {_OFFER}, section, primary_unit, NULL FROM sections WHERE section = 'other'",
)
SQL["deals_brand_facet"] = _with(p.DEALS, "SELECT DISTINCT category_id, brand FROM sections WHERE section = 'primary' AND brand <> ''")
_CHOSEN = "section = 'primary' AND brand IN ('Brand#3', 'Brand#7', 'Unknown')"
SQL["deals_filter_sort"] = _with(
    p.DEALS,
    f"SELECT {_OFFER}, section, {_RANK} FROM sections WHERE {_CHOSEN} UNION ALL SELECT {_OFFER}, section, NULL FROM sections WHERE section = 'other'",
)
for _sort, _key in {"deals_sort_price": "price", "deals_sort_price_desc": "price DESC"}.items():
    SQL[_sort] = _with(
        p.DEALS,
        f"SELECT {_OFFER}, section, row_number() OVER (PARTITION BY category_id ORDER BY section DESC, {_key}, source, external_id) AS place FROM sections",
    )
SQL["deals_ranked_split"] = SQL["deals_ranked"]
SQL["deals_top3"] = _with(p.DEALS, f"SELECT * FROM (SELECT {_OFFER}, {_RANK} FROM sections WHERE section = 'primary') WHERE rank <= 3")

# Text

SQL["normalize_text"] = f"SELECT doc_id, {p.norm('text')} AS normal FROM documents"
SQL["tokenize"] = f"""WITH split AS (SELECT doc_id, {p.words('text')} AS ws FROM documents),
 tokens AS (SELECT doc_id, w, min(idx) AS first_at FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS idx FROM split) GROUP BY ALL),
 joined AS (SELECT doc_id, count(*) AS n_tokens, string_agg(w, ' ' ORDER BY first_at) AS tokens FROM tokens GROUP BY ALL)
 SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN joined USING (doc_id)"""
_TITLE_TEXT = "concat_ws(' ', brand, title, raw_category)"
SQL["tokenize_title"] = (
    f"WITH {p.TITLES}, split AS (SELECT p_partkey, {p.title_words(_TITLE_TEXT, 'brand')} AS ws FROM titles) "
    f"SELECT p_partkey, array_to_string({p.first_seen('ws')}, ' ') AS tokens FROM split"
)
_RENAMED = "replace(replace(title, 'gear', 'Kalem'), 'rod', 'kalem')"
SQL["alias_expand"] = f"WITH {p.TITLES} SELECT p_partkey, {p.alias_words(_RENAMED)} AS title FROM titles"
SQL["extract_size"] = f"WITH {p.TITLES} SELECT p_partkey, title, size_value, size_unit, pack_quantity FROM {p.sized('titles', 'title')}"
SQL["default_brand"] = f"WITH {p.TITLES} SELECT p_partkey, CASE WHEN brand IS NULL OR trim(brand) = '' THEN 'Unknown' ELSE brand END AS brand FROM titles"

# Similarity and categories

# DuckDB counts edits in bytes; one-byte stand-ins make it count letters.
_BYTES = "translate({0}, 'àáâãäåæèéêëìíîïñòóôõùúûýÿœß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_@')"
SQL["fuzzy_token_join"] = f"""WITH a AS (SELECT DISTINCT w AS token_a, {_BYTES.format('w')} AS x FROM (SELECT unnest({p.words('text')}) AS w FROM documents)),
 b AS (SELECT DISTINCT w AS token_b, {_BYTES.format('w')} AS y FROM (SELECT unnest({p.words('text')}) AS w FROM benchmark))
 SELECT token_a, token_b FROM a, b WHERE abs(length(x) - length(y)) <= 3 AND {p.agree('x', 'y')}"""
SQL["token_set_score"] = f"""WITH {p.LISTING}, pairs AS (SELECT source, pos, {p.title_words(f'p_name || {p.SIZE_TEXT}', 'safe_brand')} AS f,
 {p.title_words('title', 'safe_brand')} AS s FROM listing JOIN part ON p_partkey = external_id),
 sets AS (SELECT source, pos, {p.first_seen('f')} AS f, {p.first_seen('s')} AS s FROM pairs)
 SELECT source, pos, round({p.score('f', 's', '1')}, 9) AS score FROM sets"""
SQL["keyword_category"] = _with(
    f"{p.LISTING}, {p.KEYWORDS}",
    "SELECT source, pos, search_term, category_id FROM listing LEFT JOIN keyword_map ON keyword = lower(search_term)",
)
TEXTS = f"""{p.LISTING}, {p.CATEGORIES}, {p.KEYWORDS}, {p.RAW_MAP}, {p.QUEUE},
 asked AS (SELECT *, CASE WHEN regexp_matches(source_category, '\\S') THEN lower(regexp_replace(source_category, '^\\s+|\\s+$', '', 'g')) END AS raw_text FROM listing),
 texts AS (SELECT DISTINCT raw_text FROM asked WHERE raw_text IS NOT NULL)"""
_GUESS = f"""{TEXTS}, tt AS (SELECT raw_text, {p.words('raw_text')} AS t FROM texts), cc AS (SELECT id, {p.words('name')} AS c FROM categories),
 scored AS (SELECT raw_text, id, {p.score('t', 'c', '0')} AS score FROM (SELECT raw_text, {p.first_seen('t')} AS t FROM tt), (SELECT id, {p.first_seen('c')} AS c FROM cc)),
 guesses AS (SELECT raw_text, id AS category_id, score FROM (SELECT *, row_number() OVER (PARTITION BY raw_text ORDER BY score DESC, id) AS rn FROM scored WHERE score > 0) WHERE rn = 1)"""
_ROUTE = "CASE WHEN score >= 0.85 THEN 'accept' WHEN score >= 0.4 THEN 'review' ELSE 'none' END"
RESOLVED = f"""{_GUESS}, resolved AS (SELECT raw_text, raw_map.category_id AS mapped_id, guesses.category_id AS guess_id, score,
 CASE WHEN raw_map.category_id IS NOT NULL THEN 'mapped' WHEN raw_text IN (SELECT raw_text FROM queue WHERE status = 'Rejected') THEN 'rejected'
 WHEN score IS NULL THEN 'none' ELSE {_ROUTE} END AS route FROM texts LEFT JOIN raw_map USING (raw_text) LEFT JOIN guesses USING (raw_text)),
 answers AS (SELECT *, CASE route WHEN 'mapped' THEN mapped_id WHEN 'accept' THEN guess_id END AS resolved_id FROM resolved),
 listing2 AS (SELECT asked.*, k.category_id AS keyword_id, a.resolved_id, CASE WHEN asked.raw_text IS NULL THEN k.category_id ELSE a.resolved_id END AS category_id,
 coalesce(asked.raw_text IS NOT NULL AND k.category_id <> a.resolved_id, false) AS dropped
 FROM asked LEFT JOIN keyword_map k ON k.keyword = lower(search_term) LEFT JOIN answers a ON a.raw_text = asked.raw_text)"""
SQL["raw_category_lookup"] = _with(TEXTS, "SELECT raw_text, category_id FROM texts LEFT JOIN raw_map USING (raw_text)")
SQL["rejected_anti"] = _with(TEXTS, "SELECT raw_text FROM texts WHERE raw_text NOT IN (SELECT raw_text FROM queue WHERE status = 'Rejected')")
SQL["category_best_guess"] = _with(_GUESS, "SELECT raw_text, category_id, round(score, 9) AS score FROM guesses")
SQL["category_route"] = _with(_GUESS, f"SELECT raw_text, category_id, {_ROUTE} AS route FROM guesses")
SQL["resolve_category"] = _with(RESOLVED, "SELECT source, pos, keyword_id, resolved_id, category_id FROM listing2")
SQL["false_positive_filter"] = _with(RESOLVED, "SELECT source, pos, category_id, dropped FROM listing2")

# Table maintenance

SQL["upsert_latest"] = _with(
    f"{p.LISTING}, {p.PRODUCTS}",
    "SELECT source, external_id, title, price, regular_price, image_url, source_category, product_url, strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS last_updated FROM products",
)
SQL["link_update"] = _with(
    f"{p.LISTING}, {p.PRODUCTS}",
    "SELECT source, external_id, CASE WHEN price < 500 THEN master_key WHEN external_id % 3 = 0 THEN 'old-' || master_key END AS master_key FROM products",
)
SQL["fill_category_once"] = _with(
    f"{p.LISTING}, {p.CATEGORIES}, {p.MASTERS}",
    f"""SELECT master_key, CASE WHEN brand = 'Unknown' AND category_id IS NOT NULL THEN category_id ELSE first_id END AS category_id FROM masters LEFT JOIN
 (SELECT CAST(external_id AS VARCHAR) AS master_key, first(source_pos % 7 + 1 ORDER BY {p.ARRIVAL}) AS first_id FROM listing WHERE source_pos % 4 > 0 GROUP BY ALL) USING (master_key)""",
)
SQL["rawmap_append"] = _with(
    RESOLVED, "SELECT raw_text, category_id FROM raw_map UNION ALL SELECT raw_text, guess_id FROM answers WHERE route = 'accept'"
)
_MD5_KEY = "md5_number_upper({0})"
SQL["review_enqueue"] = _with(
    RESOLVED,
    f"""SELECT CAST(id AS BIGINT) AS id, raw_text, suggested_id, score, status FROM queue UNION ALL
 SELECT CAST(CASE WHEN k > 9223372036854775807 THEN k - 18446744073709551616 ELSE k END AS BIGINT), raw_text, guess_id, round(score, 9), 'Pending'
 FROM (SELECT *, CAST({_MD5_KEY.format('raw_text')} AS HUGEINT) AS k FROM answers WHERE route = 'review' AND raw_text NOT IN (SELECT raw_text FROM queue))""",
)
_ACTION = "CASE WHEN id % 3 = 0 THEN 'reject' WHEN id % 2 = 0 THEN 'approve' END"
SQL["review_approve"] = _with(
    f"{_QUEUE}, {p.RAW_MAP}",
    f"""SELECT raw_text, suggested_id AS category_id, CASE WHEN {_ACTION} = 'approve' THEN 'Approved' ELSE status END AS status FROM review
 UNION ALL SELECT raw_text, category_id, 'in raw map' FROM raw_map
 UNION ALL SELECT raw_text, suggested_id, 'in raw map' FROM review WHERE {_ACTION} = 'approve' AND suggested_id IS NOT NULL""",
)
SQL["review_reject"] = _with(_QUEUE, f"SELECT id, raw_text, CASE WHEN {_ACTION} = 'reject' THEN 'Rejected' ELSE status END AS status FROM review")
SQL["run_counts"] = _with(
    RESOLVED,
    """SELECT strftime(run_ts, '%Y-%m-%d %H:%M:%S') AS run_ts, source, count(*) AS fetched, count(*) FILTER (NOT dropped) AS saved,
 count(*) FILTER (dropped) AS failed FROM listing2 GROUP BY ALL""",
)

# Entity matching

_BLOCK = "concat_ws('|', pack_quantity, coalesce(CAST(size_value AS VARCHAR), ''), coalesce(size_unit, ''), lower({0}))"
_STORED = f"""{p.LISTING}, {p.CATEGORIES}, {p.MASTERS},
 stored AS (SELECT master_key, CAST(master_key AS BIGINT) AS ord, {_BLOCK.format('brand')} AS block, {p.title_words('canonical_title', 'brand')} AS ws FROM masters),
 titled AS (SELECT DISTINCT title, safe_brand FROM listing),
 sized AS (SELECT title, safe_brand, {_BLOCK.format('safe_brand')} AS block, {p.title_words('title', 'safe_brand')} AS ws FROM {p.sized('titled', 'title')})"""
SQL["candidate_blocking"] = _with(
    _STORED,
    """SELECT source, pos, n_candidates, oldest_master FROM listing JOIN
 (SELECT title, safe_brand, count(master_key) AS n_candidates, arg_min(master_key, ord) AS oldest_master FROM sized LEFT JOIN stored USING (block) GROUP BY ALL)
 USING (title, safe_brand)""",
)
SQL["best_match"] = _with(
    f"""{_STORED}, pairs AS (SELECT title, safe_brand, master_key, ord, {p.first_seen('m')} AS m, {p.first_seen('s')} AS s FROM
 (SELECT title, safe_brand, master_key, ord, stored.ws AS m, sized.ws AS s FROM sized JOIN stored USING (block))),
 scored AS (SELECT title, safe_brand, master_key, ord, {p.score('m', 's', '1')} AS score FROM pairs),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, safe_brand ORDER BY score DESC, ord) AS rn FROM scored WHERE score >= 0.7) WHERE rn = 1)""",
    "SELECT source, pos, master_key, round(score, 9) AS score FROM listing LEFT JOIN best USING (title, safe_brand)",
)


def _sequential(source: str) -> str:
    """Appearances one after the other, block by block, in a recursive query."""
    best = (
        f"list_sort(list_filter(list_transform(w.leaders, lambda l: {{'s': -({p.score('l.t', 'i.t', '1')}), 'k': l.k}}), lambda x: x.s <= -0.7))[1].k"
    )
    return f"""ordered AS (SELECT *, row_number() OVER (ORDER BY {p.ARRIVAL}) AS k FROM {source}),
 blocked AS (SELECT *, {_BLOCK.format('safe_brand')} AS block, {p.title_words('title', 'safe_brand')} AS ws FROM {p.sized('ordered', 'title')}),
 items AS (SELECT block, k, {p.first_seen('ws')} AS t, row_number() OVER (PARTITION BY block ORDER BY k) AS i FROM blocked),
 walk AS (SELECT block, i, k, k AS leader, [{{'k': k, 't': t}}] AS leaders FROM items WHERE i = 1
  UNION ALL SELECT block, i, k, coalesce(hit, k), CASE WHEN hit IS NULL THEN list_append(leaders, {{'k': k, 't': t}}) ELSE leaders END
  FROM (SELECT i.block, i.i, i.k, i.t, w.leaders, {best} AS hit FROM walk w JOIN items i ON i.block = w.block AND i.i = w.i + 1)),
 keyed AS (SELECT *, concat_ws(':', source, external_id, strftime(run_ts, '%Y%m%d%H%M%S%f'), term_pos, source_pos, pos) AS own_key FROM ordered),
 assigned AS (SELECT o.*, f.own_key AS master_key, walk.leader = walk.k AS founds, f.title AS master_title FROM walk JOIN keyed o ON o.k = walk.k JOIN keyed f ON f.k = walk.leader)"""


SQL["assign_masters"] = f"WITH RECURSIVE {p.LISTING}, {_sequential('listing')} SELECT source, pos, master_key, founds FROM assigned"
SQL["assign_masters_stored"] = SQL["assign_masters"] + " WHERE run_ts >= TIMESTAMP '1996-01-01'"
SQL["assign_masters_joined"], SQL["best_match_joined"] = SQL["assign_masters"], SQL["best_match"]
SQL["match_products"] = f"""WITH RECURSIVE {RESOLVED}, kept AS (SELECT * FROM listing2 WHERE NOT dropped), {_sequential('kept')}
 SELECT 'link' AS kind, source || '/' || external_id AS item, arg_max(master_key, k) AS master_key, NULL AS category_id FROM assigned GROUP BY source, external_id
 UNION ALL SELECT 'master', master_title, master_key, first(category_id ORDER BY k) FILTER (category_id IS NOT NULL) FROM assigned GROUP BY master_title, master_key"""

# Feeds

_SLUG_BAD, _SLUG_RUN = "[^a-z0-9\\s-]", "[\\s-]+"


def _slug(x: str) -> str:
    return f"replace(trim(regexp_replace(regexp_replace({p.norm(x)}, '{_SLUG_BAD}', '', 'g'), '{_SLUG_RUN}', ' ', 'g')), ' ', '-')"


def _md5_key(x: str) -> str:
    k = f"CAST({_MD5_KEY.format(x)} AS HUGEINT)"
    return f"CAST(CASE WHEN {k} > 9223372036854775807 THEN {k} - 18446744073709551616 ELSE {k} END AS BIGINT)"


_PARTS = f"""base AS (SELECT p_partkey AS k, 'page ' || (p_partkey - p_partkey % 24) AS search_term, p_partkey - p_partkey % 24 AS term_pos,
 row_number() OVER (PARTITION BY p_partkey - p_partkey % 24 ORDER BY p_partkey) - 1 AS pos, {p.spelling('p_partkey % 5')} || {p.SIZE_TEXT} AS title,
 CASE WHEN p_partkey % 50 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 5 <> 3 THEN p_type END AS category,
 CASE WHEN p_partkey % 7 <> 0 THEN 'http://img/' || p_partkey END AS image, round(p_retailprice * 100) / 100 AS price,
 (round(p_retailprice * 100) + 500) / 100 AS higher, p_partkey % 97 = 96 AS bad FROM part)"""
_COLUMNS = "source, search_term, pos, external_id, title, brand, barcode, image_url, price, regular_price, source_category, product_url"
_NONE = "CAST(NULL AS VARCHAR)"
_FALLBACK = "CASE WHEN k % 3 = 1 THEN higher ELSE price END"
_SHOP = {
    "migros": f"SELECT 'migros' AS source, 0 AS source_pos, search_term, term_pos, pos, k AS external_id, title, brand, {_NONE} AS barcode, image AS image_url, price, higher AS regular_price, category AS source_category, 'https://www.migros.com.tr/part-' || k AS product_url FROM base WHERE NOT bad",
    "macrocenter": f"SELECT 'macrocenter', 1, search_term, term_pos, pos, k, title, brand, {_NONE}, image, price, higher, category, 'https://www.macrocenter.com.tr/part-' || k FROM base WHERE NOT bad",
    "marketfiyati": f"SELECT 'marketfiyati', 2, search_term, term_pos, pos, {_md5_key(chr(39) + 'M' + chr(39) + ' || k')}, title, brand, {_NONE}, image, CASE WHEN k % 11 = 0 THEN 0 ELSE price END, CASE WHEN k % 11 = 0 THEN 0 ELSE price END, category, 'https://marketfiyati.org.tr/detay/M' || k || '/' || {_slug('title')} FROM base WHERE NOT bad OR k % 11 = 0",
    "hakmarexpress": f"SELECT 'hakmarexpress', 3, search_term, term_pos, pos, k, title, brand, '869' || k, image, price, {_FALLBACK}, category, 'https://www.hakmarexpress.com.tr/part-' || k FROM base WHERE k % 13 <> 12 AND NOT bad",
    "mion": f"SELECT 'mion', 4, search_term, term_pos, pos, k, title, {_NONE}, {_NONE}, image, price, higher, {_NONE}, 'https://www.mion.com.tr/urun/part-' || k FROM base WHERE NOT bad",
    "cagrimarket": f"SELECT 'cagrimarket', 5, search_term, term_pos, pos, CASE WHEN k % 19 = 0 THEN 0 ELSE k END, title, {_NONE}, {_NONE}, image, price, {_FALLBACK}, {_NONE}, 'http://c/' || k FROM base WHERE (term_pos // 24) % 3 < 2 AND NOT bad",
    "evidea": f"SELECT 'evidea', 6, search_term, term_pos, pos, CASE WHEN k % 23 = 0 OR k % 17 = 0 THEN 0 ELSE k END, title, {_NONE}, {_NONE}, image, price, {_FALLBACK}, {_NONE}, 'http://e/' || k FROM base WHERE NOT bad",
}
_HEAD = "shops(source, source_pos, search_term, term_pos, pos, external_id, title, brand, barcode, image_url, price, regular_price, source_category, product_url)"


def _shops(*names: str) -> str:
    return f"{_PARTS}, {_HEAD} AS ({' UNION ALL '.join(_SHOP[n] for n in names)})"


SQL["feed_flatten_nested"] = _with(_shops("migros", "macrocenter", "mion", "marketfiyati", "evidea"), f"SELECT {_COLUMNS} FROM shops")
SQL["feed_root_or_data_array"] = _with(_shops("cagrimarket"), f"SELECT {_COLUMNS} FROM shops")
SQL["feed_find_array"] = _with(_shops("hakmarexpress"), f"SELECT {_COLUMNS} FROM shops")
SQL["array_first_field"] = _with(_shops("migros", "marketfiyati", "evidea"), "SELECT source, search_term, pos, image_url, price FROM shops")
SQL["array_last_field"] = _with(_shops("hakmarexpress"), "SELECT external_id, source_category FROM shops")
SQL["array_key_lookup"] = _with(_shops("evidea"), "SELECT search_term, pos, external_id FROM shops")
SQL["minor_units_price"] = _with(_shops("migros", "macrocenter", "mion"), "SELECT source, external_id, price, regular_price FROM shops")
SQL["regular_price_fallback"] = _with(
    _shops("hakmarexpress", "evidea", "cagrimarket", "marketfiyati"), "SELECT source, search_term, pos, price, regular_price FROM shops"
)
SQL["stable_key_md5"] = f"SELECT doc_id, {_md5_key('text')} AS stable_key FROM documents"
SQL["slug_url"] = _with(
    _shops("marketfiyati"), f"SELECT 'url' AS kind, product_url FROM shops UNION ALL SELECT 'document', {_slug('text')} FROM documents"
)
SQL["url_template"] = _with(_shops("migros", "macrocenter", "mion", "hakmarexpress"), "SELECT source, external_id, product_url FROM shops")
_EVERY = "migros", "macrocenter", "marketfiyati", "hakmarexpress", "mion", "cagrimarket", "evidea"
SQL["feed_quarantine"] = _with(
    _shops(*_EVERY),
    "SELECT source, search_term, pos, 'good' AS outcome FROM shops UNION ALL "
    "SELECT source, search_term, pos, 'item not readable' FROM base, (SELECT unnest(['migros','macrocenter','marketfiyati','hakmarexpress','mion','cagrimarket','evidea']) AS source) "
    "WHERE bad AND NOT (source = 'marketfiyati' AND k % 11 = 0) AND NOT (source = 'hakmarexpress' AND k % 13 = 12) AND NOT (source = 'cagrimarket' AND (term_pos // 24) % 3 = 2)",
)
SQL["feed_union"] = _with(_shops(*_EVERY[:4]), "SELECT source, term_pos, source_pos, pos, external_id, title, price FROM shops")

# Whole runs

_FEED_LISTING = f"""{_shops(*_EVERY[:4])}, listing AS (SELECT *, TIMESTAMP '2024-01-01' AS run_ts, coalesce(brand, 'Unknown') AS safe_brand FROM shops)"""
SQL["ingest_run"] = f"""WITH RECURSIVE {RESOLVED.replace(p.LISTING, _FEED_LISTING)}, kept AS (SELECT * FROM listing2 WHERE NOT dropped), {_sequential('kept')},
 grouped AS (SELECT master_key, first(category_id ORDER BY k) FILTER (category_id IS NOT NULL) AS category_id FROM assigned GROUP BY ALL)
 SELECT source, external_id, title, price, product_url, master_key, grouped.category_id FROM assigned JOIN grouped USING (master_key)"""
SQL["stream_upsert"] = """WITH last AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn,
 first_value(event_id) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS first_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
 SELECT event_type AS source, user_id AS external_id, 'k ' || k AS title, value AS price, value AS regular_price,
 CASE WHEN k % 2 = 0 THEN 'even' END AS source_category, 'http://event/' || first_id AS product_url,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_updated FROM last WHERE rn = 1"""
SQL["stream_ingest"] = SQL["ingest_run"]

# The same answers by the ways for large groups.
SQL["product_offers_bucketed"] = SQL["product_offers"]
SQL["deals_offers_bucketed"] = SQL["deals_offers"]
SQL["deals_median_split"] = SQL["deals_median_cap"]
SQL["best_match_indexed"] = SQL["best_match"]

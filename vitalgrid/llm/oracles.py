"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Levels of the tree that the SQL unrolls: 8 ** 9 rows of a group.
_LEVELS = 9
#: Round of the table of crc32, as text: one of eight steps over all bytes.
_STEP = "(SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM {})"


def _crc_table() -> str:
    rows = "(SELECT i, i AS v FROM range(256) AS t(i))"
    for _ in range(8):
        rows = _STEP.format(rows)
    return rows


def _field(name: str) -> str:
    value = f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, nodes: str) -> str:
    """CTEs ``{name}{k}`` (grp, p, n, h, l, r: nodes of level k with their siblings' digests) over ``nodes`` (grp, p, n, h)."""
    out, below = [], nodes
    for k in range(_LEVELS):
        run = "PARTITION BY grp, p // 8 ORDER BY p ROWS BETWEEN"
        out.append(f"""{name}{k} AS (SELECT grp, p, n, h,
    coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {below})""")
        below = f"""(SELECT grp, p // 8 AS p, (max(n) + 7) // 8 AS n,
    CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h FROM {name}{k} GROUP BY grp, p // 8)"""
    return ",\n".join([*out, f"{name}_top AS (SELECT grp, h FROM {below})"])


def _fold(name: str, start: str) -> str:
    """CTEs that take ``start`` (doc_id, grp, p, n, proof, folded and more) up the tree ``name``; the last is ``{name}_up``."""
    out, below = [], start
    for k in range(_LEVELS):
        out.append(f"""{name}_up{k} AS (SELECT u.* REPLACE (u.p // 8 AS p, u.proof || CASE WHEN t.n > 1 THEN t.l || t.r ELSE '' END AS proof,
    CASE WHEN t.n > 1 THEN sha256(t.l || u.folded || t.r) ELSE u.folded END AS folded)
    FROM {below} u JOIN {name}{k} t ON u.grp = t.grp AND u.p = t.p)""")
        below = f"{name}_up{k}"
    return ",\n".join([*out, f"{name}_up AS (SELECT * FROM {below})"])


ORACLES = {
    "op6_ngram_decontamination": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
seen AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, s.n, item_id FROM seen s JOIN known k ON s.n = k.n AND s.g = k.g),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_superminhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS r FROM ends UNION SELECT e.y, r.r FROM reach r JOIN ends e ON e.x = r.doc_id),
roots AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
    coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
""",
    "op11_quotient_filter_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op12_presence_mask_search": f"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
""",
    "op13_lag_lead_merkle_manifest": f"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM {_crc_table()}),
ids AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS code FROM documents, crc),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf("text")} AS leaf,
    CASE WHEN code % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS folded FROM ids),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_tree("a", "(SELECT grp, p, n, leaf AS h FROM placed)")},
langs AS (SELECT '' AS grp, grp AS name, row_number() OVER (ORDER BY grp) - 1 AS p, count(*) OVER () AS n, h FROM a_top),
{_tree("b", "(SELECT grp, p, n, h FROM langs)")},
{_fold("a", "(SELECT doc_id, grp, p, leaf, '' AS proof, folded FROM placed)")},
named AS (SELECT doc_id, '' AS grp, langs.p, leaf, proof, folded, langs.h AS subroot FROM a_up JOIN langs ON a_up.grp = langs.name),
{_fold("b", "named")}
SELECT doc_id, leaf, subroot, b_top.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b_top.h AS verified FROM b_up, b_top
""",
}

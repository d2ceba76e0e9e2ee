"""SQL twins of what SQL can state about the subpackage's queries."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# WARC records: digests in base32, and the largest page of each digest as the response.
WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{_LETTERS}', ((('0x' || substr(hex, (i // 8)::INT * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m"""

# Every pair of documents that share a 5-gram of words, and the components of those that are alike enough.
NGRAM_JOIN = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [chr(1) || text] ELSE list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) END AS grams FROM d),
k AS (SELECT doc_id, len(grams) AS n, md5(array_to_string(list_sort(grams), chr(2))) AS set_key, grams FROM s),
g AS (SELECT doc_id, n, set_key, unnest(list_transform(grams, lambda x: hash(x))) AS gram FROM k),
half AS (SELECT a.doc_id AS a, b.doc_id AS b, a.set_key AS ka, b.set_key AS kb FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id AND a.n >= 0.79 * b.n AND b.n >= 0.79 * a.n GROUP BY ALL HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
pairs AS (SELECT * FROM half UNION ALL SELECT b, a, kb, ka FROM half),
reach(node, root) AS (SELECT doc_id, doc_id FROM k UNION SELECT pairs.b, reach.root FROM reach JOIN pairs ON reach.node = pairs.a),
classes AS (SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY 1),
links AS (SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN ka <> kb THEN kb END) AS n_text_links FROM pairs GROUP BY 1)
SELECT k.doc_id, min(k.doc_id) OVER (PARTITION BY set_key) AS copy_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links
FROM k JOIN classes USING (doc_id) LEFT JOIN links USING (doc_id)"""

# Edited texts of the fingerprints' contract.
MINHASH_EDITS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS follower, length(text) AS n_chars FROM d)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(substr(text, 1, n_chars - n_chars // 2) || substr(follower, 1, n_chars // 2)) AS edited_sha256 FROM n"""

def _centroids(k: int, rounds: int, components: int, scale: int, seed: int) -> str:
    """Lloyd's rounds in full: every vector against every centroid, a pair of expressions for each round. The least of d * 1,000 + c is
    the nearest centroid, the smaller number where distances tie."""
    steps = []
    for t in range(rounds + 1):
        d = "list_sum(list_transform(range(1, {n} + 1), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i])))::BIGINT".format(n=components)
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, min({d}::HUGEINT * 1000 + c) AS best FROM x CROSS JOIN c{t} y GROUP BY r)")
        if t < rounds:
            steps.append(f"s{t} AS MATERIALIZED (SELECT c, i, sum(e)::HUGEINT AS s, count(*) AS n FROM (SELECT (best % 1000)::INT AS c, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{t} JOIN x USING (r)) GROUP BY ALL)")
            steps.append(f"m{t} AS (SELECT c, list((((s - (s % n + n) % n) // n)::BIGINT) ORDER BY i) AS v FROM s{t} GROUP BY c)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c, coalesce(m{t}.v, c{t}.v) AS v FROM c{t} LEFT JOIN m{t} USING (c))")
    return f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id)), v) - 1 AS c, v FROM x ORDER BY c LIMIT {k}),
{", ".join(steps)}, f AS (SELECT r, (best % 1000)::INT AS cluster, (best // 1000)::BIGINT AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
    sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM f JOIN x USING (r) JOIN c{rounds} ON c = cluster"""


def _spans(kind: str, pattern: str, valid: str, group: int = 0) -> str:
    """kind, first, last of the valid matches; offsets follow from the lengths of matches and of what lies between them."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::BIGINT AS first, length(found[i]) AS size
        FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS found, regexp_extract_all(text, '{p}', {group}) AS parts, string_split_regex(text, '{p}') AS pieces FROM d WHERE regexp_matches(text, '{p}'))) WHERE {valid}"""


_DIGITS = "regexp_replace(found[i], '[^0-9]', '', 'g')"
_DOUBLED = "(substr({d}, (length({d}) - j)::INT, 1)::INT * (1 + j % 2))"
_LUHN = "list_sum(list_transform(range(length({d})), lambda j: {x} - CASE WHEN {x} > 9 THEN 9 ELSE 0 END)) % 10 = 0".format(d=_DIGITS, x=_DOUBLED.format(d=_DIGITS))
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(found[i], '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
}
_any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SECRETS = {
    "assign": (rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(parts[i]) >= 12", 1),
    "access": (r"AKIA[A-Z0-9]+", "length(found[i]) >= 18", 0),
    "hex": (r"[0-9a-f]+", "length(found[i]) >= 16", 0),
}


def _base(kinds: dict[str, tuple], order: str) -> str:
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    spans = " UNION ALL ".join(_spans(k, *v) for k, v in kinds.items())
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS ({spans}), ranked AS (SELECT *, CASE kind {ranks} END AS kind_rank FROM spans)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(concat(kind, ':', first, ':', first + size), ',' ORDER BY {order}) FILTER (kind IS NOT NULL), '')) AS base_sha256 FROM d LEFT JOIN ranked USING (doc_id) GROUP BY d.doc_id"""


ORACLE = {
    "op4_ngram_join": NGRAM_JOIN,
    "op9_warc": WARC,
    "op11_centroids": _centroids(40, 5, 64, 256, 2),
    "minhash_edits": MINHASH_EDITS,
    "pii_base": _base(_PII, "kind_rank, first"),
    "secrets_base": _base(_SECRETS, "first, kind_rank"),
}

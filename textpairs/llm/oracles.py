"""DuckDB SQL of the operators whose results SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One row ``t``: the CRC-32 of every byte value (fixed value: the polynomial).
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, list_transform(range(8), lambda k: 0::BIGINT)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; needs a column ``t`` of ``crc_table``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            f"lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT)")


def lower_az(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def minhash_sql(shingle: int, percent: int) -> str:
    """All pairs of sets that share a shingle, counted; components by reachability."""
    run = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(shingle))
    return f"""WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all({lower_az('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {shingle - 2}), lambda i: {run})) END AS s FROM words),
shared AS (SELECT doc_id, len(s) AS n, g FROM (SELECT *, unnest(s) AS g FROM sets) QUALIFY count(*) OVER (PARTITION BY g) > 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n + b.n) AS n, count(*) AS c FROM shared a JOIN shared b
  ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n GROUP BY x, y),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= {percent} * (n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)"""


def trie_sql() -> str:
    """Every prefix of every rebuilt conversation as a list, grouped; sums over the prefixes of each node."""
    return f"""WITH {CRC_TABLE},
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos,
  coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, {crc32('conv_id::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own), crc_table),
built AS (SELECT conv.conv_id, pos, r, x FROM conv JOIN own ON own.conv_id = conv.conv_id - conv.conv_id % 100 WHERE pos < h
  UNION ALL SELECT own.conv_id, pos, r, x FROM own JOIN conv USING (conv_id) WHERE pos >= h),
seqs AS (SELECT conv_id, coalesce(s, []) AS s FROM conv LEFT JOIN
  (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY pos) AS s FROM built GROUP BY conv_id) USING (conv_id)),
prefixes AS (SELECT conv_id, d, list_slice(s, 1, d) AS p, len(s) = d AS ends FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT p, d, min(conv_id) AS c, count(*) AS n,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS e FROM prefixes GROUP BY p, d),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN kids USING (p, d)),
upward AS (SELECT list_slice(p, 1, a) AS p, a AS d, (k = 0)::INTEGER AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(p[d].x) END AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_nodes)),
sums AS (SELECT p, d, sum(leaf) AS leaves, sum(saved) AS saved FROM upward GROUP BY p, d)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, u.c AS parent_conv_id, v.n::BIGINT AS n_convs, v.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, v.e AS ends_sha256
FROM full_nodes v JOIN sums USING (p, d) LEFT JOIN full_nodes u ON u.d = v.d - 1 AND u.p = list_slice(v.p, 1, v.d - 1)"""


def importance_sql(longest: int = 3, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> str:
    """Counts of hashed runs, gains of the buckets, weights, noise and the draw."""
    def runs(table: str, name: str) -> str:
        parts = [f"SELECT k, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS f FROM (SELECT k, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {table} WHERE len(w) >= {n})"
                 for n in range(1, longest + 1)]
        return f"{name} AS (" + " UNION ALL ".join(parts) + ")"

    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    h = f"('0x' || substr(sha256('{seed}:' || doc_id::VARCHAR), 1, 8))::BIGINT"
    return f"""WITH {CRC_TABLE},
docs AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all({lower_az('text')}, '{word}') AS w FROM documents),
aims AS (SELECT row_number() OVER () AS k, regexp_extract_all({lower_az('text')}, '{word}') AS w FROM benchmark),
{runs('docs', 'doc_runs')}, {runs('aims', 'aim_runs')},
bucket_of AS (SELECT f, {crc32('f')} % {buckets} AS b FROM (SELECT f FROM doc_runs UNION SELECT f FROM aim_runs), crc_table),
d AS (SELECT b, count(*) AS s FROM doc_runs JOIN bucket_of USING (f) GROUP BY b),
a AS (SELECT b, count(*) AS t FROM aim_runs JOIN bucket_of USING (f) GROUP BY b),
gains AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM d) + {buckets})::DOUBLE)
  / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM a) + {buckets})::DOUBLE)))::BIGINT AS g FROM d FULL JOIN a USING (b)),
weights AS (SELECT k, count(*) AS n, sum(g) AS weight FROM doc_runs JOIN bucket_of USING (f) JOIN gains USING (b) GROUP BY k),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln(({h} + 0.5) / 4294967296.0))))::BIGINT AS score FROM docs LEFT JOIN weights USING (k)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {percent} * n // 100 THEN r END AS rank FROM scored LEFT JOIN able USING (doc_id)"""

"""The SQL that queries of this folder must equal, where SQL can say it."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, breaks: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{breaks}]+'), lambda w: w <> '')"


_SPACES = r"\x20\x09-\x0D"
_MARKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"

OP1 = f"""WITH d AS (SELECT doc_id, {_words("coalesce(text, '')", _SPACES)} AS words FROM documents),
  w AS (SELECT doc_id, s, array_to_string(words[s + 1:s + 20], ' ') AS win
    FROM (SELECT doc_id, words, unnest(range(greatest(0, len(words) - 19))) AS s FROM d)),
  again AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, s) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again),
  each_word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM d),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each_word
    ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP4 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER, _SPACES)} AS words FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS g FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY ALL),
  links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
  sides(a, b) AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN sides e ON e.a = r.other),
  top AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
  FROM d JOIN top USING (doc_id) LEFT JOIN n USING (doc_id)"""

_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {}) & 31 AS INTEGER) + 1, 1)"
_DIGEST = f"""array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || sha[i * 5 + 1:i * 5 + 5] AS BIGINT)),
  lambda v: {' || '.join(_BASE32.format(k) for k in (15, 10, 5, 0))}), '')"""

OP8 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
  f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
  SELECT page_id, strlen(payload) AS payload_bytes, {_DIGEST} AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (sha)"""

OP9 = f"""WITH i AS (SELECT item_id, {_words(_LOWER, _MARKS)} AS words FROM benchmark),
  iw AS (SELECT DISTINCT item_id, size, array_to_string(words[s + 1:s + size], ' ') AS win FROM (
    SELECT item_id, words, least(10, len(words)) AS size, unnest(range(len(words) - least(10, len(words)) + 1)) AS s
    FROM i WHERE len(words) > 0)),
  d AS (SELECT doc_id, {_words(_LOWER, _MARKS)} AS words FROM documents),
  dw AS (SELECT doc_id, size, s, array_to_string(words[s + 1:s + size], ' ') AS win FROM (
    SELECT doc_id, words, size, unnest(range(len(words) - size + 1)) AS s FROM d, (SELECT DISTINCT size FROM iw)
    WHERE len(words) >= size)),
  hits AS (SELECT doc_id, s, size, item_id FROM dw JOIN iw USING (size, win)),
  n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS k, string_agg(name, ',' ORDER BY name) AS names FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(k, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _crc32(text: str) -> str:
    """The CRC-32 of a short ASCII text: per byte one step that mixes it in and eight that shift (marked -1)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = ("CASE WHEN v >= 0 THEN xor(h, v) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END")
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda h, v: {step}), 4294967295)"


OP11 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  t AS (SELECT vec_id, unnest(c) AS w, generate_subscripts(c, 1) AS i FROM v),
  s AS (SELECT q.vec_id AS query_id, x.vec_id, sum(q.w * x.w) AS score FROM t q JOIN t x ON q.i = x.i
    AND q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id GROUP BY ALL)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, CAST(score AS BIGINT) AS score FROM s
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

OP12 = f"""WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  h AS (SELECT conv_id, own, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM o),
  c AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS k
    FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
  m AS (SELECT conv_id, k, unnest(range(len(k) + 1)) AS d FROM c),
  n AS (SELECT k[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(k) = d), '')) AS ends
    FROM m GROUP BY ALL),
  kids AS (SELECT path[1:depth - 1] AS path, count(*) AS k FROM n WHERE depth > 0 GROUP BY ALL),
  f AS (SELECT n.*, coalesce(k, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[depth].t) END AS saved FROM n LEFT JOIN kids USING (path)),
  above AS (SELECT path[1:a] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
    FROM (SELECT path, n_children, saved, unnest(range(depth + 1)) AS a FROM f) GROUP BY ALL)
  SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, above.n_leaves,
    CAST(above.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
  FROM f JOIN above USING (path) LEFT JOIN f p ON p.path = f.path[1:f.depth - 1] AND f.depth > 0"""

OP13 = f"""WITH w AS (SELECT doc_id, {_words("coalesce(text, '')", _SPACES)} AS w, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
  g AS (SELECT doc_id, w, h, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a,
    1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM w),
  x AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM g),
  grams AS (SELECT doc_id, i, w[i + 1:i + 4] AS gram FROM (SELECT doc_id, w, unnest(range(greatest(0, len(w) - 3))) AS i FROM x)),
  pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS d FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i),
  marked AS (SELECT doc_id, d, i, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM pairs),
  stretches AS (SELECT doc_id, d, min(i) AS s, max(i) + d + 4 AS e FROM marked GROUP BY doc_id, d, island),
  runs AS (SELECT doc_id, s, e, min(d) AS q FROM stretches WHERE e - s >= greatest(12, 2 * d) GROUP BY ALL),
  told AS (SELECT doc_id, count(*) AS n_runs, arg_max([s, e - s, q], [e - s, -s, -q]) AS best,
    string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
  each_word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM x),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM each_word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
  SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
    1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
    sha256(coalesce(kept.text, '')) AS collapsed_sha256
  FROM x LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE = {"op1_substring_dedup": OP1, "op4_lsh_forest": OP4, "op8_warc_zstd": OP8, "op9_decontamination": OP9,
          "op11_top_k": OP11, "op12_prefix_trie": OP12, "op13_basic_factor_runs": OP13}

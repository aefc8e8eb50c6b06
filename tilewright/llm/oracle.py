"""DuckDB statements of the corpus queries that SQL can express at the size of the check."""

_WORDS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

# The checksum's table (one row) from its rule, and the checksum of a string's bytes.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS UINTEGER), list_transform(range(8), lambda x: CAST(0 AS UINTEGER))),
                        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END) AS c
  FROM range(256) AS r(i)))"""


def _crc(text: str) -> str:
    byte = f"CAST(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) AS UINTEGER)"
    all_bytes = f"list_transform(range(octet_length(encode({text}))), lambda i: {byte})"
    step = "lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)"
    ones = "CAST(4294967295 AS UINTEGER)"
    return f"xor(list_reduce(list_prepend({ones}, {all_bytes}), {step}), {ones})"


def _runs(table: str, key: str) -> str:
    """Runs of one to three words of a table's texts, by key."""
    words = f"w_{table} AS MATERIALIZED (SELECT {key} AS k, coalesce({_WORDS.format('text')}, []) AS w FROM {table})"
    parts = " UNION ALL ".join(
        f"SELECT k, unnest([array_to_string(w[i : i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})]) AS g FROM w_{table}" for n in (1, 2, 3)
    )
    return f"{words}, g_{table} AS MATERIALIZED ({parts})"


ORACLE = {
    "op2_language": f"""
WITH {_CRC_TABLE},
docs AS MATERIALIZED (SELECT doc_id, lang, ' ' || lower(text) || ' ' AS x, coalesce(regexp_matches(text, '\\pL'), false) AS lettered,
  {_crc("CAST(doc_id AS VARCHAR)")} % 4 = 2 AS held_out FROM documents, crc),
cleaned AS MATERIALIZED (SELECT doc_id, lang, held_out, lettered, regexp_replace(x, '[^\\pL\\p{{Nl}}\\p{{No}}]+', ' ', 'g') AS x FROM docs),
grams AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM (
  SELECT doc_id, unnest([substr(x, i, k) FOR i IN range(1, length(x) - k + 2)]) AS g FROM cleaned, (VALUES (1), (2), (3)) AS v(k) WHERE x IS NOT NULL)
  WHERE g <> ' ' GROUP BY ALL),
profiles AS MATERIALIZED (SELECT lang, g, r FROM (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS r
  FROM grams JOIN cleaned USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g) WHERE r < 300),
own AS MATERIALIZED (SELECT * FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS r
  FROM grams) WHERE r < 300),
langs AS (SELECT DISTINCT lang AS name FROM profiles),
far AS (SELECT own.doc_id, name, sum(CASE WHEN p.r IS NULL THEN 300 ELSE least(abs(p.r - own.r), 300) END) AS away, 300 * count(*) AS most
  FROM own CROSS JOIN langs LEFT JOIN profiles p ON p.lang = name AND p.g = own.g GROUP BY ALL),
best AS (SELECT doc_id, arg_min(name, struct_pack(a := away, b := name)) AS lang_pred, 1 - CAST(min(away) AS DOUBLE) / any_value(most) AS score FROM far GROUP BY doc_id)
SELECT doc_id, held_out, CASE WHEN lettered THEN lang_pred ELSE 'und' END AS lang_pred, CASE WHEN lettered THEN score ELSE 0 END AS score
FROM cleaned LEFT JOIN best USING (doc_id)""",
    "op12_spelling": f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT d, run, d || ':' || run AS k, count(*) AS c FROM (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, c, {_crc('k')} AS h FROM runs, crc),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
  SELECT c, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word
  FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
masked AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || chr(1) || substr(word, i + 1) AS mask, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM masked a JOIN masked b ON a.mask = b.mask AND a.word <> b.word
  UNION SELECT masked.word, w.word, w.n FROM masked JOIN w ON rest = w.word
  UNION SELECT w.word, masked.word, masked.n FROM masked JOIN w ON rest = w.word),
tops AS (SELECT word, count(*) AS n_near, arg_min(near, struct_pack(a := -near_n, b := near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, near AS form, near_n AS form_n FROM tops JOIN w USING (word) WHERE near_n >= 10 * n),
chain(word, root) AS (SELECT word, form FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word),
roots AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM forms))
SELECT w.word, form, coalesce(root, w.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM w LEFT JOIN tops USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)""",
    "op13_importance": f"""
WITH {_CRC_TABLE}, {_runs('documents', 'doc_id')}, {_runs('benchmark', 'item_id')},
b AS MATERIALIZED (SELECT g, CAST({_crc('g')} % 10000 AS INTEGER) AS b FROM (SELECT DISTINCT g FROM (SELECT g FROM g_documents UNION ALL SELECT g FROM g_benchmark)), crc),
s AS (SELECT b, count(*) AS s FROM g_documents JOIN b USING (g) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM g_benchmark JOIN b USING (g) GROUP BY b),
totals AS (SELECT (SELECT count(*) FROM g_documents) AS all_s, (SELECT count(*) FROM g_benchmark) AS all_t),
gain AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (all_s + 10000) AS DOUBLE) / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (b), totals),
weights AS (SELECT k, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM g_documents JOIN b USING (g) JOIN gain USING (b) GROUP BY k),
scored AS (SELECT w.k AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(w.k AS VARCHAR), '')), 1, 8) AS UBIGINT) AS DOUBLE) + 0.5)
    / 4294967296.0))) AS BIGINT) AS score
  FROM w_documents w LEFT JOIN weights ON weights.k = w.k)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) <= (5 * count(*) OVER (PARTITION BY n_words >= 20)) // 100
            THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS rank
FROM scored""",
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n,
              unnest([array_to_string(w[i : i + least(len(w), 13) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 13) + 2)]) AS win
       FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
              unnest([array_to_string(w[i : i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS win
       FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_mixture": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (place % 3)] AS w FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM totals)),
f AS (SELECT *, sum(source_size) OVER () AS words,
             coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (ORDER BY source_size / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
             row_number() OVER (ORDER BY source_size / w, place) AS k FROM w),
level AS (SELECT k AS from_k, capped AS c, open_w AS o FROM f WHERE 4 * source_size * open_w >= w * (3 * words - 2 * capped) ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, place, count(*) OVER () AS sources,
             CASE WHEN from_k IS NULL OR k < from_k THEN CAST(2 * source_size AS DOUBLE)
                  ELSE CAST(w * (3 * words - 2 * c) AS DOUBLE) / CAST(2 * o AS DOUBLE) END AS target
      FROM f LEFT JOIN level ON true),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM sized),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN sources > 1 THEN 0.5 - place / (sources - 1) ELSE 0 END AS a,
             (c + size / 2) / target AS first, (c + size / 2 + source_size) / target AS second
      FROM run JOIN t ON run.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (CAST(first < 1 AS INT) + CAST(second < 1 AS INT)) AS BIGINT) AS taken,
       round(CASE WHEN size > 0 AND first < 1 THEN 2 * first / ((1 + a) + sqrt((1 + a) * (1 + a) - 4 * a * first)) END, 9) AS train_at
FROM p""",
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op7_url_filter": r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
      FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)""",
    "op10_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))
                + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
}

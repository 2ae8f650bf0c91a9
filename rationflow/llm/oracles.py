"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def ngram_join(n: int, num: int, den: int) -> str:
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: w[i:i + {n - 1}])
                               WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE {den} * c >= {num} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = w.doc_id"""


_SECRETS = (  # kind, pattern, group, least length, base
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    ("access", "AKIA[A-Z0-9]{14,}", 0, 18, True),
    ("hex", "[0-9a-f]{16,}", 0, 16, True),
    ("host", "gh[opsur]_[A-Za-z0-9]{36,}", 0, 1, False),
    ("key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, False),
)


def secret_scan() -> str:
    parts = []
    for no, (kind, rx, group, least, base) in enumerate(_SECRETS):
        parts.append(f"""
SELECT doc_id, '{kind}' AS kind, {no} AS no, {str(base).lower()} AS base, s.pos AS pos, s.e AS e FROM (
  SELECT doc_id, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
      'pos': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
      'e': list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))),
      'n': length(g[i])}}), lambda r: r.n >= {least})) AS s
  FROM (SELECT doc_id, string_split_regex(t, '{rx}') AS p, regexp_extract_all(t, '{rx}') AS m,
               regexp_extract_all(t, '{rx}', {group}) AS g FROM d))""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(parts)}),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat(kind, ':', pos, ':', e), ',' ORDER BY pos, no) FILTER (base) AS b,
         string_agg(concat(kind, ':', pos, ':', e), ',' ORDER BY pos, no) AS s FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN per ON per.doc_id = d.doc_id"""


def quality(min_docs: int, share: float, least_words: int, least_part: float) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
wins AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d))),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM wins, range(0, 5) AS r(j) WHERE c > 1 GROUP BY doc_id),
raw AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (
  SELECT doc_id, source, t, line, array_to_string(regexp_extract_all({_LOWER.format("line")}, '{_WORD}'), ' ') AS norm,
         len(regexp_extract_all(line, '{_WORD}')) AS n FROM raw WHERE regexp_matches(line, '{_WORD}')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
seen AS (SELECT DISTINCT source, t, norm, substr(md5(norm), 1, 15) AS k FROM lines),
shared AS (SELECT *, count(*) OVER (PARTITION BY source, norm) AS n, count(*) OVER (PARTITION BY source, t) AS n_lines FROM seen),
placed AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY source, t) AS n_shared,
                  min(k) OVER (PARTITION BY source, t) AS k1 FROM shared WHERE n > 1 WINDOW w AS (PARTITION BY source, t ORDER BY k)),
least AS (SELECT *, max(k) FILTER (place = 2) OVER (PARTITION BY source, t) AS k2 FROM placed),
often AS (SELECT l.source, l.norm FROM least l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source
          GROUP BY l.source, l.norm, h.n
          HAVING count(DISTINCT CASE WHEN 2 * (n_shared - 1) > n_lines - 1 THEN CASE WHEN k = k1 THEN k2 ELSE k1 END ELSE 't' || t END)
                 > greatest({share} * h.n, least({min_docs}, greatest(5, h.n / 2)))),
cut AS (SELECT l.doc_id, sum(l.n) AS n FROM lines l JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.norm = l.norm
        GROUP BY l.doc_id),
all_ AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(w) - coalesce(cut.n, 0) AS words_left
  FROM d LEFT JOIN dups ON dups.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN cut ON cut.doc_id = d.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= {least_words}
         AND words_left >= {least_part} * n_words AS kept, CAST(words_left AS BIGINT) AS words_left FROM all_"""


def sharding(n: int) -> str:
    """The checksum is worked out byte by byte from the table of the CRC-32
    polynomial, itself made here."""
    return f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(0, 256) AS r(i))),
d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
               regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
             lambda c, b: xor(c >> 8, crc.tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS first,
         sum(size) OVER () AS total FROM d),
s AS (SELECT *, CAST(first * {n} // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard FROM s"""


def warc(least: int) -> str:
    """Base32 of a digest: five hex digits are four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = "CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)"
    quad = " || ".join(f"substr('{letters}', (({group} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) AS nth,
             max(page_id) OVER (PARTITION BY body) AS lead_id FROM p)
SELECT page_id, strlen(body) AS payload_bytes, list_aggregate(list_transform(range(0, 8), lambda i: {quad}), 'string_agg', '') AS payload_digest,
       CASE WHEN nth > 1 AND strlen(body) >= {least} THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN nth > 1 AND strlen(body) >= {least} THEN lead_id END AS refers_to FROM r"""


def fill_in_middle(salt: str, fim_percent: int, spm_percent: int) -> str:
    draw = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{salt}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, length(t) AS n, {draw(0)} % (length(t) + 1) AS x, {draw(1)} % (length(t) + 1) AS y,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {draw(2)} % 100 >= {fim_percent} THEN 'plain'
                  WHEN {draw(3)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (SELECT *, substring(t, 1, least(x, y)) AS p, substring(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m,
             substring(t, greatest(x, y) + 1) AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM s"""


def vector_codes(parts: int, entries: int, rounds: int, scale: int, dim: int) -> str:
    """The rounds one after the other, as plain joins of parts and entries."""
    d = dim // parts
    dist = " + ".join(f"(p.v[{j}] - b.v[{j}]) * (p.v[{j}] - b.v[{j}])" for j in range(1, d + 1))
    mean = "[" + ", ".join(f"CAST(floor(sum(p.v[{j}]) / count(*)) AS BIGINT)" for j in range(1, d + 1)) + "]"
    near = lambda i: (f"n{i} AS MATERIALIZED (SELECT p.id, p.pos, arg_min(b.e, ({dist}) * {entries} + b.e) AS e, min({dist}) AS err "  # noqa: E731
                      f"FROM parts p JOIN b{i} b ON b.pos = p.pos GROUP BY p.id, p.pos)")
    book = lambda i: (f"b{i + 1} AS MATERIALIZED (SELECT b.pos, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN ("  # noqa: E731
                      f"SELECT n.pos, n.e, {mean} AS v FROM n{i} n JOIN parts p ON p.id = n.id AND p.pos = n.pos GROUP BY n.pos, n.e) m "
                      f"ON m.pos = b.pos AND m.e = b.e)")
    steps = ",\n".join(f"{near(i)},\n{book(i)}" for i in range(rounds))
    return f"""
WITH rows_ AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dim}
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, pos, v[pos * {d} + 1:pos * {d} + {d}] AS v FROM rows_, range(0, {parts}) AS r(pos)),
b0 AS MATERIALIZED (SELECT pos, id - 1 AS e, v FROM parts WHERE id <= {entries}),
{steps},
{near(rounds)},
per AS (SELECT id, CAST(sum(err) AS BIGINT) AS error, string_agg(printf('%02x', e), '' ORDER BY pos) AS code FROM n{rounds} GROUP BY id)
SELECT r.vec_id, per.code, per.error, CAST(sum(per.error) OVER (PARTITION BY r.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY pos, e)) FROM b{rounds}) AS codebooks_sha256
FROM rows_ r JOIN per ON per.id = r.id"""

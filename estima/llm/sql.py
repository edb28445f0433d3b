"""DuckDB SQL for the queries that SQL can express."""

_RULES = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-{1,4}[^-])*-----END [A-Z ]*PRIVATE KEY-----)?",  # without END: the header only
    "github": r"gh[pousr]_[A-Za-z0-9]{36}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"AIza[A-Za-z0-9_-]{35}",
    "stripe": r"[sr]k_live_[A-Za-z0-9]{16,}",
    "url_login": r"[a-z][a-z0-9+.-]{0,15}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@",
}


def _secret_sql() -> str:
    """Where a match starts: the lengths of the pieces between matches and of the matches before it, summed."""
    parts = []
    for n, (kind, pattern) in enumerate(_RULES.items()):
        least = {"assign": f"length(regexp_extract(m, '{pattern}', 2)) >= 8", "access": "length(m) >= 16"}.get(kind, "true")
        parts.append(f"""
    SELECT doc_id, '{kind}' AS kind, {n} AS k, p AS start, p + length(m) AS stop FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)))::BIGINT AS p
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM docs)
    ) WHERE {least}""")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3), '') AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN listed USING (doc_id)
"""


_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
    row_number() OVER (ORDER BY source_size / weight, encode(source) NULLS LAST) AS pos
  FROM sources
  WINDOW before AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
found AS (SELECT arg_min(level, pos) AS level FROM levels WHERE weight * level <= 2.0::DOUBLE * source_size),
targets AS (
  SELECT source, source_size, least(weight * coalesce(f.level, 'Infinity'::DOUBLE), 2.0::DOUBLE * source_size) AS target
  FROM levels, found f
),
cuts AS (
  SELECT *, floor(target / source_size) AS copies, target - floor(target / source_size) * source_size AS budget
  FROM targets
),
hashes AS (
  SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h
),
edges AS (
  SELECT c.source, min(CASE WHEN upto > budget THEN h END) AS edge,
    arg_min(n, h) FILTER (upto > budget) AS n, arg_min(upto, h) FILTER (upto > budget) AS upto
  FROM cuts c JOIN hashes x ON c.source IS NOT DISTINCT FROM x.source WHERE source_size > 0 GROUP BY c.source
)
SELECT doc_id, size, c.source_size, c.target,
  (CASE WHEN size = 0 THEN 0 ELSE copies + CASE WHEN d.h < e.edge OR (d.h = e.edge AND e.upto - budget < budget - (e.upto - e.n)) THEN 1 ELSE 0 END END * size)::BIGINT AS taken
FROM sized d JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN edges e ON d.source IS NOT DISTINCT FROM e.source
"""

_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s
  FROM words
),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sets p ON a = p.doc_id JOIN sets q ON b = q.doc_id WHERE 100 * n >= 90 * (len(p.s) + len(q.s) - n)
),
reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id FROM sets LEFT JOIN least USING (doc_id)
"""

_TEMPLATES = """
  ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
  ('MIT', 'Released under the MIT License.'),
  ('MIT', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.'),
  ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
  ('GPL-2.0', 'This program is free software under the GNU General Public License, version 2.'),
  ('LGPL-3.0', 'This library is licensed under the GNU Lesser General Public License, version 3.'),
  ('AGPL-3.0', 'Licensed under the GNU Affero General Public License, version 3.'),
  ('MPL-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'),
  ('BSD-3-Clause', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.'),
  ('ISC', 'Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.'),
  ('CC-BY-4.0', 'Licensed under CC BY 4.0.'),
  ('CC-BY-SA-4.0', 'Licensed under CC BY-SA 4.0.'),
  ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
  ('CC0-1.0', 'Released into the public domain under CC0 1.0.'),
  ('Proprietary', 'All rights reserved.')
"""

_LICENSES = rf"""
WITH templates AS (SELECT row_number() OVER () AS template, license, text FROM (VALUES {_TEMPLATES}) t(license, text)),
template_terms AS (
  SELECT template, license, term, count(*) AS tf
  FROM (SELECT template, license, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM templates) GROUP BY ALL
),
idfs AS (SELECT term, ln(16.0::DOUBLE / (1 + count(*))) + 1 AS idf FROM template_terms GROUP BY term),
weights AS (
  SELECT template, license, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY template)) AS weight
  FROM template_terms JOIN idfs USING (term)
),
files AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id % 10 = 0, false) AS named, concat_ws('/', source, lang, doc_id // 100) AS directory,
    concat_ws('/', source, lang, doc_id // 100, CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END) AS path
  FROM documents
),
notices AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+([A-Z])', '\1' || chr(10) || '\2', 'g'), chr(10)),
    lambda x: regexp_matches(x, '(?i)licen[cs]e|rights reserved|permission|redistribution|public domain|spdx')) AS lines, text
  FROM files WHERE regexp_matches(text, '(?i)licen[cs]e|rights reserved|permission|redistribution|public domain|spdx')
),
shares AS (
  SELECT doc_id, len(regexp_extract_all(text, '[^ 	-
]+')) AS words,
    coalesce(list_sum(list_transform(lines, lambda x: len(regexp_extract_all(x, '[^ 	-
]+')))), 0) AS notice_words
  FROM notices
),
units AS (SELECT doc_id, unnest(lines) AS line FROM notices UNION SELECT doc_id, text FROM files WHERE named),
unit_terms AS (
  SELECT doc_id, line, term, count(*) AS tf
  FROM (SELECT doc_id, line, unnest(list_filter(string_split_regex(lower(line), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM units) GROUP BY ALL
),
weighted AS (SELECT doc_id, line, term, tf * coalesce(idf, ln(16.0::DOUBLE) + 1) AS w FROM unit_terms LEFT JOIN idfs USING (term)),
lengths AS (SELECT doc_id, line, sqrt(sum(w * w)) AS length FROM weighted GROUP BY ALL),
scored AS (
  SELECT doc_id, license, round(sum(w * weight) / any_value(length), 6) AS score
  FROM weighted JOIN weights USING (term) JOIN lengths USING (doc_id, line) GROUP BY doc_id, line, template, license
),
own AS (SELECT doc_id, license, score FROM scored WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
all_files AS (
  SELECT f.doc_id, f.path, f.directory, o.license, o.score, coalesce(o.license IS NOT NULL AND (named OR notice_words >= 0.2 * words), false) AS is_licence_file
  FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN shares USING (doc_id)
),
directories AS (
  SELECT directory, license FROM all_files WHERE is_licence_file
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY score DESC, license) = 1
),
above AS (
  SELECT doc_id, d.directory, d.license FROM all_files f JOIN directories d
    ON f.license IS NULL AND (f.directory = d.directory OR starts_with(f.directory, d.directory || '/') OR d.directory = '')
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(d.directory) DESC) = 1
)
SELECT f.doc_id, f.path, f.license AS own_license, f.score, f.is_licence_file, a.directory AS inherited_from, coalesce(f.license, a.license) AS license
FROM all_files f LEFT JOIN above a USING (doc_id)
"""

_TOP_K = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM clean q JOIN clean x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

ORACLES = {"op1_license_scan": _LICENSES, "op2_exact_top_k": _TOP_K, "op9_ngram_jaccard": _JACCARD, "op5_secret_scan": _secret_sql(), "op8_source_mix": _MIX}

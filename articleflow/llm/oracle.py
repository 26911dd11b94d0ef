"""DuckDB statements for the queries that SQL can express. Constants are written out here on their own."""

from __future__ import annotations

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size / w AS ratio, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source) AS j FROM r),
lev AS (
  SELECT o.j, o.ratio,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(2.0::DOUBLE * p.source_size) FROM o p WHERE p.j < o.j), 0))
         / (SELECT sum(p.w) FROM o p WHERE p.j >= o.j) AS level
  FROM o),
lam AS (SELECT level FROM lev WHERE level < ratio ORDER BY j LIMIT 1),
t AS (SELECT source, source_size, least(w * coalesce((SELECT level FROM lam), 'infinity'::DOUBLE), 2.0::DOUBLE * source_size) AS target FROM r),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (whole * size + least(size, greatest(0, budget - whole * source_size - before)))::BIGINT AS taken, source
FROM q
"""

OP7 = r"""
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS head
  FROM pages)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to, url, NULL::VARCHAR AS error
FROM p
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
raw AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l AS (SELECT rid, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws,
             row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS again
      FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (
  SELECT rid, again, len(ws) AS n, list_sum(list_transform(ws, lambda x: strlen(x))) AS bytes,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS sym,
         len(list_filter(ws, lambda x: ends_with(x, '!!') OR ends_with(x, '??') OR ends_with(x, '!?'))) AS doubled,
         length(line) - length(regexp_replace(line, '[A-Z]', '', 'g')) AS up,
         length(line) - length(regexp_replace(line, '[a-z]', '', 'g')) AS low,
         len(list_filter(ws, lambda x: x IN ('|', '>', '»', '·'))) AS seps, len(list_distinct(ws)) AS different,
         regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|click here|subscribe to our newsletter|enable javascript|skip to content|share on facebook|sign up now|back to top') AS phrase
  FROM l),
v AS (
  SELECT rid, again, n,
         again OR sym > 0.12::DOUBLE * bytes OR doubled > 0.5::DOUBLE * n OR (up > 12 AND up > 0.75::DOUBLE * (up + low))
         OR (seps >= 3 AND seps >= 0.25::DOUBLE * n) OR (n <= 12 AND phrase) OR (n >= 10 AND different < 0.4::DOUBLE * n) AS bad
  FROM f),
lines AS (SELECT rid, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (bad) AS failed_lines,
                 coalesce(sum(n) FILTER (NOT bad), 0) AS kept_words FROM v GROUP BY rid),
pos AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) >= 5),
gram AS (SELECT rid, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS five
         FROM pos WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS c FROM gram WHERE five IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, range(0, 5) t(k) WHERE c > 1 GROUP BY rid),
a AS (
  SELECT w.rid, w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         coalesce(kept_words, 0)::BIGINT AS kept_words, coalesce(failed_lines, 0)::BIGINT AS failed_lines
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_words, failed_lines,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - kept_words > 0.5::DOUBLE * n_words) AS kept
FROM a
"""

# Fixed values, written out again: the sentences of the licence scan and its ordered rules.
_SENTENCES = """
apache2_ref=licensed under the apache license version 2 0
apache2_grant=licensed under the apache license version 2 0 the license
apache2_comply=you may not use this file except in compliance with the license
apache2_copy=you may obtain a copy of the license at
as_is_basis=unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
mit_ref=released under the mit license
mit_ref2=licensed under the mit license
mit_grant=permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit_notice=the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
as_is=the software is provided as is without warranty of any kind express or implied
gpl3_ref=this work is licensed under the gnu general public license version 3
gpl2_ref=this work is licensed under the gnu general public license version 2
gpl_free=this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl_or_later=either version 3 of the license or at your option any later version
cc_by_nc4_ref=licensed under cc by nc 4 0
cc_by4_ref=licensed under cc by 4 0
cc_by_sa4_ref=licensed under cc by sa 4 0
cc0_ref=dedicated to the public domain under cc0 1 0 universal license
bsd_redist=redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
mpl2_ref=this source code form is subject to the terms of the mozilla public license v 2 0
all_rights=all rights reserved
"""
_RULES = """
Apache-2.0=apache2_grant apache2_comply apache2_copy as_is_basis
Apache-2.0=apache2_grant apache2_comply
MIT=mit_grant mit_notice as_is
MIT=mit_grant mit_notice
GPL-3.0-or-later=gpl_free gpl_or_later
Apache-2.0=apache2_ref
Apache-2.0=apache2_grant
MIT=mit_ref
MIT=mit_ref2
MIT=mit_grant
GPL-3.0=gpl3_ref
GPL-2.0=gpl2_ref
CC-BY-NC-4.0=cc_by_nc4_ref
CC-BY-SA-4.0=cc_by_sa4_ref
CC-BY-4.0=cc_by4_ref
CC0-1.0=cc0_ref
MPL-2.0=mpl2_ref
Proprietary=all_rights
"""


def _op10() -> str:
    known = [line.split("=") for line in _SENTENCES.strip().split("\n")]
    rules = [line.split("=") for line in _RULES.strip().split("\n")]
    values = ", ".join(f"('{k}', '{s}')" for k, s in known)
    steps, left = [], "s0"
    for i, (_, ids) in enumerate(rules):
        run = "".join(f" {x} " for x in ids.split())
        steps.append(f"r{i} AS (SELECT *, replace({left}, '{run}', ' # ') AS s{i + 1} FROM {'seq' if i == 0 else f'r{i - 1}'})")
        left = f"s{i + 1}"
    count = [f"((length(s{i}) - length(s{i + 1})) // {sum(len(x) + 2 for x in ids.split()) - 3})" for i, (_, ids) in enumerate(rules)]
    names = sorted({n for n, _ in rules})
    hits = {n: " + ".join(c for c, (m, _) in zip(count, rules) if m == n) for n in names}
    listed = ", ".join(f"CASE WHEN {hits[n]} > 0 THEN '{n}' END" for n in names)
    return rf"""
WITH known(id, s) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT rid, unnest(string_split(regexp_replace(text, '[.!?;]+([ \t\n\r\f]|\z)', chr(10), 'g'), chr(10))) AS line,
               generate_subscripts(string_split(regexp_replace(text, '[.!?;]+([ \t\n\r\f]|\z)', chr(10), 'g'), chr(10)), 1) AS pos FROM d),
norm AS (SELECT rid, pos, trim(replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^a-z0-9]+', ' ', 'g'), 'licence', 'license')) AS s FROM raw),
coded AS (SELECT rid, pos, coalesce(known.id, '?') AS c FROM norm LEFT JOIN known USING (s)
          WHERE regexp_matches(s, 'license|copyright|warranty|permission|rights reserved|redistribut|public domain|under cc ')),
agg AS (SELECT rid, list(c ORDER BY pos) AS codes FROM coded GROUP BY rid),
seq AS (SELECT doc_id, coalesce(codes, []) AS codes,
               coalesce(array_to_string(list_transform(codes, lambda x: ' ' || x || ' '), ''), '') AS s0 FROM d LEFT JOIN agg USING (rid)),
{", ".join(steps)}
SELECT doc_id, coalesce(nullif(concat_ws(' AND ', {listed}), ''), 'NONE') AS licenses, ({" + ".join(count)})::INT AS n_findings,
       len(list_filter(string_split_regex({left}, ' +'), lambda x: x NOT IN ('', '?', '#')))::INT AS n_unmatched,
       len(list_filter(codes, lambda x: x = '?'))::INT AS n_unknown, coalesce(array_to_string(codes, ' '), '') AS sentence_ids
FROM r{len(rules) - 1}
"""


SQL: dict[str, str] = {"op3_mix_sources": OP3, "op7_warc_zstd": OP7, "op8_quality_rules": OP8, "op10_license_scan": _op10()}

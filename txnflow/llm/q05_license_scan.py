"""Query op5: licence phrases in ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.llm.license_scan import Template, scan_licenses
from txnflow.llm.registry import register
from txnflow.llm.tables import read

# Licence texts as their words.
MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files the software to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
    "software and to permit persons to whom the software is furnished to do so subject to the following "
    "conditions the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software the software is provided as is without warranty of any kind express "
    "or implied including but not limited to the warranties of merchantability fitness for a particular "
    "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim "
    "damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
    "connection with the software or the use or other dealings in the software")
ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is "
    "hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and the author disclaims all warranties with regard to this software "
    "including all implied warranties of merchantability and fitness in no event shall the author be liable "
    "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of "
    "use data or profits whether in an action of contract negligence or other tortious action arising out of "
    "or in connection with the use or performance of this software")
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met 1 redistributions of source code must retain the above copyright "
    "notice this list of conditions and the following disclaimer 2 redistributions in binary form must "
    "reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution this software is provided by the "
    "copyright holders and contributors as is and any express or implied warranties including but not limited "
    "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no "
    "event shall the copyright holder or contributors be liable for any direct indirect incidental special "
    "exemplary or consequential damages including but not limited to procurement of substitute goods or "
    "services loss of use data or profits or business interruption however caused and on any theory of "
    "liability whether in contract strict liability or tort including negligence or otherwise arising in any "
    "way out of the use of this software even if advised of the possibility of such damage")

TEMPLATES = [
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software"),
    Template("proprietary", "all rights reserved"),
    Template("mit", MIT, "permission is hereby granted free of charge"),
    Template("isc", ISC, "permission to use copy modify and or distribute this software"),
    Template("bsd-2", BSD, "redistributions in binary form must reproduce the above copyright notice"),
]

def _values() -> str:
    """The templates as SQL rows: number, label, words, first and end of the key, base."""
    return ",\n  ".join(f"({i}, '{t.label}', '{t.text}', {t.key_range[0]}, {t.key_range[1]}, {str(t.base).upper()})"
                        for i, t in enumerate(TEMPLATES, 1))


SQL = r"""
WITH ts(t, label, words, klo, khi, base) AS (VALUES
  @TEMPLATES@),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
tw AS (
  SELECT t, label, base, klo, khi, unnest(range(len(string_split(words, ' ')))) AS i, unnest(string_split(words, ' ')) AS w FROM ts),
dw AS (
  SELECT doc_id, p, w FROM (SELECT doc_id, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM d)
  WHERE w IN (SELECT w FROM tw)),
weight AS (
  SELECT v.w, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(DISTINCT doc_id) AS DOUBLE)) + 1 AS x
  FROM (SELECT DISTINCT w FROM tw) v LEFT JOIN dw ON v.w = dw.w GROUP BY v.w),
anchor AS (
  SELECT t, tw.w, i FROM tw JOIN weight ON tw.w = weight.w WHERE i >= klo AND i < khi
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY x DESC, i) = 1),
start AS (SELECT doc_id, t, p - i AS s FROM dw JOIN anchor ON dw.w = anchor.w),
found AS (
  SELECT start.doc_id, start.t, start.s, any_value(label) AS label, any_value(base) AS base, any_value(klo) AS klo,
    count(*) FILTER (WHERE i >= klo AND i < khi) = any_value(khi - klo) AS key,
    CASE WHEN count(*) = (SELECT count(*) FROM tw a WHERE a.t = start.t) THEN 1.0
         ELSE least(1.0, sum(x) / (SELECT sum(x) FROM tw a JOIN weight ON a.w = weight.w WHERE a.t = start.t)) END AS share
  FROM start JOIN tw ON start.t = tw.t JOIN dw ON dw.doc_id = start.doc_id AND dw.p = start.s + tw.i AND dw.w = tw.w
  JOIN weight ON tw.w = weight.w GROUP BY start.doc_id, start.t, start.s),
doc AS (
  SELECT doc_id, count(*) FILTER (WHERE key AND base) AS n_base, min(s + klo) FILTER (WHERE key AND base) AS first_word,
    max(s + klo) FILTER (WHERE key AND base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE key AND base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE key) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(CAST(coalesce(score, 0) AS DOUBLE), 9) AS score
FROM d LEFT JOIN doc USING (doc_id)
"""


@register("op5_license_scan", SQL.replace("@TEMPLATES@", _values()))
def op5(spark, sf_dir):
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (to nine digits)."""
    found = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"), TEMPLATES)
    return found.drop("text").withColumn("score", F.round("score", 9))

"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from pathlib import Path

from .ngramjoin import PERCENT, WORDS
from .vectordups import COSINE

_REACH = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT id, id FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)"""

NGRAM_JOIN = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {WORDS} THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' '))) END AS grams FROM worded),
held AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM held x JOIN held y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id FROM sets JOIN component ON doc_id = node"""

VECTOR_LINKS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= {COSINE}),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT vec_id, (SELECT count(*) FROM both_ways WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN component ON vec_id = node"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Written out apart from the operator's own lists, so that a slip in those shows.
_PAIRS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("non commercial", "noncommercial"), ("authorisation", "authorization"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owner"), ("per cent", "percent"), ("https", "http")]
_NOTICES = [
    ("Apache-2.0", "licensed under the apache license version 2 0"), ("MIT", "released under the mit license"), ("MIT", "licensed under the mit license"), ("GPL-3.0-only", "this work is licensed under the gnu general public license version 3"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"), ("CC-BY-4.0", "licensed under cc by 4 0"), ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"), ("BSD-3-Clause", "released under the bsd 3 clause license"),
    ("LicenseRef-All-Rights-Reserved", "all rights reserved"), ("LicenseRef-All-Rights-Reserved", "no license is granted"), ("LicenseRef-All-Rights-Reserved", "no part of this work may be reproduced without permission"),
]
_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright owner be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_SHORT = [("MIT", _MIT), ("0BSD", f"{_GRANT} {_AS_IS}"), ("ISC", f"{_GRANT} provided that the above copyright notice and this permission notice appear in all copies {_AS_IS}")]
_HEADS = {"MIT": ["mit license", "the mit license mit", "the mit license"], "ISC": ["isc license"], "0BSD": ["bsd zero clause license", "zero clause bsd"], "BSD-2-Clause": ["bsd 2 clause license"], "BSD-3-Clause": ["bsd 3 clause license"], "Zlib": ["zlib license", "the zlib libpng license"]}
_WTFPL = "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license terms and conditions for copying distribution and modification 0 you just do what the fuck you want to"
_CLAIM = r"(?m)^[^\p{L}\p{N}\n(©]*(?:copyright\s+(?:\(c\)|©|[0-9])|\(c\)\s*[0-9]|©)[^\n]*$"
_NAMES = r"(?m)^[^\p{L}\p{N}\n]*Copyright(?: by)?(?: \p{Lu}(?:\.|\p{Ll}[\p{L}.'-]*)){1,5}(?: <[^>\n]*>)?[^\p{L}\p{N}\n]*$"


def _canonical(text: str) -> str:
    """The canonical form of a text in its own case."""
    out = f"regexp_replace(lower(regexp_replace({text}, {_quoted(_NAMES)}, ' ', 'g')), {_quoted(_CLAIM)}, ' ', 'g')"
    out = f"(' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"
    for old, new in _PAIRS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"nullif(trim({out}), '')"


def licence_digests() -> str:
    files = [(f.stem.removesuffix("-UC"), f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    files += [(n, t.split("APPENDIX: How to apply")[0]) for n, t in files if n == "Apache-2.0"]
    whole = " UNION ALL ".join(f"SELECT {_quoted(a)} AS licence, {_canonical(_quoted(b))} AS form" for a, b in files)
    short = " UNION ALL ".join(f"SELECT {_quoted(a)} AS licence, {_quoted(b)} AS form" for a, b in [*_SHORT, *_NOTICES, ("WTFPL", _WTFPL)])
    heads = " UNION ALL ".join(f"SELECT {_quoted(a)} AS of_licence, {_quoted(h)} AS head" for a, hs in _HEADS.items() for h in hs)
    return f"""
WITH bare AS ({whole} UNION ALL {short}),
heads AS ({heads}),
headed AS (SELECT licence, form FROM bare UNION ALL SELECT licence, 'all rights reserved ' || form FROM bare WHERE licence IN (SELECT of_licence FROM heads) AND length(form) > 100),
listed AS (SELECT licence, form FROM headed UNION ALL SELECT licence, head || ' ' || form FROM headed JOIN heads ON licence = of_licence WHERE length(form) > 100),
known AS (SELECT sha256(form) AS known_digest, min(licence) AS licence FROM listed GROUP BY 1),
digests AS (SELECT doc_id, text, sha256({_canonical("text")}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
noted AS (SELECT doc_id, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS notices FROM (SELECT doc_id, sha256({_canonical("line")}) AS d FROM lines) l JOIN known k ON l.d = k.known_digest GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.licence, coalesce(n.notices, '') AS notices FROM digests d LEFT JOIN known k ON d.digest = k.known_digest LEFT JOIN noted n ON d.doc_id = n.doc_id"""

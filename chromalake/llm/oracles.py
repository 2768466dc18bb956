"""DuckDB SQL that restates queries of this subpackage."""

from chromalake.llm import url_filter as _u
from chromalake.llm.licenses import KNOWN, KNOWN_DIGESTS, SPELLINGS

ALL: dict[str, str] = {}


def _canonical(x: str) -> str:
    out = f"' ' || trim(lower(regexp_replace(regexp_replace({x}, '\\([cC]\\)', ' ', 'g'), '[^a-zA-Z0-9]+', ' ', 'g'))) || ' '"
    notice = f"regexp_matches({x}, '^[^a-zA-Z0-9(]*(\\([cC]\\)|\u00a9)')"
    out = f"CASE WHEN {out} = ' all rights reserved ' OR starts_with({out}, ' copyright ') OR starts_with({out}, ' copr ') OR {notice} THEN '  ' ELSE {out} END"
    for other, one in SPELLINGS:
        out = f"replace({out}, ' {other} ', ' {one} ')"
    return f"trim({out})"


def _lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {_canonical('l')}), lambda l: l <> '')"


_QUOTED = ", ".join("('{}', '{}')".format(k, v.replace("'", "''").replace("\n", "' || chr(10) || '")) for k, v in KNOWN)
_FIXED = ", ".join(f"('{k}', '{d}')" for k, d in KNOWN_DIGESTS)
ALL["op1_license_digests"] = f"""
WITH forms AS (SELECT sha256(array_to_string({_lines('body')}, ' ')) digest, license FROM (VALUES {_QUOTED}) t(license, body) UNION ALL SELECT digest, license FROM (VALUES {_FIXED}) f(license, digest)),
known AS (SELECT digest, min(license) license FROM forms GROUP BY 1),
docs AS (SELECT row_number() OVER () rid, doc_id, {_lines("coalesce(text, '')")} ls FROM documents),
found AS (SELECT rid, count(*) n, string_agg(DISTINCT license, ',' ORDER BY license) l FROM (SELECT rid, unnest(ls) line FROM docs) JOIN known ON digest = sha256(line) GROUP BY rid)
SELECT doc_id, CASE WHEN len(ls) > 0 THEN sha256(array_to_string(ls, ' ')) END text_digest, known.license text_license,
  coalesce(n, 0)::BIGINT n_license_lines, coalesce(l, '') line_licenses
FROM docs LEFT JOIN found USING (rid) LEFT JOIN known ON len(ls) > 0 AND known.digest = sha256(array_to_string(ls, ' '))
"""

_OP2_RULES = """
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END"""


def _levels(order: int) -> str:
    """Counts of runs from the longest to one character, then probabilities the other way round."""
    out = [f"l{order} AS (SELECT gram g, n, a, r FROM counts)"]
    out += [f"l{k} AS (SELECT substr(g, 2) g, sum(a) a, sum(r) r FROM l{k + 1} GROUP BY ALL)" for k in range(order - 1, -1, -1)]
    for k in range(order + 1):
        per = f"SELECT left(g, {k}) x, sum(a) an, sum(r) rn, count(*) FILTER (a > 0) atd, count(*) FILTER (r > 0) rtd FROM l{k} GROUP BY ALL"
        prev = f"p.ap ap, p.rp rp, p.yes yes FROM l{k} l JOIN p{k - 1} p ON p.g = substr(l.g, 2)" if k else f"1 / {_u.ALPHABET}::DOUBLE ap, 1 / {_u.ALPHABET}::DOUBLE rp, false yes FROM l{k} l"
        yes = "yes" if k else "an > 0 AND rn > 0"
        out.append(f"""p{k} AS (SELECT g, {'n, ' if k == order else ''}CASE WHEN an > 0 THEN (a + atd * ap) / (an + atd) ELSE ap END::DOUBLE ap,
  CASE WHEN rn > 0 THEN (r + rtd * rp) / (rn + rtd) ELSE rp END::DOUBLE rp, {yes} yes FROM (SELECT l.*, {prev}) l JOIN ({per}) c ON c.x = left(l.g, {k}))""")
    return ",\n".join(out)


ALL["op2_url_language_model"] = f"""
WITH parts AS (
  SELECT row_number() OVER () rid, page_id, coalesce(url, '') url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') path FROM pages),
ruled AS (SELECT *, {_OP2_RULES} AS rule, left(md5(url), 1) IN ({', '.join(f"'{x}'" for x in _u.APART)}) apart,
  repeat(chr(2), {_u.ORDER}) || url || chr(3) f FROM parts),
grams AS (SELECT rid, rule, apart, unnest(list_transform(range(1, length(url) + 2), lambda i: substr(f, i, {_u.ORDER + 1}))) gram FROM ruled),
counts AS (SELECT gram, count(*) n, count(*) FILTER (NOT apart AND rule IN ('example.net/en/', 'org/fr/')) a, count(*) FILTER (NOT apart AND rule IN ('net/', 'example.com/de/')) r FROM grams GROUP BY ALL),
{_levels(_u.ORDER)},
model AS (SELECT g AS gram, CASE WHEN yes THEN round((ln(ap) - ln(rp)) * 1000000)::BIGINT ELSE 0 END d FROM p{_u.ORDER}),
scored AS (SELECT rid, floor(sum(d)::DOUBLE / count(*))::BIGINT score FROM grams JOIN model USING (gram) GROUP BY rid),
judged AS (SELECT page_id, host, path, rule, apart, score, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END v,
  least(2000, greatest(-2000, floor(score / 10000)))::INT bin FROM ruled JOIN scored USING (rid)),
hist AS (SELECT bin, count(*) FILTER (v = 'allow') a, count(*) FILTER (v = 'block') r FROM judged WHERE v IS NOT NULL AND apart GROUP BY bin),
cum AS (SELECT bin, coalesce(lead(bin) OVER (ORDER BY bin DESC), bin - 1) below, sum(a) OVER (ORDER BY bin DESC) ta, sum(r) OVER (ORDER BY bin DESC) tr, sum(a) OVER () na, sum(r) OVER () nr FROM hist),
cut AS (SELECT coalesce((SELECT (bin + below + 1) * 5000 FROM cum WHERE na > 0 AND nr > 0 ORDER BY ta * nr - tr * na DESC, bin LIMIT 1), 0)::BIGINT threshold)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) verdict, score, threshold FROM judged, cut
"""

ALL["op5_warc_source"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT payload_bytes, sha256(coalesce(html, '')) payload_digest FROM pages),
heads AS (SELECT payload_digest, min(page_id) head FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN head END refers_to
FROM p LEFT JOIN heads USING (payload_digest)
"""

from chromalake.llm import quality_rules as _q  # noqa: E402

_LOW = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOLDS = lambda some: " OR ".join(f"contains({_LOW}, '{p}')" for p in some)
ALL["op4_line_first_rules"] = f"""
WITH docs AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) ln FROM docs),
lines AS (SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') ws FROM split),
live AS (SELECT rid, ln, line, ws, len(ws) nw, list_sum(list_transform(ws, lambda w: length(w))) chars,
    list_sum(list_transform(ws, lambda w: (regexp_matches(w, '(!!|\\?\\?)$'))::INT)) doubled,
    list_sum(list_transform(ws, lambda w: (regexp_full_match(w, '[|/~>-]+') OR w IN ('•', '·', '»', '›', '«', '‹'))::INT)) seps,
    list_sum(list_transform(ws, lambda w: (regexp_matches(w, '[#*$%&|<>]'))::INT)) syms FROM lines WHERE len(ws) > 0),
judged AS (SELECT *, (NOT regexp_matches(ws[-1], '([.!?:;,"'')\\]}}]|[^\\x00-\\x7F])$') AND nw < {_q.SHORT}) OR 100 * doubled >= {_q.DOUBLED} * nw
    OR 100 * seps >= {_q.SEPARATORS} * nw OR 100 * syms > {_q.SYMBOLS} * nw OR (nw <= {_q.LONG} AND ({_HOLDS(_q.PHRASES)})) OR (nw <= {_q.BRIEF} AND ({_HOLDS(_q.MARKS)})) AS failed FROM live),
per AS (SELECT rid, sum(nw)::BIGINT n_words, sum(chars)::BIGINT word_chars, sum(chars) FILTER (failed) lost, (count(*) - count(DISTINCT line))::BIGINT n_dup_lines FROM judged GROUP BY rid),
words AS (SELECT rid, w, row_number() OVER (PARTITION BY rid ORDER BY ln, k) pos FROM (SELECT rid, ln, unnest(ws) w, generate_subscripts(ws, 1) k FROM live)),
grams AS (SELECT rid, pos, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM words WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos FROM grams WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repeat AS (SELECT rid, count(DISTINCT p)::BIGINT n FROM (SELECT rid, unnest([pos, pos + 1, pos + 2, pos + 3, pos + 4]) p FROM twice) GROUP BY rid),
facts AS (SELECT doc_id, coalesce(n_words, 0) n_words, coalesce(word_chars, 0) word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n, 0) n_repeat_words, coalesce(lost, 0) lost
  FROM docs LEFT JOIN per USING (rid) LEFT JOIN repeat USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {_q.MIN_WORDS} OR 100 * n_repeat_words > {_q.MAX_REPEAT} * n_words) AS base_failed,
  NOT (n_words < {_q.MIN_WORDS} OR 100 * n_repeat_words > {_q.MAX_REPEAT} * n_words) AND 100 * lost <= {_q.MAX_LOST} * word_chars AS kept FROM facts
"""

# Brute force over all pairs: the searched queries miss a link with a documented small chance.
_COMPONENTS = """
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id AS node, id AS root FROM ids UNION SELECT b, root FROM reach JOIN pairs ON node = a),
comps AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1)"""

ALL["op10_minhash_large_small_star"] = f"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) g FROM ws),
n AS (SELECT doc_id, count(*)::BIGINT n FROM sh GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id a, y.doc_id b, count(*) i FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
ids AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT doc_id, coalesce(n, 0)::BIGINT n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN comps ON node = doc_id
"""

ALL["op6_pivot_permutation"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT p.vec_id a, q.vec_id b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
ids AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id)::BIGINT n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comps ON node = vec_id
"""

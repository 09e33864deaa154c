"""SQL twins of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from fadeline.llm import license_scan as L
from fadeline.llm import quality_rules as Q

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_AZ)} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS sh FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.comp) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id"""

_HARD = "chr(92) || '### Assistant: </turn> ok'"
_MARKS = "(length({0}) - length(replace({0}, chr(92), ''))) + (length({0}) - length(replace({0}, '#', ''))) + (length({0}) - length(replace({0}, '</', ''))) // 2"

CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {_HARD} UNION ALL SELECT -7, 1, 'assistant', {_HARD})
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(14 + length(role) + length(text) + {_MARKS.format('role')} + (length(role) - length(replace(role, ':', ''))) + {_MARKS.format('text')}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

_CLASS = ", ".join(f"(length(t) - length(regexp_replace(t, '{Q.CLASSES[k]}', '', 'g'))) / greatest(length(t), 1)::DOUBLE" for k in Q.CLASSES if k != "space")
_COMMON = " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in Q.COMMON.items())


def _means(name: str, n: int) -> str:
    return "[" + ", ".join(f"avg({name}[{i}])" for i in range(1, n + 1)) + "]"


def _jsd(p: str, q: str) -> str:
    part = "(CASE WHEN {0} > 0 THEN {0} * log2({0} / ((z[1] + z[2]) / 2)) ELSE 0 END)"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: ({part.format('z[1]')} + {part.format('z[2]')}) / 2)), 0))"


_NC, _NW = len(Q.CLASSES) + 1, 23
_REF = "SELECT grp, {} AS rc, {} AS rw FROM {} WHERE {} GROUP BY grp"
_HELD = f"""SELECT f.*, CASE WHEN n_words >= {Q.LEAST_WORDS} THEN {_jsd('cs', 'rc')} END AS cd, CASE WHEN n_words >= {Q.LEAST_COMMON} AND f.grp <> 'other' THEN {_jsd('ws', 'rw')} END AS wd FROM f LEFT JOIN {{0}} r ON r.grp = f.grp"""

RULES = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ('en', 'fr', 'de', 'es') THEN lang ELSE 'other' END AS grp FROM documents),
w AS (SELECT *, {_WORDS.format('t')} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8) x),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS c FROM win) x WHERE c > 1),
cov AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM rep, range(8) k(k) GROUP BY doc_id),
b AS (SELECT w.doc_id, grp, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
[(length(t) - length(array_to_string(w, ''))) / greatest(length(t), 1)::DOUBLE, {_CLASS}] AS c0, list_transform(CASE grp {_COMMON} ELSE {_list([''] * 22)} END, lambda c: len(list_filter(w, lambda x: x = c)) / greatest(len(w), 1)::DOUBLE) AS w0 FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
f AS (SELECT * EXCLUDE (c0, w0), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, list_append(c0, 1 - list_sum(c0)) AS cs, list_append(w0, 1 - list_sum(w0)) AS ws FROM b),
r1 AS ({_REF.format(_means('cs', _NC), _means('ws', _NW), 'f', 'NOT base_failed')}),
h1 AS ({_HELD.format('r1')}),
r2 AS ({_REF.format(_means('cs', _NC), _means('ws', _NW), 'h1', f'NOT base_failed AND cd <= {Q.TRIM}')}),
h2 AS ({_HELD.format('r2')})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
NOT base_failed AND coalesce(cd, 0) <= {Q.MOST_CHARS} AND coalesce(wd, 0) <= {Q.MOST_WORDS} AS kept FROM h2"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
r(node, comp) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node), k AS (SELECT a, COUNT(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, comp AS component_id, vec_id = comp AS kept FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN k ON k.a = vec_id"""


def _licenses() -> str:
    vocabulary = sorted({t for _, x in L.TEMPLATES for t in L._terms(x)})
    words = _list(vocabulary)
    notices = ", ".join(f"({k}, '{name}', {_list(L._terms(x))})" for k, (name, x) in enumerate(L.TEMPLATES))
    telling = "|".join(t.replace(".", "[.]") for t in L._telling())
    return rf"""WITH d AS (SELECT doc_id, concat_ws('/', source, lang, doc_id::VARCHAR || '.txt') AS path, text FROM documents),
kinds AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '[^a-z0-9.]+'), lambda x: CASE WHEN list_contains({words}, x) THEN x WHEN x LIKE '%.' AND list_contains({words}, x[1:-2]) THEN rtrim(x, '.') END), lambda x: x IS NOT NULL)) AS k FROM d),
df AS (SELECT t, COUNT(*) AS c FROM (SELECT unnest(k) AS t FROM kinds) x GROUP BY t), total AS (SELECT COUNT(*) AS n FROM d),
idf AS (SELECT v.t, ln((1 + n) / (1 + coalesce(c, 0))::DOUBLE) + 1 AS w FROM (SELECT unnest({words}) AS t) v CROSS JOIN total LEFT JOIN df ON df.t = v.t),
seg AS (SELECT doc_id, i, unnest(string_split(regexp_replace(text, '([.;!?])\s+', '' || chr(10), 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.;!?])\s+', '' || chr(10), 'g'), chr(10)), 1) AS j FROM (SELECT doc_id, text, 0 AS i FROM d) x),
hit AS (SELECT doc_id, j, regexp_extract_all(lower(s), '[0-9]+(?:\.[0-9]+)+|[a-z0-9]+') AS terms FROM seg WHERE regexp_matches(s, '(?i)(^|[^a-z0-9])({telling})([^a-z0-9]|$)')),
tf AS (SELECT doc_id, j, t, COUNT(*) AS f FROM (SELECT doc_id, j, unnest(terms) AS t FROM hit) x GROUP BY doc_id, j, t),
wt AS (SELECT doc_id, j, tf.t, f * coalesce(w, ln(1 + n) + 1) AS w FROM tf CROSS JOIN total LEFT JOIN idf ON idf.t = tf.t),
nrm AS (SELECT doc_id, j, sqrt(sum(w * w)) AS n FROM wt GROUP BY doc_id, j),
tpl AS (SELECT * FROM (VALUES {notices}) v(r, name, terms)), tw AS (SELECT r, x.t, COUNT(*) * any_value(w) AS w FROM (SELECT r, unnest(terms) AS t FROM tpl) x JOIN idf ON idf.t = x.t GROUP BY r, x.t), tn AS (SELECT r, sqrt(sum(w * w)) AS n FROM tw GROUP BY r),
cos AS (SELECT wt.doc_id, wt.j, tw.r, sum(wt.w * tw.w) / (any_value(nrm.n) * any_value(tn.n)) AS c FROM wt JOIN tw ON tw.t = wt.t JOIN nrm ON nrm.doc_id = wt.doc_id AND nrm.j = wt.j JOIN tn ON tn.r = tw.r GROUP BY wt.doc_id, wt.j, tw.r),
best AS (SELECT doc_id, j, c, r, len(terms) AS size FROM (SELECT cos.*, hit.terms, row_number() OVER (PARTITION BY cos.doc_id, cos.j ORDER BY c DESC, r) AS k FROM cos JOIN hit ON hit.doc_id = cos.doc_id AND hit.j = cos.j) x WHERE k = 1 AND c >= {L.THRESHOLD}),
own AS (SELECT doc_id, name AS license, c AS similarity, covered, segments FROM (SELECT best.*, sum(size) OVER (PARTITION BY doc_id) AS covered, COUNT(*) OVER (PARTITION BY doc_id) AS segments, row_number() OVER (PARTITION BY doc_id ORDER BY round(c, 9) DESC, size DESC, r) AS k FROM best) x JOIN tpl ON tpl.r = x.r WHERE k = 1),
a AS (SELECT d.doc_id, path, license, similarity, segments, covered / greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), 1)::DOUBLE AS share, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM d LEFT JOIN own ON own.doc_id = d.doc_id),
spoken AS (SELECT folder, license AS theirs FROM (SELECT folder, license, row_number() OVER (PARTITION BY folder ORDER BY round(similarity, 9) DESC, license) AS k FROM a WHERE license IS NOT NULL AND share >= {L.SPEAKS}) x WHERE k = 1),
near AS (SELECT doc_id, any_value(s.theirs ORDER BY length(s.folder) DESC) AS theirs, any_value(s.folder ORDER BY length(s.folder) DESC) AS origin FROM a JOIN spoken s ON s.folder = a.folder OR s.folder = '' OR starts_with(a.folder, s.folder || '/') WHERE license IS NULL GROUP BY doc_id)
SELECT a.doc_id, coalesce(license, theirs) AS license, round(similarity, 6) AS similarity, coalesce(segments, 0) AS n_segments, origin AS inherited_from FROM a LEFT JOIN near ON near.doc_id = a.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": JACCARD, "op5_chat_format": CHAT, "op7_quality_rules": RULES, "op8_embedding_dedup": EMBEDDINGS, "op9_license_scan": _licenses()}

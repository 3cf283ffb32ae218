"""The corpus queries in DuckDB's SQL, those that SQL can express; the others are tested against brute force."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, sym.b FROM reach JOIN sym ON sym.a = reach.r)
SELECT s.doc_id, len(any_value(s)) AS n_shingles, min(r) AS component_id, min(r) = s.doc_id AS kept FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id"""

_COMMON = {
    "en": "the of and to in a that was for on", "de": "der die und das nicht von zu mit ist den", "fr": "de la le les et des que une en un", "es": "de la que el en los del las por con",
}


def _divergence() -> str:
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"
    lists = " ".join(f"WHEN lang = '{k}' THEN {listed(v)}" for k, v in _COMMON.items())
    classes = [("[^a-z]", "c0"), ("[^A-Z]", "c1"), ("[^0-9]", "c2"), (r"[^\x20\x09-\x0D]", "c3"), (r"[^#*$%&|<>]", "c4"), (r"""[^.,;:!?''"()\-]""", "c5")]
    counted = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g')) AS {c}" for p, c in classes)
    own_words = ", ".join(f"len(list_filter(lw, lambda x: x = listed[{i + 1}])) AS w{i}" for i in range(10))

    def distance(names: list[str]) -> str:
        p = lambda c: f"CASE WHEN {' + '.join(f'o.{n}' for n in names)} > 0 THEN o.{c} / ({' + '.join(f'o.{n}' for n in names)}) ELSE 0.0::DOUBLE END"
        q = lambda c: f"CASE WHEN {' + '.join(f'l.{n}' for n in names)} > 0 THEN l.{c} / ({' + '.join(f'l.{n}' for n in names)}) ELSE 0.0::DOUBLE END"
        pairs = "[" + ", ".join(f"[{p(c)}, {q(c)}]" for c in names) + "]"
        half = lambda k: f"CASE WHEN z[{k}] > 0 THEN z[{k}] * log2(z[{k}] / ((z[1] + z[2]) / 2)) ELSE 0.0::DOUBLE END"
        return f"sqrt(greatest(0.0::DOUBLE, list_sum(list_transform({pairs}, lambda z: {half(1)} + {half(2)})) / 2))"

    cs, ws = [f"c{i}" for i in range(7)], [f"w{i}" for i in range(11)]
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS language, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w, CASE {lists} ELSE {listed(_COMMON["en"])} END AS listed FROM documents),
m AS (SELECT *, list_transform(w, lambda x: lower(x)) AS lw, {counted} FROM d),
o AS (SELECT doc_id, language, len(w)::BIGINT AS n_words, length(array_to_string(w, '')) AS word_chars, c0, c1, c2, c3, c4, c5, length(t) - c0 - c1 - c2 - c3 - c4 - c5 AS c6, length(t) AS n_chars, {own_words},
 len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines FROM m),
o2 AS (SELECT *, n_words - w0 - w1 - w2 - w3 - w4 - w5 - w6 - w7 - w8 - w9 AS w10 FROM o),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
l AS (SELECT language, {", ".join(f"sum({c}) AS {c}" for c in cs + ws)} FROM o2 GROUP BY 1),
j AS (SELECT o.*, coalesce(rep.n, 0) AS n_repeat_words, {distance(cs)} AS cd, {distance(ws)} AS wd FROM o2 o JOIN l USING (language) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, c4 AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT (n_chars >= 200 AND cd > 0.19 + sqrt(6 / (8 * ln(2)) / greatest(n_chars, 1))) AND NOT (n_words >= 50 AND wd > 0.19 + sqrt(10 / (8 * ln(2)) / greatest(n_words, 1))) AS kept FROM f"""


_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, h[2 * i + 1:2 * i + 200] AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM s) WHERE nth > 1),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100)::INT AS new FROM c)),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM r GROUP BY 1, 2),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM u),
x AS (SELECT doc_id, string_agg(h[2 * p + 1:2 * a], '' ORDER BY a) AS front, max(b) AS e, sum(b - a)::BIGINT AS gone, count(*) AS spans FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || h[2 * coalesce(e, 0) + 1:])) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)"""

_LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {_LOW.format(f"trim(line, {_BLANK})")} AS key FROM l),
often AS (SELECT key FROM (SELECT DISTINCT doc_id, key FROM k WHERE key <> '') GROUP BY key HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN often USING (key) GROUP BY doc_id"""

_MIXING = f"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
f AS (SELECT *, first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS common FROM v),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, common * weight), cap::DOUBLE) AS target FROM f),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
h AS (SELECT doc_id, source, size, md5('23:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest) AS h FROM d),
k AS (SELECT *, floor(('0x' || substr(h, 1, 8))::BIGINT * (SELECT 1 + count(*) // 32 FROM documents) / 4294967296::DOUBLE)::BIGINT AS block FROM h),
b AS (SELECT source, block, sum(size)::BIGINT AS words FROM k GROUP BY 1, 2),
y AS (SELECT b.*, quota, r, coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY r, md5('23:' || r || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b JOIN q ON q.source IS NOT DISTINCT FROM b.source, range(3) AS t(r)),
z AS (SELECT source, block, list(greatest(0, least(words, quota - start)) ORDER BY r) AS drawn FROM y GROUP BY 1, 2),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, block ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_word FROM k)
SELECT p.doc_id, p.size, q.source_size, q.target, list_sum(list_transform(z.drawn, lambda w: greatest(0, least(p.size, w - p.first_word))))::BIGINT AS taken
FROM p JOIN z ON z.block = p.block AND z.source IS NOT DISTINCT FROM p.source JOIN q ON q.source IS NOT DISTINCT FROM p.source"""

_GRID = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
 WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""

_AUDIT = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d),
g AS (SELECT part, mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, count(*) AS n FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM p, range(1, 6) AS t(i)),
r AS (SELECT part, filter_order, step::INT AS step, bit, coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
 coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0 AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0 AND toxic), 0)::BIGINT AS toxic_lost FROM g, s GROUP BY ALL)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r"""

_DRAWN = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS x FROM benchmark),
o AS (SELECT doc_id, unnest(w) AS x FROM d),
bits AS (SELECT n AS i, n AS c, 0 AS k FROM range(256) AS t(n) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS table_ FROM bits WHERE k = 8),
h AS (SELECT x, hex(encode(x)) AS h, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT x FROM o UNION SELECT x FROM b)
 UNION ALL SELECT x, h, i + 1, xor(c >> 8, table_[xor(c & 255, ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT) + 1]) FROM h, crc WHERE 2 * i < length(h)),
v AS (SELECT x, xor(c, 4294967295) % 10000 AS bucket FROM h WHERE 2 * i = length(h)),
s AS (SELECT bucket, count(*) AS s FROM o JOIN v USING (x) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (x) GROUP BY 1),
z AS (SELECT (SELECT count(*) FROM o)::DOUBLE + 10000 AS s, (SELECT count(*) FROM b)::DOUBLE + 10000 AS t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.t, 0)::DOUBLE + 1) * z.s / ((s.s::DOUBLE + 1) * z.t)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), z),
m AS (SELECT doc_id, sum(gain)::BIGINT AS gain, count(*) AS n FROM o JOIN v USING (x) JOIN g USING (bucket) GROUP BY 1),
k AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce((gain - ((gain % n) + n) % n) // n, 0)::BIGINT AS weight FROM d LEFT JOIN m USING (doc_id)),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM k),
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM q WHERE n_features >= 20)
SELECT q.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM q LEFT JOIN e USING (doc_id)"""

ORACLES = {
    "op2_minhash": _MINHASH, "op3_repeats": _REPEATS, "op4_divergence": _divergence(), "op8_line_dedup": _LINES, "op10_mixing": _MIXING,
    "op11_grid_join": _GRID, "op12_filter_audit": _AUDIT, "op13_resampling": _DRAWN,
}

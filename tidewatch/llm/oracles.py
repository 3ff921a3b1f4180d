"""SQL counterparts of the corpus queries, for DuckDB over the same tables."""

WARC = r"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to, count(*) OVER (PARTITION BY page_id, payload_digest) AS n_requests,
       count(*) OVER (PARTITION BY page_id, payload_digest) AS n_metadata
FROM d LEFT JOIN f USING (payload_digest)
"""

MIX = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS n FROM s),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS weight, source_size * 2::DOUBLE AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
z AS (SELECT level AS chosen FROM l WHERE level <= cap / weight ORDER BY cap / weight, n LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT chosen FROM z) IS NULL THEN cap ELSE least(cap, (SELECT chosen FROM z) * weight) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS rest FROM p),
e AS (SELECT d.source, size, count(*) AS n, any_value(rest) AS rest FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE size > 0 AND rest > 0 GROUP BY 1, 2),
m AS (SELECT *, size * (sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING))::DOUBLE
        + coalesce(sum(n * size * size) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE <= rest * size AS certain FROM e),
b AS (SELECT source, min(size) FILTER (certain) AS least_sure, greatest(any_value(rest) - coalesce(sum(n * size) FILTER (certain), 0)::DOUBLE, 0) AS room,
        (sum(n * size * size) FILTER (NOT certain))::DOUBLE AS squares FROM m GROUP BY source),
u AS (SELECT d.*, source_size, target, whole, rest, room,
        CASE WHEN size = 0 OR b.room IS NULL THEN 0 WHEN size >= least_sure THEN 1 ELSE least(room / squares * size, 1 - 1e-9::DOUBLE) END AS p,
        (('0x' || substr(md5('17:' || doc_id), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
k AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS rnk FROM u),
c AS (SELECT *, CASE WHEN rnk IS NULL THEN p >= 1 ELSE
        sum(size) OVER (PARTITION BY source, rnk IS NULL ORDER BY rnk, doc_id ROWS UNBOUNDED PRECEDING) <= room END AS fits FROM k),
g AS (SELECT source, any_value(target) AS target, any_value(rest) - coalesce(sum(size) FILTER (fits), 0) AS gap FROM c WHERE rest > 0 GROUP BY source),
-- The row that closes a gap, and how far the source then is from its target.
o AS (SELECT c.source, c.doc_id, gap, abs(gap - size) AS off FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE NOT fits AND rnk IS NOT NULL AND abs(gap - size) < gap
      QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY abs(gap - size), rnk, c.doc_id) = 1),
n AS (SELECT g.source, g.gap, o.doc_id AS closing, coalesce(o.off, g.gap) AS off, coalesce(o.off, g.gap) > 0.05::DOUBLE * g.target AS missed FROM g LEFT JOIN o ON g.source IS NOT DISTINCT FROM o.source),
-- Where that is far off: all documents behind it, one after the other by rank.
later AS (SELECT c.source, c.doc_id, size, rnk, gap, row_number() OVER (PARTITION BY c.source ORDER BY rnk, c.doc_id) AS pos
      FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE missed AND NOT fits AND rnk IS NOT NULL),
walk AS (SELECT source, doc_id, pos, size <= gap AS took, CASE WHEN size <= gap THEN gap - size ELSE gap END AS open FROM later WHERE pos = 1
      UNION ALL SELECT l.source, l.doc_id, l.pos, size <= open, CASE WHEN size <= open THEN open - size ELSE open END
      FROM walk JOIN later l ON l.source IS NOT DISTINCT FROM walk.source AND l.pos = walk.pos + 1),
ended AS (SELECT source, arg_max(open, pos) AS open FROM walk GROUP BY source),
second AS (SELECT l.source, l.doc_id, abs(ended.open - l.size) AS off FROM later l JOIN walk USING (doc_id) JOIN ended ON l.source IS NOT DISTINCT FROM ended.source
      WHERE NOT took AND abs(ended.open - l.size) < ended.open QUALIFY row_number() OVER (PARTITION BY l.source ORDER BY abs(ended.open - l.size), rnk, l.doc_id) = 1),
better AS (SELECT n.source, second.doc_id AS closing FROM n JOIN ended ON n.source IS NOT DISTINCT FROM ended.source LEFT JOIN second ON n.source IS NOT DISTINCT FROM second.source
      WHERE coalesce(second.off, ended.open) < n.off),
added AS (SELECT closing AS doc_id FROM n WHERE NOT EXISTS (SELECT 1 FROM better WHERE better.source IS NOT DISTINCT FROM n.source)
      UNION ALL SELECT closing FROM better
      UNION ALL SELECT doc_id FROM walk WHERE took AND EXISTS (SELECT 1 FROM better WHERE better.source IS NOT DISTINCT FROM walk.source))
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN fits OR doc_id IN (SELECT a.doc_id FROM added a WHERE a.doc_id IS NOT NULL) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""

TOPK = r"""
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s,
             count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c, i, count(*) OVER (PARTITION BY doc_id) AS n FROM t),
sh AS (SELECT DISTINCT doc_id, s FROM g WHERE c = 3 OR (i = 1 AND n < 3)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
twoway AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, twoway.y FROM reach JOIN twoway ON twoway.x = reach.y),
parts AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN parts USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

REPEATS = r"""
WITH n AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM n),
h AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s,
             count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS c FROM t),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM h WHERE c = 20),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM o WHERE k > 1),
k AS (SELECT t.doc_id, count(g.i) AS n_removed, string_agg(t.word, ' ' ORDER BY t.i) FILTER (g.i IS NULL) AS kept
      FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY 1)
SELECT n.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM n LEFT JOIN k ON k.doc_id = n.doc_id
"""

LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS words FROM benchmark),
dt AS (SELECT doc_id, len(words) AS n_doc, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
bt AS (SELECT item_id, len(words) AS n_tokens, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM b),
e AS (SELECT doc_id, item_id, n_tokens, n_doc, i - j AS doc_start, j FROM dt JOIN bt USING (word)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, doc_start ORDER BY j RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS near,
                count(*) OVER (PARTITION BY doc_id, item_id, doc_start) AS n_equal FROM e)
SELECT doc_id, item_id, doc_start::INTEGER AS doc_start, any_value(n_tokens)::INTEGER AS n_tokens, any_value(n_equal)::INTEGER AS n_equal
FROM c GROUP BY doc_id, item_id, doc_start
HAVING CASE WHEN any_value(n_tokens) >= 12 THEN max(near) >= 10 WHEN any_value(n_tokens) >= 6 THEN any_value(n_equal) >= any_value(n_tokens) - 1
            WHEN any_value(n_tokens) >= 3 THEN any_value(n_equal) = any_value(n_tokens) ELSE any_value(n_equal) = any_value(n_tokens) AND any_value(n_doc) = any_value(n_tokens) END
"""

COPIES = r"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

PHRASES = r"""
WITH RECURSIVE pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, row_number() OVER () AS k, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
t AS (SELECT lang, k, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM split),
g AS (SELECT lang, w1, lead(w1) OVER (PARTITION BY k ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY k ORDER BY i) AS w3 FROM t),
f1 AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, count(*) AS n FROM t GROUP BY 1),
c3 AS (SELECT e.lang, e.w1, e.w2, e.w3, e.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2 FROM f3 e
       JOIN f1 x ON x.lang = e.lang AND x.w1 = e.w1 JOIN f2 yz ON yz.lang = e.lang AND yz.w1 = e.w2 AND yz.w2 = e.w3
       JOIN f2 xy ON xy.lang = e.lang AND xy.w1 = e.w1 AND xy.w2 = e.w2 JOIN f1 z ON z.lang = e.lang AND z.w1 = e.w3),
s3 AS (SELECT *, 1000000 * a * a // (l1 * r1) AS early, 1000000 * a * a // (l2 * r2) AS late FROM c3),
beside AS (SELECT lang, w1, w2, max(f) AS longest FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
c2 AS (SELECT e.lang, e.w1, e.w2, e.f AS a, x.f AS l, y.f AS r FROM f2 e LEFT JOIN beside b ON b.lang = e.lang AND b.w1 = e.w1 AND b.w2 = e.w2
       JOIN f1 x ON x.lang = e.lang AND x.w1 = e.w1 JOIN f1 y ON y.lang = e.lang AND y.w1 = e.w2
       WHERE e.f >= 10 AND (longest IS NULL OR 100 * longest < 50 * e.f)),
links AS (SELECT lang, w1, w2, w3 FROM (SELECT *, count(*) OVER (PARTITION BY lang, w1, w2) AS leaving, count(*) OVER (PARTITION BY lang, w2, w3) AS entering FROM f3)
          WHERE leaving = 1 AND entering = 1 AND NOT (w1 = w2 AND w2 = w3)),
walk AS (SELECT lang, w1 AS h1, w2 AS h2, w1, w2, 1 AS nodes FROM links WHERE (lang, w1, w2) NOT IN (SELECT (lang, w2, w3) FROM links)
         UNION ALL SELECT walk.lang, h1, h2, links.w2, w3, nodes + 1 FROM walk JOIN links ON links.lang = walk.lang AND links.w1 = walk.w1 AND links.w2 = walk.w2),
paths AS (SELECT lang, w1, w2, nodes AS place, max(nodes) OVER (PARTITION BY lang, h1, h2) + 1 AS long FROM walk),
found AS (SELECT s.lang, s.w1 || ' ' || s.w2 || ' ' || s.w3 AS phrase, a, CASE WHEN early <= late THEN l1 ELSE l2 END AS l, CASE WHEN early <= late THEN r1 ELSE r2 END AS r, least(early, late) AS score,
                 coalesce(p.long, 3) AS path_words FROM s3 s LEFT JOIN paths p ON p.lang = s.lang AND p.w1 = s.w2 AND p.w2 = s.w3 AND p.place > 1
          UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2, a, l, r, 1000000 * a * a // (l * r), coalesce(p.long, 2) FROM c2 c LEFT JOIN paths p ON p.lang = c.lang AND p.w1 = c.w1 AND p.w2 = c.w2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM found)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, path_words::BIGINT AS path_words FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

VARIANTS = r"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
own AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM runs GROUP BY 1, 2),
named AS (SELECT *, row_number() OVER () AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM own WHERE length(run) >= 7),
crc AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
steps AS (SELECT k, hx, 0 AS spot, 4294967295 AS c FROM named
          UNION ALL SELECT k, hx, spot + 1, xor(c >> 8, v) FROM steps JOIN crc ON i = xor(c & 255, ('0x' || substr(hx, 2 * spot + 1, 2))::BIGINT) WHERE spot < length(hx) // 2),
digests AS (SELECT k, xor(c, 4294967295) AS h FROM steps WHERE spot = length(hx) // 2),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM named JOIN digests USING (k)),
words AS (SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
less AS (SELECT word, unnest(range(length(word))) AS spot FROM words),
cut AS (SELECT word, spot, left(word, spot) || substr(word, spot + 2) AS rest FROM less),
pairs AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.spot = b.spot AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
          UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest),
best AS (SELECT p.word, p.other, o.n AS form_n, count(*) OVER (PARTITION BY p.word) AS n_near,
                row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, encode(p.other)) AS pos FROM pairs p JOIN words o ON o.word = p.other),
formed AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * n THEN other END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
           FROM words w LEFT JOIN best b ON b.word = w.word AND pos = 1),
walk AS (SELECT word, word AS here, form AS next FROM formed UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON f.word = walk.next)
SELECT word, form, here AS root, n, n_near, form_n FROM formed JOIN walk USING (word) WHERE next IS NULL
"""

ORACLES = {
    "op3_warc_transactions": WARC,
    "op5_maxscore_topk": TOPK,
    "op6_pareto_mix": MIX,
    "op8_circulant_minhash": NEAR,
    "op9_automaton_repeats": REPEATS,
    "op10_seeded_overlaps": LEAKS,
    "op11_block_naming": COPIES,
    "op12_bruijn_collocations": PHRASES,
    "op13_permuterm_variants": VARIANTS,
}

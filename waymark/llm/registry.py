"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import chunks, exact, jaccard, language, licenses, merkle, packing, pii, quality, repeats, spelling, topk, urls

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_TEMPLATES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in licenses.TEMPLATES.items())
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(f"""WITH t(license, body) AS (VALUES {_TEMPLATES}),
l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, k, lines[k] AS line FROM l, unnest(range(1, len(lines) + 1)) AS r(k)),
w AS (SELECT *, NOT regexp_matches(translate(line, {_ASCII}), '[a-z0-9]') AS blank FROM e),
g AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM w),
p AS (SELECT doc_id, p, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS line FROM g WHERE NOT blank GROUP BY 1, 2),
u AS (SELECT doc_id, 'line' || k AS unit, line FROM e UNION ALL SELECT doc_id, 'par' || p, line FROM p WHERE n > 1
  UNION ALL SELECT doc_id, 'text', text FROM l WHERE doc_id IN (SELECT doc_id FROM p GROUP BY 1 HAVING count(*) > 1)),
a AS (SELECT 'u' AS kind, doc_id, unit, regexp_extract_all(translate(line, {_ASCII}), '[a-z0-9]+') AS ws FROM u
  UNION ALL SELECT 't', NULL, license, regexp_extract_all(translate(body, {_ASCII}), '[a-z0-9]+') FROM t),
b AS (SELECT DISTINCT kind, doc_id, unit, ws[i] || ' ' || ws[i + 1] AS bg FROM a, unnest(range(1, len(ws))) AS r(i)),
n AS (SELECT kind, doc_id, unit, count(*) AS n FROM b GROUP BY 1, 2, 3),
s AS (SELECT x.doc_id, x.unit, y.unit AS license, count(*) AS shared FROM b x JOIN b y ON x.bg = y.bg AND x.kind = 'u' AND y.kind = 't' GROUP BY 1, 2, 3),
d AS (SELECT s.doc_id, s.unit, s.license, 2.0::DOUBLE * shared / (x.n + y.n) AS dice FROM s
  JOIN n x ON x.kind = 'u' AND x.doc_id = s.doc_id AND x.unit = s.unit JOIN n y ON y.kind = 't' AND y.unit = s.license
  WHERE 200 * shared >= 80 * (x.n + y.n)),
m AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1),
f AS (SELECT doc_id, count(*) AS n_matches, arg_min(license, (-dice, license)) AS best_template, max(dice) AS dice,
  array_to_string(list_sort(list(DISTINCT split_part(license, '/', 1))), ',') AS licenses FROM m GROUP BY 1)
SELECT l.doc_id, coalesce(n_matches, 0) AS n_matches, best_template, round(coalesce(dice, 0), 6) AS dice, coalesce(licenses, '') AS licenses
FROM l LEFT JOIN f USING (doc_id)""")
def op1_license_scan(spark, d):
    return licenses.per_document(table(spark, d, "documents"))


@query()
def op1_license_windows(spark, d):
    """No SQL: windows at every word. Tested against brute force."""
    return licenses.per_document(table(spark, d, "documents"), anywhere=True)


@query()
def op3_chunked_bpe(spark, d):
    """No SQL: a tokenizer. Tested against the library."""
    return chunks.encoded_digests(table(spark, d, "documents"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) m ON m.doc_id = d.doc_id""")
def op4_ngram_jaccard(spark, d):
    return jaccard.classes(table(spark, d, "documents"))


@query("""WITH q AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)]) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""")
def op5_topk(spark, d):
    return topk.search(table(spark, d, "embeddings"))


@query(f"""WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_ASCII})) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)""")
def op6_exact_dedup(spark, d):
    return exact.groups(table(spark, d, "documents"), all_hashes=True)


@query(r"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, s) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, h || s AS rule, verdict FROM p JOIN r ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, s)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || s) DESC) = 1),
g(pattern) AS (VALUES ('%.spam%'), ('%-farm.%'), ('%.cheap-%'), ('%casino%'), ('%-pills.%'), ('%/ads/%'), ('%/tracker/%'), ('%.click/%')),
b AS (SELECT DISTINCT page_id FROM p JOIN g ON ('.' || host || path) LIKE pattern)
SELECT p.page_id, host, path, rule, coalesce(verdict, CASE WHEN b.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN m USING (page_id) LEFT JOIN b ON p.page_id = b.page_id""")
def op7_url_filter(spark, d):
    return urls.judge(table(spark, d, "pages"))


@query()
def op8_best_fit(spark, d):
    """No SQL: a tokenizer. Tested for whole pieces, room, gaps and the number of sequences."""
    return packing.pack_documents(table(spark, d, "documents"))


@query()
def op2_skip_chain_pii(spark, d):
    """No SQL: a trained field. Tested against plain patterns and planted mentions."""
    docs = table(spark, d, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query()
def op10_line_crf_quality(spark, d):
    """No SQL: a trained field. Tested by held-out accuracy."""
    docs = table(spark, d, "documents")
    return quality.score(docs, quality.train(docs, table(spark, d, "labels")))


@query()
def op9_suffix_dedup(spark, d):
    """No SQL: all strings of all texts. Tested against brute force."""
    return repeats.remove(table(spark, d, "documents")).drop("kept")


# crc32 by its table of 256 values; a value v of n bytes as n:v; levels as lists, halved until each has one digest.
_CRC = """k AS (SELECT [list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384)) FOR v IN range(256)] AS t)"""
_FIELDS = " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "{n}", "text"))
_UP = "[sha256(l[2 * i - 1] || coalesce(l[2 * i], '')) FOR i IN range(1, (len(l) + 1) // 2 + 1)]"


@query(f"""WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, lang, sha256({_FIELDS.format(n="n_chars")}) AS leaf, sha256({_FIELDS.format(n="(n_chars + 1)")}) AS other,
  xor(list_reduce(list_prepend(4294967295, [ascii(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 7 = 0 AS hit FROM documents, k),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
s(lang, level, l) AS (SELECT lang, 0, list(leaf ORDER BY pos) FROM o GROUP BY lang UNION ALL SELECT lang, level + 1, {_UP} FROM s WHERE len(l) > 1),
r AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM s WHERE len(l) = 1),
u(level, l) AS (SELECT 0, list(subroot ORDER BY place) FROM r UNION ALL SELECT level + 1, {_UP} FROM u WHERE len(l) > 1),
v AS (SELECT 0 AS tree, lang, level, l FROM s UNION ALL SELECT 1, r.lang, level, l FROM u, r),
g AS (SELECT o.doc_id, o.leaf, o.pos, o.lang, r.subroot, r.place, CASE WHEN hit AND n.other IS NOT NULL THEN n.other ELSE o.leaf END AS start
  FROM o JOIN r ON o.lang IS NOT DISTINCT FROM r.lang JOIN (SELECT doc_id, leaf, other FROM d) n ON n.doc_id IS NOT DISTINCT FROM o.doc_id AND n.leaf = o.leaf),
w AS (SELECT g.doc_id, g.leaf, row_number() OVER (PARTITION BY g.doc_id, g.leaf ORDER BY tree, level) AS step, p, v.l[xor(p, 1) + 1] AS sib
  FROM (SELECT g.*, tree, level, v.l, CASE WHEN tree = 0 THEN pos ELSE place END >> level AS p FROM g JOIN v ON v.lang IS NOT DISTINCT FROM g.lang WHERE len(v.l) > 1) g, LATERAL (SELECT g.l) v),
f(doc_id, leaf, step, x) AS (SELECT doc_id, leaf, 0, start FROM g UNION ALL
  SELECT f.doc_id, f.leaf, w.step, sha256(CASE WHEN w.p % 2 = 0 THEN f.x || coalesce(w.sib, '') ELSE w.sib || f.x END) FROM f JOIN w ON w.doc_id = f.doc_id AND w.leaf = f.leaf AND w.step = f.step + 1),
e AS (SELECT doc_id, leaf, arg_max(x, step) AS x FROM f GROUP BY 1, 2),
q AS (SELECT doc_id, leaf, string_agg(sib, '' ORDER BY step) AS sibs FROM w GROUP BY 1, 2)
SELECT g.doc_id, g.leaf, subroot, root, sha256(coalesce(sibs, '')) AS proof_sha256, e.x AS folded_root, e.x = root AS verified
FROM g JOIN e ON e.doc_id = g.doc_id AND e.leaf = g.leaf LEFT JOIN q ON q.doc_id = g.doc_id AND q.leaf = g.leaf, (SELECT l[1] AS root FROM u WHERE len(l) = 1)""")
def op13_merkle(spark, d):
    return merkle.manifest(table(spark, d, "documents"), merkle.tampered())


_BYTES = "flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END FOR x IN string_split(doc_id || ':' || run, '')])"


@query(rf"""WITH RECURSIVE {_CRC},
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM t GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, {_BYTES}), (lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))), 4294967295) AS h FROM c, k),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
p AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM w, unnest(range(1, length(word) + 1)) AS r(i)),
x AS (SELECT p.word AS u, w.word AS v FROM p JOIN w ON p.a || p.b = w.word),
e AS (SELECT u, v FROM x UNION SELECT v, u FROM x UNION SELECT p.word, q.word FROM p JOIN p q ON p.i = q.i AND p.a || '*' || p.b = q.a || '*' || q.b AND p.word <> q.word),
g AS (SELECT u, count(*) AS n_near, arg_min(v, (-w.n, v)) AS best, max(w.n) AS top FROM e JOIN w ON w.word = v GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN best END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM w LEFT JOIN g ON u = word),
r(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL""")
def op11_spelling(spark, d):
    return spelling.variants(table(spark, d, "documents"))


@query()
def op12_language(spark, d):
    """No SQL: a trained network. Tested by held-out accuracy, and its gradients against differences."""
    docs = table(spark, d, "documents")
    return language.predict(docs, language.train(docs))

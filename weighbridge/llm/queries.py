"""One registered query per operator, over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ---- 1: seekable WARC bundles --------------------------------------------------
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP1_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
e AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i:
        '{BASE32}'[1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT]), '') AS g FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY g, n) AS first_id FROM e)
SELECT page_id, n::BIGINT AS payload_bytes, g AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""


@register("op1_warc", OP1_SQL)
def op1_warc(spark, sf):
    from weighbridge.llm.warc import archive_pages

    read = archive_pages(table(spark, sf, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ---- 4: URL rules by Bloom filter cascades -------------------------------------
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
OP4_SQL = """
WITH u AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1)) AS host,
                  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                           ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(h || p, length(h) * 10000 + length(p)) AS rule, arg_max(action, length(h) * 10000 + length(p)) AS verdict
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""


@register("op4_url_filter", OP4_SQL)
def op4_url_filter(spark, sf):
    from weighbridge.llm.url_filter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    judged = judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# ---- 6: embedding near-duplicates ----------------------------------------------
OP6_SQL = """
WITH RECURSIVE
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(i, j) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.i, l.j FROM reach r JOIN l ON r.j = l.i)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.i = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT i, min(j) AS component_id FROM reach GROUP BY i) c ON c.i = e.vec_id
"""


@register("op6_embed_dedup", OP6_SQL)
def op6_embed_dedup(spark, sf):
    from weighbridge.llm.embed_dedup import embedding_groups

    return embedding_groups(table(spark, sf, "embeddings"), cosine=0.98)


# ---- 7: SimHash near-duplicates (no XXH64 in SQL: tests compare with brute force) --
@register("op7_simhash")
def op7_simhash(spark, sf):
    from weighbridge.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf, "documents"), shingle=4, max_bits=4)


# ---- 2: benchmark decontamination ----------------------------------------------
OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
           FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS v
      FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
i AS (SELECT * FROM b WHERE len(v) >= 8),
dg AS (SELECT doc_id, k, w[k:k+3] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS k FROM d)),
ig AS (SELECT item_id, k, v[k:k+3] AS g FROM (SELECT item_id, v, unnest(range(1, len(v) - 2)) AS k FROM i)),
a AS (SELECT DISTINCT doc_id, item_id, dg.k - ig.k AS s FROM dg JOIN ig USING (g)),
m AS (SELECT a.doc_id, a.item_id, s, len(v) AS n, least(len(v), 13) AS sz, j,
             CASE WHEN j + s >= 1 AND j + s <= len(w) AND w[j + s] = v[j] THEN 1 ELSE 0 END AS f
      FROM (SELECT a.*, v, unnest(range(1, len(v) + 1)) AS j FROM a JOIN i USING (item_id)) a JOIN d USING (doc_id)),
c AS (SELECT doc_id, item_id, s, n, sz, j,
             sum(f) OVER p - CASE WHEN sz < 13 THEN 0 ELSE coalesce(sum(f) OVER q, 0) END AS inside, sum(f) OVER t AS total
      FROM m WINDOW p AS (PARTITION BY doc_id, item_id, s ORDER BY j), q AS (PARTITION BY doc_id, item_id, s ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 13 PRECEDING),
                    t AS (PARTITION BY doc_id, item_id, s)),
e AS (SELECT doc_id, item_id, s, n, max(inside) AS wm, max(total) AS tm FROM c WHERE j >= sz GROUP BY ALL HAVING max(inside) >= max(sz) - floor(max(sz) * 2 / 13.0)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY wm DESC, tm DESC) AS rn FROM e),
l AS (SELECT DISTINCT len(v) AS n FROM b WHERE len(v) BETWEEN 1 AND 7),
x AS (SELECT DISTINCT doc_id, item_id, n FROM (SELECT doc_id, n, w[k:k+n-1] AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, l)) JOIN b ON v = g)
SELECT doc_id, item_id, wm::INT AS window_matches, tm::INT AS matched_tokens, n::INT AS item_tokens FROM r WHERE rn = 1
UNION ALL SELECT doc_id, item_id, n::INT, n::INT, n::INT FROM x
"""


@register("op2_decontam", OP2_SQL)
def op2_decontam(spark, sf):
    from weighbridge.llm.decontam import overlaps

    return overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


# ---- 5: licence scan -----------------------------------------------------------
def _op5_sql() -> str:
    from weighbridge.llm.licenses import TEMPLATES

    known = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
    return (
        f"WITH known(license, body) AS (VALUES {known}),\n"
        + r"""
tw AS (SELECT DISTINCT license, list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda s: s <> '') AS w FROM known),
tg AS (SELECT license, t, n, g, count(*) AS c FROM (SELECT license, w AS t, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw) GROUP BY ALL),
d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda s: s <> '') AS w FROM documents WHERE length(text) > 0),
dg AS (SELECT r, len(w) - 1 AS nd, unnest(range(len(w) - 1)) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d WHERE len(w) > 1),
h AS (SELECT r, license, t, n, nd, p, g, c FROM dg JOIN tg USING (g)),
x AS (SELECT *, count(*) OVER (PARTITION BY r, license, t ORDER BY p RANGE BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS held, least(n, nd - p) AS ns FROM h),
sp AS (SELECT r, license, t, n, p AS s, ns FROM x WHERE held >= 0.4::DOUBLE * (ns + n) - 1e-9),
bag AS (SELECT sp.r, sp.license, sp.t, sp.n, s, ns, h.g, least(count(*), any_value(h.c)) AS m FROM sp JOIN h ON h.r = sp.r AND h.license = sp.license AND h.t = sp.t AND h.p BETWEEN s AND s + ns - 1 GROUP BY sp.r, sp.license, sp.t, sp.n, s, ns, h.g),
sc AS (SELECT r, license, t, n, s, ns, sum(m)::BIGINT AS shared, 2.0::DOUBLE * sum(m) / (ns + n) AS dice FROM bag GROUP BY r, license, t, n, s, ns HAVING sum(m) >= 0.4::DOUBLE * (ns + n) - 1e-9),
one AS (SELECT * FROM sc a WHERE NOT EXISTS (SELECT 1 FROM sc b WHERE b.r = a.r AND b.license = a.license AND b.t = a.t AND abs(b.s - a.s) < a.n AND (b.dice > a.dice OR (b.dice = a.dice AND b.s < a.s)))),
best AS (SELECT * FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.r = a.r AND (b.license <> a.license OR b.t <> a.t) AND b.s <= a.s + a.ns AND a.s <= b.s + b.ns
         AND (b.shared, b.dice, a.license) > (a.shared, a.dice, b.license)))
SELECT DISTINCT doc_id, s::INT AS start, (ns + 1)::INT AS n_words, license, shared, dice FROM best JOIN d USING (r)
"""
    )


@register("op5_licenses", _op5_sql())
def op5_licenses(spark, sf):
    from weighbridge.llm.licenses import scan_licenses, templates

    return scan_licenses(table(spark, sf, "documents"), templates(spark), dice=0.8)


# ---- 8: token rollups ----------------------------------------------------------
OP8_SQL = r"""
WITH w AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n1,
                  len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+')) AS n2 FROM documents),
t AS (SELECT source, lang, 'words-1' AS tokenizer, n1 AS n FROM w UNION ALL SELECT source, lang, 'words-2', n2 FROM w)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM t GROUP BY ALL
"""


@register("op8_rollups", OP8_SQL)
def op8_rollups(spark, sf):
    """Inserts every document, revises some (their first line taken out), deletes some, counts all
    with a second tokenizer version, puts everything back and replays three of the batches; then compacts. The totals
    are those of all documents, whole."""
    import uuid

    from weighbridge.llm.rollups import RollupStore
    from weighbridge.session import ensure_checkpoint_dir

    words = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    full, head = words(F.col("text")), words(F.substring_index("text", "\n", 1))
    shortened, dropped = (F.coalesce(F.col("doc_id") % m == r, F.lit(False)) for m, r in ((5, 0), (11, 3)))
    none = F.lit(None).cast("long")

    def batch(rows, tokenizer, op, before, after):
        return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), before.alias("old_tokens"), after.alias("new_tokens"))

    insert = batch(docs, "words-1", "insert", none, full)
    revise = batch(docs.where(shortened), "words-1", "revise", full, full - head)
    delete = batch(docs.where(dropped), "words-1", "delete", F.when(shortened, full - head).otherwise(full), none)
    letters = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+|\p{N}+")).cast("long")
    upgrade = batch(docs, "words-2", "insert", none, letters)
    restore = batch(docs.where(dropped), "words-1", "insert", none, full).unionByName(batch(docs.where(shortened & ~dropped), "words-1", "revise", full - head, full))
    store = RollupStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollups-{uuid.uuid4().hex}")
    batches = {"load": insert, "revise": revise, "delete": delete, "upgrade": upgrade, "restore": restore}
    for name in ("load", "revise", "delete", "revise", "upgrade", "delete", "restore", "restore"):
        store.apply(name, batches[name])
    store.compact()
    return store.totals()


# ---- 9: quality classifier (tests check held-out accuracy) -----------------------
@register("op9_quality")
def op9_quality(spark, sf):
    from weighbridge.llm.quality import classify

    return classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


# ---- 3: packing (tests check an exact round trip) --------------------------------
@register("op3_packing")
def op3_packing(spark, sf):
    from weighbridge.llm.packing import pack_documents

    packed = pack_documents(table(spark, sf, "documents"), max_tokens=2048, as_loaded=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


# ---- 10: Katz backoff scores (tests compare with brute force) ----------------------
@register("op10_katz")
def op10_katz(spark, sf):
    from weighbridge.llm.katz import katz_scores

    return katz_scores(table(spark, sf, "documents"), folds=7, out_fold=2)


# ---- 13: cross-tokenizer alignment (tests compare with brute force) -----------------
@register("op13_align")
def op13_align(spark, sf):
    from weighbridge.llm.align import align_tokenizers

    return align_tokenizers(table(spark, sf, "documents"))


# ---- 11: conversation prefix trie --------------------------------------------------
# turns of equal number have an order of their own (see the operator), so the SQL is for tables without them
OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, count(*) AS n, c - c % 20 AS b,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                 lambda crc, s: list_reduce(list_prepend(xor(crc, s), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h
      FROM t GROUP BY c),
re AS (SELECT k.c, t.i AS d, t.r, t.x FROM k JOIN t ON t.c = k.b AND t.i <= k.h
       UNION ALL SELECT k.c, t.i - k.h + least(k.h, coalesce(kb.n, 0)), t.r, t.x FROM k JOIN t ON t.c = k.c AND t.i > k.h LEFT JOIN k kb ON kb.c = k.b),
p AS (SELECT c, d, sha256(string_agg(sha256(length(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY d)) AS key,
             len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM re
      UNION ALL SELECT c, 0, '', 0 FROM k),
a AS (SELECT *, lag(key) OVER o AS up, max(d) OVER (PARTITION BY c) AS last FROM p WINDOW o AS (PARTITION BY c ORDER BY d)),
n AS (SELECT d, key, min(c) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(w) AS w, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last) AS ends FROM a GROUP BY d, key),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids ON kids.d = n.d AND kids.key = n.key),
s AS (SELECT a.d, a.key, sum((m.n_children = 0)::INT) AS n_leaves, sum((m.n_convs - 1) * m.w) AS saved FROM m JOIN a ON a.c = m.conv_id AND a.d <= m.d GROUP BY ALL)
SELECT m.conv_id, m.d::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN s ON s.d = m.d AND s.key = m.key LEFT JOIN m u ON u.d = m.d - 1 AND u.key = m.up
"""


@register("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark, sf):
    from weighbridge.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf, "conversations"))


# ---- 12: repeated passages -----------------------------------------------------------
OP12_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT k, min(doc_id) AS low FROM s GROUP BY k),
gone AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 50)) AS j FROM s JOIN f USING (k) WHERE doc_id > low)),
words AS (SELECT d.r, u.j, u.x FROM d, (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d) u WHERE u.r = d.r),
kept AS (SELECT words.r, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone ON gone.r = words.r AND gone.j = words.j GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


@register("op12_window_dedup", OP12_SQL)
def op12_window_dedup(spark, sf):
    from weighbridge.llm.window_dedup import remove_repeats

    return remove_repeats(table(spark, sf, "documents"))

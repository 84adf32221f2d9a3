"""The named queries of this subpackage: thin forms over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import embeddings, lexical, licenses, linededup, media, minhash, mixing, quality, sharding, spelling, tokens, warc
from corpusloom.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


ORACLE["op1_near_vectors"] = """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
    ok AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
    link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
             WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id)::BIGINT AS n_links,
           least(e.vec_id, coalesce(m.low, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(m.low, e.vec_id)) AS kept
    FROM embeddings e LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = e.vec_id
"""
ORACLE["op6_minhash_groups"] = r"""
    WITH RECURSIVE word AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    sets AS (
        SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
        FROM word, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS u(i) WHERE len(w) > 0),
    size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id,
           d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
    FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
ORACLE["op4_template_lines"] = r"""
    WITH texts AS (SELECT DISTINCT text, md5(text) AS key FROM documents WHERE text IS NOT NULL),
    line AS (
        SELECT key, length(text) + 1 AS size, i - 1 AS i, length(ls[i]) + 1 AS chars, trim(regexp_replace(ls[i], '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line
        FROM (SELECT key, text, string_split(text, chr(10)) AS ls FROM texts), unnest(range(1, len(ls) + 1)) AS u(i)),
    used AS (
        SELECT *, string_split(line, ' ') AS ts, regexp_replace(' ' || line, ' [^ ]*[0-9@][^ ]*', ' <*>', 'g')[2:] AS masked
        FROM line WHERE line <> '' AND (len(string_split(line, ' ')) >= 2 OR length(line) >= 20)),
    leafed AS (
        SELECT key, size, i, chars, struct_pack(n := len(ts), lead := string_split(masked, ' ')[:3]) AS leaf,
               CASE WHEN len(list_filter(ts, lambda t: regexp_matches(t, '[0-9@]'))) * 4 > len(ts) THEN line ELSE masked END AS line
        FROM used),
    busy AS (SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT key) >= CASE WHEN leaf.n >= 10 THEN 3 ELSE 10 END),
    found AS (SELECT * FROM leafed WHERE leaf IN (SELECT leaf FROM busy)),
    dist AS (SELECT leaf, line, count(DISTINCT key) AS n FROM found GROUP BY leaf, line),
    spread AS (SELECT leaf, line, n, k, string_split(line, ' ')[k] AS token FROM dist, unnest(range(1, leaf.n + 1)) AS u(k)),
    often AS (SELECT leaf, k, token FROM spread WHERE k > 3 GROUP BY ALL HAVING sum(n) >= CASE WHEN leaf.n >= 10 THEN 3 ELSE 10 END),
    shape AS (
        SELECT s.leaf, s.line, any_value(s.n) AS n, string_agg(CASE WHEN s.k <= 3 THEN s.token ELSE coalesce(o.token, '<*>') END, ' ' ORDER BY s.k) AS t,
               count(*) FILTER (CASE WHEN s.k <= 3 THEN s.token ELSE coalesce(o.token, '<*>') END <> '<*>') AS kept, count(*) AS size
        FROM spread s LEFT JOIN often o ON s.leaf = o.leaf AND s.k = o.k AND s.token = o.token GROUP BY s.leaf, s.line),
    tmpl AS (SELECT leaf, line, n, CASE WHEN kept >= 0.75 * size THEN t ELSE line END AS template FROM shape),
    gone AS (SELECT leaf, line, template FROM tmpl WHERE (leaf, template) IN (
        SELECT (leaf, template) FROM tmpl GROUP BY leaf, template HAVING sum(n) >= CASE WHEN leaf.n >= 10 THEN 3 ELSE 10 END)),
    held AS (SELECT f.key, f.i, f.leaf, g.template FROM found f JOIN gone g ON f.leaf = g.leaf AND f.line = g.line),
    part AS (
        SELECT key, size, leaf.n >= 10 AS long, array_to_string(ws[8 * k + 1:CASE WHEN k = greatest(len(ws) // 8, 1) - 1 THEN len(ws) ELSE 8 * k + 8 END], ' ') AS s
        FROM (SELECT *, string_split(line, ' ') AS ws FROM found), unnest(range(0, greatest(len(ws) // 8, 1))) AS u(k)),
    repeat AS (SELECT s, long FROM part GROUP BY s, long HAVING count(DISTINCT key) >= CASE WHEN long THEN 3 ELSE 10 END),
    longest AS (
        SELECT key, any_value(size) AS size, sum(length(s) + 1) AS covered, list_sort(list(DISTINCT struct_pack(c := -length(s), s := s, long := long)))[:4] AS ts
        FROM part JOIN repeat USING (s, long) GROUP BY key),
    copies AS (
        SELECT DISTINCT key, unnest(CASE len(ts) WHEN 1 THEN [ts] WHEN 2 THEN [ts] WHEN 3 THEN [[ts[1], ts[2]], [ts[1], ts[3]], [ts[2], ts[3]]]
                                    ELSE [[ts[1], ts[2], ts[3]], [ts[1], ts[2], ts[4]], [ts[1], ts[3], ts[4]], [ts[2], ts[3], ts[4]]] END) AS agree
        FROM longest WHERE covered >= 0.75 * size),
    least AS (SELECT agree, min(key) AS low FROM copies GROUP BY agree),
    label AS (SELECT key, min(low) AS label FROM copies JOIN least USING (agree) GROUP BY key),
    recurring AS (
        SELECT leaf, template FROM held LEFT JOIN label USING (key) GROUP BY leaf, template
        HAVING count(DISTINCT coalesce(label, key)) >= CASE WHEN leaf.n >= 10 THEN 3 ELSE 10 END),
    dropped AS (SELECT key, list(i) AS drop FROM held WHERE (leaf, template) IN (SELECT (leaf, template) FROM recurring) GROUP BY key)
    SELECT doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::INT AS n_lines,
           coalesce(len(drop), 0)::INT AS n_dropped,
           CASE WHEN drop IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(
               range(1, len(string_split(d.text, chr(10))) + 1), lambda i: NOT list_contains(drop, i - 1)), lambda i: string_split(d.text, chr(10))[i]), chr(10)) END AS text
    FROM documents d LEFT JOIN dropped x ON md5(d.text) = x.key
"""
ORACLE["op8_warc_round_trip"] = """
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
           CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM (SELECT page_id, html,
                 CASE WHEN strlen(coalesce(html, '')) >= 1000 THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS first_id
          FROM pages)
"""
ORACLE["op11_ranked_search"] = r"""
    WITH term AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
        FROM documents),
    tf AS (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY ALL),
    len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
    total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
    weight AS (SELECT t, floor(1000.0::DOUBLE * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
    asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
        FROM benchmark),
    hit AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
        FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN len USING (doc_id), total GROUP BY item_id, doc_id)
    SELECT item_id, rank::INT AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hit WHERE score > 0) WHERE rank <= 50
"""
ORACLE["op12_spelling_variants"] = r"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, run, count(*) AS k
        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
    step AS (
        SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
    summed AS (
        SELECT run, k, xor(list_reduce(
                   flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c) - 64] END)),
                   lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
        FROM runs, step),
    word AS (
        SELECT w AS word, sum(k)::BIGINT AS n
        FROM (SELECT k, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS w FROM summed)
        WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3),
    cut AS (SELECT DISTINCT word, n, word[:i] || word[i + 2:] AS c FROM word, unnest(range(0, length(word))) AS u(i)),
    pair AS (
        SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN word b ON a.c = b.word
        UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.c = b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN cut b ON a.c = b.c AND a.word <> b.word AND length(a.word) = length(b.word)
              WHERE len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i])) = 1),
    near AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pair GROUP BY word),
    best AS (SELECT word, min(other) AS other FROM pair JOIN near USING (word, m) GROUP BY word),
    form AS (
        SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
        FROM word LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
    chain(word, head) AS (SELECT word, coalesce(form, word) FROM form UNION SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.head WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, r.head AS root, f.n, f.n_near, f.form_n
    FROM form f JOIN chain r ON r.word = f.word JOIN form e ON e.word = r.head AND e.form IS NULL
"""
ORACLE["op13_license_scan"] = licenses.template_sql()


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op2_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op4_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", "text")


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


@query
def op6_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


@query
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = tokens.round_trip_bpe(docs, path, pattern)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), tokens.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

"""Registered queries of this subpackage over whole tables, and SQL for those that it can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


@query("op2_ngram_jaccard_join", f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=LOWERED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle)
      WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.ngram_join import ngram_jaccard_join
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


RUNS = "regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op4_wu_manber_decontamination", f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS id, {RUNS.format(text=LOWERED)} AS w FROM benchmark),
p AS (SELECT DISTINCT id, least(len(w), 13) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2),
        lambda k: array_to_string(w[k:k + least(len(w), 13) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {RUNS.format(text=LOWERED)} AS w FROM documents),
x AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, (SELECT DISTINCT n FROM p)),
h AS (SELECT doc_id, n, k, id FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM x) JOIN p USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.decontaminate import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


MIX = f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format(text="coalesce(text, '')")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, ceil(sqrt(count(*)))::BIGINT AS blocks FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
c AS (SELECT *, row_number() OVER r AS rank, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER
        (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
      FROM w WINDOW r AS (ORDER BY source_size * (10 // weight), source NULLS LAST)),
f AS (SELECT rank AS free_rank, rest AS free_rest, shares AS free_shares FROM c
      WHERE 3 * source_size * shares > rest * weight ORDER BY rank LIMIT 1),
t AS (SELECT source, source_size, blocks, CASE WHEN rank >= free_rank THEN (weight * free_rest)::DOUBLE / free_shares
        ELSE (3 * source_size)::DOUBLE END AS target FROM c LEFT JOIN f ON true),
p AS (SELECT source, source_size, blocks, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
k AS (SELECT d.*, p.source_size::BIGINT AS source_size, target, passes, target - passes * p.source_size AS rest,
        coalesce('s' || d.source, 'n') || ':' || (('0x' || substr(md5('mix|block|' || doc_id), 1, 8))::BIGINT % blocks) AS name
      FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix|order|' || name), name,
        md5('mix|row|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN before + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM b"""


@query("op3_hypergeometric_mix", MIX)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.mixing import mix_report
    return mix_report(table(spark, sf_dir, "documents"))


@query("op8_order_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.order_minhash import edited_fingerprints
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op10_super_kmer_dedup", f"""
WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM x) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM g),
k AS (SELECT o.doc_id, string_agg(o.word, ' ' ORDER BY o.pos) AS kept, count(*) AS n
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d) o
      ANTI JOIN c ON c.doc_id = o.doc_id AND c.pos = o.pos GROUP BY o.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.substring_dedup import drop_repeated_passages
    return drop_repeated_passages(table(spark, sf_dir, "documents")).drop("kept")


@query("op7_warc_index_merge", """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to FROM m""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.warc_index import archive_and_index
    from veilstream.session import shared_dir
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    return archive_and_index(table(spark, sf_dir, "pages"), path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_quality_trees")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.quality_trees import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_page_crf")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.page_crf import extract
    return extract(table(spark, sf_dir, "pages"))


@query("op5_secret_network")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.secret_scan import secrets
    return secrets(table(spark, sf_dir, "documents"))


@query("op6_pii_tagger")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.pii_tagger import personal_data
    return personal_data(table(spark, sf_dir, "documents"))


TERMS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {TERMS.format(text=LOWERED)} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({TERMS.format(text=LOWERED)}) AS term FROM benchmark),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY ALL),
u AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(k) + 1)))::BIGINT AS weight
      FROM (SELECT DISTINCT term FROM q) LEFT JOIN t USING (term), s GROUP BY term),
m AS (SELECT k, doc_id, 100 - 90 + (90 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
c AS (SELECT item_id, k, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN u USING (term) JOIN m USING (k) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM c JOIN d USING (k) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.ranked_search import ranked_search
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_suffix_dedup", """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT k, i, md5(substr(x, 2 * i + 1, 800)) AS s FROM (SELECT k, x, unnest(range(octet_length(b) - 399)) AS i FROM d)),
r AS (SELECT k, i FROM s JOIN (SELECT s FROM s GROUP BY s HAVING count(*) > 1) USING (s)),
g AS (SELECT k, i, CASE WHEN i <= lag(i) OVER w + 400 THEN 0 ELSE 1 END AS head FROM r WINDOW w AS (PARTITION BY k ORDER BY i)),
n AS (SELECT k, i, sum(head) OVER (PARTITION BY k ORDER BY i) AS span FROM g),
p AS (SELECT k, span, min(i) AS start, max(i) + 400 AS stop FROM n GROUP BY ALL),
a AS (SELECT *, lag(stop, 1, 0) OVER (PARTITION BY k ORDER BY start) AS free FROM p),
c AS (SELECT k, count(*) AS n_spans, sum(stop - start) AS n_removed, max(stop) AS last,
             string_agg(substr(x, 2 * free + 1, 2 * (start - free)), '' ORDER BY start) AS kept FROM a JOIN d USING (k) GROUP BY k)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN c USING (k)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.suffix_dedup import drop_repeated_strings
    return drop_repeated_strings(table(spark, sf_dir, "documents")).drop("kept")


@query("op13_spelling_variants", f"""
WITH RECURSIVE polynomial AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
g AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head, unnest(regexp_extract_all({LOWERED}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
b AS (SELECT run, count(*) AS times, flatten([[4294967295], flatten(list_transform(string_split(head || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))])::BIGINT[] AS bytes
      FROM g WHERE length(run) >= 6 GROUP BY head, run),
h AS (SELECT run, times, xor(list_reduce(bytes, lambda a, x: xor(crc[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS h FROM b, polynomial),
o AS (SELECT CASE WHEN h % 199 <> 0 THEN run ELSE left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) END AS word, times FROM h),
v AS (SELECT word, sum(times)::BIGINT AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
e AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT x.word AS a, y.word AS b FROM e x JOIN e y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
      UNION SELECT e.word, v.word FROM e JOIN v ON e.less = v.word UNION SELECT v.word, e.word FROM e JOIN v ON e.less = v.word),
k AS (SELECT a AS word, count(*) AS n_near, arg_min(struct_pack(b := b, n := y.n), (-y.n, b)) AS best FROM p JOIN v y ON y.word = b GROUP BY a),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * n THEN best.b END AS form,
        CASE WHEN best.n >= 5 * n THEN best.n END AS form_n FROM v LEFT JOIN k ON k.word = v.word),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word
WHERE root IN (SELECT word FROM f WHERE form IS NULL)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilstream.llm.spelling import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents"))


def registered():
    return QUERIES, ORACLES

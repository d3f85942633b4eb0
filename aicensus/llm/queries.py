"""The operators applied to their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, decontamination, exact_dedup, language_id, ngram_join, quotations, resampling, secrets, superminhash, toxicity,
    url_lists, warc, whitening,
)
from .common import shared_folder, stored, table


def crc_is(value: int, modulus: int) -> Column:
    """Whether the remainder of the id's CRC-32 has this value; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == value, F.lit(False))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = stored(warc.read_archives(spark, folder).drop("payload"), "warc-records")
    page = lambda c: F.expr(f"CAST(nullif(split({c}, ':')[2], '') AS BIGINT)")
    sizes = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("referred_bytes"))
    responses = records.filter("record_type = 'response'").withColumn("referred_bytes", F.lit(None).cast("long"))
    revisits = records.filter("record_type = 'revisit'").join(sizes, "refers_to", "left")
    return responses.unionByName(revisits).select(
        page("record_id").alias("page_id"), F.coalesce("payload_bytes", "referred_bytes").alias("payload_bytes"),
        "payload_digest", "record_type", page("refers_to").alias("refers_to"), "status")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_links", "class_size", "stays")


# The fetch day of a page, and the list events of a domain, from numbers of the table; v is a hash of the domain.
_FETCHED = "date_add(DATE '2020-01-01', CAST((page_id * 37) % 1500 AS INT))"
_EVENTS = (  # category, days after 2020-01-01, listed, condition
    ("ads", "v % 900", True, "v % 3 = 0"), ("ads", "v % 900 + 30 + v % 300", False, "v % 3 = 0 AND v % 2 = 0"),
    ("ads", "v % 900 + 430", True, "v % 3 = 0 AND v % 5 = 0"), ("malware", "v % 1300", True, "v % 7 < 2"),
    ("malware", "v % 1300 + v % 90", False, "v % 7 = 1"))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_FETCHED).alias("fetched_on"))
    domains = captures.select(F.explode(url_lists.domains_of(url_lists.host_of(F.col("url")))).alias("domain")).distinct().filter(
        "domain LIKE '%.%'").withColumn("v", F.expr("CAST(conv(substr(md5(domain), 1, 6), 16, 10) AS INT)"))
    event = F.explode(F.array(*[F.expr(
        f"named_struct('category', '{c}', 'day', date_add(DATE '2020-01-01', {d}), 'listed', {str(on).lower()}, 'is', {cond})")
        for c, d, on, cond in _EVENTS])).alias("e")
    events = domains.select("domain", event).filter("e.is").select("domain", "e.category", "e.day", "e.listed")
    return url_lists.judge_captures(captures, url_lists.validity(events)).drop("url")


def quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as mail-like messages: most turns quote the turn before, some also the one before that."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    before = lambda n: said.groupBy("conv_id", (F.col("turn") + n).alias("turn")).agg(F.min("text").alias(f"before{n}"))
    marked = lambda c, mark: F.concat(F.lit(f"{mark} "), F.replace(F.col(c), F.lit("\n"), F.lit(f"\n{mark} ")))
    rows = said.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    quotes = F.concat_ws("\n", F.when(F.col("turn") % 3 == 0, marked("before2", ">>")), marked("before1", ">"), F.lit(""))
    return rows.select("conv_id", "turn", "role", F.when((F.col("turn") % 4 != 3) & F.col("before1").isNotNull(), F.concat(
        quotes, "text")).otherwise(F.col("text")).alias("text"))


def op7_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(quoting(spark, sf_dir)).select(
        "conv_id", "turn", "parent_turn", "root_turn", "depth", "n_quotes", "n_linked", "max_level",
        F.sha2("own_text", 256).alias("own_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_is(2, 4)
    model = language_id.fit(docs, ~held)
    return language_id.classify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("matches")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_is(1, 3)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_n=1)


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_copies(table(spark, sf_dir, "documents"), shingle=2)


QUERIES = {f.__name__: f for f in (op1_warc, op2_byte_bpe, op3_ngram_join, op4_url_lists, op5_language_id,
                                   op6_decontamination, op7_quotations, op8_exact_dedup, op9_secret_scan, op10_toxicity,
                                   op11_whitening, op12_resampling, op13_superminhash)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Base32 of the digest: every five hexadecimal digits are four characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {15 - 5 * j}) & 31), 1)"
    for i in range(8) for j in range(4))

ORACLES = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first_id,
             row_number() OVER (PARTITION BY t ORDER BY page_id NULLS LAST) AS n FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN first_id END AS refers_to, 'ok' AS status
FROM q""",
    "op3_ngram_join": f"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
cut AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM doc WHERE len(w) > 0),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g FROM cut),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM gram a JOIN gram b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT a, min(b) AS class_id, count(*) AS class_size FROM reach GROUP BY a)
SELECT doc_id, class_id, (SELECT count(*) FROM link WHERE a = doc_id) AS n_links, class_size, doc_id = class_id AS stays
FROM documents JOIN class ON a = doc_id""",
    "op4_url_lists": f"""
WITH capture AS (SELECT page_id, url, CAST(DATE '2020-01-01' + CAST((page_id * 37) % 1500 AS INTEGER) AS DATE) AS fetched_on,
  nullif(rtrim(regexp_extract(lower(url), '{url_lists.HOST}', 1), '.'), '') AS host FROM pages),
asked AS (SELECT DISTINCT host, fetched_on, CASE WHEN regexp_matches(host, '{url_lists.ADDRESS}') THEN [host] ELSE string_split(host, '.') END AS l
  FROM capture WHERE host IS NOT NULL),
above AS (SELECT host, fetched_on, array_to_string(l[i:], '.') AS domain FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM asked)),
listed AS (SELECT DISTINCT domain, CAST('0x' || substr(md5(domain), 1, 6) AS INTEGER) AS v FROM above WHERE domain LIKE '%.%'),
event AS (""" + " UNION ALL ".join(
        f"SELECT domain, '{c}' AS category, CAST(DATE '2020-01-01' + CAST({d} AS INTEGER) AS DATE) AS day, {on} AS listed FROM listed WHERE {cond}"
        for c, d, on, cond in _EVENTS) + """),
day AS (SELECT category, domain, day, bool_or(listed) AS listed FROM event GROUP BY ALL),
change AS (SELECT * FROM (SELECT *, coalesce(lag(listed) OVER k, false) AS was FROM day WINDOW k AS (PARTITION BY category, domain ORDER BY day))
           WHERE listed <> was),
span AS (SELECT * FROM (SELECT category, domain, day AS since, lead(day) OVER (PARTITION BY category, domain ORDER BY day) AS until, listed
         FROM change) WHERE listed),
active AS (SELECT host, fetched_on, domain, category, since, until,
  row_number() OVER (PARTITION BY host, fetched_on ORDER BY length(domain) DESC, domain DESC, category DESC) AS n,
  count(*) OVER (PARTITION BY host, fetched_on) AS n_active
  FROM above JOIN span USING (domain) WHERE fetched_on >= since AND (until IS NULL OR fetched_on < until))
SELECT page_id, fetched_on, host, coalesce(n_active, 0) AS n_active, n_active IS NOT NULL AS blocked, category,
       domain AS entry, since, until
FROM capture LEFT JOIN (SELECT * FROM active WHERE n = 1) USING (host, fetched_on)""",
    "op7_quotations": r"""
WITH said AS (SELECT conv_id, turn, text, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g')) AS n FROM conversations),
quote AS (SELECT a.conv_id, a.turn, 1 AS level, b.n FROM said a JOIN said b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.turn % 4 <> 3
  UNION ALL SELECT a.conv_id, a.turn, 2, c.n FROM said a JOIN said b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
  JOIN said c ON a.conv_id = c.conv_id AND c.turn = a.turn - 2 WHERE a.turn % 4 <> 3 AND a.turn % 3 = 0),
link AS (SELECT q.conv_id, q.turn, q.level, max(s.turn) AS source FROM quote q LEFT JOIN said s
  ON q.conv_id = s.conv_id AND s.n = q.n AND s.turn < q.turn GROUP BY 1, 2, 3),
parent AS (SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked, max(level) AS max_level,
  coalesce(max(source) FILTER (level = 1), max(source)) AS parent_turn FROM link GROUP BY 1, 2),
step AS (SELECT conv_id, turn, text, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
  coalesce(max_level, 0) AS max_level, parent_turn FROM said LEFT JOIN parent USING (conv_id, turn)),
climb AS (WITH RECURSIVE c AS (SELECT conv_id, turn, turn AS place, 0 AS depth FROM step
  UNION ALL SELECT c.conv_id, c.turn, s.parent_turn, depth + 1 FROM c JOIN step s ON s.conv_id = c.conv_id AND s.turn = c.place
  WHERE s.parent_turn IS NOT NULL) SELECT conv_id, turn, min(place) AS root_turn, CAST(max(depth) AS BIGINT) AS depth FROM c GROUP BY 1, 2)
SELECT conv_id, turn, parent_turn, root_turn, depth, n_quotes, n_linked, max_level, sha256(text) AS own_sha256
FROM step JOIN climb USING (conv_id, turn)""",
    "op6_decontamination": f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
cut AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS phrase FROM cut),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
place AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM doc),
gram AS (SELECT r, i, n, array_to_string(w[i + 1:i + n], ' ') AS phrase
         FROM place, (SELECT DISTINCT n FROM win) WHERE i + n <= len(w)),
hit AS (SELECT r, i, gram.n, item_id FROM gram JOIN win ON gram.phrase = win.phrase AND gram.n = win.n),
hit_word AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM hit) GROUP BY r),
hit_item AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
             FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_word USING (r) LEFT JOIN hit_item USING (r)""",
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d""",
    "op12_resampling": f"""
WITH crc_row AS (SELECT b, list_reduce([CAST(b AS BIGINT)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
                 FROM range(256) r(b)),
crc AS (SELECT list(v ORDER BY b) AS v FROM crc_row),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
item AS (SELECT coalesce({_WORDS}, []) AS w FROM benchmark),
used AS (SELECT DISTINCT f FROM (SELECT unnest(w) AS f FROM doc UNION ALL SELECT unnest(w) FROM item)),
bytes AS (SELECT f, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS b FROM used),
hashed AS (SELECT f, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, v[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS s FROM (SELECT unnest(w) AS f FROM doc) JOIN hashed USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS f FROM item) JOIN hashed USING (f) GROUP BY 1),
gain AS (SELECT f, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000)
    / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS g
  FROM hashed LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (SELECT r, sum(g) AS weight FROM (SELECT r, unnest(w) AS f FROM doc) JOIN gain USING (f) GROUP BY r),
scored AS (SELECT r, doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM doc LEFT JOIN sums USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, n) AS place FROM scored WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, weight + noise AS score,
       CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM placed) THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)""",
    "op13_superminhash": r"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
cut AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 1, 1))) AS i FROM doc WHERE len(w) > 0),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 2], ' ') AS g FROM cut),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM gram a JOIN gram b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN part ON a = doc_id LEFT JOIN size USING (doc_id)""",
}

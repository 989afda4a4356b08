"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from redactlake.llm import decontam, exact, html_text, langid, prefix_bpe, repeats, sharding, simhash, token_output, toxicity
from redactlake.llm.common import in_fold, new_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _documents(spark, sf_dir):
    """The table; one that lies in fewer pieces than there are cores is dealt out."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def _add(f):
    QUERIES[f.__name__] = f
    return f


@_add
def op3_exact_dedup(spark, sf_dir):
    return exact.annotate(_documents(spark, sf_dir))


ORACLES["op3_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


@_add
def op5_sharding(spark, sf_dir):
    """Append documents in arrivals, compact as they come, and read the last version back; a merge at least once a tier is full."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = sharding.ShardStore(spark, new_path(spark, "shards"), docs.schema)
    for arrival in sharding.arrivals(docs):
        store.append(arrival)
        store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


ORACLES["op5_sharding"] = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


@_add
def op8_html_extraction(spark, sf_dir):
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_add
def op10_language_id(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs)
    return langid.predict(docs.select("doc_id", "text", in_fold().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


@_add
def op1_token_output(spark, sf_dir):
    """Ids of documents written in the file format, read back from the files."""
    out = new_path(spark, "token-files")
    token_output.write(_documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_digests(spark, out)


@_add
def op7_byte_bpe(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return prefix_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_add
def op4_decontamination(spark, sf_dir):
    return decontam.report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op4_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM v),
runs AS (
  SELECT doc_id, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes)),
found AS (SELECT doc_id, item_id, p, runs.m FROM runs JOIN v USING (m, s)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_add
def op2_simhash(spark, sf_dir):
    return simhash.classes(_documents(spark, sf_dir))


@_add
def op6_toxicity(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_add
def op9_repeated_passages(spark, sf_dir):
    return repeats.cut_repeats(_documents(spark, sf_dir))


ORACLES["op9_repeated_passages"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, c, n, substr(h, 2 * c + 1, 698) AS h FROM (SELECT doc_id, h, n, unnest(range(0, n - 49, 300)) AS c FROM d WHERE n >= 50)),
w AS (SELECT doc_id, c + q AS p, substr(h, 2 * q + 1, 100) AS s FROM (SELECT doc_id, c, h, unnest(range(0, least(300, n - 49 - c))) AS q FROM c)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hits AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE first < doc_id),
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g
        FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM hits))
  GROUP BY doc_id, g),
pieces AS (SELECT d.doc_id, a, b, substr(h, 2 * lag(b, 1, 0) OVER w + 1, 2 * (a - lag(b, 1, 0) OVER w)) AS piece FROM d JOIN runs USING (doc_id) WINDOW w AS (PARTITION BY d.doc_id ORDER BY a)),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS e, string_agg(piece, '' ORDER BY a) AS t FROM pieces GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(t, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

"""The engine's registered queries, each beside the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake import evaluate
from redactlake.engine import Engine
from redactlake.functions import checks
from redactlake.functions import text as T
from redactlake.operators import layout, native, rules, spans
from redactlake.plans import cases
from redactlake.plans.registry import query
from redactlake.sources import files
from redactlake.sources.markdown import render
from redactlake.streaming import jobs


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    """The table; one that lies in fewer pieces than there are cores is dealt out, as the engine is bound by CPUs."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def hits_sql(pattern: str, where: str = "true") -> str:
    """Offsets and values of a pattern in documents."""
    return f"""
      SELECT doc_id, CAST(coalesce(list_sum(list_transform(p[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS "start",
             CAST(coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) AS BIGINT) AS "end", p[k] AS value
      FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1, 2)) AS k
            FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(1), ' '), '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents))
      WHERE {where}"""


LUHN = """(list_sum(list_transform(range(1, length(NUMBER) + 1), lambda i: CASE WHEN i % 2 = 0 THEN
  (CASE WHEN 2 * CAST(substr(NUMBER, length(NUMBER) - CAST(i AS INT) + 1, 1) AS INT) > 9 THEN 2 * CAST(substr(NUMBER, length(NUMBER) - CAST(i AS INT) + 1, 1) AS INT) - 9
        ELSE 2 * CAST(substr(NUMBER, length(NUMBER) - CAST(i AS INT) + 1, 1) AS INT) END)
  ELSE CAST(substr(NUMBER, length(NUMBER) - CAST(i AS INT) + 1, 1) AS INT) END)) % 10 = 0)""".replace("NUMBER", "regexp_replace(p[k], '[^0-9]', '', 'g')")

FOUND = {
    "EMAIL_ADDRESS": (native.EMAIL, "true", 1.0),
    "IP_ADDRESS": (native.IPV4, "true", 0.95),
    "CREDIT_CARD": (native.CARD, LUHN, 1.0),
    "URL": (native.URL, "true", 0.6),
}
ALL_FOUND = " UNION ALL ".join(f"SELECT *, '{e}' AS entity, {s} AS score FROM ({hits_sql(p, w)})" for e, (p, w, s) in FOUND.items())


def _spans(spark, sf_dir, entity):
    found = native.detect(table(spark, sf_dir, "documents"), (entity,))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value")


@query("email_spans", hits_sql(*FOUND["EMAIL_ADDRESS"][:2]))
def email_spans(spark, sf_dir):
    return _spans(spark, sf_dir, "EMAIL_ADDRESS")


@query("ipv4_spans", hits_sql(*FOUND["IP_ADDRESS"][:2]))
def ipv4_spans(spark, sf_dir):
    return _spans(spark, sf_dir, "IP_ADDRESS")


@query("card_spans", hits_sql(*FOUND["CREDIT_CARD"][:2]))
def card_spans(spark, sf_dir):
    return _spans(spark, sf_dir, "CREDIT_CARD")


PRIORITY_SQL = "CASE entity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in spans.PRIORITY.items()) + " ELSE 0 END"


def merge_sql(source: str) -> str:
    return f"""
      SELECT doc_id, min("start") AS "start", max("end") AS "end", arg_max(entity, row(NOT from_ner, "end" - "start", score, prio, -rn)) AS entity, max(score) AS score
      FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY rn) AS grp
            FROM (SELECT *, {PRIORITY_SQL} AS prio, row_number() OVER w AS rn,
                         CASE WHEN max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > "start" THEN 0 ELSE 1 END AS fresh
                  FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY "start", "end" DESC, entity, score DESC, from_ner)))
      GROUP BY doc_id, grp"""


@query(
    "redact_documents",
    f"""WITH f AS (SELECT *, false AS from_ner FROM ({ALL_FOUND})), m AS ({merge_sql("f")}),
    pieces AS (
      SELECT d.doc_id, m."start" AS pos, substr(d.text, 1 + lag(m."end", 1, 0) OVER w, m."start" - lag(m."end", 1, 0) OVER w) || '[' || entity || ']' AS piece, m."end" AS e
      FROM documents d JOIN m USING (doc_id) WINDOW w AS (PARTITION BY d.doc_id ORDER BY m."start")),
    built AS (SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS t, max(e) AS e, count(*) AS n FROM pieces GROUP BY doc_id)
    SELECT d.doc_id, coalesce(b.n, 0) AS n_entities, CASE WHEN b.n IS NULL THEN d.text ELSE b.t || substr(d.text, b.e + 1) END AS text_redacted
    FROM documents d LEFT JOIN built b USING (doc_id)""",
)
def redact_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    merged = spans.merge_overlaps(native.detect(docs))
    counted = merged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entities"))
    return spans.redact(docs, merged).join(counted, "doc_id", "left").select("doc_id", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), "text_redacted")


@query(
    "entity_histogram",
    f"""SELECT entity, lang, source, count(*) AS n, count(DISTINCT value) AS n_values FROM ({ALL_FOUND}) JOIN documents USING (doc_id)
    GROUP BY ROLLUP (entity, lang, source)""",
)
def entity_histogram(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = native.detect(docs).join(docs.select("doc_id", "lang", "source"), "doc_id")
    return found.rollup("entity", "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


# Checksums, on numbers made of the tables' keys: every other one is made wrong.


@query(
    "national_number_check",
    """WITH b AS (SELECT c_custkey, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 13 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 33 AS VARCHAR), 2, '0')
                           || lpad(CAST(c_custkey % 997 AS VARCHAR), 3, '0') AS base FROM customer),
    n AS (SELECT c_custkey, base, 97 - CAST(base AS BIGINT) % 97 + c_custkey % 2 AS cc FROM b)
    SELECT c_custkey, base || lpad(CAST(cc AS VARCHAR), 2, '0') AS number,
      CAST(CASE WHEN CAST(substr(base, 5, 2) AS INT) > 31 THEN NULL
           WHEN cc = 97 - CAST(base AS BIGINT) % 97 OR cc = 97 - (CAST(base AS BIGINT) + 2000000000) % 97 THEN 1.0
           WHEN c_custkey % 3 = 0 THEN 0.75 ELSE 0.3 END AS DOUBLE) AS score FROM n""",
)
def national_number_check(spark, sf_dir):
    pad = lambda n, k: F.lpad((F.col("c_custkey") % n).cast("string"), k, "0")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(pad(100, 2), pad(13, 2), pad(33, 2), pad(997, 3)).alias("base"))
    check = 97 - F.col("base").cast("long") % 97 + F.col("c_custkey") % 2
    rows = rows.withColumn("number", F.concat("base", F.lpad(check.cast("string"), 2, "0")))
    return rows.select("c_custkey", "number", checks.national_number_score(F.col("number"), F.col("c_custkey") % 3 == 0).cast("double").alias("score"))


@query(
    "iban_check",
    """WITH b AS (SELECT s_suppkey, lpad(CAST(s_suppkey * 7919 % 10000000000 AS VARCHAR), 12, '0') AS bban FROM supplier),
    i AS (SELECT s_suppkey, 'BE' || lpad(CAST(98 - CAST(bban || '111400' AS HUGEINT) % 97 + s_suppkey % 2 AS VARCHAR), 2, '0') || bban AS iban FROM b)
    SELECT s_suppkey, iban, CAST(CASE WHEN CAST(substr(iban, 5) || '1114' || substr(iban, 3, 2) AS HUGEINT) % 97 = 1 THEN 1.0 ELSE 0.65 END AS DOUBLE) AS score FROM i""",
)
def iban_check(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lpad((F.col("s_suppkey") * 7919 % 10_000_000_000).cast("string"), 12, "0").alias("bban"))
    key = 98 - F.concat("bban", F.lit("111400")).cast("decimal(38,0)") % 97 + F.col("s_suppkey") % 2
    rows = rows.withColumn("iban", F.concat(F.lit("BE"), F.lpad(key.cast("int").cast("string"), 2, "0"), F.col("bban")))
    return rows.select("s_suppkey", "iban", checks.iban_score(F.col("iban")).cast("double").alias("score"))


@query(
    "enterprise_check",
    """WITH b AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 20000000 AS VARCHAR), 8, '0') AS base FROM orders),
    n AS (SELECT o_orderkey, base || lpad(CAST(97 - CAST(base AS BIGINT) % 97 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS VARCHAR), 2, '0') AS number FROM b)
    SELECT o_orderkey, number, 97 - CAST(substr(number, 1, 8) AS BIGINT) % 97 = CAST(substr(number, 9, 2) AS BIGINT) AS valid FROM n""",
)
def enterprise_check(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") % 20_000_000).cast("string"), 8, "0").alias("base"))
    check = 97 - F.col("base").cast("long") % 97 + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)
    rows = rows.withColumn("number", F.concat("base", F.lpad(check.cast("string"), 2, "0")))
    return rows.select("o_orderkey", "number", checks.enterprise_ok(F.col("number")).alias("valid"))


@query(
    "nir_check",
    """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '2' END || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '0' || CAST(1 + c_custkey % 9 AS VARCHAR)
                  || CASE WHEN c_custkey % 5 = 0 THEN '2A' WHEN c_custkey % 5 = 1 THEN '2B' ELSE '33' END || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '042' AS body FROM customer),
    n AS (SELECT c_custkey, body, 97 - CAST(replace(replace(body, '2A', '19'), '2B', '18') AS BIGINT) % 97 AS good FROM b),
    m AS (SELECT c_custkey, body || lpad(CAST(CASE WHEN c_custkey % 3 = 0 THEN good % 97 + 1 ELSE good END AS VARCHAR), 2, '0') AS nir, good FROM n)
    SELECT c_custkey, nir, good = CAST(substr(nir, 14, 2) AS BIGINT) AS valid FROM m""",
)
def nir_check(spark, sf_dir):
    k = F.col("c_custkey")
    part = F.when(k % 5 == 0, "2A").when(k % 5 == 1, "2B").otherwise("33")
    body = F.concat(
        F.when(k % 2 == 0, "1").otherwise("2"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("0"), (1 + k % 9).cast("string"), part, F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("042")
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))
    good = 97 - F.replace(F.replace("body", F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18")).cast("long") % 97
    rows = rows.withColumn("nir", F.concat("body", F.lpad(F.when(k % 3 == 0, good % 97 + 1).otherwise(good).cast("string"), 2, "0")))
    return rows.select("c_custkey", "nir", checks.nir_ok(F.col("nir")).alias("valid"))


@query(
    "id_card_check",
    """WITH b AS (SELECT p_partkey, lpad(CAST(p_partkey * 104729 % 10000000000 AS VARCHAR), 10, '0') AS base FROM part),
    n AS (SELECT p_partkey, base, coalesce(nullif(CAST(base AS BIGINT) % 97, 0), 97) AS good FROM b)
    SELECT p_partkey, base || lpad(CAST(CASE WHEN p_partkey % 2 = 0 THEN good ELSE good % 97 + 1 END AS VARCHAR), 2, '0') AS number,
           CAST(CASE WHEN p_partkey % 2 = 0 OR good % 97 + 1 = good THEN 0.9 ELSE 0.6 END AS DOUBLE) AS score FROM n""",
)
def id_card_check(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 104_729 % 10_000_000_000).cast("string"), 10, "0").alias("base"))
    rest = F.col("base").cast("long") % 97
    good = F.when(rest == 0, 97).otherwise(rest)
    rows = rows.withColumn("number", F.concat("base", F.lpad(F.when(F.col("p_partkey") % 2 == 0, good).otherwise(good % 97 + 1).cast("string"), 2, "0")))
    return rows.select("p_partkey", "number", F.when(checks.account_ok(F.col("number")), 0.9).otherwise(0.6).alias("score"))


@query(
    "ctx_boost",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN least(1.0, 0.3 + 0.45) WHEN o_orderkey % 3 = 1 THEN least(1.0, 0.9 + 0.35) ELSE 0.3 END AS DOUBLE) AS score FROM orders""",
)
def ctx_boost(spark, sf_dir):
    k = F.col("o_orderkey")
    before = F.when(k % 3 == 0, "titulaire de la carte d'identité n° ").when(k % 3 == 1, "passeport ").otherwise("commande ")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", before.alias("before"), F.when(k % 3 == 1, 0.9).otherwise(0.3).alias("base"))
    card = checks.boosted(F.col("base"), F.col("before"), r"(?iu)carte\s+d'identit[ée]", 0.45)
    return rows.select("o_orderkey", F.when(k % 3 == 1, checks.boosted(F.col("base"), F.col("before"), "(?iu)passeport", 0.35)).otherwise(card).alias("score"))


# Interval operators, on spans made of lineitem.

SPANS_SQL = """(SELECT l_orderkey AS doc_id, CAST((l_partkey * 7) % 400 AS BIGINT) AS "start", CAST((l_partkey * 7) % 400 + 1 + l_quantity AS BIGINT) AS "end",
  CASE l_returnflag WHEN 'A' THEN 'PERSON' WHEN 'N' THEN 'ADDRESS' ELSE 'IBAN_CODE' END AS entity, l_discount * 10 AS score, l_linestatus = 'O' AS from_ner,
  l_suppkey FROM lineitem)"""


def _made(spark, sf_dir):
    at = (F.col("l_partkey") * 7) % 400
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        at.cast("long").alias("start"),
        (at + 1 + F.col("l_quantity")).cast("long").alias("end"),
        F.when(F.col("l_returnflag") == "A", "PERSON").when(F.col("l_returnflag") == "N", "ADDRESS").otherwise("IBAN_CODE").alias("entity"),
        (F.col("l_discount") * 10).alias("score"),
        (F.col("l_linestatus") == "O").alias("from_ner"),
        F.lit("").alias("kind"),
        "l_suppkey",
    )


@query("merge_overlaps", merge_sql(SPANS_SQL))
def merge_overlaps(spark, sf_dir):
    return spans.merge_overlaps(_made(spark, sf_dir).drop("l_suppkey")).select("doc_id", "start", "end", "entity", "score")


ISLANDS_SQL = """SELECT doc_id, min("start") AS "start", max("end") AS "end" FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS grp FROM (
      SELECT *, CASE WHEN max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= "start" THEN 0 ELSE 1 END AS fresh
      FROM {source})) GROUP BY doc_id, grp"""


@query("union_intervals", ISLANDS_SQL.format(source=SPANS_SQL))
def union_intervals(spark, sf_dir):
    return spans.islands(_made(spark, sf_dir))


SIDES_SQL = f"""a AS (SELECT DISTINCT doc_id, "start", "end" FROM {SPANS_SQL} WHERE l_suppkey % 2 = 0), b AS (SELECT doc_id, "start", "end" FROM {SPANS_SQL} WHERE l_suppkey % 2 = 1)"""


def _sides(spark, sf_dir):
    made = _made(spark, sf_dir)
    cols = ["doc_id", "start", "end"]
    return made.where(F.col("l_suppkey") % 2 == 0).select(cols).distinct(), made.where(F.col("l_suppkey") % 2 == 1).select(cols)


@query("occupied_semi", f"""WITH {SIDES_SQL} SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b."start" < a."end" AND a."start" < b."end")""")
def occupied_semi(spark, sf_dir):
    return spans.occupied(*_sides(spark, sf_dir))


@query("occupied_anti", f"""WITH {SIDES_SQL} SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b."start" < a."end" AND a."start" < b."end")""")
def occupied_anti(spark, sf_dir):
    return spans.free(*_sides(spark, sf_dir))


@query(
    "subtract_protected",
    f"""WITH {SIDES_SQL}, z AS ({ISLANDS_SQL.format(source="b")}),
    cuts AS (SELECT doc_id, "start", "end", "start" AS p FROM a UNION SELECT a.doc_id, a."start", a."end", z."end" FROM a JOIN z USING (doc_id) WHERE z."end" > a."start" AND z."end" < a."end"),
    ends AS (SELECT c.*, coalesce((SELECT min(z."start") FROM z WHERE z.doc_id = c.doc_id AND z."start" >= c.p AND z."start" < c."end"), c."end") AS q FROM cuts c
             WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = c.doc_id AND z."start" <= c.p AND c.p < z."end"))
    SELECT DISTINCT doc_id, p AS "start", q AS "end" FROM ends WHERE p < q""",
)
def subtract_protected(spark, sf_dir):
    return spans.subtract(*_sides(spark, sf_dir)).distinct()


@query(
    "ocr_threshold",
    f"""WITH s AS (SELECT * FROM {SPANS_SQL}), o AS (SELECT doc_id, "start", "end" FROM s WHERE l_suppkey % 5 = 0)
    SELECT doc_id, "start", "end", score FROM s WHERE score >= 0.5 OR score >= 0.4 AND EXISTS (SELECT 1 FROM o WHERE o.doc_id = s.doc_id AND o."start" <= s."start" AND s."end" <= o."end")""",
)
def ocr_threshold(spark, sf_dir):
    made = _made(spark, sf_dir)
    return spans.threshold(made, made.where(F.col("l_suppkey") % 5 == 0)).select("doc_id", "start", "end", "score")


@query(
    "blocklist_union",
    hits_sql(r"\b(?:the|is)\b").replace("'(\\b", "'(?i)(\\b"),
)
def blocklist_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text"))
    own = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans.deny(docs, ["the", "is"])
    value = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return found.join(own, "doc_id").select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), value.alias("value"))


# Text operators.


@query(
    "markdown_render",
    """WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')) AS line,
                 unnest(range(1, 1 + len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')))) AS k FROM documents),
    m AS (SELECT doc_id, k, CASE WHEN k = 1 THEN '' WHEN line LIKE '|%' AND lag(line) OVER (PARTITION BY doc_id ORDER BY k) LIKE '|%' THEN chr(10) ELSE chr(10) || chr(10) END || line AS piece FROM l)
    SELECT d.doc_id, coalesce(string_agg(piece, '' ORDER BY k) || chr(10), '') AS markdown FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id""",
)
def markdown_render(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", render(F.col("text")).alias("markdown"))


@query("text_fold", f"SELECT doc_id, md5(upper(translate(replace(text, 'ß', 'ss'), '{T.ACCENTED}', '{T.PLAIN}'))) AS folded_md5 FROM documents")
def text_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded_md5"))


MENTIONS_SQL = """(SELECT c_custkey AS doc_id, 'VER' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABDEGIKMOU') AS a,
  CASE WHEN c_custkey % 3 = 0 THEN 'VER' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'ABDEGIKMOU') ELSE 'ZAN' || translate(CAST(c_custkey * 7 AS VARCHAR), '0123456789', 'ABDEGIKMOU') END AS b FROM customer)"""


def _mentions(spark, sf_dir):
    """Two people, of one surname in every third document, each named in full and then by surname."""
    own = lambda head, k: F.concat(F.lit(head), F.translate(k.cast("string"), "0123456789", "ABDEGIKMOU"))
    k = F.col("c_custkey")
    a = own("VER", k)
    b = F.when(k % 3 == 0, a).otherwise(own("ZAN", k * 7))
    text = F.concat(F.lit("Monsieur Luc "), a, F.lit(" voit Madame Anne "), b, F.lit(". Monsieur "), a, F.lit(" part. Madame "), b, F.lit(" reste."))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text"))


@query(
    "pseudonym_numbering",
    f"""WITH m AS (SELECT doc_id, length(a) AS a, length(b) AS b FROM {MENTIONS_SQL})
    SELECT doc_id, unnest([9, 26 + a, 42 + a + b, 56 + 2 * a + b]) AS "start", unnest([13 + a, 31 + a + b, 42 + 2 * a + b, 56 + 2 * a + 2 * b]) AS "end",
      unnest(['PERSONNE_1', 'PERSONNE_2', 'PERSONNE_1', 'PERSONNE_2']) AS label FROM m""",
)
def pseudonym_numbering(spark, sf_dir):
    """People of one document numbered by their first mention; titles tell two of one surname apart."""
    found = Engine().detect(_mentions(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label")


@query(
    "review_top_terms",
    """WITH w AS (SELECT p_partkey AS doc_id, 'Zor' || translate(CAST(p_partkey % 1000 AS VARCHAR), '0123456789', 'abdegikmou') AS a, 'Vank' || translate(CAST(p_size AS VARCHAR), '0123456789', 'abdegikmou') AS b, p_partkey % 4 AS n FROM part)
    SELECT doc_id, a AS term, n + 1 AS n, 1 AS rank FROM w UNION ALL SELECT doc_id, b, 1, 2 FROM w""",
)
def review_top_terms(spark, sf_dir):
    """Capitalised words that the engine leaves readable, for a reader: counted, in order of their first place."""
    k = F.col("p_partkey")
    own = lambda head, x: F.concat(F.lit(head), F.translate(x.cast("string"), "0123456789", "abdegikmou"))
    a, b = own("Zor", k % 1000), own("Vank", F.col("p_size"))
    text = F.concat(F.lit("on compare le style "), a, F.lit(" et le style "), b, F.repeat(F.concat(F.lit(", puis le style "), a), (k % 4).cast("int")), F.lit(" en salle."))
    docs = table(spark, sf_dir, "part").select(k.alias("doc_id"), text.alias("text")).repartition(spark.sparkContext.defaultParallelism)
    terms = Engine().redact_with_review(docs).select("doc_id", F.posexplode("review").alias("k", "t"))
    return terms.select("doc_id", "t.term", F.col("t.count").cast("long").alias("n"), (F.col("k") + 1).alias("rank"))


@query(
    "word_fidelity",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n]+')) AS word FROM documents),
    g AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '@|[0-9]{4}', '#', 'g'), '[^ \\t\\n]+')) AS word FROM documents),
    lost AS (SELECT * FROM w EXCEPT ALL SELECT * FROM g), made AS (SELECT * FROM g EXCEPT ALL SELECT * FROM w)
    SELECT doc_id, sum(l) AS n_lost, sum(m) AS n_made FROM (SELECT doc_id, 1 AS l, 0 AS m FROM lost UNION ALL SELECT doc_id, 0, 1 FROM made) GROUP BY doc_id""",
)
def word_fidelity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return evaluate.fidelity(docs, docs.withColumn("text", F.regexp_replace("text", "@|[0-9]{4}", "#")))


# Read words and page layout, on tables made of lineitem.

WORDS_SQL = """(SELECT l_orderkey AS doc_id, 0 AS image_no, CAST(l_suppkey % 3 AS INT) AS block, 0 AS par, CAST(l_partkey % 2 AS INT) AS line, CAST(l_linenumber AS INT) AS word_no, l_quantity * 2 AS conf,
  CASE WHEN l_partkey % 7 = 0 THEN '.' ELSE 'w' || CAST(l_partkey AS VARCHAR) END AS text FROM lineitem)"""


def _words(spark, sf_dir):
    text = F.when(F.col("l_partkey") % 7 == 0, ".").otherwise(F.concat(F.lit("w"), F.col("l_partkey").cast("string")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(0).alias("image_no"),
        (F.col("l_suppkey") % 3).cast("int").alias("block"),
        F.lit(0).alias("par"),
        (F.col("l_partkey") % 2).cast("int").alias("line"),
        F.col("l_linenumber").cast("int").alias("word_no"),
        (F.col("l_quantity") * 2).alias("conf"),
        text.alias("text"),
    )


LINES_SQL = f"""SELECT doc_id, block, line, string_agg(text, ' ' ORDER BY word_no, text) AS text, round(avg(conf), 6) AS conf,
    sum(CASE WHEN length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 3 AND conf >= 70 OR length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 2 AND conf >= 85 THEN 1 ELSE 0 END) AS solid, avg(conf) AS c, count(*) AS n
  FROM {WORDS_SQL} WHERE conf >= 30 GROUP BY doc_id, block, line
  HAVING sum(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) >= 2 AND avg(conf) >= 55"""


@query("ocr_line_filter", f"SELECT doc_id, block, line, text, conf, solid FROM ({LINES_SQL}) WHERE solid >= 1")
def ocr_line_filter(spark, sf_dir):
    return layout.ocr_lines(_words(spark, sf_dir)).select("doc_id", "block", "line", "text", F.round("conf", 6).alias("conf"), "solid")


@query(
    "ocr_image_text",
    f"""WITH l AS (SELECT * FROM ({LINES_SQL}) WHERE solid >= 1),
    p AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN lag(block) OVER w = block THEN chr(10) ELSE chr(10) || chr(10) END || text AS piece FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY block, line))
    SELECT doc_id, string_agg(piece, '' ORDER BY block, line) AS text, round(sum(c * n) / sum(n), 6) AS conf, sum(solid) AS solid FROM p GROUP BY doc_id""",
)
def ocr_image_text(spark, sf_dir):
    return layout.ocr_text(_words(spark, sf_dir)).select("doc_id", "text", F.round("conf", 6).alias("conf"), "solid")


@query(
    "margin_dedupe",
    """WITH r AS (SELECT l_orderkey % 100 AS doc_id, l_linenumber AS page, CAST(l_partkey AS DOUBLE) AS y0,
      CASE WHEN l_suppkey % 4 = 0 THEN 'Page ' || l_linenumber ELSE 'Case ' || (l_partkey % 5) || ' of ' || l_returnflag END AS text, CASE WHEN l_quantity < 25 THEN 'top' ELSE 'bottom' END AS zone, l_orderkey, l_suppkey FROM lineitem),
    d AS (SELECT DISTINCT doc_id, page, y0, text, zone FROM r),
    k AS (SELECT *, regexp_replace(lower(text), '[0-9]+', '#', 'g') AS key FROM d),
    n AS (SELECT doc_id, zone, key, count(DISTINCT page) AS pages FROM k GROUP BY ALL),
    o AS (SELECT k.*, pages, row_number() OVER (PARTITION BY doc_id, zone, key ORDER BY page, y0, text) AS rn FROM k JOIN n USING (doc_id, zone, key))
    SELECT doc_id, page, y0, text, zone, CASE WHEN text LIKE 'Page %' THEN 'page number' WHEN pages >= 2 AND rn > 1 THEN 'repeated' END AS reason FROM o""",
)
def margin_dedupe(spark, sf_dir):
    k = F.col
    text = F.when(k("l_suppkey") % 4 == 0, F.concat(F.lit("Page "), k("l_linenumber").cast("string"))).otherwise(F.concat(F.lit("Case "), (k("l_partkey") % 5).cast("string"), F.lit(" of "), k("l_returnflag")))
    rows = table(spark, sf_dir, "lineitem").select(
        (k("l_orderkey") % 100).alias("doc_id"), k("l_linenumber").alias("page"), k("l_partkey").cast("double").alias("y0"), text.alias("text"), F.when(k("l_quantity") < 25, "top").otherwise("bottom").alias("zone")
    )
    return layout.repeated_margins(rows.distinct()).select("doc_id", "page", "y0", "text", "zone", "reason")


@query(
    "page_right_margin",
    """WITH r AS (SELECT l_orderkey % 500 AS doc_id, l_linenumber AS page, l_partkey % 50 + 0.5 AS x0, l_partkey % 50 + 100 + l_quantity * 8 AS x1, repeat('x', CAST(l_quantity AS INT)) AS text, 600.0 AS width FROM lineitem),
    s AS (SELECT doc_id, page, round_even(x0, 0) AS x, count(*) AS n FROM r GROUP BY ALL),
    l AS (SELECT doc_id, page, arg_max(x, row(n, -x)) AS left_margin FROM s GROUP BY ALL),
    e AS (SELECT doc_id, page, list_sort(list(x1)) AS every, coalesce(list_sort(list(x1) FILTER (length(text) >= 20)), []) AS long FROM r GROUP BY ALL),
    u AS (SELECT doc_id, page, CASE WHEN len(long) > 0 THEN long ELSE every END AS v FROM e)
    SELECT doc_id, page, CAST(left_margin AS DOUBLE) AS left_margin, CAST(greatest(v[CAST(floor(0.9 * (len(v) - 1)) AS INT) + 1], left_margin + 0.55 * 600.0) AS DOUBLE) AS right_margin FROM l JOIN u USING (doc_id, page)""",
)
def page_right_margin(spark, sf_dir):
    k = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        (k("l_orderkey") % 500).alias("doc_id"),
        k("l_linenumber").alias("page"),
        (k("l_partkey") % 50 + 0.5).alias("x0"),
        (k("l_partkey") % 50 + 100 + k("l_quantity") * 8).alias("x1"),
        F.repeat(F.lit("x"), k("l_quantity").cast("int")).alias("text"),
        F.lit(600.0).alias("width"),
    )
    return layout.page_margins(rows).select("doc_id", "page", k("left_margin").cast("double").alias("left_margin"), k("right_margin").cast("double").alias("right_margin"))


@query(
    "page_row_text",
    """WITH s AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS row_no, CAST(l_partkey % 400 AS DOUBLE) AS x0, l_partkey % 400 + l_quantity AS x1, 's' || l_suppkey AS text FROM lineitem),
    p AS (SELECT *, row_number() OVER w AS k, x0 - lag(x1) OVER w AS gap FROM s WINDOW w AS (PARTITION BY doc_id, row_no ORDER BY x0, x1, text))
    SELECT doc_id, row_no, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap > 60 THEN chr(9) WHEN gap > 1.5 THEN ' ' ELSE '' END || text, '' ORDER BY k) AS text FROM p GROUP BY ALL""",
)
def page_row_text(spark, sf_dir):
    k = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        k("l_orderkey").alias("doc_id"),
        F.lit(0).alias("page"),
        (k("l_linenumber") % 2).cast("int").alias("row_no"),
        (k("l_partkey") % 400).cast("double").alias("x0"),
        (k("l_partkey") % 400 + k("l_quantity")).alias("x1"),
        F.lit(0.0).alias("y0"),
        F.lit(10.0).alias("y1"),
        F.concat(F.lit("s"), k("l_suppkey").cast("string")).alias("text"),
        F.lit(10.0).alias("size"),
        F.lit(False).alias("bold"),
        F.lit(600.0).alias("width"),
    )
    return layout.row_texts(rows, spread=None).select("doc_id", "row_no", "text")


@query(
    "page_rows_justified",
    """WITH s AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 300 AS DOUBLE) AS x0, l_partkey % 300 + l_quantity / 4 AS x1, 's' || l_suppkey AS text, 8.0 + l_linenumber AS size FROM lineitem),
    p AS (SELECT *, row_number() OVER w AS k, x0 - lag(x1) OVER w AS gap, greatest(size, lag(size) OVER w) AS size2 FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY x0, x1, text, size)),
    g AS (SELECT doc_id, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS v FROM p GROUP BY doc_id),
    e AS (SELECT doc_id, coalesce(len(v) >= 2 AND v[len(v)] <= 2.5 * greatest(v[len(v) // 2 + 1], 1.0), false) AS even FROM g)
    SELECT doc_id, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap > 60 AND NOT even THEN chr(9) WHEN gap > size2 * 0.15 THEN ' ' ELSE '' END || text, '' ORDER BY k) AS text FROM p JOIN e USING (doc_id) GROUP BY doc_id""",
)
def page_rows_justified(spark, sf_dir):
    """Rows whose gaps are about even are justified: no columns."""
    k = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        k("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("row_no"), (k("l_partkey") % 300).cast("double").alias("x0"), (k("l_partkey") % 300 + k("l_quantity") / 4).alias("x1"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"),
        F.concat(F.lit("s"), k("l_suppkey").cast("string")).alias("text"), (8.0 + k("l_linenumber")).alias("size"), F.lit(False).alias("bold"), F.lit(600.0).alias("width"),
    )
    return layout.row_texts(rows).select("doc_id", "text")


@query(
    "margin_zones",
    """SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey % 800 AS y0, CASE WHEN l_partkey % 800 + 10 <= 72 THEN 'top' WHEN l_partkey % 800 >= 728 THEN 'bottom' END AS zone FROM lineitem""",
)
def margin_zones(spark, sf_dir):
    k = F.col
    rows = table(spark, sf_dir, "lineitem").select(k("l_orderkey").alias("doc_id"), k("l_linenumber").alias("page"), (k("l_partkey") % 800).alias("y0"), (k("l_partkey") % 800 + 10).alias("y1"), F.lit(800).alias("height"))
    return layout.margin_zones(rows).select("doc_id", "page", "y0", "zone")


@query(
    "form_fields",
    """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 = 0 THEN p_name ELSE p_brand || ' : ' || p_name END AS text FROM part WHERE p_partkey % 7 <> 0 AND NOT (p_partkey % 5 = 0 AND p_partkey % 3 <> 0)""",
)
def form_fields(spark, sf_dir):
    """Fields with a label, without one, ticks and blank ones, and comments."""
    k = F.col("p_partkey")
    value = F.when(k % 7 == 0, "  ").when((k % 5 == 0) & (k % 3 != 0), "Yes").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    rows = table(spark, sf_dir, "part").select(
        k.alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("seq"), F.when(k % 3 == 0, "comment").otherwise("field").alias("kind"), F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("label"), value.alias("value")
    )
    return layout.form_rows(rows).select("doc_id", "text")


@query(
    "best_reading",
    """WITH r AS (SELECT c_custkey AS id, 40.0 + c_custkey % 60 AS p, 40.0 + c_custkey * 7 % 60 AS r, 40.0 + c_custkey * 11 % 60 AS s FROM customer),
    b AS (SELECT *, CASE WHEN p < 70 AND r > p THEN 'rotated' ELSE 'plain' END AS m, CASE WHEN p < 70 AND r > p THEN r ELSE p END AS c FROM r),
    f AS (SELECT *, c >= 60 AND (m = 'rotated' OR id % 13 <> 0) AS held FROM b)
    SELECT id AS doc_id, CASE WHEN held THEN m ELSE 'sparse' END AS mode, CASE WHEN held THEN c ELSE s END AS conf FROM f WHERE held OR s >= 75""",
)
def best_reading(spark, sf_dir):
    k = F.col("c_custkey")
    conf = lambda x: (40.0 + x % 60).cast("double")
    text = lambda mode: F.when(k % 13 == 0, F.lit("." if mode == "plain" else mode)).otherwise(F.lit(mode))
    readings = F.array(*[F.struct(F.lit(m).alias("mode"), text(m).alias("text"), conf(x).alias("conf"), F.lit(1).alias("solid")) for m, x in (("plain", k), ("rotated", k * 7), ("sparse", k * 11))])
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit(0).alias("image_no"), F.inline(readings))
    return layout.best_reading(rows).select("doc_id", "mode", "conf")


@query(
    "image_frames",
    """WITH p AS (SELECT p_partkey, p_name || '.' || CASE p_partkey % 3 WHEN 0 THEN 'TIFF' WHEN 1 THEN 'gif' ELSE 'png' END AS file_name, p_size % 40 AS n, p_partkey % 3 AS kind FROM part)
    SELECT file_name, CAST(unnest(range(0, CASE WHEN kind = 0 THEN least(n, 31) ELSE least(n, 1) END)) AS INT) AS frame FROM p""",
)
def image_frames(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("."), F.element_at(F.array(*map(F.lit, ("TIFF", "gif", "png"))), (k % 3).cast("int") + 1)).alias("file_name"), (F.col("p_size") % 40).alias("n_frames"))
    return files.image_frames(rows, limit=30)


def _images(spark, sf_dir):
    k = F.col
    return table(spark, sf_dir, "lineitem").select(
        (k("l_orderkey") % 20).alias("doc_id"), k("l_linenumber").alias("page"), k("l_orderkey").alias("seq"), k("l_partkey").alias("xref"), k("l_quantity").alias("w"), (k("l_suppkey") % 30).alias("h")
    )


@query(
    "ocr_budget",
    """WITH i AS (SELECT l_orderkey % 20 AS doc_id, l_linenumber AS page, l_orderkey AS seq, l_partkey AS xref, l_quantity AS w, l_suppkey % 30 AS h FROM lineitem),
    m AS (SELECT *, CASE WHEN w < 30 OR h < 12 THEN 'too small' WHEN row_number() OVER (PARTITION BY doc_id, xref ORDER BY page, seq) > 1 THEN 'seen' END AS why FROM i)
    SELECT doc_id, page, seq, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY doc_id, why IS NULL ORDER BY page, seq) > 300 THEN 'over the budget' ELSE 'read' END) AS verdict FROM m""",
)
def ocr_budget(spark, sf_dir):
    """Each xref's first image stands for it, whatever its size."""
    return layout.images_to_read(_images(spark, sf_dir), small_count=True).select("doc_id", "page", "seq", "verdict")


@query(
    "images_to_read",
    """WITH i AS (SELECT l_orderkey % 20 AS doc_id, l_linenumber AS page, l_orderkey AS seq, l_partkey AS xref, l_quantity AS w, l_suppkey % 30 AS h, l_quantity >= 30 AND l_suppkey % 30 >= 12 AS large FROM lineitem),
    m AS (SELECT *, CASE WHEN NOT large THEN 'too small' WHEN row_number() OVER (PARTITION BY doc_id, xref, large ORDER BY page, seq, w DESC, h DESC) > 1 THEN 'seen' END AS why FROM i)
    SELECT doc_id, page, seq, xref, w, h, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY doc_id, why IS NULL ORDER BY page, seq, w DESC, h DESC) > 300 THEN 'over the budget' ELSE 'read' END) AS verdict FROM m""",
)
def images_to_read(spark, sf_dir):
    return layout.images_to_read(_images(spark, sf_dir))


@query(
    "markdown_tables",
    """WITH c AS (SELECT l_orderkey AS doc_id, (l_linenumber * 10000000 + l_partkey) * 10000 + l_suppkey AS row_no, CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE 'a|' || l_partkey END AS a, CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE l_returnflag END AS b FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS k FROM c WHERE a <> '')
    SELECT doc_id, string_agg('| ' || replace(a, '|', '\\|') || ' | ' || b || ' |' || CASE WHEN k = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY k) AS markdown FROM r GROUP BY doc_id""",
)
def markdown_tables(spark, sf_dir):
    k = F.col
    rows = table(spark, sf_dir, "lineitem")
    text = F.when(k("l_suppkey") % 6 == 0, F.array(F.lit(""), F.lit(""))).otherwise(F.array(F.concat(F.lit("a|"), k("l_partkey").cast("string")), k("l_returnflag")))
    cells = rows.select(k("l_orderkey").alias("doc_id"), F.lit(0).alias("table_no"), ((k("l_linenumber") * 10_000_000 + k("l_partkey")) * 10_000 + k("l_suppkey")).alias("row_no"), F.posexplode(text).alias("col_no", "text"))
    return layout.markdown_tables(cells).select("doc_id", "markdown")


@query(
    "list_numbering",
    """SELECT n, CASE WHEN n < 10 THEN '0' || n ELSE CAST(n AS VARCHAR) END AS zero, n || CASE WHEN n = 1 THEN 'er' ELSE 'e' END AS ordinal, CASE WHEN n > 26 THEN chr(CAST(96 + (n - 1) // 26 AS INT)) ELSE '' END || chr(CAST(97 + (n - 1) % 26 AS INT)) AS letters,
      repeat('c', CAST(n // 100 AS INT)) || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][CAST(n % 100 // 10 AS INT) + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][CAST(n % 10 AS INT) + 1] AS roman
    FROM (SELECT DISTINCT s_suppkey % 300 + 1 AS n FROM supplier)""",
)
def list_numbering(spark, sf_dir):
    n = F.col("n")
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 300 + 1).alias("n")).distinct()
    style = lambda s: T.list_number(n, F.lit(s))
    return rows.select("n", style("decimalZero").alias("zero"), style("ordinal").alias("ordinal"), style("lowerLetter").alias("letters"), style("lowerRoman").alias("roman"))


@query(
    "json_requests",
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 400 WHEN o_orderkey % 4 = 1 THEN 400 ELSE 200 END AS status, CASE WHEN o_orderkey % 4 > 1 THEN o_orderpriority END AS text,
      CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS n_deny FROM orders""",
)
def json_requests(spark, sf_dir):
    k = F.col("o_orderkey")
    body = (
        F.when(k % 4 == 0, F.lit("[1]"))
        .when(k % 4 == 1, F.lit('{"text": " "}'))
        .when(k % 4 == 2, F.to_json(F.struct(F.col("o_orderpriority").alias("text"))))
        .otherwise(F.to_json(F.struct(F.col("o_orderpriority").alias("text"), F.array(F.lit("x")).alias("blocklist"))))
    )
    found = files.requests(table(spark, sf_dir, "orders").select(k.alias("doc_id"), body.alias("body")))
    return found.select("doc_id", "status", F.when(F.col("status") == 200, F.col("text")).alias("text"), F.size("deny").alias("n_deny"))


@query("file_routing", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' WHEN 3 THEN NULL WHEN 4 THEN 'image' ELSE NULL END AS kind,
      CASE p_partkey % 6 WHEN 3 THEN 'save the file as .docx' END AS hint, 'a-' || replace(p_name, '"', '_') || '.md' AS out_name FROM part""")
def file_routing(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("TXT", "docx", "Pdf", "odt", "png", "")])
    name = F.concat(F.lit("C:\\up/"), F.col("p_name"), F.lit("."), kinds[(F.col("p_partkey") % 6).cast("int")])
    why = files.refusal(name, F.lit(10))
    return table(spark, sf_dir, "part").select("p_partkey", files.route(name).alias("kind"), F.when(why.startswith("save"), why).alias("hint"), T.download_name(name).alias("out_name"))


JUNK_SQL = "'" + T.EDGE_JUNK.replace("'", "''") + "'"


@query(
    "text_scalars",
    f"""WITH x AS (SELECT c_custkey, c_name, ', («' || c_name || '»)!' AS framed FROM customer)
    SELECT c_custkey, length(framed) - length(ltrim(framed, {JUNK_SQL})) AS front, length(framed) - length(rtrim(framed, {JUNK_SQL})) AS back, translate(c_name, '#', ' ') AS blanks,
      replace(format('{{:,}}', CAST(c_custkey * 12345 AS BIGINT)), ',', ' ') AS thousands, 'RG 0' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '1 Ol' AS repaired, lower(c_name) || ' x' AS term FROM x""",
)
def text_scalars(spark, sf_dir):
    """Junk at the edges, odd blanks, thousands, digits read as letters, terms of lists."""
    framed = F.concat(F.lit(", («"), "c_name", F.lit("»)!"))
    front, back = T.edge_offsets(framed)
    token = F.concat(F.lit("RG O"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("l Ol"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", front.alias("front"), back.alias("back"), T.same_length_blanks(F.translate("c_name", "#", "\u00a0")).alias("blanks"), T.thousands(F.col("c_custkey") * 12345).alias("thousands"),
        T.repair_digits(token).alias("repaired"), T.list_term(F.concat(F.lit(" "), "c_name", F.lit("\t x "))).alias("term"),
    )


@query(
    "context_scores",
    f"""WITH h AS ({hits_sql(*FOUND["IP_ADDRESS"][:2])}), b AS (SELECT h.*, substr(replace(text, chr(1), ' '), CAST(greatest("start" - 60, 0) + 1 AS INT), CAST("start" - greatest("start" - 60, 0) AS INT)) AS before FROM h JOIN documents USING (doc_id))
    SELECT doc_id, "start", CAST(CASE WHEN regexp_matches(before, 'th') THEN 1.0 ELSE 0.95 END AS DOUBLE) AS score FROM b""",
)
def context_scores(spark, sf_dir):
    """Scores of found addresses, raised where the sixty characters before them hold a word."""
    docs = table(spark, sf_dir, "documents")
    return native.with_context(native.detect(docs, ("IP_ADDRESS",)), docs, "th").select("doc_id", F.col("start").cast("long").alias("start"), "score")


@query(
    "image_has_text",
    """SELECT l_orderkey AS doc_id, l_partkey AS image_no FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_quantity * 2 + 0.5 >= 60 AND l_partkey % 7 <> 0""",
)
def image_has_text(spark, sf_dir):
    k = F.col
    text = F.when(k("l_partkey") % 7 == 0, "a.").otherwise(F.concat(F.lit("- w"), (k("l_partkey") % 7 + 10).cast("string"), F.lit(" -")))
    rows = table(spark, sf_dir, "lineitem").select(k("l_orderkey").alias("doc_id"), k("l_partkey").alias("image_no"), text.alias("text"), (k("l_suppkey") % 3).alias("solid"), (k("l_quantity") * 2 + 0.5).alias("conf"))
    return layout.has_text(rows).select("doc_id", "image_no")


@query(
    "native_copies",
    """WITH p AS (SELECT p_partkey AS doc_id, 'Own' || p_partkey % 5 || ' two' || p_partkey % 3 || ' a' || p_size || ' xy' AS image, 'own1 two2 a' || p_size % 20 || ' other' AS page FROM part),
    w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(image), '[a-z0-9]{3,}')) AS i, list_distinct(regexp_extract_all(lower(page), '[a-z0-9]{3,}')) AS o FROM p)
    SELECT doc_id FROM w WHERE len(i) > 0 AND len(list_intersect(i, o)) >= 0.6 * len(i)""",
)
def native_copies(spark, sf_dir):
    """Images of whose words the page itself has most."""
    k, text = F.col("p_partkey"), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    part = table(spark, sf_dir, "part")
    images = part.select(k.alias("doc_id"), F.lit(0).alias("image_no"), text("Own", k % 5, " two", k % 3, " a", F.col("p_size"), " xy").alias("text"))
    pages = part.select(k.alias("doc_id"), text("own1 two2 a", F.col("p_size") % 20, " other").alias("text"))
    return layout.native_copies(images, pages).select("doc_id")


@query(
    "document_vocabulary",
    """WITH l AS (SELECT p_partkey % 100 AS doc_id, unnest([p_brand || ' over-all' || ' cut-', 'off the' || p_type || ' 7']) AS line FROM part), w AS (SELECT doc_id, lower(regexp_replace(line, '[A-Za-z]+-\s*$', '')) AS line FROM l)
    SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(line, '[a-z]{2,}'), regexp_extract_all(line, '[a-z]+(?:-[a-z]+)+'))) AS word FROM w) GROUP BY ALL""",
)
def document_vocabulary(spark, sf_dir):
    """Words of each document, without halves at a line's end."""
    lines = F.array(F.concat("p_brand", F.lit(" over-all cut-")), F.concat(F.lit("off the"), "p_type", F.lit(" 7")))
    return layout.vocabulary(table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("doc_id"), lines.alias("lines")))


@query(
    "pages_to_read",
    """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 5 = 0 THEN 'page' WHEN p_size % 3 = 0 THEN 'none' WHEN p_size < 25 THEN 'page' ELSE 'images' END AS verdict FROM part""",
)
def pages_to_read(spark, sf_dir):
    """Pages whose text can't be read, or which hold hardly any beside drawings, are read whole."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.repeat(F.lit("\ue000 x"), 15)).otherwise(F.concat(F.lit(" . "), F.repeat(F.lit("a "), F.col("p_size"))))
    return layout.pages_to_read(table(spark, sf_dir, "part").select(k.alias("doc_id"), F.lit(0).alias("page"), text.alias("text"), (F.col("p_size") % 3).alias("drawings"))).select("doc_id", "verdict")


@query(
    "garbled_text",
    r"""WITH s AS (SELECT doc_id, regexp_replace(text, '[ \t\n\r\x0b\f]', '', 'g') AS s FROM documents),
    n AS (SELECT doc_id, length(s) AS n, length(regexp_replace(s, '[\p{Co}\p{Cc}\x{FFFD}]|[^\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}\p{C}]', '', 'g')) AS fair FROM s)
    SELECT doc_id, n >= 20 AND (n - fair) * 5 > n AS plain, n >= 20 AS broken FROM n""",
)
def garbled_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    broken = F.regexp_replace("text", r"[^\s]", "\ufffd")
    return docs.select("doc_id", T.garbled(F.col("text")).alias("plain"), T.garbled(broken).alias("broken"))


# Document-wide operators on text made of the tables.


@query(
    "propagate_identifiers",
    """WITH d AS (SELECT o_custkey AS doc_id, string_agg('R' || o_orderkey, ' ; ' ORDER BY o_orderkey) AS l, min(o_orderkey) AS k FROM orders GROUP BY o_custkey)
    SELECT doc_id, pos AS "start", pos + length('R' || k || 'X') AS "end" FROM (SELECT doc_id, k, unnest([0, length(l) * 2 + 6 + length('R' || k || 'X') + 3]) AS pos FROM d) WHERE length('R' || k || 'X') >= 4""",
)
def propagate_identifiers(spark, sf_dir):
    """A number that is marked at a document's start is found again near its end, and not inside a longer one."""
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    line = F.array_join(F.transform("o", lambda x: F.concat(F.lit("R"), x.cast("string"))), " ; ")
    own = F.concat(F.lit("R"), F.col("o")[0].cast("string"), F.lit("X"))
    docs = grouped.select("doc_id", own.alias("own"), F.concat_ws(" ; ", own, line, line, own, F.concat(own, F.lit("/2"))).alias("text"))
    first = docs.where(F.length("own") >= 4).select("doc_id", F.lit(0).alias("start"), F.length("own").alias("end"), F.lit("FR_NUM_ROLE").alias("entity"), F.lit(0.95).alias("score"), F.lit(False).alias("from_ner"), F.lit("").alias("kind"))
    return spans.propagate(docs.select("doc_id", "text"), first).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    "split_lines",
    """WITH d AS (SELECT c_custkey AS doc_id, c_name || chr(10) || c_mktsegment || chr(10) || ' ' || chr(10) || 'end' AS text, length(c_name) AS a, length(c_mktsegment) AS b FROM customer)
    SELECT doc_id, unnest([2, a + 1, a + b + 4]) AS "start", unnest([a, a + 1 + b, a + b + 7]) AS "end" FROM d""",
)
def split_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat_ws("\n", "c_name", "c_mktsegment", F.lit(" "), F.lit("end")).alias("text"))
    whole = docs.select("doc_id", F.lit(2).alias("start"), F.length("text").alias("end"), F.lit("PERSON").alias("entity"), F.lit(0.9).alias("score"), F.lit(True).alias("from_ner"), F.lit("").alias("kind"))
    return spans.split_lines(whole, docs).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("allowlist_antijoin", f"SELECT * FROM ({hits_sql('CC BY|[A-Z][a-z]{3,8}')}) WHERE NOT contains(' cc by the that ', ' ' || lower(value) || ' ')")
def allowlist_antijoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = native.hits(docs, "CC BY|[A-Z][a-z]{3,8}")
    shaped = found.select("doc_id", "start", "end", F.lit("FR_NOM_PROPRE").alias("entity"), F.lit(0.6).alias("score"), F.lit(False).alias("from_ner"), F.lit("").alias("kind"), "value")
    left = spans.allow(shaped, docs, ["CC BY The That"])
    return left.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value")


@query(
    "leak_rate",
    """WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '[PERSONNE]' END || ' lives in ' || c_mktsegment AS redacted, c_name, c_mktsegment FROM customer),
    t AS (SELECT c_custkey % 10 AS document, 1 AS m, CASE WHEN contains(redacted, c_name) THEN 1 ELSE 0 END AS leaked, 1 AS k, CASE WHEN contains(redacted, c_mktsegment) THEN 0 ELSE 1 END AS missing FROM o)
    SELECT CAST(c AS VARCHAR) AS document, sum(m) AS mask_total, sum(leaked) AS leaked, sum(k) AS keep_total, sum(missing) AS missing FROM (SELECT document AS c, m, leaked, k, missing FROM t) GROUP BY ROLLUP (c)""",
)
def leak_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("redacted", F.concat(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("[PERSONNE]"), F.lit(" lives in "), F.col("c_mktsegment")))
    values = F.explode(F.array(F.struct(F.lit("mask").alias("kind"), F.col("c_name").alias("value")), F.struct(F.lit("keep").alias("kind"), F.col("c_mktsegment").alias("value")))).alias("v")
    outputs = rows.select(F.col("c_custkey").cast("string").alias("document"), "redacted")
    notes = rows.select(F.col("c_custkey").cast("string").alias("document"), values).select("document", "v.*")
    found = evaluate.checks(outputs, notes).withColumn("document", (F.col("document").cast("long") % 10).cast("string"))
    return evaluate.totals(found)


# Jobs and progress.


@query(
    "keepalive_gaps",
    """SELECT user_id AS key, event_id AS seq, silence_us // 10000000 AS keepalives FROM (
      SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS silence_us FROM events) WHERE silence_us >= 10000000""",
)
def keepalive_gaps(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    return jobs.keepalives(events).select("key", "seq", "keepalives")


@query(
    "job_slots",
    """WITH j AS (SELECT user_id % 5 AS key, epoch_us(ts) AS s, epoch_us(ts) + CAST(event_id % 600 + 1 AS BIGINT) * 1000000 AS e FROM events),
    x AS (SELECT key, s AS ts, 1 AS d FROM j UNION ALL SELECT key, e, -1 FROM j), b AS (SELECT key, ts, sum(d) AS d, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS started FROM x GROUP BY ALL)
    SELECT key, ts, started, running FROM (SELECT *, sum(d) OVER (PARTITION BY key ORDER BY ts) AS running FROM b) WHERE started > 0""",
)
def job_slots(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    own = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("key"), start.alias("start"), (start + (F.col("event_id") % 600 + 1) * 1_000_000).alias("end"))
    return jobs.running(own).select("key", "ts", "started", "running")


@query(
    "progress_counters",
    """SELECT user_id AS key, event_id AS seq, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done, count(*) OVER (PARTITION BY user_id, event_type) AS total FROM events""",
)
def progress_counters(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("stage"), "ts", F.col("event_id").alias("seq"))
    return jobs.progress(events).select("key", "seq", "done", "total")


@query(
    "bounded_slots",
    """WITH RECURSIVE j AS (SELECT event_id // 200 AS key, event_id AS seq, epoch_us(ts) AS arrival, CAST(event_id % 6000 + 1 AS BIGINT) * 1000000 AS micros, row_number() OVER (PARTITION BY event_id // 200 ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT key, seq, arrival, k, arrival AS began, list_sort([arrival + micros, CAST(0 AS BIGINT)]) AS ends FROM j WHERE k = 1
      UNION ALL SELECT j.key, j.seq, j.arrival, j.k, greatest(j.arrival, ends[1]), list_sort([greatest(j.arrival, ends[1]) + j.micros, ends[2]]) FROM r JOIN j ON j.key = r.key AND j.k = r.k + 1)
    SELECT key, seq, began, began > arrival AS queued FROM r""",
)
def bounded_slots(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    own = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 200).alias("key"), F.col("event_id").alias("seq"), start.alias("arrival"), ((F.col("event_id") % 6000 + 1) * 1_000_000).cast("long").alias("micros"))
    return jobs.slots(own, 2).select("key", "seq", "began", "queued")


@query(
    "progress_throttle",
    """WITH RECURSIVE e AS (SELECT user_id AS key, event_type AS stage, epoch_us(ts) AS t, event_id AS seq, row_number() OVER w AS k, row_number() OVER w = count(*) OVER (PARTITION BY user_id, event_type) AS last
      FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
    g AS (SELECT key, stage, t, seq, k, last, true AS spaced, t AS sent_at FROM e WHERE k = 1
      UNION ALL SELECT e.key, e.stage, e.t, e.seq, e.k, e.last, e.t - sent_at >= 3600000000, CASE WHEN e.t - sent_at >= 3600000000 THEN e.t ELSE sent_at END
      FROM g JOIN e ON e.key = g.key AND e.stage = g.stage AND e.k = g.k + 1)
    SELECT key, stage, seq, spaced OR last AS sent FROM g""",
)
def progress_throttle(spark, sf_dir):
    """A greedy choice in order of time."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    return jobs.throttle(events, 3600.0).select("key", "stage", "seq", "sent")


# The whole engine; its rules look around matches, which the SQL engine can't.


@query("engine_detect")
def engine_detect(spark, sf_dir):
    return Engine().detect(documents(spark, sf_dir))


@query("engine_redact_with_review")
def engine_redact_with_review(spark, sf_dir):
    return Engine().redact_with_review(documents(spark, sf_dir))


@query("engine_analyze")
def engine_analyze(spark, sf_dir):
    return Engine().analyze(documents(spark, sf_dir), allow=["CC BY"], deny=["from the"])


PARTS_SQL = """(SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, l_partkey % 5 = 0 AS person, l_suppkey % 3 = 0 AS address, l_quantity AS q FROM lineitem)"""


def _parts(spark, sf_dir):
    """Texts of words of six letters, a blank, a comma and a blank, or a full stop apart; each word a span."""
    own = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(own.alias("w"))
    person = lambda x: x["l_partkey"] % 5 == 0
    entity = lambda x: F.when(person(x), "PERSON").when(x["l_suppkey"] % 3 == 0, "ADDRESS").otherwise("LOCATION")
    gap = lambda x: F.when(x["l_quantity"] < 10, F.lit(" xx ")).when(x["l_quantity"] < 40, F.lit(", ")).otherwise(F.lit(" ~~~~~ "))
    pieces = F.transform("w", lambda x: F.concat(F.when(person(x), "Abcdef").otherwise("Ghijkl"), gap(x)))
    docs = rows.select("doc_id", F.array_join(pieces, "").alias("text"))
    sizes = F.transform("w", lambda x: 6 + F.length(gap(x)))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    shaped = F.transform("w", lambda x, i: F.struct(F.element_at("ends", i + 1).alias("start"), (F.element_at("ends", i + 1) + 6).alias("end"), entity(x).alias("entity")))
    found = rows.withColumn("ends", ends).select("doc_id", F.inline(shaped)).select("doc_id", "start", "end", "entity", F.lit(0.5).alias("score"), F.lit(False).alias("from_ner"), F.lit("").alias("kind"))
    return docs, found


@query(
    "merge_adjacent",
    f"""WITH p AS (SELECT *, CASE WHEN q < 10 THEN 4 WHEN q < 40 THEN 2 ELSE 7 END AS gap, CASE WHEN person THEN 'PERSON' WHEN address THEN 'ADDRESS' ELSE 'LOCATION' END AS entity FROM {PARTS_SQL}),
    o AS (SELECT *, CAST(coalesce(sum(6 + gap) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, lag(gap) OVER (PARTITION BY doc_id ORDER BY k) AS before, lag(person) OVER (PARTITION BY doc_id ORDER BY k) AS other FROM p),
    r AS (SELECT *, sum(CASE WHEN before = 2 AND NOT person AND NOT other THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM o),
    f AS (SELECT *, min(CASE WHEN entity = 'ADDRESS' THEN k END) OVER (PARTITION BY doc_id, run) AS first FROM r),
    g AS (SELECT *, CASE WHEN first IS NULL OR k < first - 1 THEN k ELSE -1 END AS own FROM f)
    SELECT doc_id, min(pos) AS "start", max(pos) + 6 AS "end", CASE WHEN own = -1 THEN 'ADDRESS' ELSE max(entity) END AS entity FROM g GROUP BY doc_id, run, own""",
)
def merge_adjacent(spark, sf_dir):
    """Parts of addresses join over a comma from the first address on, and what stands just before it; over other gaps, and single names, nothing does."""
    docs, found = _parts(spark, sf_dir)
    return spans.merge_adjacent(found, docs).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "entity")


@query(
    "page_visual_rows",
    """WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0) AS k FROM (
      SELECT l_orderkey // 50 AS doc_id, l_linenumber % 2 AS page, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(l_suppkey % 90 * 8 AS DOUBLE) AS y0, CAST(l_suppkey % 90 * 8 + 10 + l_partkey % 4 AS DOUBLE) AS y1 FROM lineitem)),
    f AS (SELECT doc_id, page, x0, y0, y1, k, 0 AS row_no, y0 AS top, y1 AS bottom FROM s WHERE k = 1
      UNION ALL SELECT doc_id, page, x0, y0, y1, k, row_no + CASE WHEN apart THEN 1 ELSE 0 END, CASE WHEN apart THEN y0 ELSE least(top, y0) END, CASE WHEN apart THEN y1 ELSE greatest(bottom, y1) END
      FROM (SELECT s.*, f.row_no, f.top, f.bottom, least(s.y1, f.bottom) - greatest(s.y0, f.top) < 0.5 * least(s.y1 - s.y0, f.bottom - f.top) AS apart
            FROM f JOIN s ON s.doc_id = f.doc_id AND s.page = f.page AND s.k = f.k + 1))
    SELECT doc_id, page, x0, y0, row_no FROM f""",
)
def page_visual_rows(spark, sf_dir):
    k = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        F.floor(k("l_orderkey") / 50).alias("doc_id"), (k("l_linenumber") % 2).alias("page"), (k("l_partkey") % 400).cast("double").alias("x0"), (k("l_suppkey") % 90 * 8).cast("double").alias("y0"),
        (k("l_suppkey") % 90 * 8 + 10 + k("l_partkey") % 4).cast("double").alias("y1"),
    )
    return layout.visual_rows(rows).select("doc_id", "page", "x0", "y0", "row_no")


# The engine on made documents: each is one of the cases, whose redaction is known.


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chosen_sql(key: str, texts: list[str]) -> str:
    return f"CASE CAST({key} % {len(texts)} AS INT) " + " ".join(f"WHEN {i} THEN {quoted(t)}" for i, t in enumerate(texts)) + " END"


def _chosen(key, texts: list[str]):
    return F.element_at(F.array(*map(F.lit, texts)), (key % len(texts)).cast("int") + 1)


@query("engine_cases", f"SELECT o_orderkey AS doc_id, {chosen_sql('o_orderkey', [want for _, want in cases.REDACTED])} AS text_redacted FROM orders")
def engine_cases(spark, sf_dir):
    """Identifiers, names and addresses through the whole engine, and texts in which nothing may be found."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), _chosen(F.col("o_orderkey"), [t for t, _ in cases.REDACTED]).alias("text"))
    return Engine().redact(docs.repartition(spark.sparkContext.defaultParallelism)).select("doc_id", "text_redacted")


@query("engine_decisions", f"SELECT c_custkey AS doc_id, {chosen_sql('c_custkey', [x[3] for x in cases.DECIDED])} AS text_redacted, {chosen_sql('c_custkey', [x[4] for x in cases.DECIDED])} AS reason FROM customer")
def engine_decisions(spark, sf_dir):
    """What becomes of a model's spans: masked, as what, or kept, with the reason that a reader is told."""
    key = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(key.alias("doc_id"), _chosen(key, [x[0] for x in cases.DECIDED]).alias("text"))
    at = [x[0].rindex(x[1]) for x in cases.DECIDED]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (key % len(cases.DECIDED)).cast("int") + 1)
    model = table(spark, sf_dir, "customer").select(
        key.alias("doc_id"), pick(at).alias("start"), pick([a + len(x[1]) for a, x in zip(at, cases.DECIDED, strict=True)]).alias("end"), pick([x[2] for x in cases.DECIDED]).alias("entity"), F.lit(0.9).alias("score")
    )
    done = Engine().process(docs, model_spans=model)
    return done.select("doc_id", "text_redacted", F.array_join("kept", "; ").alias("reason"))


TWINS = {"EMAIL_ADDRESS": "R20", "IP_ADDRESS": "IP", "CREDIT_CARD": "CARD"}


@query("twin_rules", f"SELECT entity, count(*) AS n, count(*) AS n_both FROM ({ALL_FOUND}) WHERE entity <> 'URL' GROUP BY entity")
def twin_rules(spark, sf_dir):
    """Values that Catalyst's detectors find, and how many of them the engine's own rules find too."""
    docs = documents(spark, sf_dir)
    names = {r: e for e, r in TWINS.items()}

    def run(batches):
        import pyarrow as pa

        own = [r for r in rules.RULES if r.id in names]
        for batch in batches:
            rows = [(k, f.start, names[f.rule]) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in own for f in r.find(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "start", "entity"])

    ruled = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start int, entity string").withColumn("both", F.lit(1))
    found = native.detect(docs, tuple(TWINS)).join(ruled, ["doc_id", "start", "entity"], "left")
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count("both").alias("n_both"))

"""The DataFrame interface, tables of spans, files and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from redactlake.config import EngineConfig
from redactlake.engine import Engine
from redactlake.functions import text as T
from redactlake.operators import layout, native, spans
from redactlake.sources import files
from redactlake.sources.markdown import render
from redactlake.streaming import jobs

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_process(spark):
    docs = spark.createDataFrame([(1, "IBAN BE68 5390 0754 7034"), (2, None), (3, " "), (None, "rien"), (5, "x" * 50)], "doc_id long, text string")
    got = {r.doc_id: r for r in Engine(EngineConfig(max_chars=40)).process(docs).collect()}
    assert got[1].text_redacted == "IBAN [IBAN]" and got[1].spans[0].value == "BE68 5390 0754 7034"
    assert got[2].text_redacted is None and got[3].text_redacted == " " and got[None].text_redacted == "rien"
    assert got[5].status == 413 and got[5].text_redacted is None
    assert Engine().process(docs.limit(0)).count() == 0
    found = Engine().detect(docs)
    assert Engine().apply(docs, found).where("doc_id = 1").first().text_redacted == "IBAN [IBAN]"
    assert '"type":"IBAN_CODE"' in Engine().analyze(docs).where("doc_id = 1").first().detections


def test_model_table(spark):
    docs = spark.createDataFrame([(1, "Il va à Namur.")], "doc_id long, text string")
    model = spark.createDataFrame([(1, 8, 13, "LOCATION", 0.9)], "doc_id long, start int, end int, entity string, score double")
    assert Engine(EngineConfig(mask_places=True)).redact(docs, model_spans=model).first().text_redacted == "Il va à [LIEU]."


def test_span_tables(spark):
    docs = spark.createDataFrame([(1, "rue X 12, 4000 Liège et a@b.be")], "doc_id long, text string")
    rows = [(1, 0, 8, "ADDRESS", 0.8, False, ""), (1, 10, 20, "LOCATION", 0.7, True, "")]
    table = spark.createDataFrame(rows, spans.SPAN)
    assert [tuple(r)[1:4] for r in spans.merge_adjacent(table, docs).collect()] == [(0, 20, "ADDRESS")]
    cut = spans.subtract(table, spark.createDataFrame([(1, 2, 4), (1, 15, 30)], "doc_id long, start int, end int"))
    assert sorted((r.start, r.end) for r in cut.collect()) == [(0, 2), (4, 8), (10, 15)]
    assert spans.redact(docs, native.detect(docs)).first().text_redacted.endswith("[EMAIL_ADDRESS]")


def test_text(spark):
    assert one(spark, T.fold, "Éçàß") == "ECASS"
    assert one(spark, T.same_length_blanks, "a b‑c") == "a b-c"
    assert one(spark, T.repair_digits, "RG O475l2 mot") == "RG 047512 mot"
    assert one(spark, T.download_name, 'C:\\Users\\x\\Jugé "final".pdf') == "a-Jugé _final_.md"
    assert one(spark, T.download_name, "../../etc/passwd") == "a-passwd.md"
    assert one(spark, T.clean_extracted, "a​b  \r\n\n\n\nc ") == "ab\n\nc"
    assert one(spark, render, "a\n | x |\n| y |\n\n b ") == "a\n\n| x |\n| y |\n\nb\n"
    style = lambda s: lambda x: T.list_number(x.cast("int"), F.lit(s))
    assert one(spark, style("lowerLetter"), "27") == "aa" and one(spark, style("lowerLetter"), "28") == "ab" and one(spark, style("upperLetter"), "703") == "AAA" and one(spark, style("ordinal"), "1") == "1er" and one(spark, style("upperRoman"), "14") == "XIV"


def test_decode():
    assert files.decode("é".encode("utf-16")) == "é" and files.decode("é".encode()) == "é"
    assert files.decode(b"\xe9\x80") == "é€" and files.decode(b"\xe9\x81") == "é\x81"


def docx():
    body = (
        '<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Titre</w:t></w:r></w:p>'
        + "".join(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for n, t in ((1, "un"), (1, "deux"), (2, "puce"), (1, "trois")))
        + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        + "<w:p><w:del><w:r><w:delText>parti</w:delText></w:r></w:del><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>"
    )
    number = "".join(
        f'<w:abstractNum w:abstractNumId="{k}"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum>' for k, f in ((1, "decimal"), (2, "bullet"))
    ) + "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k in (1, 2))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", f"<w:numbering {W}>{number}</w:numbering>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>')
        for k in (1, 2):
            z.writestr(f"word/header{k}.xml", f"<w:hdr {W}><w:p><w:r><w:t>Entête</w:t></w:r></w:p></w:hdr>")
    return data.getvalue()


def test_files(spark):
    rows = [("a.docx", docx()), ("b.TXT", "é".encode()), ("c.odt", b"x"), ("d.docx", b"no"), ("e.pdf", b"x"), ("f", b""), (None, None)]
    got = {r.file_name: r for r in files.extract(spark.createDataFrame(rows, "file_name string, content binary")).collect()}
    assert got["a.docx"].text.split("\n\n") == ["Entête", "## Titre", "1. un", "2. deux", "• puce", "3. trois", "| a\\|b | c |", "| --- | --- |", "x\ty"]
    assert got["b.TXT"].text == "é" and got["c.odt"].error == "save the file as .docx"
    assert (got["d.docx"].status, got["e.pdf"].status, got["f"].status) == (400, 501, 400)


def test_layout(spark):
    words = [(1, 0, 0, 0, 0, 0, 70.0, "se"), (1, 0, 0, 0, 1, 0, 52.0, "LA."), (1, 0, 0, 0, 2, 0, 39.0, "hek")]
    schema = "doc_id int, image_no int, block int, par int, line int, word_no int, conf double, text string"
    assert layout.ocr_text(spark.createDataFrame(words, schema)).count() == 0
    words = [(1, 0, 0, 0, 0, 0, 90.0, "Nom"), (1, 0, 0, 0, 0, 1, 90.0, "/"), (1, 0, 0, 0, 0, 2, 90.0, "Name"), (1, 0, 0, 0, 1, 0, 95.0, "PEETERS"), (1, 0, 1, 0, 0, 0, 90.0, "RG"), (1, 0, 1, 0, 0, 1, 90.0, "21/123/A")]
    assert layout.ocr_text(spark.createDataFrame(words, schema)).first().text == "Nom / Name\nPEETERS\n\nRG 21/123/A"
    lines = spark.createDataFrame([(1, 1, 1, ["conven-", "tionnelles et avocat-", "intermédiaire"])], "doc_id int, page int, paragraph int, lines array<string>")
    known = spark.createDataFrame([(1, "conventionnelles")], "doc_id int, word string")
    assert layout.join_hyphens(lines, known).first().text == "conventionnelles et avocat-intermédiaire"


def test_paragraphs(spark):
    row = "doc_id int, page int, row_no int, x0 double, x1 double, text string, bold boolean, size double, left_margin double, right_margin double"
    rows = [
        (1, 1, 0, 0.0, 500.0, "Le tribunal dit que la", False, 10.0, 0.0, 500.0),
        (1, 1, 1, 0.0, 300.0, "demande est fondée.", False, 10.0, 0.0, 500.0),
        (1, 1, 2, 0.0, 200.0, "Elle est accueillie.", False, 10.0, 0.0, 500.0),
    ]
    got = [r.lines for r in layout.paragraphs(spark.createDataFrame(rows, row)).orderBy("paragraph").collect()]
    assert got == [["Le tribunal dit que la", "demande est fondée."], ["Elle est accueillie."]]


def test_throttle(spark):
    rows = [(1, "a", 0.0, 0), (1, "a", 0.1, 1), (1, "a", 0.3, 2), (1, "b", 0.31, 3), (1, "a", 0.4, 4)]
    events = spark.createDataFrame(rows, "key int, stage string, t double, seq int").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t")
    assert [r.sent for r in jobs.throttle(events).orderBy("seq").collect()] == [True, False, True, True, True]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.be"), (2, "rien")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    jobs.redact_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.text_redacted for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["[EMAIL]", "rien"]
    jobs.event_stream(spark, f"{tmp_path}/in", f"{tmp_path}/ev", f"{tmp_path}/cp2").awaitTermination()
    assert spark.read.text(f"{tmp_path}/ev").count() == 6


def test_requests(spark):
    rows = [(1, '{"text": "a", "whitelist": ["b"]}'), (2, "[]"), (3, '{"text": " "}'), (4, "no"), (5, None)]
    got = {r.doc_id: r for r in files.requests(spark.createDataFrame(rows, "doc_id int, body string")).collect()}
    assert got[1].status == 200 and got[1].allow == ["b"] and [got[k].status for k in (2, 3, 4)] == [400, 400, 400]


@pytest.mark.parametrize("name", ["email_spans", "merge_overlaps", "redact_documents"])
def test_registry(name):
    from redactlake.plans import registry

    assert name in registry.queries() and name in registry.oracles()


def test_sql(spark):
    from redactlake.functions import sql

    sql.register(spark)
    spark.createDataFrame([(1, "IBAN BE68 5390 0754 7034"), (2, None)], "doc_id int, text string").createOrReplaceTempView("own_docs")
    assert [r[0] for r in spark.sql("SELECT redact_text(text) FROM own_docs ORDER BY doc_id").collect()] == ["IBAN [IBAN]", None]
    assert [r.entity for r in spark.sql("SELECT d.doc_id, s.* FROM own_docs d, LATERAL detections(d.text) s").collect()] == ["IBAN_CODE"]
    assert tuple(spark.sql("SELECT enterprise_ok('0123456749'), national_number_ok('85073003328'), account_ok('000000000197')").first()) == (True, True, False)


def test_assemble(spark):
    blocks = spark.createDataFrame([(1, 0, "text", "un"), (1, 1, "image", None), (1, 2, "image", None), (1, 3, "image", None), (2, 0, "image", None)], "doc_id int, seq int, kind string, text string")
    images = spark.createDataFrame([(1, 1, "IBAN BE68 5390 0754 7034", False), (1, 2, "", True), (1, 3, "", True), (2, 0, "", False)], "doc_id int, seq int, text string, over_limit boolean")
    got = {r.doc_id: r for r in layout.assemble(blocks, images).collect()}
    assert got[1].text == "un\n\n[[IMAGE-TEXT-START]]\nIBAN BE68 5390 0754 7034\n[[IMAGE-TEXT-END]]\n\n[some images were not read]"
    assert (got[1].ocr_images, got[1].skipped_images, got[2].text) == (1, 2, "")
    assert "[IBAN]\n[[IMAGE-TEXT-END]]" in Engine().redact(spark.createDataFrame([(1, got[1].text)], "doc_id int, text string")).first().text_redacted
    pages = spark.createDataFrame([(1, 1, "x" * 30, 1), (1, 2, "", 1), (1, 3, "", 0), (1, 4, "�" * 30, 0)], "doc_id int, page int, text string, drawings int")
    assert [r.verdict for r in layout.pages_to_read(pages).orderBy("page").collect()] == ["images", "page", "none", "page"]
    lines = spark.createDataFrame([(1, ["conven-", "Le mot le"])], "doc_id int, lines array<string>")
    assert {(r.word, r.n) for r in layout.vocabulary(lines).collect()} == {("le", 2), ("mot", 1)}


def test_evaluate(spark):
    from redactlake import evaluate

    labels = spark.createDataFrame([("d", "Jean", "P_1"), ("d", "Dupont", "P_1"), ("d", "Marie", "P_1")], "document string, mention string, label string")
    groups = spark.createDataFrame([("d", 1, True, "Jean"), ("d", 1, True, "Dupont"), ("d", 2, False, "Jean"), ("d", 2, False, "Marie")], "document string, group_no int, same boolean, mention string")
    assert {(r.group_no, r.failed) for r in evaluate.label_errors(labels, groups).collect()} == {(1, False), (2, True)}
    notes = spark.createDataFrame([("d", "mask", "Jean"), ("d", "mask", r"re:BE\d+"), ("d", "keep", "cour")], "document string, kind string, value string")
    outputs = spark.createDataFrame([("d", "Jeannette de la cour, BE68")], "document string, redacted string")
    assert {(r.value, r.failed) for r in evaluate.checks(outputs, notes).collect()} == {("Jean", False), (r"re:BE\d+", True), ("cour", False)}

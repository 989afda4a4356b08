"""Gold annotations, whole-corpus figures, list numbers of word processors, events of a stream."""

import datetime as dt
import io
import json
import zipfile

from redactlake import evaluate
from redactlake.functions import text as T
from redactlake.sources import files
from redactlake.streaming import jobs


def test_annotations(spark, tmp_path):
    gold = {"document": "a.txt", "mask": {"PERSON": ["Verhaert"], "IBAN": ["re:BE\\d+"]}, "keep": ["cour"], "absent_output": ["re:\\[\\["], "same_label": [["Luc", "L."]], "distinct_labels": [["Luc", "Anne"]]}
    (tmp_path / "a.json").write_text(json.dumps(gold))
    (tmp_path / "b.json").write_text('{"document": "b.txt"}')
    notes = evaluate.annotations(spark, str(tmp_path))
    assert {tuple(r) for r in notes.collect()} == {("a.txt", "mask", "Verhaert"), ("a.txt", "mask", "re:BE\\d+"), ("a.txt", "keep", "cour"), ("a.txt", "absent", "re:\\[\\[")}
    outputs = spark.createDataFrame([("a.txt", "[PERSONNE_1] devant la cour, BE68")], "document string, redacted string")
    found = {(r.kind, r.value): r.failed for r in evaluate.checks(outputs, notes).collect()}
    assert found == {("mask", "Verhaert"): False, ("mask", "re:BE\\d+"): True, ("keep", "cour"): False, ("absent", "re:\\[\\["): False}
    groups = evaluate.label_groups(spark, str(tmp_path))
    labels = spark.createDataFrame([("a.txt", "Luc", "P1"), ("a.txt", "L.", "P1"), ("a.txt", "Anne", "P1")], "document string, mention string, label string")
    assert {(r.same, r.failed) for r in evaluate.label_errors(labels, groups).collect()} == {(True, False), (False, True)}


def test_corpus_figures(spark):
    outputs = spark.createDataFrame([("a", "x", [(0, 500)]), ("b", "y", [(0, 5)])], "document string, redacted string, spans array<struct<start:int,end:int>>")
    docs = spark.createDataFrame([("a", "t"), ("b", "t")], "document string, text string")
    assert [tuple(r) for r in evaluate.swallowed(outputs, docs).collect()] == [("a", 1)]
    again = spark.createDataFrame([("a", "x"), ("b", None)], "document string, redacted string")
    assert [r.document for r in evaluate.unsteady(outputs, again).collect()] == ["b"]
    want = spark.createDataFrame([(1, "a b b c"), (2, "x"), (3, None)], "doc_id long, text string")
    got = spark.createDataFrame([(1, "a b d d"), (2, "x")], "doc_id long, text string")
    assert [tuple(r) for r in evaluate.fidelity(want, got).collect()] == [(1, 2, 2)]


def test_clean_extracted(spark):
    df = spark.createDataFrame([("ﬁn de l’ａｃｔｅ № 5​…\r\nx",)], "x string")
    assert df.select(T.clean_extracted(df.x)).first()[0] == "fin de l’acte No 5...\nx"


def test_docx_numbers_by_style():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    level = '<w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{}"/><w:lvlText w:val="{}"/></w:lvl>'
    parts = {
        "document": f'<w:document {w}><w:body>' + "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in (("Own", "a"), ("Based", "b"), ("Plain", "c"), ("Round", "d"))) + "</w:body></w:document>",
        "styles": f'<w:styles {w}><w:style w:styleId="Own"><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style><w:style w:styleId="Based"><w:basedOn w:val="Own"/></w:style><w:style w:styleId="Plain"/>'
        '<w:style w:styleId="Round"><w:pPr><w:numPr><w:numId w:val="2"/></w:numPr></w:pPr></w:style></w:styles>',
        "numbering": f'<w:numbering {w}><w:abstractNum w:abstractNumId="1">{level.format("lowerLetter", "%1)")}</w:abstractNum><w:abstractNum w:abstractNumId="2">{level.format("bullet", "o")}</w:abstractNum>'
        '<w:num w:numId="1"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="27"/></w:lvlOverride></w:num><w:num w:numId="2"><w:abstractNumId w:val="2"/></w:num></w:numbering>',
    }
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", xml)
    assert [b[2] for b in files.Docx(data.getvalue()).blocks()] == ["aa) a", "ab) b", "c", "◦ d"]


def test_throttle_stream(spark, tmp_path):
    rows = [("k", s, dt.datetime(2024, 1, 1, 0, 0, sec), n) for n, (s, sec) in enumerate([("read", 0), ("read", 1), ("read", 4), ("mask", 4), ("read", 5), ("mask", 9)])]
    events = spark.createDataFrame(rows, "key string, stage string, ts timestamp, seq int")
    batch = {(r.stage, r.ts.second): r.sent for r in jobs.throttle(events, 3.0).collect()}
    assert batch == {("read", 0): True, ("read", 1): False, ("read", 4): True, ("read", 5): True, ("mask", 4): True, ("mask", 9): True}
    events.select("key", "stage", "ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, stage string, ts timestamp").parquet(str(tmp_path / "in"))
    query = jobs.throttle_stream(source, 3.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.stage, r.ts.second) for r in got} == {("read", 0), ("read", 4), ("mask", 4), ("mask", 9)}


def test_throttle_batches():
    import pyarrow as pa

    rows = [("a", "x", k * 700_000) for k in range(9)] + [("a", "y", k * 400_000) for k in range(5)] + [("b", "x", 0)]

    def table(part):
        key, stage, ts = zip(*part, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(stage), pa.array(ts, pa.timestamp("us"))], ["key", "stage", "ts"])

    whole = [x for b in jobs._greedy(1.0)([table(rows)]) for x in b.column("sent").to_pylist()]
    for size in (1, 2, 5, 14):
        assert [x for b in jobs._greedy(1.0)([table(rows[at : at + size]) for at in range(0, len(rows), size)]) for x in b.column("sent").to_pylist()] == whole
    assert whole == [True, False, True, False, True, False, True, False, True, True, False, False, True, True, True]


def test_one_fold(spark):
    """Columns fold Latin letters as the word lists do."""
    from pyspark.sql import functions as F

    from redactlake.operators import lexicon

    rows = spark.createDataFrame([(c,) for c in T.ACCENTED + "abcXYZ09-"], "x string").select("x", T.fold(F.col("x")).alias("f")).collect()
    assert len(rows) > 200 and all(r.f == lexicon.fold(r.x) for r in rows)


def test_lists_propagate(spark):
    from redactlake.operators import spans

    docs = spark.createDataFrame([(1, "RG 21/123 et 22/456 ; puis 22/456 seul")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 3, 19, "FR_NUM_ROLE", 0.9, False, "")], spans.SPAN)
    assert sorted((r.start, r.end) for r in spans.propagate(docs, found).collect()) == [(3, 19), (27, 33)]

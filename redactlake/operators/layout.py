"""Read words and page segments as tables: lines, paragraphs, margins, pages to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.functions.text import is_page_number, margin_key, solid_word


def ocr_lines(words: DataFrame, keep: float = 30, line: float = 55) -> DataFrame:
    """Lines of read words that are sure enough.

    words: doc_id, image_no, block, par, line, word_no, conf, text. A line stays with
    two letters or digits, a solid word and a mean confidence of ``line``.
    """
    alnum = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    sure = words.where((F.col("conf") >= keep) & (F.trim("text") != ""))
    grouped = sure.groupBy("doc_id", "image_no", "block", "par", "line").agg(
        F.avg("conf").alias("conf"),
        F.sum(F.when(solid_word(F.col("text"), F.col("conf")), 1).otherwise(0)).alias("solid"),
        F.sum(alnum).alias("alnum"),
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w"),
    )
    good = grouped.where((F.col("alnum") >= 2) & (F.col("solid") >= 1) & (F.col("conf") >= line))
    return good.withColumn("text", F.array_join(F.transform("w", lambda x: x["text"]), " ")).drop("w")


def ocr_text(words: DataFrame) -> DataFrame:
    """Text, mean confidence and solid words of each image; an empty line between blocks."""
    at = F.struct("block", "par", "line", "text", "conf", "solid", "n")
    images = ocr_lines(words).groupBy("doc_id", "image_no").agg(F.array_sort(F.collect_list(at)).alias("l"), F.sum("solid").alias("solid"), (F.sum(F.col("conf") * F.col("n")) / F.sum("n")).alias("conf"))
    before = F.concat(F.slice("l", 1, 1), F.slice("l", F.lit(1), F.size("l") - 1))
    gap = lambda x, i: F.when(i == 0, "").when(F.element_at(before, i + 1)["block"] == x["block"], "\n").otherwise("\n\n")
    text = F.array_join(F.transform("l", lambda x, i: F.concat(gap(x, i), x["text"])), "")
    return images.select("doc_id", "image_no", text.alias("text"), "conf", "solid")


def has_text(images: DataFrame) -> DataFrame:
    """Images that hold text: three letters or digits, a solid word, mean confidence 60."""
    alnum = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    return images.where((alnum >= 3) & (F.col("solid") >= 1) & (F.col("conf") >= 60))


def native_copies(images: DataFrame, pages: DataFrame, share: float = 0.6) -> DataFrame:
    """Images of whose words the page's own text has most already."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))
    both = images.join(pages.select("doc_id", F.col("text").alias("page_text")), "doc_id")
    seen, own = F.size(F.array_intersect(words(F.col("text")), words(F.col("page_text")))), F.size(words(F.col("text")))
    return both.where((own > 0) & (seen >= own * share)).drop("page_text")


def repeated_margins(rows: DataFrame) -> DataFrame:
    """Header and footer rows (doc_id, page, y0, text, zone): keep, drop and why.

    Of texts that two pages or more share but for numbers the first stays; page
    numbers go.
    """
    keyed = rows.withColumn("key", margin_key(F.col("text")))
    w = Window.partitionBy("doc_id", "zone", "key")
    order = F.row_number().over(w.orderBy("page", "y0", "text"))
    several = F.max("page").over(w) > F.min("page").over(w)
    why = F.when(is_page_number(F.col("text")), "page number").when(several & (order > 1), "repeated")
    return keyed.withColumn("reason", why).withColumn("kept", F.col("reason").isNull()).drop("key")


def page_margins(rows: DataFrame) -> DataFrame:
    """Left margin: the smallest of the commonest rounded starts; right: the end at nine tenths of rows of 20 characters."""
    starts = rows.groupBy("doc_id", "page", F.bround("x0").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    left = starts.groupBy("doc_id", "page").agg(F.max(F.struct("n", (-F.col("x")).alias("x")))["x"].alias("x")).select("doc_id", "page", (-F.col("x")).alias("left_margin"))
    ends = rows.groupBy("doc_id", "page").agg(
        F.array_sort(F.collect_list(F.when(F.length("text") >= 20, F.col("x1")))).alias("long"), F.array_sort(F.collect_list("x1")).alias("every"), F.max("width").alias("width")
    )
    used = F.when(F.size("long") > 0, F.col("long")).otherwise(F.col("every"))
    right = ends.select("doc_id", "page", "width", F.element_at(used, (F.floor(0.9 * (F.size(used) - 1)) + 1).cast("int")).alias("e"))
    both = left.join(right, ["doc_id", "page"])
    return both.select("doc_id", "page", "left_margin", F.greatest(F.col("e"), F.col("left_margin") + 0.55 * F.col("width")).alias("right_margin"))


def row_texts(segments: DataFrame, spread: float | None = 2.5) -> DataFrame:
    """Rows (doc_id, page, row_no) from their segments: tabs over wide gaps, blanks over small ones.

    A row of three segments or more is justified, and has no columns, where its widest gap is at most
    ``spread`` times its median one.
    """
    parts = F.array_sort(F.collect_list(F.struct("x0", "x1", "text", "size")))
    grouped = segments.groupBy("doc_id", "page", "row_no").agg(
        parts.alias("p"), F.max("width").alias("width"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.max("size").alias("size"), F.bool_and("bold").alias("bold")
    )
    gap = lambda i: F.element_at("p", i + 1)["x0"] - F.element_at("p", i)["x1"]
    gaps = F.array_sort(F.when(F.size("p") > 1, F.transform(F.sequence(F.lit(1), F.size("p") - 1), gap)).otherwise(F.array().cast("array<double>")))
    grouped = grouped.withColumn("gaps", gaps)
    middle = F.element_at("gaps", F.floor(F.size("gaps") / 2).cast("int") + 1)
    even = F.lit(False) if spread is None else F.when(F.size("gaps") >= 2, F.element_at("gaps", -1) <= spread * F.greatest(middle, F.lit(1.0))).otherwise(False)
    wide = F.greatest(F.lit(48.0), F.col("width") * 0.1)

    def piece(x, i):
        last = F.element_at("p", i)
        sep = F.when((gap(i) > wide) & ~F.col("even"), "\t").when(gap(i) > F.greatest(last["size"], x["size"]) * 0.15, " ").otherwise("")
        return F.when(i == 0, x["text"]).otherwise(F.concat(sep, x["text"]))

    return grouped.withColumn("even", even).withColumn("text", F.array_join(F.transform("p", piece), "")).drop("p", "gaps", "even", "width")


def margin_zones(rows: DataFrame, share: float = 0.09) -> DataFrame:
    """rows (y0, y1, height) with zone: top or bottom for those that lie wholly within ``share`` of the page's edge."""
    return rows.withColumn("zone", F.when(F.col("y1") <= share * F.col("height"), "top").when(F.col("y0") >= (1 - share) * F.col("height"), "bottom"))


def form_rows(widgets: DataFrame) -> DataFrame:
    """Values of form fields and comments (doc_id, page, seq, kind, label, value) as rows of text: "label : value"; blank values and ticks go."""
    value, label = F.trim("value"), F.trim(F.coalesce("label", F.lit("")))
    field = F.col("kind") == "field"
    shown = (value != "") & ~(field & F.col("value").isin("Off", "Yes"))
    return widgets.where(shown).select("doc_id", "page", "seq", F.when(field & (label != ""), F.concat(label, F.lit(" : "), value)).otherwise(value).alias("text"))


def best_reading(readings: DataFrame) -> DataFrame:
    """One reading of each image, of those that an outside reader has made: doc_id, image_no, mode, text, conf, solid.

    mode: plain; rotated, which wins over an unsure plain one (conf under 70) where it is surer; sparse, which stands in where
    the better of them holds no text, if it is sure itself (conf 75).
    """
    alnum = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    held = readings.withColumn("held", (alnum >= 3) & (F.col("solid") >= 1) & (F.col("conf") >= 60))
    one = lambda mode: F.max(F.when(F.col("mode") == mode, F.struct("conf", "text", "solid", "held", "mode")))
    by = held.groupBy("doc_id", "image_no").agg(one("plain").alias("p"), one("rotated").alias("r"), one("sparse").alias("s"))
    turned = (F.col("p.conf") < 70) & (F.length("r.text") > 0) & (F.col("r.conf") > F.col("p.conf"))
    best = by.withColumn("b", F.when(turned, F.col("r")).otherwise(F.col("p")))
    best = best.withColumn("b", F.when(F.coalesce(~F.col("b.held"), F.lit(True)) & F.col("s.held") & (F.col("s.conf") >= 75), F.col("s")).otherwise(F.col("b")))
    return best.where("b.held").select("doc_id", "image_no", "b.mode", "b.text", "b.conf", "b.solid")


def visual_rows(segments: DataFrame) -> DataFrame:
    """segments with row_no: those that overlap by half their height share a row."""
    import pyarrow as pa

    schema = T.StructType([*segments.schema.fields, T.StructField("row_no", T.IntegerType())])

    def run(table: pa.Table) -> pa.Table:
        x0, y0, y1 = (table.column(c).to_pylist() for c in ("x0", "y0", "y1"))
        row = [0] * table.num_rows
        k, top, bottom = -1, 0.0, -1.0
        for i in sorted(range(table.num_rows), key=lambda i: (y0[i], x0[i])):
            shared = min(y1[i], bottom) - max(y0[i], top)
            if k < 0 or shared < 0.5 * min(y1[i] - y0[i], bottom - top):
                k, top, bottom = k + 1, y0[i], y1[i]
            else:
                top, bottom = min(y0[i], top), max(y1[i], bottom)
            row[i] = k
        return table.append_column("row_no", pa.array(row, pa.int32()))

    return segments.groupBy("doc_id", "page").applyInArrow(run, schema)


def paragraphs(rows: DataFrame) -> DataFrame:
    """Rows of pages as paragraphs: a row goes on unless its look or the line before says otherwise.

    Columns, centred rows and bold titles stand alone; a row of another size, a list's marker
    after a whole line, and an indent after a sentence begin anew; and so does what follows a
    line that had room for its first word, but for a sentence that goes on in lower case.
    """
    c = F.col
    width = F.greatest(c("right_margin") - c("left_margin"), F.lit(1.0))
    inside = (c("x0") > c("left_margin") + 0.08 * width) & (c("x1") - c("x0") < 0.8 * width)
    apart = inside & (F.abs((c("x0") + c("x1")) / 2 - (c("left_margin") + c("right_margin")) / 2) <= 0.06 * width) | c("text").contains("\t")
    rows = rows.withColumn("apart", apart)
    w = Window.partitionBy("doc_id", "page").orderBy("row_no")
    last = lambda x: F.lag(x).over(w)
    ended = last("text").rlike(r"[.!?:;»”)]\s*$")
    marker = c("text").rlike(r"^\s*(?:[-–•*▪]|\d{1,3}[.)°]|[a-zA-Z][.)])\s")
    letter = (last("x1") - last("x0")) / F.greatest(F.length(F.trim(last("text"))), F.lit(1))
    wraps = c("right_margin") - last("x1") < 0.9 * (F.length(F.regexp_extract("text", r"^\s*(\S*)", 1)) + 1) * letter
    new = (
        last("text").isNull()
        | last("apart")
        | c("apart")
        | (last("bold") & ~c("bold"))
        | (F.abs(last("size") - c("size")) > 1)
        | (marker & (ended | ~wraps))
        | (ended & (c("x0") > c("left_margin") + F.greatest(F.lit(6.0), 0.6 * c("size"))))
        | (~wraps & (ended | marker | ~c("text").rlike(r"^\s*\p{Ll}")))
    )
    marked = rows.withColumn("p", F.sum(F.when(new, 1).otherwise(0)).over(w))
    lines = marked.groupBy("doc_id", "page", "p").agg(F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("l"))
    return lines.select("doc_id", "page", F.col("p").alias("paragraph"), F.transform("l", lambda x: x["text"]).alias("lines"))


def join_hyphens(paragraphs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Text of paragraphs: a hyphen at a line's end goes if the document knows the joined word, and not the one with the hyphen.

    vocabulary: doc_id, word (lower case), words of the document; lines are looked up by join, not collected.
    """
    parts = paragraphs.select("doc_id", "page", "paragraph", F.posexplode("lines").alias("k", "line"))
    w = Window.partitionBy("doc_id", "page", "paragraph").orderBy("k")
    parts = parts.withColumn("next", F.lead("line").over(w))
    head, tail = F.regexp_extract("line", r"([\p{L}]+)-$", 1), F.regexp_extract("next", r"^([\p{Ll}]+)", 1)
    split = (head != "") & (tail != "")
    parts = parts.withColumns({"word": F.when(split, F.lower(F.concat(head, tail))), "hyphened": F.when(split, F.lower(F.concat(head, F.lit("-"), tail)))})
    known = vocabulary.select("doc_id", "word").dropDuplicates()
    parts = parts.join(known.withColumn("known", F.lit(True)), ["doc_id", "word"], "left")
    parts = parts.join(known.select("doc_id", F.col("word").alias("hyphened"), F.lit(True).alias("compound")), ["doc_id", "hyphened"], "left")
    hyphen = F.col("line").endswith("-") & F.col("next").isNotNull()
    joined = F.col("known") & F.col("compound").isNull()
    piece = F.when(joined, F.expr("left(line, length(line) - 1)")).when(hyphen, F.col("line")).otherwise(F.concat("line", F.when(F.col("next").isNull(), "").otherwise(" ")))
    rows = parts.withColumn("piece", piece).groupBy("doc_id", "page", "paragraph").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p"))
    return rows.select("doc_id", "page", "paragraph", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))


def images_to_read(images: DataFrame, budget: int = 300, width: float = 30, height: float = 12, small_count: bool = False) -> DataFrame:
    """Images (doc_id, page, seq, xref, w, h) with a verdict: read, too small, seen or over the budget.

    Too small an image never stands for a larger one of its xref, unless small_count
    says that it takes the xref's place all the same. Images of one page and seq are
    taken largest first, so the order is total but for equal rows. An image of unknown
    width or height is not too small, unless the other one says so; images of unknown
    page or seq come last.
    """
    large = (F.col("w") >= width) & (F.col("h") >= height)
    at, size = [F.asc_nulls_last("page"), F.asc_nulls_last("seq")], [F.col("w").desc(), F.col("h").desc()]
    one = Window.partitionBy("doc_id", "xref") if small_count else Window.partitionBy("doc_id", "xref", large)
    first = F.row_number().over(one.orderBy(*at, F.coalesce(large, F.lit(True)).desc(), *size)) == 1
    marked = images.withColumn("why", F.when(~large, "too small").when(~first, "seen"))
    place = F.row_number().over(Window.partitionBy("doc_id", F.col("why").isNull()).orderBy(*at, *size))
    return marked.withColumn("verdict", F.coalesce("why", F.when(place > budget, "over the budget").otherwise("read"))).drop("why")


def markdown_tables(cells: DataFrame) -> DataFrame:
    """Tables (doc_id, table_no, row_no, col_no, text) as Markdown: padded to the widest row, empty rows dropped, one column as paragraphs."""
    clean = F.trim(F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))
    rows = cells.withColumn("text", clean).groupBy("doc_id", "table_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "text"))).alias("c"))
    rows = rows.withColumn("c", F.transform("c", lambda x: x["text"])).where(F.exists("c", lambda x: x != ""))
    width = F.max(F.size("c")).over(Window.partitionBy("doc_id", "table_no"))
    rows = rows.withColumn("width", width).withColumn("c", F.concat("c", F.array_repeat(F.lit(""), F.col("width") - F.size("c"))))
    line = F.when(F.col("width") == 1, F.col("c")[0]).otherwise(F.concat(F.lit("| "), F.array_join("c", " | "), F.lit(" |")))
    tables = rows.groupBy("doc_id", "table_no").agg(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))).alias("l"), F.max("width").alias("width"))
    lines = F.transform("l", lambda x: x["line"])
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("width")))
    text = F.when(F.col("width") == 1, F.array_join(lines, "\n\n")).otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size(lines))), "\n"))
    return tables.select("doc_id", "table_no", text.alias("markdown"))


def assemble(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """A document's text from its blocks (doc_id, seq, kind, text) and the texts read from its images.

    Texts of images stand between marker lines, which redaction leaves alone. An
    image over the limit leaves a notice, once in a document; one without text none.
    """
    from redactlake.operators.rules import MARKERS

    both = blocks.join(images.select("doc_id", "seq", F.col("text").alias("image_text"), "over_limit"), ["doc_id", "seq"], "left")
    first = F.row_number().over(Window.partitionBy("doc_id", F.col("over_limit")).orderBy("seq")) == 1
    part = (
        F.when(F.col("kind") != "image", F.col("text"))
        .when(F.col("over_limit") & first, "[some images were not read]")
        .when(F.col("image_text") != "", F.concat(F.lit(f"{MARKERS[0]}\n"), F.col("image_text"), F.lit(f"\n{MARKERS[1]}")))
    )
    rows = both.withColumn("part", part).where(F.col("part").isNotNull() & (F.col("part") != ""))
    counts = both.groupBy("doc_id").agg(
        F.sum(F.when((F.col("kind") == "image") & ~F.coalesce("over_limit", F.lit(False)), 1).otherwise(0)).alias("ocr_images"), F.sum(F.when(F.col("over_limit"), 1).otherwise(0)).alias("skipped_images")
    )
    joined = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")
    return counts.join(joined, "doc_id", "left").select("doc_id", F.coalesce(text, F.lit("")).alias("text"), "ocr_images", "skipped_images")


def pages_to_read(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text, drawings) with a verdict: whole page, images, or nothing to read."""
    from redactlake.functions.text import garbled

    alnum = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    return pages.withColumn("verdict", F.when(garbled(F.col("text")) | ((alnum < 25) & (F.col("drawings") > 0)), "page").when(F.col("drawings") > 0, "images").otherwise("none"))


def vocabulary(paragraph_lines: DataFrame) -> DataFrame:
    """Words of each document in lower case, compounds with hyphens also whole, with counts; halves at a line's hyphen left out."""
    line = paragraph_lines.select("doc_id", F.explode("lines").alias("line"))
    whole = F.regexp_replace("line", r"[\p{L}]+-\s*$", "")
    words = lambda pattern: F.regexp_extract_all(F.lower(whole), F.lit(pattern), F.lit(0))
    found = line.select("doc_id", F.explode(F.concat(words(r"\p{L}{2,}"), words(r"\p{L}+(?:-\p{L}+)+"))).alias("word"))
    return found.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))

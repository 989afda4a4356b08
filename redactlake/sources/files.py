"""Uploaded files: routing by extension, decoding of text, reading of DOCX.

Errors are columns, never exceptions, so one bad file does not stop a job.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions with a reader, and those with a hint.
READERS = {"txt": "text", "md": "text", "docx": "docx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "gif": "image", "bmp": "image"}
HINTS = {"doc": "docx", "odt": "docx", "rtf": "docx", "pages": "docx"}
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def route(name: Column) -> Column:
    """The reader of a file, or null."""
    return F.try_element_at(F.create_map(*[F.lit(v) for p in READERS.items() for v in p]), extension(name))


def refusal(name: Column, size: Column, most: int = 100 << 20) -> Column:
    """Why a file is refused, or null."""
    hints = F.create_map(*[F.lit(v) for p in HINTS.items() for v in p])
    hint = F.try_element_at(hints, extension(name))
    return (
        F.when(size == 0, "the file is empty")
        .when(size > most, "the file is too large")
        .when(hint.isNotNull(), F.concat(F.lit("save the file as ."), hint))
        .when(route(name).isNull(), F.lit(f"only these can be read: {' '.join(sorted(READERS))}"))
    )


def decode(data: bytes) -> str:
    """Text of a file: UTF-16 by its mark, UTF-8, Windows-1252, else Latin-1."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for kind in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(kind)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def _number(n: int, style: str) -> str:
    if style in ("lowerLetter", "upperLetter"):
        out = ""
        while n > 0:
            out, n = chr(97 + (n - 1) % 26) + out, (n - 1) // 26
    elif style in ("lowerRoman", "upperRoman"):
        from redactlake.functions.text import ROMAN

        out = ""
        for value, letters in ROMAN:
            out += letters * (n // value)
            n %= value
    elif style == "decimalZero":
        out = f"{n:02d}"
    elif style == "ordinal":
        out = f"{n}er" if n == 1 else f"{n}e"
    else:
        out = str(n)
    return out.upper() if style.startswith("upper") else out


class Docx:
    """Blocks (kind, level, text) of a word processor's file, numbering written out."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.count: dict[tuple, int] = {}
        self.formats = self._numbering()
        self.headings = self._headings()
        self.styled = self._styled()

    def _tree(self, name: str):
        return ElementTree.fromstring(self.zip.read(name)) if name in self.names else None

    def _numbering(self) -> dict[tuple[str, str], tuple[str, str, int]]:
        tree = self._tree("word/numbering.xml")
        if tree is None:
            return {}
        kinds = {
            (a.get(f"{W}abstractNumId"), lvl.get(f"{W}ilvl")): (
                lvl.find(f"{W}numFmt").get(f"{W}val") if lvl.find(f"{W}numFmt") is not None else "decimal",
                lvl.find(f"{W}lvlText").get(f"{W}val") if lvl.find(f"{W}lvlText") is not None else "%1.",
                int(lvl.find(f"{W}start").get(f"{W}val")) if lvl.find(f"{W}start") is not None else 1,
            )
            for a in tree.iter(f"{W}abstractNum")
            for lvl in a.iter(f"{W}lvl")
        }
        of = {n.get(f"{W}numId"): n.find(f"{W}abstractNumId").get(f"{W}val") for n in tree.iter(f"{W}num") if n.find(f"{W}abstractNumId") is not None}
        found = {(num, lvl): v for num, a in of.items() for (b, lvl), v in kinds.items() if a == b}
        for num in tree.iter(f"{W}num"):
            for change in num.iter(f"{W}lvlOverride"):
                key, first = (num.get(f"{W}numId"), change.get(f"{W}ilvl")), change.find(f"{W}startOverride")
                if key in found and first is not None:
                    found[key] = (*found[key][:2], int(first.get(f"{W}val")))
        return found

    def _styled(self) -> dict[str, tuple[str, str]]:
        """Number and level that paragraph styles give, their own or of the style they are based on."""
        tree = self._tree("word/styles.xml")
        own, base = {}, {}
        for style in tree.iter(f"{W}style") if tree is not None else ():
            key, num, parent = style.get(f"{W}styleId"), style.find(f"{W}pPr/{W}numPr"), style.find(f"{W}basedOn")
            if num is not None and num.find(f"{W}numId") is not None:
                level = num.find(f"{W}ilvl")
                own[key] = (num.find(f"{W}numId").get(f"{W}val"), level.get(f"{W}val") if level is not None else "0")
            if parent is not None:
                base[key] = parent.get(f"{W}val")
        for key in list(base):
            at, seen = key, set()
            while at is not None and at not in own and at not in seen:
                seen.add(at)
                at = base.get(at)
            if at in own:
                own.setdefault(key, own[at])
        return own

    def _headings(self) -> dict[str, int]:
        tree = self._tree("word/styles.xml")
        out = {}
        for s in tree.iter(f"{W}style") if tree is not None else ():
            level = s.find(f"{W}pPr/{W}outlineLvl")
            name = (s.find(f"{W}name").get(f"{W}val") if s.find(f"{W}name") is not None else "").lower()
            if level is not None:
                out[s.get(f"{W}styleId")] = min(6, int(level.get(f"{W}val")) + 1)
            elif name.startswith(("heading ", "titre ")) and name.split()[-1].isdigit():
                out[s.get(f"{W}styleId")] = min(6, int(name.split()[-1]))
        return out

    def _marker(self, p) -> str:
        num, style = p.find(f"{W}pPr/{W}numPr"), p.find(f"{W}pPr/{W}pStyle")
        key, level = self.styled.get(style.get(f"{W}val") if style is not None else None, (None, "0"))
        if num is not None and num.find(f"{W}numId") is not None:
            key = num.find(f"{W}numId").get(f"{W}val")
        if num is not None and num.find(f"{W}ilvl") is not None:
            level = num.find(f"{W}ilvl").get(f"{W}val")
        if (key, level) not in self.formats:
            return ""
        style, pattern, start = self.formats[key, level]
        self.count[key, level] = self.count.get((key, level), start - 1) + 1
        for deeper in range(int(level) + 1, 9):
            self.count.pop((key, str(deeper)), None)
        if style == "none":
            return ""
        if style == "bullet":
            return "◦ " if pattern.strip() == "o" else f"{pattern.strip()} " if pattern.strip() in ("–", "-", "◦", "▪") else "• "
        for k in range(int(level) + 1):
            kind, _, first = self.formats.get((key, str(k)), ("decimal", "", 1))
            pattern = pattern.replace(f"%{k + 1}", _number(self.count.get((key, str(k)), first), kind))
        return f"{pattern} "

    def _text(self, node) -> str:
        out = []
        for child in node:
            tag = child.tag.rpartition("}")[2]
            if tag in ("del", "instrText", "Fallback", "pPr", "rPr", "moveFrom"):
                continue
            if tag == "t":
                out.append((child.text or "").replace("­", ""))
            elif tag == "tab":
                out.append("\t")
            elif tag in ("br", "cr"):
                out.append("\n")
            elif tag == "noBreakHyphen":
                out.append("-")
            elif tag != "txbxContent":
                out.append(self._text(child))
        return "".join(out)

    def _blocks(self, body):
        for node in body:
            tag = node.tag.rpartition("}")[2]
            if tag == "p":
                style = node.find(f"{W}pPr/{W}pStyle")
                level = self.headings.get(style.get(f"{W}val"), 0) if style is not None else 0
                own = node.find(f"{W}pPr/{W}outlineLvl")
                level = min(6, int(own.get(f"{W}val")) + 1) if own is not None else level
                text = self._marker(node) + self._text(node)
                if text.strip():
                    yield "heading" if level else "text", level, f"{'#' * level} {text}" if level else text
                for box in node.iter(f"{W}txbxContent"):
                    yield from self._blocks(box)
            elif tag == "tbl":
                rows = [[" ".join(self._text(c).replace("|", "\\|").split()) for c in r.findall(f"{W}tc")] for r in node.findall(f"{W}tr")]
                rows = [r for r in rows if any(r)]
                width = max(map(len, rows), default=0)
                for i, r in enumerate(rows):
                    r += [""] * (width - len(r))
                    if width == 1:
                        yield "text", 0, r[0]
                        continue
                    yield "table_row", 0, f"| {' | '.join(r)} |"
                    if not i:
                        yield "table_row", 0, f"|{' --- |' * width}"
            elif tag in ("sdt", "sdtContent", "ins"):
                yield from self._blocks(node)

    def blocks(self) -> list[tuple[str, int, str]]:
        """Headers, body, notes, footers; headers and footers of one text once."""
        out, seen = [], set()
        for kind in ("header", "document", "footnotes", "endnotes", "footer"):
            for name in sorted(n for n in self.names if n.startswith(f"word/{kind}") and n.endswith(".xml")):
                root = self._tree(name)
                parts = [root.find(f"{W}body")] if kind == "document" else list(root) if kind.endswith("notes") else [root]
                own = [b for part in parts if part is not None for b in self._blocks(part)]
                key = tuple(own)
                if kind in ("header", "footer") and key in seen:
                    continue
                seen.add(key)
                out += own
        return out


def read(spark: SparkSession, path: str, most: int = 100 << 20) -> DataFrame:
    """Files below a path: file_name, kind, text, status, error."""
    return extract(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file_name"), "content"), most)


def extract(files: DataFrame, most: int = 100 << 20) -> DataFrame:
    """Text of files (file_name, content); PDF and images need tables from an outside reader."""
    name = F.col("file_name")
    rows = files.select("file_name", route(name).alias("kind"), refusal(name, F.coalesce(F.length("content"), F.lit(0)), most).alias("error"), "content")

    def run(batches):
        for batch in batches:
            out = []
            for kind, error, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "error", "content")), strict=True):
                if error:
                    out.append((None, 400, error))
                    continue
                try:
                    if kind == "text":
                        out.append((decode(data), 200, None))
                    elif kind == "docx":
                        out.append(("\n\n".join(b[2] for b in Docx(data).blocks()), 200, None))
                    else:
                        out.append((None, 501, "needs page segments or read words"))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, AttributeError):
                    out.append((None, 400, "the file can't be read"))  # no content in messages
            text, status, error = zip(*out, strict=True) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([batch.column("file_name"), batch.column("kind"), pa.array(text, pa.string()), pa.array(status, pa.int32()), pa.array(error, pa.string())], ["file_name", "kind", "text", "status", "error"])

    from redactlake.functions.text import clean_extracted

    found = rows.mapInArrow(run, "file_name string, kind string, text string, status int, error string")
    return found.withColumn("text", clean_extracted(F.col("text")))


def image_frames(images: DataFrame, limit: int = 300) -> DataFrame:
    """Frames of images (file_name, n_frames) that are read: all of a TIFF's up to one beyond the limit, which shows that there are more; of others the first."""
    many = F.least(F.col("n_frames"), F.lit(limit + 1))
    most = F.when(extension(F.col("file_name")).isin("tif", "tiff"), many).otherwise(F.least(F.col("n_frames"), F.lit(1)))
    return images.where(most > 0).select("file_name", F.explode(F.sequence(F.lit(0), (most - 1).cast("int"))).alias("frame"))


def requests(lines: DataFrame, most: int = 5_000_000) -> DataFrame:
    """JSON requests (doc_id, body): text, allow, deny, status, error; list items that are no strings are left out."""
    parsed = F.from_json("body", "text string, whitelist array<string>, blocklist array<string>")
    rows = lines.select("doc_id", F.col("body"), parsed.alias("r"))
    kind = F.regexp_extract(F.ltrim("body"), r"^(.)", 1)
    error = F.when(kind != "{", "the body must be an object").when(F.col("r.text").isNull() | (F.trim("r.text") == ""), "text is missing").when(F.length("r.text") > most, "the text is too long")
    status = F.when(error.isNull(), 200).when(error == "the text is too long", 413).otherwise(400)
    return rows.select("doc_id", "r.text", F.coalesce("r.whitelist", F.array().cast("array<string>")).alias("allow"), F.coalesce("r.blocklist", F.array().cast("array<string>")).alias("deny"), status.alias("status"), error.alias("error"))

"""Language ID: multinomial naive Bayes over hashed character n-grams.

Learning counts n-grams of 1 to 3 characters on the executors over about ``sample``
labelled documents of each language, chosen by a hash of their ids, so the matrix of
log-probabilities has ``languages x 2**bits`` entries whatever the corpus. Priors are the
languages' shares of all labelled documents. Both are broadcast; scoring hashes
batches of texts at once in numpy, and sums the matrix's rows at the letters of each.

Cases: a null text or one without a letter is ``und`` with score 0; without any
labelled row every text is ``und``; equal posteriors go to the language that
sorts first; null ids are scored and never learned from; repeated rows score alike and
are learned from as often as they stand; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.common import free_name, in_fold

BITS = 15  # buckets: 2 ** BITS
SAMPLE = 5000  # documents of a language that are learned from, about
LEAST = 0.5  # posterior below which a text is of no language
SMOOTH = 0.5
CHUNK = 1 << 20  # characters that are hashed at once
_MUL = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else that of the blank."""
    global _letters
    if _letters is None:
        _letters = np.full(0x110000, 32, dtype=np.uint32)
        own = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), dtype=np.uint32)
        _letters[own] = own
    return _letters


def hashed(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points (blanks for all but letters) and the three buckets of each place."""
    cp = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    x = np.concatenate([cp, np.full(2, 32, dtype=np.uint32)])
    a = x[:-2] * _MUL[0]
    b = (a ^ (a >> np.uint32(15))) + x[1:-1] * _MUL[1]
    c = (b ^ (b >> np.uint32(13))) + x[2:] * _MUL[2]
    shift = np.uint32(32 - bits)
    h = np.stack([(a * np.uint32(0x2C1B3C6D)) >> shift, (b * np.uint32(0x297A2D39)) >> shift, (c * np.uint32(0x85EBCA77)) >> shift])
    return cp, h


def chunks(text: str):
    """Pieces of a long text with the two characters that follow each."""
    for at in range(0, len(text), CHUNK):
        yield text[at : at + CHUNK + 2], min(CHUNK, len(text) - at)


def _counts(bits: int):
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to = sums.setdefault(lang, np.zeros(1 << bits, dtype=np.int64))
                for piece, n in chunks(text.lower()):
                    cp, h = hashed(piece, bits)
                    at = np.flatnonzero(cp[:n] != 32)
                    to += np.bincount(h[:, at].ravel(), minlength=1 << bits)
        for lang, to in sums.items():
            own = np.flatnonzero(to)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.astype(np.int32)), pa.array(to[own])], ["lang", "bucket", "n"])

    return count


class Model:
    """Learned languages in order, the (2**bits, languages) matrix of log-probabilities, and log-priors."""

    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray, bits: int = BITS):
        self.langs, self.table, self.prior, self.bits = langs, table, prior, bits


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = BITS, sample: int = SAMPLE) -> Model:
    """A model of the rows outside the held-out fold with text and language."""
    ready = docs.where(F.col(id_col).isNotNull() & ~in_fold(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ready = ready.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("order"))
    sizes = {r.lang: r.n for r in ready.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((1 << bits, 0)), np.zeros(0), bits)
    # The hashes are spread evenly over 64 bits, so a bound on them takes a share of a language's rows.
    edges = {lang: (1 << 63) - 1 if n <= sample else (sample * (1 << 64)) // n - (1 << 63) for lang, n in sizes.items()}
    bound = docs.sparkSession.createDataFrame(sorted(edges.items()), "lang string, edge long")
    rows = (
        ready.join(F.broadcast(bound), "lang")  # a row for each learned language
        .where("order <= edge")
        .select("lang", "text")
        .mapInArrow(_counts(bits), "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    langs = sorted(sizes)
    at = {lang: i for i, lang in enumerate(langs)}
    counts = np.full((1 << bits, len(langs)), SMOOTH)
    counts[rows.column("bucket").to_numpy(), [at[x] for x in rows.column("lang").to_pylist()]] += rows.column("n").to_numpy()
    total = sum(sizes.values())
    return Model(langs, np.log(counts / counts.sum(axis=0)), np.log(np.array([sizes[x] / total for x in langs])), bits)


def totals(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the matrix's rows at the letters of each text, and the number of its letters."""
    sums, seen = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), dtype=np.int64)
    held: list[tuple[int, str, int]] = []  # text, a piece of it with what follows, characters that count
    size, most = 0, max(1, 4 * CHUNK // max(4, len(model.langs)))

    def flush() -> None:
        nonlocal size
        cp, h = hashed("  ".join(piece for _, piece, _ in held), model.bits)
        length = np.array([len(piece) + 2 for _, piece, _ in held])
        start = np.cumsum(length) - length
        place = np.arange(len(cp)) - np.repeat(start, length)[: len(cp)]
        at = np.flatnonzero((cp != 32) & (place < np.repeat([n for _, _, n in held], length)[: len(cp)]))
        owner = np.repeat([i for i, _, _ in held], length)[at]
        if len(at):
            found = model.table[h[0, at]] + model.table[h[1, at]] + model.table[h[2, at]]
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sums[owner[head]] += np.add.reduceat(found, head)
            np.add.at(seen, owner[head], np.diff(np.append(head, len(owner))))
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        for piece, n in chunks(text):
            if held and size + len(piece) > most:
                flush()
            held.append((i, piece, n))
            size += len(piece)
    if held:
        flush()
    return sums, seen


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Predicted language and its posterior for each text."""
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    sums, seen = totals([(t or "").lower() for t in texts], model)
    sums += model.prior
    k = sums.argmax(axis=1)
    score = np.where(seen > 0, 1 / np.exp(sums - sums[np.arange(len(k)), k][:, None]).sum(axis=1), 0.0) if len(k) else np.zeros(0)
    return [model.langs[j] if n else "und" for j, n in zip(k.tolist(), seen.tolist(), strict=True)], score.tolist()


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows with lang_pred and score beside their own columns (or with _ before, on a clash)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, name, value = free_name(docs, "langid_text"), free_name(docs, "lang_pred"), free_name(docs, "score")

    def run(batches):
        for batch in batches:
            best, score = score_texts(batch.column(text).to_pylist(), shared.value)
            batch = batch.drop_columns([text])
            yield batch.append_column(name, pa.array(best, pa.string())).append_column(value, pa.array(score, pa.float64()))

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(value, T.DoubleType())])
    return docs.withColumn(text, F.col(text_col).cast("string")).mapInArrow(run, schema)


def accept(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST, languages: list[str] | None = None) -> DataFrame:
    """The rows of docs whose language the model tells: with a posterior of ``least``, and among ``languages`` where they are given.

    Without a model, for want of labelled rows, all rows with a letter stay.
    """
    model = model or fit(docs, id_col, text_col, lang_col)
    if not model.langs:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    name, value = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = predict(docs, model, id_col, text_col).where((F.col(name) != "und") & (F.col(value) >= least))
    return (found.where(F.col(name).isin(languages)) if languages else found).select(docs.columns)

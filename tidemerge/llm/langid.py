"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (languages x buckets) is fitted on a bounded sample of labelled rows, broadcast, and applied to whole
texts in sparse numpy batches: every n-gram is one gather from the matrix, every document one segment sum.

Defined results: a null text, an empty text or a text without a letter is ``und`` with score 0. Very long texts are scored in
pieces that overlap by two characters, so no n-gram is lost and memory stays bounded. Repeated rows get equal answers. With an
empty table, or no labelled row, nothing is learned and every text is ``und``. Only the id, text and label columns are read. Other
columns may have any name in the stage; ``predict`` refuses to keep one that is named like its own results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, numbered, slices, table

UNDEFINED = "und"
PIECE = 1 << 19


@dataclass(frozen=True)
class Options:
    """max_docs_per_lang bounds the labelled sample on average: of a label with more rows, a share is taken by a hash of id and text.
    max_langs bounds the broadcast matrix: of more labels, the commonest are learned. evidence is the number of n-grams at which a
    posterior stops sharpening, so that long texts do not all score 1."""

    bits: int = 15
    sizes: tuple[int, ...] = (1, 2, 3)
    smoothing: float = 0.5
    max_docs_per_lang: int = 5000
    max_langs: int = 256
    evidence: int = 50


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logp: np.ndarray = field(repr=False)  # languages x buckets
    options: Options = Options()


_ALPHA: np.ndarray | None = None


def _alpha() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _ALPHA


def ngram_blocks(texts: list[str | None], options: Options) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(documents, buckets for each n-gram size, start and end of each piece, pieces with a letter) for blocks of bounded size.

    Letters are lower-cased and all else becomes a blank; two blanks part the texts, so no n-gram mixes two of them.
    """
    docs: list[int] = []
    parts: list[str] = []
    lens: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for at in range(0, len(low), PIECE):
            part = low[at : at + PIECE + 2]
            docs.append(i)
            parts.append(part)
            lens.append(min(PIECE, len(low) - at))
            held += len(part) + 2
            if held >= PIECE:
                yield _block(docs, parts, lens, options)
                docs, parts, lens, held = [], [], [], 0
    if docs:
        yield _block(docs, parts, lens, options)


def _block(docs: list[int], parts: list[str], lens: list[int], options: Options):
    code = np.frombuffer("\n\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _alpha()[code]
    code = np.where(letter, code, np.uint32(0))
    starts = np.concatenate(([0], np.cumsum([len(p) + 2 for p in parts])[:-1])).astype(np.int64)
    ends = starts + np.asarray(lens, dtype=np.int64)
    buckets, h = [], np.zeros(len(code), dtype=np.uint32)
    for n in range(1, max(options.sizes) + 1):
        shifted = np.zeros_like(code)
        shifted[: len(code) - n + 1] = code[n - 1 :]
        h = h * np.uint32(0x01000193) + shifted + np.uint32(n)
        if n in options.sizes:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            buckets.append((mixed >> np.uint32(32 - options.bits)).astype(np.int32))
    has = np.add.reduceat(letter.astype(np.int64), np.stack([starts, ends], 1).ravel())[::2] > 0 if len(docs) else np.zeros(0, bool)
    return np.asarray(docs), buckets, np.stack([starts, ends], 1), has


def fit(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, allowed: Column | None = None, options: Options = Options()) -> Model:
    """Learn from the rows with a label for which allowed holds, about max_docs_per_lang of them for each language. The sample is a
    filter on the rows, so texts are never shuffled."""
    rows = docs.select(col(id_col).cast("string").alias("id"), col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"), (allowed if allowed is not None else F.lit(True)).alias("ok"))
    rows = rows.where("ok AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", "id")
    counted = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(options.max_langs).collect()}
    langs = sorted(counted)
    size = 1 << options.bits
    if not langs:
        return Model([], np.zeros((0, size)), options)
    share = F.create_map(*[x for k, n in counted.items() for x in (F.lit(k), F.lit(min(1.0, options.max_docs_per_lang / n)))])
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003
    sample = rows.where(F.col("lang").isin(*langs) & drawn).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                names = part.column("lang").to_pylist()
                for ids, buckets, spans, _ in ngram_blocks(part.column("text").to_pylist(), options):
                    for i, (s, e) in zip(ids, spans, strict=True):
                        into = sums.setdefault(names[i], np.zeros(size, dtype=np.int64))
                        for b in buckets:
                            into += np.bincount(b[s:e], minlength=size)
        for name, total in sums.items():
            (at,) = total.nonzero()
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # at most languages x buckets rows
    matrix = np.full((len(langs), size), options.smoothing)
    matrix[[langs.index(x) for x in got["lang"]], got["bucket"].to_numpy(dtype=int)] += got["n"].to_numpy(dtype=float)
    return Model(langs, np.log(matrix / matrix.sum(axis=1, keepdims=True)), options)


def predict_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    count = len(texts)
    total, grams, letters = np.zeros((len(model.langs), count)), np.zeros(count), np.zeros(count, dtype=bool)
    for ids, buckets, spans, has in ngram_blocks(texts, model.options):
        edges = spans.ravel()
        for k, row in enumerate(model.logp):
            at = row[buckets[0]]
            for b in buckets[1:]:
                at = at + row[b]
            np.add.at(total[k], ids, np.add.reduceat(at, edges)[::2])
        np.add.at(grams, ids, (spans[:, 1] - spans[:, 0]) * len(buckets))
        np.logical_or.at(letters, ids, has)
    if not model.langs:
        return [UNDEFINED] * count, np.zeros(count)
    best = total.argmax(axis=0)
    cooled = (total - total.max(axis=0)) / np.maximum(1.0, grams / model.options.evidence)
    score = np.where(letters, 1.0 / np.exp(cooled).sum(axis=0), 0.0)
    return [model.langs[b] if ok else UNDEFINED for b, ok in zip(best, letters, strict=True)], np.round(score, 6)


def _predicted(rows: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """The kept ones of rows' columns, which are numbered(), with lang_pred and score; text names their column of texts. One pass, no
    shuffle, the matrix broadcast (languages x buckets doubles)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, text):
                part = batch.slice(lo, hi - lo)
                langs, score = predict_texts(part.column(text).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, *, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns with lang_pred and score."""
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("kept columns can't be named lang_pred or score")
    rows = numbered(docs.select(*[col(c) for c in keep], col(text_col)))
    return _predicted(rows, model, rows.columns[-1], rows.columns[:-1]).toDF(*keep, "lang_pred", "score")


def held_out(id_col: str) -> Column:
    """Whether a document is kept from learning; a null id never is held out."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 5 == 0, F.lit(False))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.5) -> DataFrame:
    """Documents in a language that is known with at least min_score; the columns stay as they are."""
    model = fit(docs, id_col="doc_id", text_col="text", lang_col="lang", allowed=~held_out("doc_id"))
    names = docs.columns
    rows = numbered(docs)
    judged = _predicted(rows, model, rows.columns[names.index("text")], rows.columns)
    return judged.where((F.col("lang_pred") != UNDEFINED) & (F.col("score") >= min_score)).drop("lang_pred", "score").toDF(*names)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, id_col="doc_id", text_col="text", lang_col="lang", allowed=~held_out("doc_id"))
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return predict(rows, model, text_col="text", keep=["doc_id", "held_out"])

"""Best-fit packing of token sequences, certified by lower bounds.

Documents are tokenised once and cut into pieces of at most ``capacity`` ids. Full pieces stand alone. The others are dealt into
cells of bounded size by a hash of their row, each cell is packed by best-fit decreasing, and dual-feasible functions give a lower
bound for its number of bins. A cell whose count meets the bound is certified. Cells with a gap give back the documents of their
emptiest bins, and every cell gives back its emptiest bin; what is given back is dealt anew, so that cells exchange documents, and
packed again, until one cell is left or the rounds are used up. Every piece gets a place in every case. ``certified`` says of each
piece whether the bins of its cell's last packing were as few as the bound (a full piece needs a bin of its own); ``certificate`` sets
the number of all sequences against the bound for all pieces together.

Defined results: null or empty text is one id, the end mark 0. A very long text is tokenised in segments parted at spaces and gives
many pieces. Repeated rows (a repeated or null id) are placed each on its own. Ties in length go by row number. An empty table gives
an empty result. Only the id and text columns are read; the columns of the result are fixed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, slices, table, written

CAPACITY = 2048
END = (0).to_bytes(4, "little")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of a lower-casing word tokenizer as little-endian 32-bit bytes, with a memory for words.

    Its tokens never cross white space, so texts made of Latin letters, digits and ASCII signs are taken word by word and each
    distinct word is tokenised once; all other texts go through the tokenizer as a whole, parted at spaces. Two generations of at
    most MEMORY words bound the memory.
    """

    MEMORY = 250_000
    SEGMENT = 1 << 18
    _PLAIN = re.compile(r"[\t-\r\x20-\x7e¡-įı-ɏ]*")
    # Fixed value: the pre-tokenizer's pattern.
    _WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.SEGMENT:
            cut = text.find(" ", at + self.SEGMENT)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _piece(self, piece: str) -> bytes:
        out = self.young.get(piece) or self.old.get(piece)
        if out is None:
            coded = piece.encode().decode("latin1").translate(self.letters)
            out = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(coded))
        return self._keep(piece, out)

    def _keep(self, word: str, out: bytes) -> bytes:
        if len(self.young) >= self.MEMORY:
            self.old, self.young = self.young, {}
        self.young[word] = out
        return out

    def _word(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            pieces = self._WORDS.findall(word)
            if len(pieces) == 1 and pieces[0] == word:
                return self._piece(word)
            out = b"".join(map(self._piece, pieces))
        return self._keep(word, out)

    def encode(self, text: str) -> Iterator[bytes]:
        if self._PLAIN.fullmatch(text) and "<|" not in text:
            for segment in self.segments(text):
                words = segment.lower().split()
                known = self.young
                found = list(map(known.get, words))
                if None in found:
                    found = [x if x is not None else self._word(w) for x, w in zip(found, words, strict=True)]
                yield b"".join(found)
        else:
            for segment in self.segments(text):
                yield np.asarray(self.whole.encode(segment, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pieces_of(chunks: Iterator[bytes], capacity: int) -> Iterator[tuple[int, int]]:
    """(length, crc) of each piece of at most capacity ids, the end mark included."""
    held, size = bytearray(), 4 * capacity
    for chunk in chunks:
        held += chunk
        while len(held) > size:
            yield capacity, zlib.crc32(held[:size])
            del held[:size]
    held += END
    while len(held) > size:
        yield capacity, zlib.crc32(held[:size])
        del held[:size]
    yield len(held) // 4, zlib.crc32(held)


def tokenised(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    path = path or tokenizer_path()
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(path)
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                owner, number, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    at = 0
                    for k, (n, c) in enumerate(pieces_of(words.encode(text), capacity)):
                        owner.append(i)
                        number.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(c)
                        at += n
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner, pa.int32())), pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; ties go by position. An integer with a bit for each free size finds the best bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            free[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound from two families of dual-feasible functions, from the histogram of lengths."""
    have = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((have * size).sum()) // capacity)
    for eps in range(1, capacity // 2 + 1):  # long items count whole, short ones not at all
        total = int(have[capacity - eps + 1 :].sum()) * capacity + int((have[eps : capacity - eps + 1] * size[eps : capacity - eps + 1]).sum())
        best = max(best, -(-total // capacity))
    for k in range(1, 33):  # rounding down to k-ths, kept where exact
        whole = (k + 1) * size % capacity == 0
        total = int((have * np.where(whole, k * size, (k + 1) * size // capacity * capacity)).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def _round(rows: DataFrame, cells: int, number: int, capacity: int, release: float, last: bool) -> DataFrame:
    """The rows with sequence_id and offset; null for what is given back."""
    keep = rows.schema.names
    schema = T.StructType(rows.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("certified", T.BooleanType())])

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.select(keep).combine_chunks().sort_by("rid")
        lengths = group.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        made = int(bins.max()) + 1
        empty = capacity - np.bincount(bins, weights=lengths, minlength=made).astype(np.int64)
        certified = made == lower_bound(lengths, capacity)
        back = 0 if last else 1 if certified else max(1, int(release * made))
        given = np.zeros(made, dtype=bool)
        given[np.argsort(-empty, kind="stable")[:back]] = True
        given &= empty > 0
        sequence = (number << 58) + (int(key[0].as_py()) << 24) + bins
        gone = given[bins]
        group = group.append_column("sequence_id", pa.array(sequence, pa.int64(), mask=gone)).append_column("offset", pa.array(offsets, pa.int64(), mask=gone))
        return group.append_column("certified", pa.array(np.full(len(lengths), certified)))

    cell = F.pmod(F.xxhash64("rid", F.lit(number)), F.lit(cells))
    return rows.withColumn("cell", cell).groupBy("cell").applyInArrow(pack, schema)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, cell_rows: int = 1 << 17, release: float = 0.05, rounds: int = 4) -> DataFrame:
    """pieces (with a column length) with sequence_id, offset and certified.

    cell_rows bounds what one task packs; the number of cells follows the input. The rounds shrink quickly: only what cells give
    back is dealt again.
    """
    names = pieces.columns
    rows = written(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    placed = [rows.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("rid")).withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True))]
    open_rows = rows.where(F.col("length") < capacity)
    for number in range(1, rounds + 1):
        count = open_rows.count()
        if not count:
            break
        cells = -(-count // cell_rows)
        last = cells == 1 or number == rounds
        done = _round(open_rows, cells, number, capacity, release, last)
        if last:
            placed.append(done)
            break
        done = written(done, f"packed-{number}")
        placed.append(done.where("sequence_id IS NOT NULL"))
        open_rows = done.where("sequence_id IS NULL").select(rows.columns)
    out = placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    return out.select(*names, "sequence_id", "offset", "certified")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, lower bound for any packing) from the histogram of lengths, which has at most capacity rows."""
    used = packed.agg(F.countDistinct("sequence_id")).first()[0]
    got = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    have = np.zeros(capacity + 1, dtype=np.int64)
    for r in got:
        have[r["length"]] = r["n"]
    return used, lower_bound(np.repeat(np.arange(capacity + 1), have), capacity)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents; a document that comes twice is packed twice."""
    return pack(tokenised(docs))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenised(table(spark, sf_dir, "documents")))

"""The pipeline against a brute-force version on a small table."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tidemerge.llm import mixing, neardup, packing, secret_scan

ENGLISH = "the old keeper walked along the quiet harbour and counted the {} boats that came home before the storm while the children of the village waited on the wall with their lanterns"
FRENCH = "le vieux gardien marchait le long du port tranquille et comptait les {} bateaux qui rentraient avant la tempête pendant que les enfants du village attendaient sur le mur"


def fixture() -> list[dict]:
    rows = []
    for i in range(40):
        words = " ".join(f"{'mot' if i % 2 else 'word'}{i}x{k}" for k in range(30))
        rows.append(((FRENCH if i % 2 else ENGLISH).format(i) + " " + words, "fr" if i % 2 else "en", ("hot", "hot", "cold", None)[i % 4]))
    rows += [rows[3], (rows[4][0] + " end", "en", "cold"), (None, "en", "hot"), ("", None, "hot"), ("12 34 !!", "en", "cold")]
    rows.append((rows[0][0].replace("word", "term") + ' password = "abcdefGHIJKL12" here', "en", "cold"))
    rows.append((" ".join(f"{ENGLISH.format(k)} line{k}" for k in range(120)), "en", "cold"))
    return [{"doc_id": i, "text": t, "lang": lang, "source": s, "n_chars": len(t or "")} for i, (t, lang, s) in enumerate(rows)]


def shingles(text: str) -> set[tuple[str, ...]]:
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute_force(rows: list[dict]) -> Counter:
    """Pieces (doc_id, piece, start, length, ids_crc32) with their number."""
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    lead = {r["doc_id"]: r["doc_id"] for r in rows}
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((lead[a], lead[b]))
                lead = {k: lo if v == hi else v for k, v in lead.items()}
    rows = [r for r in rows if lead[r["doc_id"]] == r["doc_id"]]
    texts = {}
    for r in rows:
        text = secret_scan.masked(r["text"], [(s, e) for s, _, e in secret_scan.brute_force(r["text"])], "<SECRET>")
        texts[r["doc_id"]] = text
        r.update(text=text, n_chars=len(text))
    con = duckdb.connect()
    documents = pa.Table.from_pylist(rows)
    con.register("documents", documents)
    tokenizer = packing.WordTokenizer(packing.tokenizer_path()).whole
    out: Counter = Counter()
    for (doc,) in con.sql(f"SELECT doc_id FROM ({mixing.OP2_SQL})").fetchall():
        ids = [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            out[doc, piece, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    return out


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    pq.write_table(pa.Table.from_pylist(fixture()), at / "documents.parquet")
    return corpus_pipeline.run(spark, str(at)).collect()


def test_same_pieces_as_brute_force(packed):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == brute_force(fixture())


def test_sequences_are_gapless(packed):
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    pq.write_table(pa.Table.from_pylist(fixture()).slice(0, 0), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_from_80_percent_on_go(spark):
    """Brute force at 80: pairs that share from 70 to 90 percent of their shingles, each in words of its own."""
    rows = []
    for i in range(40):
        words = [f"w{i}x{k}" for k in range(100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[: 80 + i // 2], *(f"v{i}x{k}" for k in range(i // 4))]))]
    sets = {i: shingles(t) for i, t in rows}
    alike = {i: 100 * len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 80, 2)}
    assert sum(80 <= a < 85 for a in alike.values()) > 5 and min(alike.values()) < 80 and max(alike.values()) > 85
    got = {r.doc_id for r in neardup.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {i for i in sets if i % 2 == 0 or alike[i - 1] < 80}

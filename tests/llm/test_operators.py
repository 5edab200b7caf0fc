"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, and none at all."""

import hashlib
import re
import time
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemerge.llm import chat, common, langid, mixing, neardup, packing, pii, quality, secret_scan, urls, webp

TEXTS = ["the cat sat on the mat and looked at the moon. " * 3, "le chat est sur la table et regarde la lune avec joie. " * 3, None, "", "1234 !!", "mail a.b@c.example.org, +1 (319) 555-5132 or 10.0.0.1", "card 4425414259157784 and token = \"24be64439e3e49cf46b2d7c9\"", "x " * 30000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id int, n long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "fr" if i % 8 == 1 else "en", "hot" if i % 3 else None, len(t or ""), "k", 1, 2) for i, t in enumerate(TEXTS * 2)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id here at all", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(docs, none):
    for d, n in ((docs, docs.count()), (none, 0)):
        model = langid.fit(d, id_col="doc_id", text_col="text", lang_col="lang")
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(d, model, text_col="text", keep=["doc_id"]).collect()}
        assert len(got) == (17 if n else 0)
    assert got == {} and model.langs == []
    model = langid.fit(docs, id_col="doc_id", text_col="text", lang_col="lang", allowed=F.col("n_chars").between(20, 1000))
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model, text_col="text", keep=["doc_id"]).collect()}
    assert got[0] == "en" and got[1] == "fr" and got[2] == got[3] == got[4] == "und"


def test_packing(docs, none):
    packed = packing.pack(packing.tokenised(docs), cell_rows=4)
    used, bound = packing.certificate(packed)
    assert bound <= used <= bound + 3
    whole = packing.pack(packing.tokenised(docs))
    assert whole.where("certified").count() == whole.count() and packing.certificate(whole)[0] == packing.certificate(whole)[1]
    got = packed.collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert sum(r.piece == 0 for r in got) == docs.count()
    assert packing.pack(packing.tokenised(none)).count() == 0


def test_near_duplicates(spark, docs, none):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    for i in range(8):
        want = i if TEXTS[i] else i + 8
        assert got[i].component_id == i and got[i + 8].component_id == (i if TEXTS[i] else want)
    assert got[None].kept and neardup.near_duplicates(none).count() == 0
    assert neardup.stage(spark, docs, "").where("doc_id = 0").count() == 1


def test_different_texts_under_one_id_stay(spark):
    one, other, third = ("first second third fourth fifth sixth " + w for w in ("seventh", "and then other words", "but nothing like these at all"))
    rows = [(7, one, "a"), (7, one, "a"), (7, other, "b"), (10, one, "c"), (9, one, "d"), (None, third, "e"), (None, third, "f"), (None, None, "g"), (8, "alone here", "h")]
    for kind in ("long", "string"):
        given = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("doc_id", F.col("doc_id").cast(kind))
        out = sorted((str(r.doc_id), r.text or "") for r in neardup.stage(spark, given, "").collect())
        first = "7" if kind == "long" else "10"  # the smallest id, as numbers or as strings
        assert out == sorted([(first, one), ("7", other), ("8", "alone here"), ("None", third), ("None", "")])


def test_secrets(docs, none):
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secret_scan.scan(docs, text_col="text", keep=["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == [(s, e) for s, _, e in secret_scan.brute_force(t)]
    assert secret_scan.redact(docs, text_col="text").columns == docs.columns and secret_scan.redact(none, text_col="text").count() == 0


def test_pii_base_and_examples(spark, docs, none):
    nothing = pii.Model([], [9.0, 9.0, 9.0])
    found = {r.doc_id: r for r in pii.detect(docs, model=nothing).collect()}
    named = [pii.KINDS[s["rank"]] for s in found[5].base]
    assert named == ["email", "phone", "ip"] and [pii.KINDS[s["rank"]] for s in found[6].base] == ["card"]
    assert found[2].base == found[3].base == [] and pii.detect(none, model=nothing).count() == 0


@pytest.fixture(scope="module")
def fitted(docs):
    return pii.fit(docs)


def test_pii_held_out_and_unseen(spark, docs, none, fitted):
    recall, precision = fitted.measured
    assert recall >= 0.9 and precision >= 0.95
    personal = ["my number is 0171 2345678", "social security 321-54-9876", "Dial 212.555.0147 for help", "john (at) foo (dot) com", "मेरा फ़ोन नंबर 98765 43210 है", "Visit me, 415-555-2671, ok", "IBAN: GB82WEST12345698765432", "DE44 5001 0517 5407 3249 31", "peter.pan [at] neverland [dot] org", "Mi teléfono: 612 345 678."]
    other = ["ISBN 978-3-16-148410-0", "order 4785380592391135", "pi 3.14159265358979", "between 1990-1995 200", "MODEL AB12 CDEF GHIJ KLMN", "12 34 56 78 90 12 34 56 78 90 11", "on 2024-01-01 12:30", "### 9061847325016###", "stop (at) 10.30", "9" * 60000, "a" * 200000]
    rows = spark.createDataFrame(list(enumerate([*personal, *other])), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.detect(rows, model=fitted).collect()}
    assert sum(len(spans[i]) == 1 for i in range(len(personal))) >= 9
    assert all(spans[i] == [] for i in range(len(personal), len(spans)))
    clean = pii.redacted(pii.detect(docs, model=fitted)).where("doc_id = 5").first().clean_text
    assert clean == "mail [PII], [PII] or [PII]"
    assert pii.redacted(pii.detect(none, model=fitted)).count() == 0


def test_pii_overlaps(spark):
    """Of A, B and C, where B meets both and A and C don't meet, A and C stay; many spans take time in proportion."""
    rows = spark.sql("SELECT array(named_struct('start', 0, 'upto', -5, 'rank', 4), named_struct('start', 3, 'upto', -9, 'rank', 5), named_struct('start', 7, 'upto', -12, 'rank', 4)) AS few, transform(sequence(0, 19999), i -> named_struct('start', 2 * i, 'upto', -2 * i - 3, 'rank', 4)) AS many")
    got = rows.select(pii._greedy(F.col("few")).alias("few"), pii._greedy(F.col("many")).alias("many")).first()
    assert [(x.start, x.end) for x in got.few] == [(0, 5), (7, 12)] and [x.start for x in got.many] == list(range(0, 40000, 4))
    text = " ".join(f"a{i}@b.co {i % 900 + 100}-555-{i % 9000 + 1000}" for i in range(8000))
    began = time.perf_counter()
    found = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), model=pii.Model([("leaf", 1.0)], [0.5] * 3)).first()
    assert len(found.base) == 8000 and len(found.spans) == 16000 and time.perf_counter() - began < 60


def test_pii_base_equals_brute_force_on_all_documents(spark):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        odd = [int(c) for c in d[::-1]]
        return sum(odd[::2]) + sum(sum(divmod(2 * x, 10)) for x in odd[1::2])

    def keeps(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = ["a@b.c_d@e.f.", "x@y", "..@a.b", "1.2.3.4.5.6.7.8", "300.1.1.1 001.002.003.004", "+1 (2)3.4-5 678901 2 +12", "4111 1111-1111 1111 4111111111111111 5", "+1234567890123456", "é 10.0.0.1 日本 a@b.co"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for r in pii.with_base(rows, "doc_id", "text").collect():
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(plain[kind], r.text) if keeps(kind, m[0]))
        assert [(s["start"], s["rank"], s["end"]) for s in r.base] == want, r.text[:100]


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    for i, t in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)} if len(words) < 100 else set(range(len(words)))
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(words), len(covered), sum(map(len, words)))
    assert quality.judged(none).count() == 0


def test_sentence_marks_of_other_scripts(spark):
    hindi = "यह एक साधारण वाक्य है जिसमें कई शब्द हैं और यह किसी नियम को नहीं तोड़ता है।"
    arabic = "هذه جملة عادية فيها كلمات كثيرة ولا تخالف أي قاعدة من قواعد النص هنا؟"
    cjk = " ".join("这是一个普通的句子") + " 里面 有 很多 词 而且 结束 了。"
    rows = [(1, f"{hindi}\n{hindi[::1]} {hindi}"), (2, f"{arabic} {arabic}"), (3, cjk), (4, "one two three four five six seven eight nine ten eleven twelve"), (5, "\tone two three four five six seven eight nine ten eleven\t")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].lost_chars == 0 for i in range(1, 6)] == [True, True, True, False, True]


def test_mixing(docs, none):
    got = mixing.mix(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() > 0
    used = got.select(mixing.word_count(got["text"]).alias("n")).agg({"n": "sum"}).first()[0]
    assert used <= docs.select(mixing.word_count(docs["text"]).alias("n")).agg({"n": "sum"}).first()[0]
    assert mixing.mix(none).count() == 0


def test_urls(spark):
    html = lambda *to: "".join(f'<a href="http://{t}/x">' for t in to)
    rows = [(1, "http://bad.example/1", ""), (2, "http://hub.example/1", html("bad.example", "bad.example")), (3, "http://good.example/1", html("fine.example")), (4, "HTTP://Fine.Example?x", None), (5, None, None), (6, "nothing", "x"), (7, "http://a.b.com/en/1#x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("bad.example", 0, 1), ("good.example", 1, 0)], "host string, trusted int, blocked int")
    got = {r.page_id: r for r in urls.judge(pages, seeds=seeds).collect()}
    assert [got[i].verdict for i in range(1, 8)] == ["block", "block", "allow", "allow", "allow", "allow", "block"]
    assert (got[4].host, got[4].path, got[5].host, got[7].rule, got[7].path) == ("fine.example", "", "", "com/en/", "/en/1")
    assert urls.judge(pages.limit(0)).count() == 0


def test_ranks_equal_power_iteration(spark):
    """Dense power iteration in which a host without links hands its mass back to the seeds."""
    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("b", "d", 3), ("e", "a", 1)]
    hosts, seeds = "abcde", {"a": 1.0, "e": 3.0}
    home = [seeds.get(h, 0.0) / 4 for h in hosts]
    out = {h: sum(n for s, _, n in edges if s == h) for h in hosts}
    rank = home
    for _ in range(200):
        lost = sum(r for h, r in zip(hosts, rank) if not out[h])
        rank = [0.15 * s + 0.85 * (lost * s + sum(n / out[a] * rank[hosts.index(a)] for a, b, n in edges if b == h)) for h, s in zip(hosts, home)]
    given = spark.createDataFrame(edges, "src string, dst string, n long")
    trusted = spark.createDataFrame([(h, w, 0.0) for h, w in seeds.items()], "host string, trusted double, blocked double")
    got = {r.host: r.trust for r in urls.propagate(given, trusted, urls.Options(steps=60)).collect()}
    assert got == pytest.approx(dict(zip(hosts, rank)), abs=1e-3)


def test_production_options_reach_the_fixed_point(spark):
    """Against dense power iteration, at the options of the query: a chain h14 -> ... -> h0 with one blocked seed h0, a ring of 200
    hosts around which trust flows, and hosts without links that hang from it and hand their mass back to the seed."""
    edges = [(f"h{k}", f"h{k - 1}", 1) for k in range(1, 15)] + [(f"r{k}", f"r{(k + 1) % 200}", 3) for k in range(200)] + [(f"r{k}", f"d{k}", 1) for k in range(0, 200, 7)]
    seeds = spark.createDataFrame([("h0", 0.0, 1.0), ("r0", 1.0, 0.0)], "host string, trusted double, blocked double")
    ranks = urls.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), seeds).collect()
    distrust, trust = ({r.host: r[kind] for r in ranks if r[kind]} for kind in ("distrust", "trust"))
    assert distrust == pytest.approx({f"h{k}": 0.85**k / sum(0.85**j for j in range(15)) for k in range(15)}, abs=1e-4)
    hosts = sorted({h for s, d, _ in edges for h in (s, d)})
    at = {h: i for i, h in enumerate(hosts)}
    moves = np.zeros((len(hosts), len(hosts)))
    for s, d, n in edges:
        moves[at[d], at[s]] = n
    out = moves.sum(axis=0)
    moves /= np.where(out, out, 1.0)
    home = np.zeros(len(hosts))
    home[at["r0"]] = 1.0
    rank = home.copy()
    for _ in range(2000):
        rank = 0.15 * home + 0.85 * (moves @ rank + rank[out == 0].sum() * home)
    assert [trust.get(h, 0.0) for h in hosts] == pytest.approx(rank, abs=1e-5)
    blocked = urls.blocked_hosts(spark.createDataFrame(ranks), seeds).collect()
    assert {r.host for r in blocked} == {f"h{k}" for k in range(15) if distrust[f"h{k}"] >= 0.05} and len(blocked) == 8


def test_chat_templates_are_black_boxes(spark):
    """500 turns; templates without a parser, two of which rewrite history past any block: all equal to whole rendering."""
    turns = [("assistant" if i % 2 else "user", f"turn {i} <#\\\\> é" * (i % 4)) for i in range(500)]
    plain = lambda ts: "".join(f"[{r}]{t}\n" for r, t in ts)
    counted = lambda ts: f"{len(ts)} turns|{plain(ts)}"
    late = lambda ts: "LONG\n" * (len(ts) > 300) + plain(ts)
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    said = [t for r, t in turns if r == "assistant"]
    read = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    for template, rewrites in ((plain, 0), (counted, 499), (late, 1)):
        got = chat.formatted(rows, template=template).first()
        assert (got.formatted_chars, got.rewritten_turns, got.unread_turns) == (len(template(turns)), rewrites, 0)
        assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (500, read, sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    blocks = {tuple(chat.formatted(rows, block=b).first()) for b in (1, 16, 1000)}
    assert len(blocks) == 1 and next(iter(blocks))[2] == read
    with pytest.raises(Exception, match="declared to append"):
        chat.formatted(rows, template=chat.Template(counted, appends=True)).collect()


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "no"), (2, 0, None, None), (None, 5, "assistant", "\\")]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=2).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 5, hashlib.sha256(b"noyes").hexdigest())
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[None].loss_chars == 1


def test_media(docs, none):
    got = {r.doc_id: r for r in webp.media_rows(docs).collect()}
    for i, t in enumerate(TEXTS):
        payload, n = webp.payload_of(t)
        assert (got[i].n_bytes, got[i].payload_sha256) == (n, hashlib.sha256(payload).hexdigest()) and got[i].media_sha256 == got[i + 8].media_sha256
    assert webp.media_rows(none).count() == 0


def test_given_media_become_pixels(spark):
    pixels = np.array([[0xFF102030, 0x80FF0001], [0, 0xFFFFFFFF], [7, 7]], dtype=np.uint32)
    file = webp.encode(pixels)
    rows = [(1, file), (2, webp.encode(pixels, webp.GREY) + file), (3, file[:-6]), (4, b"GIF89a"), (5, None), (6, b""), (7, file + b"junk")]
    got = {(r.doc_id, r.image): r for r in webp.decoded(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert set(got) == {(1, 0), (2, 0), (2, 1), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (7, 1)}
    whole = {k for k, r in got.items() if r.error is None}
    assert whole == {(1, 0), (2, 0), (2, 1), (7, 0)}
    assert all((got[k].height, got[k].width, bytes(got[k].pixels)) == (3, 2, pixels.astype("<u4").tobytes()) for k in whole)
    assert all(r.pixels is None and r.height is None for k, r in got.items() if k not in whole)


def test_media_of_all_documents_come_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in webp.media_rows(docs).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        m = got[r.doc_id]
        assert (m.n_bytes, m.payload_bytes, m.payload_sha256, m.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (m.media_bytes, m.media_sha256) == (len(m.media), hashlib.sha256(m.media).hexdigest())
        assert (webp.decode(bytes(m.media)) & 0xFF).astype(np.uint8).tobytes() == payload


def test_secrets_of_all_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secret_scan.scan(docs, text_col="text", keep=["doc_id"]).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == [(s, e) for s, _, e in secret_scan.brute_force(r.text)]


def test_languages_of_all_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, id_col="doc_id", text_col="text", lang_col="lang", allowed=~langid.held_out("doc_id"))
    rows = docs.where(langid.held_out("doc_id") & F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    got = langid.predict(rows, model, text_col="text", keep=["doc_id", "lang"]).collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    few = langid.fit(docs, id_col="doc_id", text_col="text", lang_col="lang", options=langid.Options(max_langs=2))
    assert len(few.langs) == 2


CLASHING = ("lang_pred", "score", "__text", "text.x", "spans", "c0", "c1", "key", "id", "n", "w", "component", "component_id", "kept", "rep", "sig", "t", "i", "j", "rid", "cell", "length", "__mix_source", "__mix_order", "blocks", "whole", "base", "candidates", "g0", "m0", "lines", "words", "h")


@pytest.mark.parametrize("ids", ["long", "string"])
def test_columns_may_have_any_name_and_ids_any_type(spark, ids):
    rows = [(f"{i:03d}", t, "en", "s", *(["x"] * len(CLASHING))) for i, t in enumerate([*TEXTS[:2], TEXTS[0], *TEXTS[2:6]])]
    names = ["doc_id", "text", "lang", "source", *CLASHING]
    given = spark.createDataFrame(rows, "struct<" + ",".join(f"`{c}`:string" for c in names) + ">").withColumn("doc_id", F.col("doc_id").cast(ids))
    for stage in (langid.stage, neardup.stage, secret_scan.stage, mixing.stage):
        out = stage(spark, given, "")
        assert out.columns == names and 0 < out.count() <= 14 and out.schema["doc_id"].dataType == given.schema["doc_id"].dataType
    assert packing.stage(spark, given, "").count() >= 7
    for found in (pii.detect(given, model=pii.Model([], [9.0] * 3)), quality.judged(given), neardup.near_duplicates(given), webp.media_rows(given)):
        assert found.count() == 7
    for call in (lambda: mixing.mix(given), lambda: langid.predict(given, langid.fit(given, id_col="doc_id", text_col="text", lang_col="lang"), text_col="text", keep=["score"])):
        with pytest.raises(ValueError):
            call()


def test_crowded_buckets_lose_no_link(spark):
    """Texts that share a long passage, some of them linked: buckets are dealt anew by rare shingles, ids are strings."""
    common, rows = [f"b{k}" for k in range(60)], []
    for i in range(120):
        words = common + [f"u{i}x{k}" for k in range((20, 25, 120)[i % 3])]
        rows.append((f"d{i:03d}", words))
        for copy in "ef" * (i % 5 == 0):
            words = [*words[: 7 * i % len(words)], "edit" + copy, *words[7 * i % len(words) + 1 :]]
            rows.append((f"{copy}{i:03d}", words))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    lead = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                lo, hi = sorted((lead[a], lead[b]))
                lead = {k: lo if v == hi else v for k, v in lead.items()}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id string, text string")
    for options in (neardup.Options(tile=8, split=16), neardup.Options()):
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, options=options).collect()} == lead


def test_intermediate_tables_need_a_shared_folder(spark):
    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        common.scratch_dir(SimpleNamespace(sparkContext=context, conf=conf))

"""Personal data: candidate spans scored by gradient-boosted trees.

Base patterns give spans that always stay. Besides them, generators with high recall propose spans that may overlap: addresses with
written-out signs, runs of digits of any grouping, and account codes. Each candidate gets format features (digits, groups, separators,
checksums, first signs) and context features (words just before, the characters around). Boosted trees over these, fitted here, give a
margin, which is turned into a probability, and a threshold for each generator selects what is added.

The trees learn from generated examples: formats filled with hashed digits and names, set between phrases that speak for or against
personal data and between windows of the corpus (a bounded sample of documents). Two fifths of the examples are held out: on them the
margin is calibrated to a probability. Thresholds are the least at which held-out examples and, by that probability, the candidates of
all documents reach the target precision. All of it is column expressions; the driver sees counts of feature combinations of the
examples, and of rounded margins of the corpus. Scoring is part of a row's own projection, with no shuffle and no Python.

Defined results: null text counts as empty and has no spans. Very long texts are handled whole; patterns neither recurse nor start
anew inside a run they have failed on, positions are summed in three levels, and overlaps are told from ranks in sorted lists, so that
the work grows with the number of matches and not with its square. Repeated rows give equal results. An empty table gives an empty
result. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table

KINDS = ("email", "ip", "card", "phone")
# The base patterns, with possessive quantifiers and no new start within a failed run, which changes no match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARD = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
ADDED = ("address", "number", "account")
GENERATORS = {
    "address": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "number": r"[+(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){10,30}+(?![A-Za-z0-9])",
}
GENERATOR_GUARD = {"address": r"@[A-Za-z0-9-]|[\[(]at[\])]", "number": r"[0-9](?:[\x20().-]{0,2}+[0-9]){6}", "account": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"}
# Words before a span that speak for personal data, and against it.
SPEAKS_FOR = r"(?i)(phone|mobile|tel|call|dial|text me|sms|ring|cell|fax|hotline|whatsapp|mail|contact|reach|write to|iban|account|card|ssn|social security|passport|number is|kontakt|telefon|anruf|ruf|nummer|numéro|número|appel|joindre|llam|tarjeta|carte|karte|konto|compte|cuenta|फ़ोन|फोन|मोबाइल|नंबर|संपर्क|कॉल|телефон|позвон|звони|هاتف|اتصل|电话|電話|手机)[^.!?\n।]{0,20}$"
SPEAKS_AGAINST = r"(?i)(version|isbn|issn|order|invoice|ticket|page|seite|serial|build|rfc|doi|figure|table|model|code|tracking|part|sku|ratio|sum|total|release|bestellung|rechnung|commande|facture|pedido|factura|\bno|\bnr|\bid|\bpi)(\x20?(number|no|nr|nummer))?[.:#\x20-]{0,3}$"
TLD = r"(?i)[.)\]\x20](com|org|net|edu|gov|int|info|biz|io|eu|uk|de|fr|es|it|nl|pl|ch|at|be|pt|se|no|dk|fi|ie|us|ca|mx|br|ar|in|cn|jp|kr|ru|au|nz|za|example)$"
FEATURES = ("gen", "digits", "groups", "first", "sep", "luhn", "g1", "gl", "same", "lead", "ctx", "prev", "next", "at", "tail", "check")

# What examples are made of. In a format # is a digit, {n} a name, {d} a domain and {t} its end.
PERSONAL = (
    "(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "(0##) ###-####", "1-###-###-####", "0### #######", "0## #######", "0#### ######", "0##-#######", "0# ## ## ## ##", "0#.##.##.##.##", "### ### ###", "##### #####", "#### ######", "0### ### ####",
    "+## ### #######", "###-##-####", "### ## ####", "#### #### ####", "0### ## ## ##", "{n} (at) {d} (dot) {t}", "{n} [at] {d} [dot] {t}", "{n}(at){d}.{t}", "{n}.{n}[at]{d}[dot]{t}", "{n} (at) {d}.{t}", "{n}_## [at] {d}.{d}.{t}", "{iban}", "{iban}", "{iban4}", "{iban4}",
)
UNSURE = ("##########", "0##########", "0#########", "### ####", "###-####", "#######", "#### #### #### ####")  # personal only if the words before say so
OTHER = (
    "#.#.##.#.#.#.#", "##.#.#.#.#.#.#", "#.##.###.##.##.##", "978-#-##-######-#", "979-##-####-###-#", "978##########", "20##-0#-1# 1#", "19##-20## ###", "20##0#1#", "20##0#1#-######", "1#.0#.20## 1", "########", "#########", "##############", "###################", "######################",
    "#.##############", "0.#######", "#######.##", "# # # # # # #", "## ## ## ## ## ## ## ##", "### ### ### ### ### ###", "## ## ## ## ## ## ## ## ## ## ##", "##.#.#.#.#", "####-######", "##-####-####-##", "20##########", "#-#-#-#-#-#-#-#", "10.####.###.##.##",
    "{fake}", "{fake}", "{fake4}", "{fake4}", "meet (at) figure.{d}", "look [at] step.two", "stop (at) 10.30", "wait (at) line.end",
)
NAMES = ("jane", "john", "maria", "li.wei", "o.smith", "anna", "amit", "sofia", "max", "info", "joe", "k.mueller")
DOMAINS = ("example", "foo", "mailhost", "site", "acme", "university", "post", "server7", "my-firm")
ENDS = ("com", "org", "net", "de", "fr", "es", "co", "example", "edu", "in")
FOR = ("Call ", "call me on ", "phone: ", "tel ", "my number is ", "mobile ", "Telefon: ", "fax ", "contact ", "reach me at ", "whatsapp ", "appelez le numéro ", "llama al número ", "Dial ", "my social security number ", "ssn ", "meine Nummer ist ", "mail me: ", "write to ", "iban ", "account ", "मेरा फ़ोन नंबर ", "संपर्क करें: ", "звоните ", "text me ", "Kontakt: ", "card ")
AGAINST = ("version ", "ISBN ", "order ", "invoice ", "serial: ", "build ", "doi: ", "page ", "ticket ", "id ", "model ", "code ", "ISBN: ", "Rechnung Nr. ", "order number ", "tracking no. ", "the ratio ", "the sum ", "pi ")
PLAIN = ("", "the value of ", "we saw ", "and then ", "about ", "on ", "it was ", "x ", "see ", "=", "# ", "und ", "dans ", "for ", "at ", "und zwar ", "$$$ ", ", ")
AFTER = ("", " today", ".", ", thanks", " for help", " was", ") and", " है", "\n", "$$$", " ###", ";", " y", " oder")


@dataclass(frozen=True)
class Options:
    """examples: how many are generated without the corpus; max_docs bounds the documents whose windows surround further ones;
    rounds, rate, depth: of the boosting; precision: the target of the thresholds; least: smallest probability in any case."""

    examples: int = 12_000
    max_docs: int = 4_000
    rounds: int = 40
    rate: float = 0.3
    depth: int = 4
    precision: float = 0.97
    least: float = 0.5


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda n, x: n + x)


def located(text: Column, pattern: str, guard: str, context: bool = False) -> Column:
    """array<struct<start, end, text>> of all matches, positions in code points; none is sought where the guard fails. With context
    also before, up to 40 characters that stand before a match (up to the match before the last at most), and next, the one after it.

    What stands between the matches comes from a split by the same pattern, so that no position is sought in the text again. Lengths
    are summed by chunks of 64 and of 4096, so that a match takes at most 128 steps and one for each 4096 matches before it."""
    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    ending = lambda x: F.coalesce(F.substring(x, -40, 40), F.lit(""))
    fields = ["start", "end", "text", *["before", "next"] * context]

    def pieces(s: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            out = [F.length(x["g"]).alias("g"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("n"), x["m"].alias("text")]
            if context:
                out.append(ending(F.concat(ending(F.get(s["g"], i - 1)), ending(F.get(s["m"], i - 1)), ending(x["g"]))).alias("before"))
                after = F.get(s["g"], i + 1)
                out.append(F.when(after == "", F.coalesce(F.substring(F.get(s["m"], i + 1), 1, 1), F.lit(""))).otherwise(F.substring(after, 1, 1)).alias("next"))
            return F.struct(*out)

        return F.transform(F.arrays_zip(s["g"].alias("g"), s["m"].alias("m")), of)

    def by_64(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / 64).cast("int")), lambda c: _sum(F.slice(a, c * 64 + 1, F.lit(64))))

    def start(s: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            c, d = F.shiftright(i, 6), F.shiftright(i, 12)
            before = _sum(F.slice(s["d"], F.lit(1), d)) + _sum(F.slice(s["c"], d * 64 + 1, c - d * 64)) + _sum(F.slice(s["b"], c * 64 + 1, i - c * 64))
            return F.struct((before + x["g"]).alias("start"), (before + x["g"] + x["n"]).alias("end"), *[x[f].alias(f) for f in fields[2:]])

        return F.filter(F.transform(s["p"], of), lambda x: x["text"].isNotNull())

    # Each step binds its array to a name once, by a transform of an array of one.
    with_b = lambda p: F.struct(p.alias("p"), F.transform(p, lambda x: x["g"] + x["n"]).alias("b"))
    with_c = lambda s: F.struct(s["p"].alias("p"), s["b"].alias("b"), by_64(s["b"]).alias("c"))
    with_d = lambda s: F.struct(s["p"].alias("p"), s["b"].alias("b"), s["c"].alias("c"), by_64(s["c"]).alias("d"))
    bound = F.array(parts)
    for step in (pieces, with_b, with_c, with_d, start):
        bound = F.transform(bound, step)
    kinds = ["int", "int", "string", "string", "string"]
    none = F.array().cast(f"array<struct<{','.join(f'{f}:{k}' for f, k in zip(fields, kinds, strict=False))}>>")
    return F.when(text.rlike(guard), bound[0]).otherwise(none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _holds(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    n = F.length(_digits(text))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(text))
    return n.between(10, 15)


def with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and base: array<struct<start, rank, end>> in order."""
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    for k, kind in enumerate(KINDS):
        rows = rows.withColumn(f"m{k}", _kept(located(F.col("text"), BASE[kind], GUARD[kind]), kind))
    ranked = [_ranked(f"m{k}", k) for k in range(len(KINDS))]
    return rows.select("doc_id", "text", F.sort_array(F.concat(*ranked)).alias("base"))


def _kept(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: _holds(kind, x["text"]))


def _ranked(name: str, rank: int) -> Column:
    return F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def _around(c: Column) -> Column:
    return F.when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^[#*$%&|<>=_/\\]"), 3).otherwise(0)


def _mod97(text: Column) -> Column:
    """The remainder of a text of digits and A-Z, these as 10 to 35, by 97."""
    numbers = F.transform(F.split(text, ""), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c))
    return F.aggregate(F.filter(F.split(F.array_join(numbers, ""), ""), lambda c: c != ""), F.lit(0), lambda n, c: (n * 10 + c.cast("int")) % 97)


def _checked(code: Column) -> Column:
    """Whether an account code carries its check digits."""
    code = F.translate(code, " ", "")
    return _mod97(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))) == 1


def _features(gen: int, x: Column) -> Column:
    m = x["text"]
    digits = _digits(m)
    sizes = F.transform(F.filter(F.split(m, "[^0-9]+"), lambda g: g != ""), lambda g: F.length(g))
    before = x["before"]
    seps = F.regexp_replace(m, "[^\\x20().-]", "")
    one = lambda s: seps.rlike(f"^[{s}]+$")
    number, account, address = (F.lit(ADDED[gen] == k) for k in ("number", "account", "address"))
    end = lambda k: F.coalesce(F.least(F.lit(8), F.get(sizes, k)), F.lit(0))
    return F.struct(
        x["start"].alias("start"),
        x["end"].alias("end"),
        F.lit(gen).alias("gen"),
        F.least(F.lit(24), F.length(digits)).alias("digits"),
        F.least(F.lit(8), F.size(sizes)).alias("groups"),
        F.when(m.startswith("+"), 1).when(m.startswith("("), 2).when(m.rlike("^[A-Za-z]"), 3).otherwise(0).alias("first"),
        F.when(seps == "", 0).when(one("\\x20"), 1).when(one("-"), 2).when(one("."), 3).when(seps.contains("("), 4).otherwise(5).alias("sep"),
        F.when(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), 1).otherwise(0).alias("luhn"),
        end(0).alias("g1"),
        end(F.size(sizes) - 1).alias("gl"),
        F.when(number & (F.size(F.array_distinct(sizes)) == 1), 1).otherwise(0).alias("same"),
        F.when(digits.rlike("^97[89]"), 1).when(m.rlike("^(19|20)[0-9]{2}(?![0-9])|^20[0-9]{2}[01][0-9][0-3]"), 2).when(digits.startswith("0"), 3).otherwise(0).alias("lead"),
        F.when(before.rlike(SPEAKS_AGAINST), 2).when(before.rlike(SPEAKS_FOR), 1).otherwise(0).alias("ctx"),
        _around(F.substring(before, -1, 1)).alias("prev"),
        _around(x["next"]).alias("next"),
        F.when(m.contains("@"), 1).when(m.rlike(r"[\[(]at[\])]"), 2).otherwise(0).alias("at"),
        F.when(address & m.rlike(TLD), 1).otherwise(0).alias("tail"),
        F.when(account, F.when(_checked(m), 1).otherwise(0)).otherwise(0).alias("check"),
    )


def _ranks(points: Column, others: Column, ours: int) -> Column:
    """For each of our points, ascending, how many of the others come before it; of equal ones, those with ours = 1."""
    tagged = F.sort_array(F.concat(F.transform(points, lambda p: F.struct(p.alias("p"), F.lit(ours).alias("t"))), F.transform(others, lambda p: F.struct(p.alias("p"), F.lit(1 - ours).alias("t")))))
    at = F.filter(F.transform(tagged, lambda x, i: F.when(x["t"] == ours, i).otherwise(-1)), lambda i: i >= 0)
    return F.transform(at, lambda i, k: i - k)


def _clear_of(spans: Column, base: Column) -> Column:
    """The spans (ascending, without overlaps among themselves) that meet no base span: as many base spans begin before their end as
    end by their start."""
    begun = _ranks(F.transform(spans, lambda x: x["end"]), F.transform(base, lambda b: b["start"]), 0)
    ended = _ranks(F.transform(spans, lambda x: x["start"]), F.transform(base, lambda b: b["end"]), 1)
    both = F.transform(F.array(F.struct(begun.alias("a"), ended.alias("b"))), lambda r: F.filter(spans, lambda x, k: F.get(r["a"], k) == F.get(r["b"], k)))
    return F.when(F.size(base) == 0, spans).when(F.size(spans) == 0, spans).otherwise(both[0])


def with_candidates(rows: DataFrame) -> DataFrame:
    """rows (text, base) with candidates: an array of features of the spans that meet no base span."""
    for g, name in enumerate(ADDED):
        rows = rows.withColumn(f"g{g}", located(F.col("text"), GENERATORS[name], GENERATOR_GUARD[name], context=True))
    for g in range(len(ADDED)):
        rows = rows.withColumn(f"g{g}", _clear_of(F.col(f"g{g}"), F.col("base")))
    parts = [_featured(f"g{g}", g) for g in range(len(ADDED))]
    return rows.withColumn("candidates", F.concat(*parts)).drop(*[f"g{g}" for g in range(len(ADDED))])


def _featured(name: str, gen: int) -> Column:
    return F.transform(name, lambda x: _features(gen, x))


def _pick(values: tuple[str, ...], *salt: Column | str) -> Column:
    parts = [F.lit(p) if isinstance(p, str) else p for p in salt]
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(*parts), F.lit(len(values))) + 1).cast("int"))


def made_up(keys: DataFrame) -> DataFrame:
    """Examples for rows (k, before, after; null for a phrase): text, at (where the filled format begins), y (whether it is personal)
    and held (whether it is kept for calibration)."""
    k = F.col("k")
    shapes = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(c).alias("c")) for c, fs in ((0, OTHER), (1, PERSONAL), (2, UNSURE)) for f in fs])
    rows = keys.withColumn("shape", F.element_at(shapes, (F.pmod(F.xxhash64(k, F.lit("shape")), F.lit(len(OTHER) + len(PERSONAL) + len(UNSURE))) + 1).cast("int")))
    rows = rows.withColumn("digs", F.translate(F.concat(F.md5(F.concat(k.cast("string"), F.lit("a"))), F.md5(F.concat(k.cast("string"), F.lit("b")))), "abcdef", "135790"))
    land = _pick(("DE18", "FR23", "ES20", "NL14", "PL24"), k, "land")
    rows = rows.withColumn("land", F.substring(land, 1, 2)).withColumn("body", F.substring("digs", F.lit(1), F.substring(land, 3, 2).cast("int")))
    rest = _mod97(F.concat("body", "land", F.lit("00")))
    rows = rows.withColumn("iban", F.concat("land", F.lpad((98 - rest).cast("string"), 2, "0"), "body"))
    rows = rows.withColumn("fake", F.concat(F.translate(F.substring(F.md5(k.cast("string")), 1, 2), "0123456789", "KLMNPQRSTU"), F.substring("digs", 3, 2), F.substring(F.md5(k.cast("string")), 3, 18)))
    rows = rows.withColumn("fake", F.upper("fake"))
    four = lambda c: F.regexp_replace(c, "(.{4})(?=.)", "$1 ")
    filled = F.array_join(F.transform(F.split(F.col("shape.f"), ""), lambda c, i: F.when(c == "#", F.substring(F.col("digs"), i + 1, F.lit(1))).otherwise(c)), "")
    for mark, value in (("{n}", _pick(NAMES, k, "n")), ("{d}", _pick(DOMAINS, k, "d")), ("{t}", _pick(ENDS, k, "t")), ("{iban4}", four(F.col("iban"))), ("{iban}", F.col("iban")), ("{fake4}", four(F.col("fake"))), ("{fake}", F.col("fake"))):
        filled = F.replace(filled, F.lit(mark), value)
    kind = F.pmod(F.xxhash64(k, F.lit("ctx")), F.lit(10))
    phrase = F.when(kind < 4, _pick(FOR, k, "for")).when(kind < 6, _pick(AGAINST, k, "against")).otherwise(_pick(PLAIN, k, "plain"))
    rows = rows.withColumn("said", F.when(F.col("before").isNotNull() & (kind >= 5), F.concat("before", F.lit(" "))).otherwise(phrase)).withColumn("filled", filled)
    text = F.concat("said", "filled", F.coalesce(F.concat(F.lit(" "), F.col("after")), _pick(AFTER, k, "after")))
    c, speaks = F.col("shape.c"), F.when(F.col("said").rlike(SPEAKS_AGAINST), 2).when(F.col("said").rlike(SPEAKS_FOR), 1).otherwise(0)
    y = ((c == 1) & ((speaks != 2) | F.col("filled").rlike("^[A-Za-z]"))) | ((c == 2) & (speaks == 1))
    held = F.pmod(F.xxhash64("shape.f", "said"), F.lit(5)) < 2  # by format and phrase, so that held-out pairs are new
    return rows.select("k", text.alias("text"), F.length("said").alias("at"), F.length("filled").alias("n"), y.alias("y"), held.alias("held"))


def examples(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """Generated examples: between phrases, and between windows of at most about max_docs documents."""
    spark = docs.sparkSession
    none = F.lit(None).cast("string")
    plain = spark.range(options.examples).select(F.col("id").alias("k"), none.alias("before"), none.alias("after"))
    rows = docs.select(col(id_col).cast("string").alias("i"), col(text_col).alias("t")).where(F.length("t") > 80)
    n = rows.count()
    share = min(1.0, options.max_docs / n) if n else 1.0
    drawn = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(1_000_003)) < share * 1_000_003)
    at = F.pmod(F.xxhash64("t", F.lit("at")), F.length("t") - 70).cast("int")
    windows = drawn.select(F.xxhash64("i", "t").alias("k"), F.substring("t", at + 1, F.lit(40)).alias("before"), F.substring("t", at + 41, F.lit(25)).alias("after"))
    return made_up(plain.unionByName(windows))


def _cells(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label weights as negative and positive, held) of the candidates that meet an example's filled format."""
    rows = examples.select("k", "text", "at", "n", "y", "held", F.array().cast("array<struct<start:int,rank:int,end:int>>").alias("base"))
    each = with_candidates(rows).select("at", "n", "y", "held", F.explode_outer("candidates").alias("x")).where(F.col("x").isNotNull())
    each = each.where((F.col("x.start") < F.col("at") + F.col("n")) & (F.col("at") < F.col("x.end")))
    whole = (F.col("x.start") >= F.col("at") - 1) & (F.col("x.end") <= F.col("at") + F.col("n") + 1)
    counted = each.groupBy(*[F.col(f"x.{f}").alias(f) for f in FEATURES], "held").agg(F.count_if(~(F.col("y") & whole)).alias("neg"), F.count_if(F.col("y") & whole).alias("pos")).collect()  # no more rows than examples
    counted.sort(key=lambda r: [r[f] for f in FEATURES] + [r["held"]])
    return np.array([[r[f] for f in FEATURES] for r in counted], dtype=np.int64).reshape(-1, len(FEATURES)), np.array([[r["neg"], r["pos"]] for r in counted], dtype=float).reshape(-1, 2), np.array([r["held"] for r in counted], dtype=bool)


def boost(x: np.ndarray, w: np.ndarray, options: Options) -> list:
    """Trees for the logistic loss, fitted on weighted cells: ("leaf", value) or (feature, at most, left, right)."""
    margin, trees = np.zeros(len(x)), []
    for _ in range(options.rounds):
        q = 1 / (1 + np.exp(-margin))
        tree = _grow(x, w[:, 1] - w.sum(axis=1) * q, w.sum(axis=1) * q * (1 - q), options.depth, options.rate)
        trees.append(tree)
        margin += _values(tree, x)
    return trees


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float):
    best, split = 1e-6, None
    for f in range(x.shape[1]) if depth and len(x) else ():
        gs, hs = (np.bincount(x[:, f], weights=v).cumsum() for v in (g, h))
        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
        v = int(gain[:-1].argmax()) if len(gain) > 1 else -1
        if v >= 0 and gain[v] > best + 1e-9:
            best, split = float(gain[v]), (f, v)
    if split is None:
        return "leaf", round(float(rate * g.sum() / (h.sum() + 1)), 6)
    f, v = split
    left = x[:, f] <= v
    return f, v, _grow(x[left], g[left], h[left], depth - 1, rate), _grow(x[~left], g[~left], h[~left], depth - 1, rate)


def _values(tree, x: np.ndarray) -> np.ndarray:
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    return np.where(x[:, tree[0]] <= tree[1], _values(tree[2], x), _values(tree[3], x))


def sigmoid_of(margin: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the probability 1 / (1 + exp(-slope * margin - shift)), fitted by Newton's method with weak priors."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-a * margin - b))
        g, h = w[:, 1] - w.sum(axis=1) * q, w.sum(axis=1) * q * (1 - q)
        grad = np.array([(g * margin).sum() - (a - 1), g.sum() - b])
        hess = np.array([[(h * margin**2).sum() + 1, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1]])
        step = np.linalg.solve(hess, grad)
        a, b = max(0.05, a + float(step[0])), b + float(step[1])
        if abs(step).max() < 1e-9:
            break
    return a, b


def tree_sql(tree, name: str) -> str:
    if tree[0] == "leaf":
        return f"{tree[1]}D"
    return f"IF({name}.{FEATURES[tree[0]]} <= {tree[1]}, {tree_sql(tree[2], name)}, {tree_sql(tree[3], name)})"


@dataclass(frozen=True)
class Model:
    """thresholds: for each generator, the least margin that is added. measured: on held-out examples, (recall, precision)."""

    trees: list
    thresholds: list[float]
    measured: tuple[float, float] = (0.0, 0.0)

    def margin(self, name: str) -> str:
        """SQL: the margin of the candidate called name."""
        return " + ".join(f"({tree_sql(t, name)})" for t in self.trees) or "0D"

    def selects(self, name: str) -> str:
        """SQL: whether the candidate called name is added."""
        least = " ".join(f"WHEN {g} THEN {t}D" for g, t in enumerate(self.thresholds))
        return f"{self.margin(name)} >= CASE {name}.gen {least} END"


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> Model:
    x, w, held = _cells(examples(docs, id_col=id_col, text_col=text_col, options=options))
    trees = boost(x[~held], w[~held], options)
    margin = sum(_values(t, x) for t in trees) if trees else np.zeros(len(x))
    a, b = sigmoid_of(margin[held], w[held])
    chance = lambda m: 1 / (1 + np.exp(-a * m - b))
    scored = with_candidates(with_base(docs, id_col, text_col)).select(F.explode_outer("candidates").alias("x")).where(F.col("x").isNotNull())
    tenths = F.expr(f"cast(floor(10 * ({Model(trees, []).margin('x')})) as int)")
    seen = scored.select(F.col("x.gen").alias("gen"), tenths.alias("m")).groupBy("gen", "m").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each tenth of a margin

    def threshold(g: int) -> float:
        """The least margin from which on both held-out examples and all documents reach the target precision."""
        own = held & (x[:, 0] == g)
        corpus = np.array([(r["m"] / 10, r["n"]) for r in seen if r["gen"] == g], dtype=float).reshape(-1, 2)
        least = (math.log(options.least / (1 - options.least)) - b) / a
        for m in np.unique(np.floor(np.concatenate([margin[own], corpus[:, 0], [least]]) * 10) / 10):
            if m < least:
                continue
            there, met = w[own & (margin >= m)], corpus[corpus[:, 0] >= m]
            good = not len(there) or there[:, 1].sum() >= options.precision * there.sum()
            if good and (not len(met) or (met[:, 1] * chance(met[:, 0] + 0.05)).sum() >= options.precision * met[:, 1].sum()):
                return round(float(m), 6)
        return math.ceil(10 * max([*margin[own], *corpus[:, 0], 0.0])) / 10 + 1.0

    thresholds = [threshold(g) for g in range(len(ADDED))]
    taken = held & (margin >= np.array(thresholds)[x[:, 0]])
    hit = w[taken].sum(axis=0)
    return Model(trees, thresholds, (float(hit[1] / max(1.0, w[held][:, 1].sum())), float(hit[1] / max(1.0, hit.sum()))))


def _greedy(spans: Column) -> Column:
    """Of spans (start, upto = -end, rank) in order, those that begin at or after the end of the last one kept. Kept spans are gathered
    in pieces of 256, so that no long array is copied at every step."""
    kind = "struct<at:int,now:array<struct<start:int,rank:int,end:int>>,done:array<array<struct<start:int,rank:int,end:int>>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("now"), F.array().alias("done")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        one = F.array(F.struct(x["start"].alias("start"), x["rank"].alias("rank"), (-x["upto"]).alias("end")))
        full = F.size(s["now"]) >= 256
        kept = F.struct((-x["upto"]).alias("at"), F.when(full, one).otherwise(F.concat(s["now"], one)).alias("now"), F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"))
        return F.when(x["start"] >= s["at"], kept.cast(kind)).otherwise(s)

    return F.aggregate(spans, start, step, lambda s: F.concat(F.flatten(s["done"]), s["now"]))


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, options: Options = Options()) -> DataFrame:
    """doc_id, text, base (start, rank, end) and spans (start, rank, end), where ranks count KINDS and then ADDED.

    Added spans meet no base span. Of those that overlap, taken in order of their starts and the longest first, each stays that
    begins after the last that stayed."""
    model = fit(docs, id_col=id_col, text_col=text_col, options=options) if model is None else model
    rows = with_candidates(with_base(docs, id_col, text_col))
    chosen = F.expr(f"filter(candidates, x -> {model.selects('x')})")
    ordered = F.sort_array(F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("upto"), (x["gen"] + len(KINDS)).alias("rank"))))
    return rows.select("doc_id", "text", "base", F.sort_array(F.concat("base", _greedy(ordered))).alias("spans"))


def redacted(found: DataFrame, mask: str = "[PII]") -> DataFrame:
    """detect()'s rows with clean_text: spans that touch or overlap are joined and each joined span gives way to one mask."""
    mark = F.lit(mask)
    # A span shows its mask and the text after it up to the next one; a running end is told from ranks: after sorting by start, a span
    # begins a joined one if as many spans ended before its start as began before it.
    starts, ends = F.transform("spans", lambda s: s["start"]), F.sort_array(F.transform("spans", lambda s: s["end"]))
    rows = found.withColumn("__ends", ends).withColumn("__ended", _ranks(starts, ends, 0))
    heads = F.filter(F.transform("spans", lambda s, i: F.struct(s["start"].alias("s"), i.alias("i"))), lambda x: F.get(F.col("__ended"), x["i"]) >= x["i"])
    rows = rows.withColumn("__heads", heads)
    upto = lambda k: F.when(k + 1 < F.size("__heads"), F.get(F.col("__heads"), k + 1)["i"]).otherwise(F.size("spans"))
    joined = F.transform("__heads", lambda x, k: F.struct(x["s"].alias("s"), F.get(F.col("__ends"), upto(k) - 1).alias("e")))
    rows = rows.withColumn("__joined", joined)
    after = lambda x, k: F.substring(F.col("text"), x["e"] + 1, F.coalesce(F.get(F.col("__joined"), k + 1)["s"], F.length("text")) - x["e"])
    first = F.substring(F.col("text"), F.lit(1), F.coalesce(F.get(F.col("__joined"), F.lit(0))["s"], F.length("text")))
    clean = F.concat(first, F.array_join(F.transform("__joined", lambda x, k: F.concat(mark, after(x, k))), ""))
    return rows.withColumn("clean_text", clean).select(*[col(c) for c in found.columns if c != "clean_text"], "clean_text")


def op6_pii_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return detect(docs).select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))

"""Personal data: base patterns, and terms that reveal them by the corpus's statistics.

Base entities (e-mail and IP addresses, payment cards, phone numbers) are found by patterns.
Terms in the same texts can reveal them too. Most entities are rare, so terms are also counted
against groups of them: their kind, mail domain, network, card issuer or phone area. How
strongly a term t reveals an entity or group e is estimated from co-occurrence over all documents: with p(e) the share of documents that hold
e, and p(e|t) the share of the documents with t that hold e, the disclosure is
``1 - log p(e|t) / log p(e)``, the pointwise mutual information in units of e's
information content: 0 for a term that tells nothing, 1 for one that tells everything. Terms
at ``REMOVE`` or above are removed, those at ``GENERALISE`` or above replaced by their kind,
wherever they stand, in texts without the entity too. Only pairs that ``MIN_TEXTS`` different
texts support count, so that copies of one text prove nothing; and who sees the term must be able to
conclude the entity with ``CONFIDENCE`` or more, so that a term of many texts, few of them with the
entity, stays: that is asked of the lower end (Wilson, ``Z`` standard errors) of p(e|t), as few texts may agree by chance.

Only DataFrame functions are used. The patterns give the same matches as plain ones, but
consume runs of characters at once (possessive, and starting only where a run starts), so
that a long text costs time in proportion. Places come from the pieces between matches.

Scale: texts are scanned where they are read, once to count and once to mark; the terms of texts
with entities go to a written table that is small against the texts. All terms are counted, in each
task before the shuffle; candidates then meet the counts, one row a term. Disclosing terms and the
places of the texts that hold them are broadcast if they take ``BROADCAST_BYTES`` or less, and
joined by a shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table

KINDS = ("email", "ip", "card", "phone")
#: A run starts after another character or where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried on it.
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
TERM = r"[\p{L}\p{N}]++"
BETWEEN_TERMS = r"[^\p{L}\p{N}]++"
MIN_TERM = 3
MIN_TEXTS = 3
GENERALISE, REMOVE = 0.8, 0.95
CONFIDENCE, Z = 0.5, 1.28
BROADCAST_BYTES = 16 << 20
_STEP = 32


def _bind(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def match_spans(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<s, e, m>>: start, end (code points, end exclusive) and text of all matches, or of those that keep(m) holds for.

    Lengths are summed up in blocks of some matches, and then over the blocks, as appending to an array copies it.
    """
    span = "array<struct<s:int,e:int,m:string>>"
    state = lambda at, out: F.struct(at.cast("int").alias("at"), out.alias("out"))
    moved = lambda x, by: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["m"].alias("m"))

    def one(acc, x):
        def added(s):
            longer = F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"))))
            return state(s + F.length(x["m"]), longer if keep is None else F.when(keep(x["m"]), longer).otherwise(acc["out"]))

        return _bind(acc["at"] + F.length(x["p"]), added)

    def joined(blocks):  # (length, spans from the block's start) of each block
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, by: F.transform(b["out"], lambda x: moved(x, by))))

    def places(matches):
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        steps = lambda q: F.sequence(F.lit(0), ((F.size(q) - 1) / _STEP).cast("int"))
        blocks = _bind(pairs, lambda q: F.transform(steps(q), lambda b: F.aggregate(F.slice(q, b * _STEP + 1, F.lit(_STEP)), state(F.lit(0), F.array().cast(span)), one)))
        return _bind(blocks, joined)

    return _bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, places(m)).otherwise(F.array().cast(span)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        x = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _bind(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    return F.length(_digits(m)).between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<s, k, e, m>> of a kind's matches that pass its test; k is the kind's place in KINDS."""
    found = F.filter(match_spans(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
    found = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), x["m"].alias("m")))
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,m:string>>"))


def _joined(spans: Column, names: tuple[str, ...] = (*KINDS, "term")) -> Column:
    """kind:start:end of all spans, by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _entity(x: Column) -> Column:
    """What an entity is counted under: its kind, and its text in lower case or its digits."""
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
    return F.concat(name, F.lit(":"), F.when(x["k"] < 2, F.lower(x["m"])).otherwise(_digits(x["m"])))


def _classes(x: Column) -> Column:
    """What an entity is counted under: itself, its kind, and the groups between that it belongs to.

    They are the mail domain, the first two and three parts of an IP address, a card's first six digits and a phone's first four.
    """
    group = lambda name, value: F.concat(F.lit(f"{name}:"), value)
    of_kind = [
        F.array(group("domain", F.lower(F.substring_index(x["m"], "@", -1)))),
        F.array(group("net2", F.substring_index(x["m"], ".", 2)), group("net3", F.substring_index(x["m"], ".", 3))),
        F.array(group("issuer", F.substring(_digits(x["m"]), 1, 6))),
        F.array(group("area", F.substring(_digits(x["m"]), 1, 4))),
    ]
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
    groups = F.when(x["k"] == 0, of_kind[0]).when(x["k"] == 1, of_kind[1]).when(x["k"] == 2, of_kind[2]).otherwise(of_kind[3])
    return F.concat(F.array(_entity(x), kind), groups)


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and _text, one array of base spans for each kind, and _spans, all of them."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_text"), *[base_spans(text, k).alias(f"_{k}") for k in KINDS])
    return out.withColumn("_spans", F.concat(*[f"_{k}" for k in KINDS]))


def _words(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    words = F.filter(F.split(text, BETWEEN_TERMS), lambda w: F.length(w) >= MIN_TERM)
    return F.array_distinct(F.transform(words, F.lower))


def _places(text: Column, spans: Column, keep=None) -> Column:
    """array<struct<term, s, e>> of the terms of a text outside its base spans, or of those that keep(term) holds for."""
    wanted = lambda m: (F.length(m) >= MIN_TERM) & (F.lit(True) if keep is None else keep(F.lower(m)))
    found = F.filter(match_spans(text, TERM, wanted), lambda w: ~F.exists(spans, lambda y: (y["s"] < w["e"]) & (w["s"] < y["e"])))
    return F.transform(found, lambda w: F.struct(F.lower(w["m"]).alias("term"), w["s"].alias("s"), w["e"].alias("e")))


def _key(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def _term_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(term, n_t): in how many documents each of the distinct candidates occurs.

    An inner join, as Spark would move a semi-join to before the counts, where it makes a row for each word of each document.
    """
    words = docs.select(F.explode(_words(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(candidates, "term")


def _lower_end(p: Column, n: Column) -> Column:
    """The lower end of Wilson's interval of a share p of n."""
    z = Z * Z
    return (p + z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """A written table (term, remove) of the terms whose disclosure of a class of entities is GENERALISE or more."""
    held = F.array_distinct(F.flatten(F.transform("_spans", _classes)))
    found = scan(docs, []).where(F.size("_spans") > 0)
    found = found.select(_key(F.col("_text")).alias("_key"), held.alias("classes"), F.array_distinct(F.transform(_places(F.col("_text"), F.col("_spans")), lambda w: w["term"])).alias("terms"))
    texts = found.groupBy("_key").agg(F.count(F.lit(1)).alias("copies"), F.first("classes").alias("classes"), F.first("terms").alias("terms"))
    texts = materialize(texts, "pii-texts")
    n = docs.count()
    classes = texts.select("copies", F.explode("classes").alias("class")).groupBy("class").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts"))
    classes = materialize(classes.where((F.col("texts") >= MIN_TEXTS) & (F.col("n_e") < n)).select("class", "n_e"), "pii-classes")
    beside = texts.select("copies", "terms", F.explode("classes").alias("class")).join(classes.select("class"), "class", "left_semi")
    pairs = beside.select("copies", "class", F.explode("terms").alias("term")).groupBy("class", "term").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("texts"))
    pairs = materialize(pairs.where(F.col("texts") >= MIN_TEXTS), "term-pairs")
    counts = _term_counts(docs, pairs.select("term").distinct())
    p = F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))
    disclosure = 1 - F.log(p) / F.log(F.col("n_e") / F.lit(float(n)))
    flagged = pairs.join(counts, "term").where(_lower_end(p, F.col("n_t")) >= CONFIDENCE).join(classes, "class").groupBy("term").agg(F.max(disclosure).alias("d")).where(F.col("d") >= GENERALISE)
    return materialize(flagged.select("term", (F.col("d") >= REMOVE).alias("remove")), "pii-terms")


def _marked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (a scan of ``docs``) and added: array<struct<s, k, e, remove>>, all places of disclosing terms.

    k is one more than that of the last kind.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select(_key(text).alias("_key"), F.explode(_words(text)).alias("term")).join(broadcast_if_small(disclosing_terms(docs), F.octet_length("term") + 16, BROADCAST_BYTES), "term")
    hits = words.groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "remove"))).alias("_hits"))
    hits = materialize(hits, "pii-hits")
    joined = found.withColumn("_k", _key(F.col("_text"))).join(broadcast_if_small(hits, F.aggregate(F.map_keys("_hits"), F.lit(64), lambda n, t: n + F.octet_length(t) + 16), BROADCAST_BYTES), F.col("_k") == F.col("_key"), "left")
    places = _places(F.col("_text"), F.col("_spans"), lambda term: F.map_contains_key("_hits", term))
    spans = F.transform(places, lambda w: F.struct(w["s"].alias("s"), F.lit(len(KINDS)).alias("k"), w["e"].alias("e"), F.element_at("_hits", w["term"]).alias("remove")))
    return joined.withColumn("added", F.when(F.col("_hits").isNotNull(), spans).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,remove:boolean>>")))


def find_pii(docs: DataFrame) -> DataFrame:
    """Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term for every row.

    A null or empty text has no spans (the checksum is of no bytes). Rows with equal texts
    have equal spans; rows with equal or null ids are told apart by nothing but their text. An empty table gives none.
    """
    found = _marked(docs, scan(docs, ["doc_id"]))
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    slim = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    spans = _joined(F.concat(slim("_spans"), slim("added"))).alias("spans")
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("_spans")), 256).alias("base_sha256"), spans, F.size("added").cast("long").alias("n_term"))


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each span (s, k, e, remove) replaced; spans that overlap are one, of the first's kind."""
    kind = "struct<s:int,k:int,e:int,remove:boolean>"

    def fold(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e"), last["remove"].alias("remove"))
        return F.when(x["s"] < F.coalesce(last["e"], F.lit(0)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(F.array_sort(spans), F.array().cast(f"array<{kind}>"), fold)
    mark = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])

    def build(m):
        pieces = F.transform(m, lambda x, i: F.concat(_between(m, i, x), F.when(x["remove"], "").otherwise(F.element_at(mark, x["k"] + 1))))
        tail = text.substr(F.element_at(m, -1)["e"] + 1, F.length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    def _between(m, i, x):
        start = F.when(i == 0, 0).otherwise(F.coalesce(F.get(m, i - 1)["e"], F.lit(0)))
        return text.substr(start + 1, x["s"] - start)

    return F.when(F.size(spans) > 0, _bind(merged, build)).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with entities and disclosing terms replaced in text.

    A null text stays null and an empty one empty. Repeated rows stay, and equal texts change alike. Spans that overlap are replaced as
    one, by the kind of the first; of spans with one start by the first kind listed. An empty table gives none.
    """
    names = docs.columns
    found = scan(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")), ["_row"])  # no name of docs can clash
    joined = _marked(docs, found)
    base_part = F.transform("_spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit(False).alias("remove")))
    spans = F.concat(base_part, F.col("added"))
    new = F.when(F.col("_row.text").isNotNull(), _redacted(F.col("_text"), spans))
    return joined.select(*[new.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in names])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))

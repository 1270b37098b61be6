"""Personal data: pattern matches and, beyond them, terms that give a protected entity away; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written

FEW = 100_000  # rows of ids that are broadcast at most
KINDS = ["email", "ip", "card", "phone"]
# The kinds' patterns. Possessive repeats and the look-behind only keep the matcher from trying the same
# run of signs again from each of its places; the leftmost match of such a run starts at its first sign anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this sign has no match.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{2,}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def folded(items: Column, kind: str, add: Callable[[Column, Column], Column]) -> Column:
    """A fold of ``add`` over items with the state (at: int, out: ``kind``), which starts at 0 and empty.

    Items are folded in blocks of about the square root of their number and a block's ``out`` is appended as a whole,
    so that many items don't copy the growing array each.
    """
    none = F.array().cast(kind)

    def block(acc: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), add, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

    def run(x: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / width).cast("int")), lambda i: F.slice(x, i * width + 1, width))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), block)

    return let(items, run)


def located(text: Column, pattern: str | Column) -> Column:
    """array<struct<s, e, v>>: start, end (code points, exclusive) and value of every match, leftmost, non-overlapping.

    Spark returns matches and the text between them; running lengths of both give the places.
    """
    pattern = F.lit(pattern)
    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["v"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))).alias("out"))

    pairs = let(found, lambda f: F.zip_with(F.slice(f["gaps"], F.lit(1), F.size(f["hits"])), f["hits"], lambda g, v: F.struct(F.length(g).alias("g"), v.alias("v"))))
    return folded(pairs, "array<struct<s:int,e:int,v:string>>", add)["out"]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = _digits(v)

    def add(acc: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    return F.length(d).between(14, 19) & (F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0)


def _holds(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.concat(F.lit("0"), F.substr(part(p), F.lit(1), F.lit(4))).cast("int") <= 255))
    if kind == "card":
        return _luhn(v)
    return F.length(_digits(v)).between(10, 15)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind; failing matches are dropped and not retried."""
    sign = SIGNS[kind]
    able = F.contains(text, F.lit(sign)) if sign else F.lit(True)
    if kind != "email":
        able = able & F.rlike(text, F.lit({"ip": r"[0-9]\.[0-9]", "card": PATTERNS["card"], "phone": r"\+[0-9]"}[kind]))
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    return F.when(able, F.filter(located(text, PATTERNS[kind]), lambda x: _holds(kind, x["v"]))).otherwise(none)


def _entity(kind: Column, v: Column) -> Column:
    """One name for all spellings of an entity."""
    return F.concat(kind, F.lit(":"), F.when(kind == "email", F.lower(v)).when(kind == "ip", v).otherwise(_digits(v)))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), x["v"].alias("v")))


def find_base(docs: DataFrame) -> DataFrame:
    """(doc_id, h, found, _t): h is a hash of the text, found the base spans by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    frame = docs.select("doc_id", text.alias("_t"))
    every = F.concat(*(_of_kind(base_spans(F.col("_t"), k), i) for i, k in enumerate(KINDS)))
    return frame.select("doc_id", F.xxhash64("_t").alias("h"), F.array_sort(every).alias("found"), "_t")


def _words(text: Column) -> Column:
    """The distinct lower-cased terms of a text; each is lowered by itself."""
    spelt = F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    return F.array_distinct(F.split(F.lower(F.array_join(spelt, " ")), " "))


def disclosing(holding: DataFrame, docs: DataFrame, threshold: float, support: int) -> DataFrame:
    """(doc_id, h, telling): the terms of each document that tell that one of its entities is there.

    Over all documents and whole texts: n(t, e) documents hold the term and the entity, n(t) the term, n(e) the entity,
    of N, where rows with equal doc_id and text count once. The measure is the mutual information log2(n(t,e) N / (n(t) n(e))) as a share of its largest value,
    -log2(n(t,e) / N); pairs that ``support`` documents share and that reach ``threshold`` (above 0) disclose. As n(t,e)
    is n(t) or n(e) at most, most pairs can't reach it by these two counts alone and are never formed. Entities of the same
    documents have the same counts with every term, and so have terms with every entity: each such group is one, known by
    128 bits of its documents' hashes, so that a text of thousands of entities, repeated, forms one pair and not all.
    """
    units = written(docs.groupBy("doc_id", "h").agg(F.count("*").alias("rows")), "units")
    n, repeated = units.agg(F.count("*"), F.count_if(F.col("rows") > 1)).first()
    total = float(max(2, n))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("x.k") + 1)
    entities = written(holding.select("doc_id", "h", F.explode("found").alias("x")).select("doc_id", "h", _entity(kind, F.col("x.v")).alias("entity")).distinct(), "entities")
    spread = entities.groupBy("entity").agg(F.count("*").alias("n_e"), *_documents("e")).where(F.col("n_e") >= support)
    shared = written(entities.join(spread, "entity").select("doc_id", "h", "n_e", "e1", "e2").distinct(), "shared")

    def reach(low: Column) -> Column:
        """The largest count that can go with ``low``; the share rises with n(t,e), so n(t,e) = low decides."""
        return F.pow(F.lit(total), F.lit(1.0 - threshold)) * F.pow(low, F.lit(threshold)) * (1 + 1e-9)

    most = shared.agg(F.max("n_e")).first()[0] or 0
    share_of = F.lit(1.0)
    if repeated:  # a row that stands there k times counts 1/k each time
        again = units.where("rows > 1")
        docs = _same(docs, F.broadcast(again) if repeated <= FEW else again)
        share_of = 1.0 / F.coalesce("rows", F.lit(1))
    terms = docs.select(F.explode(_words(F.col("text"))).alias("term"), share_of.alias("part")).groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n_t"))
    terms = terms.where(F.col("n_t").between(support, F.greatest(F.lit(float(most)), reach(F.lit(float(most))))))
    own = holding.select("doc_id", "h", F.explode(_words(F.col("_t"))).alias("term")).where("term <> ''").distinct()
    own = written(own.join(terms, "term"), "own")
    own = own.join(own.groupBy("term").agg(*_documents("t")), "term")
    groups = own.select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"), "n_t", "t1", "t2").distinct()
    both = shared.join(groups, shared["doc_id"].eqNullSafe(groups["_doc_id"]) & (shared["h"] == groups["_h"])).drop("_doc_id", "_h")
    together = written(both.where(F.greatest("n_t", "n_e") <= reach(F.least("n_t", "n_e"))), "together")
    joint = F.col("n_te") / total
    share = F.when(joint >= 1, 1.0).otherwise(F.log2(joint * total * total / (F.col("n_t") * F.col("n_e"))) / -F.log2(joint))
    names = ["e1", "e2", "n_e", "t1", "t2", "n_t"]
    pairs = together.groupBy(*names).agg(F.count("*").alias("n_te")).where((F.col("n_te") >= support) & (share >= threshold))
    telling = together.join(pairs.select(*names), names, "left_semi").select("doc_id", "h", "t1", "t2", "n_t").distinct()
    telling = telling.withColumnsRenamed({c: f"_{c}" for c in telling.columns})
    same = own["doc_id"].eqNullSafe(telling["_doc_id"]) & (own["h"] == telling["_h"]) & (own["t1"] == telling["_t1"]) & (own["t2"] == telling["_t2"]) & (own["n_t"] == telling["_n_t"])
    return own.join(telling, same, "left_semi").groupBy("doc_id", "h").agg(F.collect_set("term").alias("telling"))


def _documents(name: str) -> tuple[Column, Column]:
    """128 bits that tell a group's distinct documents."""
    return F.bit_xor(F.xxhash64("doc_id", "h")).alias(f"{name}1"), F.bit_xor(F.xxhash64("h", F.lit(name), "doc_id")).alias(f"{name}2")


def _placed(holding: DataFrame, docs: DataFrame, threshold: float, support: int) -> DataFrame:
    """(doc_id, h, terms): every place of a document's telling terms that no base span covers already."""
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    places = _same(holding.dropDuplicates(["doc_id", "h"]), disclosing(holding, plain, threshold, support)).where("telling is not null")
    # terms hold no sign with a meaning in patterns, so their spellings, set off from other signs of terms, are one
    spelt = F.filter(F.array_distinct(F.regexp_extract_all("_t", F.lit(TERM), F.lit(0))), lambda w: F.array_contains("telling", F.lower(w)))
    sign = TERM.removesuffix("{2,}")
    places = places.withColumn("_p", F.concat(F.lit(f"(?<!{sign})(?:"), F.array_join(spelt, "|"), F.lit(f")(?!{sign})")))
    free = F.filter(located(F.col("_t"), F.col("_p")), lambda t: ~F.exists("found", lambda x: (x["s"] < t["e"]) & (t["s"] < x["e"])))
    return places.select("doc_id", "h", F.transform(free, lambda t: F.struct(t["s"].alias("s"), F.lit(len(KINDS)).alias("k"), t["e"].alias("e"))).alias("terms"))


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.withColumnsRenamed({"doc_id": "_doc_id", "h": "_h"})
    return left.join(r, left["doc_id"].eqNullSafe(r["_doc_id"]) & (left["h"] == r["_h"]), "left").drop("_doc_id", "_h")


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _without_value(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def scan_pii(docs: DataFrame, threshold: float = 0.8, support: int = 2) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document.

    Base spans come from the patterns over whole texts. The method adds spans of kind ``term``: every place, outside
    base spans, of a word that discloses one of the document's entities by the corpus's co-occurrence (see
    ``disclosing``). An entity or a term in fewer than ``support`` documents has no pair to count. base_sha256 and spans list kind:start:end by
    start, then kind. Null and empty texts have no spans (the SHA-256 of nothing, an empty list); repeated rows get a
    row each and count each in the statistics' distinct (doc_id, text) once; null ids are matched as equal; an empty
    table gives no rows. Columns other than doc_id and text are ignored.
    """
    kept = written(find_base(docs).withColumn("_t", F.when(F.size("found") > 0, F.col("_t"))), "spans")
    terms = _placed(kept.where(F.size("found") > 0), docs, threshold, support)
    every = F.array_sort(F.concat(_without_value(F.col("found")), F.coalesce("terms", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    count = lambda i: F.size(F.filter("found", lambda x: x["k"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return _same(kept, terms).select("doc_id", *map(count, range(len(KINDS))), F.sha2(_text_of(F.col("found")), 256).alias("base_sha256"), _text_of(every).alias("spans"))


def sanitise(docs: DataFrame, threshold: float = 0.8, support: int = 2) -> DataFrame:
    """``docs`` with every span generalised to its kind in brackets; overlapping spans become the first one's kind.

    Null and empty texts stay as they are; repeated rows stay repeated, each sanitised alike; null ids are matched as
    equal; an empty table gives no rows; other columns are carried, whatever their names, but n_chars is set to the new
    length where a text changes.
    """
    terms = _placed(written(find_base(docs).where(F.size("found") > 0), "spans"), docs, threshold, support)
    # other columns are renamed, so that none clashes with those made here
    marked = docs.toDF(*(c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = marked.withColumn("h", F.xxhash64(text))
    spans = F.concat(*(_of_kind(base_spans(F.col("text"), k), i) for i, k in enumerate(KINDS)))
    every = F.array_sort(F.concat(_without_value(spans), F.coalesce("terms", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    names = F.array(*(F.lit(f"[{k}]") for k in [*KINDS, "term"]))
    def add(acc: Column, x: Column) -> Column:
        piece = F.array(F.substr(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["k"] + 1))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    whole = let(folded(F.col("every"), "array<string>", add), lambda x: F.concat(F.array_join(x["out"], ""), F.substr(F.col("text"), x["at"] + 1, F.length("text"))))
    frame = _same(marked, terms).withColumn("every", every)
    frame = frame.withColumn("text", F.when(F.size("every") > 0, whole).otherwise(F.col("text")))
    names_of = dict(zip(docs.columns, marked.drop("h").columns))
    if "n_chars" in names_of:
        n = names_of["n_chars"]
        frame = frame.withColumn(n, F.when(F.size("every") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return frame.select(*(F.col(m).alias(c) for c, m in names_of.items()))

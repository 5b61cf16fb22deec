"""Personal data: fixed patterns, and terms that disclose them by corpus co-occurrence.

Patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers.  The
information-theoretic part looks at all terms (runs of letters, single ones too, outside
e-mail addresses and not joined to digits or signs) of the documents that hold such an entity.  Over the whole corpus it estimates the pointwise mutual information of
entity c and term t and compares it with the entity's information content:

    PMI(c; t) = log2(n(c,t) N / (n(c) n(t))),  IC(c) = log2(N / n(c))

All four count distinct texts, so that copies count once, and the same terms in them.  As
n(c,t) is at most n(c), a term with n(t) above n(c) (N / n(c)) ** (1 - ``generalise``) cannot
reach the threshold, so only rarer ones meet an entity at all.  A term whose PMI reaches
``generalise`` x IC is generalised to a label that keeps its shape (name, word or acronym)
and class of length, one that reaches ``remove`` x IC is removed,
wherever it stands in a document with that entity; at least ``min_contexts`` distinct texts
with both are asked for.

DataFrame functions only.  Every pattern is written so that it never backtracks over long
runs: possessive repeats, and look-behinds that start at the head of a run.  Offsets are running
sums over blocks of matches, so a text's time follows its length.

Null text is empty and has no spans; texts are scanned whole; repeated rows get the same
spans; of an entity and a term at one place the entity goes; rows and texts are told apart by
64-bit hashes; working columns carry a prefix, so clashing names are safe; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, text_or_empty

P = "__p_"
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
# Fixed patterns.  The look-behind for e-mail also allows the end of the match before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Maximal runs of digits with single separators; those with fewer than 12 digits would fail anyway.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have at least.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
MIN_CONTEXTS = 3
#: Matches whose offsets are summed up together.
BLOCK = 64
_TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}++(?![\p{N}@_%+])"
_SPAN = "struct<kind:string,start:int,end:int>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    values = F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.substring(digits, k, F.lit(1)).cast("int") * F.when((n - k) % 2 == 1, F.lit(2)).otherwise(F.lit(1)),
    )
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return v.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def _let(x: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def _blocks(x: Column) -> Column:
    """An array that is not empty, cut into arrays of :data:`BLOCK`."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))


def sums_before(values: Column) -> Column:
    """For each number of an array the sum of those before it, by blocks of blocks: nothing grows with the array but the result."""
    within = lambda block, base: F.transform(block, lambda _, k: base + _sum(F.slice(block, F.lit(1), k)))
    outer = lambda sums: _let(_blocks(sums), lambda bs: _let(F.transform(bs, _sum), lambda tops: F.flatten(F.zip_with(bs, within(tops, F.lit(0)), within))))
    whole = lambda v: _let(_blocks(v), lambda bs: F.flatten(F.zip_with(bs, _let(F.transform(bs, _sum), outer), within)))
    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def matches(df: DataFrame, name: str, text: str, pattern: str, when: Column) -> DataFrame:
    """Adds column ``name``: array<struct<start, end, value>> of all matches; offsets in code points.

    The pieces between matches and the matches themselves, one after another, are the
    text; so the running sum of their lengths gives the offsets.
    """
    t = F.col(text)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    hits = F.when(when, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # The last piece has no match after it.
    pieces = lambda h: F.filter(F.zip_with(F.split(t, pattern, -1), h, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value"))), lambda x: x["value"].isNotNull())

    def placed(parts: Column) -> Column:
        before = sums_before(F.transform(parts, lambda x: x["gap"] + F.length(x["value"])))
        return F.zip_with(parts, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))

    return df.withColumn(name, _let(hits, lambda h: F.when(F.size(h) > 0, _let(pieces(h), placed)).otherwise(none)))


def without_addresses(t: Column) -> Column:
    """The text with every character of its e-mail addresses as ``_``, so that offsets stay."""
    pattern = PATTERNS["email"]
    filled = F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda g, v: F.concat(g, F.repeat(F.lit("_"), F.coalesce(F.length(v), F.lit(0)))))
    return F.when(F.contains(t, F.lit("@")), F.array_join(filled, "")).otherwise(t)


def with_base_spans(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``__p_text`` and ``__p_found``: array<struct<kind, start, end, value>> by start, then kind as listed."""
    df = df.withColumn(P + "text", text_or_empty(text_col))
    t = F.col(P + "text")
    for kind, pattern in PATTERNS.items():
        hint = HINTS[kind]
        df = matches(df, P + kind, P + "text", pattern, F.contains(t, F.lit(hint)) if hint else F.lit(True))
    one = lambda kind, rank: F.transform(
        F.filter(P + kind, lambda m: _valid(kind, m["value"])),
        lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")),
    )
    every = F.sort_array(F.concat(*[one(kind, rank) for rank, kind in enumerate(PATTERNS)]))
    return df.withColumn(P + "found", every).drop(*[P + k for k in PATTERNS])


def found_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, digest, found, text), written once: every row's pattern matches; equal texts share a digest.

    ``text``, without addresses, is there for rows with a match only, so that no other text is shuffled to meet entities.
    """
    df = with_base_spans(docs.select(id_col, text_col), text_col)
    held = F.when(F.size(P + "found") > 0, without_addresses(F.col(P + "text"))).alias("text")
    return cut(df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.xxhash64(P + "text").alias("digest"), F.col(P + "found").alias("found"), held), "personal")


def disclosing_terms(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, generalise: float, remove: float, min_contexts: int) -> DataFrame:
    """(row, added): spans of the terms that disclose an entity of their document, per row key."""
    holds = table.select("row", "digest", "found", F.explode("found").alias("e")).select("row", "digest", "found", F.xxhash64("e.kind", F.lower("e.value")).alias("entity"))
    # An entity in fewer texts than asked for has no term in enough of them.
    alone = holds.select("digest", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_c")).filter(F.col("n_c") >= min_contexts)
    alone = cut(alone, "entities")
    total = float(max(1, table.select("digest").distinct().count()))
    most = lambda n_c: n_c * F.pow(F.lit(total) / n_c, F.lit(1 - generalise)) * (1 + 1e-9)
    held = holds.join(alone, "entity").groupBy("row").agg(F.collect_set(F.struct("entity", "n_c")).alias("entities"), F.first("digest").alias("digest"))
    texts = table.filter(F.col("text").isNotNull()).select("row", "text")
    near = matches(texts.join(held, "row"), "term", "text", _TERM, F.lit(True))
    terms = F.transform("term", lambda m: F.struct(F.lower(m["value"]).alias("term"), m["start"].alias("start"), m["end"].alias("end")))
    near = cut(near.select("row", "digest", "entities", terms.alias("terms")), "contexts")
    # Counts of all terms over the distinct texts of the corpus, by the same reading; only those of candidates are kept.
    # A text's terms are shuffled as one string, which takes less than half the room of an array of strings; no term holds a space.
    tokens = F.array_join(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), F.lower)), " ")
    once = docs.select(F.xxhash64(text_or_empty(text_col)).alias("digest"), without_addresses(text_or_empty(text_col)).alias("text")).select("digest", tokens.alias("tokens")).dropDuplicates(["digest"])
    widest = alone.agg(F.max(most(F.col("n_c"))).alias("widest"))  # one row
    documents = once.filter(F.col("tokens") != "").select(F.explode(F.split("tokens", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).filter(F.col("n_t") >= min_contexts)
    documents = cut(documents.join(F.broadcast(widest), F.col("n_t") <= F.col("widest")).drop("widest"), "rare_terms")
    own = near.select("row", "digest", "entities", F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("term")).join(documents, "term")
    fitting = F.filter("entities", lambda e: F.col("n_t") <= most(e["n_c"]))
    pairs = own.select("row", "digest", "term", "n_t", F.explode(fitting).alias("e")).select("row", "digest", "term", "n_t", "e.entity", "e.n_c")
    joint = pairs.select("entity", "n_c", "term", "n_t", "digest").distinct().groupBy("entity", "n_c", "term", "n_t").agg(F.count("*").alias("n_ct"))
    risky, total = joint.filter(F.col("n_ct") >= min_contexts), F.lit(total)
    pmi = F.log2(F.col("n_ct") * total / (F.col("n_c") * F.col("n_t")))
    ic = F.greatest(F.log2(total / F.col("n_c")), F.lit(0.0))
    risky = risky.select("entity", "term", pmi.alias("pmi"), ic.alias("ic")).filter((F.col("ic") > 0) & (F.col("pmi") >= generalise * F.col("ic")))
    kind = F.when(F.col("pmi") >= remove * F.col("ic"), F.lit("removed")).otherwise(F.lit("generalised"))
    # The stronger action wins where two entities ask for the same word; a row's terms are bounded by its own text.
    hits = pairs.join(risky.select("entity", "term", kind.alias("kind")), ["entity", "term"]).groupBy("row", "term").agg(F.max("kind").alias("kind"))
    hits = hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    found = near.select("row", "terms").dropDuplicates(["row"]).join(hits, "row")
    spans = F.transform("terms", lambda t: F.struct(F.try_element_at("kinds", t["term"]).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select("row", F.filter(spans, lambda s: s["kind"].isNotNull()).cast(f"array<{_SPAN}>").alias("added"))


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = 0.8, remove: float = 0.95, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """(doc_id, row, base, spans) for each row of ``docs``: spans of the patterns, and all spans."""
    table = found_table(docs, id_col, text_col)
    added = disclosing_terms(docs, table, id_col, text_col, generalise, remove, min_contexts)
    base = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    df = table.select("doc_id", "row", base.alias("base")).join(added, "row", "left")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(_ordered(F.concat("base", "added")))
    return df.select("doc_id", "row", "base", every.alias("spans"))


def shape(term: Column) -> Column:
    """What a generalised term leaves: ``[NAME-M]`` and the like; S has up to 5 letters, M up to 9, L more."""
    first = F.substring(term, 1, 1)
    kind = F.when(term == F.upper(term), F.lit("ACRONYM")).when(first != F.lower(first), F.lit("NAME")).otherwise(F.lit("WORD"))
    size = F.when(F.length(term) <= 5, F.lit("S")).when(F.length(term) <= 9, F.lit("M")).otherwise(F.lit("L"))
    return F.concat(F.lit("["), kind, F.lit("-"), size, F.lit("]"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = 0.8, remove: float = 0.95, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """``docs`` with every span replaced: patterns by a label, generalised terms by their shape, removed terms by nothing."""
    spans = personal_data(docs, id_col, text_col, generalise, remove, min_contexts).filter(F.size("spans") > 0)
    spans = spans.select(F.col("row").alias(P + "row"), F.col("spans").alias(P + "spans")).dropDuplicates([P + "row"])
    df = docs.withColumn(P + "row", F.xxhash64(F.col(id_col), F.col(text_col))).join(spans, P + "row", "left")
    text = F.col(f"`{text_col}`")
    label = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit("" if k == "removed" else f"[{k.upper()}]"))])

    def step(acc, s):
        fresh = s["start"] >= acc["pos"]
        put = F.when(s["kind"] == "generalised", shape(F.substring(text, s["start"] + 1, s["end"] - s["start"]))).otherwise(label[s["kind"]])
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), put)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    clean = F.aggregate(
        P + "spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text)))
    )
    clean = F.when(F.col(P + "spans").isNotNull(), clean).otherwise(text)
    return df.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

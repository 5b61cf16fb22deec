"""Personal data against a plain reading of the patterns, and the disclosure rule on a small corpus."""

import hashlib
import math
import re
from collections import defaultdict

import regex

from tessella.llm.pii import joined, op2_pii, personal_data, sanitise


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (2 if k % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, p, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


EDGES = [
    None, "", "x@y.z_abc@d.e", "a@b@c.d a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "001.2.3.255 256.1.1.1 1.2.3", "4111 1111 1111 1111 5", "4111-1111-1111-1111  4111111111111111",
    "é🙂 +1 (988) 555-2485, x@y.zz +12", "5 5 5  5", "1" * 5000, "a" * 50000 + " b@c.dd", "+1+1 555 555 5555-", "9" * 20 + "@1.2.3.4", "٣٤٥.1.2.3", "a@b.c " * 300,
]


def test_edges_against_plain_patterns(spark):
    df = spark.createDataFrame([(k, t, "own") for k, t in enumerate(EDGES)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in personal_data(df).select("doc_id", joined("base").alias("b"), joined("spans").alias("s")).collect()}
    assert len(got) == len(EDGES)
    for k, t in enumerate(EDGES):
        assert got[k]["b"] == ",".join(f"{a}:{b}:{c}" for a, b, c in base(t or "")), t
    assert personal_data(df.limit(0)).count() == 0
    clean = {r["doc_id"]: r for r in sanitise(df).collect()}
    assert clean[0]["text"] is None and clean[1]["text"] == "" and clean[4]["text"] == "[IP].[IP]" and clean[0]["spans"] == "own"
    assert clean[8]["text"] == "é🙂 [PHONE], [EMAIL] +12"


def test_query_against_plain_patterns(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op2_pii(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        spans = base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert r["n_email"] == sum(s[0] == "email" for s in spans)


def test_disclosing_term_is_taken(spark):
    other = [f"plain words about matter {k} and more of the same" for k in range(60)]
    known = [f"note {k}: write to Zorblatt at z.b@mail.example.com about the matter of day {w}" for k, w in enumerate(["sun", "moon", "rain", "wind"])]
    copies = ["call Quixley at q@mail.example.com now"] * 5
    df = spark.createDataFrame(list(enumerate(other + known + copies)), "doc_id long, text string")
    out = [r["text"] for r in sanitise(df).orderBy("doc_id").collect()]
    assert out[:60] == other
    assert all("Zorblatt" not in t and "[EMAIL]" in t and "the matter" in t for t in out[60:64])
    assert all(t == "call Quixley at [EMAIL] now" for t in out[64:])  # copies count once


def test_terms_far_from_the_entity_and_among_copies(spark):
    filler = "plain words about this matter and more of the same " * 4
    other = [f"{filler}{k}" for k in range(60)]
    far = [f"Dear Zorblatt {filler}{w} z.b@mail.example.com {filler} Zorblatt" for w in ("sun", "moon", "rain")]
    copies = [f"call Quixley at q@mail.example.com {w}" for w in ("now", "then", "soon")]
    df = spark.createDataFrame(list(enumerate(other + far + copies * 20)), "doc_id long, text string")
    out = [r["text"] for r in sanitise(df).orderBy("doc_id").collect()]
    assert out[:60] == other
    assert all("Zorblatt" not in t and "[EMAIL]" in t for t in out[60:63])
    assert all("Quixley" not in t and "[EMAIL]" in t for t in out[63:])


def added(texts, generalise=0.8, remove=0.95, least=3):
    """The disclosing terms' spans of each text, by plain counting over distinct texts."""
    term = regex.compile(r"(?<![\p{L}\p{N}@._%+-])\p{L}++(?![\p{N}@_%+])")
    once = sorted(set(texts))
    held, free, of_entity, joint, of_term = {}, {}, defaultdict(int), defaultdict(int), defaultdict(int)
    for t in once:
        found = base(t)
        held[t] = {(k, t[a:b].lower()) for k, a, b in found}
        free[t] = [(m[0].lower(), *m.span()) for m in term.finditer(t) if not any(a < m.end() and m.start() < b for _, a, b in found)]
        for e in held[t]:
            of_entity[e] += 1
            for w in {x[0] for x in free[t]}:
                joint[e, w] += 1
        for w in {x[0] for x in free[t]}:
            of_term[w] += 1
    out = {}
    for t in once:
        kinds = {}
        for e in held[t]:
            ic = math.log2(len(once) / of_entity[e])
            for w in {x[0] for x in free[t]}:
                if of_entity[e] >= least and joint[e, w] >= least and ic > 0:
                    pmi = math.log2(joint[e, w] * len(once) / (of_entity[e] * of_term[w]))
                    if pmi >= generalise * ic:
                        kinds[w] = max(kinds.get(w, ""), "removed" if pmi >= remove * ic else "generalised")
        out[t] = {(kinds[w], a, b) for w, a, b in free[t] if w in kinds}
    return [out[t] for t in texts]


def test_added_spans_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    letters = [(10**6 + k, f"Dear {'Zorblatt' if k % 5 else 'someone'}, {'QUIX' if k < 9 else 'plain'} matter {k} {w} z.b@mail.example.com or +1 (988) 555-2485{' again' * (k % 3)}") for k, w in enumerate(["sun", "moon", "rain", "wind", "snow"] * 3)]
    letters += [(10**6 + 50 + k, f"Zorblatt alone in text {k}") for k in range(5)]
    rows = docs + letters + letters[:4] + [(10**6 + 99, letters[0][1])]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", joined("base").alias("b"), joined("spans").alias("s")).collect()
    want = defaultdict(list)
    for (d, t), x in zip(rows, added([t for _, t in rows]), strict=True):
        want[d].append({f"{k}:{a}:{b}" for k, a, b in [*x, *base(t)]})
    assert sum(len(x[0]) for x in want.values()) > 30 and len(got) == len(rows)
    for r in got:
        assert set(r["s"].split(",")) - {""} == want[r["doc_id"]][0]
    assert any("generalised" in r["s"] for r in got) and any("removed" in r["s"] for r in got)


def test_offsets_of_very_many_matches(spark):
    """Running sums by blocks, and a time that follows the number of matches."""
    import random
    import time

    from pyspark.sql import functions as F

    from tessella.llm.pii import matches, sums_before

    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 4096, 4097, 9000):
        x = [rng.randrange(9) for _ in range(n)]
        want = [sum(x[:k]) for k in range(n)] if n < 100 else None
        got = spark.createDataFrame([(x,)], "x array<int>").select(sums_before(F.col("x")).alias("s")).first()["s"]
        assert len(got) == n and (got == want if want is not None else all(b - a == v for a, b, v in zip(got, got[1:], x, strict=False)))
    took = {}
    for n in (2_000, 2_000, 40_000):
        text = " ".join(f"{'é' * (k % 3)}w{'x' * (k % 5)}" for k in range(n))
        df, began = spark.createDataFrame([(text,)], "t string"), time.perf_counter()
        got = matches(df, "m", "t", r"\p{L}+", F.lit(True)).first()["m"]
        took[n] = time.perf_counter() - began
        assert [(m["start"], m["end"], m["value"]) for m in got] == [(*m.span(), m[0]) for m in regex.finditer(r"\p{L}+", text)]
    assert took[40_000] < 20 * took[2_000] + 5, took


def test_short_names_and_names_in_addresses(spark):
    other = [f"plain words about matter {k} and more of the same" for k in range(60)]
    known = [f"note {k}: Dr Ng, ng.w@mail.example.com, of day {w}" for k, w in enumerate(["sun", "moon", "rain", "wind"])]
    df = spark.createDataFrame(list(enumerate(other + known)), "doc_id long, text string")
    out = [r["text"] for r in sanitise(df).orderBy("doc_id").collect()]
    assert out[:60] == other and all("Ng" not in t and "[EMAIL]" in t for t in out[60:])


def test_generalised_terms_keep_their_shape(spark):
    from tessella.llm.pii import shape

    df = spark.createDataFrame([("Zorblatt", "[NAME-M]"), ("QUIX", "[ACRONYM-S]"), ("plainlyspoken", "[WORD-L]")], "t string, w string")
    assert all(r["w"] == r["s"] for r in df.select("w", shape(df["t"]).alias("s")).collect())


def shuffled(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_shuffles_stay_well_below_the_texts(spark):
    """Texts without an entity are not shuffled, and the terms of all texts are shuffled as strings, not as arrays of them."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    letters = [(10**6 + k, f"Dear Zorblatt, matter {k} {w} z.b@mail.example.com") for k, w in enumerate(["sun", "moon", "rain", "wind"])]
    df = spark.createDataFrame(docs + letters, "doc_id long, text string")
    before = set(shuffled(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as those of large tables
    try:
        got = {r["doc_id"]: r["s"] for r in personal_data(df).select("doc_id", joined("spans").alias("s")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(docs) + 4 and all("removed:5:13" in got[d] for d, _ in letters)
    written = sum(v for k, v in shuffled(spark).items() if k not in before)
    size = sum(len(t.encode()) for _, t in docs)
    assert 0.2 * size < written < 1.6 * size, written / size


def test_terms_of_any_script_are_counted(spark):
    """Terms that are shuffled as one string: none at all, one letter, and such whose lower case holds a mark."""
    other = [f"plain words about matter {k} and more of the same" for k in range(60)] + ["", "12 34", "x", None]
    known = [f"İzmirli 王 {w} +1 (988) 555-2485" for w in ("sun", "moon", "rain", "wind")]
    df = spark.createDataFrame(list(enumerate(other + known)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in personal_data(df).select("doc_id", joined("spans").alias("s")).collect()}
    assert all(got[k] == "" for k in range(64))
    assert all(got[64 + k].startswith("removed:0:7,removed:8:9,") for k in range(4)), got[64]

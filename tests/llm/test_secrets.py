"""Secret scans against a plain reading of their patterns."""

import hashlib
import random
import re
import string

from tessella.llm.secrets import P_CELLS, accepted, joined, op7_secrets, randomness, scan_text, secret_spans


def base(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_query_against_plain_patterns(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_secrets(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base(docs[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_edges_and_random_keys(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    keys = [key(40) for _ in range(60)]
    texts = ["", None, "token: token: abcdefg", "API_KEY='abc.def-1'", "paſſword=abcdefgh", "AKIA" + "A" * 16 + " AKIAB", "f" * 24 + "g", "é" * 10 + " secret = zzzzzz"]
    texts += [f"words {k} words" for k in keys] + ["the-well-known-name-of-a-thing-1 aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'y' AS spans")
    out = {r["doc_id"]: r["s"] for r in secret_spans(df).select("doc_id", joined("spans").alias("s")).collect()}
    assert len(out) == len(texts)
    for k, t in enumerate(texts):
        plain = [s for s in out[k].split(",") if s and not s.startswith("random")]
        assert plain == [f"{a}:{b}:{c}" for a, b, c in base(t or "")]
    assert sum("random:6:46" in out[8 + k] for k in range(60)) >= 50
    assert not any("random" in out[k] for k in range(68, len(texts)))
    assert secret_spans(df.limit(0)).count() == 0


def test_keys_are_uniform_in_p():
    rng = random.Random(1)
    for letters, n in (("0123456789abcdef", 24), ("0123456789abcdef", 40), (string.ascii_letters + string.digits, 20), (string.ascii_letters + string.digits, 64), (string.ascii_letters + string.digits + "+/", 200)):
        ps = [randomness("".join(rng.choices(letters, k=n)))[1] for _ in range(1000)]
        for t in (0.1, 0.25, 0.5, 0.75, 0.9):
            assert abs(sum(p < t for p in ps) / 1000 - t) < 0.06, (letters, n, t)
    assert randomness("aaaaaaaaaaaaaaaaaaaaaaaa1")[1] < 0.01 and randomness("internationalization")[1] < 0.05
    assert randomness("a_b/c" * 5) is None


def test_false_discoveries_stay_below_the_rate(spark):
    rng = random.Random(11)
    words = "get set user name list view model table index parse token cache event stream build value config render update handler manager service context request response".split()
    names = ["".join(w.capitalize() for w in rng.choices(words, k=4)) for _ in range(1500)] + ["_".join(rng.choices(words, k=5)) for _ in range(500)] + ["/".join(rng.choices(words, k=5)) for _ in range(500)]
    letters = string.ascii_letters + string.digits
    keys = ["".join(rng.choices(letters, k=k)) for k in (20, 24, 32, 40, 64) for _ in range(60)]
    lone = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=32))]  # the only one of its encoding
    inside = ["https://host/files/" + "".join(rng.choices(letters, k=40)) + "/view" for _ in range(60)]
    texts = [f"see {t} there" for t in names + keys + lone + inside]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in secret_spans(df, fdr=0.05).filter("size(spans) > 0").collect()}
    wrong, right = sum(k < len(names) for k in got), sum(k >= len(names) for k in got)
    assert wrong <= 0.05 * (wrong + right), (wrong, right)
    assert right >= 0.8 * (len(texts) - len(names)), right


def reported(texts, fdr=0.05):
    """Spans of the tests of randomness, by the same steps without Spark."""
    found = [(k, *f) for k, t in enumerate(texts) for f in scan_text(t)[1]]
    counts = {}
    for _, a, b, e, p in found:
        counts.setdefault((e, min((b - a) // 10, 12)), [0] * P_CELLS)[min(int(p * P_CELLS), P_CELLS - 1)] += 1
    limits = accepted(counts, fdr)
    return {k for k, a, b, e, p in found if min(int(p * P_CELLS), P_CELLS - 1) >= limits.get((e, min((b - a) // 10, 12)), P_CELLS)}


def test_lone_keys_are_found():
    """A table with one key, of 200 keys each; and one among 600 identifiers, of which few are taken for keys."""
    letters = string.ascii_letters + string.digits
    words = "get set user name list view model table index parse token cache event stream build value config render update handler".split()
    for n, least in ((40, 0.95), (20, 0.75)):
        hits = sum(bool(reported([f"see {''.join(random.Random(seed).choices(letters, k=n))} there"])) for seed in range(200))
        assert hits >= least * 200, (n, hits)
    hits = wrong = 0
    for seed in range(60):
        rng = random.Random(1000 + seed)
        names = ["see " + "".join(w.capitalize() for w in rng.choices(words, k=4)) for _ in range(300)] + ["see " + "_".join(rng.choices(words, k=5)) for _ in range(300)]
        got = reported([*names, "see " + "".join(rng.choices(letters, k=40))])
        hits += len(names) in got
        wrong += len(got - {len(names)})
    assert hits >= 54 and wrong <= 0.0025 * 60 * 600, (hits, wrong)


def test_keys_behind_either_kind_of_separator():
    rng = random.Random(4)
    std = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=44)) + "/+"
    url = "".join(rng.choices(string.ascii_letters + string.digits + "-_", k=44)) + "_-"
    spans = {(a, b): e for a, b, e, _ in scan_text(f"id_{std} files/{url}")[1]}
    assert spans[(3, 49)] == "base64" and spans[(56, 102)] == "base64url"

"""Quality rules on edge cases; the query has SQL besides."""

from collections import Counter

from tessella.llm.quality import RULES, order_rules, quality_filter, quality_report

PROSE = " ".join(f"word{k % 61}x{k}" for k in range(80))
TEXTS = [None, "", " \n\t", "a", PROSE, PROSE + "\n" + PROSE, "\n".join(["same line here"] * 40), " ".join(f"w{k}*#" for k in range(90)), "a b c a b c a b", PROSE * 50, "x" * 100000, "é🙂 " * 60]


def measure(text):
    w = text.split(" ") if text else []
    w = [x for p in w for x in p.replace("\n", "\t").split("\t") if x]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    at = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(at)


def test_edges(spark):
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in quality_report(df).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measure(t or ""), k
    kept = {r["doc_id"] for r in quality_filter(df).collect()}
    assert kept == {k for k, r in got.items() if r["kept"]} and 4 in kept
    assert quality_filter(df).columns == df.columns
    for order in (RULES, RULES[::-1]):
        assert {r["doc_id"] for r in quality_filter(df, order).collect()} == kept
    assert quality_report(df.limit(0)).count() == 0 and quality_filter(df.limit(0)).count() == 0


def test_cascade_tells_rule_and_number(spark):
    fails = {
        "too_few_words": lambda n, c, s, d, r, k: n < 50,
        "repeated_words": lambda n, c, s, d, r, k: 100 * r > 50 * n,
        "symbols": lambda n, c, s, d, r, k: 10 * s > n,
        "echoed_lines": lambda n, c, s, d, r, k: 2 * d > k,
        "word_length": lambda n, c, s, d, r, k: c < 2 * n or c > 15 * n,
    }
    # Repeated rows, ids included, are judged each alike.
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(TEXTS)] * 2, "doc_id long, text string, failed_rule int")
    for rules in (RULES, RULES[::-1], RULES[2:4]):
        order = [r.name for r in order_rules(df, rules)]
        assert sorted(order) == sorted(r.name for r in rules) and order == [r.name for r in order_rules(df.repartition(3), rules)]
        rows = quality_report(df, rules).collect()
        assert len(rows) == 2 * len(TEXTS)
        for r in rows:
            t = TEXTS[r["doc_id"]] or ""
            lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n"))
            met = [k for k, name in enumerate(order) if fails[name](*measure(t), lines)]
            assert (r["failed_rule"], r["rules_run"]) == ((order[met[0]], met[0] + 1) if met else (None, len(order))), r["doc_id"]
            assert r["kept"] == (not met) and (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measure(t)
    assert [r.name for r in order_rules(df.limit(0))] == [r.name for r in RULES]
    assert len(order_rules(df.select("text"))) == len(RULES)

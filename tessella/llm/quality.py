"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule names the measure it needs and a test.  Its cost (characters and words that the
measure goes through, each at a stated rate) and its selectivity (share rejected) are
estimated on a bounded sample, in one job; rules then run in order of rejections per cost,
and a document that one rule rejects skips the measures of the rules after it.  The sample
follows from the ids alone, so the order is the same in every run.  The verdict is the same
in any order; the rule that rejected a document, and how many rules it met, tell the order.

Defined results: null or empty text has no words and is rejected as too short; texts
of any length are measured whole; rules with equal rejections per cost keep their given order;
repeated rows are measured and judged each alike, and sampled together; a table without the id
column is sampled by its texts; an empty table gives an empty table; other columns
pass through, and working columns carry a prefix so that clashing names are safe.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACES, text_or_empty, word_array

#: Working columns start with this.
P = "__q_"
#: Rows of the sample that costs and selectivities come from, out of so many that the sampling hash tells apart.
SAMPLE_ROWS, SAMPLE_CELLS = 2000, 16**7
#: What a measure costs per character and per word, in nanoseconds (timed on eight cores); each costs a little besides.
COSTS = {"n_words": (0, 0), "word_chars": (70, 0), "n_symbols": (70, 0), "n_dup_lines": (30, 0), "n_repeat_words": (0, 1200)}
FIXED_COST = 100


def _layer(df: DataFrame, name: str, value: Column, active: Column) -> DataFrame:
    return df.withColumn(P + name, F.when(active, value))


def _words(df: DataFrame, active: Column) -> DataFrame:
    df = _layer(df, "w", word_array(F.col(P + "text")), active)
    return _layer(df, "n_words", F.size(P + "w").cast("long"), active)


def _word_chars(df: DataFrame, active: Column) -> DataFrame:
    return _layer(df, "word_chars", F.length(F.translate(P + "text", SPACES, "")).cast("long"), active)


def _symbols(df: DataFrame, active: Column) -> DataFrame:
    rest = F.length(F.translate(P + "text", "#*$%&|<>", ""))
    return _layer(df, "n_symbols", (F.length(P + "text") - rest).cast("long"), active)


def _dup_lines(df: DataFrame, active: Column) -> DataFrame:
    lines = F.filter(F.split(P + "text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    df = _layer(df, "lines", lines, active)
    df = _layer(df, "n_lines", F.size(P + "lines").cast("long"), active)
    return _layer(df, "n_dup_lines", F.size(P + "lines").cast("long") - F.size(F.array_distinct(P + "lines")), active)


def _repeat_words(df: DataFrame, active: Column) -> DataFrame:
    """Words inside 3-word windows that occur twice or more: sort the windows, look at neighbours."""
    w, n = F.col(P + "w"), F.size(P + "w")
    tri = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    df = _layer(df, "tri", tri, active & (n >= 3))
    t = F.col(P + "tri")
    # Most documents repeat nothing, and a hash set tells that without a sort.
    repeats = active & t.isNotNull() & (F.size(F.array_distinct(t)) < F.size(t))
    df = _layer(df, "sorted", F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeats)
    s = F.col(P + "sorted")
    at = F.transform(
        s,
        lambda x, k: F.when(
            ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), x["i"]
        ),
    )
    df = _layer(df, "at", F.sort_array(F.filter(at, lambda i: i.isNotNull())), s.isNotNull())
    a = F.col(P + "at")
    covered = F.aggregate(
        F.transform(a, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - p, F.lit(3)))), F.lit(0), lambda x, y: x + y
    )
    return _layer(df, "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"), active)


#: Measures by name; each adds its column under the condition it is given.
MEASURES: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "n_words": lambda df, active: df,  # every rule needs the words, so they come first
    "word_chars": _word_chars,
    "n_symbols": _symbols,
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` is true; ``measure`` is what has to be known."""

    name: str
    measure: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(P + name)


BASE_RULES = (
    Rule("too_few_words", "n_words", lambda: _c("n_words") < 50),
    Rule("repeated_words", "n_repeat_words", lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
)
#: Thresholds that leave ordinary prose alone and catch lists, markup and echoed lines.
RULES = (
    *BASE_RULES,
    Rule("symbols", "n_symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule("echoed_lines", "n_dup_lines", lambda: 2 * _c("n_dup_lines") > _c("n_lines")),
    Rule("word_length", "word_chars", lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 15 * _c("n_words"))),
)


def _prepared(docs: DataFrame, text_col: str) -> DataFrame:
    return _words(docs.withColumn(P + "text", text_or_empty(text_col)), F.lit(True))


def _tidy(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in keep])


def sampled(docs: DataFrame, text_col: str, rows: int, id_col: str) -> DataFrame:
    """About ``rows`` documents (all, if fewer), by a hash of their ids: the same in every run."""
    total = docs.count()
    key = F.md5(F.coalesce(F.col(f"`{id_col if id_col in docs.columns else text_col}`").cast("string"), F.lit("")))
    cell = F.conv(F.substring(key, 1, 7), 16, 10).cast("double")
    return docs.filter(cell * F.lit(float(total)) < F.lit(float(rows * SAMPLE_CELLS))).select(text_col)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> list[Rule]:
    """Rules by rejections per cost, both estimated on about ``sample_rows`` documents.

    Only the order of evaluation depends on the sample, never a verdict.
    """
    df = _prepared(sampled(docs, text_col, sample_rows, id_col), text_col)
    for m in dict.fromkeys(r.measure for r in rules):
        df = MEASURES[m](df, F.lit(True))
    seen = df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.length(P + "text")), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(P + "n_words"), F.lit(0)).alias("words"),
        *[F.count_if(r.fails()).alias(f"r{k}") for k, r in enumerate(rules)],
    ).first()

    def rate(k: int) -> float:
        char, word = COSTS[rules[k].measure]
        return seen[f"r{k}"] / max(1, FIXED_COST * seen["rows"] + char * seen["chars"] + word * seen["words"])

    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-rate(k), k))]


def cascade(df: DataFrame, ordered: list[Rule]) -> DataFrame:
    """Adds ``__q_failed``, the first rule, in order, that rejects the document, or null, and ``__q_run``, how many it met.

    A measure is taken only of documents that are still in the race.
    """
    df, have = df.withColumn(P + "failed", F.lit(None).cast("string")).withColumn(P + "run", F.lit(0).cast("long")), set()
    for r in ordered:
        going = F.col(P + "failed").isNull()
        if r.measure not in have:
            df = MEASURES[r.measure](df, going)
            have.add(r.measure)
        df = df.withColumn(P + "run", F.col(P + "run") + going.cast("long"))
        df = df.withColumn(P + "failed", F.when(going, F.when(r.fails(), F.lit(r.name))).otherwise(F.col(P + "failed")))
    return df


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass every rule, with their own columns."""
    df = cascade(_prepared(docs, text_col), order_rules(docs, rules, text_col))
    # A row number holds the filter above the measures: pushed down, it would repeat them all in its own condition.
    df = df.withColumn(P + "row", F.monotonically_increasing_id())
    return _tidy(df.filter(F.col(P + "failed").isNull() & (F.col(P + "row") >= 0)), docs.columns)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Each document's measures, ``base_failed`` and ``kept``, beside its own columns.

    The verdict, ``failed_rule`` (null if kept) and ``rules_run`` are the cascade's.  The report
    has every measure of every document, so what the cascade skipped is measured after it.
    """
    ordered = order_rules(docs, rules, text_col)
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = cascade(_prepared(docs, text_col), ordered)
    judged = {r.measure for r in ordered}
    for m in out[1:]:
        had = F.col(P + m) if m in judged else F.lit(None).cast("long")
        df = df.withColumn(P + "had", had)
        df = MEASURES[m](df, F.col(P + "had").isNull()).withColumn(P + m, F.coalesce(P + "had", P + m))
    base = BASE_RULES[0].fails() | BASE_RULES[1].fails()
    added = {*out, "base_failed", "kept", "failed_rule", "rules_run"}
    own = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    verdict = [_c("failed").isNull().alias("kept"), _c("failed").alias("failed_rule"), _c("run").alias("rules_run")]
    return df.select(*own, *[_c(c).alias(c) for c in out], base.alias("base_failed"), *verdict)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; see :func:`quality_report`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_report(docs).drop("text")


OP8_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS tri
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) WHERE c >= 2),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT m.*, length(text) AS chars, unnest([
        {'k': 0, 'rule': 'too_few_words', 'char': 0, 'word': 0, 'fails': n_words < 50},
        {'k': 1, 'rule': 'repeated_words', 'char': 0, 'word': 1200, 'fails': 100 * n_repeat_words > 50 * n_words},
        {'k': 2, 'rule': 'symbols', 'char': 70, 'word': 0, 'fails': 10 * n_symbols > n_words},
        {'k': 3, 'rule': 'echoed_lines', 'char': 30, 'word': 0, 'fails': 2 * n_dup_lines > n_lines},
        {'k': 4, 'rule': 'word_length', 'char': 70, 'word': 0, 'fails': word_chars < 2 * n_words OR word_chars > 15 * n_words}], recursive := true)
      FROM m JOIN t USING (doc_id)),
s AS (SELECT k, count(*) FILTER (fails) / greatest(1, 100 * count(*) + any_value(char) * sum(chars) + any_value(word) * sum(n_words))::DOUBLE AS rate
      FROM f WHERE ('0x' || md5(doc_id::VARCHAR)[1:7])::BIGINT * (SELECT count(*) FROM documents) < 2000::BIGINT * 268435456 GROUP BY k),
o AS (SELECT k, row_number() OVER (ORDER BY rate DESC, k) AS pos FROM s),
v AS (SELECT doc_id, min_by(rule, pos) FILTER (fails) AS failed_rule, coalesce(min(pos) FILTER (fails), 5)::BIGINT AS rules_run
      FROM f JOIN o USING (k) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       failed_rule IS NULL AS kept, failed_rule, rules_run
FROM m JOIN v USING (doc_id)
"""

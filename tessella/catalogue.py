"""Every query of the engine's own operators, with its SQL where SQL can express it."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import hashing as H
from tessella.functions import losses as L
from tessella.functions.cityhash import city_hashes
from tessella.operators import clustering, factorization, frame, linalg, metrics
from tessella.operators import updaters as U
from tessella.plans import apps
from tessella.plans import tables as T
from tessella.plans import trainers
from tessella.plans.config import Embedding, LearnConfig
from tessella.plans.lbfgs import LBFGS, aligned, in_orthant, pseudo_gradient
from tessella.plans.tables import EVENTS_SQL, ORDERS_SQL, QUALITY_SQL, key_sql, md5_sql, weight_sql
from tessella.sources import files, formats
from tessella.streaming import online

OFFSET = 0.0137
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(x, digits: int = 6):
    """Rounded, without a negative zero; a small offset keeps short decimals off the edge between two results."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + F.lit(OFFSET * 10.0**-digits), digits) + F.lit(0.0)


def rs(x: str, digits: int = 6) -> str:
    return f"round({x} + {OFFSET * 10.0**-digits!r}::DOUBLE, {digits}) + 0.0E0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SOFTPLUS = "(greatest({0}, 0.0E0) + ln(1 + exp(-abs({0}))))"
_Y = "(CASE WHEN label > 0 THEN 1.0E0 ELSE -1.0E0 END)"
_SIGMOID = "(1 / (1 + exp(-({0}))))"

# --- keys and triplets --------------------------------------------------------------


@query(f"SELECT p_partkey, {md5_sql('p_name')} AS h, {key_sql('p_brand', 5)} AS brand_key, {key_sql('p_type', 6)} AS type_key FROM part")
def hash_features(spark, sf_dir):
    key = partial(H.string_key, portable=True)
    return table(spark, sf_dir, "part").select("p_partkey", H.md5_60(F.col("p_name")).alias("h"), key(F.col("p_brand"), 5).alias("brand_key"), key(F.col("p_type"), 6).alias("type_key"))


@query("SELECT l_suppkey, l_linenumber, count(*) AS n, (l_suppkey >> 10) | (l_linenumber::BIGINT << 54) AS key FROM lineitem GROUP BY l_suppkey, l_linenumber")
def group_key_pack(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return got.withColumn("key", H.group_key(F.col("l_suppkey"), F.col("l_linenumber")))


@query("SELECT DISTINCT l_partkey, ('0x' || reverse(lpad(lower(to_hex(l_partkey)), 16, '0')))::UBIGINT::DECIMAL(20, 0)::VARCHAR AS spread FROM lineitem")
def nibble_reverse(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    return parts.select("l_partkey", F.conv(F.hex(H.reverse_nibbles(F.col("l_partkey"))), 16, 10).alias("spread"))


@query(f"SELECT {key_sql('l_returnflag', 1)} % 1009 AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def hash_kernel(spark, sf_dir):
    key = H.string_key(F.col("l_returnflag"), 1, portable=True)
    return frame.hash_kernel(table(spark, sf_dir, "lineitem").select(key.alias("index")), 1009).groupBy(F.col("index").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"{EVENTS_SQL} SELECT row_id, index, {rs('value', 9)} AS value FROM tr")
def sparse_triplets(spark, sf_dir):
    return T.events_triplets(spark, sf_dir).select("row_id", "index", r("value", 9).alias("value"))


@query(f"{EVENTS_SQL} SELECT (SELECT bool_and(value = 1) FROM tr) AS all_ones, (SELECT count(*) FROM tr) AS nnz, (SELECT count(*) FROM tr WHERE value = 1) AS ones")
def binary_default_value(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    ones = F.sum(F.size(F.filter("features", lambda f: f["value"] == 1.0)).cast("long")).alias("ones")
    return frame.is_binary(rows).crossJoin(rows.agg(ones))


@query(f"{EVENTS_SQL} SELECT index, count(*) AS count FROM tr GROUP BY index")
def unique_index_count(spark, sf_dir):
    return frame.unique_index(T.events_triplets(spark, sf_dir))


@query(f"{EVENTS_SQL} SELECT index, least(count(*), 255) AS count FROM tr GROUP BY index")
def count_saturate(spark, sf_dir):
    return frame.unique_index(T.events_triplets(spark, sf_dir), 255)


@query(f"{ORDERS_SQL} SELECT index, count(*) AS count, row_number() OVER (ORDER BY index) - 1 AS local_id FROM tr GROUP BY index")
def localize_dense_id(spark, sf_dir):
    return frame.dictionary(frame.triplets(T.orders_rows(spark, sf_dir)))


@query(f"""{ORDERS_SQL}, dic AS (SELECT index, row_number() OVER (ORDER BY index) - 1 AS local_id FROM tr GROUP BY index HAVING count(*) > 10)
SELECT row_id, local_id, {rs('value')} AS value FROM tr JOIN dic USING (index)""")
def remap_drop_missing(spark, sf_dir):
    tri = frame.triplets(T.orders_rows(spark, sf_dir))
    often = frame.unique_index(tri).filter("count > 10")
    dic = frame.dictionary(tri.join(often, "index", "left_semi"))
    return frame.remap(tri, dic).withColumn("value", r("value"))


# --- products -----------------------------------------------------------------------


@query(f"{EVENTS_SQL} SELECT row_id, {rs('margin')} AS y FROM mg")
def spmv(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    tri = frame.triplets(rows)
    return linalg.spmv(tri, T.hash_model(tri), rows).select("row_id", r("y").alias("y"))


@query(f"{EVENTS_SQL} SELECT index, {rs('sum(value * (row_id % 7 - 3))')} AS g FROM tr GROUP BY index")
def spmv_transpose(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    d = rows.select("row_id", (F.col("row_id") % 7 - 3).cast("double").alias("d"))
    return linalg.spmv_t(frame.triplets(rows), d).select("index", r("g").alias("g"))


_LONG = f"mv AS (SELECT index, x.k AS k, x.v AS v FROM (SELECT index, unnest([{', '.join('struct_pack(k := %d, v := %s / 10)' % (k, weight_sql('index', f'v{k}:')) for k in range(4))}]) AS x FROM (SELECT DISTINCT index FROM tr)))"


@query(f"{EVENTS_SQL}, {_LONG} SELECT row_id, k::INT AS k, {rs('sum(value * v)')} AS y FROM tr JOIN mv USING (index) GROUP BY row_id, k")
def spmm(spark, sf_dir):
    tri = T.events_triplets(spark, sf_dir)
    return linalg.spmm(tri, T.hash_model(tri, 4), 4).withColumn("y", r("y"))


@query(f"""{EVENTS_SQL}, {_LONG}, xk AS (SELECT row_id, k, (row_id % (k + 2)) AS x FROM (SELECT DISTINCT row_id FROM tr), (SELECT unnest([0, 1, 2, 3]) AS k)),
g AS (SELECT index, k, sum(value * x) AS y FROM tr JOIN xk USING (row_id) GROUP BY index, k)
SELECT index, k::INT AS k, {rs('y + 0.5E0 * v')} AS y FROM g JOIN mv USING (index, k)""")
def spmm_transpose_addend(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    tri = frame.triplets(rows)
    x = rows.select("row_id", F.array(*[(F.col("row_id") % (k + 2)).cast("double") for k in range(4)]).alias("x"))
    z = T.hash_model(tri, 4).select("index", F.col("v").alias("z"))
    return linalg.spmm_t(tri, x, 4, z, 0.5).withColumn("y", r("y"))


# --- losses and metrics --------------------------------------------------------------


@query(f"{EVENTS_SQL} SELECT count(*) AS n, {rs('sum(' + _SOFTPLUS.format('-' + _Y + ' * margin') + ')', 4)} AS objv, {rs('greatest(avg(((label > 0) = (margin > 0))::INT), 1 - avg(((label > 0) = (margin > 0))::INT))')} AS acc FROM mg")
def logit_objective(spark, sf_dir):
    m = T.margins(T.events_rows(spark, sf_dir))
    return m.agg(F.count("*").alias("n"), r(metrics.logit_objective(F.col("label"), F.col("margin")), 4).alias("objv"), r(metrics.accuracy(F.col("label"), F.col("margin"), folded=True)).alias("acc"))


@query(f"{ORDERS_SQL} SELECT {rs('-sum(CASE WHEN label > 0 THEN ln(' + _SIGMOID.format('margin') + ') ELSE ln(1 - ' + _SIGMOID.format('margin') + ') END)', 4)} AS log_loss FROM mg")
def log_loss(spark, sf_dir):
    m = T.margins(T.orders_rows(spark, sf_dir))
    return m.agg(r(metrics.log_loss(F.col("label"), L.sigmoid(F.col("margin"))), 4).alias("log_loss"))


@query(f"{EVENTS_SQL} SELECT {rs('sum(pow(greatest(0.0E0, 1 - ' + _Y + ' * margin), 2))', 4)} AS objv FROM mg")
def square_hinge_objective(spark, sf_dir):
    m = T.margins(T.events_rows(spark, sf_dir))
    return m.agg(r(F.sum(L.Loss(L.LossKind.SQUARE_HINGE).value(F.col("label"), F.col("margin"))), 4).alias("objv"))


@query(f"{EVENTS_SQL} SELECT {rs('sum(0.5E0 * pow(margin - label, 2))', 4)} AS objv FROM mg")
def square_objective(spark, sf_dir):
    m = T.margins(T.events_rows(spark, sf_dir))
    return m.agg(r(F.sum(L.Loss(L.LossKind.SQUARE).value(F.col("label"), F.col("margin"))), 4).alias("objv"))


@query(f"{EVENTS_SQL} SELECT {rs('sum(CASE WHEN label > 0 THEN 1.0E0 ELSE 0 END) / sum(' + _SIGMOID.format('margin') + ')')} AS copc FROM mg")
def copc(spark, sf_dir):
    return T.margins(T.events_rows(spark, sf_dir)).agg(r(metrics.copc(F.col("label"), F.col("margin"))).alias("copc"))


@query(f"{QUALITY_SQL} SELECT count(*) AS n, {rs('avg(((label > 0) = (margin > 0))::INT)')} AS acc, {rs('greatest(avg(((label > 0) = (margin > 0))::INT), 1 - avg(((label > 0) = (margin > 0))::INT))')} AS folded FROM mg")
def accuracy_folded(spark, sf_dir):
    m = T.margins(T.quality_rows(spark, sf_dir))
    y, s = F.col("label"), F.col("margin")
    return m.agg(F.count("*").alias("n"), r(metrics.accuracy(y, s)).alias("acc"), r(metrics.accuracy(y, s, folded=True)).alias("folded"))


_AUC = """, ps AS (SELECT {by} round(margin, 9) AS s, sum((label > 0)::INT)::DOUBLE AS p, sum((label <= 0)::INT)::DOUBLE AS n FROM {src} GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER ({part} ORDER BY s) - n AS below FROM ps),
au AS (SELECT {by} CASE WHEN sum(p) = 0 OR sum(n) = 0 THEN 1.0E0 ELSE sum(p * (below + n / 2)) / (sum(p) * sum(n)) END AS auc FROM cu {group})"""


@query(f"{EVENTS_SQL}{_AUC.format(by='', src='mg', part='', group='')} SELECT {rs('auc')} AS auc, {rs('greatest(auc, 1 - auc)')} AS folded FROM au")
def auc_folded(spark, sf_dir):
    a = metrics.auc(T.margins(T.events_rows(spark, sf_dir)), digits=9)
    return a.select(r("auc").alias("auc"), r(metrics.fold(F.col("auc"))).alias("folded"))


@query(f"{EVENTS_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 512 AS batch_id FROM mg){_AUC.format(by='batch_id,', src='b', part='PARTITION BY batch_id', group='GROUP BY batch_id')} SELECT count(*) AS n_batches, {rs('avg(greatest(auc, 1 - auc))')} AS auc FROM au")
def auc_per_batch_mean(spark, sf_dir):
    m = frame.minibatches(T.margins(T.events_rows(spark, sf_dir)), 512)
    return metrics.auc(m, by=["batch_id"], folded=True, digits=9).agg(F.count("*").alias("n_batches"), r(F.avg("auc")).alias("auc"))


@query(f"""{EVENTS_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 1000 AS batch_id FROM mg),
o AS (SELECT batch_id, count(*) AS n, sum({_SOFTPLUS.format('-' + _Y + ' * margin')}) AS objv, avg(((label > 0) = (margin > 0))::INT) AS a FROM b GROUP BY 1){_AUC.format(by='batch_id,', src='b', part='PARTITION BY batch_id', group='GROUP BY batch_id')}
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_batches, {rs('sum(objv) / sum(n)')} AS logloss, {rs('avg(greatest(a, 1 - a))')} AS acc, {rs('avg(greatest(auc, 1 - auc))')} AS auc FROM o JOIN au USING (batch_id)""")
def progress_merge(spark, sf_dir):
    m = frame.minibatches(T.margins(T.events_rows(spark, sf_dir)), 1000)
    return metrics.merged_progress(metrics.progress(m)).select("n_rows", "n_batches", *[r(c).alias(c) for c in ("logloss", "acc", "auc")])


# --- gradients -----------------------------------------------------------------------


def _gradient(spark, sf_dir, loss):
    rows = T.events_rows(spark, sf_dir)
    dual = T.margins(rows).select("row_id", loss.dual(F.col("label"), F.col("margin")).alias("d"))
    return linalg.spmv_t(frame.triplets(rows), dual).select("index", r("g").alias("g"))


_GRAD = "{0} SELECT index, {1} AS g FROM tr JOIN (SELECT row_id, {2} AS d FROM mg) USING (row_id) GROUP BY index"


@query(_GRAD.format(EVENTS_SQL, rs("sum(value * d)"), f"-{_Y} / (1 + exp({_Y} * margin))"))
def logit_gradient(spark, sf_dir):
    return _gradient(spark, sf_dir, L.Loss())


@query(_GRAD.format(EVENTS_SQL, rs("sum(value * d)"), f"-2 * {_Y} * greatest(0.0E0, 1 - {_Y} * margin)"))
def square_hinge_gradient(spark, sf_dir):
    return _gradient(spark, sf_dir, L.Loss(L.LossKind.SQUARE_HINGE))


@query(_GRAD.format(EVENTS_SQL, rs("sum(value * d)"), f"-2 * {_Y} * (CASE WHEN {_Y} * margin > 1 THEN 1 ELSE 0 END)"))
def square_hinge_gradient_compat(spark, sf_dir):
    return _gradient(spark, sf_dir, L.Loss(L.LossKind.SQUARE_HINGE, compat=True))


@query(_GRAD.format(EVENTS_SQL, rs("sum(value * d)"), "margin - label"))
def square_gradient(spark, sf_dir):
    return _gradient(spark, sf_dir, L.Loss(L.LossKind.SQUARE))


# --- proximal steps and gradient shaping -----------------------------------------------

_G = "SELECT l_suppkey, sum(l_discount - 0.05E0) AS g, sum(l_tax) + 1 AS eta FROM lineitem GROUP BY l_suppkey"


def _supplier_gradients(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_discount") - 0.05).alias("g"), (F.sum("l_tax") + 1).alias("eta"))


@query(f"SELECT l_suppkey, {rs('CASE WHEN abs(g) <= 0.25E0 THEN 0 ELSE (g - sign(g) * 0.25E0) / (eta + 0.1E0) END')} AS w FROM ({_G})")
def l1l2_prox(spark, sf_dir):
    return _supplier_gradients(spark, sf_dir).select("l_suppkey", r(L.prox(F.col("g"), F.col("eta"), 0.25, 0.1)).alias("w"))


@query(f"SELECT l_suppkey, {rs('greatest(least(g, 0.2E0), -0.2E0)')} AS g FROM ({_G})")
def grad_clip(spark, sf_dir):
    return _supplier_gradients(spark, sf_dir).select("l_suppkey", r(L.clip(F.col("g"), 0.2)).alias("g"))


@query(f"SELECT l_suppkey AS index, 0::INT AS k, {rs('g / sqrt(sum(g * g) OVER ())')} AS gv FROM ({_G})")
def grad_normalize(spark, sf_dir):
    g = _supplier_gradients(spark, sf_dir).select(F.col("l_suppkey").alias("index"), F.array("g").alias("gv"))
    return factorization.normalised(g).select("index", F.posexplode("gv").alias("k", "gv")).withColumn("gv", r("gv"))


# --- batches ----------------------------------------------------------------------------


@query("SELECT event_id AS row_id, (row_number() OVER (ORDER BY event_id) - 1) // 300 AS batch_id FROM events")
def minibatch_assign(spark, sf_dir):
    return frame.minibatches(T.events_rows(spark, sf_dir).select("row_id"), 300)


@query(f"SELECT event_id AS row_id, (event_type = 'purchase') AS positive FROM events WHERE event_type = 'purchase' OR {md5_sql("event_id::VARCHAR || '#' || '9'")} % 1000 < 300")
def negative_downsample(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir).select("row_id", "label")
    return frame.downsample_negatives(rows, H.bernoulli(F.col("row_id"), 9, 300)).select("row_id", (F.col("label") > 0).alias("positive"))


@query(
    "WITH b AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) + 1 AS hi FROM lineitem) "
    "SELECT least((l_orderkey - b.lo) // greatest((b.hi - b.lo) // 10, 1), 9) AS part, count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem, b GROUP BY 1"
)
def range_segment(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem")
    lo, hi = keys.agg(F.min("l_orderkey"), F.max("l_orderkey") + 1).first()
    return keys.groupBy(frame.segment_of(F.col("l_orderkey"), lo, hi, 10).alias("part")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


@query()
def shuffle_buffer(spark, sf_dir):
    return frame.shuffled(T.events_rows(spark, sf_dir).select("row_id", "label"), 1000, seed=3)


# --- update steps --------------------------------------------------------------------------

# A first push of the gradient at zero weights: margin 0, so each row's dual is half its sign.
_ZERO_GRAD = f"g0 AS (SELECT index, sum(value * (-{_Y}) * 0.5E0) AS g FROM tr GROUP BY index)"


def _first_push(spark, sf_dir, rule, digits=6):
    rows = T.events_rows(spark, sf_dir)
    dual = rows.select("row_id", L.Loss().dual(F.col("label"), F.lit(0.0)).alias("d"))
    grad = linalg.spmv_t(frame.triplets(rows), dual)
    return U.push(trainers.empty_state(spark, rule), grad, rule).select("index", *[r(c, digits).alias(c) for c in rule.state])


def _prox(z: str, eta: str, l1: str = "1", l2: str = "0") -> str:
    return f"(CASE WHEN abs({z}) <= {l1} THEN 0.0E0 ELSE (({z}) - sign({z}) * {l1}) / ({eta} + {l2}) END)"


@query(f"{EVENTS_SQL}, {_ZERO_GRAD} SELECT index, {rs(_prox('-g', '20.0E0'))} AS w FROM g0")
def sgd_step(spark, sf_dir):
    return _first_push(spark, sf_dir, U.SGD())


@query(f"{EVENTS_SQL}, {_ZERO_GRAD} SELECT index, {rs(_prox('-g', '((abs(g) + 1) / 0.1E0)'))} AS w, {rs('abs(g)')} AS n FROM g0")
def adagrad_step(spark, sf_dir):
    return _first_push(spark, sf_dir, U.AdaGrad())


@query(f"{EVENTS_SQL}, {_ZERO_GRAD} SELECT index, {rs(_prox('-g', '((abs(g) + 1) / 0.1E0)'))} AS w, {rs('g')} AS z, {rs('abs(g)')} AS n FROM g0")
def ftrl_step(spark, sf_dir):
    return _first_push(spark, sf_dir, U.FTRL())


#: Three minibatches cover the table.
_THIRD = "((SELECT count(*) FROM events) // 3 + 1)"


def _ftrl_ctes(batches: int, size: str) -> str:
    """Unrolled: one block of CTEs a batch; the state after all of them is s<batches>."""
    out = [f"{EVENTS_SQL}, nb AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // {size} AS b FROM er)", "s0 AS (SELECT 0::BIGINT AS index, 0.0E0 AS w, 0.0E0 AS z, 0.0E0 AS n WHERE false)"]
    for k in range(batches):
        out += [
            f"t{k} AS (SELECT tr.* FROM tr JOIN nb USING (row_id) WHERE b = {k})",
            f"m{k} AS (SELECT row_id, label, sum(value * coalesce(w, 0)) AS margin FROM t{k} LEFT JOIN s{k} USING (index) GROUP BY ALL)",
            f"d{k} AS (SELECT row_id, -{_Y} / (1 + exp({_Y} * margin)) AS d FROM m{k})",
            f"g{k}x AS (SELECT index, sum(value * d) AS g FROM t{k} JOIN d{k} USING (row_id) GROUP BY index)",
            f"j{k} AS (SELECT index, g, coalesce(w, 0) AS w, coalesce(z, 0) AS z, coalesce(n, 0) AS n FROM s{k} FULL JOIN g{k}x USING (index))",
            f"u{k} AS (SELECT index, g, w, CASE WHEN g IS NULL THEN z ELSE z + g - (sqrt(n * n + g * g) - n) / 0.1E0 * w END AS z, CASE WHEN g IS NULL THEN n ELSE sqrt(n * n + g * g) END AS n FROM j{k})",
            f"s{k + 1} AS (SELECT index, CASE WHEN g IS NULL THEN w ELSE {_prox('-z', '((1 + n) / 0.1E0)')} END AS w, z, n FROM u{k})",
        ]
    return ",\n".join(out)


@query(f"{_ftrl_ctes(3, _THIRD)} SELECT index, {rs('w')} AS w, {rs('z')} AS z, {rs('n')} AS n FROM s3")
def ftrl_three_batches(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    rows = frame.minibatches(rows, rows.count() // 3 + 1).persist()
    rule, state = U.FTRL(), trainers.empty_state(spark, U.FTRL())
    for k in range(3):
        part = rows.filter(F.col("batch_id") == k)
        tri = frame.triplets(part)
        m = part.join(linalg.spmv(tri, state.select("index", "w"), part, "margin"), "row_id")
        grad = linalg.spmv_t(tri, m.select("row_id", L.Loss().dual(F.col("label"), F.col("margin")).alias("d")))
        state = trainers.checkpointed(U.push(state, grad, rule, k + 1))
    return state.select("index", *[r(c).alias(c) for c in rule.state])


@query(f"{EVENTS_SQL}, {_ZERO_GRAD} SELECT count_if({_prox('-g', '((abs(g) + 1) / 0.1E0)')} <> 0)::BIGINT AS nnz_w, 0::BIGINT AS nnz_v FROM g0")
def model_nnz(spark, sf_dir):
    return U.nnz(_first_push(spark, sf_dir, U.FTRL(), 12))


@query()
def sgd_fit(spark, sf_dir):
    rows = T.orders_rows(spark, sf_dir)
    n = rows.count()
    model, history = trainers.train_linear(rows, LearnConfig(algo="sgd", minibatch=n // 3 + 1, max_data_pass=1))
    return spark.createDataFrame([(h["pass"], h["train"]["n_rows"], h["train"]["logloss"], h["train"]["auc"]) for h in history], "pass int, n_rows long, logloss double, auc double").crossJoin(U.nnz(model.state))


@query(
    f"{_ftrl_ctes(3, _THIRD)}, fm AS (SELECT row_id, label, coalesce(sum(value * w), 0) AS margin FROM tr LEFT JOIN s3 USING (index) GROUP BY ALL) "
    f"SELECT row_id, label, {rs('margin', 5)} AS margin, {rs(_SIGMOID.format('margin'), 5)} AS prediction FROM fm"
)
def ftrl_fit_predict(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    model, _ = trainers.train_linear(rows, LearnConfig(minibatch=rows.count() // 3 + 1, max_data_pass=1))
    return model.transform(rows).select("row_id", "label", r("margin", 5).alias("margin"), r("prediction", 5).alias("prediction"))


# Ids of 2**63 and more are negative longs; the model's bias has no id.
_HIGH = "CASE WHEN index % 2 = 0 THEN index ELSE index - 9223372036854775807 - 1 END"


@query(
    f"{EVENTS_SQL}, hi AS (SELECT row_id, label, value, {_HIGH} AS index FROM tr), hm AS (SELECT row_id, label, sum(value * {weight_sql('index')}) + 0.25E0 AS margin FROM hi GROUP BY ALL) "
    f"SELECT row_id, label, {rs('margin')} AS margin, {rs(_SIGMOID.format('margin'))} AS prediction FROM hm"
)
def batch_predict(spark, sf_dir):
    def high(f):
        return F.struct(F.when(f["index"] % 2 == 0, f["index"]).otherwise(f["index"].bitwiseXOR(F.lit(-(1 << 63)))).alias("index"), f["value"].alias("value"))

    rows = T.events_rows(spark, sf_dir).withColumn("features", F.transform("features", high))
    model, path = T.hash_model(frame.triplets(rows)), files.scratch(spark, "model")
    model.unionByName(spark.createDataFrame([(None, 0.25)], "index long, w double")).write.parquet(path)
    out = apps.predicted(rows, spark.read.parquet(path))
    return out.select("row_id", "label", r("margin").alias("margin"), r("prediction").alias("prediction"))


@query()
def ftrl_fit_local(spark, sf_dir):
    return trainers.train_linear_local(T.events_rows(spark, sf_dir), LearnConfig()).state


# --- k-means ----------------------------------------------------------------------------------


def _seeds(vectors):
    """The lowest row of each label, at unit length, numbered by label."""
    first = vectors.groupBy("label").agg(F.min_by("x", "row_id").alias("x"))
    return first.select(F.col("label").cast("int").alias("cluster"), L.unit(F.col("x")).alias("centroid"))


def _kmeans_sql(rounds: int) -> str:
    out = [
        "WITH v0 AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE * (1 + vec_id % 3)) AS x FROM embeddings)",
        "v AS (SELECT *, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS n FROM v0)",
        "c0 AS (SELECT label AS cluster, list_transform(x, lambda e: e / n) AS c FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM v) WHERE k = 1)",
    ]
    for k in range(rounds + 1):
        out.append(f"a{k} AS (SELECT vec_id, x, cluster, s FROM (SELECT vec_id, x, cluster, round(list_inner_product(x, c) / n, 12) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(x, c) / n, 12) DESC, cluster) AS o FROM v, c{k}) WHERE o = 1)")
        if k < rounds:
            out += [
                f"e{k} AS (SELECT cluster, i, avg(e) AS e FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL)",
                f"l{k} AS (SELECT cluster, list(e ORDER BY i) AS m FROM e{k} GROUP BY cluster)",
                f"c{k + 1} AS (SELECT cluster, list_transform(m, lambda e: e / q) AS c FROM (SELECT *, sqrt(list_sum(list_transform(m, lambda e: e * e))) AS q FROM l{k}))",
            ]
    return ",\n".join(out)


@query(f"{_kmeans_sql(0)} SELECT vec_id AS row_id, cluster::INT AS cluster, {rs('s')} AS score FROM a0")
def kmeans_assign(spark, sf_dir):
    v = T.vectors(spark, sf_dir, scaled=True)
    return clustering.assign(v, _seeds(v), 12).select("row_id", "cluster", r("score").alias("score"))


@query(f"{_kmeans_sql(2)} SELECT cluster::INT AS cluster, i::INT AS k, {rs('e')} AS v FROM (SELECT cluster, unnest(c) AS e, unnest(range(0, len(c))) AS i FROM c2)")
def kmeans_iterations(spark, sf_dir):
    v = T.vectors(spark, sf_dir, scaled=True).persist()
    c = _seeds(v)
    for _ in range(2):
        c = trainers.checkpointed(clustering.update(clustering.assign(v, c, 12), c))
    return c.select("cluster", F.posexplode("centroid").alias("k", "e")).select("cluster", "k", r("e").alias("v"))


_FAR = "CASE WHEN i % 2 = 0 THEN (i * 1099511627776)::HUGEINT ELSE i::HUGEINT + 9223372036854775808 END"


@query(f"{_kmeans_sql(2)} SELECT cluster::INT AS cluster, ({_FAR})::VARCHAR AS feature, {rs('e')} AS w FROM (SELECT cluster, unnest(c) AS e, unnest(range(0, len(c))) AS i FROM c2)")
def kmeans_sparse(spark, sf_dir):
    """Two rounds on sparse rows whose ids are multiples of 2**40, or 2**63 and more."""
    far = lambda i: F.when(i % 2 == 0, i.cast("long") * (1 << 40)).otherwise(i.cast("long").bitwiseXOR(F.lit(-(1 << 63))))
    v = T.vectors(spark, sf_dir, scaled=True)
    rows = v.select("row_id", F.lit(0.0).alias("label"), F.lit(1.0).alias("weight"), F.transform("x", lambda x, i: F.struct(far(i).alias("index"), x.alias("value"))).alias("features"))
    init = _seeds(v).select("cluster", F.posexplode("centroid").alias("i", "w")).select("cluster", far(F.col("i")).alias("index"), "w")
    k = v.agg(F.max("label")).first()[0] + 1
    c = clustering.fit_sparse(rows, k, 2, init=init)
    return c.select("cluster", H.unsigned_text(F.col("index")).alias("feature"), r("w").alias("w"))


@query()
def kmeans_fit(spark, sf_dir):
    c = clustering.fit(T.vectors(spark, sf_dir), 8, 3, seed=5, empty="keep")
    return c.select("cluster", F.size("centroid").alias("dim"), L.dot(F.col("centroid"), F.col("centroid")).alias("square"))


# --- batch objectives ---------------------------------------------------------------------------

_NLL = f"(label * {_SOFTPLUS.format('-margin')} + (1 - label) * {_SOFTPLUS.format('margin')})"


def _linear_objective(spark, sf_dir):
    """The solver's objective on orders, the ids of its coordinates, and the hash weights with a bias of 0."""
    target = trainers.LinearObjective(T.orders_rows(spark, sf_dir), l2=0.1)
    at = target.dictionary.select("local_id", "index", T.hash_weight(F.col("index")).alias("w")).toArrow().sort_by("local_id")  # one row a coordinate
    return target, at["index"], np.append(at["w"].to_numpy(), 0.0)


def _by_index(spark, ids, x, name):
    return spark.createDataFrame(pa.table({"index": ids, name: x}))


@query(f"{ORDERS_SQL}, mw AS (SELECT DISTINCT index, {weight_sql('index')} AS w FROM tr) SELECT {rs(f'(SELECT sum({_NLL}) FROM mg) + 0.5E0 * 0.1E0 * (SELECT sum(w * w) FROM mw)', 4)} AS smooth, {rs('0.3E0 * (SELECT sum(abs(w)) FROM mw)', 4)} AS l1 ")
def lbfgs_objective(spark, sf_dir):
    target, _, w = _linear_objective(spark, sf_dir)
    return spark.createDataFrame([(target.value(w), LBFGS(l1=0.3).total(0.0, w))], "smooth double, l1 double").select(r("smooth", 4).alias("smooth"), r("l1", 4).alias("l1"))


_LIN_GRAD = f"""{ORDERS_SQL}, dg AS (SELECT row_id, {_SIGMOID.format('margin')} - label AS d FROM mg),
gr AS (SELECT index, sum(value * d) + 0.1E0 * {weight_sql('index')} AS g, {weight_sql('index')} AS w FROM tr JOIN dg USING (row_id) GROUP BY index)"""


@query(f"{_LIN_GRAD} SELECT index, {rs('g', 5)} AS g FROM gr")
def lbfgs_gradient(spark, sf_dir):
    target, ids, w = _linear_objective(spark, sf_dir)
    return _by_index(spark, ids, target.value_and_grad(w)[1][:-1], "g").select("index", r("g", 5).alias("g"))


@query(f"{_LIN_GRAD} SELECT index, {rs('CASE WHEN w > 0 THEN -g - 0.3E0 WHEN w < 0 THEN -g + 0.3E0 WHEN g < -0.3E0 THEN -g - 0.3E0 WHEN g > 0.3E0 THEN -g + 0.3E0 ELSE 0.0E0 END', 5)} AS steepest FROM gr")
def owlqn_pseudo_gradient(spark, sf_dir):
    target, ids, w = _linear_objective(spark, sf_dir)
    steepest = pseudo_gradient(w, target.value_and_grad(w)[1], 0.3)
    return _by_index(spark, ids, steepest[:-1], "steepest").select("index", r("steepest", 5).alias("steepest"))


@query()
def lbfgs_fit(spark, sf_dir):
    model, solver, _ = trainers.train_linear_lbfgs(T.events_rows(spark, sf_dir), LBFGS(max_iter=4, l1=0.5), l2=1.0)
    trace = spark.createDataFrame([(k, v) for k, v in enumerate(solver.trace)], "iteration int, objective double")
    return trace.crossJoin(model.agg(F.count_if(F.col("w") != 0).alias("nnz")))


# --- factorization machines ----------------------------------------------------------------------

_FM = f"""{EVENTS_SQL}, {_LONG}, pr AS (SELECT row_id, k, sum(value * v) AS xv, sum(pow(value * v, 2)) AS xv2 FROM tr JOIN mv USING (index) GROUP BY ALL),
sc AS (SELECT row_id, label, margin + q AS m FROM mg JOIN (SELECT row_id, 0.5E0 * sum(xv * xv - xv2) AS q FROM pr GROUP BY row_id) USING (row_id)),
du AS (SELECT row_id, -{_Y} / (1 + exp({_Y} * m)) AS d FROM sc)"""


def _fm(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    tri = frame.triplets(rows)
    model = T.hash_model(tri, 4)
    return model, factorization.with_margin(rows, tri, model, 4)


def _fm_gradient(spark, sf_dir):
    """The model with the gradient of its features."""
    model, scored = _fm(spark, sf_dir)
    duals = scored.withColumn("d", L.Loss().dual(F.col("label"), F.col("margin")))
    return model, factorization.gradient(duals, model, 4)


@query(f"{_FM} SELECT row_id, {rs('m')} AS margin FROM sc")
def fm_score(spark, sf_dir):
    return _fm(spark, sf_dir)[-1].select("row_id", r("margin").alias("margin"))


@query(f"{_FM} SELECT index, k::INT AS k, {rs('sum(d * value * (xv - value * v))')} AS gv FROM tr JOIN mv USING (index) JOIN du USING (row_id) JOIN pr USING (row_id, k) GROUP BY index, k")
def fm_gradient(spark, sf_dir):
    return _fm_gradient(spark, sf_dir)[1].select("index", F.posexplode("gv").alias("k", "gv")).withColumn("gv", r("gv"))


@query(f"{_FM}, ms AS (SELECT sum(w * w) AS w2 FROM (SELECT DISTINCT index, {weight_sql('index')} AS w FROM tr)) SELECT {rs(f'(SELECT sum({_SOFTPLUS.format("-" + _Y + " * m")}) FROM sc) + 0.05E0 * (SELECT w2 FROM ms) + 0.1E0 * (SELECT sum(v * v) FROM mv)', 4)} AS objective")
def fm_objective(spark, sf_dir):
    model, scored = _fm(spark, sf_dir)
    return factorization.objective(scored, model, 0.1, 0.2).select(r("objective", 4).alias("objective"))


@query(f"""{EVENTS_SQL}, ct AS (SELECT index, count(*) AS cnt, {weight_sql('index')} AS w FROM tr GROUP BY index)
SELECT index, cnt, (cnt > 100 AND w <> 0) AS active, CASE WHEN cnt > 100 AND w <> 0 THEN {rs("(" + md5_sql("index::VARCHAR || ':0' || '#1'") + " % 1000003 / 1000003.0E0 * 2 - 1) * 0.01E0", 9)} END AS v0 FROM ct""")
def fm_activation(spark, sf_dir):
    tri = T.events_triplets(spark, sf_dir)
    s = frame.unique_index(tri).withColumn("w", T.hash_weight(F.col("index")))
    on = U.activate(F.col("count"), F.col("w"), F.lit(None).cast("array<double>"), 100, True)
    v = F.when(on, U.fresh_embedding(F.col("index"), 2, 0.01, 1))
    return s.select("index", F.col("count").alias("cnt"), on.alias("active"), r(F.get(v, F.lit(0)), 9).alias("v0"))


@query(f"{EVENTS_SQL}, {_ZERO_GRAD} SELECT index, {rs(_prox('-g', '((abs(g) + 1) / 0.01E0)'))} AS w, {rs('-g')} AS z, {rs('abs(g)')} AS n FROM g0")
def fm_online_w_step(spark, sf_dir):
    return _first_push(spark, sf_dir, U.FMLinear(alpha=0.01))


@query(f"""{_FM}, gv AS (SELECT index, k, sum(d * value * (xv - value * v)) + 0.1E0 * any_value(v) AS g, any_value(v) AS v FROM tr JOIN mv USING (index) JOIN du USING (row_id) JOIN pr USING (row_id, k) GROUP BY index, k)
SELECT index, k::INT AS k, {rs('v - 0.05E0 / (abs(g) + 1) * g')} AS v, {rs('abs(g)')} AS n FROM gv""")
def fm_online_v_step(spark, sf_dir):
    model, grad = _fm_gradient(spark, sf_dir)
    both = model.join(grad.select("index", F.col("gv").alias("g")), "index").withColumn("n", F.transform("v", lambda x: F.lit(0.0)))
    v, n = U.embedding_step(F.col("v"), F.col("n"), F.col("g"), 0.05, 1.0, 0.1)
    long = both.select("index", v.alias("v2"), n.alias("n2")).select("index", F.posexplode(F.arrays_zip("v2", "n2")).alias("k", "x"))
    return long.select("index", "k", r("x.v2").alias("v"), r("x.n2").alias("n"))


@query()
def fm_online_fit(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    conf = LearnConfig(minibatch=rows.count() // 2 + 1, max_data_pass=1, lambda_l1=0.1, lr_eta=0.1, embedding=Embedding(dim=2, threshold=10))
    model, history = trainers.train_factorization(rows, conf)
    return U.nnz(model.state).withColumn("logloss", F.lit(history[-1]["train"]["logloss"]))


@query()
def fm_lbfgs_fit(spark, sf_dir):
    _, bias, solver = trainers.train_factorization_lbfgs(T.events_rows(spark, sf_dir), LBFGS(max_iter=2), factors=2, l2=1.0, l2_v=1.0)
    return spark.createDataFrame([(k, v, bias) for k, v in enumerate(solver.trace)], "iteration int, objective double, bias double")


@query(f"{EVENTS_SQL}, {_LONG} SELECT index, {rs(weight_sql('index'))} AS w, {rs('sum(v)')} AS v_sum FROM mv GROUP BY index")
def fm_dump(spark, sf_dir):
    path = files.scratch(spark, "dump")
    model = T.hash_model(T.events_triplets(spark, sf_dir), 4)
    factorization.dump(model, 0.25).write.text(path)
    t = F.split("value", "\t")
    back = spark.read.text(path).filter(~F.startswith(F.col("value"), F.lit("bias")))
    v = F.aggregate(F.transform(F.slice(t, 3, 100), lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return back.select(F.get(t, F.lit(0)).cast("long").alias("index"), r(F.get(t, F.lit(1)).cast("double")).alias("w"), r(v).alias("v_sum"))


# --- formats ---------------------------------------------------------------------------------------

_READ_SQL = "SELECT count(*) AS n, sum(label) AS label_sum, sum(len(f))::BIGINT AS nnz, " + rs("sum(list_sum(list_transform(f, lambda x: x.value)))", 4) + " AS value_sum, sum(list_sum(list_transform(f, lambda x: x.index % 1000003)))::BIGINT AS index_sum FROM er"


def _read_back(rows):
    entries = rows.select("label", F.posexplode_outer("features").alias("at", "f"))
    first = F.coalesce("at", F.lit(0)) == 0  # a row's first entry, or the one that stands for a row without any
    value, index = F.sum("f.value"), F.sum(F.col("f.index") % 1000003)
    return entries.agg(F.count(F.when(first, 1)).alias("n"), F.sum(F.when(first, F.col("label"))).alias("label_sum"), F.sum(F.col("at").isNotNull().cast("long")).alias("nnz"), r(value, 4).alias("value_sum"), index.alias("index_sum"))


@query(f"{EVENTS_SQL} {_READ_SQL}")
def format_libsvm_roundtrip(spark, sf_dir):
    path = files.scratch(spark, "libsvm")
    formats.write_format(T.events_rows(spark, sf_dir), path, "libsvm")
    return _read_back(formats.read_format(spark, path, "libsvm"))


@query(f"{ORDERS_SQL} {_READ_SQL}")
def convert_rows(spark, sf_dir):
    text, packed, again = (files.scratch(spark, n) for n in ("libsvm", "crb", "libsvm"))
    formats.write_format(T.orders_rows(spark, sf_dir), text, "libsvm")
    formats.convert(spark, text, "libsvm", packed, "crb", max_records=5000)
    formats.convert(spark, packed, "crb", again, "libsvm")
    return _read_back(formats.read_format(spark, again, "libsvm"))


_CLICK_FIELDS = [("l_quantity::INT::VARCHAR", 0), ("l_linenumber::VARCHAR", 1), ("lpad(l_suppkey::VARCHAR, 8, '0')", 13), ("lpad(l_partkey::VARCHAR, 8, 'x')", 14)]


@query(f"WITH er AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0E0 ELSE 0.0E0 END AS label, [{', '.join(f'struct_pack(index := {key_sql(x, k)}, value := 1.0E0)' for x, k in _CLICK_FIELDS)}] AS f FROM lineitem) {_READ_SQL}")
def format_criteo(spark, sf_dir):
    li, path = table(spark, sf_dir, "lineitem"), files.scratch(spark, "clicks")
    ints = [F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), *[F.lit("")] * 11]
    cats = [F.lpad(F.col("l_suppkey").cast("string"), 8, "0"), F.lpad(F.col("l_partkey").cast("string"), 8, "x"), *[F.lit("")] * 24]
    li.select(F.concat_ws("\t", F.when(F.col("l_returnflag") == "R", "1").otherwise("0"), *ints, *cats).alias("value")).write.text(path)
    return _read_back(formats.parse_clicks(spark.read.text(path), portable=True))


_WRAP = "(({0}) % 18446744073709551616::UHUGEINT)"


def _city_sql(x: str) -> str:
    """The hash of strings of eight bytes, from their little-endian number, in 128-bit numbers cut to 64 bits."""
    k2, mul = "11160318154034397263::UHUGEINT", "(11160318154034397263 + 16)::UHUGEINT"
    turned = lambda v, k: f"(({v} // {2**k}::UHUGEINT) + {_WRAP.format(f'{v} * {2 ** (64 - k)}::UHUGEINT')})"
    xor = lambda a, b: f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"
    folded = lambda v: xor(v, f"{v} // {2**47}::UHUGEINT")
    number = "('0x' || " + " || ".join(f"substr(hx, {2 * k + 1}, 2)" for k in range(7, -1, -1)) + ")::UBIGINT::UHUGEINT"
    return f"""c0 AS (SELECT *, hex(encode({x})) AS hx FROM src), c1 AS (SELECT *, {number} AS b FROM c0), c2 AS (SELECT *, {_WRAP.format(f'b + {k2}')} AS a FROM c1),
c3 AS (SELECT *, {_WRAP.format(f"{_WRAP.format(turned('b', 37) + f' * {mul}')} + a")} AS u, {_WRAP.format(f"{_WRAP.format(turned('a', 25) + ' + b')} * {mul}")} AS v FROM c2),
c4 AS (SELECT *, {_WRAP.format(f"{xor('u', 'v')} * {mul}")} AS p FROM c3), c5 AS (SELECT *, {_WRAP.format(f"{xor('v', folded('p'))} * {mul}")} AS q FROM c4),
c6 AS (SELECT *, {_WRAP.format(f"{folded('q')} * {mul}")} AS h FROM c5)"""


@query(f"WITH src AS (SELECT l_returnflag, lpad(l_partkey::VARCHAR, 8, 'x') AS x FROM lineitem), {_city_sql('x')} SELECT x, (l_returnflag = 'R')::INT::DOUBLE AS label, ((h // 1024) + 14 * 18014398509481984::UHUGEINT)::BIGINT AS key, count(*) AS n FROM c6 GROUP BY ALL")
def format_criteo_city(spark, sf_dir):
    """Clicks with one category, keyed as the original tools key them."""
    path, part = files.scratch(spark, "clicks"), F.lpad(F.col("l_partkey").cast("string"), 8, "x")
    line = F.concat(F.when(F.col("l_returnflag") == "R", "1").otherwise("0"), F.lit("\t" * 15), part, F.lit("\t" * 24))
    table(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(path)
    lines = spark.read.text(path)
    rows = formats.parse_clicks(lines, city=True)
    x = F.substring_index(F.substring_index("value", "\t", 16), "\t", -1).alias("x")
    names = lines.select(x).distinct().withColumn("key", H.field_key(F.get(city_hashes(F.array("x")), F.lit(0)), 14))
    return rows.select("label", F.explode("features.index").alias("key")).groupBy("label", "key").agg(F.count("*").alias("n")).join(names, "key")


@query("WITH er AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 1.0E0 ELSE 0.0E0 END AS label, [struct_pack(index := ((o_custkey * 1048576) >> 10) | (1::BIGINT << 54), value := 1.0E0), struct_pack(index := ((o_orderkey * 4096) >> 10) | (7::BIGINT << 54), value := 1.0E0)] AS f FROM orders) " + _READ_SQL)
def format_adfea(spark, sf_dir):
    o, path = table(spark, sf_dir, "orders"), files.scratch(spark, "grouped")
    line = F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.lit("2"), F.when(F.col("o_orderstatus") == "P", "1").otherwise("0"), F.concat((F.col("o_custkey") * 1048576).cast("string"), F.lit(":1")), F.concat((F.col("o_orderkey") * 4096).cast("string"), F.lit(":7")))
    o.select(line.alias("value")).write.text(path)
    return _read_back(formats.read_format(spark, path, "adfea"))


# --- streaming and trees ---------------------------------------------------------------------------


@query()
def online_ftrl_stream(spark, sf_dir):
    return online.learn_stream(online.file_stream(spark, T.events_rows(spark, sf_dir), 3, "events"))


@query()
def keyed_ftrl_stream(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    grads = rows.select(F.explode("features").alias("f"), F.col("row_id").alias("row_id"), "label").select("row_id", F.col("f.index").alias("index"), F.col("row_id").alias("at"), (F.col("f.value") * L.Loss().dual(F.col("label"), F.lit(0.0))).alias("g"))
    return online.drained(online.keyed_ftrl(online.file_stream(spark, grads, 2, "grads").select("index", "at", "g")), "keyed")


@query(f"{_ftrl_ctes(2, '((SELECT count(*) FROM events) // 2 + 1)').replace('sum(value * coalesce(w, 0)) AS margin', '0.0E0 * count(*) AS margin')} SELECT index, {rs('w')} AS w, {rs('z')} AS z, {rs('n')} AS n FROM s2")
def keyed_push_stream(spark, sf_dir):
    """Gradients at zero weights arrive in two halves; each is one push into state keyed by feature range."""
    rows = T.events_rows(spark, sf_dir)
    grads = rows.select("row_id", F.explode("features").alias("f"), L.Loss().dual(F.col("label"), F.lit(0.0)).alias("d")).select("row_id", F.col("f.index").alias("index"), (F.col("f.value") * F.col("d")).alias("g"))
    halves = frame.minibatches(rows.select("row_id"), rows.count() // 2 + 1)
    path, home = files.scratch(spark, "gradients"), files.scratch(spark, "pushes")
    for k in range(2):
        grads.join(halves.filter(F.col("batch_id") == k), "row_id").select("index", "g").write.mode("append").parquet(path)
        out = online.drained(online.keyed_push(spark.readStream.schema("index long, g double").parquet(path)), "pushes", home)
    last = out.groupBy("index").agg(F.max_by(F.struct("w", "z", "n"), "batch").alias("s"))
    return last.select("index", *[r(f"s.{c}").alias(c) for c in ("w", "z", "n")])


@query()
def gbt_wrapper(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("label"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    model = trainers.train_boosted_trees(li, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], maxIter=3, maxDepth=3, seed=1)
    return model.transform(li).groupBy("label", "prediction").agg(F.count("*").alias("n"))


# --- whole fits, unrolled ----------------------------------------------------------------------------


def _fit_ctes(source: str, size: str, batches: int, passes: int, columns: tuple[str, ...], step) -> str:
    """Unrolled passes over minibatches: m<k> are the margins of step k, s<k> the state before it; ``step(t)`` has the columns' SQL."""
    out = [
        f"{source}, nb AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // {size} AS b FROM er)",
        f"s0 AS (SELECT 0::BIGINT AS index, {', '.join(f'0.0E0 AS {c}' for c in columns)} WHERE false)",
    ]
    for k in range(batches * passes):
        old = ", ".join(f"coalesce({c}, 0) AS {c}" for c in columns)
        new = ", ".join(f"CASE WHEN g IS NULL THEN {c} ELSE {sql} END AS {c}" for c, sql in step(k + 1).items())
        out += [
            f"t{k} AS (SELECT tr.* FROM tr JOIN nb USING (row_id) WHERE b = {k % batches})",
            f"m{k} AS (SELECT row_id, label, sum(value * coalesce(w, 0)) AS margin FROM t{k} LEFT JOIN s{k} USING (index) GROUP BY ALL)",
            f"d{k} AS (SELECT row_id, -{_Y} / (1 + exp({_Y} * margin)) AS d FROM m{k})",
            f"h{k} AS (SELECT index, sum(value * d) AS g FROM t{k} JOIN d{k} USING (row_id) GROUP BY index)",
            f"j{k} AS (SELECT index, g, {old} FROM s{k} FULL JOIN h{k} USING (index))",
            f"s{k + 1} AS (SELECT index, {new} FROM j{k})",
        ]
    return ",\n".join(out)


def _sgd_sql(t: int) -> dict[str, str]:
    eta = f"{(1 + t**0.5) / 0.1!r}::DOUBLE"
    return {"w": _prox(f"{eta} * w - g", eta)}


def _adagrad_sql(t: int) -> dict[str, str]:
    n = "sqrt(n * n + g * g)"
    eta = f"(({n} + 1) / 0.1E0)"
    return {"w": _prox(f"{eta} * w - g", eta), "n": n}


_HALF = "((SELECT count(*) FROM events) // 2 + 1)"


@query(f"{_fit_ctes(EVENTS_SQL, _THIRD, 3, 1, ('w',), _sgd_sql)} SELECT index, {rs('w')} AS w FROM s3")
def sgd_fit_weights(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    model, _ = trainers.train_linear(rows, LearnConfig(algo="sgd", minibatch=rows.count() // 3 + 1, max_data_pass=1))
    return model.state.select("index", r("w").alias("w"))


@query(f"{_fit_ctes(EVENTS_SQL, _HALF, 2, 2, ('w', 'n'), _adagrad_sql)} SELECT index, {rs('w')} AS w, {rs('n')} AS n FROM s4")
def adagrad_fit_weights(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    model, _ = trainers.train_linear(rows, LearnConfig(algo="adagrad", minibatch=rows.count() // 2 + 1, max_data_pass=2))
    return model.state.select("index", r("w").alias("w"), r("n").alias("n"))


def _delayed_ctes(batches: int, size: str) -> str:
    """FTRL whose gradients lag by one push: s<k> is the state before the push of batch k, margins are taken under s<k - 1>."""
    out = _ftrl_ctes(batches, size)
    for k in range(1, batches):
        out = out.replace(f"FROM t{k} LEFT JOIN s{k} USING", f"FROM t{k} LEFT JOIN s{k - 1} USING")
    return out


@query(f"{_delayed_ctes(4, '((SELECT count(*) FROM events) // 4 + 1)')} SELECT index, {rs('w')} AS w, {rs('z')} AS z, {rs('n')} AS n FROM s4")
def ftrl_delayed(spark, sf_dir):
    """Two minibatches under way at once: each gradient is taken before the push of the minibatch before."""
    rows = T.events_rows(spark, sf_dir)
    model, _ = trainers.train_linear(rows, LearnConfig(minibatch=rows.count() // 4 + 1, max_data_pass=1), delay=1)
    return model.state.select("index", *[r(c).alias(c) for c in ("w", "z", "n")])


_LOSS_OF = f"avg({_SOFTPLUS.format('-' + _Y + ' * margin')})"


@query(
    f"{_fit_ctes(EVENTS_SQL, _HALF, 2, 2, ('w', 'n'), _adagrad_sql)}, "
    + ", ".join(f"v{p} AS (SELECT row_id, label, sum(value * coalesce(w, 0)) AS margin FROM tr LEFT JOIN s{2 * p + 2} USING (index) GROUP BY ALL)" for p in range(2))
    + " "
    + " UNION ALL ".join(
        f"SELECT {p}::INT AS pass, (SELECT count(*) FROM v{p}) AS n_rows, (SELECT {rs(_LOSS_OF)} FROM (FROM m{2 * p} UNION ALL FROM m{2 * p + 1})) AS logloss, (SELECT {rs(_LOSS_OF)} FROM v{p}) AS held_logloss" for p in range(2)
    )
)
def fit_history(spark, sf_dir):
    """Progress of each pass: of its minibatches as they were met, and of a held table after it."""
    rows = T.events_rows(spark, sf_dir)
    _, history = trainers.train_linear(rows, LearnConfig(algo="adagrad", minibatch=rows.count() // 2 + 1, max_data_pass=2), validation=rows)
    got = [(h["pass"], h["train"]["n_rows"], h["train"]["logloss"], h["validation"]["logloss"]) for h in history]  # one row a pass
    return spark.createDataFrame(got, "pass int, n_rows long, logloss double, held_logloss double").select("pass", "n_rows", r("logloss").alias("logloss"), r("held_logloss").alias("held_logloss"))


@query(f"{_ftrl_ctes(2, _HALF)} SELECT index, {rs('w')} AS w, {rs('z')} AS z, {rs('n')} AS n FROM s2")
def online_ftrl_resumed(spark, sf_dir):
    """A stream whose second half arrives after the learner has stopped; it goes on from its saved state."""
    rows = T.events_rows(spark, sf_dir)
    halves = frame.minibatches(rows, rows.count() // 2 + 1).persist()
    path, home = files.scratch(spark, "arrivals"), files.scratch(spark, "online")
    for k in range(2):
        halves.filter(F.col("batch_id") == k).drop("batch_id").write.mode("append").parquet(path)
        state = online.learn_stream(spark.readStream.schema(rows.schema).parquet(path), home=home)
    return state.select("index", *[r(c).alias(c) for c in ("w", "z", "n")])


def _fm_fit_ctes(batches: int, size: str, threshold: int, alpha: str = "0.1E0", l1: str = "0.1E0") -> str:
    """Unrolled online factorization machine of two factors; embeddings appear where a feature is frequent and its weight not 0."""
    fresh = {k: f"(({md5_sql(f'''index::VARCHAR || ':{k}' || '#1'''+chr(39))} % 1000003 / 1000003.0E0 * 2 - 1) * 0.01E0)" for k in range(2)}
    none = "NULL::DOUBLE"

    def activated(when: str) -> str:
        on = f"({when}) AND v0 IS NULL AND cnt > {threshold} AND w <> 0"
        return ", ".join([*[f"CASE WHEN {on} THEN {fresh[k]} ELSE v{k} END AS v{k}" for k in range(2)], *[f"CASE WHEN {on} THEN 0.0E0 ELSE e{k} END AS e{k}" for k in range(2)]])

    out = [
        f"{EVENTS_SQL}, nb AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // {size} AS b FROM er)",
        f"s0 AS (SELECT 0::BIGINT AS index, 0::BIGINT AS cnt, 0.0E0 AS w, 0.0E0 AS z, 0.0E0 AS n, {none} AS v0, {none} AS v1, {none} AS e0, {none} AS e1 WHERE false)",
    ]
    for k in range(batches):
        turned = "sqrt(n * n + g * g)"
        new_z = f"(z - (g - ({turned} - n) / {alpha} * w))"
        full = "sqrt(e{0} * e{0} + q{0} * q{0})"
        out += [
            f"t{k} AS (SELECT tr.* FROM tr JOIN nb USING (row_id) WHERE b = {k})",
            f"c{k} AS (SELECT index, count(*) AS c FROM t{k} GROUP BY index)",
            f"a{k} AS (SELECT index, coalesce(cnt, 0) + coalesce(c, 0) AS cnt, coalesce(w, 0) AS w, coalesce(z, 0) AS z, coalesce(n, 0) AS n, v0, v1, e0, e1, c IS NOT NULL AS here FROM s{k} FULL JOIN c{k} USING (index))",
            f"b{k} AS (SELECT index, cnt, w, z, n, here, {activated('here')} FROM a{k})",
            f"o{k} AS (SELECT index, w, CASE WHEN w <> 0 THEN v0 END AS v0, CASE WHEN w <> 0 THEN v1 END AS v1 FROM b{k} WHERE here)",
            f"p{k} AS (SELECT row_id, label, sum(value * w) AS y, coalesce(sum(value * v0), 0) AS x0, coalesce(sum(value * v1), 0) AS x1, coalesce(sum(pow(value * v0, 2) + pow(value * v1, 2)), 0) AS xx FROM t{k} JOIN o{k} USING (index) GROUP BY ALL)",
            f"m{k} AS (SELECT *, y + 0.5E0 * (x0 * x0 + x1 * x1 - xx) AS margin FROM p{k})",
            f"d{k} AS (SELECT row_id, x0, x1, -{_Y} / (1 + exp({_Y} * margin)) AS d FROM m{k})",
            f"h{k} AS (SELECT index, sum(value * d) AS g, sum(value * d * x0) AS r0, sum(value * d * x1) AS r1, sum(value * value * d) AS rr FROM t{k} JOIN d{k} USING (row_id) GROUP BY index)",
            f"i{k} AS (SELECT b{k}.*, g, CASE WHEN w <> 0 THEN r0 - v0 * rr END AS q0, CASE WHEN w <> 0 THEN r1 - v1 * rr END AS q1 FROM b{k} LEFT JOIN h{k} USING (index))",
            f"u{k} AS (SELECT index, cnt, w = 0 AS was, CASE WHEN g IS NULL THEN w ELSE {_prox(new_z, f'((1 + {turned}) / {alpha})', l1)} END AS w, CASE WHEN g IS NULL THEN z ELSE {new_z} END AS z, CASE WHEN g IS NULL THEN n ELSE {turned} END AS n, "
            + ", ".join(f"CASE WHEN q{f} IS NULL THEN v{f} ELSE v{f} - {alpha} / ({full.format(f)} + 1) * q{f} END AS v{f}, CASE WHEN q{f} IS NULL THEN e{f} ELSE {full.format(f)} END AS e{f}" for f in range(2))
            + f" FROM i{k})",
            f"s{k + 1} AS (SELECT index, cnt, w, z, n, {activated('was')} FROM u{k})",
        ]
    return ",\n".join(out)


@query(f"{_fm_fit_ctes(2, _HALF, 10)} SELECT index, cnt, {rs('w')} AS w, {rs('z')} AS z, {rs('n')} AS n, {rs('v0', 9)} AS v0, {rs('v1', 9)} AS v1 FROM s2")
def fm_online_fit_state(spark, sf_dir):
    rows = T.events_rows(spark, sf_dir)
    conf = LearnConfig(minibatch=rows.count() // 2 + 1, max_data_pass=1, lambda_l1=0.1, lr_eta=0.1, embedding=Embedding(dim=2, threshold=10))
    model, _ = trainers.train_factorization(rows, conf)
    v = [r(F.get("v", F.lit(k)), 9).alias(f"v{k}") for k in range(2)]
    return model.state.select("index", "cnt", *[r(c).alias(c) for c in ("w", "z", "n")], *v)


# The first step from zero weights: steepest descent, cut by tens until it lowers the objective enough.
_FIRST_STEP = f"""{EVENTS_SQL}, gz AS (SELECT index, sum(value * (0.5E0 - label)) AS g FROM tr GROUP BY index UNION ALL SELECT NULL, sum(0.5E0 - label) FROM er),
st AS (SELECT index, CASE WHEN g > 0.5E0 THEN 0.5E0 - g WHEN g < -0.5E0 THEN -0.5E0 - g ELSE 0.0E0 END AS s FROM gz),
q AS (SELECT sqrt(sum(s * s)) AS n, sum(abs(s)) AS a, sum(s * s) FILTER (WHERE index IS NOT NULL) AS r, max(s) FILTER (WHERE index IS NULL) AS b FROM st),
um AS (SELECT row_id, label, sum(value * s) + (SELECT b FROM q) AS u FROM tr JOIN st USING (index) GROUP BY row_id, label),
tj AS (SELECT j, pow(0.1E0, j) / n AS step FROM q, range(8) AS js(j)),
ob AS (SELECT j, step, sum(label * {_SOFTPLUS.format('-step * u')} + (1 - label) * {_SOFTPLUS.format('step * u')}) AS loss FROM um, tj GROUP BY j, step),
ok AS (SELECT step, loss + 0.5E0 * step * step * r + 0.5E0 * step * a AS objective FROM ob, q WHERE loss + 0.5E0 * step * step * r + 0.5E0 * step * a - (SELECT count(*) * ln(2) FROM er) <= -1e-4 * step * n * n ORDER BY j LIMIT 1)"""


@query(f"{_FIRST_STEP} SELECT coalesce(index::VARCHAR, 'bias') AS feature, {rs('step * s')} AS w, {rs('objective', 4)} AS objective FROM st, ok")
def lbfgs_first_step(spark, sf_dir):
    model, solver, _ = trainers.train_linear_lbfgs(T.events_rows(spark, sf_dir), LBFGS(max_iter=1, l1=0.5), l2=1.0)
    return model.select(F.coalesce(F.col("index").cast("string"), F.lit("bias")).alias("feature"), r("w").alias("w"), r(F.lit(solver.trace[-1]), 4).alias("objective"))


def _pseudo_sql(w: str, g: str, l1: str = "0.5E0") -> str:
    return f"CASE WHEN {w} > 0 THEN -{g} - {l1} WHEN {w} < 0 THEN {l1} - {g} WHEN {g} < -{l1} THEN -{g} - {l1} WHEN {g} > {l1} THEN {l1} - {g} ELSE 0.0E0 END"


def _armijo_sql(k: int, before: str, slope: str) -> str:
    """The first step whose objective falls enough; x<k> has the points (j, step, index, x), o<k> the chosen j, step and objective."""
    return f"""u{k} AS (SELECT j, row_id, label, sum(value * x) AS m FROM tb JOIN x{k} USING (index) GROUP BY ALL),
l{k} AS (SELECT j, sum(label * {_SOFTPLUS.format('-m')} + (1 - label) * {_SOFTPLUS.format('m')}) AS loss FROM u{k} GROUP BY j),
e{k} AS (SELECT j, any_value(step) AS step, sum(0.5E0 * abs(x) + CASE WHEN index >= 0 THEN 0.5E0 * x * x ELSE 0.0E0 END) AS pen FROM x{k} GROUP BY j),
o{k} AS (SELECT j, step, loss + pen AS objective FROM l{k} JOIN e{k} USING (j) WHERE loss + pen - {before} <= 1e-4 * step * {slope} ORDER BY j LIMIT 1)"""


# Two iterations with l1 = 0.5 and l2 = 1: the bias is the feature -1, of value 1 in every row.
_TWO_STEPS = f"""{EVENTS_SQL}, tb AS (SELECT row_id, label, index, value FROM tr UNION ALL SELECT row_id, label, -1, 1.0E0 FROM er),
g0 AS (SELECT index, sum(value * (0.5E0 - label)) AS g FROM tb GROUP BY index),
p0 AS (SELECT index, g, {_pseudo_sql('0.0E0', 'g')} AS p FROM g0),
n0 AS (SELECT sum(p * p) AS pp FROM p0),
x0 AS (SELECT j, pow(0.1E0, j) / sqrt(pp) AS step, index, pow(0.1E0, j) / sqrt(pp) * p AS x FROM p0, n0, range(8) AS js(j)),
{_armijo_sql(0, '(SELECT count(*) * ln(2) FROM er)', '-(SELECT pp FROM n0)')},
w1 AS (SELECT x0.index, x AS w, g AS g0 FROM x0 JOIN o0 USING (j) JOIN p0 ON p0.index = x0.index),
d1 AS (SELECT row_id, 1 / (1 + exp(-sum(value * w))) - any_value(label) AS d FROM tb JOIN w1 USING (index) GROUP BY row_id),
h1 AS (SELECT index, sum(value * d) AS h FROM tb JOIN d1 USING (row_id) GROUP BY index),
v1 AS (SELECT index, w, g0, h + CASE WHEN index >= 0 THEN w ELSE 0.0E0 END AS g FROM w1 JOIN h1 USING (index)),
p1 AS (SELECT index, w, w AS s, g - g0 AS y, {_pseudo_sql('w', 'g')} AS p FROM v1),
n1 AS (SELECT sum(s * p) / sum(s * y) AS a, sum(s * y) AS sy, sum(y * y) AS yy, sum(y * p) AS yp FROM p1),
r1 AS (SELECT index, w, p, sy / yy * (p - a * y) + s * (a - (yp - a * yy) / yy) AS d FROM p1, n1),
q1 AS (SELECT index, w, p, CASE WHEN d * p > 0 THEN d ELSE 0.0E0 END AS d FROM r1),
z1 AS (SELECT j, pow(0.5E0, j) AS step, index, w + pow(0.5E0, j) * d AS x, CASE WHEN w <> 0 THEN sign(w) ELSE sign(p) END AS side FROM q1, range(8) AS js(j)),
x1 AS (SELECT j, step, index, CASE WHEN x * side < 0 THEN 0.0E0 ELSE x END AS x FROM z1),
{_armijo_sql(1, '(SELECT objective FROM o0)', '-(SELECT sum(p * d) FROM q1)')}"""


@query(f"{_TWO_STEPS} SELECT CASE WHEN index < 0 THEN 'bias' ELSE index::VARCHAR END AS feature, {rs('x')} AS w, {rs('objective', 4)} AS objective FROM x1 JOIN o1 USING (j)")
def lbfgs_two_steps(spark, sf_dir):
    """Two iterations with vectors as tables; the second uses the history of the first."""
    model, solver, _ = trainers.train_linear_lbfgs(T.events_rows(spark, sf_dir), LBFGS(max_iter=2, l1=0.5), l2=1.0, tables=True)
    return model.select(F.coalesce(F.col("index").cast("string"), F.lit("bias")).alias("feature"), r("w").alias("w"), r(F.lit(solver.trace[-1]), 4).alias("objective"))


@query(f"{_LIN_GRAD}, sp AS (SELECT index, w, g, CASE WHEN w > 0 THEN -g - 0.3E0 WHEN w < 0 THEN -g + 0.3E0 WHEN g < -0.3E0 THEN -g - 0.3E0 WHEN g > 0.3E0 THEN -g + 0.3E0 ELSE 0.0E0 END AS s FROM gr), "
       f"dr AS (SELECT *, CASE WHEN -g * s > 0 THEN -g ELSE 0.0E0 END AS d FROM sp), nw AS (SELECT *, w + 0.1E0 * d AS x, CASE WHEN w <> 0 THEN sign(w) ELSE sign(s) END AS side FROM dr) "
       f"SELECT index, {rs('d', 5)} AS direction, {rs('CASE WHEN x * side < 0 THEN 0.0E0 ELSE x END', 5)} AS point FROM nw")  # fmt: skip
def owlqn_orthant(spark, sf_dir):
    """The plain direction without what points away from steepest descent, and a step along it within the orthant."""
    target, ids, w = _linear_objective(spark, sf_dir)
    grad = target.value_and_grad(w)[1]
    steepest = pseudo_gradient(w, grad, 0.3)
    direction = aligned(-grad, steepest, 0.3)
    point = in_orthant(w + 0.1 * direction, w, steepest, 0.3)
    both = spark.createDataFrame(pa.table({"index": ids, "direction": direction[:-1], "point": point[:-1]}))
    return both.select("index", r("direction", 5).alias("direction"), r("point", 5).alias("point"))


# --- models, sinks and shaping ---------------------------------------------------------------------------


@query(f"{EVENTS_SQL}, {_ZERO_GRAD}, md AS (SELECT index, {_prox('-g', '((abs(g) + 1) / 0.1E0)')} AS w FROM g0) SELECT index, {rs('w')} AS w FROM md WHERE w <> 0")
def model_file(spark, sf_dir):
    """A saved model of weights only, read back."""
    path = files.scratch(spark, "model")
    rows = T.events_rows(spark, sf_dir)
    grad = linalg.rows_t(rows.withColumn("d", L.Loss().dual(F.col("label"), F.lit(0.0))))
    trainers.LinearModel(U.push(trainers.empty_state(spark, U.FTRL()), grad, U.FTRL()), L.Loss()).save(path, 3, weights_only=True)
    return trainers.LinearModel.load(spark, path, 3).state.select("index", r("w").alias("w"))


@query(f"{EVENTS_SQL} SELECT {rs(_SIGMOID.format('margin'))} AS prediction, count(*) AS n FROM mg GROUP BY 1")
def prediction_file(spark, sf_dir):
    """Predictions written one a line and read back."""
    path = files.scratch(spark, "predictions")
    formats.write_predictions(T.margins(T.events_rows(spark, sf_dir)).withColumn("prediction", L.sigmoid(F.col("margin"))), path)
    return spark.read.text(path).groupBy(r(F.col("value").cast("double")).alias("prediction")).agg(F.count("*").alias("n"))


@query(f"{_kmeans_sql(1)} SELECT i::INT AS k, {rs('e')} AS v, count(*) AS n FROM (SELECT unnest(c) AS e, unnest(range(0, len(c))) AS i FROM c1) GROUP BY ALL")
def centroid_file(spark, sf_dir):
    """Centroids of one round, written as a text matrix and read back."""
    path, v = files.scratch(spark, "centroids"), T.vectors(spark, sf_dir, scaled=True)
    c = _seeds(v)
    formats.write_centroids(clustering.update(clustering.assign(v, c, 12), c), path)
    long = spark.read.text(path).select(F.posexplode(F.split("value", " ")).alias("k", "v"))
    return long.groupBy("k", r(F.col("v").cast("double")).alias("v")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS index, p_brand || '=' || p_size AS name, 'i' AS kind FROM part")
def feature_names(spark, sf_dir):
    path = files.scratch(spark, "names")
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.concat_ws("=", "p_brand", F.col("p_size").cast("string")), F.lit("i"))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return formats.read_feature_names(spark, path)


@query(f"{EVENTS_SQL} SELECT row_id, {rs('coalesce(sum(CASE WHEN index % 2 = 0 THEN value * ' + weight_sql('index') + ' END), 0)')} AS y FROM tr GROUP BY row_id")
def spmv_missing(spark, sf_dir):
    """A product with weights for half the features; the others count nothing."""
    rows = T.events_rows(spark, sf_dir)
    tri = frame.triplets(rows)
    return linalg.spmv(tri, T.hash_model(tri).filter("index % 2 = 0"), rows).select("row_id", r("y").alias("y"))


@query(f"{EVENTS_SQL}, {_ZERO_GRAD}, md AS (SELECT index, {_prox('-g', '((abs(g) + 1) / 0.1E0)')} AS w FROM g0) SELECT index, w <> 0 AS shown, CASE WHEN w <> 0 THEN {rs(weight_sql('index', 'v0:') + ' / 10')} END AS v0 FROM md")
def fm_visible(spark, sf_dir):
    """Embeddings as others see them: none where shrinking left a weight of 0."""
    state = _first_push(spark, sf_dir, U.FTRL(), 12).join(T.hash_model(T.events_triplets(spark, sf_dir), 4).select("index", "v"), "index")
    v = U.visible_embedding(F.col("w"), F.col("v"), True)
    return state.select("index", v.isNotNull().alias("shown"), r(F.get(v, F.lit(0))).alias("v0"))


@query(f"SELECT l_suppkey, {rs('round(greatest(least(g, 0.2E0), -0.2E0) / 0.2E0 * 127) / 127 * 0.2E0')} AS g FROM ({_G})")
def grad_quantize(spark, sf_dir):
    return _supplier_gradients(spark, sf_dir).select("l_suppkey", r(L.quantize(F.col("g"), 1, 0.2)).alias("g"))


@query(f"SELECT vec_id AS row_id, {rs('list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * (embedding[i]::DOUBLE + 0.5E0 * embedding[len(embedding) + 1 - i]::DOUBLE)))')} AS y FROM embeddings")
def axpy_vectors(spark, sf_dir):
    """x + 0.5 y of each vector and its reverse, seen through a product with 1, 2, 3, ..."""
    got = L.axpy(F.col("x"), F.reverse("x"), 0.5)
    steps = F.transform("x", lambda v, i: (i + 1).cast("double"))
    return T.vectors(spark, sf_dir).select("row_id", r(L.dot(got, steps)).alias("y"))


@query(f"SELECT o_orderpriority, {rs('ln(p / (1 - p))')} AS margin FROM (SELECT o_orderpriority, avg((o_orderstatus = 'P')::INT) AS p FROM orders GROUP BY 1) WHERE p > 0 AND p < 1")
def base_margin(spark, sf_dir):
    """The margin that each priority's mean response starts from."""
    means = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "P").cast("int")).alias("p")).filter("p > 0 AND p < 1")
    got = [(m["o_orderpriority"], L.base_score_logit(m["p"])) for m in means.collect()]  # one row a priority
    return spark.createDataFrame(got, "o_orderpriority string, margin double").withColumn("margin", r("margin"))


def _unlabelled_clicks(k: int) -> tuple[str, str]:
    """SQL of field k's text, alike in both engines, and of whether it counts."""
    if k < formats.N_INTEGERS:
        return f"CASE WHEN (l_linenumber + {k}) % 3 = 0 THEN '' ELSE CAST((l_orderkey + {k}) % {k + 7} - 2 AS VARCHAR(20)) END", "x <> ''"
    return f"CASE WHEN (l_suppkey + {k}) % 4 = 0 THEN '' ELSE lpad(CAST((l_partkey * {k}) % 100003 AS VARCHAR(20)), {7 + (k % 5 > 0)}, 'x') END", "length(x) = 8"


_CLICK_TEXTS = [_unlabelled_clicks(k) for k in range(formats.N_INTEGERS + formats.N_CATEGORIES)]
_CLICK_ENTRIES = ", ".join(f"CASE WHEN {ok.replace('x', f'f{k}', 1)} THEN struct_pack(index := {key_sql(f'f{k}', k)}, value := 1.0E0) END" for k, (_, ok) in enumerate(_CLICK_TEXTS))


@query(f"WITH ft AS (SELECT {', '.join(f'{sql} AS f{k}' for k, (sql, _) in enumerate(_CLICK_TEXTS))} FROM lineitem), er AS (SELECT 0.0E0 AS label, list_filter([{_CLICK_ENTRIES}], lambda e: e IS NOT NULL) AS f FROM ft) {_READ_SQL}")
def format_criteo_test(spark, sf_dir):
    """Unlabelled clicks with all fields, some of them empty or of the wrong length."""
    path = files.scratch(spark, "clicks")
    texts = [F.expr(sql) for sql, _ in _CLICK_TEXTS]
    # The integers come from a lambda, as all fields in one generated method are too many for the JVM to compile it.
    some = lambda x: F.coalesce(x, F.lit(""))
    line = F.concat_ws("\t", F.transform(F.array(*texts[: formats.N_INTEGERS]), some), *map(some, texts[formats.N_INTEGERS :]))
    table(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(path)
    return _read_back(formats.parse_clicks(spark.read.text(path), labelled=False, portable=True))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed events, margins, and the merged metrics of minibatches."""
    return progress_merge(spark, sf_dir)


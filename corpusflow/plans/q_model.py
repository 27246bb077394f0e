"""Checked queries: losses, robustness statistics, scoring, metrics, ensembles, history
(SURVEY §2.7 T6, §2.8-§2.11) over the fixture scorer ``Q_SCORED``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.arrays import argmax, softmax
from corpusflow.operators import evaluate as E
from corpusflow.operators import history as H
from corpusflow.operators import robust as L
from corpusflow.operators.score import pseudo_label, score
from corpusflow.operators.split import assign_batches
from corpusflow.plans.fixtures import CORPUS_SQL, HISTORY_SQL, SCORED_SQL, corpus, history, scored, table
from corpusflow.plans.registry import query, with_ctes


def _h(seed, col):
    return f"md5(concat_ws(':', '{seed}', CAST({col} AS VARCHAR)))"


# per-row cross-entropy of logits [0, z] and [0, z2], and KL(p2 || p1)
_CE_SQL = """
ce0 AS (SELECT *, greatest(0.0, z) AS m1, greatest(0.0, z2) AS m2 FROM scored),
ce1 AS (SELECT *, ln(exp(0.0 - m1) + exp(z - m1)) + m1 AS lse1,
                  ln(exp(0.0 - m2) + exp(z2 - m2)) + m2 AS lse2 FROM ce0),
ce AS (SELECT *, lse1 - CASE WHEN label = 1 THEN z ELSE 0.0 END AS ce,
                 lse2 - CASE WHEN label = 1 THEN z2 ELSE 0.0 END AS ce_2,
                 exp(0.0 - lse2) * ((0.0 - lse2) - (0.0 - lse1)) + exp(z2 - lse2) * ((z2 - lse2) - (z - lse1)) AS kl,
                 CASE WHEN z > 0 THEN 1 ELSE 0 END AS pred FROM ce1)"""
_BASE = with_ctes(SCORED_SQL, _CE_SQL)


def scored_ce(spark, sf):
    s = scored(spark, sf)
    return L.row_cross_entropy(s).withColumn("pred", argmax("logits"))


@query("row_cross_entropy", _BASE + "SELECT doc_id, batch_id, domain, label, ce FROM ce")
def q_row_cross_entropy(spark, sf):
    return scored_ce(spark, sf).select("doc_id", "batch_id", "domain", "label", "ce")


@query("epoch_loss", _BASE + """
SELECT avg(bl) AS epoch_loss, count(*) AS n_batches FROM (SELECT batch_id, avg(ce) AS bl FROM ce GROUP BY batch_id)""")
def q_epoch_loss(spark, sf):
    return L.epoch_loss(scored_ce(spark, sf))


@query("rdrop_loss", _BASE + """
SELECT batch_id, avg(0.5 * (ce + ce_2) + 2.0 * kl) AS rdrop_loss, count(*) AS n FROM ce GROUP BY batch_id""")
def q_rdrop_loss(spark, sf):
    return L.rdrop_loss(scored(spark, sf), alpha=2.0)


@query("group_dro", _BASE + """
, g AS (SELECT batch_id, domain, sum(ce) AS s, count(*) AS n, exp(0.01 * sum(ce) / count(*)) AS e FROM ce GROUP BY ALL),
w AS (SELECT *, e / sum(e) OVER (PARTITION BY batch_id) AS w FROM g)
SELECT batch_id, sum(w * s) / sum(n) AS dro_loss, count(*) AS n_groups FROM w GROUP BY batch_id""")
def q_group_dro(spark, sf):
    return L.group_dro(scored_ce(spark, sf), eta=0.01)


@query("irm_penalty", _BASE + """
, g AS (SELECT batch_id, domain, avg(ce) AS m, count(*) AS n FROM ce GROUP BY ALL)
SELECT batch_id, CASE WHEN count(*) < 2 THEN 0.0
                      ELSE coalesce(avg(CASE WHEN n >= 2 THEN m * m END) * 1000.0, 0.0) END AS irm_penalty
FROM g GROUP BY batch_id""")
def q_irm_penalty(spark, sf):
    return L.irm_penalty(scored_ce(spark, sf), weight=1e3, mode="reference")


@query("irm_penalty_paper", _BASE + """
, r AS (SELECT *, (exp(0.0 - lse1) - CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) * 0.0
                 + (exp(z - lse1) - CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) * z AS gr FROM ce),
g AS (SELECT batch_id, domain, avg(gr) AS m, count(*) AS n FROM r GROUP BY ALL)
SELECT batch_id, CASE WHEN count(*) < 2 THEN 0.0
                      ELSE coalesce(avg(CASE WHEN n >= 2 THEN m * m END) * 1000.0, 0.0) END AS irm_penalty
FROM g GROUP BY batch_id""")
def q_irm_penalty_paper(spark, sf):
    return L.irm_penalty(scored_ce(spark, sf), weight=1e3, mode="paper")


@query("group_loss_running", _BASE + """
, g AS (SELECT domain, batch_id, sum(ce) AS s, count(*) AS n FROM ce GROUP BY ALL)
SELECT domain, batch_id,
       sum(s) OVER (PARTITION BY domain ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS loss_sum,
       CAST(sum(n) OVER (PARTITION BY domain ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_seen
FROM g""")
def q_group_loss_running(spark, sf):
    return L.group_loss_running(scored_ce(spark, sf))


# Mixup partners inside batches of 16; fixed lambda 0.7 for the check
_MIX_EMB_SQL = f"""
eb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS features, label,
              (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS batch_id FROM embeddings),
ea AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY {_h(42, 'vec_id')}, vec_id) AS r1,
                 row_number() OVER (PARTITION BY batch_id ORDER BY {_h(43, 'vec_id')}, vec_id) AS r2 FROM eb),
pairs AS (SELECT a.vec_id, b.vec_id AS partner_id, a.batch_id, CAST(0.7 AS DOUBLE) AS lam, a.label, b.label AS label_b,
                 a.features AS fa, b.features AS fb
          FROM ea a JOIN ea b ON a.batch_id = b.batch_id AND a.r1 = b.r2)"""


@query("mixup_pairs", with_ctes(_MIX_EMB_SQL) + """
SELECT vec_id, partner_id, batch_id, lam, label, label_b,
       lam * fa[1] + (1.0 - lam) * fb[1] AS mix_first,
       list_sum(list_transform(range(1, len(fa) + 1), lambda i: lam * fa[i] + (1.0 - lam) * fb[i])) AS mix_sum
FROM pairs""")
def q_mixup_pairs(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"), "label")
    emb = assign_batches(emb, 16, order="vec_id").drop("epoch", "position")
    pairs = L.mixup_features(L.mixup_pairs(emb, "vec_id", seed=42, lam=0.7))
    return pairs.select("vec_id", "partner_id", "batch_id", "lam", "label", "label_b",
                        F.element_at("mixed", 1).alias("mix_first"),
                        F.aggregate("mixed", F.lit(0.0), lambda a, x: a + x).alias("mix_sum"))


_MIX_SCORED_SQL = f"""
sa AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY {_h(42, 'doc_id')}, doc_id) AS r1,
                 row_number() OVER (PARTITION BY batch_id ORDER BY {_h(43, 'doc_id')}, doc_id) AS r2 FROM ce),
sp AS (SELECT a.batch_id, CAST(0.7 AS DOUBLE) AS lam, a.ce AS ce_a,
              a.lse1 - CASE WHEN b.label = 1 THEN a.z ELSE 0.0 END AS ce_b
       FROM sa a JOIN sa b ON a.batch_id = b.batch_id AND a.r1 = b.r2)"""


@query("mixup_loss", _BASE + "," + _MIX_SCORED_SQL + """
SELECT batch_id, avg(lam * ce_a + (1.0 - lam) * ce_b) AS mixup_loss FROM sp GROUP BY batch_id""")
def q_mixup_loss(spark, sf):
    s = scored(spark, sf).select("doc_id", "batch_id", "label", "logits")
    return L.mixup_loss(L.mixup_pairs(s, "doc_id", seed=42, lam=0.7))


@query("domain_bucket", with_ctes(CORPUS_SQL) + """
SELECT domain, CAST(('0x' || substr(md5(domain), 1, 8))::BIGINT % 1000 AS INTEGER) AS bucket
FROM (SELECT DISTINCT domain FROM corpus)""")
def q_domain_bucket(spark, sf):
    d = corpus(spark, sf).select("domain").distinct()
    return d.select("domain", L.domain_bucket("domain").alias("bucket"))


# ---------------------------------------------------------------- scoring, metrics

_P_SQL = """
sc AS (SELECT *, exp(0.0 - lse1) AS p0, exp(z - lse1) AS p1 FROM ce)"""


@query("score_rows", _BASE + "," + _P_SQL + """
SELECT doc_id, pred, CASE WHEN pred = 1 THEN p1 ELSE p0 END AS confidence, p0 AS p_fake, p1 AS p_true,
       CASE pred WHEN 0 THEN 'FAKE' WHEN 1 THEN 'TRUE' END AS pred_name FROM sc""")
def q_score_rows(spark, sf):
    s = score(scored(spark, sf))
    return s.select("doc_id", "pred", "confidence", "p_fake", "p_true", "pred_name")


_CLASS_SQL = """
cc AS (SELECT label, pred, count(*) AS n FROM ce GROUP BY ALL),
cls AS (SELECT label AS c FROM cc UNION SELECT pred FROM cc),
pc AS (SELECT c,
         coalesce((SELECT sum(n) FROM cc WHERE label = c AND pred = c), 0) AS tp,
         coalesce((SELECT sum(n) FROM cc WHERE pred = c AND label <> c), 0) AS fp,
         coalesce((SELECT sum(n) FROM cc WHERE label = c AND pred <> c), 0) AS fn,
         coalesce((SELECT sum(n) FROM cc WHERE label = c), 0) AS support FROM cls),
pm AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p,
                 CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r,
                 CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f FROM pc)"""


@query("metrics_macro", _BASE + "," + _CLASS_SQL + """
SELECT avg(p) AS precision, avg(r) AS recall, avg(f) AS f1, sum(tp) / sum(support) AS accuracy FROM pm""")
def q_metrics_macro(spark, sf):
    return E.prf(scored_ce(spark, sf), "macro")


@query("metrics_weighted", _BASE + "," + _CLASS_SQL + """
SELECT sum(p * support) / sum(support) AS precision, sum(r * support) / sum(support) AS recall,
       sum(f * support) / sum(support) AS f1, sum(tp) / sum(support) AS accuracy FROM pm""")
def q_metrics_weighted(spark, sf):
    return E.prf(scored_ce(spark, sf), "weighted")


_AUC_HARD_SQL = """
ah AS (SELECT count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 1 AND pred <> 1) AS fn,
              count(*) FILTER (WHERE label <> 1 AND pred <> 1) AS tn, count(*) FILTER (WHERE label <> 1 AND pred = 1) AS fp
       FROM ce),
auc AS (SELECT CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN 0.0
                    ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END AS auc FROM ah)"""


@query("auc_hard", _BASE + "," + _AUC_HARD_SQL + "SELECT auc FROM auc")
def q_auc_hard(spark, sf):
    return E.auc_hard(scored_ce(spark, sf))


@query("auc_score", _BASE + """
, ps AS (SELECT z AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
         FROM ce GROUP BY z),
rs AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM ps)
SELECT CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.0
            ELSE sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc FROM rs""")
def q_auc_score(spark, sf):
    return E.auc_score(scored_ce(spark, sf).withColumn("score", F.col("z")))


@query("confusion", _BASE + """
SELECT label, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1,
       count(*) FILTER (WHERE pred IS NULL OR pred NOT IN (0, 1)) AS pred_other
FROM ce GROUP BY label""")
def q_confusion(spark, sf):
    return E.confusion(scored_ce(spark, sf))


_RECORD_SQL = _BASE + "," + _CLASS_SQL + "," + _AUC_HARD_SQL + """,
rec AS (SELECT (SELECT avg(bl) FROM (SELECT avg(ce) AS bl FROM ce GROUP BY batch_id)) AS loss,
               sum(tp) / sum(support) AS accuracy, avg(p) AS precision, avg(r) AS recall, avg(f) AS f1,
               (SELECT auc FROM auc) AS auc FROM pm)
"""


@query("metrics_record", _RECORD_SQL + "SELECT * FROM rec")
def q_metrics_record(spark, sf):
    return E.evaluate_table(scored_ce(spark, sf))


@query("target_check", _RECORD_SQL + "SELECT *, accuracy >= 0.93 AND f1 >= 0.93 AS target_met FROM rec")
def q_target_check(spark, sf):
    return E.target_met(E.evaluate_table(scored_ce(spark, sf)), 0.93, 0.93)


@query("pseudo_label", """
WITH s AS (SELECT doc_id, CAST(n_chars - 1500 AS DOUBLE) / 1000.0 AS z FROM documents),
p AS (SELECT doc_id, z, greatest(0.0, z) AS m FROM s),
q AS (SELECT doc_id, CASE WHEN z > 0 THEN 1 ELSE 0 END AS pred,
             exp(greatest(0.0, z) - m) / (exp(0.0 - m) + exp(z - m)) AS confidence FROM p)
SELECT doc_id, quality AS label, 'gold' AS origin FROM labels
UNION ALL
SELECT doc_id, pred, 'pseudo' FROM q WHERE confidence >= 0.9 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_pseudo_label(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.array(F.lit(0.0), (F.col("n_chars") - 1500).cast("double") / 1000.0).alias("logits"))
    gold = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return pseudo_label(gold, score(docs), "doc_id", 0.9)


# ---------------------------------------------------------------- ensembles

def _models_long(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    models = F.array(*[F.struct(F.lit(f"m{m}").alias("model"),
                                ((F.col("n_chars") - 1000 * m).cast("double") / 1000.0).alias("z")) for m in (1, 2, 3)])
    long = d.select("doc_id", F.explode(models).alias("e")).select("doc_id", "e.model", "e.z")
    return long.withColumn("probs", softmax(F.array(F.lit(0.0), F.col("z"))))


_ENS_SQL = """
ml AS (SELECT d.doc_id, 'm' || CAST(m AS VARCHAR) AS model, CAST(d.n_chars - 1000 * m AS DOUBLE) / 1000.0 AS z
       FROM documents d CROSS JOIN (VALUES (1), (2), (3)) t(m)),
mp AS (SELECT *, exp(0.0 - greatest(0.0, z)) / (exp(0.0 - greatest(0.0, z)) + exp(z - greatest(0.0, z))) AS p0,
                 exp(z - greatest(0.0, z)) / (exp(0.0 - greatest(0.0, z)) + exp(z - greatest(0.0, z))) AS p1 FROM ml)"""


@query("ensemble_average", with_ctes(_ENS_SQL) + """
SELECT doc_id, avg(p0) AS p0, avg(p1) AS p1, count(*) AS n_models,
       CASE WHEN avg(p1) > avg(p0) THEN 1 ELSE 0 END AS pred FROM mp GROUP BY doc_id""")
def q_ensemble_average(spark, sf):
    return H.ensemble_average(_models_long(spark, sf), id_col="doc_id")


@query("ensemble_summary", with_ctes(_ENS_SQL) + """
, acc AS (SELECT model, avg(CASE WHEN (CASE WHEN z > 0 THEN 1 ELSE 0 END) = l.quality THEN 1.0 ELSE 0.0 END) AS accuracy
          FROM mp JOIN labels l ON mp.doc_id = l.doc_id GROUP BY model)
SELECT model, accuracy, (SELECT avg(accuracy) FROM acc) AS mean_accuracy, (SELECT count(*) FROM acc) AS n_models,
       least((SELECT avg(accuracy) FROM acc) + 0.02, 0.95) AS projected FROM acc""")
def q_ensemble_summary(spark, sf):
    long = _models_long(spark, sf).withColumn("pred", argmax("probs"))
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    per = (long.join(lab, "doc_id").groupBy("model")
           .agg(F.avg((F.col("pred") == F.col("quality")).cast("double")).alias("accuracy")))
    return H.ensemble_summary(per)


# ---------------------------------------------------------------- history (H1, H2, K1)

_HIST = with_ctes(HISTORY_SQL)


@query("best_epoch", _HIST + """
SELECT run_id, CASE WHEN max(val_f1) > 0 THEN arg_min(epoch, (-val_f1, epoch)) END AS best_epoch,
       max(val_f1) AS best_f1 FROM history GROUP BY run_id""")
def q_best_epoch(spark, sf):
    return H.best_epoch(history(spark, sf))


@query("history_checkpoints", _HIST + """
SELECT run_id, epoch, val_f1, val_f1 > coalesce(max(val_f1) OVER (PARTITION BY run_id ORDER BY epoch
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS improved FROM history""")
def q_history_checkpoints(spark, sf):
    return H.checkpoint_flags(history(spark, sf))


@query("early_stop", _HIST + """
, f AS (SELECT *, val_f1 > coalesce(max(val_f1) OVER (PARTITION BY run_id ORDER BY epoch
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS improved,
               row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS rk FROM history),
g AS (SELECT *, rk - coalesce(max(CASE WHEN improved THEN rk END) OVER (PARTITION BY run_id ORDER BY epoch
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS since FROM f)
SELECT run_id, min(CASE WHEN since >= 3 THEN epoch END) AS stop_epoch, max(epoch) AS last_epoch FROM g GROUP BY run_id""")
def q_early_stop(spark, sf):
    return H.early_stop(history(spark, sf), patience=3)


@query("history_arrays", _HIST + """
SELECT run_id, array_to_string(list(epoch ORDER BY epoch), ',') AS epochs,
       array_to_string(list(CAST(round(val_f1 * 1000000) AS BIGINT) ORDER BY epoch), ',') AS val_f1_micro
FROM history GROUP BY run_id""")
def q_history_arrays(spark, sf):
    a = H.history_arrays(history(spark, sf), ["val_f1"])
    return a.select("run_id", F.array_join(F.transform("epochs", lambda x: x.cast("string")), ",").alias("epochs"),
                    F.array_join(F.transform("val_f1", lambda x: F.round(x * 1000000).cast("long").cast("string")), ",")
                    .alias("val_f1_micro"))


# ---------------------------------------------------------------- run report (K4)

REPORT_CONFIG = {"model": "fixture-scorer", "max_length": 256, "batch_size": 16, "seed": 42}


def _report_sql():
    from corpusflow.plans.fixtures import CORPUS_SQL as _C
    from corpusflow.plans.q_corpus import _CLEAN_A_SQL, _DEDUP_SQL
    from corpusflow.plans.q_split import _X4
    cfg = " UNION ALL ".join(f"SELECT 'config', '{k}', '{v}'" for k, v in REPORT_CONFIG.items())
    return with_ctes(SCORED_SQL, _CE_SQL, _C, _CLEAN_A_SQL, _DEDUP_SQL, _X4) + "," + _CLASS_SQL + f"""
, info AS (SELECT count(*) AS total, count(*) FILTER (WHERE label = 1) AS n_fake, count(*) FILTER (WHERE label = 0) AS n_true,
                  count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
                  count(*) FILTER (WHERE split = 'test') AS n_test FROM splitted),
met AS (SELECT sum(p * support) / sum(support) AS precision, sum(r * support) / sum(support) AS recall,
               sum(f * support) / sum(support) AS f1, sum(tp) / sum(support) AS accuracy FROM pm)
SELECT 'dataset' AS section, k AS key, v AS value FROM (
  SELECT 'total' AS k, CAST(total AS VARCHAR) AS v FROM info UNION ALL SELECT 'n_fake', CAST(n_fake AS VARCHAR) FROM info
  UNION ALL SELECT 'n_true', CAST(n_true AS VARCHAR) FROM info UNION ALL SELECT 'n_train', CAST(n_train AS VARCHAR) FROM info
  UNION ALL SELECT 'n_val', CAST(n_val AS VARCHAR) FROM info UNION ALL SELECT 'n_test', CAST(n_test AS VARCHAR) FROM info)
UNION ALL {cfg}
UNION ALL SELECT 'metrics', k, v FROM (
  SELECT 'precision' AS k, printf('%.6f', precision) AS v FROM met UNION ALL SELECT 'recall', printf('%.6f', recall) FROM met
  UNION ALL SELECT 'f1', printf('%.6f', f1) FROM met UNION ALL SELECT 'accuracy', printf('%.6f', accuracy) FROM met)"""


@query("run_report", _report_sql())
def q_run_report(spark, sf):
    from corpusflow.plans.q_split import split3
    from corpusflow.sources.sinks import run_report
    s = split3(spark, sf)
    info = s.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == 1).alias("n_fake"),
                 F.count_if(F.col("label") == 0).alias("n_true"), F.count_if(F.col("split") == "train").alias("n_train"),
                 F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "test").alias("n_test"))
    metrics = E.prf(scored_ce(spark, sf), "weighted")
    return run_report(info, REPORT_CONFIG, metrics)

"""Operators on small literal tables."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import metrics as M
from spindrift.functions import stats as S
from spindrift.kernels import volumes as V
from spindrift.models import classify, cv, survival
from spindrift.operators import cohort, columns, joins, longitudinal
from spindrift.plans import qa, workflow
from spindrift.sources import feed, files
from spindrift.streaming import watch


def longitudinal_table(spark):
    rows = [(p, "GTV", tp, day, 10.0 + off, 100.0 - off) for p in "AB" for tp, day, off in (("b", 0, 0), ("f", 28, 5))]
    return spark.createDataFrame(rows, "patient_id string, roi_name string, timepoint string, relative_day int, f1 double, f2 double")


def test_delta(spark):
    df = longitudinal_table(spark)
    got = longitudinal.delta(df, "f", "b", features=["f1", "f2"]).orderBy("patient_id").collect()
    assert [(r.delta_f1, r.delta_f2) for r in got] == [(5.0, -5.0)] * 2
    only = longitudinal.delta(df.where("not (patient_id = 'B' and timepoint = 'f')"), "f", "b", features=["f1"]).collect()
    assert [r.patient_id for r in only] == ["A"]
    none = longitudinal.delta(df, "x", "b", features=["f1"])
    assert none.count() == 0 and none.columns == ["patient_id", "roi_name", "delta_f1"]
    with pytest.raises(Exception, match="several rows"):
        longitudinal.delta(df.unionAll(df), "f", "b", features=["f1"]).collect()


def test_trend(spark):
    df = spark.createDataFrame([("A", "t0", 0, 1.0), ("A", "t1", 14, 4.0), ("A", "t2", 28, 7.0), ("B", "t0", 0, 1.0), (None, "t0", 0, 1.0)], "patient_id string, timepoint string, day int, f double")
    got = longitudinal.slopes(df, features=["f"], time_index="day").collect()
    assert len(got) == 1 and abs(got[0].slope_f - 6 / 28) < 1e-12


def test_merge_outcome(spark):
    feats = spark.createDataFrame([("PT001", 0.73), ("PT002", 0.81), ("PT003", 0.5)], "patient_id string, shape double")
    days = spark.createDataFrame([("PT001", 365, 1, "hi"), ("PT002", 730, 0, "lo")], "PatientID string, `Survival.time` int, `deadstatus.event` int, risk_group string")
    got = joins.merge_outcome(feats, days, "PatientID", time="Survival.time", event="deadstatus.event", outcome="risk_group").orderBy("patient_id").collect()
    assert [round(r.OS_months, 6) for r in got] == [round(365 / 30.44, 6), round(730 / 30.44, 6)] and got[0].risk_group == "hi"
    months = spark.createDataFrame([("PT001", 12.0, 1), ("PT002", 24.0, 0)], "patid string, m double, s int")
    assert [r.OS_months for r in joins.merge_outcome(feats, months, "patid", time="m", event="s").orderBy("patient_id").collect()] == [12.0, 24.0]
    lost = joins.unmatched(feats, days.withColumnRenamed("PatientID", "patient_id")).first()
    assert lost.n_unmatched == 1 and lost["sample"] == ["PT003"]


def test_unions_and_engines(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "patient_id int, f double"), spark.createDataFrame([(2, 3.0)], "patient_id int, g double")
    assert joins.union_rows(a, b).columns == ["patient_id", "f", "g"]
    assert joins.merge_engines({"a": a}).columns == ["patient_id", "f"]
    assert sorted(map(tuple, joins.merge_engines({"a": a, "b": b, "c": b.drop("patient_id")}).collect()), key=str) == [(1, 2.0, None), (2, None, 3.0)]


def test_compare_features(spark):
    nan, inf = math.nan, math.inf
    a = spark.createDataFrame([("c", "same", 1.0), ("c", "tiny", 1.0), ("c", "diff", 1.0), ("c", "nan", nan), ("c", "inf", inf), ("c", "nanfin", nan), ("c", "onlya", 1.0)], "case_id string, feature string, value double")
    b = spark.createDataFrame([("c", "same", 1.0), ("c", "tiny", 1.0 + 1e-12), ("c", "diff", 1.0 + 1e-6), ("c", "nan", nan), ("c", "inf", inf), ("c", "nanfin", 1.0), ("c", "onlyb", 1.0)], "case_id string, feature string, value double")
    got = {r.feature: r.status for r in joins.compare_features(a, b).collect()}
    assert got == {"diff": "changed", "nanfin": "changed", "onlya": "missing", "onlyb": "extra"}


def predictions(spark, y, p):
    return spark.createDataFrame(list(zip(map(float, y), map(float, p))), "y double, p double")


def test_metrics(spark):
    d = predictions(spark, [0, 0, 0, 1, 1, 1], [0.05, 0.1, 0.15, 0.85, 0.9, 0.95])
    assert 0.15 < M.youden(d).first().threshold <= 0.85 and M.auc(d).first().auc == 1.0 and M.average_precision(d).first().ap == 1.0
    perfect = predictions(spark, [0, 0, 1, 1], [0, 0, 1, 1])
    assert M.brier(perfect).first().brier == 0 and M.ece(perfect).first().ece == 0
    none, one = predictions(spark, [], []), predictions(spark, [0, 0], [0.2, 0.4])
    for df in (none, one):
        assert M.auc(df).first().auc is None
        M.youden(df).collect(), M.ece(df).collect(), M.average_precision(df).collect(), M.net_benefit(df).collect(), M.at_threshold(df, 0.5).collect()
    edge = predictions(spark, [1] * 3, [0.3, 3 * 0.1, 1.5])
    assert M.ece(edge).first().ece is not None
    multi = spark.createDataFrame([(0, [0.0, 1.0, 0.0])] * 3, "y int, p array<double>")
    assert M.multiclass_brier(multi, 3).first().brier == 2.0
    good = spark.createDataFrame([(k, [1.0 if i == k else 0.0 for i in range(3)]) for k in (0, 1, 2, 0, 1, 2)], "y int, p array<double>")
    assert M.macro_auc(good, 3).first().macro_auc == 1.0 and M.multiclass_ece(good).first().ece == 0
    assert {r["class"]: r.f1 for r in M.class_report(spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "y int, pred int")).collect()} == {0: 0.666667, 1: 0.666667}


def test_statistics(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(160):
        cov, site = rng.normal(), "AB"[i % 2]
        f = [rng.normal() + 0.8 * cov for _ in range(5)]
        rows.append((i, site, float(cov), *[float(2 * v + 3 if site == "B" else v) for v in f]))
    df = spark.createDataFrame(rows, "pid int, site string, covar double, " + ", ".join(f"f{i} double" for i in range(5)))
    feats = [f"f{i}" for i in range(5)]
    for eb in (True, False):
        out = S.combat(df, feats, "site", continuous=["covar"], eb=eb).toPandas()
        raw = df.toPandas()
        for f in feats:
            gap = lambda t: abs(t[t.site == "A"][f].mean() - t[t.site == "B"][f].mean())
            assert gap(out) < 0.25 * gap(raw)
    assert S.combat(df.where("site = 'A'"), feats, "site").count() == 80
    res = S.residualize(df, feats, ["covar"]).toPandas()
    assert all(abs(np.corrcoef(res[f], res.covar)[0, 1]) < 1e-6 for f in feats) and abs(res.f0.mean() - df.toPandas().f0.mean()) < 1e-6
    icc = {r.feature: r.icc3 for r in S.icc_table(df, df, feats, "pid").collect()}
    assert all(v > 0.99 for v in icc.values())
    m = np.array([[1, 0.96, 0.1], [0.96, 1, 0.95], [0.1, 0.95, 1]])
    assert S.prune_correlated(["a", "b", "c"], m) == ["a", "c"] and S.prune_correlated(["a", "b", "c"], m, 0.94, against_kept=False) == ["a"]
    assert abs(S.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(S.chi2_tail(9.487729, 4) - 0.05) < 1e-6
    assert S.concordance_index([1, 2, 3, 4], [4, 3, 2, 1], [1, 1, 1, 0]) == 1.0


def test_cox_two_groups():
    """One binary covariate without ties: the score equation holds at the estimate."""
    rng = np.random.default_rng(1)
    x = (np.arange(200) % 2).astype(float)
    t = rng.exponential(np.exp(-0.7 * x))
    e = (rng.random(200) < 0.8).astype(float)
    b, v, _ = survival.cox(x, t, e)
    score = sum(x[i] - (x[t >= t[i]] * np.exp(b[0] * x[t >= t[i]])).sum() / np.exp(b[0] * x[t >= t[i]]).sum() for i in range(200) if e[i])
    assert abs(score) < 1e-5 and abs(b[0] - 0.7) < 0.4 and v[0, 0] > 0
    bl, _ = classify.logit(np.array([0.0] * 50 + [1.0] * 50), np.array([1.0] * 10 + [0.0] * 40 + [1.0] * 30 + [0.0] * 20))
    assert abs(bl[1] - (math.log(30 / 20) - math.log(10 / 40))) < 1e-6
    with pytest.raises(ArithmeticError):
        classify.logit(np.arange(20.0), (np.arange(20) >= 10).astype(float))


def test_scans_skip_what_cannot_be_fitted(spark):
    rng = np.random.default_rng(2)
    rows = [(f"P{i}", float(rng.exponential(24)), int(rng.random() < 0.7), float(rng.normal()), 1.0, None if i > 5 else 1.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "patient_id string, OS_months double, OS_event int, a double, flat double, sparse double")
    assert [r.feature for r in survival.cox_scan(df).collect()] == ["a"]
    assert [r.feature for r in classify.logit_scan(df.drop("OS_months"), "OS_event").collect()] == ["a"]


def test_folds(spark):
    df = spark.createDataFrame([(f"P{i % 12}", i % 2) for i in range(48)], "patient_id string, y int")
    for label in (None, "y"):
        cv.assert_no_leak(cv.group_folds(df, "patient_id", 4, label=label), "patient_id")
    with pytest.raises(ValueError, match="leakage"):
        cv.assert_no_leak(df.withColumn("fold", F.monotonically_increasing_id() % 3), "patient_id")
    assert cv.fold_count(df, "patient_id", 20) == (12, True) and cv.fold_count(df, "other", 5) == (5, False)


def test_scorecard(spark):
    rows = [("C07", "PASS", 1.5, False), ("C06", "FAIL", 1.5, True), ("C17", "PARTIAL", 0.8, False), ("C99", "NA", 9.0, False)]
    r = qa.scorecard(qa.constant_checks(spark, rows)).first()
    assert abs(r.weighted_pct - 100 * 1.9 / 3.8) < 1e-9 and r.gate_capped and r.failed_gates == ["C06"] and r.band == "Moderate" and r.n_applicable == 3


def test_cohort(spark):
    study = lambda day, kind, rts: {"id": f"s{day}", "relative_day": day, "images": [{"id": f"i{day}", "modality": kind, "files": [f"/x/{day}.nrrd"], "tag": kind.lower()}], "structures": rts}
    rt = [{"id": "rt", "path": "/x/rt", "references": "", "rois": [{"id": "1", "name": "GTV"}]}]
    tree = {"name": "c", "patients": [{"id": "P1", "courses": [{"id": "rt1", "studies": [study(0, "CT", rt), study(28, "CBCT", [])]}]}, {"id": "P2", "studies": [{"id": "s", "date": "20200102", "images": []}]}]}
    rows = cohort.flatten_cohort(cohort.cohort_from(spark, tree)).orderBy("timepoint").collect()
    assert [(r.timepoint, r.mask_tag, r.course_id) for r in rows] == [("day+0", "GTV", "rt1"), ("day+28", "", "rt1")]
    assert rows[0].asDict().keys() == dict.fromkeys(cohort.MANIFEST_COLUMNS).keys()
    assert cohort.flatten_cohort(cohort.cohort_from(spark, {"name": "e", "patients": []})).count() == 0
    listing = spark.createDataFrame([("f:/d/P001/P001_CT.nrrd", 1), ("f:/d/P001/P001_CT_mask-label.nrrd", 1), ("f:/d/L-1_image.nrrd", 1), ("f:/d/L-1_mask.nrrd", 1), ("f:/d/L-2_image.nrrd", 1)], "path string, length long")
    assert {r.patient_id for r in cohort.images_with_masks(listing).collect()} == {"P001", "L-1"}


def test_privacy_and_parsing(spark):
    df = spark.createDataFrame([("p1", "Doe", "1.2", "20240131", "100, 200"), ("", "Roe", "1.2", "2024-02-01", "100200"), (None, None, None, "x", "bad")], "PatientID string, PatientName string, SeriesInstanceUID string, d string, xy string")
    a = columns.anonymize(df, "salt").collect()
    assert a[0].PatientID.startswith("ANON-") and a[1].PatientID == "" and a[0].PatientName == "" and a[0].SeriesInstanceUID == a[1].SeriesInstanceUID != "1.2"
    with pytest.raises(ValueError):
        columns.anonymize(df, "")
    got = df.select(columns.parse_date(F.col("d")).cast("string").alias("d"), columns.packed_xy(F.col("xy")).alias("xy")).collect()
    assert [r.d for r in got] == ["2024-01-31", "2024-02-01", None] and tuple(got[0].xy) == tuple(got[1].xy) == (100, 200) and got[2].xy is None


def test_suv(spark):
    f = lambda **k: tuple(spark.range(1).select(columns.suv_factor(*[F.lit(k.get(n, d)).cast("string" if n == "units" else "double") for n, d in (("w", 70.0), ("units", "BQML"), ("s", 43200.0), ("i", 39600.0), ("h", 6588.0), ("dose", 370e6), ("v", None))]).alias("x")).first().x)
    assert abs(f()[0] - 70000 / (370e6 * math.exp(-math.log(2) * 3600 / 6588))) < 1e-12 and f()[1] is False
    assert f(units="GML") == (1.0, False) and f(units="CNTS", v=0.5) == (0.5, False) and f(units="odd") == (1.0, True) and f(w=None)[1] is True


def test_kernels(spark):
    ball = V.sphere(25, 7)
    e = V.direction_histogram(ball)
    assert e.shape == (180,) and abs(e[:90].sum() - 1) < 1e-9 and abs(e[90:].sum() - 1) < 1e-9
    z, y, x, _, _ = V.dots(ball, 8, 16, scales=2)[0]
    assert max(abs(v - 12) for v in (z, y, x)) <= 1
    assert V.components(np.array([[[1, 0, 1]]], bool))[1] == 2
    square = V.fill_polygons([([2, 12, 12, 2], [2, 2, 12, 12]), ([5, 8, 8, 5], [5, 5, 8, 8])], (20, 20))
    assert square.sum() == 100 - 9
    w, p, q = V.staple(np.array([[1, 1, 0, 0], [1, 1, 0, 0], [1, 0, 0, 1]]))
    assert (w >= 0.5).tolist() == [True, True, False, False] and p[2] < p[0]
    image, mask = V.pack(ball, (1, 1, 2)), V.pack((ball > 0).astype(np.uint8), (1, 1, 2))
    a, m = V.crop_resample(image, mask, pad_mm=2)
    assert a["shape"] == m["shape"] and V.unpack(m)[0].sum() > (ball > 0).sum()
    with pytest.raises(ValueError):
        V.crop_resample(image, mask, label=9)
    assert files.parse_nrrd(files.write_nrrd(image))[0] == image
    df = spark.createDataFrame([(1, image), (2, {**image, "dtype": "broken"})], f"id int, volume {V.VOLUME}")
    got = V.per_volume(df, lambda r: [{"id": r["id"], "mean": V.first_order(V.unpack(r["volume"])[0])["Mean"]}], "id int, mean double").orderBy("id").collect()
    assert got[0].status == "ok" and got[1].status == "failed" and got[1].error


def test_readings():
    ns = 'xmlns="http://x"'
    roi = lambda inc: f"<roi><imageZposition>1.5</imageZposition><imageSOP_UID>u</imageSOP_UID><inclusion>{inc}</inclusion>" + "".join(f"<edgeMap><xCoord>{x}</xCoord><yCoord>{y}</yCoord></edgeMap>" for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))) + "</roi>"
    text = f"<LidcReadMessage {ns}><readingSession><unblindedReadNodule><noduleID>n1</noduleID><characteristics><malignancy>4</malignancy></characteristics>{roi('TRUE')}{roi('FALSE')}</unblindedReadNodule></readingSession><readingSession/></LidcReadMessage>"
    (n,) = files.parse_readings(text)
    assert n["session"] == 1 and n["scores"]["malignancy"] == 4 and n["scores"]["margin"] == 0 and len(n["rois"]) == 1


def test_feed_and_watch(spark, tmp_path):
    feed.register(spark)
    src = tmp_path / "feed"
    src.mkdir()
    event = lambda n: {"Seq": n, "ChangeType": "NewInstance" if n % 2 else "StableStudy", "ResourceType": "Study", "ID": f"id{n}", "Path": f"/s/{n}", "Date": "d"}
    (src / "a.json").write_text(json.dumps({"Changes": [event(n) for n in range(1, 8)]}))
    assert spark.read.format("change_feed").option("path", str(src)).option("limit", 3).load().count() == 7

    def drain():
        s = watch.watched(spark.readStream.format("change_feed").option("path", str(src)).load(), ["NewInstance"], {"path": "/s/*"})
        q = s.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.seq for r in spark.read.json(str(tmp_path / "out")).collect())

    assert drain() == [1, 3, 5, 7]
    (src / "b.json").write_text(json.dumps({"Changes": [event(n) for n in range(8, 12)]}))
    assert drain() == [1, 3, 5, 7, 9, 11]


def test_workflow(spark, tmp_path):
    feats = spark.createDataFrame([(f"P{i}", float((i * 7) % 11)) for i in range(40)], "patient_id string, f double")
    clin = spark.createDataFrame([(f"P{i}", 10.0 + i, i % 2) for i in range(40)], "pid string, t double, e int")
    feats.write.parquet(f"{tmp_path}/f.parquet")
    clin.write.parquet(f"{tmp_path}/c.parquet")
    plan = workflow.survival_plan(f"{tmp_path}/f.parquet", f"{tmp_path}/c.parquet", str(tmp_path), "pid", "t", "e")
    plan.save(f"{tmp_path}/plan.json")
    out = workflow.run(spark, workflow.Plan.load(f"{tmp_path}/plan.json"))
    assert out["ready"].count() == 40 and out["cox"].count() == 1
    assert workflow.resolve("${A:-x}/{b}", {"b": "{c}", "c": 1}) == "x/1"
    with pytest.raises(KeyError):
        workflow.resolve("{none}", {})

"""Reports, result documents, incremental summaries, nested regions, worker calls, word tables and mergeable statistics."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folimetry.functions import formatting
from folimetry.operators import frequencies, reports, workers
from folimetry.operators import statistics as st
from folimetry.sources import files

NAN = float("nan")
PAGES = "model string, test_set string, device string, label string, run_index int, is_warmup boolean, file string, page int, seconds double, cer double, text string"


def pages_of(spark):
    rows = []
    for run, warm, scores in ((0, True, (0.9, 0.9)), (1, False, (0.1, 0.3)), (2, False, (0.4, NAN)), (3, False, (None, NAN))):
        rows += [("m", "t", "cpu", "", run, warm, "f", k + 1, 1.0 + run, s, f"é{k}") for k, s in enumerate(scores)]
    rows += [("m", "t", "cpu", "blur()", 0, False, "f", 1, 1.0, 0.5, "x"), ("m", "t", "cpu", "jpeg()", 0, False, "f", 1, 1.0, None, "x")]
    rows += [("w", "t", "cpu", "", 0, True, "f", 1, 2.0, 0.7, None), ("d", "t", "cpu", "only", 0, False, "f", 1, 2.0, 0.7, None)]
    return spark.createDataFrame(rows, PAGES)


def test_score_summary_over_measured_runs(spark):
    got = {(r.model, r.metric): r for r in reports.score_summary(pages_of(spark), ["cer"]).collect()}
    r = got["m", "cer"]
    assert (r.n, r["mean"], r.median) == (2, pytest.approx(0.3), pytest.approx(0.3)) and r.std == pytest.approx(np.std([0.2, 0.4], ddof=1))
    assert (r.ci_lower, r.ci_upper) == pytest.approx(st.interval(np.array([0.2, 0.4]))) and got["m", reports.SPEED].n == 3 and got["m", reports.SPEED]["mean"] == 3
    assert ("w", "cer") not in got and ("d", "cer") not in got


def test_result_documents_and_reports(spark):
    runs = spark.createDataFrame([("m", "t", "cpu", "", 3, 1.5, {"peak_ram_mb": 812.4})], "model string, test_set string, device string, label string, run_index int, load_seconds double, resources map<string,double>")
    got = {r.model: json.loads(r.document) for r in reports.result_documents(pages_of(spark), ["cer"], runs=runs, details=("text",)).collect()}
    d = got["m"]
    assert (d["total_runs"], d["warmup_runs"], d["measured_runs"], d["model_load_time_seconds"], d["resources"]) == (4, 1, 3, 1.5, {"peak_ram_mb": 812.4})
    assert d["metrics"] == [{"file": "f", "page": k, "prediction_time_seconds": 4.0, "text": f"é{k - 1}", "scores": {}} for k in (1, 2)]
    assert d["metric_summaries"]["cer"]["mean"] == 0.3 and d["metric_summaries"]["cer"]["n_runs"] == 2 and d["timing_summary"]["mean"] == 3.0
    assert d["degradation_results"] == [{"label": "blur()", "scores": {"cer": 0.5}}, {"label": "jpeg()", "scores": {}}]
    assert got["w"]["metrics"][0]["scores"] == {"cer": 0.7} and "metric_summaries" not in got["w"] and set(got) == {"m", "w"}
    shown = {r.model: r.report for r in reports.markdown_reports(pages_of(spark), ["cer"], runs=runs).collect()}
    assert shown["m"].startswith("## m — t — cpu\n\n| Metric | Mean | Std | 95% CI |\n|---|---|---|---|\n| CER | 0.3000 | 0.1414 | [0.2000, 0.4000] |\n| Speed (s/page) | 3.0000 |")
    assert "- Load time: 1.50s\n- Peak RAM: 812 MB\n- Peak VRAM: —" in shown["m"] and shown["m"].endswith("| Degradation | CER |\n|---|---|\n| blur() | 0.5000 |\n| jpeg() | — |")
    assert shown["w"] == "## w — t — cpu" and "only | 0.7000" in shown["d"]
    none = pages_of(spark).limit(0)
    assert reports.result_documents(none, ["cer"]).count() == reports.markdown_reports(none, ["cer"]).count() == 0


def test_summary_follows_new_and_changed_files(spark, tmp_path):
    folder, summary, log = tmp_path / "results" / "set", f"{tmp_path}/summary", f"{tmp_path}/log"
    folder.mkdir(parents=True)

    def put(name, when, **fields):
        (folder / name).write_text(json.dumps(fields) if fields else "{broken")
        os.utime(folder / name, (when, when))

    def rows():
        return {(r.Model, r["Test Set"], r.Device): r.Pages for r in files.read_summary(spark, summary).collect()}

    put("a_b_cpu_results.json", 1000, total_pages_processed=3)
    put("x_results.json", 1000, model_name="named", device="cuda", test_set="own", total_pages_processed=5)
    put("broken_cpu_results.json", 1000)
    (folder / "other.json").write_text("{}")
    assert files.refresh_summary(spark, str(tmp_path / "results"), summary, log) == 3
    assert rows() == {("a_b", "set", "cpu"): "3", ("named", "own", "cuda"): "5"}
    assert files.refresh_summary(spark, str(tmp_path / "results"), summary, log) == 0
    put("a_b_cpu_results.json", 2000, total_pages_processed=7)
    put("new_cpu_results.json", 2000, total_pages_processed=1)
    put("copy_results.json", 3000, model_name="a_b", device="cpu", test_set="set", total_pages_processed=9)
    assert files.refresh_summary(spark, str(tmp_path / "results"), summary, log) == 3
    assert rows() == {("a_b", "set", "cpu"): "9", ("named", "own", "cuda"): "5", ("new", "set", "cpu"): "1"}


def tree(depth, rng):
    return {"text": f"t{rng.randrange(1000)}", "children": [tree(depth - 1, rng) for _ in range(rng.randrange(3))] if depth else []}


def test_nested_regions_round_trip(spark):
    rng = random.Random(2)
    outer = {"text": "outer", "children": [{"text": "inner", "children": [{"text": "innermost"}]}]}
    chain = {"text": "end"}
    for k in range(150):
        chain = {"text": str(k), "children": [chain]}
    pages = [[{"page": 4, "regions": [outer]}, {"regions": [tree(5, rng) for _ in range(4)]}], [{"page_number": 2, "regions": [chain]}], [{"regions": []}], [{"regions": [{"text": "a", "children": {"text": "no list"}}, 5]}]]
    rows = [(k, json.dumps({"pages": p})) for k, p in enumerate(pages)] + [(8, "{"), (9, None)]
    got = files.nested_regions(spark.createDataFrame(rows, "path int, json string").withColumnRenamed("path", "k")).collect()

    def rebuilt(k, position, path):
        of = [r for r in got if (r.k, r.position) == (k, position)]
        here = sorted((r for r in of if list(r.parent or []) == path and len(r.path) == len(path) + 1), key=lambda r: r.path[-1])
        return [(r.region.text, rebuilt(k, position, list(r.path))) for r in here]

    def plain(regions):
        return [(x["text"], plain(x.get("children", []))) if isinstance(x, dict) else ("", []) for x in regions]

    assert rebuilt(0, 0, []) == plain([outer]) and rebuilt(0, 1, []) == plain(pages[0][1]["regions"])
    assert max(len(r.path) for r in got if r.k == 1) == 151 and {r.page for r in got if r.k == 1} == {2}
    assert [(r.region.text, r.path) for r in sorted((r for r in got if r.k == 3), key=lambda r: r.path)] == [("a", [0]), ("", [1])] and {r.k for r in got} == {0, 1, 3}


def test_worker_calls_keep_what_works(spark, tmp_path):
    def worker(batch):
        if any(x == 7 for x in batch):
            raise ValueError("seven")
        return [x * 2 for x in batch[: -1 if 9 in batch and len(batch) > 1 else None]]

    rows = spark.createDataFrame([(x,) for x in range(1, 21)], "x int").coalesce(1)
    got = {r.x: r for r in workers.call_worker(rows, "x", worker, "int", batch=8).collect()}
    assert {x for x, r in got.items() if r.error} == {7} and got[7].error == "ValueError: seven" and got[7].calls == 4 and got[7].result is None
    assert all(r.result == 2 * x for x, r in got.items() if x != 7) and got[1].calls == 2 and got[9].calls == 2 and got[20].calls == 1

    def flaky():
        tries = {}

        def call(batch):
            for x in batch:
                tries[x] = tries.get(x, 0) + 1
                if len(batch) > 1 or tries[x] < 3:
                    raise RuntimeError("busy")
            return batch

        return call

    got = workers.call_worker(rows, "x", None, "int", batch=4, setup=flaky).collect()
    assert all(r.error is None and r.result == r.x for r in got) and {r.calls for r in got} == {3, 4}
    table = workers.failures(workers.call_worker(rows, "x", worker, "int").withColumn("odd", F.col("x") % 2), ["odd"]).collect()
    assert {(r.odd, r.rows, r.failed, r.commonest_error) for r in table} == {(0, 10, 0, None), (1, 10, 1, "ValueError: seven")}
    assert workers.call_worker(rows.limit(0), "x", worker, "int").count() == 0
    with pytest.raises(ValueError):
        workers.call_worker(rows.withColumn("Error", F.lit(1)), "x", worker)


def test_word_table(spark):
    texts = spark.createDataFrame([("The cat, the (CAT) sat.",), ("a--b 12 É é' ",), (None,), ("",)], "text string")
    got = {r.word: r.n for r in frequencies.word_frequencies(texts).collect()}
    assert got == {"the": 2, "cat": 2, "sat": 1, "a--b": 1, "é": 2}
    known = frequencies.known_words(frequencies.word_frequencies(texts), 8.0)
    assert known("Cat,") and known("(É)") and known("the") and not known("dog") and not known("12") and not known("")
    with pytest.raises(ValueError):
        frequencies.known_words(frequencies.word_frequencies(texts), 1.0)
    blocks = [{"index": 0, "label": "text", "content": "see the c-", "left": None}, {"index": 1, "label": "text", "content": "at, now", "left": None}]
    assert formatting.with_whole_words(blocks, known)[0]["content"] == "see the cat, now" and len(formatting.with_whole_words(blocks, frequencies.KnownWords(np.array([], np.int64)))) == 2


@pytest.mark.parametrize(("token", "yes"), [("compu-ter", True), ("ab", False), ("abc", True), ("a--bc", False), ("a''bc", False), ("abc-", True), ("it's", True), ("'abc", False), ("x" * 31, True), ("x" * 32, False), (" ABC ", True), ("a1b", False)])
def test_word_shape(token, yes):
    assert formatting.likely_word(token) is yes


def test_values_at_ranks(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=1001), "b": np.repeat([1.0, 2.0, 3.0], [500, 1, 500]), "c": np.array([5.0]), "d": np.array([NAN, NAN]), None: rng.integers(0, 9, 400).astype(float), "e": np.exp(rng.normal(0, 9, 777))}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None)]
    table = spark.createDataFrame(rows, "k string, x double").repartition(5)
    ranks = {"first": lambda n: F.lit(1), "third": lambda n: F.ceil(n / 3), "last": lambda n: n + 5}
    got = {r.k: r for r in st.values_at(table, ["k"], "x", ranks).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        v = np.sort(v[~np.isnan(v)])
        want = (len(v), v[0], v[-(-len(v) // 3) - 1], v[-1]) if len(v) else (0, None, None, None)
        assert (got[k].n, got[k].first, got[k].third, got[k].last) == want, k


def test_merged_median_and_paired_test_agree_with_the_drawn_ones(spark):
    rng = np.random.default_rng(8)
    x = rng.gamma(2.0, size=3001)
    table = spark.createDataFrame([("g", float(v), i) for i, v in enumerate(x)], "k string, x double, i long").repartition(4)
    got = st.median_merged(table, ["k"], "x").first()
    low, high = st.interval(x, statistic="median")
    assert got.median == np.sort(x)[1500] and abs(got.ci_lower - low) < 0.02 and abs(got.ci_upper - high) < 0.02
    for shift, sure in ((0.0, False), (0.2, True)):
        a, b = rng.normal(size=800), rng.normal(size=800)
        pairs = spark.createDataFrame([("g", float(p + shift), float(q), i) for i, (p, q) in enumerate(zip(a, b))] + [("one", 1.0, 2.0, 1), ("g", None, 1.0, 9), ("g", NAN, 1.0, 9)], "k string, a double, b double, i long").repartition(4)
        got = {r.k: r for r in st.paired_merged(pairs, ["k"], "i").collect()}
        assert abs(got["g"].p_value - st.paired_p(a + shift, b)) < 0.06 and got["g"].significant == sure and got["g"].n == 800 and got["one"].p_value is None


def test_reports_round_exact_values_and_ties_to_even(spark):
    from folimetry.functions import text as tx

    values = [0.5, 1.5, 2.5, 414.5, -2.5, 1.005, 0.125, 2.675, 1e17, float("nan"), None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    shown = rows.select("k", tx.fixed(F.col("v"), 0).alias("a"), tx.fixed(F.col("v"), 2).alias("b"), tx.fmt(F.col("v"), 0, "s").alias("c")).orderBy("k").collect()
    known = [v for v in values if v is not None and v == v]
    assert [(r.a, r.b, r.c) for r in shown] == [(f"{v:.0f}", f"{v:.2f}", f"{v:.0f}s") for v in known] + [(None, None, "N/A")] * 2
    pages = spark.createDataFrame([("m", "t", "cpu", "", 1, False, 1, 1, 1.0, 0.00005)], "model string, test_set string, device string, label string, run_index long, is_warmup boolean, file long, page long, seconds double, cer double")
    runs = spark.createDataFrame([("m", "t", "cpu", "", 1, 0.005, {"peak_ram_mb": 414.5})], "model string, test_set string, device string, label string, run_index long, load_seconds double, resources map<string,double>")
    report = reports.markdown_reports(pages, ["cer"], runs=runs, intervals=False).first().report
    assert "- Load time: 0.01s\n- Peak RAM: 414 MB" in report and f"| CER | {0.00005:.4f} | 0.0000 |" in report


def test_queries_hand_workers_small_batches_of_long_rows(spark):
    import pandas as pd

    from folimetry.plans import catalogue

    @F.pandas_udf("long")
    def rows_at_once(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    def query(session, _):
        texts = session.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), F.when(F.col("id") == 7, 3 * catalogue.BATCH_BYTES).otherwise(1 << 16)).alias("text"))
        return texts.select("id", F.char_length("text").alias("n"), rows_at_once("text").alias("rows"))

    made = catalogue.small_batches(query)(spark.newSession(), "").collect()
    assert len(made) == 400 and max(r.rows for r in made) <= catalogue.BATCH_BYTES / (1 << 16) + 1 and max(r.n for r in made) == 3 * catalogue.BATCH_BYTES


def test_annotation_exports_are_dealt_once_and_by_no_fixed_number(spark):
    from folimetry.plans import catalogue

    for name in ("annotation_convert", "annotation_pages"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION" not in plan


@pytest.mark.parametrize("name", ["norm_nfc", "image_limit", "page_frames"])
def test_registered_queries_bound_their_batches(spark, name):
    from folimetry.plans import catalogue

    session = spark.newSession()
    catalogue.queries()[name](session, "/root/testdata/sf0.001")
    assert int(session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == catalogue.BATCH_BYTES


@pytest.mark.parametrize("name, source, key, text", [("norm_nfc", "documents", "doc_id", "text"), ("image_limit", "pages", "page_id", "html"), ("page_frames", "pages", "page_id", "html")])
def test_a_querys_own_function_gets_few_long_rows_at_once(spark, tmp_path, monkeypatch, name, source, key, text):
    import functools

    from pyspark.sql import functions

    from folimetry.plans import catalogue

    folder, real, n, size = tmp_path / "seen", functions.pandas_udf, 600, 1 << 16
    folder.mkdir()

    def spying(kind):
        def decorate(function):
            @functools.wraps(function)
            def spied(*columns):
                with open(f"{folder}/{os.getpid()}", "a") as f:
                    print(len(columns[0]), sum(map(len, columns[0])), file=f)
                return function(*columns)

            return real(kind)(spied)

        return decorate

    session = spark.newSession()
    session.range(0, n, 1, 1).select(F.col("id").alias(key), F.repeat(F.lit("x"), size).alias(text)).write.parquet(f"{tmp_path}/{source}.parquet")
    monkeypatch.setattr(functions, "pandas_udf", spying)
    assert len(catalogue.queries()[name](session, str(tmp_path)).collect()) == n
    seen = [tuple(map(int, line.split())) for path in folder.iterdir() for line in path.read_text().splitlines()]
    assert sum(rows for rows, _ in seen) == n and n * size <= sum(taken for _, taken in seen)
    assert max(taken for _, taken in seen) <= catalogue.BATCH_BYTES + 2 * size

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenloom.functions import kernels as K
from lumenloom.functions.hashing import uniform
from lumenloom.operators import algebra, batching, buckets, evaluate, filters, skew
from lumenloom.plans import prepare
from lumenloom.sources import readers, sinks
from lumenloom.streaming import telemetry


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def _doubles(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_buckets(spark):
    assert buckets.parse_sizes("256x256,336x192") == {1: (256, 256), 2: (336, 192)}
    assert buckets.parse_pairs("[(1, 2), 3, [4, 5]]", 10) == {11: (1, 2), 13: (4, 5)}
    assert buckets.parse_pairs("1,2 3,4") == {1: (1, 2), 2: (3, 4)}
    for wrong in ("", "1,2,3", "[", "[5]"):
        with pytest.raises(ValueError):
            buckets.parse_pairs(wrong)
    with pytest.raises(ValueError):
        buckets.usable({1: (5, 0)})
    near = lambda w, h: _one(spark, buckets.nearest(F.lit(w), F.lit(h), {7: (2, 1), 3: (1, 1), 5: (4, 2), 9: (3, 0)})["bucket_id"])
    assert near(100, 50) == 7  # as near as bucket 5, but listed first
    assert near(10, 11) == 3
    assert near(0, 5) is None


def test_filters_at_their_limits(spark):
    rows = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.6), (4, 0.61), (5, 0.0)], "i int, p double")
    kept = lambda rule: [r[0] for r in rows.where(~rule).orderBy("i").collect()]
    assert kept(filters.watermark_drop(rows, "p", 0.6)) == [1, 2, 3, 5]
    assert kept(filters.score_drop(F.col("p"), 0.6)) == [1, 2, 3, 4]
    marks = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, p boolean")
    assert [r[0] for r in marks.where(~filters.watermark_drop(marks, "p", 0.6)).orderBy("i").collect()] == [2, 3]
    assert marks.where(~filters.watermark_drop(marks, "p", 1.0)).count() == 3
    captions = spark.createDataFrame([(1, ["one"]), (2, ["one", "two words"]), (3, []), (4, None), (5, ["w " * 900])], "i int, c array<string>")
    assert [tuple(r) for r in captions.select("i", filters.too_short(F.col("c")), filters.too_long(F.col("c"))).orderBy("i").collect()] == [(1, True, False), (2, False, False), (3, True, False), (4, True, False), (5, False, True)]


def test_first_reason_wins(spark):
    raw = spark.createDataFrame(
        [(1, "two words", "en", 10, 10, 1.0, 0.9, 5), (2, "two words", "zh", 10, 10, 1.0, 0.9, 5), (3, "two words", None, 300, 300, 9.0, 0.9, 5), (4, "x", "zh", 300, 300, 1.0, 0.0, 5), (5, "two words", "zh", 1, 1, 9.0, None, 5)],
        "k int, caption string, lang string, width int, height int, aesthetic_score double, pwatermark double, drop_reasons int",
    )
    limits = prepare.Limits(language_probability=1.0, least_score=5.0)
    out = prepare.prepared(raw, "k", ["caption", "absent"], {1: (256, 256)}, limits)
    assert {r["k"]: r["drop_reason"] for r in out.collect()} == {1: "language", 2: "resolution", 3: "watermark", 4: "caption", 5: None}
    assert [tuple(r) for r in prepare.survivors(out, "k").collect()] == [(5, ["Two words"], 1)]
    assert prepare.survivors(out.limit(0), "k").count() == 0


def test_caption_kinds(spark):
    chat = "array<struct<speaker: string, turn_value: string>>"
    raw = spark.createDataFrame([(1, "s", ["a", None], [("h", "q"), ("m", "r")], ("c", "e")), (2, None, None, [("h", "q")], (None, "e")), (3, None, None, None, None)], f"k int, s string, l array<string>, h {chat}, j struct<caption: string, captionEn: string>")
    got = {r[0]: r[1] for r in raw.select("k", prepare.caption_list(raw, ["s", "l", "h", "j"], None)).collect()}
    assert got == {1: ["s", "a", "r", "c"], 2: ["e"], 3: []}


def test_positions_and_places(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 3).alias("g")).repartition(5)
    got = algebra.with_position(rows, "k").orderBy("k").collect()
    assert [r["pos"] for r in got] == list(range(1000))
    placed = algebra.place_in_group(algebra.with_position(rows, "k"), ["g"], "pos", step=64).orderBy("pos").collect()
    seen = {}
    for r in placed:
        assert r["place"] == seen.get(r["g"], 0)
        seen[r["g"]] = r["place"] + 1
    assert algebra.with_position(rows.limit(0), "k").count() == 0


def test_first_of_each_takes_nulls_as_equal(spark):
    rows = spark.createDataFrame([(3, None, "x"), (1, None, "y"), (2, "a", "z"), (5, "a", "w")], "o int, k string, v string")
    assert sorted(tuple(r) for r in algebra.first_of_each(rows, ["k"], "o").collect()) == [(1, None, "y"), (2, "a", "z")]


def test_mix_spec():
    assert [(e.path, e.weight, e.alias) for e in algebra.parse_mix("data/a")] == [("data/a", 1.0, "a")]
    assert [round(e.weight, 9) for e in algebra.parse_mix("a:2 b:2 c:1")] == [0.4, 0.4, 0.2]
    for wrong in ("", "  ", "a:x", "a:0", "a:-0.5", "a:nan"):
        with pytest.raises(ValueError):
            algebra.parse_mix(wrong)


def test_ranks_are_disjoint_and_batches_pure(spark):
    rows = spark.range(70).select(F.col("id").alias("pos"), (F.col("id") % 7 + 1).alias("bucket"))
    whole = batching.batches(rows, ["bucket"], "pos", 4)
    assert whole.groupBy("bucket", "batch_no").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (4, 4, 14)
    assert batching.epoch_length(rows, ["bucket"], 4).first()[0] == 14
    assert batching.batches(rows, ["bucket"], "pos", 4, drop_last=False).count() == 70
    parts = [{r[0] for r in batching.shard(rows, "pos", 2, k).collect()} for k in range(2)]
    assert not parts[0] & parts[1] and len(parts[0] | parts[1]) == 70


def test_weighted_schedule_is_the_sequential_one(spark):
    counts = spark.createDataFrame([(0, 2), (1, 4), (2, 0), (None, 3)], "dataset_id int, n_batches long")
    weights = spark.createDataFrame([(7, 0, 0.5), (7, 1, 0.5), (7, 2, 9.0), (8, 1, 1.0), (9, 2, 1.0), (9, 0, 0.0)], "mix_id int, dataset_id int, weight double")
    got = {(r[0], r[1]): tuple(r)[2:] for r in batching.weighted_schedule(counts, weights).collect()}
    assert {k[0] for k in got} == {7, 8} and len(got) == 18  # nine slots for each mix that has a source
    u = {(r[0], r[1]): r[2] for r in spark.range(9).join(spark.createDataFrame([(7,), (8,)], "m int")).select("m", "id", uniform(F.concat_ws(":", F.col("m").cast("string"), F.col("id").cast("string")), 42)).collect()}
    for mix in (7, 8):
        taken, order = {0: 0, 1: 0}, {}
        for slot in range(9):
            source = 1 if mix == 8 or u[mix, slot] >= 0.5 else 0
            n = (2, 4)[source]
            s, pass_no, batch = got[mix, slot]
            assert (s, pass_no) == (source, taken[source] // n)
            order.setdefault((source, pass_no), []).append(batch)
            taken[source] += 1
        for (source, _), batches in order.items():  # a pass takes each batch once
            assert len(set(batches)) == len(batches) and set(batches) <= set(range((2, 4)[source]))
    many = spark.createDataFrame([(0, 40), (1, 400)], "dataset_id int, n_batches long")
    orders = {}
    for r in batching.weighted_schedule(many, spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.1)], "mix_id int, dataset_id int, weight double")).orderBy("slot").collect():
        orders.setdefault((r["dataset_id"], r["pass_no"]), []).append(r["batch_no"])
    assert sorted(orders[0, 0]) == sorted(orders[0, 1]) == list(range(40)) and orders[0, 0] != orders[0, 1]
    assert batching.weighted_schedule(counts.limit(0), weights).count() == 0


def test_epochs_shuffle_rows_and_batches(spark):
    rows = spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("bucket"))
    epochs = [{r["row_id"]: (r["bucket"], r["batch_no"]) for r in batching.epoch_batches(rows, ["bucket"], "row_id", 8, e).collect()} for e in (0, 1)]
    assert epochs[0] != epochs[1] and all(len(e) == 3 * 32 for e in epochs)
    again = {r["row_id"]: (r["bucket"], r["batch_no"]) for r in batching.epoch_batches(rows.repartition(5), ["bucket"], "row_id", 8, 0).collect()}
    assert again == epochs[0]
    assert batching.epoch_batches(rows, ["bucket"], "row_id", 8, 0, drop_last=False).count() == 100
    batches = batching.epoch_batches(rows, ["bucket"], "row_id", 8, 0).select("bucket", "batch_no").distinct()
    orders = [[tuple(r)[:2] for r in batching.batch_order(batches, ["bucket", "batch_no"], e).orderBy("order_no").collect()] for e in (0, 1)]
    assert orders[0] != orders[1] and set(orders[0]) == set(orders[1])
    lists = batching.index_lists(rows.withColumnRenamed("row_id", "pos"), "bucket", "pos", size=10).orderBy("bucket", "part_no").collect()
    assert [len(r["positions"]) for r in lists] == [10, 10, 10, 4, 10, 10, 10, 3, 10, 10, 10, 3] and lists[0]["positions"][:2] == [0, 3]


def test_dropout_keeps_one(spark):
    rows = spark.range(40).select("id", F.floor(F.col("id") / 4).alias("b"))
    gone = batching.keep_one_per_batch(rows, ["b"], "id", 1.0)
    assert gone.where("not dropped").groupBy("b").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (1, 1, 10)


def test_kernels(spark):
    assert _one(spark, K.resolution_shift(F.lit(32), F.lit(32))) == 1.0
    assert _one(spark, K.resolution_shift(F.lit(128), F.lit(128))) == 3.0
    x = _doubles([1, 2])
    times = F.array(*[F.lit(i / 100) for i in range(101)])
    assert _one(spark, K.solve(x, lambda z, t: F.transform(z, lambda v: F.lit(3.0)), times)) == pytest.approx([4, 5])
    assert _one(spark, K.solve(x, lambda z, t: F.transform(z, lambda v: -v), times, "heun")) == pytest.approx([math.exp(-1), 2 * math.exp(-1)], rel=1e-4)
    with pytest.raises(ValueError):
        K.solve(x, lambda z, t: z, times, "midpoint")
    p = _one(spark, K.caption_weights(_doubles([10, 20, 90]), 1.0))
    assert sum(p) == pytest.approx(1) and p[0] < p[1] < p[2] and p == pytest.approx([0.147541, 0.163934, 0.688525], abs=1e-6)
    assert _one(spark, K.caption_weights(_doubles([0, 0]), 1.0)) == [0.5, 0.5]
    assert [_one(spark, K.pick(_doubles([0.2, 0.3, 0.5]), F.lit(u))) for u in (0.0, 0.2, 0.49, 0.5, 0.9999999)] == [0, 1, 1, 2, 2]
    rate = [r[0] for r in spark.range(3).select(K.learning_rate(F.col("id") * 50, 50, 100, 0.1, 1.0)).collect()]
    assert rate == pytest.approx([1e-6, 1.0, 0.1])
    assert _one(spark, K.padded(_doubles([1]), F.lit(3), F.lit(0.0))) == [1, 0, 0]
    assert _one(spark, K.masked_mean(_doubles([1, 2, 9]), _doubles([1, 1, 0]))) == 1.5
    assert _one(spark, K.masked_mean(_doubles([1, 2]), _doubles([0, 0]))) == 0
    assert _one(spark, K.rotate(_doubles([1, 0]), _doubles([math.pi / 2]))) == pytest.approx([0, 1], abs=1e-9)
    assert _one(spark, K.sane_side(F.lit(70))) == 64
    assert _one(spark, K.guided(_doubles([2]), _doubles([1]), 1.0)) == [2]
    assert _one(spark, K.guided(_doubles([2]), _doubles([1]), 3.0)) == [4]


def test_evaluation(spark):
    random = np.random.default_rng(0)
    a, b = random.normal(size=(60, 4)), random.normal(0.5, 2, size=(50, 4))
    frame = lambda x: spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>")
    n, mean, cov = evaluate.gaussian(frame(a), "v")
    assert n == 60 and mean == pytest.approx(a.mean(0)) and cov == pytest.approx(np.cov(a.T))
    assert evaluate.frechet_distance((n, mean, cov), (n, mean, cov)) == pytest.approx(0, abs=1e-6)
    k = lambda x, y: (x @ y.T / 4 + 1) ** 3
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    want = off(k(a, a)) + off(k(b, b)) - 2 * k(a, b).mean()
    assert evaluate.kernel_distance(frame(a), frame(b), "v").first()[0] == pytest.approx(want)
    assert evaluate.kernel_distance(frame(a[:1]), frame(b), "v").first()[0] is None
    assert evaluate.rotating_window(400, 16, 16) == (0, 16) and evaluate.rotating_window(401, 116, 16) == (1, 17)
    assert evaluate.spaced_steps(50, 10)[-1] == 49 and evaluate.spaced_steps(3, 10) == [0, 1, 2]
    chunks = spark.range(4).select(evaluate.contiguous_chunk(F.col("id"), F.lit(4), 3)).collect()
    assert [r[0] for r in chunks] == [0, 0, 1, 1]


def test_skew(spark):
    many = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1), (3, 3)], "k int, v int")
    one = spark.createDataFrame([(1, 50, "a"), (2, 1, "b"), (None, 1, "n")], "k int, n int, w string")
    for hot in (1, 8):
        got = skew.join_hot_keys_apart(many, one, ["k"], "n", rows=hot)
        assert got.count() == 51 and got.where("w = 'a'").count() == 50
        assert skew.join_hot_keys_apart(many, one, ["k"], "n", how="left", rows=hot).count() == 53
    names = spark.createDataFrame([(1, 50, "a"), (1, 50, "b"), (2, 1, "c"), (9, 1, "d")], "k int, n int, w string")
    for rows in (7, 100):
        met = skew.join_members(many.join(one.select("k", "n"), "k"), names, ["k"], "n", "v", rows=rows)
        assert met.columns == ["k", "v", "w"] and met.count() == 101 and met.distinct().count() == 101
    right = spark.createDataFrame([(1, 10), (1, 20), (4, 1)], "k int, s int")
    joined = skew.eager_join_aggregate(many, right, "k", {"v_sum": F.sum("v")}, {"s_sum": F.sum("s")}).collect()
    plain = many.join(right, "k").groupBy("k").agg(F.count("*"), F.sum("v"), F.sum("s")).collect()
    assert [(r["k"], r["joined_rows"], r["joined_v_sum"], r["joined_s_sum"]) for r in joined] == [tuple(r) for r in plain]
    assert skew.eager_join_aggregate(many.limit(0), right, "k", {"v_sum": F.sum("v")}, {}).count() == 0
    assert [tuple(r) for r in skew.heavy_keys(many, "k", 0.05).collect()] == [(1, 50)]
    total = skew.salted_aggregate(many, ["k"], {"p": F.collect_set("v")}, {"n": F.sum(F.size("p"))}, salts=4)
    assert {r["k"]: r["n"] for r in total.collect()} == {1: 50, 2: 1, 3: 1, None: 1}


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.range(5).select("id", (F.col("id") % 2).alias("g"))
    sinks.save(rows, str(tmp_path / "t"), by="g")
    assert readers.dataset(spark, str(tmp_path / "t")).count() == 5
    assert readers.dataset(spark, str(tmp_path / "none"), {str(tmp_path / "none"): str(tmp_path / "t")}).count() == 5
    sinks.save_metrics(rows.agg(F.count("*").alias("n")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()[0] == 5
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 10
    assert readers.discover(spark, str(tmp_path / "t"), "*.parquet").count() >= 2
    assert readers.split_head(rows, "id", "train[:2]").count() == 2 and readers.split_head(rows, "id", "train").count() == 5
    assert readers.field_list(["a, b", "", "c,"]) == ["a", "b", "c"]
    assert readers.json_argument('{"a": 1}') == {"a": 1}
    assert readers.channel_constants({}, 2) == ([0.0, 0.0], [1.0, 1.0])
    assert sinks.isolated(["1", "x"], int) == [("1", 1, None), ("x", None, "ValueError: invalid literal for int() with base 10: 'x'")]
    urls = spark.createDataFrame([("ok",), ("bad",), ("none",)], "url string")
    assert {r["url"]: r["status"] for r in readers.fetched(urls, "url", lambda u: {"ok": b"x", "none": None}[u]).collect()} == {"ok": "ok", "bad": "error", "none": "invalid"}
    assert [r[0] for r in readers.pending(rows, rows.where("id < 3"), "id").orderBy("id").collect()] == [3, 4]


def test_streams_equal_tables(spark, tmp_path):
    log = spark.createDataFrame([("r", s, s % 2, 4, float(s), s) for s in range(300)], "run_name string, train_step long, dataset_id int, n_samples int, loss double, sec long")
    log = log.withColumn("logged_at", F.timestamp_seconds("sec"))
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    run = telemetry.interval_counts_stream(stream, 125).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    run.awaitTermination()
    want = telemetry.interval_counts(log, 125).drop("ratio")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))
    ema = telemetry.running_average(log, 0.9).orderBy("train_step").collect()
    e = None
    for r in ema:
        e = r["loss"] if e is None else 0.9 * e + 0.1 * r["loss"]
        assert r["ema"] == pytest.approx(e, rel=1e-9)
    one = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "log"))
    run = telemetry.running_average_stream(one, 0.9).writeStream.outputMode("append").format("memory").queryName("ema").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("ema").orderBy(F.col("train_step").desc()).first()["ema"] == pytest.approx(e)


def test_windows_of_event_time(spark, tmp_path):
    log = spark.createDataFrame([(i * 600, i % 2, 3) for i in range(60)], "sec long, dataset_id int, n_samples int").withColumn("logged_at", F.timestamp_seconds("sec"))
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    counts = telemetry.windowed_counts_stream(stream, "1 hour", "2 hours")
    run = counts.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.table("windows").collect()
    assert rows and all(r["n_lines"] == 3 and r["n_samples"] == 9 for r in rows)


def test_names(spark):
    from lumenloom.functions import text as T

    assert _one(spark, T.location_parts(F.lit("hf://a/b/c/d.bin"), "hf://"))[:] == ("a/b", "c/d.bin")
    assert _one(spark, T.location_parts(F.lit("hf://a/b"), "hf://")) is None
    assert _one(spark, T.step_name(F.lit(42))) == "step_000042"
    assert [_one(spark, T.block_of(F.lit(k), "blocks")) for k in ("module.blocks.7.w", "blocks.x.w", "other.7")] == [7, None, None]


def test_fetches_end_in_a_status(spark):
    import time

    def fetch(url):
        if url == "late":
            raise TimeoutError(url)
        if url == "slow":
            time.sleep(3)
        if url == "broken":
            raise OSError(url)
        return None if url == "nothing" else url.encode()

    def decode(content):
        if content == b"text":
            raise ValueError("no picture")
        return 300, 200

    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(["late", "slow", "broken", "nothing", "text", "good", None])], "i int, url string, status string")
    got = {r["i"]: (r["status"], r["decoded_width"]) for r in readers.fetched(rows, "url", fetch, decode, seconds=1.0).collect()}
    assert got == {0: ("timeout", None), 1: ("timeout", None), 2: ("error", None), 3: ("invalid", None), 4: ("invalid", None), 5: ("ok", 300), 6: ("invalid", None)}
    assert readers.fetched(rows.limit(0), "url", fetch).count() == 0


def test_outcomes_of_fetching_and_encoding(spark):
    b = "struct<bucket_id: int>"
    rows = spark.createDataFrame(
        [(0, None, "timeout", None, None), (1, None, "error", None, None), (2, None, "invalid", None, None), (3, None, "ok", 90, 90), (4, None, "ok", 0, 90), (5, None, "resize_error", 300, 300), (6, "language", "ok", 300, 300), (7, None, "ok", 300, 300), (60, None, "ok", 300, 300), (61, None, "ok", 300, 300)],
        "pos long, drop_reason string, status string, decoded_width int, decoded_height int",
    ).withColumn("bucket", F.lit(None).cast(b))
    out = prepare.fetch_outcomes(rows, {1: (256, 256)}, 1.0)
    want = ["fetch_timeout", "fetch_error", "invalid_image", "resolution_post", "bucket_error", "bucket_error", "language", None, None, None]
    assert [r["drop_reason"] for r in out.orderBy("pos").collect()] == want

    def encode(part):
        if len(part) > 1:
            raise RuntimeError("too many")
        return [[1.0, 2.0]]

    encoded = prepare.encode_groups(out, encode, "pos")
    assert {r["pos"]: (r["drop_reason"], r["latents"]) for r in encoded.where("pos in (6, 7, 60, 61)").collect()} == {6: ("language", None), 7: (None, [1.0, 2.0]), 60: ("encode_error", None), 61: ("encode_error", None)}
    report = {(r["batch_no"], r["reason"]): r["n_rows"] for r in filters.drop_report(encoded, by=["batch_no"]).collect()}
    assert report[1, "encode_error"] == 2 and report[0, "kept"] == 1 and sum(report.values()) == 10
    assert [tuple(r) for r in prepare.ordered(encoded.where("drop_reason is null"), "pos").select("place", "pos").collect()] == [(0, 7)]


def test_solver_of_batches(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [4.0])], "i int, x array<double>")
    times = [k / 100 for k in range(101)]
    got = {r["i"]: r["solved"] for r in K.solved(rows, "x", lambda x, t: -x, times, "heun").collect()}
    assert got[1] == pytest.approx([math.exp(-1), 2 * math.exp(-1)], rel=1e-4) and got[2] is None and got[3] == pytest.approx([4 * math.exp(-1)], rel=1e-4)
    states = K.solved(rows, "x", lambda x, t: 3.0 + 0 * x, [0.0, 0.5, 1.0], lambda x, t, dt, f: x + dt * f(x, t), intermediates=True).where("i = 3").first()["solved"]
    assert states == [[4.0], [5.5], [7.0]]
    with pytest.raises(ValueError):
        K.solved(rows, "x", lambda x, t: x, [0.0, 1.0], "midpoint")


def test_wide_vectors(spark):
    random = np.random.default_rng(1)
    a, b = random.normal(size=(40, 2048)), random.normal(0.1, 1, size=(45, 2048))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    n, mean, cov = evaluate.gaussian(frame(a), "v")
    assert n == 40 and np.allclose(mean, a.mean(0)) and np.allclose(cov, np.cov(a.T))
    with pytest.raises(Exception, match="too wide"):
        evaluate.kernel_distance(frame(a), frame(b), "v")
    k = lambda x, y: (x @ y.T / 2048 + 1) ** 3
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    got = evaluate.kernel_distance_subsets(frame(a[:20]), frame(b[:20]), "i", "v", size=50, subsets=3).first()
    assert got["size"] == 20 and got["mean"] == pytest.approx(off(k(a[:20], a[:20])) + off(k(b[:20], b[:20])) - 2 * k(a[:20], b[:20]).mean()) and got["std"] == pytest.approx(0, abs=1e-12)
    assert evaluate.kernel_distance_subsets(frame(a[:1]), frame(b), "i", "v").first()["mean"] is None


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    schema = "run_name string, train_step long, dataset_id int, n_samples int"
    source, place = str(tmp_path / "log"), str(tmp_path / "state")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    counted = lambda: telemetry.interval_counts_stream(spark.readStream.schema(schema).parquet(source), 10)
    read = lambda: sorted(tuple(r) for r in telemetry.latest(spark, place, ["run_name", "interval_no", "dataset_id"], counted().schema).collect())
    write([("a", 1, 0, 5), ("a", 11, 0, 7)])
    telemetry.keep_latest(counted(), place).awaitTermination()
    assert read() == [("a", 0, 0, 5), ("a", 1, 0, 7)]
    write([("a", 2, 0, 1), ("b", 3, 1, 2)])
    telemetry.keep_latest(counted(), place).awaitTermination()  # a new query on the old folder
    assert read() == [("a", 0, 0, 6), ("a", 1, 0, 7), ("b", 0, 1, 2)]
    telemetry.keep_latest(counted(), place).awaitTermination()  # nothing new: nothing counts twice
    assert read() == [("a", 0, 0, 6), ("a", 1, 0, 7), ("b", 0, 1, 2)]


def test_shared_folder(spark):
    from lumenloom.session import shared_folder, written

    assert shared_folder(spark)
    back = written(spark.range(5).withColumn("x", F.array("id")))
    assert sorted(r["x"][0] for r in back.collect()) == [0, 1, 2, 3, 4]

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster())


def test_buckets_may_be_strict(spark):
    with pytest.raises(Exception, match="no bucket"):
        spark.range(1).select(buckets.nearest(F.lit(0), F.lit(5), {1: (2, 1)}, strict=True)).collect()

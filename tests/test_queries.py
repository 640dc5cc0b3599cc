"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import os

import duckdb
import pytest

from quantalake.plans import registry

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    return "nan" if v != v else round(v + 0.0, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        out = db.execute(SQL[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=repr)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a == b
    else:
        assert got


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from quantalake.streaming.powers import session_powers, windowed_powers

    rows = [("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:31", "a", 2.0), ("2024-01-01 00:02:00", "a", 5.0), ("2024-01-01 00:09:00", "b", 7.0)]
    batch = spark.createDataFrame(rows, "t string, k string, x double").select(F.to_timestamp("t").alias("t"), "k", "x")
    batch.write.parquet(str(tmp_path / "in"))
    for f, span in ((windowed_powers, "1 minute"), (session_powers, "1 minute")):
        want = {tuple(r) for r in f(batch, "t", ["k"], "x", 2, span, "1 minute").collect()}
        stream = f(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "t", ["k"], "x", 2, span, "1 minute")
        name = f"out_{f.__name__}"
        stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = {tuple(r) for r in spark.table(name).collect()}
        assert got <= want and len(got) >= 2  # the last window stays open


def test_sliding_stream(spark, tmp_path):
    """Panes and windows are states of one stream: what it gives are windows of the batch, all that the watermark passed."""
    from pyspark.sql import functions as F

    from quantalake.streaming.powers import sliding_powers

    rows = [(f"2024-01-01 00:{m:02d}:{s:02d}", "ab"[m % 2], float(m + s)) for m in range(40) for s in (1, 31)]
    batch = spark.createDataFrame(rows, "t string, k string, x double").select(F.to_timestamp("t").alias("t"), "k", "x")
    batch.write.parquet(str(tmp_path / "in"))
    want = {(r.k, r.start): (r.p0, r.p1) for r in sliding_powers(batch, "t", ["k"], "x", 2, "10 minutes", "2 minutes", "1 minute").collect()}
    for (k, start), (n, total) in want.items():
        own = [x for t, g, x in rows if g == k and 0 <= (__import__("datetime").datetime.fromisoformat(t) - start).total_seconds() < 600]
        assert (n, total) == (len(own), sum(own))
    stream = sliding_powers(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "t", ["k"], "x", 2, "10 minutes", "2 minutes", "1 minute")
    stream.writeStream.format("memory").queryName("sliding").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.k, r.start): (r.p0, r.p1) for r in spark.table("sliding").collect()}
    assert len(got) >= 10 and all(want[k] == v for k, v in got.items())


def test_counts_of_a_stream_survive_restarts(spark, tmp_path):
    """A batch that runs again, a stop between two runs, and bases in the middle: the quantiles are those of all rows."""
    import random

    from quantalake.operators.quantiles import quantiles
    from quantalake.streaming.values import count_values, keep_counts, stream_quantiles, value_counts

    rng, path = random.Random(3), f"file://{tmp_path}/counts"
    rows = [[(rng.choice("ab"), rng.choice([None, float(rng.randrange(9))])) for _ in range(20)] for _ in range(7)]
    frames = [spark.createDataFrame(own, "g string, x double") for own in rows]
    for number, df in enumerate(frames):
        keep_counts(df, number, ["g"], "x", path, 3)
        if number in (1, 2, 4):  # the last one before a restart runs again
            keep_counts(df, number, ["g"], "x", path, 3)
        every = spark.createDataFrame([r for own in rows[: number + 1] for r in own], "g string, x double")
        want = {(r.g, r.x): r.n for r in every.where("x is not null").groupBy("g", "x").count().toDF("g", "x", "n").collect()}
        assert {(r.g, r.x): r.times for r in value_counts(spark, path, ["g"], "x").collect()} == want
    assert {r.g: r.quantiles for r in stream_quantiles(spark, path, ["g"], "x", [1, 2, 3], 4).collect()} == {r.g: r.quantiles for r in quantiles(every, ["g"], "x", [1, 2, 3], 4).collect()}
    folder, kept = str(tmp_path / "in"), f"file://{tmp_path}/kept"
    for df in frames[:4]:
        df.coalesce(1).write.mode("append").parquet(folder)
    for more in (frames[4:], []):
        stream = spark.readStream.schema("g string, x double").option("maxFilesPerTrigger", 1).parquet(folder)
        count_values(stream, ["g"], "x", kept, 3).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        for df in more:
            df.coalesce(1).write.mode("append").parquet(folder)
    assert {(r.g, r.x): r.times for r in value_counts(spark, kept, ["g"], "x").collect()} == want


def test_json_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    from quantalake.operators import inference as I  # noqa: E741
    from quantalake.sources import tables

    df = spark.range(3).select(I.from_interval(F.col("id") * 1.0, F.col("id") - 1.0, F.col("id") + 2.0, I.CL95).alias("e"))
    kind = df.schema["e"].dataType.simpleString()
    back = df.select("e", tables.from_json(tables.to_json(F.col("e")), kind).alias("b"))
    assert all(r.e == r.b for r in back.collect())
    tables.save(df.select("e.point"), str(tmp_path / "c"), "csv")
    assert tables.load_csv(spark, str(tmp_path / "c"), "point double").count() == 3


def test_uniform_probabilities_on_ties(spark, tmp_path):
    """Prices in whole units: every other probability ends in a 5 that is rounded, and SQL scales before it rounds."""
    prices = [240979, 134593, 215273, 228827, 178821, 180011, *range(119_000, 321_000, 7)]
    path = str(tmp_path / "orders.parquet")
    spark.createDataFrame([(k, float(p)) for k, p in enumerate(prices)], "o_orderkey long, o_totalprice double").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    out = con.execute(SQL["dist_uniform"])
    names = [c[0] for c in out.description]
    assert sorted(out.fetchall()) == sorted(tuple(x) for x in QUERIES["dist_uniform"](spark, str(tmp_path)).select(*names).collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["bootstrap_basic", "bootstrap_bca", "resample_each", "bootstrap_regress", "resample_trimmed"])
def test_queries_do_not_broadcast_draws(spark, monkeypatch, name):
    """Of any number of draws: in the plan of the query, and in those of the tables that it stores."""
    from quantalake.operators import resampling

    plans = []
    monkeypatch.setattr(resampling, "stored", lambda df, _: plans.append(df) or df)
    plans.append(QUERIES[name](spark, DATA))
    found = [line for df in plans for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "idx#" in line]
    assert found and all("ShuffledHashJoin" in line for line in found)


def test_qr_of_suppliers(spark, tmp_path):
    """Line items that share a key, a supplier whose quantities are all the same, one with two line items."""
    path = str(tmp_path / "lineitem.parquet")
    rows = [(1, 5, 1, float(k % 7), 100.0 * k * k) for k in range(30)] + [(2, k, 1, 4.0, 10.0 * k) for k in range(9)] + [(3, k, 1, 1.0 + k, 5.0) for k in range(2)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double").repartition(4).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    got = QUERIES["qr_check"](spark, str(tmp_path))
    assert sorted(con.execute(SQL["qr_check"]).fetchall()) == sorted(tuple(r) for r in got.select("g", "product", "orthogonal").collect()) == [(1, True, True), (2, True, True)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_qr_shuffles_rows_once(spark):
    """A row a line item is shuffled, then a row a supplier; nothing is joined or unfolded."""
    plan = QUERIES["qr_check"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Join" not in plan and "Generate" not in plan

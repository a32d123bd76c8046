import datetime
import json
import random

from pyspark.sql import functions as F

from kelpline.plans.stream_queries import with_store
from kelpline.streaming.low_ratings import low_rating_stream
from kelpline.streaming.panels import read_reviews, run_available, windowed_counts
from kelpline.streaming.upsert import distinct_within, keep_best, merge_best

SCHEMA = "asin string, timestamp long"


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    day = 86_400_000
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"asin": "a", "timestamp": (k * 40 + i) * day}) for i in range(4)))
        rows = read_reviews(spark, str(src), SCHEMA).withColumn("at", F.timestamp_millis("timestamp"))
        run_available(windowed_counts(rows, "at", ["asin"]), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r["n"] for r in got) == 8 and {r["asin"] for r in got} == {"a"}


def low_by_definition(rows, complete):
    """unit, month of low ratings with six months between them, from all rows at once."""
    months = {}
    for unit, at, rating in rows:
        mi = at.year * 12 + at.month - 1
        n, stars = months.setdefault(unit, {}).get(mi, (0, 0))
        months[unit][mi] = n + 1, stars + rating
    out = []
    for unit, own in months.items():
        fired = None
        for mi in sorted(own):
            n, stars = own[mi]
            year = [own[m] for m in range(mi - 12, mi) if m in own]
            total, sums = sum(a for a, _ in year), sum(b for _, b in year)
            if n >= 10 and total >= 30 and min(own) + 12 <= mi <= complete - 3 and stars / n <= sums / total - 0.3 and (fired is None or mi - fired >= 6):
                out.append((unit, mi))
                fired = mi
    return sorted(out)


def test_low_ratings_of_a_stream_that_stops_and_has_late_rows(spark, tmp_path):
    """Files of five months each, a tenth of the rows a file late; the query is stopped after each file and goes on from its checkpoint."""
    draw, first = random.Random(4), datetime.date(1999, 1, 1)
    rows = []
    for unit in ("a", "b", "c"):
        for day in range(0, 1000):
            low = draw.random() < 0.6 and (day // 30) % (7 if unit == "a" else 4) == 3
            rows += [(unit, first + datetime.timedelta(days=day), draw.choice([1, 2, 3]) if low else draw.choice([4, 5])) for _ in range(1 if unit != "c" else 2)]
    src = tmp_path / "in"
    src.mkdir()
    files = {}
    for r in rows:
        own = (r[1] - first).days // 150
        files.setdefault(own + (draw.random() < 0.1 and (r[1] - first).days % 150 > 120), []).append(r)
    complete = 2001 * 12 + 11
    for k in sorted(files):
        spark.createDataFrame(files[k], "unit string, day date, rating int").select("unit", F.col("day").cast("timestamp").alias("at"), "rating").coalesce(1).write.parquet(str(src / f"f{k}"))
        stream = spark.readStream.schema("unit string, at timestamp, rating int").parquet(str(src / "f*"))
        with_store(spark, lambda stream=stream: run_available(low_rating_stream(stream, complete), str(tmp_path / "out"), str(tmp_path / "check")))
    end = first + datetime.timedelta(days=2000)  # a row far ahead closes all months
    spark.createDataFrame([("z", end, 5)], "unit string, day date, rating int").select("unit", F.col("day").cast("timestamp").alias("at"), "rating").write.parquet(str(src / "f99"))
    stream = spark.readStream.schema("unit string, at timestamp, rating int").parquet(str(src / "f*"))
    with_store(spark, lambda: run_available(low_rating_stream(stream, complete), str(tmp_path / "out"), str(tmp_path / "check")))
    got = sorted(map(tuple, spark.read.schema("unit string, m0 int").parquet(str(tmp_path / "out")).collect()))
    assert got == low_by_definition(rows, complete) and len(got) > 5


def test_the_best_row_of_each_key_is_kept_whatever_runs_again(spark, tmp_path):
    src, table, order = tmp_path / "in", str(tmp_path / "table"), lambda: [F.col("n").desc(), F.col("id")]
    src.mkdir()
    draw = random.Random(3)
    rows = [(i, draw.choice("abcdefgh") if i % 3 else "hot", draw.randrange(6)) for i in range(300)] + [(300, None, 1), (301, None, 2)]
    for k in range(3):
        part = rows[k::3]
        (src / f"{k}.json").write_text("\n".join(json.dumps({"id": i, "key": key, "n": n}) for i, key, n in part))
        stream = read_reviews(spark, str(src), "id long, key string, n long")
        keep_best(stream, table, str(tmp_path / "one"), ["key"], order, buckets=4)
    want = sorted(((key, *min((-n, i) for i, k, n in rows if k == key)[::-1]) for key in {r[1] for r in rows}), key=str)
    read = lambda: sorted(((r["key"], r["id"], -r["n"]) for r in spark.read.schema("id long, key string, n long, bucket int").parquet(table).collect()), key=str)
    assert read() == want
    keep_best(read_reviews(spark, str(src), "id long, key string, n long", 1), table, str(tmp_path / "two"), ["key"], order, buckets=4)  # the same files once more, one a batch
    merge_best(spark.createDataFrame([rows[0]], "id long, key string, n long"), table, ["key"], order, buckets=4)
    merge_best(spark.createDataFrame([], "id long, key string, n long"), table, ["key"], order, buckets=4)
    assert read() == want


def test_repeats_within_a_watermark(spark, tmp_path):
    (tmp_path / "in").mkdir()
    day = 86_400_000
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"asin": a, "timestamp": t * day}) for a, t in [("a", 1), ("a", 1), ("b", 2), ("a", 3)]))
    rows = read_reviews(spark, str(tmp_path / "in"), SCHEMA).withColumn("at", F.timestamp_millis("timestamp"))
    run_available(distinct_within(rows, "at", ["asin"], "10 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r["asin"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]

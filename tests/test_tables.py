"""Sources, cleaning steps, feature tables and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislemap.functions.text import tokenize
from aislemap.operators import clean, describe, features
from aislemap.plans.profiles import PROFILES, clean_listings
from aislemap.session import materialise
from aislemap.sources import listings as io

SCHEMA = "listing_id bigint, title string, description string, price string, seller string, division string, category string, subcategory string, cluster int"


def listings(spark, n=40):
    rows = [
        (i, f"red lamp {i % 3}", "a bright lamp\nfor the desk", f"{10 + i},5", "shop" if i % 7 else None, "home", "lamps", None if i % 5 else "desk lamps", i % 4 - 1)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "raw")
    listings(spark).drop("listing_id", "subcategory", "cluster").coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    df = io.read_listings(spark, path)
    assert df.count() == 40 and "subcategory" not in df.columns
    assert df.select("listing_id").distinct().count() == 40
    filled = clean.backfill_subcategory(df)
    assert filled.where("subcategory = 'lamps'").count() == 40
    assert df.where(F.col("description").contains("\n")).count() == 40


def test_missing_results_raise(spark, tmp_path):
    with pytest.raises(io.MissingResult):
        io.read_assignments(spark, str(tmp_path / "none"))
    with pytest.raises(io.MissingResult):
        io.read_vectors(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("name", ["kmeans", "bertopic", "shared"])
def test_profiles(spark, name):
    out = clean_listings(listings(spark), name, min_rows=10)
    profile = PROFILES[name]
    assert ("category" in out.columns) != profile.drop_category
    assert ("text_features" in out.columns) == profile.text_features
    # 8 rows have their own subcategory, too few to keep; missing sellers go where fields are required
    want = 32 - len([i for i in range(40) if i % 5 and i % 7 == 0]) if profile.require_fields else 30
    assert out.count() == want


def test_validation(spark):
    ok = spark.createDataFrame([(i, 1.0, "t", "s", i % 2) for i in range(10)], "i int, price double, title string, subcategory string, cluster int")
    assert clean.validate_assignments(ok).count() == 0
    issues = {r["issue"] for r in clean.validate_assignments(ok.drop("price").withColumn("cluster", F.lit(1))).collect()}
    assert issues == {"missing_column_price", "too_few_clusters"}
    assert {r["issue"] for r in clean.validate_assignments(ok.drop("cluster")).collect()} == {"missing_column_cluster"}


def test_vectors_agree_with_long_form(spark):
    df = spark.createDataFrame(
        [(i, f"red lamp number{i % 4}", f"bright light for room{i % 3} and desk", float(10 + i * i), f"s{i % 2}") for i in range(24)],
        "listing_id bigint, title string, description string, price double, seller string",
    )
    small = {"ngram": (1, 2), "min_df": 2, "max_features": 500}
    long = features.listing_features(df, title=small, description=small, min_seller_rows=5)
    rows, vocab = features.feature_vectors(df, title=small, description=small, min_seller_rows=5)
    assert "red lamp" in vocab
    want = {r["listing_id"]: (r["n"], r["s"], r["q"]) for r in long.groupBy("listing_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q")).collect()}
    for r in rows.collect():
        v = r["features"].toArray()
        n, s, q = want[r["listing_id"]]
        assert (np.abs(v) > 0).sum() == n and v.sum() == pytest.approx(s) and (v**2).sum() == pytest.approx(q)


def test_encoder_hook(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "listing_id bigint, title string")

    def encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    got = {r["listing_id"]: r["vec"] for r in features.embed_text(df, "title", encoder).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0]}


def test_embedded_rows_are_dealt_by_their_size(spark, monkeypatch):
    from aislemap import session
    from aislemap.operators import vectors

    # equal texts, whose stored rows are far smaller than those in memory
    df = spark.range(4000).select(F.col("id").alias("listing_id"), F.concat(F.lit("red lamp "), F.col("id") % 5).alias("title"))
    parts, svd = [], vectors.truncated_svd
    monkeypatch.setattr(vectors, "truncated_svd", lambda rows, *a, **k: parts.append(rows.rdd.getNumPartitions()) or svd(rows, *a, **k))
    whole = {r["listing_id"]: r["vec"] for r in features.embed_text(df, "title", dims=2).collect()}
    monkeypatch.setattr(session, "PART_BYTES", 1 << 14)
    dealt = {r["listing_id"]: r["vec"] for r in features.embed_text(df, "title", dims=2).collect()}
    assert parts[0] <= 8 and parts[1] >= 4000 * 88 // (1 << 14)
    assert whole.keys() == dealt.keys() and all(np.allclose(whole[i], dealt[i]) for i in whole)


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = describe.cluster_first_titles(listings(spark), 5)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "WindowGroupLimit" in plan


def test_grids_have_no_cross_join(spark):
    df = materialise(listings(spark).withColumn("subcategory", F.coalesce("subcategory", "category")))
    for out in (describe.crosstab_row_pct(df, "cluster", "subcategory"), describe.heatmap_top(df), describe.seller_share(df)):
        text = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_column_functions_work_on_streams(spark, tmp_path):
    from aislemap.functions.price import clean_price_decimal_comma

    path = str(tmp_path / "in")
    listings(spark).write.parquet(path)
    stream = spark.readStream.schema(SCHEMA).parquet(path).select(clean_price_decimal_comma("price").alias("price"), tokenize("title").alias("t"))
    q = stream.writeStream.format("memory").queryName("cleaned_stream").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cleaned_stream").where("price is not null").count() == 40

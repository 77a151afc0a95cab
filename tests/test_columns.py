"""Column functions on hand-made values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislemap.functions import maths, price, text


def values(spark, inputs, expr):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r["o"] for r in df.select("i", expr("v").alias("o")).orderBy("i").collect()]


def test_price_decimal_comma(spark):
    got = values(spark, ["12,50", "1 299,00", "€5", "1,234.50", "1d", None, "nan", "inf", "-3", "1e2"], price.clean_price_decimal_comma)
    assert got == [12.5, 1299.0, None, None, None, None, None, None, -3.0, 100.0]


def test_price_currency(spark):
    assert values(spark, ["€1,234.50", "12,50", "€5", "1 299,00"], price.clean_price_currency) == [1234.5, 1250.0, 5.0, None]


def test_language(spark):
    assert values(spark, ["Dėklas", "case", "", None], text.tag_language) == ["lt", "en", "en", "en"]


def test_measurements(spark):
    assert values(spark, ["15.6 inch", "10 inches"], text.norm_inches) == ["15_6in", "10ines"]
    assert values(spark, ["10x20x30", "3x4"], text.norm_dimensions) == ["dim_10_2030", "dim_3_4"]
    got = values(spark, ["256 gb", "64gb", "8 mb", "1tb", "0129gb", "33 gb", "128gb", "x12864gb"], text.norm_storage)
    assert got == ["storage_large", "storage_medium", "storage_small", "storage_small", "storage_large", "storage_medium", "storage_medium", "xstorage_large"]


def test_terms(spark):
    got = values(spark, ["brand new", "genuine leather", "water resistant"], text.norm_terms)
    assert got == ["new", "original leather", "waterproof"]


def test_basic_and_robust(spark):
    assert values(spark, ["  Žalia, ĄČĘ!  (x-y) ", None], text.basic_preprocess) == ["žalia ąčę x-y", ""]
    assert values(spark, ["The Cover for 64 GB phone"], text.robust_preprocess) == ["case storage_medium phone"]
    assert values(spark, ["Dėklas ir dangtis"], text.robust_preprocess) == ["case dangtis"]


def test_text_features(spark):
    df = spark.createDataFrame([("Lamp", "Shop", 60.0, "a  b\n c d e f g"), ("Lamp", None, None, "short")], "title string, seller string, price double, description string")
    got = [r[0] for r in df.select(text.text_features()).collect()]
    assert got == ["Lamp Seller: Shop medium price a b c d e f g", "Lamp"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(text.ngrams("t", 1, 3)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_log_gamma(spark):
    xs = [0.5, 1.0, 2.0, 3.5, 10.0, 1000.0, 1e8]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(maths.log_gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-13, atol=1e-12)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_exact_quantiles(spark, by):
    from aislemap.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    v = np.round(np.concatenate([rng.normal(0, 50, 500), [0.0, -7.0, 3.0, 3.0, 3.0]]), 2)
    g = rng.integers(0, 3, len(v))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)] + [(0, None)], "g int, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]
    for r in exact_quantiles(df, "v", probs, by).collect():
        part = v[g == r["g"]] if by else v
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], np.quantile(part, probs), rtol=1e-12)


def test_word_characters_as_in_python(spark):
    import re

    texts = ["25 m² box, 5½ in, 10³ pcs", "café dėklas_x brand-new", "Ⅷ the²end the", "naïve—x٣y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", text.tokenize("t").alias("tokens"), text.basic_preprocess("t").alias("plain"), text.remove_stopwords_by_lang(F.col("t"), F.lit("en")).alias("kept")).collect()
    for r in rows:
        low = r["t"].lower()
        assert r["tokens"] == re.findall(r"\b\w\w+\b", low)
        assert r["plain"] == re.sub(r"\s+", " ", re.sub(r"[^\w\s-]", " ", low)).strip()
        assert r["kept"] == re.sub(r"\b(?:" + "|".join(text.ENGLISH_STOPWORDS_SHORT) + r")\b", " ", r["t"])


def test_searches_that_spare_replacements_miss_none(spark):
    samples = ["3.5 inch", '5"', "5　in", "12x30", "1×2×3 x4", "64 gb", "٣mb", "in 5", "x4 5x", "the case", "", "129tb and 2in by 4 X 5"]
    chain = values(spark, samples, lambda c: text.norm_storage(text.norm_dimensions(text.norm_inches(c))))
    assert values(spark, samples, text.norm_measures) == chain
    # a term that only another rule makes, and none inside words
    samples = ["silicon shell", "water proof cm", "inchworm", "x_cm", "re-inch", "cordless²", "plain words", None]
    assert values(spark, samples, text.norm_terms) == ["silicone case", "waterproof cm", "inchworm", "x_cm", "re-in", "cordless²", "plain words", None]
    # what stands before a word is looked at only where one can start
    assert text._whole_words(["the", "of|by"]).startswith("(?=[bot])")

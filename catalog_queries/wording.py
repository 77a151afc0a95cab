"""Queries for text normalisation and text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislemap.functions import text as tx
from aislemap.operators import features
from aislemap.sources.warehouse import _MEASURES, _PHRASES, messy_texts, products, texts
from catalog_queries.cleaning import cleaned
from catalog_queries.oracle import CLEAN, with_
from catalog_queries.registry import Registry
from catalog_queries.scoring import rounded

QUERIES = Registry()
query = QUERIES.query



def per_value(long, key: str, value: str):
    """Totals per term of a long feature table, which itself has millions of rows."""
    return long.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))


# ---- SQL versions of the rules: RE2 has no Unicode classes for \w and no look-behind,
# so word characters are spelled out and neighbours are captured and put back; two
# passes cover neighbours shared by adjoining matches.
W = r"\p{L}\p{N}_"


def _list_sql(options: list[str]) -> str:
    return "[" + ", ".join("'" + o + "'" for o in options) + "]"


MESSY = f"""messy AS (SELECT p_partkey AS listing_id, {_list_sql(_PHRASES)}[p_partkey % {len(_PHRASES)} + 1] || ' ' || p_name || ' ' || CAST(p_size * 7 AS VARCHAR)
|| {_list_sql(_MEASURES)}[p_partkey % {len(_MEASURES)} + 1] AS text FROM part UNION ALL SELECT -doc_id - 1, text FROM documents)"""


def sub(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def words(text: str, pattern: str, to: str) -> str:
    p = f"(^|[^{W}])(?:{pattern})($|[^{W}])"
    return sub(sub(text, p, rf"\1{to}\2"), p, rf"\1{to}\2")


def squeeze(text: str) -> str:
    return f"trim({sub(sub(text, f'[^{W}' + chr(92) + 's-]', ' '), chr(92) + 's+', ' ')})"


def inches(t: str) -> str:
    return sub(sub(t, tx.INCHES, r"\1in"), tx.INCHES_DECIMAL, r"\1_\2in")


def dims(t: str) -> str:
    return sub(t, tx.DIMENSIONS, r"dim_\1_\2\3")


def storage(t: str) -> str:
    for size, name in ((r"0*(?:129|1[3-9]\d|[2-9]\d\d|[1-9]\d{3,})", "large"), (r"0*(?:3[3-9]|[4-9]\d|1[01]\d|12[0-8])", "medium"), (r"\d+", "small")):
        p = rf"(^|[^\d])(?:{size})\s*(?:gb|tb|mb)"
        t = sub(sub(t, p, rf"\1storage_{name}"), p, rf"\1storage_{name}")
    return t


def stop(t: str, lang: str) -> str:
    return f"CASE WHEN {lang} = 'lt' THEN {words(t, '|'.join(tx.LITHUANIAN_STOPWORDS), ' ')} ELSE {words(t, '|'.join(tx.ENGLISH_STOPWORDS_SHORT), ' ')} END"


def rewrite(t: str) -> str:
    for pattern, to in tx.TERM_REWRITES:
        t = words(t, pattern, to)
    return t


def lang(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '[{tx.LITHUANIAN_LETTERS}]') THEN 'lt' ELSE 'en' END"


def _messy(name: str, expr, sql: str) -> None:
    def run(spark, sf_dir):
        return messy_texts(spark, sf_dir).select("listing_id", expr().alias("result"))

    query(name, with_(MESSY) + f"SELECT listing_id, {sql} AS result FROM messy")(run)


_messy("t1_basic_preprocess", lambda: tx.basic_preprocess("text"), squeeze("lower(text)"))
_messy("t2_tag_language", lambda: tx.tag_language("text"), lang("text"))
_messy("t3_norm_inches", lambda: tx.norm_inches(F.lower("text")), inches("lower(text)"))
_messy("t4_norm_dimensions", lambda: tx.norm_dimensions("text"), dims("text"))
_messy("t5_norm_storage", lambda: tx.norm_storage(F.lower("text")), storage("lower(text)"))
_messy("t6_remove_stopwords_by_lang", lambda: tx.remove_stopwords_by_lang(F.lower("text"), tx.tag_language("text")), stop("lower(text)", lang("text")))
_messy("t7_norm_terms", lambda: tx.norm_terms(F.lower("text")), rewrite("lower(text)"))
_messy("t8_strip_punct_squeeze", lambda: tx.strip_punct_squeeze("text"), squeeze("text"))

query("t9_robust_preprocess", with_(
    MESSY,
    f"a AS MATERIALIZED (SELECT listing_id, {lang('lower(text)')} AS lang, {storage(dims(inches('lower(text)')))} AS t FROM messy)",
    f"b AS MATERIALIZED (SELECT listing_id, {stop('t', 'lang')} AS t FROM a)",
    f"c AS MATERIALIZED (SELECT listing_id, {rewrite('t')} AS t FROM b)",
) + f"SELECT listing_id, {squeeze('t')} AS result FROM c")(
    lambda spark, sf_dir: messy_texts(spark, sf_dir).select("listing_id", tx.robust_preprocess("text").alias("result")))


@query("t10_text_features", with_(CLEAN) + r"""SELECT listing_id, concat_ws(' ', title, 'Seller: ' || seller, CASE WHEN price < 50 THEN 'low price' WHEN price < 200 THEN 'medium price' ELSE 'high price' END,
CASE WHEN length(description) > 10 THEN trim(regexp_replace(substring(description, 1, 200), '\s+', ' ', 'g')) END) AS text_features FROM clean""")
def t10(spark, sf_dir):
    return cleaned(spark, sf_dir, True).select("listing_id", tx.text_features().alias("text_features"))


_TOK = f"toks AS (SELECT doc_id AS listing_id, regexp_extract_all(lower(text), '[{W}]{{2,}}') AS t FROM documents)"


@query("t11_tokenize", with_(_TOK) + "SELECT listing_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM toks")
def t11(spark, sf_dir):
    df = texts(spark, sf_dir).select("listing_id", tx.tokenize("text").alias("t"))
    return df.select("listing_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


_STOP = "(" + ", ".join(f"'{w}'" for w in features.ENGLISH_STOPWORDS) + ")"


@query("t12_remove_english_stopwords", with_(_TOK) + f"SELECT listing_id, len(k) AS n_tokens, md5(array_to_string(k, ' ')) AS tokens_md5 FROM (SELECT listing_id, list_filter(t, lambda x: x NOT IN {_STOP}) AS k FROM toks)")
def t12(spark, sf_dir):
    df = texts(spark, sf_dir).select("listing_id", tx.remove_stopwords(tx.tokenize("text"), features.ENGLISH_STOPWORDS).alias("t"))
    return df.select("listing_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def grams_sql(source: str, low: int, high: int) -> str:
    return " UNION ALL ".join(
        f"SELECT listing_id, array_to_string(t[i:i + {n - 1}], ' ') AS term FROM (SELECT listing_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM {source})" for n in range(low, high + 1))


@query("t13_ngrams", with_(_TOK) + f"SELECT listing_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct, min(term) AS first_term, max(term) AS last_term FROM ({grams_sql('toks', 1, 5)}) GROUP BY 1")
def t13(spark, sf_dir):
    return features.run_facts(texts(spark, sf_dir), "text", (1, 5))


def vocab_sql(name: str, grams: str, min_df: int, max_features: int) -> str:
    return f"""{name}_tf AS (SELECT listing_id, term, count(*) AS tf FROM ({grams}) GROUP BY 1, 2),
{name}_vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM {name}_tf GROUP BY 1 HAVING count(*) >= {min_df} ORDER BY total DESC, term LIMIT {max_features})"""


def tfidf_sql(name: str, n_rows: str) -> str:
    return f"""{name}_raw AS (SELECT listing_id, term, tf * (ln((1 + {n_rows}) / (1 + df)) + 1) AS w FROM {name}_tf JOIN {name}_vocab USING (term)),
{name} AS (SELECT listing_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY listing_id)) AS weight FROM {name}_raw)"""


_DESC = vocab_sql("d", grams_sql("toks", 1, 5), 10, 20000)


@query("t14_vocabulary", with_(_TOK, _DESC) + "SELECT term, df, total FROM d_vocab")
def t14(spark, sf_dir):
    return features.frequent_terms(texts(spark, sf_dir), "text", (1, 5), 10, 20000)[0]


@query("t15_tfidf", with_(_TOK, _DESC, tfidf_sql("d", "(SELECT count(*) FROM documents)")) + "SELECT term, count(*) AS n, round(sum(weight), 6) AS total, round(max(weight), 6) AS largest FROM d GROUP BY 1")
def t15(spark, sf_dir):
    weights = features.tfidf_text(texts(spark, sf_dir), "text", (1, 5), 10, 20000)
    return rounded(per_value(weights, "term", "weight"))


PRODUCTS = """products AS (SELECT p_partkey AS listing_id, p_name || ' ' || p_brand AS title, text AS description, p_retailprice AS price, s_name AS seller
FROM part JOIN documents ON doc_id = p_partkey % (SELECT count(*) FROM documents) JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier))"""


def stopped(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[{W}]{{2,}}'), lambda x: x NOT IN {_STOP})"


_BOTH = "both_toks AS (SELECT listing_id, " + stopped("title || ' ' || description") + " AS t FROM products)"
_EVAL = vocab_sql("ev", grams_sql("both_toks", 1, 1), 1, 100) + "," + tfidf_sql("ev", "(SELECT count(*) FROM products)")


@query("t16_tfidf_eval", with_(PRODUCTS, _BOTH, _EVAL) + "SELECT listing_id, term, round(weight, 6) AS weight FROM ev")
def t16(spark, sf_dir):
    return rounded(features.tfidf_eval(products(spark, sf_dir)))


_Z = """m AS (SELECT avg(ln(1 + price)) AS mu, stddev_pop(ln(1 + price)) AS sp, stddev_samp(ln(1 + price)) AS ss, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM products)"""


@query("t17_combine_features", with_(
    PRODUCTS, _Z,
    "tt AS (SELECT listing_id, " + stopped("title") + " AS t FROM products)",
    f"dt AS (SELECT listing_id, regexp_extract_all(lower(description), '[{W}]{{2,}}') AS t FROM products)",
    vocab_sql("ti", grams_sql("tt", 1, 3), 5, 15000), tfidf_sql("ti", "(SELECT count(*) FROM products)"),
    vocab_sql("de", grams_sql("dt", 1, 5), 10, 20000), tfidf_sql("de", "(SELECT count(*) FROM products)"),
    "big AS (SELECT seller FROM products GROUP BY 1 HAVING count(*) >= 10)",
    """pf AS (SELECT listing_id, unnest(['price_log', 'price_low', 'price_medium', 'price_high']) AS feature, unnest([(ln(1 + price) - mu) / sp, CAST(price < q1 AS DOUBLE),
CAST(price >= q1 AND price < q3 AS DOUBLE), CAST(price >= q3 AS DOUBLE)]) AS value FROM products, m)""",
) + """SELECT feature, count(*) AS n, round(sum(value), 6) AS total, round(max(value), 6) AS largest FROM (
SELECT listing_id, 'title:' || term AS feature, weight * 1.5 AS value FROM ti UNION ALL SELECT listing_id, 'description:' || term, weight * 0.5 FROM de
UNION ALL SELECT listing_id, 'seller_' || CASE WHEN seller IN (SELECT seller FROM big) THEN seller ELSE 'other' END, CAST(1 AS DOUBLE) FROM products
UNION ALL SELECT listing_id, feature, value FROM pf WHERE value <> 0) GROUP BY 1""")
def t17(spark, sf_dir):
    return rounded(per_value(features.listing_features(products(spark, sf_dir)), "feature", "value"))


@query("e6_fallback_features", with_(PRODUCTS, _Z, _BOTH, _EVAL) + """SELECT listing_id, 'price' AS feature, round((ln(1 + price) - mu) / ss, 6) AS value, 'approximated_features' AS metrics_source FROM products, m
UNION ALL SELECT listing_id, 'term:' || term, round(weight, 6), 'approximated_features' FROM ev""")
def e6(spark, sf_dir):
    return rounded(features.fallback_features(products(spark, sf_dir)))


@query("t18_embed_text")
def t18(spark, sf_dir):
    return features.embed_text(cleaned(spark, sf_dir).select("listing_id", "title"), "title")


@query("t19_topic_words", with_(f"toks AS (SELECT ascii(lang) * 1000 + CAST(replace(source, 'src', '') AS INTEGER) - CASE WHEN source = 'src3' THEN ascii(lang) * 1000 + 4 ELSE 0 END AS cluster, unnest(regexp_extract_all(lower(text), '[{W}]{{2,}}')) AS term FROM documents)") + """,
c AS (SELECT cluster, term, count(*) AS tf FROM toks GROUP BY 1, 2), w AS (SELECT cluster, sum(tf) AS words FROM c GROUP BY 1), f AS (SELECT term, sum(tf) AS f FROM c GROUP BY 1),
s AS (SELECT cluster, term, round(CAST(tf AS DOUBLE) / words * ln(1 + (SELECT avg(words) FROM w) / f), 9) AS weight FROM c JOIN w USING (cluster) JOIN f USING (term))
SELECT cluster, term, round(weight, 6) AS weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS INTEGER) AS rank FROM s) WHERE rank <= 10 AND cluster <> -1""")
def t19(spark, sf_dir):
    # one source stands for the outliers
    topic = F.when(F.col("seller") == "src3", F.lit(-1)).otherwise(F.ascii("division") * 1000 + F.regexp_replace("seller", "src", "").cast("int"))
    return rounded(features.topic_words(texts(spark, sf_dir).withColumn("cluster", topic), "text"))

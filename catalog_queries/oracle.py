"""SQL building blocks for the DuckDB twins of the queries."""

NUMBER = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"

_OFFERS = """
offers AS (
  SELECT l_partkey, l_suppkey, (CAST(round(min(l_extendedprice) * 100) AS BIGINT) + 250) // 500 AS cents
  FROM lineitem GROUP BY l_partkey, l_suppkey
),
shown AS (
  SELECT *, CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS txt,
         (l_partkey + l_suppkey) % 20 AS style
  FROM offers
)"""

_RAW = """
raw AS (
  SELECT l_partkey * 1000000 + l_suppkey AS listing_id,
         p_name || ' ' || p_brand AS title,
         {description}
         CASE WHEN style = 0 THEN '€' || txt WHEN style = 1 THEN 'n/a' WHEN style = 2 THEN NULL
              WHEN style = 3 THEN '1,' || txt WHEN style % 2 = 0 THEN replace(txt, '.', ',') ELSE txt END AS price,
         CASE WHEN (7 * l_partkey + l_suppkey) % 97 <> 0 THEN s_name END AS seller,
         p_type AS division, p_brand AS category,
         CASE WHEN p_size % 10 <> 0 THEN p_brand || ' ' || p_name END AS subcategory,
         CAST(CASE WHEN p_size % 20 = 19 THEN -1 ELSE p_size % 20 END AS INTEGER) AS cluster
  FROM shown JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  {documents}
)"""

RAW = _OFFERS + "," + _RAW.format(
    description="d.text AS description,",
    documents="LEFT JOIN documents d ON d.doc_id = l_partkey % (SELECT count(*) FROM documents)",
)
RAW_SHORT = _OFFERS + "," + _RAW.format(description="", documents="")


def parse_price(text: str) -> str:
    return f"CASE WHEN regexp_full_match({text}, '{NUMBER}') THEN TRY_CAST({text} AS DOUBLE) END"


PRICE = parse_price("replace(replace(price, ',', '.'), ' ', '')")
PRICE_CURRENCY = parse_price("replace(replace(price, '€', ''), ',', '')")

# listings with a parsed price, backfilled subcategory and the price check done
PRICED = f"""
priced AS (
  SELECT * REPLACE ({PRICE} AS price, coalesce(subcategory, category) AS subcategory) FROM raw
  WHERE ({PRICE}) IS NOT NULL
)"""

COMPLETE = PRICED + """,
complete AS (SELECT * EXCLUDE (category) FROM priced WHERE seller IS NOT NULL AND title IS NOT NULL
  AND division IS NOT NULL AND subcategory IS NOT NULL{described}),
clean AS (SELECT * FROM complete WHERE subcategory IN
  (SELECT subcategory FROM complete GROUP BY 1 HAVING count(*) >= 30))"""

# cleaned listings, with and without the text of the description
CLEAN = RAW + "," + COMPLETE.format(described=" AND description IS NOT NULL")
CLEAN_SHORT = RAW_SHORT + "," + COMPLETE.format(described="")


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"

"""Driver tables and the listing views derived from them.

The driver's tables hold no product listings, so three views derive them:

``listings``     lineitem joined to part, one listing per line item
``raw_outputs``  model replies (text) per listing and attempt, built from ``listings``
``ledger``       crawl outcomes, built from ``events``

The view bodies are plain SQL that Spark and DuckDB both run unchanged, so a
DuckDB oracle reads exactly the same derived input as the Spark query
(``cte_sql`` renders them as a WITH prefix). They avoid backslashes (Spark
unescapes them in literals, DuckDB does not) and print numbers only through
``printf`` with a fixed format.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import short_methods

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    for name in names or TABLES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


LISTINGS_SQL = """
SELECT
  md5(concat_ws('|', CAST(l.l_orderkey AS STRING), CAST(l.l_partkey AS STRING),
      CAST(l.l_suppkey AS STRING), CAST(l.l_linenumber AS STRING),
      CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS STRING))) AS listing_key,
  l.l_partkey AS part_key,
  l.l_linenumber AS line_number,
  CASE WHEN l.l_linenumber = 7 THEN CAST(NULL AS DOUBLE) ELSE l.l_extendedprice END AS price,
  l.l_extendedprice * l.l_discount AS discount_amount,
  CASE l.l_suppkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' ELSE CAST(NULL AS STRING) END AS currency,
  p.p_brand AS brand,
  p.p_name AS model,
  split_part(p.p_name, ' ', 1) AS colour_1,
  CAST(NULL AS STRING) AS colour_2,
  CAST(NULL AS STRING) AS colour_3,
  p.p_type AS material_1,
  CASE WHEN p.p_size % 3 = 0 THEN split_part(p.p_name, ' ', 2) ELSE CAST(NULL AS STRING) END AS material_2,
  CASE l.l_returnflag WHEN 'R' THEN TRUE WHEN 'A' THEN FALSE ELSE CAST(NULL AS BOOLEAN) END AS reclining,
  l.l_discount > 0.05 AS pull_out_bed,
  l.l_linestatus = 'F' AS storage,
  CAST(l.l_quantity AS BIGINT) AS seat_number,
  CASE WHEN p.p_size % 10 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p.p_size AS DOUBLE) END AS height,
  p.p_retailprice AS width,
  l.l_tax * 100 AS depth,
  CAST(l.l_linenumber AS BIGINT) AS product_count
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""

# JSON fragments used by the reply templates. jnum/jstr/jbool print JSON literals.
def _jnum(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'null' ELSE printf('%.2f', {x}) END"


def _jstr(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'null' ELSE '\"' || {x} || '\"' END"


def _jbool(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'null' WHEN {x} THEN 'true' ELSE 'false' END"


def _jint(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'null' ELSE CAST({x} AS STRING) END"


_PRICE_TEXT = (
    "CASE WHEN price IS NULL THEN 'null' WHEN price >= 1000 THEN "
    "'\"£' || CAST(CAST(floor(price / 1000) AS BIGINT) AS STRING) || ',' || "
    "substr(printf('%.2f', price), length(printf('%.2f', price)) - 5) || '\"' "
    "ELSE '\"£' || printf('%.2f', price) || '\"' END"
)

# Template 2: the plain, well-formed object with all 20 keys.
_OBJ = (
    "'{\"price\": ' || " + _jnum("price")
    + " || ', \"discount_amount\": ' || printf('%.4f', discount_amount)"
    + " || ', \"currency\": ' || " + _jstr("currency")
    + " || ', \"brand\": ' || " + _jstr("brand")
    + " || ', \"model\": ' || " + _jstr("model")
    + " || ', \"colour_1\": ' || " + _jstr("colour_1")
    + " || ', \"colour_2\": null, \"colour_3\": null'"
    + " || ', \"material_1\": ' || " + _jstr("material_1")
    + " || ', \"material_2\": ' || " + _jstr("material_2")
    + " || ', \"reclining\": ' || " + _jbool("reclining")
    + " || ', \"pull_out_bed\": ' || " + _jbool("pull_out_bed")
    + " || ', \"storage\": ' || " + _jbool("storage")
    + " || ', \"seat_number\": ' || " + _jint("seat_number")
    + " || ', \"height\": ' || " + _jnum("height")
    + " || ', \"width\": ' || " + _jnum("width")
    + " || ', \"depth\": ' || " + _jnum("depth")
    + " || ', \"product_count\": ' || " + _jint("product_count")
    + " || ', \"additional_features\": [], \"evidence\": [\"price tag\"]}'"
)

# Template 4: trailing commas; on line 3 a non-string array element (fails validation).
_OBJ_TRAILING = (
    "'{\"price\": ' || " + _jnum("price")
    + " || ', \"currency\": ' || " + _jstr("currency")
    + " || ', \"brand\": ' || " + _jstr("brand")
    + " || ', \"model\": ' || " + _jstr("model")
    + " || ', \"colour_1\": ' || " + _jstr("colour_1")
    + " || ', \"material_1\": ' || " + _jstr("material_1")
    + " || ', \"reclining\": ' || " + _jbool("reclining")
    + " || ', \"storage\": ' || " + _jbool("storage")
    + " || ', \"seat_number\": ' || " + _jint("seat_number")
    + " || ', \"height\": ' || " + _jnum("height")
    + " || ', \"width\": ' || " + _jnum("width")
    + " || ', \"depth\": ' || " + _jnum("depth")
    + " || ', \"product_count\": ' || " + _jint("product_count")
    + " || ', \"additional_features\": [\"USB charger\", '"
    + " || CASE WHEN line_number = 3 THEN '2, ' ELSE '' END || '], }'"
)

# Template 5: values as text with currency signs, units, words; model only under "name".
_OBJ_TEXTY = (
    "'{\"price\": ' || " + _PRICE_TEXT
    + " || ', \"brand\": \"  ' || brand || '  \", \"model\": \"\", \"name\": ' || " + _jstr("model")
    + " || ', \"colour_1\": ' || " + _jstr("colour_1")
    + " || ', \"colour_3\": ' || CAST(line_number AS STRING)"
    + " || ', \"material_1\": ' || " + _jstr("material_1")
    + " || ', \"reclining\": ' || CASE WHEN reclining IS NULL THEN 'null' WHEN reclining THEN '\" Yes \"' ELSE '\"n\"' END"
    + " || ', \"pull_out_bed\": ' || CASE WHEN pull_out_bed THEN '1' ELSE '\"false\"' END"
    + " || ', \"storage\": ' || CASE WHEN storage THEN '\"1\"' ELSE '\"0\"' END"
    + " || ', \"seat_number\": \"' || CAST(seat_number AS STRING) || '-seater\"'"
    + " || ', \"height\": ' || CASE WHEN height IS NULL THEN 'null' ELSE '\"' || CAST(CAST(height AS BIGINT) AS STRING) || ' inches\"' END"
    + " || ', \"width\": \"' || printf('%.1f', width) || ' cm\"'"
    + " || ', \"depth\": \"' || printf('%.2f', depth) || 'MM\"'"
    + " || ', \"product_count\": \"' || CAST(product_count - 1 AS STRING) || ' sofas\"'"
    + " || ', \"additional_features\": \"cup holders\", \"evidence\": \"\"'"
    + " || ', \"description\": \"Shown in ' || CASE currency WHEN 'GBP' THEN '£' WHEN 'EUR' THEN '€' ELSE 'US$' END || ' incl. VAT\"}'"
)

# Template 6: attributes only under "specifications" (fallback rules), extra keys.
_OBJ_NESTED = (
    "'{\"name\": \"  ' || model || '  \", \"brand\": ' || " + _jstr("brand")
    + " || ', \"price\": ' || " + _jnum("price")
    + " || ', \"colour_1\": ' || " + _jstr("colour_1")
    + " || ', \"delivery\": \"from ' || CASE WHEN currency IS NULL THEN '$5' ELSE '£5 or €6' END || '\"'"
    + " || ', \"specifications\": {\"materials\": ' || CASE WHEN line_number % 2 = 0"
    + " THEN '\"' || material_1 || ' / ' || coalesce(material_2, 'Linen') || ' and Oak\"'"
    + " ELSE '[\" ' || material_1 || ' \", \"\", \"Wool\"]' END"
    + " || ', \"dimensions\": {\"width\": \"' || printf('%.2f', width) || ' cm\", \"depth\": ' || " + _jnum("depth")
    + " || ', \"height\": ' || CASE WHEN height IS NULL THEN 'null' ELSE '\"' || CAST(CAST(height AS BIGINT) AS STRING) || ' in\"' END || '}'"
    + " || CASE WHEN line_number % 3 = 0 THEN ', \"size\": \"' || CAST(seat_number AS STRING) || '-seater\"'"
    + " WHEN line_number % 3 = 1 THEN ', \"sofa_sizes\": [\"' || CAST(seat_number AS STRING) || ' Seater\", \"2 seater\"]'"
    + " ELSE ', \"sofa_sizes\": [], \"seater\": \"' || CAST(seat_number AS STRING) || 'seater\"' END"
    + " || '}, \"product_count\": ' || " + _jint("product_count") + " || '}'"
)

RAW_OUTPUTS_SQL = f"""
SELECT listing_key, 1 AS attempt,
  CASE (part_key + line_number) % 8
    WHEN 0 THEN '```json' || chr(10) || {_OBJ} || chr(10) || '```'
    WHEN 1 THEN 'Sure!' || chr(10) || '```' || chr(10) || {_OBJ} || chr(10) || '```' || chr(10)
    WHEN 2 THEN {_OBJ}
    WHEN 3 THEN 'Here is the extracted record: ' || {_OBJ} || ' Let me know if you need more.'
    WHEN 4 THEN {_OBJ_TRAILING}
    WHEN 5 THEN {_OBJ_TEXTY}
    WHEN 6 THEN {_OBJ_NESTED}
    ELSE CASE WHEN line_number % 2 = 0 THEN {_OBJ} || ' ' || '{{\"note\": 1}}'
              ELSE '{{\"price\": ' || {_jnum("price")} || ', \"brand\": ' END
  END AS raw_text,
  CAST(1.25 AS DOUBLE) AS runtime_s
FROM listings
UNION ALL
SELECT listing_key, 2 AS attempt,
  CASE WHEN line_number = 7 THEN 'I cannot read this page.' ELSE {_OBJ} END AS raw_text,
  CAST(2.5 AS DOUBLE) AS runtime_s
FROM listings WHERE (part_key + line_number) % 8 = 7
"""

LEDGER_SQL = """
SELECT
  user_id AS pos,
  event_id,
  ts,
  'https://shop.example/item/' || CAST(user_id AS STRING) AS url,
  CASE event_type
    WHEN 'click' THEN 'ok'
    WHEN 'view' THEN 'timeout'
    WHEN 'error' THEN 'failed'
    WHEN 'purchase' THEN 'blocked'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'skipped' ELSE 'moved' END
  END AS status,
  value AS duration_s,
  CAST(200 + (event_id % 4) * 100 + (event_id % 7) AS INT) AS http_status,
  CAST(round(value * 1000) AS BIGINT) AS screenshot_bytes,
  event_type = 'purchase' AS cloudflare_blocked
FROM events
"""

VIEWS = {
    "listings": LISTINGS_SQL,
    "raw_outputs": RAW_OUTPUTS_SQL,
    "ledger": LEDGER_SQL,
}
# A view may only use views listed before it.
VIEW_DEPS = {"listings": [], "raw_outputs": ["listings"], "ledger": []}


def cte_sql(*names: str) -> str:
    """WITH prefix defining the named views (and what they need) for DuckDB."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in VIEW_DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n"


def register_views(spark: SparkSession, sf_dir: str) -> None:
    register_tables(spark, sf_dir, ["lineitem", "part", "events"])
    for name in ("listings", "raw_outputs", "ledger"):
        spark.sql(VIEWS[name]).createOrReplaceTempView(name)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ["lineitem", "part"])
    return spark.sql(LISTINGS_SQL)


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_methods(spark)
    listings(spark, sf_dir).createOrReplaceTempView("listings")
    return spark.sql(RAW_OUTPUTS_SQL)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ["events"])
    return spark.sql(LEDGER_SQL)

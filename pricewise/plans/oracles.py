"""DuckDB oracle SQL for the registered queries.

Each string runs on DuckDB with the driver tables registered as views; the
derived views (``listings``, ``raw_outputs``, ``ledger``) come in as a WITH
prefix built from the very same SQL Spark runs (``testdata.cte_sql``).
"""
from __future__ import annotations

from ..sources.testdata import cte_sql

ORACLES: dict[str, str] = {}

LISTING_SCALARS = (
    "price, discount_amount, currency, brand, model, colour_1, colour_2, colour_3, material_1, "
    "material_2, reclining, pull_out_bed, storage, seat_number, height, width, depth, product_count"
)
FEATURE_COLS = (
    "currency, colour_1, colour_2, colour_3, material_1, material_2, reclining, pull_out_bed, "
    "storage, seat_number, height, width, depth, product_count"
)

# Split chain: exact percentiles, strata, seeded ranks, hold-out flag.
SPLIT_CTES = """,
fin AS (SELECT price FROM listings WHERE price IS NOT NULL AND isfinite(price)),
cuts AS (SELECT quantile_cont(price, 0.2) AS c1, quantile_cont(price, 0.4) AS c2,
                quantile_cont(price, 0.6) AS c3, quantile_cont(price, 0.8) AS c4 FROM fin),
strata AS (
  SELECT l.*, CASE WHEN l.price IS NULL OR NOT isfinite(l.price) THEN -1
    ELSE CAST(l.price >= c.c1 AS INT) + CAST(l.price >= c.c2 AS INT) + CAST(l.price >= c.c3 AS INT)
       + CAST(l.price >= c.c4 AS INT) END AS stratum
  FROM listings l CROSS JOIN cuts c),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42||' || listing_key), listing_key) AS rk,
         count(*) OVER (PARTITION BY stratum) AS n_stratum
  FROM strata),
splitted AS (
  SELECT *, rk <= greatest(1, CAST(round_even(n_stratum * 0.15, 0) AS BIGINT)) AS holdout FROM ranked)
"""


def with_split() -> str:
    return cte_sql("listings").rstrip() + SPLIT_CTES


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --------------------------------------------------------------------------- S
oracle("s1_read_records", cte_sql("listings") + f"SELECT {LISTING_SCALARS} FROM listings WHERE line_number <> 7")
oracle("s3_worklist", "SELECT CAST(row_number() OVER (ORDER BY page_id) AS BIGINT) AS pos, url FROM pages QUALIFY pos <= 1000")

# --------------------------------------------------------------------------- F
oracle("f2_drop", cte_sql("listings") + f"SELECT listing_key, {FEATURE_COLS} FROM listings")
oracle("f7_cap", cte_sql("listings") + "SELECT listing_key, price FROM listings WHERE price < 90000.0")

# --------------------------------------------------------------------------- D
oracle("d1_strata", with_split() + """
SELECT stratum, count(*) AS n, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS price_cents,
       min(price) AS min_price, max(price) AS max_price
FROM strata GROUP BY stratum""")
oracle("d2_holdout", with_split() + "SELECT listing_key, stratum, holdout FROM splitted")
oracle("d3_split", with_split() + "SELECT listing_key, CASE WHEN holdout THEN 'holdout' ELSE 'train' END AS split FROM splitted")
oracle("d4_counts", with_split() + """
SELECT count(*) AS total, count(*) FILTER (WHERE NOT holdout) AS train, count(*) FILTER (WHERE holdout) AS holdout
FROM splitted""")

from ..functions.stats import norm_ppf_sql  # noqa: E402
from ..schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES  # noqa: E402

EVAL_CTES = """,
train AS (SELECT * FROM splitted WHERE NOT holdout),
hold AS (SELECT * FROM splitted WHERE holdout AND price < 90000.0),
scored AS (SELECT *, seat_number * width AS prediction FROM hold)
"""


def with_eval() -> str:
    return with_split() + EVAL_CTES


# --------------------------------------------------------------------------- T1, T6
oracle("t1_folds", with_eval() + """
SELECT listing_key, CAST(ntile(5) OVER (ORDER BY md5('1001||' || listing_key), listing_key) - 1 AS INT) AS fold
FROM train WHERE price < 90000.0""")
def _split_text() -> str:
    """Every scalar field with its length in front, as T6 writes it."""
    doubles = {"price", "discount_amount", "height", "width", "depth"}
    parts = []
    for c in ["listing_key", *LISTING_SCALARS.split(", "), "stratum"]:
        t = f"CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR)" if c in doubles else f"CAST({c} AS VARCHAR)"
        parts.append(f"coalesce(length({t}) || ':' || {t}, '-')")
    return " || '|' || ".join(parts)


_FINGERPRINTS = with_eval() + f""",
prints AS (SELECT CASE WHEN holdout THEN 'holdout' ELSE 'train' END AS split, count(*) AS n,
  substr(sha256(CAST(count(*) AS VARCHAR) || '|' || CAST(sum(CAST(('0x' || substr(md5({_split_text()}), 1, 15)) AS BIGINT)) AS VARCHAR)), 1, 16)
    AS fingerprint
FROM splitted GROUP BY 1)
"""
oracle("t6_fingerprint", _FINGERPRINTS + "SELECT split, n, fingerprint FROM prints")
oracle("v13_lineage", _FINGERPRINTS + """
SELECT 'run-1' AS train_run_id, 'model-explicit' AS model_version,
  substr(sha256(string_agg(split || ':' || fingerprint, '|' ORDER BY split)), 1, 16) AS data_split_id FROM prints""")
oracle("s10_run_log", with_eval() + """,
m AS (SELECT count(*) AS n, sqrt(avg((price - prediction) * (price - prediction))) AS rmse,
  1.0 - sum((price - prediction) * (price - prediction)) / (var_pop(price) * count(*)) AS r2 FROM scored)
SELECT 'training' AS stage, 'train_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM train
UNION ALL SELECT 'evaluation', 'holdout_size', CAST(n AS DOUBLE) FROM m
UNION ALL SELECT 'evaluation', 'holdout_rmse', round(rmse, 4) FROM m
UNION ALL SELECT 'evaluation', 'holdout_r2', round(r2, 4) FROM m""")

# --------------------------------------------------------------------------- F
oracle("f1_flatten", cte_sql("listings") + """
SELECT listing_key, price AS "parsed_json.price", width AS "parsed_json.specifications.dimensions.width",
  depth AS "parsed_json.specifications.dimensions.depth", height AS "parsed_json.specifications.dimensions.height",
  material_1 AS "parsed_json.specifications.material" FROM listings""")


def _vocab_sql(src: str) -> str:
    parts = []
    for c in CATEGORICAL_FEATURES:
        vt = "boolean" if c in ("reclining", "pull_out_bed", "storage") else "string"
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS position, v AS value, "
            f"'{vt}' AS value_type FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {src} WHERE {c} IS NOT NULL)")
    return "\nUNION ALL\n".join(parts)


oracle("f6_vocab", with_eval() + _vocab_sql("train"))
oracle("f4_known", with_eval() + ", " + ",\n".join(
    f"lv_{c} AS (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM train WHERE {c} IS NOT NULL)" for c in CATEGORICAL_FEATURES
) + "\nSELECT listing_key, " + ", ".join(f"lv_{c}.v AS {c}" for c in CATEGORICAL_FEATURES)
    + " FROM splitted h " + " ".join(f"LEFT JOIN lv_{c} ON lv_{c}.v = CAST(h.{c} AS VARCHAR)" for c in CATEGORICAL_FEATURES)
    + " WHERE h.holdout")
oracle("f5_inferred", cte_sql("listings") + "SELECT listing_key, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY {c} IS NULL, CAST({c} AS VARCHAR)) - 1 AS INT) END AS {c}_code"
    for c in CATEGORICAL_FEATURES) + " FROM listings")
oracle("s6_split_sink", with_split() + """
SELECT listing_key, CASE WHEN holdout THEN 'holdout' ELSE 'train' END AS split,
  listing_key || '|' || part_key || '|' || line_number || '|' || seat_number AS value FROM splitted""")
oracle("f9_align", cte_sql("listings") + f"SELECT {FEATURE_COLS} FROM listings")

# --------------------------------------------------------------------------- R1–R4
_NUMERIC_DEFAULTS = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS field, {i} AS position, coalesce(median(CASE WHEN {c} > 0 THEN CAST({c} AS DOUBLE) END), "
    f"median(CAST({c} AS DOUBLE)), 1.0) AS d FROM train"
    for i, c in enumerate(NUMERIC_FEATURES)
)
_COUNTS = ",\nvocab AS (" + _vocab_sql("train") + "),\nlong AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM train WHERE {c} IS NOT NULL"
    for c in CATEGORICAL_FEATURES
) + """),
cnt AS (SELECT "column", value, count(*) AS n FROM long GROUP BY ALL),
lv AS (SELECT v."column", v.position, v.value, coalesce(c.n, 0) AS n FROM vocab v LEFT JOIN cnt c USING ("column", value)),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, position) AS rank FROM lv),
numd AS (""" + _NUMERIC_DEFAULTS + ")\n"

oracle("r1_numeric", with_eval() + _COUNTS + "SELECT field, position, round(d, 6) AS \"default\" FROM numd")
oracle("r2_mode", with_eval() + _COUNTS + "SELECT \"column\", value FROM rk WHERE rank = 1")
oracle("r3_topk", with_eval() + _COUNTS + "SELECT \"column\", CAST(rank AS INT) AS rank, value, n FROM rk WHERE rank <= 10")
oracle("r4_schema", _FINGERPRINTS + _COUNTS + """
SELECT 'numeric_default' AS section, field, position, printf('%.6f', d) AS value FROM numd
UNION ALL SELECT 'numeric_above', field, position, '0' FROM numd
UNION ALL SELECT 'allowed', "column", position, value FROM vocab
UNION ALL SELECT 'top', "column", CAST(rank - 1 AS INT), value FROM rk WHERE rank <= 10
UNION ALL SELECT 'categorical_default', "column", 0, value FROM rk WHERE rank = 1
UNION ALL SELECT 'top_k', '', 0, '10'
UNION ALL SELECT 'lineage', 'model_version', 0, 'model-1'
UNION ALL SELECT 'lineage', 'train_run_id', 1, 'run-1'
UNION ALL SELECT 'lineage', 'data_split_id', 2, substr(sha256(string_agg(split || ':' || fingerprint, '|' ORDER BY split)), 1, 16) FROM prints""")

# --------------------------------------------------------------------------- V2–V10
oracle("v2_metrics", with_eval() + """
SELECT count(*) AS n, round(sqrt(avg((price - prediction) * (price - prediction))), 4) AS rmse,
  round(1.0 - sum((price - prediction) * (price - prediction)) / (var_pop(price) * count(*)), 4) AS r2 FROM scored""")
oracle("v4_residuals", with_eval() + "SELECT listing_key, price - prediction AS residual FROM scored")
oracle("v5_range", with_eval() + """
SELECT least(min(price), min(prediction)) AS lo, greatest(max(price), max(prediction)) AS hi FROM scored""")
oracle("v6_histogram", with_eval() + """,
res AS (SELECT price - prediction AS r FROM scored),
rng AS (SELECT CASE WHEN min(r) = max(r) THEN min(r) - 0.5 ELSE min(r) END AS lo,
               CASE WHEN min(r) = max(r) THEN max(r) + 0.5 ELSE max(r) END AS hi FROM res),
b AS (SELECT least(CAST(floor(30.0 * (r - lo) / (hi - lo)) AS BIGINT) + 1, 30) AS bin FROM res, rng),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT g.bin, round(lo + (hi - lo) * (g.bin - 1) / 30.0, 4) AS edge_lo, round(lo + (hi - lo) * g.bin / 30.0, 4) AS edge_hi,
  coalesce(c.n, 0) AS count
FROM (SELECT range AS bin FROM range(1, 31)) g CROSS JOIN rng LEFT JOIN c ON c.bin = g.bin""")
_P = ("CASE WHEN i = 1 THEN 1.0 - pow(0.5, 1.0 / n) WHEN i = n THEN pow(0.5, 1.0 / n) "
      "ELSE (i - 0.3175) / (n + 0.365) END")
oracle("v7_qq", with_eval() + f""",
res AS (SELECT listing_key, price - prediction AS osr FROM scored),
pts AS (SELECT row_number() OVER (ORDER BY osr, listing_key) AS i, osr, CAST(count(*) OVER () AS DOUBLE) AS n FROM res),
q AS (SELECT i, osr, {norm_ppf_sql(_P)} AS osm FROM pts),
line AS (SELECT regr_slope(osr, osm) AS slope, regr_intercept(osr, osm) AS intercept, regr_r2(osr, osm) AS r2 FROM q)
SELECT i, osr, round(osm, 6) AS osm, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r2
FROM q, line""")

_NUM_LIST = ", ".join(NUMERIC_FEATURES)
_PERM = with_eval() + f""",
base AS (SELECT listing_key, price, {_NUM_LIST}, row_number() OVER (ORDER BY listing_key) AS j FROM hold),
reps AS (SELECT CAST(range AS INT) AS rep FROM range(10)),
hr AS (SELECT rep, {_NUM_LIST}, row_number() OVER (PARTITION BY rep
        ORDER BY md5('1001||' || CAST(rep AS VARCHAR) || '|' || listing_key), listing_key) AS j FROM base, reps),
perm AS ({" UNION ALL ".join(
    f"SELECT b.price, '{c}' AS feature, h.rep, " + ", ".join(f"{'h' if c == d else 'b'}.{d}" for d in NUMERIC_FEATURES)
    + " FROM base b JOIN hr h ON b.j = h.j" for c in NUMERIC_FEATURES)}),
per_rep AS (SELECT feature, rep, sqrt(avg((price - seat_number * width) * (price - seat_number * width))) AS rmse
            FROM perm GROUP BY feature, rep),
base_rmse AS (SELECT sqrt(avg((price - seat_number * width) * (price - seat_number * width))) AS b FROM base),
imp AS (SELECT feature, avg(rmse - b) AS m, stddev_pop(rmse - b) AS s FROM per_rep, base_rmse GROUP BY feature)
"""
oracle("v8_permutation", _PERM + "SELECT feature, round(m, 4) AS importance_mean, round(s, 4) AS importance_std FROM imp")
oracle("v9_topk", _PERM + "SELECT feature, round(m, 4) AS importance_mean FROM imp ORDER BY m DESC, feature LIMIT 20")
oracle("v10_sample", with_eval() + "SELECT listing_key FROM hold ORDER BY md5('42||' || listing_key), listing_key LIMIT 400")

# --------------------------------------------------------------------------- E1–E19
from .oracle_extract import cleaned_cte  # noqa: E402
from ..schema import TEXT_FIELDS as _TEXT, LISTING_COLUMNS as _LC  # noqa: E402

_E = cte_sql("raw_outputs").rstrip() + cleaned_cte()
_RECORD = ", ".join(f"array_to_string(a.{c}, '|') AS {c}" if c in ("additional_features", "evidence") else f"a.{c}" for c in _LC)
_FV = _E + """,
w AS (SELECT *, min(CASE WHEN valid THEN attempt END) OVER (PARTITION BY image_path) AS win FROM att WHERE attempt <= 2),
fv AS (SELECT image_path, win IS NOT NULL AS success, CAST(coalesce(win, 0) AS INT) AS attempts_used,
         CAST(sum(runtime_s) FILTER (WHERE win IS NULL OR attempt <= win) AS DOUBLE) AS runtime_s,
         CASE WHEN win IS NULL THEN arg_max(error, attempt) END AS last_error, max(attempt) AS attempts_tried
       FROM w GROUP BY image_path, win),
win_row AS (SELECT image_path, raw_text FROM w WHERE attempt = win),
rec AS (
  SELECT fv.image_path, regexp_extract(fv.image_path, '[^/]*$', 0) AS image_file, fv.success,
    CASE WHEN NOT fv.success THEN 'no valid JSON after ' || CAST(fv.attempts_tried AS VARCHAR)
         || ' attempt(s); last error: ' || fv.last_error END AS error,
    CASE WHEN fv.success THEN fv.runtime_s ELSE 0.0 END AS runtime_s,
    CASE WHEN fv.success THEN fv.attempts_used ELSE 0 END AS attempts_used,
    '' AS prompt_text, wr.raw_text, """ + _RECORD + """
  FROM fv LEFT JOIN win_row wr ON wr.image_path = fv.image_path
          LEFT JOIN att a ON a.image_path = fv.image_path AND a.attempt = fv.attempts_used)
"""


def _e(cols: str) -> str:
    return _E + f"SELECT image_path, attempt, {cols} FROM att"


oracle("e1_json_text", _e("json_text"))
oracle("e2_parse", _e("parse_ok"))
oracle("e3_project", _e("CAST(n_allowed AS INT) AS n_allowed, CAST(n_other AS INT) AS n_other"))
oracle("e4_alias", _e("model"))
oracle("e5_materials", _e("material_1, material_2"))
oracle("e6_dimensions", _e("width, depth, height"))
oracle("e7_seats", _e("seat_number"))
oracle("e8_currency", """SELECT doc_id, CASE WHEN contains(text, '£') THEN 'GBP' WHEN contains(text, '€') THEN 'EUR'
  WHEN contains(text, '$') THEN 'USD' END AS currency FROM documents""")
oracle("e9_number", _e("price, discount_amount"))
from .oracle_extract import as_int as _as_int  # noqa: E402
oracle("e10_int", _E.replace("att AS (SELECT image_path, attempt, raw_text,",
                             "att AS (SELECT image_path, attempt, raw_text, "
                             f"CASE WHEN parse_ok THEN {_as_int('$.seat_number')} END AS seat_int, "
                             f"CASE WHEN parse_ok THEN {_as_int('$.product_count')} END AS count_int,")
       + "SELECT image_path, attempt, seat_int, count_int FROM att")
oracle("e11_bool", _e("reclining, pull_out_bed, storage"))
oracle("e12_count", _e("product_count"))
oracle("e13_arrays", _e(", ".join(
    f"array_to_string({f}, '|') AS {f}_text, CAST(len({f}) AS INT) AS {f}_n" for f in ("additional_features", "evidence"))))
oracle("e14_text", _e(", ".join(_TEXT)))
oracle("e15_schema", _e(", ".join(
    f"array_to_string({c}, '|') AS {c}" if c in ("additional_features", "evidence") else c for c in _LC)))
oracle("e16_validate", _e("valid, error"))
oracle("e17_first_valid", _FV + "SELECT image_path, success, attempts_used, runtime_s, last_error FROM fv")
oracle("e18_route", _FV + "SELECT * FROM rec")
oracle("e19_summary", _FV + """
SELECT count(*) AS total_images, count(*) FILTER (WHERE success) AS successful_extractions,
  count(*) FILTER (WHERE NOT success) AS failed_extractions,
  coalesce(CAST(count(*) FILTER (WHERE success) AS DOUBLE) / nullif(count(*), 0), 0.0) AS success_rate,
  coalesce(sum(runtime_s), 0.0) AS runtime_s FROM rec""")

oracle("s11_documents", with_eval() + ", voc AS (" + _vocab_sql("train") + "), imp AS (" + ORACLES["v9_topk"] + "), summ AS (" + ORACLES["e19_summary"] + """)
SELECT 'levels' AS document, "column" AS name, string_agg(value, '|' ORDER BY position) AS text, CAST(NULL AS DOUBLE) AS value FROM voc GROUP BY "column"
UNION ALL SELECT 'importance', feature, NULL, importance_mean FROM imp
UNION ALL SELECT 'summary', 'total_images', NULL, CAST(total_images AS DOUBLE) FROM summ
UNION ALL SELECT 'summary', 'successful_extractions', NULL, CAST(successful_extractions AS DOUBLE) FROM summ""")
oracle("s10_runs_written", with_eval() + ", summ AS (" + ORACLES["e19_summary"] + """)
SELECT 'inference' AS stage, u.metric, round(u.value, 4) AS value FROM (SELECT count(*) AS n, avg(prediction) AS m, min(prediction) AS lo, max(prediction) AS hi FROM scored) s,
  LATERAL (VALUES ('n_predictions', CAST(n AS DOUBLE)), ('mean_price', m), ('min_price', lo), ('max_price', hi)) u(metric, value)
UNION ALL SELECT 'extraction', u.metric, round(u.value, 4) FROM summ,
  LATERAL (VALUES ('total_images', CAST(total_images AS DOUBLE)), ('successful_extractions', CAST(successful_extractions AS DOUBLE)),
    ('failed_extractions', CAST(failed_extractions AS DOUBLE)), ('success_rate', success_rate), ('runtime_s', CAST(runtime_s AS DOUBLE))) u(metric, value)""")

# --------------------------------------------------------------------------- L1–L7
# What, beside "cloudflare", a bot-check page says.
_SIG = ["cf-challenge", "challenge-platform", "checking your browser", "ray id", "security verification", "verify you are human"]
from .oracle_extract import strip as _strip  # noqa: E402

_LEDGER = cte_sql("ledger").rstrip() + """,
wl AS (SELECT CAST(row_number() OVER (ORDER BY page_id) AS BIGINT) AS pos, url FROM pages),
lt AS (SELECT pos, arg_max(status, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id
       FROM ledger GROUP BY pos)
"""
oracle("l1_pending", _LEDGER + "SELECT pos, url FROM wl WHERE pos NOT IN (SELECT pos FROM lt WHERE status IN ('ok', 'skipped'))")
oracle("l2_latest", _LEDGER + "SELECT pos, event_id, status FROM lt")
oracle("l2_latest_stream", _LEDGER + "SELECT pos, event_id, status FROM lt")
oracle("l3_counts", _LEDGER + """,
st AS (SELECT * FROM (VALUES ('ok'), ('failed'), ('blocked'), ('skipped'), ('timeout')) t(metric)),
ev AS (SELECT CASE WHEN status IN ('ok', 'failed', 'blocked', 'skipped', 'timeout') THEN status ELSE 'failed' END AS metric,
              count(*) AS n FROM ledger GROUP BY 1)
SELECT st.metric, coalesce(ev.n, 0) AS n FROM st LEFT JOIN ev USING (metric)
UNION ALL SELECT 'done', count(*) FILTER (WHERE status IN ('ok', 'skipped')) FROM lt""")
oracle("l4_blocked", """
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html || '<p>Cloudflare: Ray ID 8f2a</p>'
  WHEN 1 THEN html || '<p>Protected by CLOUDFLARE</p>' WHEN 2 THEN html || '<p>Ray ID only</p>' ELSE html END AS html FROM pages)
SELECT page_id, contains(lower(html), 'cloudflare') AND (""" + " OR ".join(
    f"contains(lower(html), '{s}')" for s in _SIG) + ") AS blocked FROM p")
oracle("l5_outcome", """
WITH e AS (SELECT event_id, event_type = 'view' AS t, event_type = 'error' AS f, value > 5 AS s, event_type = 'purchase' AS b,
  CAST(200 + (event_id % 4) * 100 + event_id % 7 AS INT) AS h, CAST(round(value * 1000) AS BIGINT) AS bytes, value FROM events)
SELECT event_id,
  CASE WHEN t THEN 'timeout' WHEN f OR NOT s THEN 'failed' WHEN b THEN 'blocked' ELSE 'ok' END AS status,
  CASE WHEN h >= 500 THEN 'server_error' WHEN h >= 400 THEN 'client_error' WHEN h IS NOT NULL THEN 'ok' END AS http_class,
  CASE WHEN s AND NOT t AND NOT f THEN round_even(bytes / 1024.0, 1) END AS screenshot_kb,
  round_even(value, 2) AS duration_s,
  CASE WHEN t THEN false ELSE b END AS cloudflare_blocked
FROM e""")
oracle("l6_key", "SELECT CAST(row_number() OVER (ORDER BY page_id) AS BIGINT) AS pos, "
       "printf('screenshot_%02d.png', row_number() OVER (ORDER BY page_id)) AS file_name FROM pages")
_S = _strip("replace(text, chr(10), ' ')")
oracle("l7_preview", f"""
SELECT doc_id, CASE WHEN length({_S}) <= 180 THEN {_S} ELSE substr({_S}, 1, 177) || '...' END AS preview FROM documents""")

# --------------------------------------------------------------------------- P1, P4
oracle("p1_unwrap", with_eval() + """
SELECT listing_key, CASE WHEN line_number = 2 THEN 'id_' || listing_key END AS id,
  CASE WHEN line_number % 2 = 0 THEN 'shots/' || listing_key || '.png' END AS image_path,
  price, currency, material_1, seat_number, width, reclining
FROM splitted WHERE holdout""")
oracle("p4_predictions", with_eval() + """,
lines AS (SELECT listing_key || '|0' AS o, true AS rec, listing_key, line_number, seat_number, width FROM splitted WHERE holdout
          UNION ALL SELECT listing_key || '|1', false, NULL, NULL, NULL, NULL FROM splitted WHERE holdout AND line_number = 6),
pos AS (SELECT *, row_number() OVER (ORDER BY o) - 1 AS input_index FROM lines),
recs AS (SELECT *, row_number() OVER (ORDER BY o) - 1 AS n FROM pos WHERE rec)
SELECT round(seat_number * width, 4) AS predicted_price, input_index,
  CASE WHEN line_number % 2 = 0 THEN 'shots/' || listing_key || '.png' END AS image_path,
  coalesce(CASE WHEN line_number = 2 THEN 'id_' || listing_key END, 'row_' || CAST(n AS VARCHAR)) AS id
FROM recs""")

oracle("p3_score", with_eval() + "SELECT listing_key, round(seat_number * width, 4) AS predicted_price FROM splitted WHERE holdout")
oracle("s2_read_input", with_eval() + """,
lines AS (SELECT listing_key || '|0' AS o, true AS rec, listing_key, line_number, price FROM splitted WHERE holdout
          UNION ALL SELECT listing_key || '|1', false, NULL, NULL, NULL FROM splitted WHERE holdout AND line_number = 6),
pos AS (SELECT *, row_number() OVER (ORDER BY o) - 1 AS input_index FROM lines)
SELECT input_index, CASE WHEN line_number = 2 THEN 'id_' || listing_key END AS id,
  CASE WHEN line_number % 2 = 0 THEN price END AS price FROM pos WHERE rec""")

# --------------------------------------------------------------------------- R5–R10
_SCEN = with_eval() + _COUNTS + """,
req AS (SELECT listing_key AS scenario_id, line_number, width, seat_number, storage, material_1 FROM splitted WHERE holdout),
num AS (
  SELECT scenario_id, 'width' AS field, CASE WHEN line_number = 1 THEN 0.0 ELSE width END AS v FROM req WHERE line_number <> 6
  UNION ALL SELECT scenario_id, 'legs', 4.0 FROM req WHERE line_number = 5
  UNION ALL SELECT scenario_id, 'seat_number', CAST(seat_number AS DOUBLE) FROM req WHERE line_number NOT IN (5, 6)),
cat AS (
  SELECT scenario_id, 'material_1' AS field, CASE WHEN line_number = 2 THEN 'PLAID' ELSE material_1 END AS value
    FROM req WHERE line_number <> 6
  UNION ALL SELECT scenario_id, 'colour_9', 'red' FROM req WHERE line_number = 3
  UNION ALL SELECT scenario_id, 'reclining', CASE WHEN line_number = 4 THEN ' Yes ' ELSE CAST(storage AS VARCHAR) END
    FROM req WHERE line_number NOT IN (3, 6)),
kinds AS (SELECT "column" AS field, bool_or(value_type = 'boolean') AS is_bool FROM vocab GROUP BY 1),
co AS (
  SELECT c.scenario_id, c.field, c.value,
    CASE WHEN EXISTS (SELECT 1 FROM vocab v WHERE v."column" = c.field AND v.value = c.value) THEN c.value
         WHEN k.is_bool AND lower(trim(c.value)) IN ('true', '1', 'yes') THEN 'true'
         WHEN k.is_bool AND lower(trim(c.value)) IN ('false', '0', 'no') THEN 'false'
         ELSE c.value END AS coerced
  FROM cat c LEFT JOIN kinds k ON k.field = c.field),
al AS (SELECT co.*, EXISTS (SELECT 1 FROM vocab v WHERE v."column" = co.field AND v.value = co.coerced) AS allowed FROM co),
bad AS (
  SELECT scenario_id FROM num WHERE v <= 0 OR isnan(v)
  UNION SELECT scenario_id FROM num WHERE field NOT IN (""" + ", ".join(f"'{c}'" for c in NUMERIC_FEATURES) + """)
  UNION SELECT scenario_id FROM al WHERE NOT allowed
  UNION SELECT scenario_id FROM cat WHERE field NOT IN (SELECT DISTINCT "column" FROM vocab))
"""
oracle("r5_positive", _SCEN + """
SELECT r.scenario_id, coalesce(string_agg(n.field, ',' ORDER BY n.field), '') AS nonpositive
FROM req r LEFT JOIN num n ON n.scenario_id = r.scenario_id AND (n.v <= 0 OR isnan(n.v)) GROUP BY r.scenario_id""")
oracle("r6_unknown", _SCEN + """,
un AS (SELECT scenario_id, 0 AS g, field FROM num WHERE field NOT IN (""" + ", ".join(f"'{c}'" for c in NUMERIC_FEATURES) + """)
       UNION ALL SELECT scenario_id, 1, field FROM cat WHERE field NOT IN (SELECT DISTINCT "column" FROM vocab))
SELECT r.scenario_id, coalesce(string_agg(u.field, ',' ORDER BY u.g, u.field), '') AS unknown_fields
FROM req r LEFT JOIN un u ON u.scenario_id = r.scenario_id GROUP BY r.scenario_id""")
oracle("r7_coerce", _SCEN + "SELECT scenario_id, field, value, coerced FROM co")
oracle("r8_allowed", _SCEN + "SELECT scenario_id, field, allowed FROM al")
_BASE_NUM = {c: f"(SELECT d FROM numd WHERE field = '{c}')" for c in NUMERIC_FEATURES}
_BASE_CAT = {c: f"(SELECT value FROM rk WHERE \"column\" = '{c}' AND rank = 1)" for c in CATEGORICAL_FEATURES}
oracle("r9_overlay", _SCEN + "SELECT r.scenario_id, " + ", ".join(
    [f"round(coalesce((SELECT v FROM num n WHERE n.scenario_id = r.scenario_id AND n.field = '{c}'), {_BASE_NUM[c]}), 6) AS {c}"
     for c in NUMERIC_FEATURES]
    + [f"coalesce((SELECT coerced FROM co WHERE co.scenario_id = r.scenario_id AND co.field = '{c}'), {_BASE_CAT[c]}) AS {c}"
       for c in CATEGORICAL_FEATURES if c not in ("colour_2", "colour_3")]  # always null in the view: no vocabulary
) + " FROM req r WHERE r.scenario_id NOT IN (SELECT scenario_id FROM bad)")
_ERRORS = """
  SELECT scenario_id, field FROM num WHERE v <= 0 OR isnan(v)
  UNION ALL SELECT scenario_id, field FROM num WHERE field NOT IN (""" + ", ".join(f"'{c}'" for c in NUMERIC_FEATURES) + """)
  UNION ALL SELECT scenario_id, field FROM al WHERE NOT allowed AND field IN (SELECT DISTINCT "column" FROM vocab)
  UNION ALL SELECT scenario_id, field FROM cat WHERE field NOT IN (SELECT DISTINCT "column" FROM vocab)"""
_SHORT = (_SCEN.replace(" FROM splitted WHERE holdout),", " FROM splitted WHERE holdout\n"
                        "  UNION ALL SELECT listing_key || '|short', 10 + line_number, width, seat_number, storage, material_1"
                        " FROM splitted WHERE holdout AND line_number >= 4),", 1)
          .replace("FROM req WHERE line_number <> 6\n  UNION ALL SELECT scenario_id, 'legs', 4.0 FROM req WHERE line_number = 5",
                   "FROM req WHERE line_number <> 6 AND line_number < 10 OR line_number = 14\n"
                   "  UNION ALL SELECT scenario_id, 'legs', 4.0 FROM req WHERE line_number = 5\n"
                   "  UNION ALL SELECT scenario_id, 'legs', width FROM req WHERE line_number = 15", 1)
          .replace("FROM req WHERE line_number NOT IN (5, 6)),", "FROM req WHERE line_number NOT IN (5, 6) AND line_number < 10),", 1)
          .replace("FROM req WHERE line_number NOT IN (3, 6)),", "FROM req WHERE line_number NOT IN (3, 6) AND line_number < 10),", 1))
oracle("r10_scenarios", _SHORT.replace(with_eval(), _FINGERPRINTS, 1) + ", errs AS (SELECT scenario_id, count(*) AS n FROM (" + _ERRORS + """) GROUP BY 1)
SELECT r.scenario_id, CASE WHEN e.n IS NULL THEN round(
    coalesce((SELECT v FROM num n WHERE n.scenario_id = r.scenario_id AND n.field = 'seat_number'), (SELECT d FROM numd WHERE field = 'seat_number'))
    * coalesce((SELECT v FROM num n WHERE n.scenario_id = r.scenario_id AND n.field = 'width'), (SELECT d FROM numd WHERE field = 'width')), 4) END AS predicted_price,
  'model-1' AS model_version, 'run-1' AS train_run_id,
  (SELECT substr(sha256(string_agg(split || ':' || fingerprint, '|' ORDER BY split)), 1, 16) FROM prints) AS data_split_id,
  CAST(coalesce(e.n, 0) AS INT) AS n_errors
FROM req r LEFT JOIN errs e ON e.scenario_id = r.scenario_id""")

# --------------------------------------------------------------------------- T5, P3, R10 with a fitted model
from . import oracle_boost as _boost  # noqa: E402

oracle("t5_nodes", with_eval() + _boost.ensemble() + "\n" + _boost.nodes())
oracle("p3_model", with_eval() + _boost.ensemble() + ",\nheld AS (SELECT * FROM splitted WHERE holdout)" + _boost.scored("held", "listing_key")
       + "\nSELECT k AS listing_key, predicted_price FROM price_of")
oracle("r10_model", _SCEN + _boost.ensemble() + ",\nov AS MATERIALIZED (" + ORACLES["r9_overlay"][len(_SCEN):] + ")" + _boost.scored("ov", "scenario_id")
       + "\nSELECT k AS scenario_id, predicted_price FROM price_of")

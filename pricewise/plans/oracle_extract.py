"""DuckDB mirror of the extraction rules (E1–E19), generated as SQL text.

Independent of the Spark code path: DuckDB's own JSON reader and RE2 regexes, and
patterns of its own, written out here from the rules, so that a slip in the
library's patterns shows as a difference.
"""
from __future__ import annotations

from ..schema import LISTING_COLUMNS, TEXT_FIELDS

# White space, fences, braces, separators, units and words of the rules, for RE2.
SPACE = (r"[\x09-\x0D\x20\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
PY_STRIP_RE = f"^{SPACE}+|{SPACE}+$"
FENCE_RE = r"(?s)```(?:json)?" + SPACE + r"*(\{.*?\})" + SPACE + "*```"
FIRST_OBJ_RE = r"(?s)\{.*\}"
TRAILING_COMMA_RE = "," + SPACE + r"*([}\]])"
NUMBER_JUNK_RE = "[£€$,]"
UNIT_SUFFIX_RE = "(?i)" + SPACE + "*(inches|inch|in|cm|mm|'|\")" + SPACE + "*$"
FLOAT_TEXT_RE = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
MATERIAL_SPLIT_RE = " and |[+,/;]"
SEATER_RE = r"(\d+)" + SPACE + "*seater"
TRUE_WORDS = ["1", "true", "y", "yes"]
FALSE_WORDS = ["0", "false", "n", "no"]
ERR_NO_JSON = "the reply holds no JSON object"
ERR_BAD_JSON = "invalid JSON"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(PY_STRIP_RE)}, '', 'g')"  # regex form: independent of the Spark trim


def jt(p: str) -> str:
    return f"json_type(v, {lit(p)})"


def js(p: str) -> str:
    return f"json_extract_string(v, {lit(p)})"


def jd(p: str) -> str:
    return f"TRY_CAST(json_extract_string(v, {lit(p)}) AS DOUBLE)"


NUM_TYPES = "('BIGINT', 'UBIGINT', 'DOUBLE')"


def finite(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def number_from_text(s: str) -> str:
    t1 = f"regexp_replace({strip(s)}, {lit(NUMBER_JUNK_RE)}, '', 'g')"
    t2 = strip(f"regexp_replace({t1}, {lit(UNIT_SUFFIX_RE)}, '')")
    return f"(CASE WHEN regexp_matches({t2}, {lit(FLOAT_TEXT_RE)}) THEN {finite(f'TRY_CAST({t2} AS DOUBLE)')} END)"


def as_number(p: str) -> str:
    return (f"(CASE WHEN {jt(p)} IN {NUM_TYPES} THEN {finite(jd(p))} "
            f"WHEN {jt(p)} = 'VARCHAR' THEN {number_from_text(js(p))} END)")


def as_int(p: str) -> str:
    digits = f"nullif(regexp_extract(replace({js(p)}, ',', ''), '-?[0-9]+', 0), '')"
    return (f"(CASE WHEN {jt(p)} IN ('BIGINT', 'UBIGINT') THEN TRY_CAST({js(p)} AS BIGINT) "
            f"WHEN {jt(p)} = 'DOUBLE' THEN CASE WHEN isfinite({jd(p)}) THEN TRY_CAST(trunc({jd(p)}) AS BIGINT) END "
            f"WHEN {jt(p)} = 'VARCHAR' THEN TRY_CAST({digits} AS BIGINT) END)")


def as_bool(p: str) -> str:
    w = f"lower({strip(js(p))})"
    t = ", ".join(lit(x) for x in TRUE_WORDS)
    f_ = ", ".join(lit(x) for x in FALSE_WORDS)
    return (f"(CASE WHEN {jt(p)} = 'BOOLEAN' THEN CAST({js(p)} AS BOOLEAN) "
            f"WHEN {jt(p)} = 'VARCHAR' THEN CASE WHEN {w} IN ({t}) THEN true WHEN {w} IN ({f_}) THEN false END END)")


def text_of(p: str) -> str:
    return f"(CASE WHEN {jt(p)} = 'VARCHAR' THEN {js(p)} ELSE CAST(json_extract(v, {lit(p)}) AS VARCHAR) END)"


def as_text(p: str) -> str:
    return (f"(CASE WHEN {jt(p)} = 'NULL' THEN NULL WHEN {jt(p)} = 'VARCHAR' THEN nullif({strip(js(p))}, '') "
            f"WHEN {jt(p)} IS NOT NULL THEN CAST(json_extract(v, {lit(p)}) AS VARCHAR) END)")


def absent(p: str) -> str:
    return f"({jt(p)} IS NULL OR {jt(p)} = 'NULL')"


def blank(p: str) -> str:
    return f"({absent(p)} OR ({jt(p)} = 'VARCHAR' AND {js(p)} = ''))"


def truthy(p: str) -> str:
    return (f"(CASE WHEN {absent(p)} THEN false WHEN {jt(p)} = 'BOOLEAN' THEN CAST({js(p)} AS BOOLEAN) "
            f"WHEN {jt(p)} IN {NUM_TYPES} THEN {jd(p)} <> 0 WHEN {jt(p)} = 'VARCHAR' THEN {js(p)} <> '' "
            f"WHEN {jt(p)} = 'ARRAY' THEN json_array_length(v, {lit(p)}) > 0 "
            f"WHEN {jt(p)} = 'OBJECT' THEN len(json_keys(v, {lit(p)})) > 0 ELSE true END)")


def elem_text(e: str) -> str:
    return f"(CASE WHEN json_type({e}) = 'VARCHAR' THEN json_extract_string({e}, '$') ELSE CAST({e} AS VARCHAR) END)"


def parts(p: str) -> str:
    from_text = (f"list_filter(list_transform(regexp_split_to_array({js(p)}, {lit(MATERIAL_SPLIT_RE)}), "
                 f"lambda x: {strip('x')}), lambda x: x <> '')")
    from_list = (f"list_filter(list_transform(json_extract(v, {lit(p + '[*]')}), lambda e: {strip(elem_text('e'))}), "
                 f"lambda x: x <> '')")
    return (f"(CASE WHEN {jt(p)} = 'VARCHAR' THEN {from_text} WHEN {jt(p)} = 'ARRAY' THEN {from_list} "
            f"ELSE CAST([] AS VARCHAR[]) END)")


def sizes_text(p: str) -> str:
    first = p + "[0]"
    return (f"(CASE WHEN {jt(p)} = 'ARRAY' AND {truthy(p)} THEN CASE WHEN {jt(first)} = 'VARCHAR' THEN lower({js(first)}) END "
            f"WHEN {jt(p)} = 'VARCHAR' THEN lower({js(p)}) END)")


def string_array(p: str) -> str:
    return (f"(CASE WHEN {jt(p)} = 'ARRAY' THEN list_transform(json_extract(v, {lit(p + '[*]')}), lambda e: {elem_text('e')}) "
            f"WHEN {blank(p)} THEN CAST([] AS VARCHAR[]) ELSE [{text_of(p)}] END)")


def non_string(p: str) -> str:
    return (f"({jt(p)} = 'ARRAY' AND len(list_filter(json_extract(v, {lit(p + '[*]')}), "
            f"lambda e: json_type(e) <> 'VARCHAR')) > 0)")


def field_exprs() -> dict[str, str]:
    spec = "$.specifications"
    spec_obj = f"coalesce({jt(spec)} = 'OBJECT', false)"
    dims = spec + ".dimensions"
    dims_obj = f"({spec_obj} AND coalesce({jt(dims)} = 'OBJECT', false))"
    out: dict[str, str] = {}
    for f in ("price", "discount_amount"):
        out[f] = as_number(f"$.{f}")
    for f in ("width", "depth", "height"):
        out[f] = f"(CASE WHEN {dims_obj} AND {absent('$.' + f)} THEN {as_number(dims + '.' + f)} ELSE {as_number('$.' + f)} END)"
    s1, s2, s3 = spec + ".sofa_sizes", spec + ".size", spec + ".seater"
    txt = f"(CASE WHEN {truthy(s1)} THEN {sizes_text(s1)} WHEN {truthy(s2)} THEN {sizes_text(s2)} ELSE {sizes_text(s3)} END)"
    seat_fb = f"TRY_CAST(nullif(regexp_extract({txt}, {lit(SEATER_RE)}, 1), '') AS BIGINT)"
    out["seat_number"] = f"(CASE WHEN {spec_obj} AND {absent('$.seat_number')} THEN {seat_fb} ELSE {as_int('$.seat_number')} END)"
    pc = as_int("$.product_count")
    out["product_count"] = f"(CASE WHEN {pc} >= 1 THEN {pc} ELSE 1 END)"
    for f in ("reclining", "pull_out_bed", "storage"):
        out[f] = as_bool(f"$.{f}")
    for f in TEXT_FIELDS:
        out[f] = as_text(f"$.{f}")
    hint = (f"concat(CASE WHEN {truthy('$.description')} THEN {text_of('$.description')} ELSE '' END, ' ', "
            f"CASE WHEN {truthy('$.delivery')} THEN {text_of('$.delivery')} ELSE '' END)")
    cur = (f"(CASE WHEN contains({hint}, '£') THEN 'GBP' WHEN contains({hint}, '€') THEN 'EUR' "
           f"WHEN contains({hint}, '$') THEN 'USD' END)")
    out["currency"] = f"(CASE WHEN {absent('$.currency')} THEN {cur} ELSE {as_text('$.currency')} END)"
    out["model"] = (f"(CASE WHEN {blank('$.model')} AND coalesce({jt('$.name')} = 'VARCHAR', false) "
                    f"THEN nullif({strip(js('$.name'))}, '') ELSE {as_text('$.model')} END)")
    ma, mb = spec + ".materials", spec + ".material"
    use = f"({spec_obj} AND {blank('$.material_1')} AND coalesce({truthy(ma)} OR {truthy(mb)}, false))"
    pr = f"(CASE WHEN {truthy(ma)} THEN {parts(ma)} ELSE {parts(mb)} END)"
    out["material_1"] = f"(CASE WHEN {use} THEN nullif({strip(pr + '[1]')}, '') ELSE {as_text('$.material_1')} END)"
    out["material_2"] = (f"(CASE WHEN {use} AND len({pr}) > 1 THEN nullif({strip(pr + '[2]')}, '') "
                         f"ELSE {as_text('$.material_2')} END)")
    for f in ("additional_features", "evidence"):
        out[f] = string_array(f"$.{f}")
    return out


def cleaned_cte() -> str:
    """CTEs ``att`` (per attempt: json_text, parse_ok, fields, valid, error)."""
    f = field_exprs()
    t = strip("raw_text")
    fenced = f"nullif(regexp_extract({t}, {lit(FENCE_RE)}, 1), '')"
    whole = f"CASE WHEN starts_with({t}, '{{') AND ends_with({t}, '}}') THEN {t} END"
    first = f"nullif(regexp_extract({t}, {lit(FIRST_OBJ_RE)}, 0), '')"
    allowed = "[" + ", ".join(lit(c) for c in LISTING_COLUMNS) + "]"
    errs = ("nullif(concat_ws('; ', " + ", ".join(
        f"CASE WHEN {non_string('$.' + a)} THEN '{a}: items must be strings' END"
        for a in ("additional_features", "evidence")) + "), '')")
    fields = ",\n    ".join(f"CASE WHEN ok THEN {f[c]} END AS {c}" for c in LISTING_COLUMNS)
    return f""",
r0 AS (SELECT listing_key AS image_path, attempt, raw_text, runtime_s,
              coalesce({strip(fenced)}, {whole}, {first}) AS json_text FROM raw_outputs),
r1 AS (SELECT *, regexp_replace({strip('json_text')}, {lit(TRAILING_COMMA_RE)}, '\\1', 'g') AS rep FROM r0),
r2a AS (SELECT *, TRY_CAST(rep AS JSON) AS vv FROM r1),
r2 AS (SELECT *, coalesce(vv IS NOT NULL AND json_type(vv) = 'OBJECT', false) AS parse_ok,
              CASE WHEN vv IS NOT NULL AND json_type(vv) = 'OBJECT' THEN vv END AS v FROM r2a),
r3 AS (SELECT *, {errs} AS errs,
              CASE WHEN v IS NOT NULL THEN len(list_intersect(json_keys(v), {allowed})) END AS n_allowed,
              CASE WHEN v IS NOT NULL THEN len(list_filter(json_keys(v), lambda k: NOT list_contains({allowed}, k))) END AS n_other
       FROM r2),
r4 AS (SELECT *, CASE WHEN json_text IS NULL THEN {lit(ERR_NO_JSON)} WHEN NOT parse_ok THEN {lit(ERR_BAD_JSON)}
                      WHEN errs IS NOT NULL THEN 'schema: ' || errs END AS error FROM r3),
att AS (SELECT image_path, attempt, raw_text, runtime_s, json_text, parse_ok, n_allowed, n_other, error,
    error IS NULL AS valid, error IS NULL AS ok,
    {fields}
  FROM (SELECT *, error IS NULL AS ok FROM r4) q)
"""

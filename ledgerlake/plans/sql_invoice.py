"""DuckDB spellings of the invoice derivations, for the oracle SQL.

These mirror ``plans.derived`` and ``operators.evaluate`` expression by
expression; they exist only to check the Spark jobs.
"""

from __future__ import annotations

from ledgerlake.operators.invoice import CURRENCIES, ITEM_FIELDS, MONEY_FIELDS, SCALAR_FIELDS, TAX_RATES
from ledgerlake.plans import derived as D

WS = r"[\t\n\x0b\f\r ]"
PY_FLOAT = (rf"^{WS}*[+-]?(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)"
            rf"(?:[eE][+-]?[0-9](?:_?[0-9])*)?{WS}*$")
PY_INF = rf"(?i)^{WS}*[+-]?(?:inf|infinity){WS}*$"
PY_NAN = rf"(?i)^{WS}*[+-]?nan{WS}*$"
NUM_TYPES = "('DOUBLE','UBIGINT','BIGINT','HUGEINT','UHUGEINT')"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def money(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), 2) AS DECIMAL(18,2))"


def jq(x: str) -> str:
    return f"coalesce(to_json({x}), 'null')"


def num(x: str) -> str:
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR), '(\\.\\d)0$', '\\1')"


def dollar(x: str) -> str:
    return f"('\"$' || format('{{:,.2f}}', CAST({x} AS DOUBLE)) || '\"')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def py_float(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, {lit(PY_FLOAT)}) "
            f"THEN TRY_CAST(replace({collapse(x)}, '_', '') AS DOUBLE) "
            f"WHEN regexp_matches({x}, {lit(PY_INF)}) THEN (CASE WHEN starts_with({collapse(x)}, '-') "
            f"THEN -1.0 ELSE 1.0 END) * CAST('inf' AS DOUBLE) "
            f"WHEN regexp_matches({x}, {lit(PY_NAN)}) THEN CAST('nan' AS DOUBLE) END)")


def num_tag(d: str) -> str:
    return (f"(CASE WHEN {d} IS NULL THEN NULL WHEN isnan({d}) THEN 'x:nan' "
            f"WHEN {d} = CAST('inf' AS DOUBLE) THEN 'n:inf' WHEN {d} = CAST('-inf' AS DOUBLE) THEN 'n:-inf' "
            f"ELSE 'n:' || coalesce(CAST(TRY_CAST(round({d}, 2) AS DECIMAL(38,2)) AS VARCHAR), "
            f"CAST(round({d}, 2) AS VARCHAR)) END)")


def str_tag(s: str) -> str:
    text = collapse(s)
    stripped = f"regexp_replace(regexp_replace(replace({text}, ',', ''), '^[$€£]+', ''), '^CA\\$', '')"
    f = py_float(stripped)
    return (f"(CASE WHEN {s} IS NULL THEN NULL WHEN {f} IS NOT NULL THEN {num_tag(f)} "
            f"ELSE 's:' || {fold(text)} END)")


LINE_ORDER = ", ".join(D.LINE_ORDER)
RATES = "[" + ", ".join(f"CAST({r} AS DECIMAL(6,4))" for r in TAX_RATES) + "]"
CURS = "[" + ", ".join(lit(c) for c in CURRENCIES) + "]"

GOLD_CTE = f"""
gold_lines AS (
  SELECT l.l_orderkey, {', '.join('l.' + c for c in D.LINE_ORDER)}, p.p_name AS description,
         CAST(l.l_quantity AS DECIMAL(18,2)) AS quantity,
         {money('l.l_extendedprice / l.l_quantity')} AS unit_price
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey),
gold_items AS (
  SELECT l_orderkey,
         list(struct_pack(description := description, quantity := quantity, unit_price := unit_price,
              amount := {money('quantity * unit_price')}) ORDER BY {LINE_ORDER}, description) AS line_items,
         sum({money('quantity * unit_price')}) AS amount_sum
  FROM gold_lines GROUP BY l_orderkey),
gold_base AS (
  SELECT o.o_orderkey AS id, c.c_name AS vendor,
         printf('INV-%d-%06d', year(o.o_orderdate), o.o_orderkey) AS invoice_number,
         CAST(o.o_orderdate AS DATE) AS invoice_date,
         coalesce(gi.line_items, []) AS line_items,
         {money('coalesce(gi.amount_sum, 0)')} AS subtotal,
         {RATES}[o.o_orderkey % 10 + 1] AS rate,
         {CURS}[o.o_orderkey % 11 + 1] AS currency
  FROM orders o LEFT JOIN gold_items gi ON o.o_orderkey = gi.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
gold_tax AS (SELECT *, {money('subtotal * rate')} AS tax FROM gold_base),
gold AS (SELECT id, vendor, invoice_number, invoice_date, line_items, subtotal, tax,
                {money('subtotal + tax')} AS total, currency FROM gold_tax)"""


def item_json(it: str, money_fmt=num) -> str:
    return (f"'{{\"description\":' || {jq(it + '.description')} || ',\"quantity\":' || {num(it + '.quantity')} "
            f"|| ',\"unit_price\":' || {money_fmt(it + '.unit_price')} || ',\"amount\":' || "
            f"{money_fmt(it + '.amount')} || '}}'")


def completion(items_json: str, subtotal: str, tax: str, total: str) -> str:
    return (f"('{{\"vendor\":' || {jq('vendor')} || ',\"invoice_number\":' || {jq('invoice_number')} || "
            f"',\"invoice_date\":' || {jq(chr(34) + 'x' + chr(34))[:0]}to_json(strftime(invoice_date, '%Y-%m-%d')) || "
            f"',\"line_items\":[' || array_to_string({items_json}, ',') || '],\"subtotal\":' || {subtotal} || "
            f"',\"tax\":' || {tax} || ',\"total\":' || {total} || ',\"currency\":' || {jq('currency')} || '}}')")


COMPLETION = completion("list_transform(line_items, lambda it: " + item_json("it") + ")",
                        num("subtotal"), num("tax"), num("total"))

PRED_CTE = f"""
gold_c AS (
  SELECT *, list_transform(line_items, lambda it: {item_json('it')}) AS items_json,
         list_transform(line_items, lambda it: {item_json('it', dollar)}) AS items_text
  FROM gold),
gold_v AS (
  SELECT id, {completion('items_json', num('subtotal'), num('tax'), num('total'))} AS c,
         {completion('items_json', num('subtotal'), num('tax'), num('total + 1'))} AS wrong_total,
         {completion('list_filter(items_json, lambda x, i: i < len(items_json))', num('subtotal'), num('tax'), num('total'))} AS dropped,
         {completion('list_concat(items_json, items_json[1:1])', num('subtotal'), num('tax'), num('total'))} AS duplicated,
         {completion('items_text', dollar('subtotal'), dollar('tax'), dollar('total'))} AS as_text
  FROM gold_c),
gold_p AS (
  SELECT id, c, CASE id % 10
      WHEN 0 THEN c
      WHEN 1 THEN {lit(D.FENCE_OPEN)} || c || {lit(D.FENCE_CLOSE)}
      WHEN 2 THEN {lit(D.PROSE_BEFORE)} || c || {lit(D.PROSE_AFTER)}
      WHEN 3 THEN c || {lit(D.TRAILING)}
      WHEN 4 THEN substr(c, 1, CAST(floor(length(c) / 2) AS BIGINT))
      WHEN 5 THEN wrong_total
      WHEN 6 THEN dropped
      WHEN 7 THEN duplicated
      WHEN 8 THEN as_text
      ELSE {lit(D.NO_JSON)} END AS varied
  FROM gold_v),
predictions AS (
  SELECT 'baseline' AS tag, id, varied AS prediction FROM gold_p
  UNION ALL
  SELECT 'tuned' AS tag, id, CASE WHEN id % 20 < 10 THEN varied ELSE c END AS prediction FROM gold_p)"""


def clean_expr(raw: str) -> str:
    t = f"regexp_replace({raw}, '^{WS}+|{WS}+$', '', 'g')"
    fenced = f"(CASE WHEN starts_with({t}, '```') THEN regexp_replace({t}, '^```(?:json)?{WS}*|{WS}*```$', '', 'g') ELSE {t} END)"
    return fenced


def salvage_expr(t: str) -> str:
    last = f"instr(reverse({t}), '}}')"
    end = f"(CASE WHEN {last} > 0 THEN length({t}) - {last} + 1 ELSE 0 END)"
    start = f"instr({t}, '{{')"
    return (f"(CASE WHEN starts_with({t}, '{{') THEN {t} WHEN {start} > 0 AND {end} > {start} "
            f"THEN substr({t}, {start}, {end} - {start} + 1) END)")


SCALAR_LIST = "[" + ", ".join(lit(f) for f in SCALAR_FIELDS) + "]"
ITEM_LIST = "[" + ", ".join(lit(f) for f in ITEM_FIELDS) + "]"
NUMERIC_FIELDS = "(" + ", ".join(lit(f) for f in MONEY_FIELDS + ["unit_price", "amount"]) + ")"


def _row_float(jt: str, s: str) -> str:
    return (f"(CASE WHEN {jt} IN {NUM_TYPES} THEN CAST({s} AS DOUBLE) "
            f"WHEN {jt} = 'BOOLEAN' THEN CAST({s} = 'true' AS DOUBLE) "
            f"WHEN {jt} = 'VARCHAR' THEN {py_float(s)} END)")


def _row_date_ok(jt: str, s: str, x: str) -> str:
    epoch = f"(floor({x}) = {x} AND ({x} - 86400 * floor({x} / 86400)) = 0)"
    text = (f"((regexp_matches({s}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND TRY_CAST({s} AS DATE) IS NOT NULL) OR "
            f"(regexp_matches({s}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]00:00(?::00(?:\\.0+)?)?(?:Z|[+-]00:?00)?$') "
            f"AND TRY_CAST(substr({s}, 1, 10) AS DATE) IS NOT NULL))")
    return (f"coalesce(CASE WHEN {jt} = 'VARCHAR' THEN {text} OR (regexp_matches({s}, '^\\d+$') AND {epoch}) "
            f"WHEN {jt} IN {NUM_TYPES} THEN {epoch} ELSE false END, false)")


PARSED_CTE = f"""
pred_strip AS (SELECT tag, id, prediction, {clean_expr('prediction')} AS stripped FROM predictions),
pred_clean AS (SELECT tag, id, prediction, stripped, {salvage_expr('stripped')} AS clean FROM pred_strip),
pred_parsed AS (
  SELECT tag, id, prediction, stripped, clean,
         coalesce(CASE WHEN json_valid(clean) THEN json_type(clean) = 'OBJECT' END, false) AS parsed_ok
  FROM pred_clean),
pred_paths AS (
  SELECT tag, id, clean, coalesce(json_type(clean, '$.line_items') = 'ARRAY', false) AS items_is_list,
         list_concat(
           list_transform({SCALAR_LIST}, lambda f: {{'path': f, 'field': f, 'jp': '$.' || f}}),
           flatten(list_transform(
             range(CASE WHEN json_type(clean, '$.line_items') = 'ARRAY'
                        THEN CAST(json_array_length(clean, '$.line_items') AS BIGINT) ELSE 0 END),
             lambda i: list_transform({ITEM_LIST}, lambda f: {{
               'path': 'line_items[' || i || '].' || f, 'field': f,
               'jp': '$.line_items[' || i || '].' || f}})))) AS paths
  FROM pred_parsed WHERE parsed_ok),
pred_rows AS (
  SELECT tag, id, items_is_list, p.path AS path, p.field AS field,
         json_type(clean, p.jp) AS jt, json_extract_string(clean, p.jp) AS s,
         CAST(json_extract(clean, p.jp) AS VARCHAR) AS j
  FROM (SELECT tag, id, clean, items_is_list, unnest(paths) AS p FROM pred_paths)),
pred_rows2 AS (
  SELECT *, {_row_float('jt', 's')} AS x FROM pred_rows),
pred_rows3 AS (
  SELECT *,
    CASE WHEN jt IS NULL OR jt = 'NULL' THEN NULL
         WHEN jt = 'BOOLEAN' THEN 'b:' || s
         WHEN jt IN {NUM_TYPES} THEN {num_tag('CAST(s AS DOUBLE)')}
         WHEN jt = 'VARCHAR' THEN {str_tag('s')}
         ELSE 's:' || j END AS vtag,
    CASE WHEN field IN ('vendor', 'invoice_number', 'description') THEN coalesce(jt = 'VARCHAR', false)
         WHEN field = 'invoice_date' THEN {_row_date_ok('jt', 's', 'x')}
         WHEN field = 'quantity' THEN coalesce(NOT isnan(x) AND x > 0, false)
         WHEN field IN {NUMERIC_FIELDS} THEN coalesce(NOT isnan(x) AND x >= 0, false)
         WHEN field = 'currency' THEN jt IS NULL OR coalesce(jt = 'VARCHAR' AND length(s) = 3, false)
    END AS ok,
    starts_with(path, 'line_items[') AS in_item
  FROM pred_rows2),
pred_rec AS (
  SELECT tag, id,
    list(path || '=' || vtag ORDER BY path) FILTER (WHERE vtag IS NOT NULL) AS pe,
    list_filter([
      CASE WHEN NOT bool_and(ok) FILTER (WHERE field = 'vendor' AND NOT in_item) THEN 'vendor' END,
      CASE WHEN NOT bool_and(ok) FILTER (WHERE field = 'invoice_number') THEN 'invoice_number' END,
      CASE WHEN NOT bool_and(ok) FILTER (WHERE field = 'invoice_date') THEN 'invoice_date' END,
      CASE WHEN NOT (bool_and(items_is_list) AND coalesce(bool_and(ok) FILTER (WHERE in_item), true))
           THEN 'line_items' END,
      CASE WHEN NOT bool_and(ok) FILTER (WHERE field = 'subtotal') THEN 'subtotal' END,
      CASE WHEN NOT bool_and(ok) FILTER (WHERE field = 'tax') THEN 'tax' END,
      CASE WHEN NOT bool_and(ok) FILTER (WHERE field = 'total') THEN 'total' END,
      CASE WHEN NOT bool_and(ok) FILTER (WHERE field = 'currency') THEN 'currency' END],
      lambda x: x IS NOT NULL) AS problems
  FROM pred_rows3 GROUP BY tag, id),
pred_valid AS (
  SELECT p.tag, p.id, p.prediction, p.stripped, p.clean, p.parsed_ok, r.problems,
         coalesce(r.pe, []) AS pe, p.parsed_ok AND coalesce(len(r.problems) = 0, false) AS schema_valid
  FROM pred_parsed p LEFT JOIN pred_rec r ON p.tag = r.tag AND p.id = r.id),
gold_rows AS (
  SELECT id, p.path AS path, p.s AS s, p.d AS d FROM (
    SELECT id, unnest(list_concat([
        {{'path': 'vendor', 's': vendor, 'd': NULL::DOUBLE}},
        {{'path': 'invoice_number', 's': invoice_number, 'd': NULL::DOUBLE}},
        {{'path': 'invoice_date', 's': strftime(invoice_date, '%Y-%m-%d'), 'd': NULL::DOUBLE}},
        {{'path': 'subtotal', 's': NULL::VARCHAR, 'd': CAST(subtotal AS DOUBLE)}},
        {{'path': 'tax', 's': NULL::VARCHAR, 'd': CAST(tax AS DOUBLE)}},
        {{'path': 'total', 's': NULL::VARCHAR, 'd': CAST(total AS DOUBLE)}},
        {{'path': 'currency', 's': currency, 'd': NULL::DOUBLE}}],
      flatten(list_transform(range(len(line_items)), lambda i: [
        {{'path': 'line_items[' || i || '].description', 's': line_items[i + 1].description, 'd': NULL::DOUBLE}},
        {{'path': 'line_items[' || i || '].quantity', 's': NULL::VARCHAR, 'd': CAST(line_items[i + 1].quantity AS DOUBLE)}},
        {{'path': 'line_items[' || i || '].unit_price', 's': NULL::VARCHAR, 'd': CAST(line_items[i + 1].unit_price AS DOUBLE)}},
        {{'path': 'line_items[' || i || '].amount', 's': NULL::VARCHAR, 'd': CAST(line_items[i + 1].amount AS DOUBLE)}}])))) AS p
    FROM gold)),
gold_flat AS (
  SELECT id, list(path || '=' || vtag ORDER BY path) FILTER (WHERE vtag IS NOT NULL) AS ge FROM (
    SELECT id, path, CASE WHEN d IS NOT NULL THEN {num_tag('d')} ELSE {str_tag('s')} END AS vtag
    FROM gold_rows) GROUP BY id),
scored AS (
  SELECT p.tag, p.id, p.parsed_ok, p.schema_valid, p.pe, coalesce(g.ge, []) AS ge
  FROM pred_valid p JOIN gold_flat g ON p.id = g.id),
confusion AS (
  SELECT tag, id, parsed_ok, schema_valid,
         CAST(CASE WHEN parsed_ok THEN len(list_intersect(pe, ge)) ELSE 0 END AS BIGINT) AS tp,
         CAST(CASE WHEN parsed_ok THEN len(pe) - len(list_intersect(pe, ge)) ELSE 0 END AS BIGINT) AS fp,
         CAST(CASE WHEN parsed_ok THEN len(ge) - len(list_intersect(pe, ge)) ELSE len(ge) END AS BIGINT) AS fn,
         parsed_ok AND len(list_intersect(pe, ge)) = len(pe) AND len(list_intersect(pe, ge)) = len(ge) AS exact
  FROM scored)"""

WITH_ALL = "WITH " + GOLD_CTE.strip() + "," + PRED_CTE + "," + PARSED_CTE + "\n"

REPORT_CTE = """
report_agg AS (
  SELECT tag, count(*) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn,
         sum(CAST(exact AS INT)) AS n_exact, sum(CAST(parsed_ok AS INT)) AS n_parsed,
         sum(CAST(schema_valid AS INT)) AS n_valid
  FROM confusion GROUP BY tag),
report_pr AS (
  SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS p,
            coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS r
  FROM report_agg),
report AS (
  SELECT tag, CAST(n AS BIGINT) AS n, round(p, 4) AS field_precision, round(r, 4) AS field_recall,
         round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS field_f1,
         round(coalesce(CAST(n_exact AS DOUBLE) / nullif(n, 0), 0.0), 4) AS exact_match_rate,
         round(coalesce(CAST(n_parsed AS DOUBLE) / nullif(n, 0), 0.0), 4) AS json_parse_rate,
         CASE WHEN n > 0 THEN round(1 - CAST(n_parsed AS DOUBLE) / n, 4) ELSE 0.0 END AS invalid_json_syntax_rate,
         round(coalesce(CAST(n_valid AS DOUBLE) / nullif(n, 0), 0.0), 4) AS schema_validity_rate
  FROM report_pr)"""

WITH_REPORT = WITH_ALL.rstrip() + "," + REPORT_CTE + "\n"

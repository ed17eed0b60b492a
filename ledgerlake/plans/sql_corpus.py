"""DuckDB spellings of corpus generation and rendering, for the oracle."""

from __future__ import annotations

from ledgerlake.operators import corpus as C
from ledgerlake.operators.invoice import CURRENCIES, TAX_RATES
from ledgerlake.plans.sql_invoice import item_json, lit, money, num, jq

SEED = 7


def draw(id_expr: str, slot_expr: str, seed: int = SEED) -> str:
    return (f"(CAST(('0x' || substr(md5('{seed}:' || CAST({id_expr} AS VARCHAR) || ':' || {slot_expr}), 1, 8)) "
            f"AS BIGINT) / 4294967296.0)")


def hexd(id_expr: str, group_expr: str, j, seed: int = SEED) -> str:
    """Draw ``j`` (0-3) of md5(seed:id:group), as uniform [0, 1)."""
    start = f"(8 * ({j}) + 1)"
    return (f"(CAST(('0x' || substr(md5('{seed}:' || CAST({id_expr} AS VARCHAR) || ':' || {group_expr}), {start}, 8)) "
            f"AS BIGINT) / 4294967296.0)")


def pick(values, u: str) -> str:
    arr = "[" + ", ".join(lit(str(v)) for v in values) + "]"
    return f"{arr}[CAST(floor({u} * {len(values)}) AS INT) + 1]"


def fmt(x: str, cur: str = "currency") -> str:
    return (f"((CASE {cur} WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'CAD' THEN 'CA$' "
            f"ELSE '' END) || format('{{:,.2f}}', CAST({x} AS DOUBLE)))")


PROD_VALUES = ", ".join(f"({k}, {lit(n)}, {lo}, {hi})" for k, (n, lo, hi) in enumerate(C.PRODUCTS))
RATES = "[" + ", ".join(lit(str(r)) for r in TAX_RATES) + "]"

GEN_CTE = f"""
gen_ids AS (SELECT o_orderkey AS id FROM orders),
gen_prod AS (SELECT * FROM (VALUES {PROD_VALUES}) p(k, description, low, high)),
gen_head AS (
  SELECT id,
    {pick(C.VENDOR_STEMS, hexd('id', "'head'", 0))} || ' ' || {pick(C.VENDOR_SUFFIXES, hexd('id', "'head'", 1))} AS vendor,
    CAST(DATE '{C.FIRST_DAY}' + CAST(floor({hexd('id', "'head'", 2)} * {C.DAY_SPAN}) AS INT) AS DATE) AS invoice_date,
    {pick(C.NUMBER_PREFIXES, hexd('id', "'head'", 3))} AS prefix,
    CAST(floor({hexd('id', "'more'", 0)} * {C.MAX_SEQ}) + 1 AS INT) AS seq,
    CAST(floor({hexd('id', "'more'", 1)} * {C.MAX_ITEMS}) + 1 AS INT) AS n_items,
    CAST({pick(TAX_RATES, hexd('id', "'more'", 2))} AS DECIMAL(6,4)) AS rate,
    {pick(CURRENCIES, hexd('id', "'more'", 3))} AS currency
  FROM gen_ids),
gen_ranked AS (
  SELECT h.id, p.k, p.description, p.low, p.high,
         row_number() OVER (PARTITION BY h.id ORDER BY {hexd('h.id', "'rank:' || (p.k // 4)", 'p.k % 4')}, p.k) AS pos, h.n_items
  FROM gen_head h, gen_prod p),
gen_lines AS (
  SELECT id, pos, description,
         CAST(floor({hexd('id', "'item:' || k", 0)} * {C.MAX_QTY}) + 1 AS DECIMAL(18,2)) AS quantity,
         {money(f"low + (high - low) * {hexd('id', chr(39) + 'item:' + chr(39) + ' || k', 1)}")} AS unit_price
  FROM gen_ranked WHERE pos <= n_items),
gen_items AS (
  SELECT id, list(struct_pack(description := description, quantity := quantity, unit_price := unit_price,
                              amount := {money('quantity * unit_price')}) ORDER BY pos) AS line_items,
         sum({money('quantity * unit_price')}) AS amount_sum
  FROM gen_lines GROUP BY id),
gen_sub AS (
  SELECT h.id, h.vendor, printf('%s-%d-%05d', h.prefix, year(h.invoice_date), h.seq) AS invoice_number,
         h.invoice_date, i.line_items, {money('i.amount_sum')} AS subtotal, h.rate, h.currency
  FROM gen_head h JOIN gen_items i USING (id)),
gen_tax AS (SELECT *, {money('subtotal * rate')} AS tax FROM gen_sub),
gen AS (SELECT id, vendor, invoice_number, invoice_date, line_items, subtotal, tax,
               {money('subtotal + tax')} AS total, currency FROM gen_tax)"""


def date_variant(d: str, u: str) -> str:
    fmts = ["%Y-%m-%d", "%m/%d/%Y", "%d %B %Y", "%B %-d, %Y", "%d-%b-%Y"]
    k = f"CAST(floor({u} * 5) AS INT)"
    return "(CASE " + k + " " + " ".join(f"WHEN {n} THEN strftime({d}, '{f}')" for n, f in enumerate(fmts)) + " END)"


def qty(x: str) -> str:
    return f"CAST(CAST({x} AS INT) AS VARCHAR)"


def render_table(dt: str) -> str:
    items = (f"list_transform(line_items, lambda x: printf('%-26s%5s%14s%14s', x.description, {qty('x.quantity')}, "
             f"{fmt('x.unit_price')}, {fmt('x.amount')}))")
    head = (f"[vendor, 'INVOICE ' || invoice_number, 'Date: ' || {dt}, '', {lit(C.TABLE_HEADER)}, "
            f"{lit(C.TABLE_RULE)}]")
    tail = (f"[{lit(C.TABLE_RULE)}, printf('%45s%13s', 'Subtotal', {fmt('subtotal')}), "
            f"printf('%45s%13s', 'Tax', {fmt('tax')}), printf('%45s%13s', 'TOTAL DUE', {fmt('total')}), '', "
            f"'All amounts in ' || currency || '.']")
    return f"array_to_string(list_concat({head}, {items}, {tail}), chr(10))"


def render_email(dt: str) -> str:
    items = (f"array_to_string(list_transform(line_items, lambda x: {qty('x.quantity')} || 'x ' || x.description || "
             f"' at ' || {fmt('x.unit_price')} || ' (' || {fmt('x.amount')} || ')'), '; ')")
    nl = "chr(10)"
    return (f"('Subject: Invoice ' || invoice_number || ' from ' || vendor || {nl} || {nl} || 'Hi there,' || {nl} || {nl} "
            f"|| 'Please find our invoice dated ' || {dt} || ' attached. We billed the following: ' || {items} "
            f"|| '.' || {nl} || {nl} || 'That comes to ' || {fmt('subtotal')} || ' before tax, with ' || {fmt('tax')} "
            f"|| ' tax applied, for a total of ' || {fmt('total')} || ' ' || currency || ' due on receipt.' || {nl} "
            f"|| {nl} || 'Thanks,' || {nl} || 'Accounts Receivable' || {nl} || vendor)")


def render_receipt(dt: str) -> str:
    items = (f"flatten(list_transform(line_items, lambda x: [x.description, '  ' || {qty('x.quantity')} || ' @ ' "
             f"|| {fmt('x.unit_price')} || ' = ' || {fmt('x.amount')}]))")
    head = f"['*** ' || upper(vendor) || ' ***', 'Ref ' || invoice_number || '  ' || {dt}, '']"
    tail = (f"['', 'SUB ' || {fmt('subtotal')}, 'TAX ' || {fmt('tax')}, 'TOT ' || {fmt('total')} || ' (' || currency "
            f"|| ')', 'THANK YOU FOR YOUR BUSINESS']")
    return f"array_to_string(list_concat({head}, {items}, {tail}), chr(10))"


def render_prose(dt: str) -> str:
    items = (f"array_to_string(list_transform(line_items, lambda x: x.description || ' (qty ' || {qty('x.quantity')} "
             f"|| ', ' || {fmt('x.amount')} || ')'), ', ')")
    return (f"('Record of charges from ' || vendor || ', reference ' || invoice_number || ', issued ' || {dt} "
            f"|| '. The order covered ' || {items} || '. Net of tax the balance was ' || {fmt('subtotal')} "
            f"|| '; tax added ' || {fmt('tax')} || ', bringing the amount payable to ' || {fmt('total')} || ' in ' "
            f"|| currency || '.')")


DT = date_variant("invoice_date", hexd("id", "'render'", 0))
STYLE_K = f"CAST(floor({hexd('id', chr(39) + 'render' + chr(39), 1)} * 4) AS INT)"
RENDER_CTE = f"""
rendered AS (
  SELECT *, {pick(C.STYLES, hexd('id', "'render'", 1))} AS style,
         CASE {STYLE_K} WHEN 0 THEN {render_table(DT)} WHEN 1 THEN {render_email(DT)}
              WHEN 2 THEN {render_receipt(DT)} ELSE {render_prose(DT)} END AS text
  FROM gen)"""


def ocr(text: str, rate: float) -> str:
    inner = (f"array_to_string(list_transform(string_split(tok, ''), lambda c, ci: CASE WHEN c IN ('S', 'O') AND "
             f"{draw('id', chr(39) + 'ocr:' + chr(39) + ' || (ti - 1) || ' + chr(39) + ':' + chr(39) + ' || (ci - 1)')} "
             f"< {rate} THEN translate(c, 'SO', '50') ELSE c END), '')")
    return (f"array_to_string(list_transform(string_split({text}, ' '), lambda tok, ti: CASE WHEN "
            f"regexp_matches(tok, '[0-9]') THEN tok ELSE {inner} END), ' ')")


GEN_COMPLETION = ("('{\"vendor\":' || " + jq("vendor") + " || ',\"invoice_number\":' || " + jq("invoice_number")
                  + " || ',\"invoice_date\":' || to_json(strftime(invoice_date, '%Y-%m-%d')) || ',\"line_items\":[' || "
                  "array_to_string(list_transform(line_items, lambda it: " + item_json("it") + "), ',') || "
                  "'],\"subtotal\":' || " + num("subtotal") + " || ',\"tax\":' || " + num("tax") + " || ',\"total\":' || "
                  + num("total") + " || ',\"currency\":' || " + jq("currency") + " || '}')")

WITH_GEN = "WITH " + GEN_CTE.strip() + "\n"
WITH_RENDER = "WITH " + GEN_CTE.strip() + "," + RENDER_CTE + "\n"


def indented_json() -> str:
    """DuckDB spelling of corpus.indented_json over gen/rendered columns."""
    item = ("'    {' || chr(10) || '      \"description\": ' || " + jq("x.description") + " || ',' || chr(10) || "
            "'      \"quantity\": ' || " + num("x.quantity") + " || ',' || chr(10) || "
            "'      \"unit_price\": ' || " + num("x.unit_price") + " || ',' || chr(10) || "
            "'      \"amount\": ' || " + num("x.amount") + " || chr(10) || '    }'")
    items = ("(CASE WHEN len(line_items) = 0 THEN '[]' ELSE '[' || chr(10) || array_to_string("
             "list_transform(line_items, lambda x: " + item + "), ',' || chr(10)) || chr(10) || '  ]' END)")
    nl = " || chr(10) || "
    return ("('{'" + nl + "'  \"vendor\": ' || " + jq("vendor") + " || ','" + nl
            + "'  \"invoice_number\": ' || " + jq("invoice_number") + " || ','" + nl
            + "'  \"invoice_date\": ' || to_json(strftime(invoice_date, '%Y-%m-%d')) || ','" + nl
            + "'  \"line_items\": ' || " + items + " || ','" + nl
            + "'  \"subtotal\": ' || " + num("subtotal") + " || ','" + nl
            + "'  \"tax\": ' || " + num("tax") + " || ','" + nl
            + "'  \"total\": ' || " + num("total") + " || ','" + nl
            + "'  \"currency\": ' || " + jq("currency") + nl + "'}')")


def render_prompt_sql() -> str:
    head, rest = C.RENDER_PROMPT.split("{style}")
    mid, tail = rest.split("{payload}")
    style = pick(C.LLM_STYLES, hexd("id", "'render'", 2))
    return f"({lit(head)} || {style} || {lit(mid)} || {indented_json()} || {lit(tail)})"

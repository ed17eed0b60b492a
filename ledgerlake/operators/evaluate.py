"""Field-level evaluation of raw model output against gold invoices.

Per record the work is a narrow projection (parse, validate, flatten,
compare two small arrays); the only shuffles are the prediction/gold join on
``id`` and the final partial+final aggregate per run tag, so the driver sees
one row per run.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import values as V
from ledgerlake.functions.jsontext import salvage_object, strip_fences
from ledgerlake.functions.text import once
from ledgerlake.operators.invoice import ITEM_FIELDS, MONEY_FIELDS, SCALAR_FIELDS

STRICT_SCHEMA = "array<map<string,string>>"
DAY_SECONDS = 86400
# One pass over a record: its fields and those of its items, as values of their own.
SCALARS = "struct<" + ",".join(f"{f}:variant" for f in SCALAR_FIELDS) + ">"
ITEMS = "array<struct<" + ",".join(f"{f}:variant" for f in ITEM_FIELDS) + ">>"
# Half of a character, which only the strict reader judges.
HALF_CHARACTER = r"\\u[dD][89a-fA-F]"
NOT_JSON_NUMBER = r"([:\[,]\s*)(NaN|-?Infinity)(?=\s*[,\]}])"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_MIDNIGHT = r"^\d{4}-\d{2}-\d{2}[T ]00:00(?::00(?:\.0+)?)?(?:Z|[+-]00:?00)?$"


def _json_type(schema: Column) -> Column:
    """JSON type of a VARIANT value by its schema: its own type name, but one name for all numbers."""
    # plain comparisons, the frequent types first: inside lambdas a list of values is slow to search
    return (F.when(schema.startswith("DECIMAL"), F.lit("NUMBER"))
            .when((schema == "STRING") | (schema == "VOID") | (schema == "BOOLEAN"), schema)
            .when(schema.startswith("OBJECT"), F.lit("OBJECT"))
            .when(schema.startswith("ARRAY"), F.lit("ARRAY"))
            .when(schema.isNotNull(), F.lit("NUMBER")))


def facts(x: Column) -> Column:
    """What scoring and validation need from one JSON value: type name (NULL
    when absent), text (strings), double (numbers and booleans) and, for all
    but strings and numbers, the printed JSON."""
    def of_schema(schema: Column) -> Column:
        string = schema == "STRING"
        number = schema.startswith("DECIMAL") | ~(string | (schema == "VOID") | (schema == "BOOLEAN") | schema.startswith("OBJECT") | schema.startswith("ARRAY"))
        return F.struct(
            _json_type(schema).alias("t"),
            F.when(string, F.try_variant_get(x, "$", "string")).alias("s"),
            # to a string is cheap, to a double Spark builds a cast for every value; only an infinity needs it
            F.when(string, F.lit(None).cast("double"))
            .when(number, F.coalesce(F.try_variant_get(x, "$", "string").try_cast("double"), F.try_variant_get(x, "$", "double")))
            .when(schema == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double")).alias("d"),
            F.when(~(string | number), F.to_json(x)).alias("j"))

    return once(F.schema_of_variant(x), of_schema)


def _present(f: Column) -> Column:
    return f["t"].isNotNull() & (f["t"] != "VOID")


def _is_string(f: Column) -> Column:
    return F.coalesce(f["t"] == "STRING", F.lit(False))


def _float_of(f: Column) -> Column:
    """Lax float coercion of a JSON value: numbers, booleans, numeric text."""
    return F.when(f["t"] == "STRING", V.py_float(f["s"])).otherwise(f["d"])


def _num_ok(f: Column, strict_positive: bool = False) -> Column:
    def ok(x: Column) -> Column:
        return ~F.isnan(x) & (x > 0 if strict_positive else x >= 0)

    return F.coalesce(F.when(_is_string(f), once(V.py_float(f["s"]), ok)).otherwise(ok(f["d"])), F.lit(False))


def _date_ok(f: Column) -> Column:
    t, s = f["t"], f["s"]
    as_text = (s.rlike(ISO_DATE) & F.try_to_date(s, "yyyy-MM-dd").isNotNull()) | (
        s.rlike(ISO_MIDNIGHT) & F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd").isNotNull())
    epoch = _float_of(f)
    as_epoch = (F.floor(epoch) == epoch) & (F.pmod(epoch, F.lit(float(DAY_SECONDS))) == 0)
    return F.coalesce(F.when(t == "STRING", as_text | (s.rlike(r"^\d+$") & as_epoch))
                      .when(t == "NUMBER", as_epoch).otherwise(F.lit(False)), F.lit(False))


def facts_tag(f: Column) -> Column:
    """Type-tagged normalized value of one JSON value (NULL when absent/null)."""
    t = f["t"]
    return (F.when(t == "NUMBER", V.number_tag(f["d"]))
            .when(t == "STRING", V.string_tag(f["s"]))
            .when(t == "BOOLEAN", F.concat(F.lit("b:"), f["j"]))
            .when(_present(f), F.concat(F.lit("s:"), f["j"])))


def extract_record(df: DataFrame, record_col: str = "record") -> DataFrame:
    """Project a parsed record into per-field facts columns ``f_<field>`` and
    ``items`` (array of per-item facts, NULL when line_items is not a list).

    Two narrow projections: pull values, derive facts; each value is extracted
    once, and the facts of all fields come from one lambda.
    """
    v = F.col(record_col)
    pulled = df.select("*", F.try_variant_get(v, "$", SCALARS).alias("x_scalars"), F.try_variant_get(v, "$.line_items", ITEMS).alias("x_items"))
    told = pulled.select(
        *df.columns, F.transform(F.array(*[F.col("x_scalars")[f] for f in SCALAR_FIELDS]), facts).alias("x_facts"),
        F.transform("x_items", lambda e, i: F.struct(
            i.alias("idx"), *[facts(e[f]).alias(f) for f in ITEM_FIELDS])).alias("items"))
    return told.select(*df.columns, *[F.col("x_facts")[i].alias(f"f_{f}") for i, f in enumerate(SCALAR_FIELDS)], "items")


def _item_ok(e: Column) -> Column:
    return F.coalesce(_is_string(e["description"])
                      & _num_ok(e["quantity"], True) & _num_ok(e["unit_price"])
                      & _num_ok(e["amount"]), F.lit(False))


def json_invoice_problems() -> Column:
    """Failed schema rules over the extracted facts columns (lax coercion like
    the reference's model validation): strings must be JSON strings, money may
    be numeric text, absent currency defaults, explicit null currency fails."""
    cur = F.col("f_currency")
    items = F.col("items")
    rules = [
        F.when(~_is_string(F.col("f_vendor")), F.lit("vendor")),
        F.when(~_is_string(F.col("f_invoice_number")), F.lit("invoice_number")),
        F.when(~_date_ok(F.col("f_invoice_date")), F.lit("invoice_date")),
        F.when(items.isNull() | ~F.coalesce(F.forall(items, _item_ok), F.lit(False)), F.lit("line_items")),
    ]
    rules += [F.when(~_num_ok(F.col(f"f_{m}")), F.lit(m)) for m in MONEY_FIELDS]
    cur_ok = cur["t"].isNull() | F.coalesce(_is_string(cur) & (F.length(cur["s"]) == 3), F.lit(False))
    rules.append(F.when(~cur_ok, F.lit("currency")))
    return F.array_compact(F.array(*rules))


@contextmanager
def repeated_keys(spark: SparkSession) -> Iterator[None]:
    """JSON parsers that are built inside allow repeated keys; the caller's setting is put back."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def parse_predictions(df: DataFrame, raw_col: str = "prediction") -> DataFrame:
    """Add ``clean`` (text after fence strip and salvage), ``parsed_ok`` and
    ``record`` (VARIANT, only when parsed)."""
    out = df.withColumn("clean", salvage_object(strip_fences(F.col(raw_col))))
    wrapped = F.concat(F.lit("["), F.col("clean"), F.lit("]"))
    strict = F.from_json(wrapped, STRICT_SCHEMA, {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    # of a repeated key the last value counts, as with most JSON readers; NaN and infinities, which
    # JSON lacks but models write, become text that reads as such a number
    quoted = F.regexp_replace("clean", NOT_JSON_NUMBER, '$1"$2"')
    with repeated_keys(df.sparkSession):
        # nearly every answer is read once, in brackets that show what follows the object; the strict reader tells the rest
        out = out.withColumn("_whole", F.when(~F.col("clean").rlike(HALF_CHARACTER), F.try_parse_json(wrapped)))
        read = F.col("_whole").isNotNull()
        alone = F.try_variant_get("_whole", "$[1]", "variant").isNull()
        ok = F.when(read, alone).otherwise(once(strict, lambda x: (F.size(x) == 1) & x[0].isNotNull()))
        out = out.withColumn("parsed_ok", F.coalesce(F.col("clean").isNotNull() & ok, F.lit(False)))
        record = F.when(read, F.try_variant_get("_whole", "$[0]", "variant")).otherwise(F.coalesce(F.try_parse_json("clean"), F.try_parse_json(quoted)))
        return out.withColumn("record", F.when(F.col("parsed_ok"), record)).drop("_whole")


def validate_predictions(df: DataFrame) -> DataFrame:
    """parse_predictions + facts + ``problems`` and ``schema_valid``."""
    ex = extract_record(parse_predictions(df))
    problems = F.when(F.col("parsed_ok") & F.col("record").isNull(), F.array(F.lit("unparsed"))) \
        .when(F.col("parsed_ok"), json_invoice_problems())
    return (ex.withColumn("problems", problems)
            .withColumn("schema_valid", F.col("parsed_ok") & F.coalesce(F.size("problems") == 0, F.lit(False))))


def _entry(path: Column, tag: Column) -> Column:
    return F.concat(path, tag)  # null without a tag, which is computed once


def _tag_entries(src: Column, tagger) -> Column:
    """Array of (path with ``=``, value) structs -> non-null ``path=tag`` strings.

    The normalization expression appears once, inside the lambda, however
    many fields a record has; this keeps generated code small.
    """
    return F.filter(F.transform(src, lambda x: _entry(x["path"], tagger(x))),
                    lambda x: x.isNotNull())


#: Items whose paths are written out; those of further ones are put together.
WRITTEN_PATHS = 32


def _item_path(idx: Column, field: str) -> Column:
    written = F.array(*[F.lit(f"line_items[{i}].{field}=") for i in range(WRITTEN_PATHS)])
    return F.coalesce(F.get(written, idx), F.concat(F.lit("line_items["), idx.cast("string"), F.lit(f"].{field}=")))


def flatten_extracted() -> Column:
    """Extracted facts -> array of ``path=tag`` entries; absent/null values
    skipped, non-object line items skipped with their original index kept."""
    scalars = F.array(*[F.struct(F.lit(f"{f}=").alias("path"), F.col(f"f_{f}").alias("v"))
                        for f in SCALAR_FIELDS])
    items = F.flatten(F.transform(F.coalesce(F.col("items"), F.array()), lambda e: F.array(
        *[F.struct(_item_path(e["idx"], f).alias("path"), e[f].alias("v")) for f in ITEM_FIELDS])))
    return _tag_entries(F.concat(scalars, items), lambda x: facts_tag(x["v"]))


def flatten_invoice(inv: Column) -> Column:
    """Typed invoice struct (gold) -> ``path=tag`` entries."""
    numeric = set(MONEY_FIELDS) | {"quantity", "unit_price", "amount"}

    def src(path, f, c):
        if f in numeric:
            return F.struct(path.alias("path"), F.lit(None).cast("string").alias("s"),
                            c.cast("decimal(38,2)").alias("d"))
        text = F.date_format(c, "yyyy-MM-dd") if f == "invoice_date" else c
        return F.struct(path.alias("path"), text.alias("s"), F.lit(None).cast("decimal(38,2)").alias("d"))

    scalars = F.array(*[src(F.lit(f"{f}="), f, inv[f]) for f in SCALAR_FIELDS])
    items = F.flatten(F.transform(F.coalesce(inv["line_items"], F.array()), lambda e, i: F.array(
        *[src(_item_path(i, f), f, e[f]) for f in ITEM_FIELDS])))
    # Gold money is exact cents in DECIMAL: tag it by a direct cast.
    return _tag_entries(F.concat(scalars, items), lambda x: F.when(
        x["d"].isNotNull(), V.decimal_tag(x["d"])).otherwise(V.string_tag(x["s"])))


def field_confusion(tp: Column, n_pred: Column, n_gold: Column, parsed_ok: Column) -> list[Column]:
    """tp / fp / fn / exact for one record, from how many entries both sides share and each has. A wrong value is
    both fp and fn; an unparseable answer adds every gold field to fn."""
    return [
        F.when(parsed_ok, tp).otherwise(0).cast("bigint").alias("tp"),
        F.when(parsed_ok, n_pred - tp).otherwise(0).cast("bigint").alias("fp"),
        F.when(parsed_ok, n_gold - tp).otherwise(n_gold).cast("bigint").alias("fn"),
        (parsed_ok & (tp == n_pred) & (tp == n_gold)).alias("exact"),
    ]


def read_predictions(predictions: DataFrame, id_col: str = "id") -> DataFrame:
    """(tag, id, parsed_ok, schema_valid, pred_entries) of raw outputs (tag, id, prediction): narrow, no shuffle."""
    checked = validate_predictions(predictions.select("tag", id_col, "prediction"))
    return checked.select("tag", id_col, "parsed_ok", "schema_valid",
                          F.when(F.col("parsed_ok"), flatten_extracted()).otherwise(F.array().cast("array<string>")).alias("pred_entries"))


def _shipped(entries: Column) -> Column:
    """Entries as one text for a shuffle, which is much smaller than an array; ``_unshipped`` takes it apart. The separator
    cannot stand in an entry."""
    safe = F.transform(entries, lambda e: F.replace(F.replace(e, F.lit("\x02"), F.lit("\x02\x02")), F.lit("\x01"), F.lit("\x02\x03")))
    return F.array_join(safe, "\x01")


def _unshipped(text: Column) -> Column:
    return F.split(text, "\x01")


def score_records(predictions: DataFrame, gold: DataFrame, tags: list[str], id_col: str = "id") -> DataFrame:
    """Pair raw outputs (tag, id, prediction) of the runs ``tags`` with gold
    (id, ``invoice`` struct) by tag and id and score each pair.

    Both sides are parsed and flattened before they meet, so the join ships
    entries, not raw texts, and the targets once for all runs. A target without an answer scores as an unparseable one
    (all its fields are missed); an answer without a target has only false
    positives. Use ``runs.require_aligned`` to refuse such runs instead.
    """
    runs, tag = list(dict.fromkeys(tags)), F.col("tag")
    gold_flat = gold.select(F.col(id_col).alias("_id"), flatten_invoice(F.col("invoice")).alias("gold_entries"))
    gold_flat = gold_flat.select("_id", _shipped(F.col("gold_entries")).alias("gold_text"), F.size("gold_entries").alias("n_gold"))
    found = None
    for run in runs:
        # the runs share one exchange of the targets; the first run also takes the answers of no run, which match nothing
        elsewhere = [F.coalesce(tag == t, F.lit(False)) for t in runs[1:]]
        mine = predictions.where(tag == run) if run != runs[0] else predictions.where(~reduce(or_, elsewhere, F.lit(False)))
        read = read_predictions(mine, id_col)
        read = read.select("tag", id_col, "parsed_ok", "schema_valid", _shipped(F.col("pred_entries")).alias("pred_text"), F.size("pred_entries").alias("n_pred"))
        pairs = read.join(gold_flat, (F.col(id_col) == F.col("_id")) & (tag == run), "full_outer")
        n_pred, n_gold = F.coalesce("n_pred", F.lit(0)), F.coalesce("n_gold", F.lit(0))
        both = F.when((n_pred > 0) & (n_gold > 0), F.size(F.array_intersect(_unshipped(F.col("pred_text")), _unshipped(F.col("gold_text"))))).otherwise(0)
        # a projection of its own: the entries are intersected once, not once for every count
        met = pairs.select(F.when(F.col("parsed_ok").isNull(), F.lit(run)).otherwise(tag).alias("tag"), F.coalesce(id_col, "_id").alias(id_col), F.coalesce("parsed_ok", F.lit(False)).alias("parsed_ok"),
                           F.coalesce("schema_valid", F.lit(False)).alias("schema_valid"), both.alias("both"), n_pred.alias("n_pred"), n_gold.alias("n_gold"))
        found = met if found is None else found.unionByName(met)
    return found.select("tag", id_col, "parsed_ok", "schema_valid", *field_confusion(F.col("both"), F.col("n_pred"), F.col("n_gold"), F.col("parsed_ok")))


def _rate(num: Column, den: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0)), 4)


def score_report(records: DataFrame) -> DataFrame:
    """Micro precision / recall / F1 over all fields plus exact-match and JSON
    health rates, one row per run tag."""
    agg = records.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.sum(F.col("exact").cast("int")).alias("n_exact"),
        F.sum(F.col("parsed_ok").cast("int")).alias("n_parsed"),
        F.sum(F.col("schema_valid").cast("int")).alias("n_valid"))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return agg.select(
        "tag", F.col("n").cast("bigint").alias("n"),
        F.round(p, 4).alias("field_precision"), F.round(r, 4).alias("field_recall"),
        F.round(f1, 4).alias("field_f1"),
        _rate(F.col("n_exact"), F.col("n")).alias("exact_match_rate"),
        _rate(F.col("n_parsed"), F.col("n")).alias("json_parse_rate"),
        F.when(F.col("n") > 0, F.round(1 - F.col("n_parsed") / F.col("n"), 4)).otherwise(F.lit(0.0))
        .alias("invalid_json_syntax_rate"),
        _rate(F.col("n_valid"), F.col("n")).alias("schema_validity_rate"))

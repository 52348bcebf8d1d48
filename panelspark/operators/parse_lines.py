"""Raw delimited lines: load the rows that conform, and give every other line with its reason.

Strict load plus anti-join: the record offsets (line_id) stay with every line, the strict load keeps only conforming
lines, those are subtracted from the raw offsets, and only the remainder is diagnosed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import computed_once, join_dimension

#: Code points that are no characters, in place of `,` and `;` within quotes.
_MASKS = "\uffff\ufffe"
_DATE = r"^(\d{4})-(\d{2})-(\d{2})(?:[ T]([01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?)?\z"
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t]+|[ \t]+\z", "")


def _fields(line: Column, sep: Column) -> Column:
    """The raw fields of a line: cut at separators outside quotes."""
    inner = F.transform(F.split(line, '"', -1), lambda p, i: F.when(i % 2 == 1, F.translate(p, ",;", _MASKS)).otherwise(p))
    return F.when(F.instr(line, '"') == 0, F.split(line, sep, -1)).otherwise(F.split(F.array_join(inner, '"'), sep, -1))


def _value(field: Column) -> Column:
    """A raw field without blanks around it and without its quotes."""
    f = _strip(field)
    bare = F.replace(F.regexp_extract(f, r'(?s)^"(.*)"\z', 1), F.lit('""'), F.lit('"'))
    return _strip(F.translate(F.when(f.startswith('"'), bare).otherwise(f), _MASKS, ",;"))


def _well_quoted(line: Column, sep: Column) -> Column:
    """Quotes as in RFC 4180: they open at a field's start and close at its end; within, a quote is doubled."""
    parts = F.split(line, '"', -1)
    n = F.size(parts)
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    ends = ((first == "") | F.endswith(first, sep)) & ((last == "") | F.startswith(last, sep))
    between = F.slice(parts, 2, F.greatest(n - 2, F.lit(0)))  # from the first quoted part on, every second one is outside quotes
    checks = F.transform(between, lambda p, i: (i % 2 == 0) | (p == "") | (F.startswith(p, sep) & F.endswith(p, sep)))
    return (F.instr(line, '"') == 0) | ((n % 2 == 1) & ends & F.forall(checks, lambda x: x))


def _real_datetime(v: Column) -> Column:
    real = F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd").isNotNull()
    return F.coalesce(v.rlike(_DATE) & real, F.lit(False))


def _finite(v: Column) -> Column:
    return F.coalesce(v.rlike(_NUMBER) & (F.abs(v.try_cast("double")) < float("inf")), F.lit(False))


def headers(lines: DataFrame) -> DataFrame:
    """(file_name, sep, names, n_cols, at_datetime, at_close) of each file: from its line 1, positions from 1, 0 where there is none."""
    h = lines.filter("line_no = 1 AND line IS NOT NULL AND file_name IS NOT NULL").groupBy("file_name").agg(F.min("line").alias("line"))
    h = h.withColumn("line", F.regexp_replace("line", r"^\x{FEFF}|\r\z", ""))
    count = lambda ch: F.length("line") - F.length(F.replace("line", F.lit(ch), F.lit("")))
    h = h.withColumn("sep", F.when(count(";") > count(","), ";").otherwise(","))
    names = F.transform(_fields(F.col("line"), F.col("sep")), lambda f: F.lower(_value(f)))
    h = h.withColumn("names", names)
    at = lambda *which: F.array_position(F.transform("names", lambda n: n.isin(*which)), True).cast("int")
    return h.select("file_name", "sep", "names", F.size("names").alias("n_cols"), at("date", "datetime").alias("at_datetime"), at("close").alias("at_close"))


def _judged(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Lines after the header with reason (null: the line conforms), datetime and close; each line is taken apart once."""
    body = lines.filter("line_no IS NULL OR line_no <> 1")
    body = body.withColumn("body", F.regexp_replace(F.coalesce("line", F.lit("")), r"\r\z", ""))
    joined = join_dimension(body, layouts, "file_name", "left")
    joined = joined.withColumn("sep", F.coalesce("sep", F.lit(",")))
    joined = computed_once(joined, "f", _fields(F.col("body"), F.col("sep")))
    pick = lambda at: F.coalesce(_value(F.try_element_at("f", F.when(F.col(at) > 0, F.col(at)).otherwise(F.lit(1_000_000)))), F.lit(""))
    joined = computed_once(joined, "v", F.struct(pick("at_datetime").alias("datetime"), pick("at_close").alias("close")))
    counted_well = F.coalesce(F.size("f") == F.col("n_cols"), F.lit(False)) & (_strip(F.col("body")) != "")
    reason = (
        F.when(~_well_quoted(F.col("body"), F.col("sep")), "quoting")
        .when(~counted_well, "columns")
        .when(~_real_datetime(F.col("v.datetime")), "datetime")
        .when(~_finite(F.col("v.close")), "close")
    )
    judged = computed_once(joined, "reason", reason)
    return judged.select("line_id", "file_name", "line_no", "line", "reason", "v.datetime", "v.close", "f", "names")


def _columns(lines: DataFrame) -> DataFrame:
    return lines.select("line_id", "file_name", "line_no", "line")


def _layouts(lines: DataFrame) -> DataFrame:
    return cut_lineage(headers(lines))  # one row a file, read out of the lines once


def load_rows(lines: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(line_id, file_name, line_no, datetime, close, more...): the lines that conform in all respects, one row per line.

    more: further columns by their names in the header, as doubles; null where a file has none or the value is no
    number. Rows that repeat in all of these count once. Null offsets are offsets like any other.
    """
    lines = _columns(lines)
    ok = _judged(lines, _layouts(lines)).filter("reason IS NULL")
    stamp = F.to_timestamp(F.concat(F.substring("datetime", 1, 10), F.lit(" "), F.rpad(F.substring("datetime", 12, 8), 8, ":00")))
    whole = F.when(F.length("datetime") == 10, F.to_timestamp(F.col("datetime"))).otherwise(stamp)
    field = lambda c: _value(F.try_element_at("f", F.nullif(F.array_position("names", c).cast("int"), F.lit(0))))
    others = [F.when(_finite(field(c)), field(c).try_cast("double")).alias(c) for c in more]
    return ok.select("line_id", "file_name", "line_no", whole.alias("datetime"), F.col("close").cast("double").alias("close"), *others).distinct()


def failing_lines(lines: DataFrame) -> DataFrame:
    """(line_id, file_name, line_no, line, reason): every line after the header that load_rows does not give.

    The first reason that applies: quoting, columns (blank and null lines, and lines of files without a header,
    included), datetime, close. Repeated rows come out once; a line without line_id is told apart by file, number and
    text, so that no good line takes it away; an empty table gives an empty result.
    """
    lines = _columns(lines)
    layouts = _layouts(lines)
    offset = [F.col("line_id"), F.col("file_name"), F.col("line_no"), F.when(F.col("line_id").isNull(), F.col("line"))]
    names = [f"_o{i}" for i in range(len(offset))]
    loaded = _judged(lines, layouts).filter("reason IS NULL").select(*(c.alias(f"{n}l") for c, n in zip(offset, names)))
    raw = lines.filter("line_no IS NULL OR line_no <> 1").withColumns(dict(zip(names, offset)))
    same = [F.col(n).eqNullSafe(F.col(f"{n}l")) for n in names]
    rest = raw.join(loaded, reduce(lambda a, b: a & b, same), "left_anti").select(*lines.columns)
    return _judged(rest, layouts).filter("reason IS NOT NULL").select(*lines.columns, "reason").distinct()

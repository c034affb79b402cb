"""Rules as SQL expressions.

A rule is one SQL expression over named columns. ``spark`` and ``duck`` write
the few functions that the two engines name differently; the rest is common.

    @m(x, p)      whether pattern p occurs in x
    @n(x, p)      how often it does
    @all(x, p)    array of its occurrences
    @rep(x, p, r) x with all occurrences replaced
    @back(x, p, a, b)  each occurrence as a, its first group, b, its second
                  group if b isn't empty
    @strip(x, c)  x without leading and trailing characters of c
    @rstrip(x, c) x without trailing characters of c
    @bare(x)      x without accents
    @starts(x, y) whether x begins with y
    @words(x)     array of the parts of x between white space
    @cnt(a, c)    elements w of array a for which condition c holds
    @codes(a, b)  the parts that aren't null, joined by commas
    @even(x)      x rounded half to even
    @at(a, i)     the element of array a after i others, null if there is none
    @one()        the index of an array's first element
    @hash(x)      SHA-256 in hexadecimal digits
    @json(x, p)   what stands at path p of JSON text x, as text; null if nothing
    @quoted(x)    x as a JSON string, null for null
    @joined(x, o) texts of a group in the order of o, joined by spaces
    @amount(x)    the amount that a token stands for, in either notation
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import ACCENTED, PLAIN

_SPARK = {
    "m": "regexp_like({0}, {1})",
    "n": "size(regexp_extract_all({0}, {1}, 0))",
    "all": "regexp_extract_all({0}, {1}, 0)",
    "rep": "regexp_replace({0}, {1}, {2})",
    "back": "regexp_replace({0}, {1}, concat({2}, '$1', {3}, if({3} = '', '', '$2')))",
    "strip": "trim(both {1} from {0})",
    "rstrip": "trim(trailing {1} from {0})",
    "bare": f"translate({{0}}, '{ACCENTED}', '{PLAIN}')",
    "starts": "startswith({0}, {1})",
    "words": "filter(split({0}, r'\\s+'), w -> w <> '')",
    "cnt": "size(filter({0}, w -> {1}))",
    "codes": "array_join(array({*}), ',')",
    "even": "cast(bround({0}) as bigint)",
    "at": "get({0}, {1})",
    "one": "0",
    "hash": "sha2({0}, 256)",
    "json": "try_variant_get(try_parse_json({0}), {1}, 'string')",
    "quoted": "trim(leading '[' from trim(trailing ']' from to_json(array({0}))))",
    "joined": "listagg({0}, ' ') within group (order by {1})",
}
_DUCK = {
    "m": "regexp_matches({0}, {1})",
    "n": "len(regexp_extract_all({0}, {1}))",
    "all": "regexp_extract_all({0}, {1})",
    "rep": "regexp_replace({0}, {1}, {2}, 'g')",
    "back": "regexp_replace({0}, {1}, concat({2}, '\\1', {3}, case when {3} = '' then '' else '\\2' end), 'g')",
    "strip": "trim({0}, {1})",
    "rstrip": "rtrim({0}, {1})",
    "bare": "strip_accents({0})",
    "starts": "starts_with({0}, {1})",
    "words": "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')",
    "cnt": "cast(len(list_filter({0}, lambda w: {1})) as integer)",
    "codes": "coalesce(array_to_string([{*}], ','), '')",
    "even": "cast(bround({0}) as bigint)",
    "at": "get({0}, {1})",
    "one": "0",
    "even": "cast(round_even({0}, 0) as bigint)",
    "at": "{0}[{1} + 1]",
    "one": "1",
    "hash": "sha256({0})",
    "json": "json_extract_string({0}, {1})",
    "quoted": "coalesce(cast(to_json({0}) as varchar), 'null')",
    "joined": "string_agg({0}, ' ' order by {1})",
}


def _amount(b: str) -> str:
    """The number that ``b``, digits and marks, stands for."""
    dots, commas = f"length(@rep({b}, ~'[^.]', ''))", f"length(@rep({b}, ~'[^,]', ''))"

    def last(mark: str) -> str:
        return f"concat(replace(@rep({b}, ~'[{mark}][^{mark}]*$', ''), '{mark}', ''), '.', @rep({b}, ~'^.*[{mark}]', ''))"

    plain = f"case when {dots} > 1 and {commas} = 0 then {last('.')} when {commas} > 1 and {dots} = 0 then {last(',')} when {commas} > 0 and {dots} > 0 then case when @m({b}, ~',[^.]*$') then replace(replace({b}, '.', ''), ',', '.') else replace({b}, ',', '') end else replace({b}, ',', '.') end"
    return f"try_cast({plain} as decimal(18,3))"


_KEPT_MARKS, _SIGNED = "@rep({0}, ~'[^0-9,.-]', '')", "case when @m(%s, ~'^-') then -1 else 1 end"
_DUCK["amount"] = f"({_SIGNED % _KEPT_MARKS} * {_amount(f"@rep({_KEPT_MARKS}, ~'^[-+]+', '')")})"
# Spark writes the token out once: lambdas bind it with and without its sign.
_SPARK["amount"] = f"get(transform(array({_KEPT_MARKS}), k -> {_SIGNED % 'k'} * get(transform(array(@rep(k, ~'^[-+]+', '')), b -> {_amount('b')}), 0)), 0)"
_MACRO = re.compile(r"@([a-z]+)\(")


def _arguments(sql: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose parenthesis opened before ``at``."""
    out, start, depth, quoted, i = [], at, 0, False, at
    while True:
        c = sql[i]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            if c in "([":
                depth += 1
            elif c in ")]" and depth:
                depth -= 1
            elif c == ")":
                return [*out, sql[start:i]], i + 1
            elif c == "," and not depth:
                out.append(sql[start:i])
                start = i + 1
        i += 1


def _write(sql: str, names: dict[str, str]) -> str:
    while m := _MACRO.search(sql):
        found, end = _arguments(sql, m.end())
        found = [x.strip() for x in found]
        text = re.sub(r"\{(\*|[0-9])\}", lambda k: ", ".join(found) if k[1] == "*" else found[int(k[1])], names[m[1]])
        sql = sql[: m.start()] + text + sql[end:]
    return sql


def rx(pattern: str) -> str:
    """A pattern as a literal; patterns write an apostrophe as \\x27."""
    return f"~'{pattern}'"


def spark(sql: str) -> str:
    return _write(sql, _SPARK).replace("~'", "r'")


def duck(sql: str) -> str:
    return _write(sql, _DUCK).replace("~'", "'")


def split_methods(spark: SparkSession) -> None:
    """Have Spark split generated methods that the JVM is too large to compile
    (8000 bytes; beyond it they are interpreted)."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def column(sql: str) -> Column:
    return F.expr(spark(sql))


def one_of(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def any_in(c: str, values) -> str:
    """Whether a text holds any of the values."""
    return "(" + " or ".join(f"contains({c}, '" + v.replace("'", "''") + "')" for v in values) + ")"


def word_pattern(values) -> str:
    """A pattern for any of the values as a whole word."""
    return rx(r"\b(?:" + "|".join(re.escape(v).replace("\\ ", " ").replace("'", r"\x27") for v in values) + r")\b")

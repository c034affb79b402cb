"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once a document. The ledger stores the measurements
and, in one long, a bit for each rule that failed. A policy is a named,
versioned set of rules; applying it is a bitwise AND, and ablations (what a
policy would keep without one of its rules) are sums over the same bits.

The work is one narrow pass over the text in built-in functions: no shuffle,
no Python. Repeated word windows are found in the row: the 64-bit hashes of
its windows are sorted with their positions only where an ``array_distinct``
shows that any repeat exists, so the cost is n log n for the longest text.

Defined cases: a null text counts as one without words; rows are judged
alone, so ties, repeated rows and clashing column names change nothing; an
empty table gives an empty ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words

#: Name and condition of failure, over the columns of ``measured``. A rule's
#: place in the list is its bit, so new rules go to the end.
RULES = [
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("shouting", "100 * n_upper > 30 * word_chars"),
    ("exclamations", "100 * n_exclamations > 30 * n_words"),
    ("mean_word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words"),
]
#: Policies by name and version; an old version stays as it was.
POLICIES = {
    ("base", 1): ("too_few_words", "repeated_windows"),
    ("clean", 1): ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "exclamations", "mean_word_length"),
}


#: Up to so many different repeated windows are looked up in a list.
FEW = 48


def _covered(at: Column) -> Column:
    """Words under windows of three that start at the sorted places ``at``."""
    return let(at, lambda ps: F.aggregate(F.transform(ps, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(ps, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b))


def _by_lookup(hashes: Column, twice: Column) -> Column:
    return _covered(F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda p: p.isNotNull()))


def _by_sort(hashes: Column) -> Column:
    def repeated(ps: Column) -> Column:
        def same(x, j):
            return F.coalesce(F.get(ps, j)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(ps, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

    return _covered(let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), repeated))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements that the rules use, a row a document.

    n_repeat_words counts the words inside three-word windows that occur twice
    or more in the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    windows = F.transform(F.sequence(F.lit(0), F.size("ws") - 3), lambda i: F.xxhash64(F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2)))
    rows = docs.select("doc_id", words(F.col("text")).alias("ws"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("ls"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclamations"),
        F.when(F.size("ws") >= 4, windows).otherwise(F.array().cast("array<bigint>")).alias("hs"),
    )
    rows = rows.withColumn("sorted", F.when(F.size("hs") == F.size(F.array_distinct("hs")), F.array().cast("array<bigint>")).otherwise(F.sort_array("hs")))
    rows = rows.withColumn("twice", F.array_distinct(F.filter("sorted", lambda h, i: h == F.get("sorted", i + 1))))
    repeats = F.when(F.size("twice") == 0, 0).when(F.size("twice") <= FEW, _by_lookup(F.col("hs"), F.col("twice"))).otherwise(_by_sort(F.col("hs")))
    return rows.withColumn("n_repeat_words", repeats.cast("long")).drop("hs", "sorted", "twice")


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """The measurements with ``failed``: bit i is set where rule i failed."""
    bits = [F.when(F.expr(f"({when})"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, when) in enumerate(rules)]
    return measured(docs).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def mask(names, rules=RULES) -> int:
    place = {name: i for i, (name, _) in enumerate(rules)}
    return sum(1 << place[n] for n in names)


def keeps(policy: tuple[str, int], failed: str = "failed") -> Column:
    """Whether a policy keeps a row of the ledger."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: tuple[str, int]) -> DataFrame:
    """A row a rule of the policy: rows failing it, failing it alone, and kept
    by the policy without it. One pre-aggregated pass over the ledger."""
    whole = mask(POLICIES[policy])
    bits = [(n, mask([n])) for n in POLICIES[policy]]
    sums = []
    for n, bit in bits:
        sums += [
            F.count_if(F.col("failed").bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"{n}_fails"),
            F.count_if(F.col("failed").bitwiseAND(F.lit(whole).cast("long")) == bit).alias(f"{n}_alone"),
        ]
    one = rows.agg(F.count_if(keeps(policy)).alias("kept"), *sums)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_fails").alias("fails"), F.col(f"{n}_alone").alias("alone"), (F.col("kept") + F.col(f"{n}_alone")).alias("kept_without")) for n, _ in bits])))


def quality_report(docs: DataFrame) -> DataFrame:
    """The contract's view of the ledger under policy clean 1."""
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~keeps(("base", 1))).alias("base_failed"), keeps(("clean", 1)).alias("kept"))


SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
wins as (
  select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) as c
  from (select row_number() over () as rid, ws, unnest(range(1, len(ws) - 1)) as i from (select ws from (select doc_id, ws from w order by doc_id)))),
cover as (
  select rid, sum(least(3, coalesce(nxt - i, 3))) as n from (select rid, i, lead(i) over (partition by rid order by i) as nxt from wins where c > 1) group by rid),
m as (
  select row_number() over (order by doc_id) as rid, doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as n_upper,
         length(regexp_replace(text, '[^!]', '', 'g')) as n_exclamations
  from w),
f as (select m.*, coalesce(cover.n, 0) as n_repeat_words from m left join cover using (rid))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or 100 * n_dup_lines > 40 * n_lines
            or 100 * n_upper > 30 * word_chars or 100 * n_exclamations > 30 * n_words or word_chars > 20 * n_words or word_chars < 2 * n_words) as kept
from f
"""

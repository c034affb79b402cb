"""Scalar text functions as column expressions; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (the vocabulary that results depend on).
LEGAL_SUFFIXES = ("bv", "corp", "corporation", "eurl", "gmbh", "inc", "limited", "llc", "llp", "ltd", "nv", "plc", "sa", "sarl", "sas", "sasu", "snc", "spa", "suarl")
GENERIC_TOKENS = ("company", "corp", "corporation", "enterprise", "enterprises", "global", "group", "inc", "international", "limited", "llc", "ltd", "service", "services", "solution", "solutions", "trading")
ROLE_LABELS = ("from", "supplier", "vendor", "seller", "customer", "client", "buyer", "bill to", "ship to")
PLACEHOLDERS = ("todo", "tbd", "unknown", "n/a", "na", "none", "null", "placeholder", "replace me", "a completer", "a verifier", "-", "--")
DOTTED_FORMS = (("s.a.r.l", "sarl"), ("s.a", "sa"), ("l.l.c", "llc"), ("inc.", "inc"), ("ltd.", "ltd"))
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")



def _accents() -> tuple[str, str]:
    """Letters whose canonical decomposition is a letter and marks, with that
    letter; then the marks, which have no counterpart and so disappear."""
    import unicodedata

    old, new, marks = [], [], []
    for i in range(0xC0, 0x2000):
        c = chr(i)
        if unicodedata.category(c) == "Mn" and 0x300 <= i < 0x370:
            marks.append(c)
            continue
        whole = unicodedata.normalize("NFD", c)
        bare = "".join(x for x in whole if unicodedata.category(x) != "Mn")
        if len(whole) > 1 and len(bare) == 1 and unicodedata.category(c)[0] == "L":
            old.append(c)
            new.append(bare)
    return "".join(old + marks), "".join(new)


ACCENTED, PLAIN = _accents()


def compatible(c: Column) -> Column:
    """Compatibility composition (NFKC). Texts of ASCII and plain Latin letters
    are composed already; only others go to Python, in Arrow batches."""

    def run(texts):
        import unicodedata

        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.when(c.rlike("[^\\x00-\\x7FÀ-ÖØ-öø-ÿ°]"), F.pandas_udf(run, "string")(c)).otherwise(c)


def normalize_spacing(c: Column) -> Column:
    """Compatibility characters composed, runs of blanks to one, blank lines to
    at most one, trimmed."""
    c = F.regexp_replace(F.replace(compatible(F.coalesce(c, F.lit(""))), F.lit(chr(0xA0)), F.lit(" ")), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def ascii_digits(c: Column) -> Column:
    return F.translate(c, *DIGITS)


def words_only(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def plain_words(c: Column) -> Column:
    """words_only without accents."""
    return words_only(strip_accents(c))


def without_dots(c: Column) -> Column:
    """words_only after dotted legal forms are joined."""
    c = F.lower(F.coalesce(c, F.lit("")))
    for old, new in DOTTED_FORMS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return words_only(c)


def identifier(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def label_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def iban(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def without_markup(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "</?s_[A-Za-z0-9_]+>", " "), r"\s+", " "))


def compact(c: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most)


def safe_name(c: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), 1, most)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def without_repeats(c: Column) -> Column:
    """Adjacent equal tokens once."""
    parts = tokens(c)
    kept = F.filter(F.transform(parts, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(parts, x["i"] - 1) != x["t"]))
    return F.array_join(F.transform(kept, lambda x: x["t"]), " ")


def without_legal_form(c: Column) -> Column:
    return F.regexp_replace(c, "(?:(?:^| )(?:" + "|".join(LEGAL_SUFFIXES) + "))+$", "")


def without_role_label(c: Column) -> Column:
    labels = "|".join(sorted(ROLE_LABELS, key=len, reverse=True))
    return F.regexp_replace(c, f"^(?:{labels})(?: |$)", "")


def is_placeholder(c: Column) -> Column:
    return plain_words(c).isin(*PLACEHOLDERS)


def significant_tokens(c: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(c)), F.array(*map(F.lit, GENERIC_TOKENS)))


def is_meaningful(c: Column) -> Column:
    found = significant_tokens(c)
    return (F.size(found) > 0) & ~((F.size(found) == 1) & (F.length(F.get(found, F.lit(0))) < 4))


def letter_digit_fixed(c: Column) -> Column:
    """The letter O before a digit is a zero, I between digits is a one."""
    return F.regexp_replace(F.regexp_replace(c, "O(?=[0-9])", "0"), "(?<=[0-9])I(?=[0-9])", "1")


def similarity(a: Column, b: Column) -> Column:
    """0.9 if one holds the other, else Jaccard similarity of the tokens."""
    x, y = plain_words(a), plain_words(b)
    tx, ty = F.array_distinct(tokens(x)), F.array_distinct(tokens(y))
    union = F.size(F.array_union(tx, ty))
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(F.contains(x, y) | F.contains(y, x), 0.9)
        .otherwise(F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(tx, ty)) / union))
    )


def document_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def description(c: Column) -> Column:
    """A table description without its row number, at least three letters."""
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"^0?[0-9]{1,3}[ .)\-]+", ""), r"\s+", " ")
    c = F.regexp_replace(c, r"^[ |:\-]+|[ |:\-]+$", "")
    return F.when(F.length(F.regexp_replace(c, r"[^\p{L}]", "")) >= 3, c)


def first_match(c: Column, *patterns: str) -> Column:
    """The first group (or the whole) of the first pattern that occurs, case
    ignored, lines apart."""
    found = []
    for p in patterns:
        whole = F.regexp_extract(c, f"(?im){p}", 0)
        part = F.regexp_extract(c, f"(?im){p}", 1) if "(" in p.replace("(?", "") else F.lit("")
        found += [F.nullif(part, F.lit("")), F.nullif(whole, F.lit(""))]
    return F.coalesce(*found)


def table_norm(c: Column) -> Column:
    """Lower case without accents; digits, letters a-z, points, percent signs
    and Arabic letters, single spaces."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[^0-9a-z.%\x{0600}-\x{06FF}]+", " "))


def party_norm(c: Column) -> Column:
    """A party's name for comparison: entities and quotes resolved, then lower
    case without accents; digits, letters a-z and Arabic letters."""
    for old, new in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"')):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[^0-9a-z\x{0600}-\x{06FF}]+", " "))


def listed(c: Column) -> Column:
    """A list from JSON, or from parts between semicolons, trimmed."""
    parts = F.coalesce(F.from_json(c, "array<string>"), F.split(c, ";"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")

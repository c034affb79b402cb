"""Personal data: candidate spans scored by boosted trees.

Base spans follow fixed patterns and always stay. Besides, generators with
high recall propose spans that the base patterns miss (addresses written out
or defanged, telephone numbers without a plus sign, grouped card numbers).
Boosted trees score every candidate on its format and the text around it; a
threshold of calibrated probability for each kind selects what is redacted.

The main path is built-in functions in one narrow pass over the text: no
shuffle, no Python. Matches are found by marking them with a private-use
character and splitting at the marks, so offsets come out in code points. The
patterns are possessive where that changes no match, so that long runs of
digits or letters cost linear time and no stack.

The trees are fitted on the driver, in plain Python, on ``TRAIN_ROWS``
generated candidates (the documented bound; labels come from the generator),
and evaluated as SQL expressions.

Defined cases: a null text counts as empty; texts are judged alone, so ties,
repeated rows and clashing column names change nothing; private-use marks
that are in a text match no pattern and keep their width; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
SPANS = "array<struct<s:int,e:int,m:string>>"

_LOCAL = r"A-Za-z0-9._%+-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Proposals: kind, cheap test, pattern.
GENERATORS = [
    ("email", r"(?i)[\[({ ](?:at|dot)[\])} ]", r"(?i)(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{2,64}+(?: ?[\[({] ?at ?[\])}] ?| at )[A-Za-z0-9-]{2,63}+(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[A-Za-z0-9-]{2,24}+){1,4}"),
    ("ip", r"[0-9](?:\[\.\]|\(\.\))[0-9]", r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("card", r"[0-9]{4}[. /][0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[. /][0-9]{4}){3}(?![0-9])"),
    ("phone", r"[0-9]{2}[)./ -]{1,2}[0-9]{2,4}[./ -][0-9]{2}", r"(?<![0-9+])(?<![0-9][./-])(?:(?:1[ .-])?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\(?0[0-9](?:[ .-][0-9]{2}){4}|\(?0[0-9]{1,4}\)?[ ./-][0-9]{3,4}[ .-][0-9]{3,4})(?![0-9]|[./-][0-9])"),
]
BEFORE, AFTER = 24, 12
#: Format and context features: name and the pattern to find in the
#: candidate (m), in the text before it (b) or after it (a).
FEATURES = [
    ("brackets", "m", r"[\[({] ?(?:at|dot|AT|DOT|\.) ?[\])}]"),
    ("spelled_dot", "m", r"(?i)[ \])}]dot[ \[({]|\] ?dot"),
    ("spelled_at", "m", r"(?i)[ \[({]at[ \])}]"),
    ("top_domain", "m", r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es)$"),
    ("paren", "m", r"^\("),
    ("dashes", "m", r"^\(?[0-9]{3}\)?-[0-9]{3}-"),
    ("trunk", "m", r"^\(?0[0-9]"),
    ("exchange", "m", r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]"),
    ("spaces_only", "m", r"^[0-9 ]+$"),
    ("dots_only", "m", r"^[0-9.]+$"),
    ("card_prefix", "m", r"^(?:4|5[1-5]|3[47]|6)"),
    ("octet_over", "m", r"(?:^|[^0-9])(?:2[6-9][0-9]|25[6-9]|[3-9][0-9][0-9])(?:[^0-9]|$)"),
    ("two_part_local", "m", r"^[A-Za-z0-9]+[._][A-Za-z0-9]+ ?[\[({a]"),
    ("hint_mail", "b", r"(?i)mail|contact|write|reach"),
    ("hint_phone", "b", r"(?i)phone|call|tel|mobile|fax|cell|ring"),
    ("hint_card", "b", r"(?i)card|visa|credit|pay|account"),
    ("hint_ip", "b", r"(?i)\bip\b|host|server|addr|from"),
    ("hint_other", "b", r"(?i)order|part|serial|version|invoice|total|page|section|isbn"),
    ("colon", "b", r": ?$"),
    ("digit_near", "a", r"^[ ,;]{0,2}[0-9]"),
    ("unit_after", "a", r"^ ?(?:%|kg|km|eur|usd)"),
]
TRAIN_ROWS, ROUNDS, RATE, PRECISION, SEED = 6000, 40, 0.4, 0.95, 9


# ---- spans by marks -------------------------------------------------------


def spans(text: Column, pattern: str, test: Column) -> Column:
    """Leftmost non-overlapping matches as array of (s, e, m), code points."""

    def read(parts: Column) -> Column:
        def step(acc, part):
            width = F.locate(CLOSE, part) - 1
            hit = F.struct(acc["at"].alias("s"), (acc["at"] + width).alias("e"), F.substring(part, F.lit(1), width).alias("m"))
            return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

        start = F.struct(F.length(parts[0]).alias("at"), F.array().cast(SPANS).alias("out"))
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), start, step, lambda acc: acc["out"])

    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, OTHER + OTHER), pattern, f"{OPEN}$0{CLOSE}")
    return F.when(test, let(F.split(marked, OPEN), read)).otherwise(F.array().cast(SPANS))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Array of (s, e, m) for each kind by the fixed patterns."""

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    def card(x: Column) -> Column:
        return let(_digits(x["m"]), lambda d: F.length(d).between(14, 19) & _luhn(d))

    return {
        "email": spans(text, _EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, _IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), lambda x: F.forall(F.split(x["m"], r"\."), small)),
        "card": F.filter(spans(text, _CARD, text.rlike(_CARD)), card),
        "phone": F.filter(spans(text, _PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(_digits(x["m"])).between(10, 15)),
    }


# ---- trees ----------------------------------------------------------------


def _sample(rng: random.Random) -> tuple[str, str, str, str, int]:
    """A generated candidate: kind, m, b, a, label."""

    def word(n=0):
        return "".join(rng.choice("etaoinshrdlu") for _ in range(n or rng.randint(2, 8)))

    def some(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def odds(if_right: float, if_wrong: float) -> bool:
        return rng.random() < (if_right if label else if_wrong)

    # Both labels come in all forms and contexts, only with other odds, so that
    # no single feature tells them apart.
    kind, label = rng.choice(KINDS), rng.random() < 0.5
    if kind == "email":
        at, dot = rng.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", ".")] if odds(0.75, 0.12) else [(" at ", " dot "), (" at ", "."), (" at ", ".")])
        end = rng.choice(["com", "org", "net", "de", "fr", "io"]) if odds(0.95, 0.2) else word(rng.randint(3, 9))
        m = word() + (rng.choice([".", "_"]) + word() if odds(0.5, 0.1) else "") + at + word() + dot + end
    elif kind == "ip":
        most = 255 if odds(0.99, 0.45) else 999
        m = rng.choice(["[.]", "(.)"]).join(str(rng.randint(0, most)) for _ in range(4))
    elif kind == "card":
        sep = rng.choice(" ." if odds(0.9, 0.5) else "/.")
        m = sep.join([(rng.choice("456") if odds(0.97, 0.35) else rng.choice("0123789")) + some(3), *[some(4) for _ in range(3)]])
    elif odds(0.3, 0.35):  # with a trunk zero, in other groups
        sep = rng.choice(" .-/")
        m = "0" + rng.choice([sep.join([some(1), *[some(2) for _ in range(4)]]), f"{some(rng.randint(1, 4))}{sep}{some(rng.randint(3, 4))}{sep}{some(rng.randint(3, 4))}"])
    else:
        area, first = (rng.choice("23456789") + some(2) if odds(0.98, 0.3) else some(3) for _ in range(2))
        form = rng.choice("pds" if odds(0.8, 0.2) else "..s")
        m = {"p": f"({area}) {first}-{some(4)}", "d": f"{area}-{first}-{some(4)}", "s": f"{area} {first} {some(4)}", ".": f"{area}.{first}.{some(4)}"}[form]
    good = {"email": ["mail me: ", "contact ", "e-mail: ", "reach us "], "ip": ["server ", "host ", "from ", "ip "], "card": ["card: ", "visa ", "credit card ", "account "], "phone": ["call ", "tel: ", "phone: ", "mobile "]}[kind]
    before, after = word() + " " + word() + " ", " " + word()
    if odds(0.85, 0.04):
        before = word() + " " + rng.choice(good)
    elif odds(0.05, 0.75):
        before = word() + " " + rng.choice(["order ", "part ", "serial ", "version ", "invoice ", "total ", "page ", "section "])
    if odds(0.02, 0.35):
        after = rng.choice([" " + some(3), "%", " kg", " eur"])
    return kind, m, before[-BEFORE:], after[:AFTER], int(label)


def _vector(kind: str, m: str, b: str, a: str) -> list[int]:
    part = {"m": m, "b": b, "a": a}
    return [int(kind == k) for k in KINDS] + [int(bool(re.search(p, part[w]))) for _, w, p in FEATURES]


@cache
def model() -> tuple[list[tuple], dict[str, float]]:
    """Trees of depth two, as (feature, (feature, leaf, leaf), (feature, leaf,
    leaf)), and the score that each kind must reach.

    Newton boosting on logistic loss; the last quarter of the rows calibrates:
    a kind's threshold is the least score from which on at least ``PRECISION``
    of its held rows are right, halfway to the next score below.
    """
    rng = random.Random(SEED)
    rows = [_sample(rng) for _ in range(TRAIN_ROWS)]
    xs, ys = [_vector(*r[:4]) for r in rows], [r[4] for r in rows]
    fit = len(rows) * 3 // 4
    width, score, trees = len(xs[0]), [0.0] * len(rows), []

    def leaf(ids, g, h):
        return RATE * sum(g[i] for i in ids) / (sum(h[i] for i in ids) + 1.0)

    def split(ids, g, h):
        total_g, total_h = sum(g[i] for i in ids), sum(h[i] for i in ids)
        best = (0.0, 0)
        for f in range(width):
            on = [i for i in ids if xs[i][f]]
            sg, sh = sum(g[i] for i in on), sum(h[i] for i in on)
            gain = sg * sg / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            best = max(best, (gain, f))
        f = best[1]
        return f, [i for i in ids if xs[i][f]], [i for i in ids if not xs[i][f]]

    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [y - q for y, q in zip(ys, p)], [q * (1 - q) for q in p]
        f, on, off = split(range(fit), g, h)
        tree = [f]
        for side in (on, off):
            f2, yes, no = split(side, g, h)
            tree.append((f2, round(leaf(yes, g, h), 6), round(leaf(no, g, h), 6)))
        trees.append(tuple(tree))
        for i, x in enumerate(xs):
            f2, yes, no = tree[1] if x[f] else tree[2]
            score[i] += yes if x[f2] else no
    limits = {}
    for kind in KINDS:
        held = sorted(((score[i], ys[i]) for i in range(fit, len(rows)) if rows[i][0] == kind), reverse=True)
        right, limit = 0, math.inf
        for n, (s, y) in enumerate(held, 1):
            right += y
            after = held[n][0] if n < len(held) else s - 1
            if right >= PRECISION * n and after < s - 1e-6:
                limit = (s + after) / 2
        limits[kind] = limit
    return trees, limits


def _score(kind: Column, m: Column, b: Column, a: Column) -> Column:
    part = {"m": m, "b": b, "a": a}
    tests = [kind == k for k in KINDS] + [part[w].rlike(p) for _, w, p in FEATURES]

    def node(tree) -> Column:
        f, yes, no = tree
        return F.when(tests[f], _side(yes)).otherwise(_side(no))

    def _side(x) -> Column:
        return F.when(tests[x[0]], F.lit(x[1])).otherwise(F.lit(x[2]))

    return reduce(lambda p, q: p + q, [node(t) for t in model()[0]])


def chosen_spans(text: Column, base: Column) -> Column:
    """Accepted proposals as array of (s, rank, e, kind), none over a base span
    and none over another one of its kind that starts before it."""

    def one(kind: str, test: str, pattern: str) -> Column:
        def fits(x):
            b = F.substring(text, F.greatest(x["s"] - BEFORE, F.lit(0)) + 1, F.least(x["s"], F.lit(BEFORE)))
            a = F.substring(text, x["e"] + 1, F.lit(AFTER))
            ok = _score(F.lit(kind), x["m"], b, a) >= model()[1][kind]
            return ok & ~F.exists(base, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))

        kept = F.filter(spans(text, pattern, text.rlike(test)), fits)
        return F.transform(kept, _tag(kind))

    return F.concat(*[one(*g) for g in GENERATORS])


def _tag(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"))


# ---- operator -------------------------------------------------------------


def find(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``pii_base`` and ``pii_added``: arrays of
    (s, rank, e, kind) sorted by start, then kind as listed."""
    text = F.col("pii_text")
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("pii_text"))
    rows = rows.select(*keep, "pii_text", *[c.alias(f"pii_{k}") for k, c in base_spans(text).items()])
    tagged = [F.transform(F.col(f"pii_{k}"), _tag(k)) for k in KINDS]
    rows = rows.select(*keep, "pii_text", F.sort_array(F.concat(*tagged)).alias("pii_base"))
    return rows.select(*keep, "pii_base", F.sort_array(chosen_spans(text, F.col("pii_base"))).alias("pii_added"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """The contract's view: counts and digest of the base spans, all spans, and
    whether there are any."""
    rows = find(docs, "doc_id")
    counts = [F.size(F.filter("pii_base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.when(F.size("pii_added") == 0, F.col("pii_base")).otherwise(F.sort_array(F.concat("pii_base", "pii_added")))
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("pii_base")), 256).alias("base_sha256"), _joined(every).alias("spans"), (F.size(every) > 0).alias("has_pii"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of spans that
    overlap, the first by start, then kind, stands for all of them."""
    rows = find(docs, *docs.columns)

    def step(acc, x):
        taken = F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.when(x["s"] >= acc["at"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")).alias("out"),
        )
        return taken

    whole = F.aggregate(F.sort_array(F.concat("pii_base", "pii_added")), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when((F.size("pii_base") == 0) & (F.size("pii_added") == 0), F.col("text")).otherwise(whole)
    rows = rows.withColumn("pii_new", text)
    out = {"text": F.col("pii_new")} | ({"n_chars": F.length("pii_new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[out[c].alias(c) if c in out else c for c in docs.columns])

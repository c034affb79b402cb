"""Toxicity of texts whose words may be disguised.

A noisy channel: a writer turns letters into look-alikes (leetspeak), spaces a
word out, repeats letters or puts marks between them. Suspicious tokens become
lattices of the letters that each character may stand for; the Viterbi path
under a character trigram model of the corpus restores the word. A run of
spaced letters may hold several words, so one may begin at each of its letters.
The score is a logistic regression on parts of the restored words of a text,
wherever in a word they stand.

Distribution: the trigram counts cover every document, summed in each task
before one shuffle of a table bounded by the alphabet. The word list and its
weights are fitted on at most ``TRAIN_ROWS`` labelled rows (the documented
bound), those of least hash among the rows whose crc32 of doc_id modulo 3 is
not 1; exact copies count once. Scoring is one narrow pass in Arrow batches,
with the model (some thousand numbers) in the task closure.

Defined cases: a null or empty text scores as one without known words;
without labels every score is 0.5 or less and nothing is predicted toxic; a
null doc_id is not held out; a very long text is restored word by word, long
tokens in pieces that overlap; texts are judged alone, so ties, repeated rows
and clashing column names change nothing; an empty table gives an empty
result. Labels, language, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, texts_of

TRAIN_ROWS = 20_000
#: Most words in the model; a word's least rows and share of toxic rows.
MOST_WORDS, LEAST_ROWS, LEAST_SHARE, LEAST_PRECISION, MOST_CANDIDATES = 400, 8, 0.01, 0.8, 50_000
SHORTEST, LONGEST_PART = 3, 9
CLEAN_COST = 4
THRESHOLD = 0.7
#: What a character may stand for besides itself, with the cost of it.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
MARKS = "*.-_~^'`,:;/#&%"
COSTS = {"look": 0.7, "mark": 0.5, "mask": 4.0, "double": 0.3, "single": 0.3}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE = 26
#: Accented Latin letters count in the character model as their base.
FOLD = {i: b for i in range(0xC0, 0x180) if (b := unicodedata.normalize("NFD", chr(i))[0]).isascii() and b.isalpha()}
#: Runs of one character in a piece that is restored at once.
LONGEST = 48
#: Words that a worker keeps restored before it starts anew.
KEPT = 50_000

_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]{1,2}|[@$!|0-9][ .\-_*]{1,2}){2,}[^\W_](?!\w)")
_RUN = re.compile(r"(.)\1*", re.S)
_BETWEEN = re.compile(r"[\W\d_]+")
_TRIPLE = re.compile(r"([a-z@$!0-9])\1\1")
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡"


def trigram_counts(docs: DataFrame) -> list[int]:
    """Counts of letter trigrams over all texts; accents are folded, all that
    is no Latin letter is an edge."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        place = np.full(256, EDGE, np.int64)
        for i, c in enumerate(LETTERS):
            place[ord(c)] = place[ord(c.upper())] = i
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                if not text.isascii():
                    text = text.translate(FOLD)
                x = place[np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8)]
                total += np.bincount(x[:-2] * 729 + x[1:-1] * 27 + x[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = [0] * 27**3
    for r in rows:
        out[r["gram"]] = r["n"]
    return out


def language_model(counts: list[int]) -> list[float]:
    """Cost (negative log probability) of a letter after two others."""
    out = []
    for at in range(0, len(counts), 27):
        row = counts[at : at + 27]
        total = sum(row) + 27
        out += [math.log(total / (n + 1)) for n in row]
    return out


class Restorer(dict):
    """Maps a disguised token to the word that the channel most likely had."""

    def __init__(self, costs: list[float]):
        self.costs = costs

    def options(self, token: str) -> list[list[tuple[str, float]]]:
        """The lattice: for each run of one character, outputs and costs."""
        out = []
        for run in _RUN.finditer(token):
            c, n = run[1], len(run[0])
            if c not in LETTERS and c.isalpha() and c not in LOOKS:
                out.append([(c, 0.0)])
                continue
            if c in LETTERS:
                out.append([(c * n, 0.0)] if n == 1 else [(c * 2, COSTS["double"]), (c, COSTS["single"] + (n == 2) * 1.5)])
                continue
            found = [(x, COSTS["look"]) for x in LOOKS.get(c, "")]
            if n == 2:
                found += [(x * 2, 2 * COSTS["look"]) for x in LOOKS.get(c, "")]
            if c in MARKS or c == " ":
                found.append(("", COSTS["mark"]))
            if c in "*#":
                found += [(x * n, COSTS["mask"] * n) for x in LETTERS]
            out.append(found or [("", COSTS["mask"])])
        return out

    def __missing__(self, token: str) -> str:
        costs, paths = self.costs, {(EDGE, EDGE): (0.0, "")}
        for options in self.options(token):
            best: dict = {}
            for (a, b), (cost, word) in paths.items():
                for letters, extra in options:
                    x, y, total = a, b, cost + extra
                    for c in letters:
                        z = LETTERS.find(FOLD.get(ord(c), c)) % 27
                        total += costs[x * 729 + y * 27 + z]
                        x, y = y, z
                    if (x, y) not in best or best[x, y][0] > total:
                        best[x, y] = (total, word + letters)
            paths = best
        word = min((cost + costs[a * 729 + b * 27 + EDGE], word) for (a, b), (cost, word) in paths.items())[1]
        if len(self) >= KEPT:
            self.clear()
        self[token] = word
        return word

    def words(self, text: str) -> set[str]:
        """The different words of a text, disguised ones restored, each after a
        blank; what need not begin a word has none."""
        low = text.lower()
        found = set()
        triple = _TRIPLE.search(low) is not None
        for raw in set(low.split()):
            token = raw.strip(_STRIP)
            if token.isalpha() and not (triple and _TRIPLE.search(token)):
                found.add(" " + token)
            elif any(c in LETTERS for c in token) or not token:
                bare = raw.strip("\"'.,;:?-*#&%<>|")
                if bare and any(c in LETTERS for c in bare):
                    self.restored(bare, found)
                    if token != bare and token:
                        found.add(" " + token) if token.isalpha() else self.restored(token, found)
                    found.update(" " + w for w in _BETWEEN.split(bare) if len(w) >= SHORTEST and w.isalpha())
        for run in _SPACED.findall(low):
            for word in self.restored(run.replace(" ", ""), found):
                found.update(" " + word[i : i + LONGEST_PART] for i in range(1, len(word) - SHORTEST + 1))
        return found

    def restored(self, token: str, found: set[str]) -> list[str]:
        """Adds the word behind a token to ``found``, a long one in pieces that
        overlap by half; returns the pieces."""
        if len(token) <= LONGEST:
            pieces = [token]
        else:
            runs = [m[0][:3] for m in _RUN.finditer(token)]
            half = LONGEST // 2
            pieces = ["".join(runs[i : i + LONGEST]) for i in range(0, max(len(runs) - half, 1), half)]
        words = [self[x] for x in pieces]
        found.update((" " if i == 0 else "") + w for i, w in enumerate(words) if w)
        return words


def in_training(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of at most ``most`` labelled rows, one for each text.

    The ids are few by that bound, so they go to the tasks, not the texts to
    the ids."""
    train = labels.where(F.col("toxic").isNotNull() & in_training())
    ids = train.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("same")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: trigram costs, word weights, intercept."""
    costs = language_model(trigram_counts(docs))
    rows = cut(training_rows(docs, labels).select("text", "toxic"), "training")

    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    least = max(LEAST_ROWS if size["toxic"] >= 4 * LEAST_ROWS else 2, LEAST_SHARE * size["toxic"])

    def counted(only: set | None):
        """Rows that hold each part; given a set, only those in it."""

        def run(batches):
            import pyarrow as pa

            restore, counts = Restorer(costs), {}

            def batch_of():
                return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["part", "n"])

            for batch in batches:
                for text in texts_of(batch.column(0)):
                    own = parts(restore.words(text))
                    for x in own if only is None else own & only:
                        counts[x] = counts.get(x, 0) + 1
                    if len(counts) > KEPT:
                        yield batch_of()
                        counts.clear()
            yield batch_of()
            counts.clear()
            restore.clear()
            give_back()

        return run

    def totals(label: int, only: set | None) -> DataFrame:
        return rows.where(F.col("toxic") == label).select("text").mapInArrow(counted(only), "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))

    # Parts in enough toxic rows, then how many clean rows hold them.
    toxic = {r["part"]: r["n"] for r in totals(1, None).where(F.col("n") >= least).orderBy(F.desc("n"), "part").limit(MOST_CANDIDATES).collect()}
    clean = {r["part"]: r["n"] for r in totals(0, set(toxic)).collect()}
    known = _chosen(toxic, clean)

    def features(batches):
        import pyarrow as pa

        restore = Restorer(costs)
        for batch in batches:
            found = [sorted(known[w] for w in parts(restore.words(t)) if w in known) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch.column(1)], ["at", "toxic"])

    data = rows.select("text", F.col("toxic").cast("long")).mapInArrow(features, "at array<long>, toxic long").groupBy("at", "toxic").count().collect()
    # One feature more: that any of them is there.
    weights, intercept = _logistic([([*r["at"], len(known)] if r["at"] else [], r["toxic"], r["count"]) for r in data], len(known) + 1)
    return {"costs": costs, "weights": dict(zip(known, weights)), "any": weights[-1], "intercept": intercept}


def parts(words: set[str]) -> set[str]:
    """Parts of words of three to nine letters; those that begin a word also
    with the blank before them."""
    found = set()
    for w in words:
        first = w.startswith(" ")
        for i in range(first, len(w) - SHORTEST + 1):
            ends = range(i + SHORTEST, min(len(w), i + LONGEST_PART) + 1)
            found.update([w[i:k] for k in ends])
            if first and i == 1:
                found.update([w[:k] for k in ends])
    return found


def _chosen(toxic: dict, clean: dict) -> dict:
    """Precise parts by toxic rows less those of clean rows, which cost
    ``CLEAN_COST`` each, every part as long as it loses no row, none in another. One that must begin a word counts only if it isn't precise
    elsewhere."""
    good = {x for x, n in toxic.items() if n >= LEAST_PRECISION * (n + clean.get(x, 0))}
    # Given the same part elsewhere, one that begins a word only rules out others
    # that begin it.
    twins = {x for x in good if x[0] == " " and x[1:] in good}
    shorter = set()
    for x in good:
        for i in range(1 if x in twins else len(x)):
            shorter.update(y for k in range(i + SHORTEST, len(x) + 1) if (y := x[i:k]) != x and toxic.get(y) == toxic[x])
    out: dict = {}
    for x in sorted(good - twins - shorter, key=lambda x: (CLEAN_COST * clean.get(x, 0) - toxic[x], x)):
        if not any(x in y or y in x for y in out):
            out[x] = len(out)
        if len(out) == MOST_WORDS:
            break
    return out


def _logistic(rows: list[tuple], width: int, steps: int = 4000, ridge: float = 0.02) -> tuple[list[float], float]:
    """Weights and intercept of a ridge logistic regression by gradient steps
    with per-feature scaling; deterministic."""
    import numpy as np

    rows = sorted(rows)
    if not rows:
        return [0.0] * width, -2.0
    w, b = np.zeros(width), 0.0
    lens = np.array([len(at) for at, _, _ in rows])
    idx = np.array([i for at, _, _ in rows for i in at], dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), lens)
    y, n = np.array([t for _, t, _ in rows], float), np.array([c for _, _, c in rows], float)
    mass = np.bincount(idx, n[row], minlength=width) if width else np.zeros(0)
    for _ in range(steps):
        z = b + np.bincount(row, w[idx], minlength=len(rows)) if len(idx) else np.full(len(rows), b)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = n * (p - y)
        if width:
            w -= (np.bincount(idx, g[row], minlength=width) + ridge * w) / (mass * 0.25 + ridge) * 0.5
        b -= g.sum() / (n.sum() * 0.25) * 0.5
    return [float(x) for x in w], float(b)


def score(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """The columns ``keep`` and the score of every text."""
    schema = docs.select(*keep).schema.add("score", "double", False)

    def run(batches):
        import pyarrow as pa

        restore, weights, b = Restorer(model["costs"]), model["weights"], model["intercept"]
        for batch in batches:
            out = []
            for text in texts_of(batch.column(place)):
                words = "\n".join(restore.words(text))
                known = sorted(w for w in weights if w in words)
                z = b + sum(weights[w] for w in known) + (model["any"] if known else 0.0)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.float64())], [*keep, "score"])
        del restore
        give_back()

    place = keep.index("text") if "text" in keep else len(keep)
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's view: fit on the training labels, score every text."""
    rows = score(docs, fit(docs, labels), "doc_id")
    return rows.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; all columns stay."""
    return score(docs, fit(docs, labels), *docs.columns).where(F.col("score") < THRESHOLD).drop("score")

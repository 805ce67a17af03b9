"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a predicate over one document that is true when the document is to go. The rules' order changes the
cost of the cascade and never its verdict, which is their disjunction. `plan_cascade` runs every rule on a hash sample
of bounded size, takes its share of rejections and the work that its features do there (characters and words that they
visit, by the fixed price of a visit in WORK), and orders the rules by rejection per cost; `verdict` chains them in that
order in one CASE expression, so that a document pays only for the rules up to its first hit. Work is counted, not timed,
so the order is the same in every run.

Null and empty texts have no words and are rejected as short. Texts of any length are read whole, in one row each.
Repeated rows get the same verdict each. An empty table gives an empty one. Columns of the input pass through; the
features are named columns of the result and replace input columns of the same name.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import bound, words_of

SYMBOL_RE = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 256
#: Files that the sample is taken from.
SAMPLE_FILES = 8
#: What a feature costs: by row, by character and by word that it visits, in nanoseconds of one core, rounded. The words
#: themselves are cut once a row, whichever rule comes first, and cost no rule anything.
WORK = {
    "n_words": (10, 0, 0),
    "word_chars": (50, 1, 10),
    "n_symbols": (200, 10, 0),
    "n_lines": (200, 10, 0),
    "n_dup_lines": (300, 12, 0),
    "n_repeat_words": (500, 0, 400),
    "n_upper": (200, 20, 0),
    "n_bare_words": (100, 2, 150),
}
#: Features by name, in the order in which they may use one another.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bare_words")
_TEXT, _WORDS = "__quality_text", "__quality_words"


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _repeat_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. If all are distinct, as in most texts, nothing is sorted. Otherwise
    (hash, position) pairs are sorted, the positions of equal neighbours are kept, and the lengths that their
    windows cover are added up."""

    def hashes(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.size(w) - 2)

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def equal_neighbours(s: Column) -> Column:
            n = F.size(s)
            same = F.filter(
                F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | ((i + 1 < n) & (F.get(s, i + 1)["h"] == x["h"])), x["p"])),
                lambda p: p.isNotNull(),
            )
            return F.array_sort(same)

        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
        merge = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum"))
        return bound(pairs, lambda s: F.aggregate(equal_neighbours(s), zero, merge, lambda acc: acc["sum"]))

    some = bound(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some)


def _feature(name: str, text: Column, words: Column) -> Column:
    by_name = {
        "n_words": lambda: F.size(words),
        "word_chars": lambda: F.length(F.concat_ws("", words)),
        "n_symbols": lambda: F.regexp_count(text, F.lit(SYMBOL_RE)),
        "n_lines": lambda: F.size(_lines(text)),
        "n_dup_lines": lambda: bound(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": lambda: _repeat_words(words),
        "n_upper": lambda: F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_bare_words": lambda: F.size(F.filter(words, lambda w: ~w.rlike(r"\p{L}"))),
    }
    return by_name[name]().cast("long")


@dataclass(frozen=True)
class Rule:
    """A document goes if `rejects`, a function of the named features, is true."""

    name: str
    needs: tuple[str, ...]
    rejects: object

    def of(self, features: dict[str, Column]) -> Column:
        return self.rejects(*(features[n] for n in self.needs))


#: short and repeated are the base rules of the contract.
RULES = (
    Rule("short", ("n_words",), lambda n: n < MIN_WORDS),
    Rule("repeated", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > MAX_REPEAT_PERCENT * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 25 * n)),
    Rule("same_lines", ("n_dup_lines", "n_lines"), lambda d, n: (n >= 6) & (10 * d > 3 * n)),
    Rule("shouting", ("n_upper", "word_chars"), lambda u, n: 10 * u > 4 * n),
    Rule("bare_words", ("n_bare_words", "n_words"), lambda b, n: 10 * b > 3 * n),
)
BASE_RULES = ("short", "repeated")


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({_TEXT: text, _WORDS: words_of(text)})


def _lazy(names) -> dict[str, Column]:
    return {n: _feature(n, F.col(_TEXT), F.col(_WORDS)) for n in names}


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """About `rows` texts, chosen by hash out of at most SAMPLE_FILES files, which are chosen by the hash of their names;
    out of the whole table where it does not come from files."""
    texts = docs.select("text")
    files = sorted({f.rsplit("/", 1)[-1] for f in docs.inputFiles()}, key=lambda f: (zlib.crc32(f.encode()), f))
    if len(files) > SAMPLE_FILES:
        try:
            name = docs.metadataColumn("_metadata")["file_name"]
            texts = docs.filter(name.isin(files[:SAMPLE_FILES])).select("text")
        except AnalysisException:
            pass
    share = min(1.0, rows / max(1, texts.count()))
    return texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))


def plan_cascade(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by descending rejections per cost on a sample of about sample_rows rows; ties keep their order. One job
    counts the sample's rows, characters, words and each rule's rejections; costs are WORK times these, so every run has
    the same order. The sample decides the order alone, so its bound drops no document."""
    ready = _prepared(_sample(docs, sample_rows))
    hits = [F.count_if(F.coalesce(r.of(_lazy(r.needs)), F.lit(False))).alias(r.name) for r in rules]
    sizes = [F.count(F.lit(1)).alias("__rows"), F.sum(F.length(_TEXT)).alias("__chars"), F.sum(F.size(_WORDS)).alias("__words")]
    row = ready.agg(*sizes, *hits).first()
    n, chars, words = max(1, row["__rows"]), row["__chars"] or 0, row["__words"] or 0

    def cost(rule: Rule) -> float:
        return sum(a + (b * chars + c * words) / n for a, b, c in (WORK[name] for name in rule.needs))

    rated = [(-(row[r.name] / n) / cost(r), i, r) for i, r in enumerate(rules)]
    return [rule for _, _, rule in sorted(rated, key=lambda x: x[:2])]


def verdict(rules, features: dict[str, Column]) -> Column:
    """Name of the first rule of the cascade that rejects the row, null if none does."""
    out = None
    for rule in rules:
        test = F.coalesce(rule.of(features), F.lit(False))
        out = F.when(test, F.lit(rule.name)) if out is None else out.when(test, F.lit(rule.name))
    return out


def filter_quality(docs: DataFrame, rules=None) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs.

    The words are a lambda's variable here: as a column below a filter they would be computed anew wherever the
    filter's expressions use them, in the worst case for every word."""
    rules = rules or plan_cascade(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = bound(words_of(F.col("text")), lambda words: verdict(rules, {n: _feature(n, text, words) for r in rules for n in r.needs}))
    return docs.filter(hit.isNull())


def score_quality(docs: DataFrame, rules=None) -> DataFrame:
    """docs with the base features, base_failed, kept and rejected_by (the base rule first, else a rule of the cascade;
    which one of several depends on the measured order only where no base rule fails)."""
    rules = rules or plan_cascade(docs)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ready = _prepared(docs).withColumns(_lazy(base))
    known = {n: F.col(n) for n in base}
    features = _lazy([n for r in rules for n in r.needs if n not in base]) | known
    by = {r.name: r for r in RULES}
    base_failed = by["short"].of(known) | by["repeated"].of(known)
    rest = [r for r in rules if r.name not in BASE_RULES]
    out = ready.withColumn("base_failed", base_failed)
    hit = F.when(by["short"].of(known), F.lit("short")).when(by["repeated"].of(known), F.lit("repeated")).otherwise(verdict(rest, features))
    out = out.withColumn("rejected_by", hit)
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop(_TEXT, _WORDS)

"""Quality rules by weak supervision (built-in DataFrame functions only).

Rules look at a document and vote good (1), bad (-1) or abstain (0). How often a
rule is right is not known; expectation-maximisation estimates it, together with
the share of good documents, from how the rules agree over the whole corpus. The
posterior probability that a document is good then replaces a filter in which
every rule must pass.

The model is a mixture of good and bad documents in which every rule has, for
either kind, a chance of each of its three votes; nothing else is fixed. Rules may
therefore be loose: one that often says bad of good documents is found to say
little, and the others overrule it; a rule that abstains more on bad documents says
something by abstaining. Documents that fail the base rule are never kept, so the
model is fitted to the others.

The model sees only the number of documents of each combination of votes: at most
3^rules rows whatever the corpus size, so each round of the estimation is one
aggregation over that small table.

Defined results: null and empty texts have no words, fail the base rule and are
not kept. Repeated rows get the same result each. An empty table gives an empty
result. If no document passes the base rule, the model stays where it started. Other
columns are ignored or, with ``carry``, handed on in ``_row``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, staged, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
RULES = ("symbols", "dup_lines", "repeats", "word_length", "capitals", "sentence_ends", "variety")


#: Where the estimation starts: the share of good documents, and the chances of the votes bad, none, good for good and for bad documents.
START_SHARE, START_GOOD, START_BAD = 0.8, (0.05, 0.25, 0.7), (0.4, 0.3, 0.3)


@dataclass(frozen=True)
class Verdict:
    """Shares of good and bad documents; of either kind the chances of the votes bad, none and good, by rule."""

    shares: tuple[float, float] = (START_SHARE, 1 - START_SHARE)
    chances: tuple[tuple[tuple[float, ...], ...], ...] = ((START_GOOD,) * len(RULES), (START_BAD,) * len(RULES))


def _repeat_words(ws: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hash. Sorting (hash, place) brings equal windows
    together in n log n steps, so long texts cost in proportion; texts without a
    repeated window stop at the comparison with the distinct count.
    """

    def places(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda p: F.array_sort(
                F.transform(
                    F.filter(
                        p,
                        lambda x, k: F.coalesce((k > 0) & (x["h"] == F.get(p, k - 1)["h"]), F.lit(False))
                        | F.coalesce(x["h"] == F.get(p, k + 1)["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            at,
            start,
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(places(h))))
    return F.when(F.size(ws) < WINDOW + 1, F.lit(0)).otherwise(found)


def _measures(text: Column) -> Column:
    """All counts of a text in one struct, from one split into words."""
    text = F.coalesce(text, F.lit(""))

    def of(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
            F.coalesce(_repeat_words(ws), F.lit(0)).cast("long").alias("n_repeat_words"),
        )

    return let(words(text), of)


def measures(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """The kept columns of docs with the counts that the rules use."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
    m = docs.select(
        *keep,
        _measures(F.col(text)).alias("_m"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, "\\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.regexp_count(t, F.lit("[.!?](?=[ \\t-\\r]|$)")).cast("long").alias("n_ends"),
    )
    return m.select(*keep, "_m.*", "_l.*", "n_symbols", "n_capitals", "n_ends")


def _votes() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.col(c) / n

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    length = F.col("word_chars") / n
    return {
        "symbols": vote(share("n_symbols") > 0.1, share("n_symbols") < 0.02),
        "dup_lines": vote(F.col("n_dup_lines") * 10 > F.col("n_lines"), F.col("n_dup_lines") == 0),
        "repeats": vote(share("n_repeat_words") > 0.05, share("n_repeat_words") < 0.01),
        "word_length": vote((length < 4) | (length > 7), length.between(4.4, 6.5)),
        "capitals": vote(F.col("n_capitals") * 10 > F.col("word_chars"), F.col("n_capitals") * 25 < F.col("word_chars")),
        "sentence_ends": vote((share("n_ends") < 0.03) | (share("n_ends") > 0.3), share("n_ends").between(0.05, 0.2)),
        "variety": vote((n >= 50) & (share("n_distinct") < 0.45), share("n_distinct") > 0.6),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def posterior(model: Verdict) -> Column:
    """Probability that a document with the votes v_<rule> is good.

    The model is one literal array, so that each round of the estimation runs the same compiled plan.
    """
    kinds = [F.struct(F.lit(math.log(share)).alias("share"), F.array(*[F.array(*[F.lit(math.log(x)) for x in rule]) for rule in rules]).alias("rules")) for share, rules in zip(model.shares, model.chances)]
    votes = F.array(*[F.col(f"v_{r}") for r in RULES])

    def weight(kind: Column) -> Column:
        said = F.zip_with(votes, kind["rules"], lambda v, rule: F.get(rule, v + 1))
        return F.aggregate(said, kind["share"], lambda a, x: a + x)

    return let(F.transform(F.array(*kinds), weight), lambda w: 1 / (1 + F.exp(w[1] - w[0])))


def estimate(patterns: DataFrame, rounds: int = 40, tolerance: float = 1e-5) -> Verdict:
    """Expectation-maximisation over ``patterns`` (v_<rule>..., n); one pseudo count for each chance keeps it off 0 and 1."""
    model = Verdict()
    votes = [f"v_{r}" for r in RULES]
    for _ in range(rounds):
        w = patterns.select(*votes, "n", posterior(model).alias("p")).select(*votes, (F.col("p") * F.col("n")).alias("w0"), ((1 - F.col("p")) * F.col("n")).alias("w1"))
        sums = [F.sum(w_).alias(w_) for w_ in ("w0", "w1")]
        sums += [F.sum(F.when(F.col(v) == k - 1, F.col(f"w{kind}")).otherwise(0.0)).alias(f"{v}_{k}_{kind}") for v in votes for k in range(3) for kind in (0, 1)]
        r = w.agg(*sums).first()
        if r["w0"] is None:
            return model
        all_ = r["w0"] + r["w1"]
        shares = tuple((r[f"w{kind}"] + 1) / (all_ + 2) for kind in (0, 1))
        chances = tuple(tuple(tuple((r[f"{v}_{k}_{kind}"] + 1) / (r[f"w{kind}"] + 3) for k in range(3)) for v in votes) for kind in (0, 1))
        done = abs(shares[0] - model.shares[0]) < tolerance
        model = Verdict(shares, chances)
        if done:
            break
    return model


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), carry: bool = False, threshold: float = 0.5) -> DataFrame:
    """Measures, votes, ``posterior``, ``base_failed`` and ``kept`` of every row.

    ``keep`` names the columns of docs to return; with ``carry`` the whole row comes
    back in the struct ``_row`` instead, so that no name can clash.
    """
    if carry:
        rows = measures(packed(docs, text), f"_{text}", "_row")
        keep = ("_row",)
    else:
        rows = measures(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, text))]), text, *keep)
    rows = staged(rows.withColumns({f"v_{r}": v for r, v in _votes().items()}), "measures")
    patterns = staged(rows.where(~base_failed()).groupBy(*[f"v_{r}" for r in RULES]).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns").coalesce(1)
    model = estimate(patterns)
    return rows.withColumn("base_failed", base_failed()).withColumn("posterior", posterior(model)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their own columns."""
    return judge(docs, text, carry=True).where("kept").select("_row.*")

"""Quality rules as weak supervision (native): rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, Scratch, let, quoted, words

#: The symbols that the base counts.
SYMBOLS = "#*$%&|<>"
LETTERS = UPPER + LOWER
#: Frequent function words of English, Spanish, French and German.
FUNCTION_WORDS = (
    "the of and to in a is that it for on was with as be by at are this from or have not "
    "de la que el en y los del se las por un para con no una su al lo "
    "le et les des du une est pour qui dans par pas au sur "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine auch"
)


def n_of(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeated_words(ws: Column, window: int = 3) -> Column:
    """Words that lie in a window of words found twice or more, the first included.

    Windows are hashed, (hash, place) pairs sorted, and those with an equal neighbour kept; their places in
    order add the words that they cover beyond the one before.
    """
    n = F.size(ws) - window + 1
    hashed = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - window), lambda i: F.struct(F.xxhash64(*[F.get(x, i + k) for k in range(window)]).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    places = let(F.array_sort(let(ws, hashed)), twice)
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate(places, start, lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(window), i - acc["last"])).alias("sum")), lambda acc: acc["sum"])
    return F.when(n >= 2, covered).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts that rules vote on, a row a document, without a shuffle. All are 0 for a null or empty text."""
    t = F.coalesce(docs[quoted(text)].cast("string"), F.lit(""))
    at = docs.select(docs[quoted(key)].alias("doc_id"), t.alias("t"), words(t).alias("ws"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    return at.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "ws")).cast("long").alias("word_chars"),
        n_of(F.col("t"), SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
        let(lines, F.size).cast("long").alias("n_lines"),
        n_of(F.col("t"), UPPER).alias("n_upper"),
        n_of(F.col("t"), LETTERS).alias("n_letters"),
        n_of(F.col("t"), "!").alias("n_shouts"),
        n_of(F.col("t"), ".?").alias("n_stops"),
        F.size(F.filter("ws", lambda w: w.isin([x for w in FUNCTION_WORDS.split() for x in (w, w.capitalize())]))).cast("long").alias("n_function"),
    )


@dataclass(frozen=True)
class Rule:
    """A rule votes -1 (bad) if `bad` holds, else 1 (good) if `good` holds, else abstains (0).

    slip: how often good documents are voted bad, to begin with; hint: how often bad ones are voted good, next to 0.9 of the good ones.
    """

    name: str
    bad: str
    good: str
    slip: float = 0.01
    hint: float = 0.6

    def start(self) -> tuple[dict[int, float], dict[int, float]]:
        """Likelihoods of votes given bad and good."""
        bad, good = {-1: 0.25, 1: self.hint}, {-1: self.slip, 1: 0.9}
        return tuple({**x, 0: 1 - sum(x.values())} for x in (bad, good))


#: Each rule looks at other evidence and votes both ways, with room to abstain between.
RULES = (
    Rule("length", "n_words < 50", "n_words >= 80", slip=0.02),
    Rule("symbols", "100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    Rule("repetition", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    Rule("lines", "100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0 and n_lines > 1", slip=0.02),
    Rule("shouting", "100 * n_upper > 40 * n_letters", "100 * n_upper between n_letters and 15 * n_letters"),
    Rule("exclamations", "100 * n_shouts > 15 * n_words", "100 * n_shouts <= 2 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    Rule("sentences", "100 * n_stops < n_words or 100 * n_stops > 60 * n_words", "100 * n_stops between 3 * n_words and 25 * n_words", slip=0.02),
    Rule("function_words", "100 * n_function < 5 * n_words", "100 * n_function >= 15 * n_words", slip=0.02),
    Rule("line_shape", "n_words < 4 * n_lines", "n_words >= 8 * n_lines", slip=0.02),
)


@dataclass
class LabelModel:
    """P(good) and, for each rule, the log-likelihood ratios of its votes -1, 0 and 1."""

    prior: float
    ratios: list[dict[int, float]]
    accuracies: list[float]

    @classmethod
    def fit(cls, patterns: dict[tuple[int, ...], int], rules=RULES, rounds: int = 100, hold: float = 0.05) -> LabelModel:
        """Expectation-maximisation over counts of vote patterns.

        Votes are independent given the class; abstaining may depend on it too. There are at most
        3^rules patterns, however many documents they count. The starting likelihoods weigh as `hold` of
        all documents, which keeps the classes from changing places or meaning.
        """
        total = sum(patterns.values())
        prior, smooth = 0.7, max(1.0, hold * total)
        like = [r.start() for r in rules]
        for _ in range(rounds if total else 0):
            counts = [[{v: smooth * p for v, p in one.items()} for one in r.start()] for r in rules]
            goods = 0.7 * smooth
            for votes, many in sorted(patterns.items()):
                logit = math.log(prior / (1 - prior)) + sum(math.log(like[i][1][v] / like[i][0][v]) for i, v in enumerate(votes))
                p = 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))
                goods += p * many
                for i, v in enumerate(votes):
                    counts[i][1][v] += p * many
                    counts[i][0][v] += (1 - p) * many
            new = goods / (total + smooth)
            like = [[{v: c / sum(one.values()) for v, c in one.items()} for one in rule] for rule in counts]
            still, prior = abs(new - prior) < 1e-9, new
            if still:
                break
        ratios = [{v: math.log(one[1][v] / one[0][v]) for v in (-1, 0, 1)} for one in like]
        right = [(prior * one[1][1] + (1 - prior) * one[0][-1]) / (1 - prior * one[1][0] - (1 - prior) * one[0][0]) for one in like]
        return cls(prior, ratios, right)

    def posterior(self, rules=RULES) -> Column:
        logit = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, ratio in zip(rules, self.ratios, strict=True):
            logit = logit + F.when(vote(rule) == 1, ratio[1]).when(vote(rule) == -1, ratio[-1]).otherwise(ratio[0])
        return 1 / (1 + F.exp(-logit))


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0)


def fit_rules(feats: DataFrame, rules=RULES) -> LabelModel:
    """The label model of all rows of feats; the cluster counts vote patterns, of which a few hundred come to the driver."""
    names = [f"v{i}" for i in range(len(rules))]
    counted = feats.select(*[vote(r).alias(n) for r, n in zip(rules, names, strict=True)]).groupBy(*names).count().collect()
    return LabelModel.fit({tuple(r[:-1]): r[-1] for r in counted}, rules)


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior, a row a document.

    base_failed: under 50 words, or over half of them in repeated windows. kept: the base holds and the
    posterior probability of good quality is at least `least`. Features are written once to the shared
    folder (numbers only); votes are counted and judged from there. A bad vote alone does not reject: what counts is how
    reliable its rule has turned out and what the others say. A null or empty text fails the base;
    an empty table has no rows; rows are judged one by one, so repeats are judged alike and come back
    as often as they came; a tie at `least` is kept; columns other than key and text, whatever their names, are not read.
    """
    feats = Scratch(docs.sparkSession).save(features(docs, key, text), "features")
    model = fit_rules(feats, rules)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    out = feats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), model.posterior(rules).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))

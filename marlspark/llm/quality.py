"""Quality rules as weak supervision.

Each rule votes 1 (good), -1 (bad) or 0 (abstains) on a document. Expectation-maximisation over the counts of vote
patterns, at most 3^11 of them however large the corpus is, estimates the share of good documents and for each rule
how often it votes either way on good and on bad documents; the posterior probability of good then decides, instead of
a demand that all rules pass. So a rule that fires in a corpus on documents that all others find good loses its say,
and one that agrees with others on bad documents gains. Texts are read once and never shuffled; all of it is DataFrame
and SQL functions, but for the rounds of EM, which are arithmetic of the driver on the pattern counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, tidy

WORD = r"[^\\x20\\x09-\\x0D]+"
SYMBOLS, MARKS = "#*$%&|<>", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: rule -> (bad if, good if), over the columns of `features`; it abstains if neither holds.
RULES = {
    "length": ("n_words < 20", "n_words >= 80"),
    "word_length": ("word_chars > 15 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"),
    "lines": ("n_dup_lines > 0.3 * n_lines and n_dup_lines >= 3", "n_dup_lines <= 0.05 * n_lines"),
    "repeats": ("n_repeat_words > 0.3 * n_words", "n_repeat_words < 0.15 * n_words"),
    "capitals": ("n_capitals > 0.4 * word_chars", "n_capitals < 0.15 * word_chars"),
    "shouts": ("n_shouts > 0.2 * n_words", "n_shouts < 0.03 * n_words"),
    "marks": ("n_marks > 0.2 * word_chars", "n_marks < 0.08 * word_chars"),
    "tables": ("n_pipes > 0.05 * n_words", "n_pipes = 0"),
    "digits": ("n_digits > 0.3 * word_chars", "n_digits < 0.1 * word_chars"),
    "vocabulary": ("n_distinct < 0.1 * n_words and n_words < 2000", "n_distinct > 0.25 * n_words"),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Where EM starts: the share of good documents, and P(vote -1 | the rule votes) on good and on bad documents. Bad documents
#: pass most rules, each kind of them failing its own; good ones hardly ever fail any.
GOOD, START = 0.8, (0.005, 0.2)
#: So many documents, and votes of each rule on either class, like GOOD and START are added to what is counted: they hold
#: the classes to their meaning in a small table and don't matter in a large one.
PRIOR = 50
ROUNDS, TOLERANCE = 200, 1e-6


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts that the rules read. A null text has no words, lines or characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_t", text).withColumn("_w", F.expr(f"regexp_extract_all(_t, '{WORD}', 0)")).withColumn("_l", F.expr(f"filter(split(_t, '\\n', -1), x -> x rlike '{WORD}')"))
    out = out.withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", F.expr("if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"))
    lost = lambda chars, by="": F.length("_t") - F.length(F.translate(F.col("_t"), chars, by))
    out = out.select(
        *docs.columns, "n_words", "_h",
        F.length(F.expr(r"regexp_replace(_t, '[\\x20\\x09-\\x0D]+', '')")).cast("long").alias("word_chars"),
        lost(SYMBOLS).cast("long").alias("n_symbols"), lost("!").cast("long").alias("n_shouts"), lost("|").cast("long").alias("n_pipes"), lost(MARKS).cast("long").alias("n_marks"), lost("0123456789").cast("long").alias("n_digits"),
        F.expr(r"regexp_count(_t, '\\p{Lu}')").cast("long").alias("n_capitals"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )
    # windows sorted by hash, then place: equal ones are neighbours; _r: the places of those found twice or more
    out = out.withColumn("_s", F.expr("if(size(array_distinct(_h)) = size(_h), null, sort_array(arrays_zip(_h, sequence(0, size(_h) - 1))))"))
    out = out.withColumn("_p", F.expr("filter(zip_with(_s, slice(_s, 2, size(_s)), (a, b) -> if(a.`_h` = b.`_h`, array(a.`1`, b.`1`), null)), x -> x is not null)"))
    out = out.withColumn("_r", F.expr("sort_array(array_distinct(flatten(_p)))"))
    covered = F.expr("coalesce(aggregate(zip_with(_r, slice(_r, 2, size(_r)), (a, b) -> least(3, b - a)), 0, (n, x) -> n + x), 0)")
    counts = [c for c in out.columns if c not in (*docs.columns, "_h", "_s", "_p", "_r")]
    # a generator, so that no filter on a count moves below it: there it would be worked out again for each mention
    held = F.explode(F.array(F.struct(*counts, covered.cast("long").alias("n_repeat_words")))).alias("_counts")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], held).select(*[F.col(f"`{c}`") for c in docs.columns], "_counts.*")


def votes() -> list[Column]:
    return [F.expr(f"cast(case when {bad} then -1 when {good} then 1 else 0 end as tinyint)").alias(f"v_{name}") for name, (bad, good) in RULES.items()]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _terms(model: dict) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of good before any vote, and per rule what votes of 1 and -1 add to them."""
    rules = [(math.log((1 - on_good) / (1 - on_bad)), math.log(on_good / on_bad)) for on_good, on_bad in model["rules"].values()]
    return math.log(model["good"] / (1 - model["good"])), rules


def posterior(model: dict) -> Column:
    """P(good | votes) under the model."""
    odds, rules = _terms(model)
    score = F.lit(odds)
    for name, (up, down) in zip(model["rules"], rules, strict=True):
        v = F.col(f"v_{name}")
        score = score + F.when(v == 1, up).when(v == -1, down).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def start() -> dict:
    return {"good": GOOD, "rules": dict.fromkeys(RULES, START)}


def fit(patterns: list[tuple[tuple[int, ...], int]], prior: float = PRIOR, rounds: int = ROUNDS) -> dict:
    """EM over vote patterns, in the order of RULES, with their counts: {"good": share, "rules": {name: (P(-1 | good),
    P(-1 | bad))}}, both among the votes that aren't abstentions. A rule that would vote -1 more often on good documents
    than on bad ones gets one rate for both, and so no say."""
    model = start()
    for _ in range(rounds):
        odds, rules = _terms(model)
        n_good = n_all = 0.0
        seen = [[0.0] * 4 for _ in RULES]  # votes of -1 and of any kind on good documents, on bad ones
        for votes_, n in patterns:
            score = odds + sum(up if v == 1 else down for v, (up, down) in zip(votes_, rules, strict=True) if v)
            good = n / (1 + math.exp(-max(-500.0, min(500.0, score))))
            n_good += good
            n_all += n
            for own, v in zip(seen, votes_, strict=True):
                if v:
                    own[1] += good
                    own[3] += n - good
                    if v == -1:
                        own[0] += good
                        own[2] += n - good
        new = {"good": (n_good + prior * GOOD) / (n_all + prior), "rules": {}}
        for name, (bad_g, all_g, bad_b, all_b) in zip(RULES, seen, strict=True):
            a, b = (bad_g + prior * START[0]) / (all_g + prior), (bad_b + prior * START[1]) / (all_b + prior)
            if a > b:
                a = b = (bad_g + bad_b + prior * sum(START)) / (all_g + all_b + 2 * prior)
            new["rules"][name] = (a, b)
        moved = max(abs(x - y) for name in RULES for x, y in zip(model["rules"][name], new["rules"][name], strict=True))
        model, moved = new, max(moved, abs(model["good"] - new["good"]))
        if moved < TOLERANCE:
            break
    return model


def patterns_of(feature_rows: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """The vote patterns of the documents that the base rules leave to be decided, with their counts; at most 3^11."""
    names = [f"v_{name}" for name in RULES]
    counted = feature_rows.filter(~base_failed()).select(*votes()).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return sorted((tuple(r[:-1]), r["n"]) for r in counted.collect())


def fit_on(feature_rows: DataFrame) -> dict:
    return fit(patterns_of(feature_rows))


def judged(feature_rows: DataFrame, model: dict) -> DataFrame:
    """Adds v_*, base_failed, quality (posterior) and kept."""
    rows = feature_rows.select("*", *votes()).withColumn("base_failed", base_failed()).withColumn("quality", posterior(model))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


@tidy
def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns only; reads the texts once and shuffles none.

    Works on any table with a text column: nulls and empty texts have no words and go, repeated rows are judged
    alike, an empty table stays empty, and further columns are carried along whatever their names. The documents are
    written once with their counts, so that the rules' counts aren't worked out again for the verdicts.
    """
    names = [f"_c{k}" for k in range(len(docs.columns))]
    rows = staged(features(docs.toDF(*names), names[docs.columns.index(text_col)]), "quality-rows")
    return judged(rows, fit_on(rows)).filter("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


@tidy
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-features")
    return judged(rows, fit_on(rows)).select("doc_id", *BASE, "base_failed", "kept", "quality")

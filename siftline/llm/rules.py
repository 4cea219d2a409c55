"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a rate that a text may not exceed. Its cutoff is chosen for each stratum (the language) on labelled rows:
from lenient to strict, a cutoff is certified while an exact binomial test rejects "it turns away more than `alpha` of
the good documents", i.e. while P(Binomial(n, alpha) <= rejected) <= level, for n good documents. Testing in that fixed
order and stopping at the first failure needs no correction over cutoffs; Bonferroni over strata and rules gives
level = delta / (strata * rules). So with probability 1 - delta every rule in every stratum turns away at most `alpha`
of good documents. Of the certified cutoffs the one with the most bad documents against good ones is taken; a rule
without a certified cutoff that pays turns nothing away in that stratum, and neither do strata without labels.

Defined results: null and empty texts have no words and fail the base rule; a null language is a stratum of its own; a
document with several labels counts as good if its smallest label is 1, null labels count for nothing; repeated rows
are judged (and counted) each; rates that tie with a cutoff pass; very long texts are measured whole; other columns pass
through whatever their names; an empty table gives no rows, and without labels only the base rule decides.
"""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftline.llm.common import SPACES, materialise, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Largest share of good documents that one rule may turn away in a stratum.
ALPHA = 0.02
#: Probability that any rule in any stratum breaks that.
DELTA = 0.05
#: A good document turned away weighs as this many times its share against bad ones caught.
COST = 10.0
#: Cutoffs that are tried, lenient to strict. They don't depend on the data, as the test requires.
GRID = {
    "symbol_rate": [3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05],
    "exclaim_rate": [2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15],
    "upper_rate": [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "repeat_rate": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "dup_line_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "word_length": [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0],
}


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once, though lambdas inside use it for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more: windows sorted by hash, equal neighbours kept."""

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            F.sort_array(starts),
            zero,
            lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end")),
            lambda acc: acc["n"],
        )

    def repeated(s: Column) -> Column:
        def start(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
            same = F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))
            return F.when(same, x["i"])

        return F.array_compact(F.transform(s, start))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(F.sort_array(windows), lambda s: covered(repeated(s))))


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns of `docs`, and a struct `_m` with the counts of each text. Row by row, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, text.alias("_text"), words(F.col("text")).alias("_w"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

    def count_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    counted = base.select(
        *keep,
        F.size("_w").cast("long").alias("_n"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("_chars"),
        _without(F.col("_text"), SYMBOLS).cast("long").alias("_symbols"),
        _without(F.col("_text"), UPPER).cast("long").alias("_upper"),
        _without(F.col("_text"), "!").cast("long").alias("_exclaim"),
        _let(lines, count_lines).alias("_lines"),
        _repeat_words(F.col("_w")).cast("long").alias("_repeat"),
    )
    return counted.select(
        *keep,
        F.struct(
            F.col("_n").alias("n_words"),
            F.col("_chars").alias("word_chars"),
            F.col("_symbols").alias("n_symbols"),
            F.col("_lines.dup").cast("long").alias("n_dup_lines"),
            F.col("_repeat").alias("n_repeat_words"),
            F.col("_lines.all").cast("long").alias("n_lines"),
            F.col("_upper").alias("n_upper"),
            F.col("_exclaim").alias("n_exclaim"),
        ).alias("_m"),
    )


def base_failed() -> Column:
    m = F.col("_m")
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def rates() -> dict[str, Column]:
    m = F.col("_m")
    n = F.greatest(m["n_words"], F.lit(1))
    return {
        "symbol_rate": m["n_symbols"] / n,
        "exclaim_rate": m["n_exclaim"] / n,
        "upper_rate": m["n_upper"] / F.greatest(m["word_chars"], F.lit(1)),
        "repeat_rate": m["n_repeat_words"] / n,
        "dup_line_rate": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
        "word_length": m["word_chars"] / n,
    }


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed exactly term by term in logarithms."""
    first = n * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)
    zero = F.struct(first.alias("term"), F.exp(first).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + odds
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, zero, step, lambda acc: acc["sum"])


def learn(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grid=None) -> DataFrame:
    """(stratum, cut_<rule>...) from measured rows with doc_id, stratum and `_m`; infinity where a rule is off.

    `measured` should be a written table, as its counts are used many times over.

    Two aggregations with partial sums: (stratum, rule, cutoff) counts, then a row for each stratum.
    """
    grid = grid or GRID
    label = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    label = label.agg(F.min("quality").alias("_quality"))
    held = measured.filter(~base_failed()).join(label, F.col("doc_id") == F.col("_id"))
    rate = rates()
    tries = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"), F.lit(k).alias("k"), F.lit(c).alias("cut"), (rate[rule] > c).alias("hit")
            )
            for rule, cuts in grid.items()
            for k, c in enumerate(cuts)
        ]
    )
    good = F.col("_quality") == 1
    counts = (
        held.select("stratum", good.alias("good"), F.inline(tries))
        .groupBy("stratum", "rule", "k", "cut")
        .agg(
            F.count_if("good").alias("n_good"),
            F.count_if(~F.col("good")).alias("n_bad"),
            F.count_if(F.col("good") & F.col("hit")).alias("good_hit"),
            F.count_if(~F.col("good") & F.col("hit")).alias("bad_hit"),
        )
    )
    counts = materialise(counts)  # a few rows for each stratum
    strata = counts.agg(F.count_distinct(F.struct("stratum"))).first()[0]
    level = delta / max(1, strata * len(grid))
    may = F.col("good_hit") <= alpha * F.col("n_good")
    passed = may & (binomial_cdf(F.col("n_good"), F.when(may, F.col("good_hit")).otherwise(F.lit(0)), alpha) <= level)
    in_order = W.partitionBy("stratum", "rule").orderBy("k")
    gain = F.col("bad_hit") / F.greatest("n_bad", F.lit(1)) - COST * F.col("good_hit") / F.greatest("n_good", F.lit(1))
    tested = counts.withColumn("certified", F.min(passed).over(in_order)).withColumn("gain", gain)
    off = F.lit(float("inf"))
    best = F.max(F.when(F.col("certified") & (F.col("gain") > 0), F.struct("gain", -F.col("k"), "cut")))["cut"]
    cuts = tested.groupBy("stratum", "rule").agg(best.alias("cut"))
    wide = [F.coalesce(F.max(F.when(F.col("rule") == r, F.col("cut"))), off).alias(f"cut_{r}") for r in grid]
    return cuts.groupBy("stratum").agg(*wide)


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add `_kept` to measured rows with a stratum. One row of `cuts` for each stratum; Spark broadcasts it if small."""
    right = cuts.withColumnRenamed("stratum", "_stratum")
    judged = measured.join(right, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    off = F.lit(float("inf"))
    rules = [rate <= F.coalesce(F.col(f"cut_{rule}"), off) for rule, rate in rates().items()]
    # One expression, as parts of a conjunction would be pushed below the join and measure the text again there.
    kept = F.forall(F.array(~base_failed(), *rules), lambda x: x)
    return judged.withColumn("_kept", kept).drop(*right.columns)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, kept) of each row. Texts are measured once; only counts are written."""
    measured = measure(docs.withColumn("_lang", F.col("lang")), "doc_id", "_lang").withColumnRenamed("_lang", "stratum")
    measured = materialise(measured)
    judged = judge(measured, materialise(learn(measured, labels)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(f"_m.{n}").alias(n) for n in names],
        base_failed().alias("base_failed"),
        F.col("_kept").alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns as they are; texts don't move between executors.

    Rows are written with their counts, as measuring a text again costs far more than reading it again."""
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "text", F.col("lang").alias("_lang"))
    rows = measure(whole, "_row", "doc_id", "_lang").withColumnRenamed("_lang", "stratum")
    rows = materialise(rows)
    cuts = materialise(learn(rows.select("doc_id", "stratum", "_m"), labels))
    return judge(rows.drop("doc_id"), cuts).filter("_kept").select("_row.*")


def oracle() -> str:
    """DuckDB SQL for `verdicts`, written apart from the code above."""
    tests = " UNION ALL ".join(
        f"SELECT lang, good, '{r}' AS rule, {k} AS k, {c!r} AS cut, {r} > {c!r} AS hit FROM held"
        for r, cuts in GRID.items()
        for k, c in enumerate(cuts)
    )
    space = r"[ \t\n\x0b\f\r]"
    checks = " AND ".join(
        f"{r} <= coalesce((SELECT cut FROM cuts c WHERE c.rule = '{r}' AND c.lang IS NOT DISTINCT FROM m.lang), 'inf'::DOUBLE)"
        for r in GRID
    )
    return f"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS lines
  FROM documents
), pos AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
), tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM pos
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE n > 1) GROUP BY 1
), m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{space}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(replace(text, '!', '')) AS n_exclaim
  FROM w LEFT JOIN rep USING (doc_id)
), r AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    n_symbols / greatest(n_words, 1) AS symbol_rate, n_exclaim / greatest(n_words, 1) AS exclaim_rate,
    n_upper / greatest(word_chars, 1) AS upper_rate, n_repeat_words / greatest(n_words, 1) AS repeat_rate,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_rate, word_chars / greatest(n_words, 1) AS word_length
  FROM m
), held AS (
  SELECT r.*, q.quality = 1 AS good FROM r
  JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1) q USING (doc_id)
  WHERE NOT base_failed
), c AS (
  SELECT lang, rule, k, cut, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad,
    count(*) FILTER (good AND hit) AS good_hit, count(*) FILTER (NOT good AND hit) AS bad_hit
  FROM ({tests}) GROUP BY ALL
), lvl AS (
  SELECT {DELTA} / greatest(1, count(DISTINCT coalesce(lang, '<null>')) * {len(GRID)}) AS level FROM c
), p AS (
  SELECT c.*, coalesce((SELECT sum(exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({ALPHA})
      + (n_good - j) * ln(1 - {ALPHA}))) FROM generate_series(0, good_hit) g(j) WHERE j <= n_good), 0) AS cdf
  FROM c
), t AS (
  SELECT p.*, bool_and(good_hit <= {ALPHA} * n_good AND cdf <= level) OVER (PARTITION BY lang, rule ORDER BY k) AS certified,
    bad_hit / greatest(n_bad, 1) - {COST} * good_hit / greatest(n_good, 1) AS gain
  FROM p, lvl
), cuts AS (
  SELECT DISTINCT ON (lang, rule) lang, rule, cut FROM t WHERE certified AND gain > 0 ORDER BY lang, rule, gain DESC, k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {checks} AS kept
FROM r m"""

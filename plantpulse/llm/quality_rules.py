"""Quality rules as a short-circuit cascade, in SQL expressions only.

Every rule is a boolean expression that is true when a document fails it.
Before the run each rule's cost and selectivity (share of rows it rejects) are
estimated on a bounded sample, and rules are ordered by rejection per cost, so that later,
dearer rules see fewer documents.  The cost of a row is that of the rule's steps: those on counts cost alike,
those that read the text cost its characters (their mean in the sample) by kind of step.  Clock times of such
cheap rules are mostly noise; this estimate is the same on every run, and so is the order.  It
changes the work, never the verdict: a document is kept when no rule fails.

Defined results: null, empty and blank texts have no words, zero counts and
fail the base rule.  Repeated rows are judged alike, each for itself.  An empty
table gives an empty result.  Extra columns of the input are kept; the input's
own columns win no name: result columns replace equal names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import let, table, words

#: Rows of the sample that costs and selectivities are estimated on (expected number).
SAMPLE_ROWS = 2_000
#: Cost of a rule on counts alone, and per character of a step that reads the text: a plain search, a pattern.
ON_COUNTS, SEARCH, PATTERN = 1.0, 0.01, 0.05
SYMBOLS = "[#*$%&|<>]"
GRAM = 5
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: What ``quality_rules`` adds.
RULE_COLUMNS = (*BASE_COLUMNS, "failed_rule", "kept")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column
    #: cost per character of the text, 0 for a rule on counts
    per_char: float = 0.0


def n_repeat_words(w: Column) -> Column:
    """Word positions covered by a 5-word window that occurs twice or more.

    Windows are compared by their 64-bit hash.  Equal hashes lie side by side
    after sorting, so the cost is n log n however often a window repeats, and
    texts without repetition stop at the distinct count.
    """
    last = F.size(w) - GRAM

    def covered(g: Column) -> Column:
        def positions(s: Column) -> Column:
            h = lambda i: s[i]["h"]
            size = F.size(s)
            return F.sort_array(F.transform(
                F.filter(F.sequence(F.lit(0), size - 1), lambda i:
                         ((i > 0) & (h(F.greatest(i - 1, F.lit(0))) == h(i)))
                         | ((i < size - 1) & (h(F.least(i + 1, size - 1)) == h(i)))),
                lambda i: s[i]["i"]))

        def spread(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(GRAM), p[F.least(i + 1, F.size(p) - 1)] - x))
                            .otherwise(F.lit(GRAM))),
                F.lit(0).cast("bigint"), lambda a, x: a + x)

        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")) \
            .otherwise(let(let(pairs, positions), spread))

    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[w[i + k] for k in range(GRAM)]))
    return F.when(last < 1, F.lit(0).cast("bigint")).otherwise(let(grams, covered))


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts that every document gets, whatever the verdict.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = docs.drop(*[c for c in RULE_COLUMNS if c in docs.columns])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        n_repeat_words(w).alias("n_repeat_words")))
    out = kept.withColumn("__c", counts) \
        .withColumn("n_symbols", F.when(t == "", F.lit(0)).otherwise(F.regexp_count(t, F.lit(SYMBOLS))).cast("bigint")) \
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    out = out.select(*[c for c in kept.columns], "__c.n_words", "__c.word_chars", "n_symbols", "n_dup_lines",
                     "__c.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 10)
                          | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules over the base counts and the text; none fails ordinary prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [
        # more than one special symbol to four words: markup or tables
        Rule("symbols", 4 * F.col("n_symbols") > F.col("n_words")),
        # mean word length outside 2 to 20 characters
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        # more than three lines in ten repeat an earlier line (six repeated lines at least)
        Rule("dup_lines", (F.col("n_dup_lines") >= 6)
             & (10 * F.col("n_dup_lines") > 3 * F.regexp_count(t, F.lit("\n"))), PATTERN),
        # shouting: more than half of the characters are upper-case letters A-Z
        Rule("upper_case", 2 * (F.char_length(t) - F.char_length(F.regexp_replace(t, "[A-Z]+", ""))) > F.col("word_chars"), PATTERN),
        # more than one exclamation mark to three words
        Rule("exclamations", 3 * (F.char_length(t) - F.char_length(F.replace(t, F.lit("!"), F.lit("")))) > F.col("n_words"), SEARCH),
    ]


def estimated_order(sample: DataFrame, rules: list[Rule], text: str = "text") -> list[tuple[Rule, float, float]]:
    """Rules with cost per row and rejected share on ``sample``, best first.

    Rules that reject nothing go last, cheapest first; ties go by name.
    """
    hits = [F.avg(F.when(r.fails, 1.0).otherwise(0.0)).alias(f"r{i}") for i, r in enumerate(rules)]
    row = sample.agg(F.avg(F.char_length(F.coalesce(F.col(text), F.lit("")))).alias("chars"), *hits).first()
    found = [(r, ON_COUNTS + r.per_char * (row["chars"] or 0.0), row[f"r{i}"] or 0.0) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def apply_cascade(judged: DataFrame, ordered: list[Rule]) -> DataFrame:
    """Adds ``failed_rule`` (first failing rule in the cascade's order, null if
    none) and ``kept``.  A CASE stops at the first branch that is true, so a
    rule is evaluated only for rows that all earlier rules let through."""
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for r in ordered:
        verdict = verdict.when(r.fails, F.lit(r.name))
    return judged.withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull())


def quality_rules(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None,
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The input plus base counts, ``failed_rule`` and ``kept``."""
    rules = default_rules(text) if rules is None else rules
    n = docs.count()
    share = min(1.0, sample_rows / n) if n else 1.0
    ordered = [r for r, _, _ in estimated_order(base_columns(docs.select(text).sample(False, share, 11), text), rules, text)]
    return apply_cascade(base_columns(docs, text), ordered)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                      "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2
), r AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id
), b AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 4 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_dup_lines >= 6 AND 10 * n_dup_lines > 3 * (length(text) - length(replace(text, chr(10), ''))))
            OR 2 * (length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g'))) > word_chars
            OR 3 * (length(text) - length(replace(text, '!', ''))) > n_words) AS kept
FROM f
"""

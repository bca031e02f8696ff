"""Quality rules as a bitmask ledger: every rule is evaluated once, failures are bits, policies are masks.

All of it is DataFrame functions; one pass over the text, no shuffle.

* ``rule_ledger``: measurements and ``failed_bits`` of each document;
* ``apply_policy``: a versioned policy is a set of rules, i.e. a mask; a document is kept if ``failed_bits & mask = 0``;
* ``ablations``: per rule, documents failing it, failing it alone, and kept if the rule went, from one aggregation over
  the distinct bit patterns.

Defined cases: a null text counts as empty; empty and blank texts have no words (all measures 0) and fail
``few_words``; repeated rows are judged each for itself; an empty table gives an empty ledger; further columns of the
input are ignored by the ledger and kept by ``keep_by_policy``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, col, read, words_of

SYMBOLS = "#*$%&|<>"
#: Rules by bit; a rule's bit never changes, so ledgers stay readable when rules are added.
RULES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "capitals", "letters")
#: Versioned policies: rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length"),
    "v2": RULES,
}
CURRENT = "v2"
#: Limits, all in integers so that every engine agrees: symbols per 100 words, duplicate lines per 100 lines with a
#: word, characters per 10 words (least, most), upper-case A-Z per 100 letters, letters per 100 word characters (least).
SYMBOLS_PER_100, DUP_LINES_PER_100, CHARS_PER_10, CAPITALS_PER_100, LETTERS_PER_100 = 20, 50, (15, 150), 50, 40


def mask(rules: Sequence[str]) -> int:
    return sum(1 << RULES.index(r) for r in set(rules))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that occurs at least twice in the text."""
    windows = F.when(F.size(words) >= 3, F.transform(F.slice(words, 1, F.size(words) - 2), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(s: Column) -> Column:
        """``s``: (hash, position) of every window, sorted; a repeated one has a neighbour of its hash."""
        same = lambda i, x: F.coalesce(F.get(s, i).getField("h") == x["h"], F.lit(False))
        at = F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(same(i - 1, x) | same(i + 1, x), x["p"]).otherwise(F.lit(-1))), lambda p: p >= 0))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
        return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")), lambda a: a["n"])

    # sorted only where some window repeats
    return _bind(windows, lambda g: F.when(F.size(g) == F.size(F.array_distinct(g)), F.lit(0).cast("long")).otherwise(_bind(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered)))


def _measured(text: Column) -> Column:
    """Struct of the measurements of a text; the text is split into words once and into lines once."""
    count = lambda x: x.cast("long")
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    of_lines = lambda lines: F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))
    of_words = lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("repeat"))
    lines = _bind(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""), of_lines)
    both = F.struct(_bind(words_of(text), of_words).alias("w"), lines.alias("l"))
    return _bind(
        both,
        lambda b: F.struct(
            count(b["w"]["n"]).alias("n_words"),
            count(b["w"]["chars"]).alias("word_chars"),
            count(F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))).alias("n_symbols"),
            count(b["l"]["dup"]).alias("n_dup_lines"),
            b["w"]["repeat"].alias("n_repeat_words"),
            count(b["l"]["n"]).alias("n_lines"),
            count(F.regexp_count(text, F.lit("[A-Z]"))).alias("n_capitals"),
            count(letters).alias("n_letters"),
        ),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters")


def _failed_bits(m: Column) -> Column:
    fails = {
        "few_words": m["n_words"] < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 100 * m["n_symbols"] > SYMBOLS_PER_100 * m["n_words"],
        "duplicate_lines": 100 * m["n_dup_lines"] > DUP_LINES_PER_100 * m["n_lines"],
        "word_length": (10 * m["word_chars"] < CHARS_PER_10[0] * m["n_words"]) | (10 * m["word_chars"] > CHARS_PER_10[1] * m["n_words"]),
        "capitals": 100 * m["n_capitals"] > CAPITALS_PER_100 * m["n_letters"],
        "letters": 100 * m["n_letters"] < LETTERS_PER_100 * m["word_chars"],
    }
    bits = F.lit(0)
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(fails[rule], F.lit(1 << i)).otherwise(F.lit(0)))
    return bits


def ledger_of(text: Column) -> Column:
    """Struct of a text's measurements and ``failed_bits`` (bit i: rule RULES[i] fails).

    One expression in which every costly part is bound once, so a filter on it, which the optimiser copies below other
    columns, doesn't multiply the work.
    """
    full = _bind(F.coalesce(text, F.lit("")), _measured)
    return _bind(full, lambda m: F.struct(*(m[c].alias(c) for c in MEASURES), _failed_bits(m).alias("failed_bits")))


def measures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the measurements of each document."""
    return rule_ledger(docs, text, doc_id).drop("failed_bits")


def rule_ledger(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, measurements and ``failed_bits``."""
    return docs.select(col(doc_id).alias("doc_id"), ledger_of(col(text)).alias("ledger")).select("doc_id", "ledger.*")


def apply_policy(ledger: DataFrame, policy: str = CURRENT, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy; no rule is evaluated again."""
    base, chosen = mask(policies["base"]), mask(policies[policy])
    bits = F.col("failed_bits")
    return ledger.withColumn("base_failed", bits.bitwiseAND(F.lit(base)) != 0).withColumn("kept", bits.bitwiseAND(F.lit(base | chosen)) == 0)


def ablations(ledger: DataFrame, policy: str = CURRENT, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """Per rule of the policy: ``failed``, ``failed_alone`` (the documents that dropping the rule would keep), ``kept_without``.

    One aggregation to the distinct bit patterns (at most 2**rules rows), the rest is on those.
    """
    m = mask(policies[policy])
    seen = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).alias("bit")) for r in policies[policy])))
    x = seen.select("bits", "n", rules.alias("r"))
    bit = F.col("r.bit")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        count(F.col("bits").bitwiseAND(bit) != 0).alias("failed"),
        count(F.col("bits") == bit).alias("failed_alone"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without"),
    )


def keep_by_policy(docs: DataFrame, policy: str = CURRENT, text: str = "text", policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """The documents a policy keeps, with all their columns, in the same pass."""
    rejecting = mask(policies["base"]) | mask(policies[policy])
    return docs.filter(ledger_of(col(text).cast("string"))["failed_bits"].bitwiseAND(F.lit(rejecting)) == 0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = apply_policy(rule_ledger(read(spark, sf_dir, "documents")))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits", "base_failed", "kept")


MEASURES_SQL = r"""
w0 as (select row_number() over () as rid, *, coalesce(text, '') as t from @table),
w1 as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w0),
tri as (select rid, i, [w[i], w[i + 1], w[i + 2]] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from w1 where len(w) >= 3)),
dup as (select rid, g from tri group by rid, g having count(*) > 1),
cov as (select rid, count(distinct i + o) as n from tri join dup using (rid, g), (select unnest([0, 1, 2]) as o) group by rid),
m as (select w1.*, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
        len(lines) as n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals,
        length(regexp_replace(t, '[^\p{L}]+', '', 'g')) as n_letters
      from w1 left join cov using (rid)),
ledger as (select *, ((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (100 * n_symbols > 20 * n_words)::int
        + 8 * (100 * n_dup_lines > 50 * n_lines)::int + 16 * (10 * word_chars < 15 * n_words or 10 * word_chars > 150 * n_words)::int
        + 32 * (100 * n_capitals > 50 * n_letters)::int + 64 * (100 * n_letters < 40 * word_chars)::int)::int as failed_bits from m)
"""
ORACLE = "with " + MEASURES_SQL.replace("@table", "documents") + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits, failed_bits & 3 <> 0 as base_failed, failed_bits = 0 as kept from ledger"""

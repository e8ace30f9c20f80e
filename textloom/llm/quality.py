"""Quality rules as a learned decision list: sequential covering over labelled statistics, native to Spark SQL.

Statistics of a text are Spark expressions. Rules are conjunctions of thresholds on them, each grown by information
gain on one part of the labelled documents and pruned on the other; what a rule covers is taken away before the next
is grown. All counts are Spark aggregations; the driver sees counts only. The list becomes one CASE expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

_WS = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body(value) with the value evaluated once: a lambda variable is a place in memory, an expression is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(windows: Column, k: int) -> Column:
    """Words inside windows (hashes by place) that occur twice or more."""

    def count(order: Column) -> Column:
        key = lambda i: F.get(order, i)["h"]
        spots = F.filter(F.transform(order, lambda x, i: F.when((x["h"] == key(i - 1)) | (x["h"] == key(i + 1)), x["i"])), lambda x: x.isNotNull())
        fresh = lambda p: F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(k)), F.lit(k)))
        return _let(F.array_sort(spots), lambda p: F.aggregate(fresh(p), F.lit(0), lambda a, x: a + x))

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(ordered, count)).otherwise(0)


def _word_stats(words: Column, k: int) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))
    repeats = _let(hashes, lambda h: _let(windows(h), lambda w: _repeat_words(w, k)))
    return F.struct(F.size(words).cast("long").alias("n_words"), repeats.cast("long").alias("n_repeat_words"))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, n_lines, n_upper, n_digits, n_bangs), all long."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split("_t", _WS), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    gone = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    src = docs.select(F.col(id_col).alias("_id"), t.alias("_t"))
    out = src.select(
        "_id",
        _let(words, lambda w: _word_stats(w, k)).alias("_w"),
        (F.length("_t") - gone(_BLANKS)).cast("long").alias("word_chars"),
        gone(_SYMBOLS).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("_l"),
        F.length("_t").cast("long").alias("n_chars"),
        F.regexp_count("_t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("_t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        gone("!").cast("long").alias("n_bangs"),
    )
    return out.select(F.col("_id").alias(id_col), "_w.n_words", "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"), "_w.n_repeat_words", "n_chars", F.col("_l.all").alias("n_lines"), "n_upper", "n_digits", "n_bangs")


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")


#: What rules look at: expressions over text_statistics.
FEATURES = {
    "symbols_per_char": lambda: _ratio("n_symbols", "word_chars"),
    "dup_lines_per_line": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeats_per_word": lambda: _ratio("n_repeat_words", "n_words"),
    "chars_per_word": lambda: _ratio("word_chars", "n_words"),
    "upper_per_char": lambda: _ratio("n_upper", "word_chars"),
    "digits_per_char": lambda: _ratio("n_digits", "word_chars"),
    "bangs_per_word": lambda: _ratio("n_bangs", "n_words"),
    "words_per_line": lambda: _ratio("n_words", "n_lines"),
    "words": lambda: F.col("n_words").cast("double"),
}

Rule = list[tuple[str, str, float]]


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for name, op, at in rule:
        out = out & ((FEATURES[name]() >= F.lit(at)) if op == ">=" else (FEATURES[name]() < F.lit(at)))
    return out


def list_column(rules: list[tuple[Rule, int]], default: int = 1) -> Column:
    """The decision list's label: that of the first rule that holds, or the default."""
    if not rules:
        return F.lit(default)
    out = F.when(rule_column(rules[0][0]), rules[0][1])
    for rule, label in rules[1:]:
        out = out.when(rule_column(rule), label)
    return out.otherwise(default)


def _bin(cuts: list[float], value: Column) -> Column:
    """How many of the thresholds the value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= value)) if cuts else F.lit(0)


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 8000, steps: int = 24, max_rules: int = 8, max_conditions: int = 3, max_failed: int = 4, precision: float = 0.9, least: int = 3, share: float = 0.004) -> list[tuple[Rule, int]]:
    """Rules for label 0, from the at most max_labels labelled documents whose crc32(id) comes first.

    A third of them (by another hash) prunes, the others grow. A rule grows by the condition of the most information
    gain until it covers no document of label 1, then loses the last conditions that do not help on the other part. It
    is kept if, on either part, at least `precision` of what it covers has label 0, and if it covers `least` documents
    of label 0 for growing, or a `share` of all of them where that is more, and one for pruning. Thresholds are
    quantiles of all values and of those of label 0, and half of the least value above 0. After max_failed rules that
    do not hold on the other part, each begun by another condition, the list is complete. Null texts have no words.
    Labels that are null, neither 0 nor 1, of a null id or held out (crc32 mod 4 = 2) are not used; of an id with both
    labels the larger one is. Without labels of both kinds, or on an empty table, there are no rules.
    """
    id_ = F.col("_id").cast("string").cast("binary")
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("_id").isNotNull() & (F.crc32(id_) % 4 != 2))
    chosen = known.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.crc32(id_), "_id").limit(max_labels)
    stats = text_statistics(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("_id")), "_id", "left_semi"), "_id", "text")
    part = (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("prune")
    table = materialize(stats.join(F.broadcast(chosen), "_id").select("*", part), "labelled")
    names = list(FEATURES)
    cuts = [i / steps for i in range(1, steps)]
    bad_only = lambda n: F.when(F.col("y") == 0, FEATURES[n]())
    quantiles = [F.percentile_approx(v, cuts, 1000).alias(f"{n}_{k}") for n in names for k, v in (("all", FEATURES[n]()), ("bad", bad_only(n)))]
    above = [(F.min(F.when(FEATURES[n]() > 0, FEATURES[n]())) / 2).alias(f"{n}_low") for n in names]
    got = table.agg(*quantiles, *above, F.count_if(~F.col("prune")).alias("grow")).first()
    at = {n: sorted({*(got[f"{n}_all"] or []), *(got[f"{n}_bad"] or []), *([got[f"{n}_low"]] if got[f"{n}_low"] else [])}) for n in names}
    least = max(least, math.ceil(share * got["grow"]))
    bad, good = F.col("y") == 0, F.col("y") == 1
    sum_ = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    rules: list[tuple[Rule, int]] = []
    left = F.lit(True)
    banned: set[tuple[str, str]] = set()  # conditions that began a rule which did not hold on the other part
    while len(rules) < max_rules and len(banned) < max_failed:
        rule: Rule = []
        for _ in range(max_conditions):
            # One pass: how many of either label lie between neighbouring thresholds of each feature.
            bins = F.array(*(F.struct(F.lit(i).alias("f"), _bin(at[n], FEATURES[n]()).alias("b")) for i, n in enumerate(names)))
            counts = table.where(left & rule_column(rule) & ~F.col("prune")).select("y", F.explode(bins).alias("x")).groupBy("x.f", "x.b").agg(sum_(bad).alias("bad"), sum_(good).alias("good")).collect()
            total = [sum(r[k] for r in counts if r["f"] == 0) for k in ("bad", "good")]
            if not total[0] or not total[1]:
                break
            base = math.log2(total[0] / sum(total))
            best: tuple = (0.0, None)
            for i, n in enumerate(names):
                for j, cut in enumerate(at[n]):
                    hi = [sum(r[k] for r in counts if r["f"] == i and r["b"] > j) for k in ("bad", "good")]
                    for op, (p, q) in ((">=", hi), ("<", [a - b for a, b in zip(total, hi, strict=True)])):
                        if not rule and (n, op) in banned:
                            continue
                        if p >= least and (gain := p * (math.log2((p + 0.5) / (p + q + 1)) - base)) > best[0] + 1e-9:
                            best = (gain, (n, op, float(cut)))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        prefixes = [rule[: i + 1] for i in range(len(rule))]
        sums = table.where(left).agg(*(sum_(rule_column(p) & which & (F.col("prune") == prune)) for p in prefixes for which in (bad, good) for prune in (True, False))).first()
        scored = []
        for i, p in enumerate(prefixes):
            bp, bg, gp, gg = sums[4 * i : 4 * i + 4]
            if bg >= least and bg >= precision * (bg + gg) and bp >= precision * (bp + gp) and bp:
                scored.append(((bp - gp) / (bp + gp), bp, -len(p), p))
        if not scored:
            banned.add(rule[0][:2])
            continue
        chosen_rule = max(scored, key=lambda x: x[:3])[3]
        tight = {}  # of conditions on one side of one feature the last is the tightest
        for name, op, cut in chosen_rule:
            tight[name, op] = cut
        rules.append(([(name, op, cut) for (name, op), cut in tight.items()], 0))
        left = left & ~rule_column(rules[-1][0])
    discard(table)
    return rules


def apply_rules(docs: DataFrame, rules: list[tuple[Rule, int]], id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """text_statistics with base_failed, rule_label (int) and kept, a row for each row of docs.

    base_failed: fewer than min_words words, or more than max_repeat percent of the words in repeated windows. kept:
    not base_failed and the list says 1. Null texts have no words. Repeated rows each return a row, an empty table none.
    Other columns are not read.
    """
    stats = text_statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    return stats.select("*", failed.alias("base_failed"), list_column(rules).cast("int").alias("rule_label")).withColumn("kept", ~F.col("base_failed") & (F.col("rule_label") == 1))

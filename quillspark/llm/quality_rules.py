r"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``ledger`` evaluates every rule once per document and stores the measurements and one failure bit per rule. Policies
are versioned sets of rules: ``apply_policy`` reads only the bits, and ``ablation`` tells from them what each rule does
alone, without going back to the texts.

Words are runs of characters other than ``\x20`` and ``\x09-\x0D``. Rules marked (base) are fixed by contract:

    bit 0  few_words       (base) fewer than 10 words
    bit 1  repeated_words  (base) more than 20 % of the words lie in 5-word windows that the text holds twice or more
    bit 2  symbols         more than 25 symbols of #*$%&|<> per 100 words
    bit 3  shouting        more than 40 % of the word characters are A-Z
    bit 4  word_length     mean word length outside 2 to 20 characters
    bit 5  repeated_lines  more than 40 % of the lines with a word equal an earlier line
    bit 6  insults         a toxic score of 1 or more

The toxic lexicon is learned from a bounded sample of labelled rows (``fit_lexicon``). It holds words that many toxic
documents of a language hold between different neighbours and no other labelled document holds, each a score of 1, and
beginnings of words, written ``stem*k``, each occurrence a score of 1/k: many insults have more forms than any sample,
and k is the count at which hardly a clean document is met. ``n_insults`` is the largest score of a stem, rounded down,
plus the number of words.

Cases: a null text has no words, an empty text neither (both fail few_words); texts of any length are read whole;
repeated rows each get a row; columns named like a measurement, ``failed`` or ``kept`` (in any case of letters) are
replaced, all others stay; without labels the lexicon is empty and bit 6 never set; an empty table gives an empty
ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import place

# White space of the word definition, the symbols, and the base limits.
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

RULES = ("few_words", "repeated_words", "symbols", "shouting", "word_length", "repeated_lines", "insults")
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: Versioned policies: a document is kept if none of the rules failed.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "clean-1": ("few_words", "repeated_words", "symbols", "shouting", "word_length", "repeated_lines"),
    "clean-2": RULES,
}
BASE, CURRENT = "base-1", "clean-2"
#: Columns that measure() adds.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "n_insults")


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def measure(docs: DataFrame, lexicon: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, whatever their names, and the measurements that the rules need (one pass, no shuffle)."""
    names, taken = docs.columns, (*MEASURES, "failed")
    at = (place(docs, id_col), place(docs, text_col))
    kept = [k for k, c in enumerate(names) if k in at or c.lower() not in taken]
    # Columns go by their places, and ride in one struct, so that no name of theirs meets one of these steps.
    marks = [f"c{k}" for k in range(len(names))]
    step = docs.toDF(*marks).select(F.struct(*(marks[k] for k in kept)).alias("rest"), F.coalesce(F.col(marks[at[1]]), F.lit("")).alias("text"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, WHITE, "")) > 0)
    step = step.withColumns({"_q_words": F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""), "_q_lines": lines})
    step = step.withColumn("_q_hash", F.transform("_q_words", lambda w: F.xxhash64(w)))

    def window(first: Column, i: Column) -> Column:
        return F.xxhash64(first, *(F.get(F.col("_q_hash"), i + k) for k in range(1, WINDOW)))

    starts = F.slice("_q_hash", 1, F.greatest(F.size("_q_hash") - (WINDOW - 1), F.lit(0)))
    step = step.withColumn("_q_win", F.transform(starts, window))
    # Most texts repeat no window; only the others sort theirs.
    again = F.size(F.array_distinct("_q_win")) < F.size("_q_win")
    sorted_ = F.array_sort(F.transform("_q_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.withColumn("_q_sorted", F.when(again, sorted_).otherwise(none))

    def twice(e: Column, k: Column) -> Column:
        near = [F.get(F.col("_q_sorted"), k + d)["h"] for d in (-1, 1)]
        return F.coalesce(near[0] == e["h"], F.lit(False)) | F.coalesce(near[1] == e["h"], F.lit(False))

    found = F.array_sort(F.transform(F.filter("_q_sorted", twice), lambda e: e["i"]))
    covered = F.aggregate(
        found,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    n_words = F.size("_q_words").cast("long")
    out = {
        "n_words": n_words,
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_upper": _count_of(text, UPPER),
        "n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_insults": _insults(text, lexicon or []),
    }
    # A generator, unlike a projection, lets no filter on a measurement copy its expressions further down.
    made = F.inline(F.array(F.struct(*(value.alias(name) for name, value in out.items()))))
    return step.select(*(F.col("rest").getField(marks[k]) for k in kept), made).toDF(*(names[k] for k in kept), *out)


def _insults(text: Column, lexicon: list[str]) -> Column:
    if not lexicon:
        return F.lit(0).cast("long")
    words = [w for w in sorted(lexicon) if "*" not in w]
    total = F.lit(0).cast("long")
    if words:
        total = total + F.size(F.array_intersect(plain_words(text), F.array(*[F.lit(w) for w in words])))
    stems = [w.split("*") for w in sorted(lexicon) if "*" in w]
    if stems:
        # An edge tells where a word begins; the longer text less the shorter one counts the occurrences of a stem.
        edged = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
        def largest(e: Column) -> Column:
            return F.array_max(F.array(*[F.floor((F.length(e) - F.length(F.replace(e, F.lit(f" {stem}"), F.lit("")))) / (len(stem) + 1) / int(k)) for stem, k in stems]))

        # The lambda's variable makes the text once for all stems.
        total = total + F.get(F.transform(F.array(edged), largest), F.lit(0))
    return total


def plain_words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)


def failures() -> Column:
    """The failure bits, from the measurements of measure()."""
    n, chars = F.col("n_words"), F.col("word_chars")
    failed = {
        "few_words": n < 10,
        "repeated_words": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 100 * F.col("n_symbols") > 25 * n,
        "shouting": 100 * F.col("n_upper") > 40 * chars,
        "word_length": (chars < 2 * n) | (chars > 20 * n),
        "repeated_lines": 100 * F.col("n_dup_lines") > 40 * F.col("n_lines"),
        "insults": F.col("n_insults") >= 1,
    }
    bits = F.lit(0).cast("long")
    for name in RULES:
        bits = bits.bitwiseOR(F.when(failed[name], F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, lexicon: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and the column ``failed``, a bit per failed rule, for every row of docs."""
    return measure(docs, lexicon, id_col, text_col).withColumn("failed", failures())


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with the verdict ``kept`` of a policy."""
    return book.withColumn("kept", passes(policy))


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_alone): rows that fail a rule of the policy, and rows that only this rule rejects."""
    wanted = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    sums = [F.count("*").alias("n")]
    for name in POLICIES[policy]:
        sums += [F.count_if(wanted.bitwiseAND(F.lit(BIT[name])) != 0).alias(f"{name}_failed")]
        sums += [F.count_if(wanted == BIT[name]).alias(f"{name}_alone")]
    rows = ", ".join(f"'{name}', {name}_failed, {name}_alone" for name in POLICIES[policy])
    return book.agg(*sums).selectExpr(f"stack({len(POLICIES[policy])}, {rows}) as (rule, n_failed, n_alone)")


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, rows_per_class: int = 4000, share: float = 0.05, contexts: int = 4
) -> list[str]:
    """Words of toxic documents, from about ``rows_per_class`` toxic and as many other label rows.

    A word enters if, within a language, the sampled toxic rows hold it after at least ``contexts`` different words and
    after at least ``share`` of the number of those rows, and no other sampled row of any language holds it. Exact and
    near copies repeat neighbours and so don't add up.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") == 1).alias("is_toxic"))
    totals = {r["is_toxic"]: r["n"] for r in marks.groupBy("is_toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(True):
        return []
    at = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8)
    cut = {k: f"{int(min(1.0, rows_per_class / n) * 0xFFFFFFFF):08x}" for k, n in totals.items()}
    drawn = F.when(F.col("is_toxic"), at <= cut[True]).otherwise(at <= cut.get(False, ""))
    # About 2 * rows_per_class rows of 9 bytes, whatever the input's size.
    sample = docs.where(F.col("text").isNotNull()).join(F.broadcast(marks.where(drawn)), "doc_id")
    words = F.array_remove(plain_words(F.col("text")), "")
    pairs = F.transform(F.col("words"), lambda w, i: F.struct(w.alias("w"), F.get(F.col("words"), i - 1).alias("before")))
    rows = sample.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "is_toxic", words.alias("words"))
    rows = rows.select("doc_id", "lang", "is_toxic", F.explode(pairs).alias("p")).select("doc_id", "lang", "is_toxic", "p.*")
    size = sample.where("is_toxic").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.countDistinct("doc_id").alias("size"))
    seen = rows.groupBy("w", "lang", F.coalesce("before", F.lit("")).alias("before")).agg(
        F.max(F.when(F.col("is_toxic"), 1).otherwise(0)).alias("bad"), F.max(F.when(F.col("is_toxic"), 0).otherwise(1)).alias("good")
    )
    per = seen.groupBy("w", "lang").agg(F.sum("bad").alias("ctx"), F.max("good").alias("good")).join(F.broadcast(size), "lang", "left")
    per = per.withColumn("hot", (F.col("ctx") >= contexts) & (F.col("ctx") >= share * F.col("size")))
    found = per.groupBy("w").agg(F.max("hot").alias("hot"), F.max("good").alias("good")).where("hot and good = 0")
    exact = [r["w"] for r in found.select("w").collect()]
    return sorted(exact) + _fit_stems(rows, size, sample, share, contexts)


def _fit_stems(rows: DataFrame, size: DataFrame, sample: DataFrame, share: float, least: int) -> list[str]:
    """Beginnings ``stem*k`` of words that, k times or more in a document, tell toxic rows of a language from others.

    Of the sampled toxic rows of the language ``share`` (and ``least``) or more hold the stem k times, of all clean rows
    one in a thousand or fewer and at most one for 20 toxic ones; k is the smallest such count. Stems of fewer than
    ``least`` different words in toxic rows are left to the words themselves.
    """
    cuts = F.transform(F.sequence(F.lit(4), F.lit(9)), lambda n: F.when(F.length("w") > n, F.substring(F.col("w"), F.lit(1), n)))
    stems = rows.select("doc_id", "lang", "is_toxic", F.explode(F.array_compact(cuts)).alias("stem"))
    per = stems.groupBy("stem", "doc_id").agg(F.count("*").alias("n"), F.max("lang").alias("lang"), F.max("is_toxic").alias("is_toxic"))
    tries = (1, 2, 3, 4, 5, 6, 8)
    bad = [F.count_if(F.col("is_toxic") & (F.col("n") >= k)).alias(f"bad{k}") for k in tries]
    good = [F.count_if(~F.col("is_toxic") & (F.col("n") >= k)).alias(f"good{k}") for k in tries]
    here = per.groupBy("stem", "lang").agg(*bad, *good)
    forms = rows.where("is_toxic").select("lang", "w").distinct().select("lang", F.explode(F.array_compact(cuts)).alias("stem"))
    forms = forms.groupBy("stem", "lang").agg(F.count("*").alias("forms")).where(F.col("forms") >= least)
    clean = sample.where(~F.col("is_toxic")).select("doc_id").distinct().count()
    # Only stems of enough toxic rows meet the clean counts of all languages.
    hot = here.join(forms, ["stem", "lang"]).join(F.broadcast(size), "lang").where((F.col("bad1") >= least) & (F.col("bad1") >= share * F.col("size"))).select("stem", "size", *(f"bad{k}" for k in tries))
    all_good = here.groupBy("stem").agg(*(F.sum(f"good{k}").alias(f"good{k}") for k in tries))
    out: dict[str, int] = {}
    for r in hot.join(all_good, "stem").collect():
        for k in tries:
            b, g = r[f"bad{k}"], r[f"good{k}"]
            if b >= max(least, share * r["size"]) and g <= 0.001 * clean and b >= 20 * g:
                out[r["stem"]] = min(k, out.get(r["stem"], k))
                break
    # A longer stem adds nothing to a shorter one of the same count or less.
    return [f"{w}*{k}" for w, k in sorted(out.items()) if not any(out.get(w[:n], k + 1) <= k for n in range(4, len(w)))]

"""Quality rules: base counts, and divergence from language references. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent
# The divergence guards: words a text needs before its histograms count, and the most divergence (0 to 1). That of common
# words is a share of what a text without any has from the reference, and no less than chance gives texts of 100 words.
CHAR_GUARD, CHAR_LIMIT = 50, 0.1
WORD_GUARD, WORD_SHARE, WORD_CHANCE = 100, 0.5, 0.05
EDGES = ".,;:!?'\"()[]{}<>*_-/|\u2026\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u00ab\u00bb\u00a1\u00bf"  # cut off words before they are looked up

# The most common words of each language.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "as", "with", "be", "by"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a"],
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where lambdas use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """A hash for each window of ``width`` words, from one hash a word."""

    def body(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= width, let(hashes, body)).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words that windows with equal hashes cover, each counted once: by sorting, so in n log n steps."""

    def marked(s: Column) -> Column:
        def twice(j: Column) -> Column:
            own = F.get(s, j)
            before, after = F.get(s, j - 1), F.get(s, j + 1)
            same = F.coalesce(own["h"] == before["h"], F.lit(False)) | F.coalesce(own["h"] == after["h"], F.lit(False))
            return F.when(same, own["i"])

        at = F.transform(F.sequence(F.lit(0), F.size(s) - 1), twice)
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        step = lambda j: F.coalesce(F.least(F.get(p, j + 1) - F.get(p, j), F.lit(width)), F.lit(width))
        steps = F.transform(F.sequence(F.lit(0), F.size(p) - 1), step)
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(again, let(let(pairs, marked), covered)).otherwise(F.lit(0).cast("long"))


def _histograms(text: Column, words: Column, lang: Column) -> tuple[Column, Column]:
    """Counts by character class, and of the language's common words (in any case, without ``EDGES``) with all other words last."""
    held = F.coalesce(text, F.lit(""))
    length, in_words = F.length(held), F.length(F.array_join(words, ""))
    some = [F.regexp_count(held, F.lit(p)) for p in (r"[A-Z]", r"[0-9]", r"[.,;:!?'\x22()\-]", r"[#*$%&|<>=@~^_+/\\{}\[\]]", r"[^\x00-\x7F]")]
    lower = in_words - sum(some[1:], some[0])
    chars = F.array(*[c.cast("double") for c in (lower, *some, length - in_words)])
    table = F.create_map(*[F.lit(x) for k, v in COMMON.items() for x in (k, v)])
    # Positions of common words in their list, from 1; texts of other languages have none.
    list_ = F.coalesce(F.try_element_at(table, lang), F.array().cast("array<string>"))
    places = lambda names: F.transform(words, lambda w: F.array_position(names, F.btrim(F.lower(w), F.lit(EDGES))))
    found = F.when(F.size(list_) > 0, F.array_remove(let(list_, places), 0)).otherwise(F.array().cast("array<bigint>"))
    size = max(map(len, COMMON.values()))

    def counts(p: Column) -> Column:
        each = [(F.size(p) - F.size(F.array_remove(p, k))).cast("double") for k in range(1, size + 1)]
        return F.array(*each, (F.size(words) - F.size(p)).cast("double"))

    return chars, let(found, counts)


CHAR_BINS, WORD_BINS = 7, 17


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with ``COUNTS``, _lang, and the histograms _chars and _common."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], body.alias("_body"), F.col(f"`{lang}`").alias("_lang"))
    rows = rows.withColumn("_words", split_words(F.col("_body")))
    chars, common = _histograms(F.col("_body"), F.col("_words"), F.col("_lang"))
    rows = rows.withColumns({"_chars": chars, "_common": common, "_windows": window_hashes(F.col("_words"))})
    lines = F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    in_words = sum((F.get("_chars", F.lit(k)) for k in range(1, CHAR_BINS - 1)), F.get("_chars", F.lit(0)))
    return rows.select(
        *[F.col(f"`{c}`") for c in kept], "_lang", "_chars", "_common", F.size("_words").cast("long").alias("n_words"),
        in_words.cast("long").alias("word_chars"), F.regexp_count("_body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows")).alias("n_repeat_words"),
    )


def references(measured: DataFrame) -> DataFrame:
    """_lang with its shares of character classes (_ref_chars) and common words (_ref_words), over all texts of :func:`measure`.

    A row for each language (null is one), summed before the shuffle.
    """
    sums = measured.groupBy("_lang").agg(
        *[F.sum(F.get("_chars", F.lit(k))).alias(f"c{k}") for k in range(CHAR_BINS)],
        *[F.sum(F.get("_common", F.lit(k))).alias(f"w{k}") for k in range(WORD_BINS)],
    )

    def shares(prefix: str, bins: int) -> Column:
        names = [F.col(f"{prefix}{k}") for k in range(bins)]
        total = sum(names[1:], names[0])
        return F.array(*[F.when(total > 0, n / total).otherwise(0.0) for n in names])

    return sums.select("_lang", shares("c", CHAR_BINS).alias("_ref_chars"), shares("w", WORD_BINS).alias("_ref_words"))


def divergence(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon divergence (base 2, from 0 to 1) of counts and shares; 0 without counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def body(n: Column) -> Column:
        terms = F.zip_with(counts, reference, lambda c, q: let(c / n, lambda p: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return F.when(total > 0, let(total, body)).otherwise(0.0)


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", refs: DataFrame | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with ``COUNTS``, char_divergence, word_divergence, base_failed and kept.

    Base rules: at least ``LEAST_WORDS`` words, and at most ``MOST_REPEATED`` percent of them in windows of
    ``WINDOW`` words that the text holds twice. Then a text must stay near its language's reference:
    Jensen-Shannon divergence of character classes up to ``CHAR_LIMIT`` and of common words up to ``WORD_SHARE`` of
    the divergence of a text without common words (at least ``WORD_CHANCE``), each only from a guard number of words on. ``refs`` (by default those of
    ``docs``) has a row for each language, so that it is joined by size. Texts are measured once: without ``refs`` the measures are
    kept in a table, with the columns ``keep``.

    A null text counts as empty and fails. Null and unlisted languages have a reference for characters but
    no common words. Columns of the new names are replaced, and names that start with an underscore and stand in this module are
    its own; repeated rows are judged alike. Very long texts take time in proportion (n log n for repeated windows).
    """
    new = ["char_divergence", "word_divergence", "base_failed", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*COUNTS, *new)]
    own = {c: f"_kept{i}" for i, c in enumerate(keep)}  # a column of the table may have any name
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col(f"`{text}`").alias("_t"), F.col(f"`{lang}`").alias("_l"))
    rows = measure(named, "_t", "_l", list(own.values()))
    if refs is None:
        rows = stored(rows, "measured")
        refs = stored(references(rows), "references")
    # Once for each language: how far a text of other words only is.
    without = F.array(*[F.lit(float(k == WORD_BINS - 1)) for k in range(WORD_BINS)])
    limit = F.greatest(F.lit(WORD_CHANCE), divergence(without, F.col("_ref_words")) * WORD_SHARE)
    refs = refs.select(F.col("_lang").alias("_ref_lang"), "_ref_chars", "_ref_words", limit.alias("_word_limit"))
    rows = rows.join(refs, F.col("_lang").eqNullSafe(F.col("_ref_lang")), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    far = (F.col("n_words") >= CHAR_GUARD) & (F.col("char_divergence") > CHAR_LIMIT)
    far = far | ((F.col("n_words") >= WORD_GUARD) & (F.col("word_divergence") > F.col("_word_limit")))
    judged = rows.withColumns(
        {
            "char_divergence": divergence(F.col("_chars"), F.col("_ref_chars")),
            "word_divergence": divergence(F.col("_common"), F.col("_ref_words")), "base_failed": failed,
        }
    ).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return judged.select(*[F.col(n).alias(c) for c, n in own.items()], *COUNTS, *new)

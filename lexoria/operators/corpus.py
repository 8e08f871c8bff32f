"""Counting tokens of corpora, and moving counts of forms to lemmas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexoria.functions import text as X
from lexoria.operators.keyed import first_per_key
from lexoria.plans.runtime import broadcast_within


def count_words(docs: DataFrame, unit: Column | None = None, text: str = "text", vocabulary: DataFrame | None = None, by: list[str] | None = None, most_broadcast: int = 64 << 20) -> DataFrame:
    """([by], word, occurrences, documents): tokens counted, and in how many units they are.

    Without a unit each row is one: a row's tokens are sorted, the first of each kind is marked, and
    one grouping by word, combined before its shuffle, counts both. With a unit (an author, a clip)
    there are two groupings, so that no set of units is ever held for a word. With a vocabulary (word)
    only its words count; it is broadcast up to so many bytes, which are counted first. Null texts count for nothing.
    """
    by = by or []
    if unit is None:
        tokens = F.sort_array(X.tokenize(text))
        toks = docs.select(*by, tokens.alias("_t")).select(*by, F.explode(_marked(F.col("_t"))).alias("_x")).select(*by, "_x.word", "_x.first")
    else:
        toks = docs.select(*by, unit.alias("_unit"), F.explode(X.tokenize(text)).alias("word"))
    if vocabulary is not None:
        toks = toks.join(broadcast_within(vocabulary.select("word").distinct(), most_broadcast), "word", "left_semi")
    if unit is None:
        return toks.groupBy(*by, "word").agg(F.count("*").alias("occurrences"), F.sum("first").alias("documents"))
    per_unit = toks.groupBy(*by, "word", "_unit").agg(F.count("*").alias("n"))
    return per_unit.groupBy(*by, "word").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


def _marked(tokens: Column) -> Column:
    """Sorted tokens with a 1 for the first of each kind."""
    return F.transform(tokens, lambda w, i: F.struct(w.alias("word"), F.when((i > 0) & (F.get(tokens, i - 1) == w), 0).otherwise(1).alias("first")))


def corpus_totals(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, documents, tokens, matched is not looked at): all tokens, not only those of a vocabulary."""
    return docs.groupBy(*by).agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size(X.tokenize(text))), F.lit(0)).alias("tokens"))


def vocabulary(lexemes: DataFrame, form: str, usable: Column) -> DataFrame:
    """(word): distinct normalized forms that are usable."""
    return lexemes.where(usable).select(X.normalize(F.trim(F.col(form))).alias("word")).where("word <> ''").distinct()


def form_map(forms: DataFrame, form: str = "form", lemma: str = "lemma") -> DataFrame:
    """(form, lemma, n_lemmas): one row per pair, with how many lemmas claim the form."""
    one = forms.where(F.col(form).isNotNull() & F.col(lemma).isNotNull()).select(F.col(form).alias("form"), F.col(lemma).alias("lemma")).distinct()
    n = one.groupBy("form").agg(F.count("*").alias("n_lemmas"))
    return one.join(n, "form")


def roll_up(counts: DataFrame, claims: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Strict: ([by], lemma, occurrences, documents). `counts`: [by], word, occurrences, documents.

    A form's counts are shared among the lemmas that claim it in proportion to 1 plus the count of the
    lemma's own citation form. Occurrences add up, documents are the largest share, both rounded half
    to even at the end. A form without a claim is its own lemma.
    """
    by = by or []
    own = counts.select(*by, F.col("word").alias("lemma"), F.col("occurrences").alias("_head"))
    got = counts.withColumnRenamed("word", "form").join(claims.select("form", "lemma"), "form", "left")
    got = got.withColumn("lemma", F.coalesce("lemma", "form"))
    got = got.join(own, [*by, "lemma"], "left").withColumn("_w", F.coalesce("_head", F.lit(0)) + 1)
    total = got.groupBy(*by, "form").agg(F.sum("_w").alias("_t"))
    got = got.join(total, [*by, "form"])
    share = F.col("_w") / F.col("_t")
    out = got.groupBy(*by, "lemma").agg(F.sum(F.col("occurrences") * share).alias("o"), F.max(F.col("documents") * share).alias("d"))
    even = lambda c: F.bround(F.round(c, 6)).cast("long")
    return out.select(*by, "lemma", even("o").alias("occurrences"), even("d").alias("documents"))


def roll_up_loose(counts: DataFrame, claims: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Loose: every lemma that claims a form gets its count in full."""
    by = by or []
    got = counts.withColumnRenamed("word", "form").join(claims.select("form", "lemma"), "form", "left")
    return got.groupBy(*by, F.coalesce("lemma", "form").alias("lemma")).agg(F.sum("occurrences").alias("occurrences"))


def merge_panel(counts: DataFrame, corpora: list[str], key: str = "lemma") -> DataFrame:
    """(key, occurrences, documents) over the corpora of one panel."""
    return counts.where(F.col("corpus_name").isin(corpora)).groupBy(key).agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def co_claimants(claims: DataFrame, counts: DataFrame) -> DataFrame:
    """(lemma, other): the most frequent other lemma that shares a form; of equals the first by name.

    A form hands on its first two claimants only: the other one of a lemma is the first of them, or the
    second if it is the first itself. So lemmas of a form are never paired.
    """
    own = counts.select(F.col("word").alias("lemma"), "occurrences")
    c = claims.where("n_lemmas > 1").select("form", "lemma").join(own, "lemma", "left").select("form", F.struct((-F.coalesce("occurrences", F.lit(0))).alias("n"), F.col("lemma").alias("lemma")).alias("k"))
    c = c.join(c.groupBy("form").agg(F.min("k").alias("a")), "form")
    c = c.join(c.where("k <> a").groupBy("form").agg(F.min("k").alias("b")), "form")
    best = c.select(F.col("k.lemma").alias("lemma"), F.when(F.col("k") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("o"))
    return best.groupBy("lemma").agg(F.min("o").alias("o")).select("lemma", F.col("o.lemma").alias("other"))


def best_runs(runs: DataFrame) -> DataFrame:
    """Of each corpus (corpus_name, id, docs, at, status) the completed run with the most documents, of equals
    the latest, then the first by id; corpora without a completed run have none."""
    rows = runs.where("status = 'completed'")
    return first_per_key(rows, ["corpus_name"], [-F.col("docs"), -F.coalesce(F.unix_micros("at"), F.lit(-(1 << 62))), "id"])


# Tokens of a document on average, and distinct words of a corpus at least.
TOKEN_RATIO, LEAST_WORDS = (50, 2000), 5000


def quality_checks(counts: DataFrame, runs: DataFrame, expected: list[str], ratio: tuple[int, int] = TOKEN_RATIO, least_words: int = LEAST_WORDS) -> DataFrame:
    """(corpus_name, check_name, verdict): no word in more documents than were read, no count of 0 or less,
    tokens of a document within a range, enough words where a run is completed; and for '' whether all
    expected corpora are. `counts`: corpus_name, word, occurrences, documents; `runs`: corpus_name, docs,
    tokens, status, one row per corpus."""
    q = counts.groupBy("corpus_name").agg(F.count_distinct("word").alias("_words"), F.max("documents").alias("_top"), F.count_if(F.col("occurrences") <= 0).alias("_bad"))
    q = q.join(runs, "corpus_name", "left")
    each = F.col("tokens") / F.col("docs")
    w = q.select(
        "corpus_name",
        F.when((F.col("docs") > 0) & (F.col("_top") > F.col("docs")), "fail").otherwise("pass").alias("no_cycling"),
        F.when(F.col("_bad") > 0, "fail").otherwise("pass").alias("positive_counts"),
        F.when((F.col("docs") > 0) & (F.col("tokens") > 0), F.when((each < ratio[0]) | (each > ratio[1]), "warn").otherwise("pass")).otherwise("skip").alias("token_ratio"),
        F.when(F.coalesce(F.col("status") != "completed", F.lit(True)), "skip").when(F.col("_words") < least_words, "fail").otherwise("pass").alias("word_coverage"),
    )
    done = q.where("status = 'completed'").agg(F.count_if(F.col("corpus_name").isin(expected)).alias("n"))
    last = done.select(F.lit("").alias("corpus_name"), F.lit("all_complete").alias("check_name"), F.when(F.col("n") < len(set(expected)), "warn").otherwise("pass").alias("verdict"))
    return w.unpivot(["corpus_name"], ["no_cycling", "positive_counts", "token_ratio", "word_coverage"], "check_name", "verdict").unionByName(last)


# --- classification: ladders of conditions -----------------------------------------------------------


# Where the bins of rarity begin and end, and those of candidates; the verdicts' thresholds.
RARITY = [(0.30, "very_rare"), (0.50, "rare"), (0.60, "uncommon")]
RARITY_OF_CANDIDATES = [(0.30, "very_rare"), (0.50, "rare")]
MODERN_RARE, MODERN_ALIVE, ATTESTED, ATTESTED_DOCUMENTS, EMERGING = 500, 2000, 3, 2, -0.15


def _binned(c: Column, steps: list[tuple[float, str]], rest: str, none: Column) -> Column:
    out = F.when(none, None)
    for ceiling, name in steps:
        out = out.when(c < ceiling, name)
    return out.when(c.isNotNull(), rest)


def rarity(c: Column) -> Column:
    """Five bins by frequency in a dictionary: none at 0.01 or less, then below 0.3, 0.5 and 0.6."""
    return _binned(c, RARITY, "standard", c <= 0.01)


def rarity_of_candidates(c: Column) -> Column:
    return _binned(c, RARITY_OF_CANDIDATES, "uncommon", F.lit(False))


def verdict(hist: Column, hist_docs: Column, modern: Column, shift: Column, rare: int = MODERN_RARE, alive: int = MODERN_ALIVE) -> Column:
    """How a word fares between a historical and a modern panel."""
    attested = (hist >= ATTESTED) & (hist_docs >= ATTESTED_DOCUMENTS)
    return (
        F.when((modern >= alive) & (shift <= EMERGING), "emerging").when(modern >= alive, "alive").when(~attested, "absent")
        .when(modern == 0, "extinct").when(modern < rare, "historical_only").otherwise("declining")
    )


# Fixed value: tokens of the corpus by which the thresholds were set.
CALIBRATED = 16_969_999_321


def scale_bar(bar: int, tokens: int, calibrated: int = CALIBRATED) -> int:
    """A threshold calibrated on one corpus size, for another; unscaled without tokens."""
    return round(bar * tokens / calibrated) if tokens else bar


def per_million(c: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, c * 1e6 / tokens).otherwise(F.lit(0.0))


def log_ratio(h: Column, m: Column, smooth: float = 0.1) -> Column:
    return F.log2((h + smooth) / (m + smooth))


def family_ratio(strict: Column, loose: Column) -> Column:
    return F.when(strict > 0, loose / strict).otherwise(F.lit(1.0))


def band(c: Column) -> Column:
    """0 without occurrences, else 1 plus the whole part of the decimal logarithm, at most 7."""
    return F.when(F.coalesce(c, F.lit(0)) <= 0, 0).otherwise(F.least(F.lit(7), F.length(c.cast("long").cast("string"))))


def modern_band(c: Column, rare: int = MODERN_RARE) -> Column:
    return F.when(c.isNull(), None).when(c == 0, 0).when(c < rare, 1).otherwise(2)


def zipf(c: Column, tokens: Column) -> Column:
    """Zipf frequency from our own counts; null without occurrences."""
    return F.when((c > 0) & (tokens > 0), F.log10(c / tokens * 1e9))


def banded(c: Column, steps: list[tuple[float, int]], rest: int) -> Column:
    """Points of the first step whose ceiling lies above the value; `rest` above all."""
    out = None
    for ceiling, points in steps:
        out = F.when(c < ceiling, points) if out is None else out.when(c < ceiling, points)
    return out.otherwise(rest)

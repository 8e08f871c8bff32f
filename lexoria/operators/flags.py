"""Flags derived from a word's definition, forms and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexoria.functions import text as X
from lexoria.operators.keyed import first_per_key

# A definition that states a diminutive.
SAYS_DIMINUTIVE = r"(?U)(?:^|\|)\s*(?:\([^)]{0,40}\)\s*)?[Dd]iminutiv\w*\s+(?:al|a|ale|lui|de\s+la)\b"
# Endings of diminutives and what the word's stem ends in without them.
DIMINUTIVE_ENDINGS = {
    "uleț": "", "uliță": "ă", "ișor": "", "ișoară": "ă", "cioară": "ă", "șoară": "ă", "șor": "", "uță": "ă", "uț": "",
}
# Old spellings and what they became, (pattern, replacement), in order.
OLD_SPELLINGS = [("țiune$", "ție"), ("ziune$", "zie"), ("siune$", "sie"), ("^s(?=[bdg])", "z"), ("^des(?=[bdgjlmnrv])", "dez"), ("^adv", "av")]
# Fixed value: how much more frequent than an old form the living one must be.
TWIN = 20
# Fixed value: a definition that only names a verb's act.
DEVERBAL = r"(?iU)^\s*(?:Faptul|Ac[țt]iunea)\s+de\s+a\s+(?:\(\s*se\s*\)\s+|se\s+)?(\p{L}+)"
# Word classes by type of inflection, and by description where the type says nothing.
CLASS_OF_TYPE = {
    "F": "substantiv feminin", "M": "substantiv masculin", "N": "substantiv neutru", "A": "adjectiv", "AF": "adjectiv", "AM": "adjectiv", "AN": "adjectiv",
    "V": "verb", "VT": "verb", "VI": "verb", "PT": "participiu", "P": "pronume", "SP": "nume propriu",
}
CLASS_OF_DESCRIPTION = {
    "adv.": "adverb", "interj.": "interjecție", "adj.": "adjectiv", "prep.": "prepoziție", "conj.": "conjuncție", "pron.": "pronume",
    "s.f.": "substantiv feminin", "s.m.": "substantiv masculin", "s.n.": "substantiv neutru", "vb.": "verb", "part.": "participiu",
}
# What a description holds that says something, and types of inflection that do.
TELLING = ["adj", "s.m", "s.f", "s.n", "vb", "adv", "interj", "înv", "reg", "pop", "dial", "arh"]
TELLING_TYPES = ["A", "N", "F", "M", "VT", "VI", "IL", "PT", "P"]


def says_diminutive(definition: Column) -> Column:
    return F.coalesce(definition.rlike(SAYS_DIMINUTIVE), F.lit(False))


def diminutives(words: DataFrame, forms: DataFrame, word: str = "word", definition: str = "definition", endings: dict[str, str] = DIMINUTIVE_ENDINGS) -> DataFrame:
    """Words with `diminutive`: the definition says so, or the word has one of the endings and over 2
    characters before it, which with what the ending stands for are a known form (form)."""
    w = F.lower(F.col(word))
    rule = F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(r).alias("r")) for e, r in endings.items()]))
    cand = words.select(F.col(word).alias("_w"), w.alias("_l"), rule.alias("_r")).where(F.endswith(F.col("_l"), F.col("_r.e")))
    cand = cand.where(F.length("_l") > F.length("_r.e") + 2).select("_w", "_l", F.expr("left(_l, length(_l) - length(_r.e)) || _r.r").alias("form")).where("form <> _l")
    known = forms.where("form <> ''").select(F.lower("form").alias("form")).distinct()
    hit = cand.join(known, "form", "left_semi").select("_w").distinct().withColumn("_hit", F.lit(1))
    got = words.join(hit, F.col(word) == F.col("_w"), "left")
    return got.select(*words.columns, (says_diminutive(F.col(definition)) | F.col("_hit").isNotNull()).cast("int").alias("diminutive"))


def archaic_spellings(words: DataFrame, counts: DataFrame, factor: int = TWIN, rules: list[tuple[str, str]] = OLD_SPELLINGS) -> DataFrame:
    """(word, modern): the first rewriting that changes the word into one that is `factor` times as
    frequent. `words`: word, own; `counts`: word, n."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.regexp_replace("word", a, b).alias("modern")) for i, (a, b) in enumerate(rules)])
    cand = words.select("word", "own", F.explode(each).alias("r")).select("word", "own", "r.i", "r.modern").where("modern <> word")
    hit = cand.join(counts.select(F.col("word").alias("modern"), "n"), "modern").where(F.col("n") >= factor * F.greatest(F.coalesce("own", F.lit(0)), F.lit(1)))
    return first_per_key(hit.select("word", "i", "modern"), ["word"], ["i"]).select("word", "modern")


def entry_heads(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variant, head) and (head): which forms stand in an entry beside a main one, and all main ones.
    `entries`: entry_id, form, main; forms are normalized."""
    e = entries.where("form <> ''").select("entry_id", X.normalize("form").alias("form"), (F.col("main") == 1).alias("main")).distinct()
    heads = e.where("main").select("entry_id", F.col("form").alias("head"))
    pairs = e.where("not main").select("entry_id", F.col("form").alias("variant")).join(heads, "entry_id").where("variant <> head")
    return pairs.select("variant", "head").distinct(), heads.select("head").distinct()


def variants(words: DataFrame, entries: DataFrame, counts: DataFrame, paradigms: DataFrame, factor: int = TWIN) -> DataFrame:
    """(variant, head): words that are a spelling of a living head.

    A definition that is nothing but 'vezi X' names the head; it holds if X is `factor` times as frequent
    as the word. Otherwise a word that is never main in an entry is a variant of the main forms beside it:
    the nearest by edit distance, of equals the most frequent, then by name, if that one is as frequent.
    Words whose spelling is known to be old are left out. A word is counted by itself, a head by its
    paradigm if that is more. `words`: word, definition, archaic; `entries`: entry_id, form, main; `counts`:
    word, n; `paradigms`: lemma, n.
    """
    pairs, heads = entry_heads(entries)
    zero = F.lit(0).cast("long")
    own = counts.select("word", F.col("n").alias("_own"))
    top = counts.select(F.col("word").alias("head"), "n").unionByName(paradigms.select(F.col("lemma").alias("head"), "n")).groupBy("head").agg(F.max("n").alias("_head"))
    w = words.where(F.coalesce(F.col("archaic"), F.lit(0)) == 0).select("word", X.pointer_target("definition").alias("pointer"))
    w = w.join(own, "word", "left").join(heads.select(F.col("head").alias("word"), F.lit(True).alias("is_head")), "word", "left")
    w = w.where("pointer is not null or is_head is null").select("word", "pointer", (factor * F.greatest(F.coalesce("_own", zero), F.lit(1))).alias("floor"))
    named = w.where("pointer <> word").join(top.withColumnRenamed("head", "pointer"), "pointer").where("_head >= floor").select("word", F.col("pointer").alias("head"))
    rest = w.join(named, "word", "left_anti").select("word", "floor").join(pairs.withColumnRenamed("variant", "word"), "word").join(top, "head", "left")
    rest = rest.select("word", "floor", "head", F.coalesce("_head", zero).alias("_head"), F.levenshtein("word", "head").alias("d"))
    near = first_per_key(rest, ["word"], ["d", -F.col("_head"), "head"]).where("_head >= floor").select("word", "head")
    return named.unionByName(near).select(F.col("word").alias("variant"), "head")


def deverbal(words: DataFrame, flags: list[str], word: str = "word", definition: str = "definition", seam: str | None = None) -> DataFrame:
    """(word, verb): nouns whose first segment says 'the act of' a verb that is itself a row without any
    of the flags; a missing flag column is 0. With a seam the verb's is the noun's or 'relevant'."""
    flags = [f for f in flags if f in words.columns]
    clear = F.lit(True)
    for f in flags:
        clear = clear & (F.coalesce(f, F.lit(0)) == 0)
    s = F.col(seam) if seam else F.lit("")
    verb = X.normalize(F.regexp_extract(F.trim(X.first_segment(definition)), DEVERBAL, 1))
    nouns = words.select(F.col(word).alias("word"), verb.alias("verb"), s.alias("_s")).where("verb <> '' and verb <> word")
    verbs = words.where(clear).select(F.col(word).alias("verb"), s.alias("_v")).distinct()
    return nouns.join(verbs, "verb").where("_s = _v or _v = 'relevant'").select("word", "verb").distinct()


def word_class(kind: Column, description: Column) -> Column:
    """The word class by type of inflection, else by description, else null."""
    known = lambda names, c: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.coalesce(c, F.lit("")))
    return F.coalesce(known(CLASS_OF_TYPE, F.trim(kind)), known(CLASS_OF_DESCRIPTION, F.lower(F.trim(description))))


def curation(form: Column, description: Column, kind: Column) -> Column:
    """Why a candidate is left out: a proper noun, several words, a description that says nothing; or 'kept'."""
    says = F.lit(False)
    for t in TELLING:
        says = says | F.lower(description).contains(t)
    says = F.coalesce(says & (F.trim(description) != ""), F.lit(False)) | F.regexp_extract(F.coalesce(kind, F.lit("")), "^([A-Z]+)", 1).isin(TELLING_TYPES)
    return (
        F.when(form.rlike(r"^\p{Lu}"), "proper_noun").when(form.rlike(r"^[A-Z][a-z]+ [A-Z]| |^[a-z]+-[a-z]+"), "foreign").when(~says, "no_description").otherwise("kept")
    )


def curated(lexemes: DataFrame, above: float = 0.01, below: float = 1.0, longer: int = 3) -> DataFrame:
    """`lexemes` (form, frequency, description, kind and others) within the range of frequency and longer
    than `longer`, with `verdict` as `curation` tells."""
    f = F.col("frequency")
    kept = lexemes.where((f > above) & (f < below) & (F.length("form") > longer))
    return kept.withColumn("verdict", curation(F.col("form"), F.col("description"), F.col("kind")))


def fair_question(flags: list[str], definition: str = "definition", dictionaries: str = "dict_count") -> Column:
    """Whether a word can be asked about: no flag set, in 3 dictionaries, and a first segment of 12
    characters that points nowhere, isn't a derivation's, a heading or in capitals."""
    s = F.trim(X.first_segment(definition))
    low, out = F.lower(s), (F.col(dictionaries) >= 3) & (F.length(s) >= 12)
    for f in flags:
        out = out & (F.coalesce(F.col(f), F.lit(0)) == 0)
    for x in ("vezi ", "diminutiv", "augmentativ"):
        out = out & ~low.startswith(x)
    return out & ~s.endswith(":") & ~s.rlike("^[A-Z][A-Z]")


def proper_nouns(forms: DataFrame, form: str) -> DataFrame:
    """(word, proper): whether a form is capitalized wherever it stands."""
    f = F.col(form)
    return forms.where(f.isNotNull()).groupBy(F.lower(f).alias("word")).agg(F.min((F.initcap(F.substring(f, 1, 1)) == F.substring(f, 1, 1)).cast("int") * (F.lower(f) != f).cast("int")).alias("proper"))


def register_bits(c: Column, names: list[str]) -> Column:
    """A bit for each name that a text holds."""
    return sum((F.when(F.coalesce(c.contains(n), F.lit(False)), 1 << k).otherwise(0) for k, n in enumerate(names)), F.lit(0))


def recent_first(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows numbered from the newest within a key."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at))))

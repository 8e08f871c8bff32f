"""Text functions on columns. All are native expressions but the rounding of large counts and sizes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The alphabet's letters with marks, and what they fold to, place by place.
MARKED, PLAIN = "țșţşăâî", "tstsaai"
# Fixed value: a token is letters with inner hyphens and apostrophes.
TOKEN = r"[a-zăâîșț](?:[a-zăâîșț\-']*[a-zăâîșț])?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(1)
def _compositions() -> tuple[str, str, str, str]:
    """From Python's Unicode data, as texts to look things up in: '|' base mark composed, for every letter
    that is composed of two; '|' composed base mark; '|' mark and its combining class in three digits; and
    the marks as ranges of a pattern's class."""
    pairs, parts, classes, marks = [], [], [], []
    for cp in range(0xA0, 0x20000):
        ch = chr(cp)
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xDFFF:
            continue
        if k := unicodedata.combining(ch):
            classes.append(f"|{ch}{k:03d}")
            marks.append(cp)
        two = unicodedata.decomposition(ch).split()
        if len(two) == 2 and not two[0].startswith("<") and unicodedata.normalize("NFC", ch) == ch:
            pair = "".join(chr(int(x, 16)) for x in two)
            pairs.append(f"|{pair}{ch}")
            parts.append(f"|{ch}{pair}")
    ranges, at = "", 0
    while at < len(marks):
        to = at
        while to + 1 < len(marks) and marks[to + 1] == marks[to] + 1:
            to += 1
        ranges += rf"\x{{{marks[at]:X}}}-\x{{{marks[to]:X}}}"
        at = to + 1
    return "".join(pairs), "".join(parts), "".join(classes), ranges


def compose(c: Column | str) -> Column:
    """Letters and combining marks put together (NFC), natively: marks are sorted by class and then looked
    up one by one with the letter so far; one that stays keeps later ones of its class from the letter.
    For text of letters and marks; syllables typed in single Hangul letters stay as they are."""
    pairs, parts, classes, marks = _compositions()
    x = _col(c)
    # 1-based places in the texts, which are constants
    at = lambda key, table: F.call_function("locate", F.concat(F.lit("|"), key), F.lit(table))
    kind = lambda m: F.substr(F.lit(classes), at(m, classes) + 2, F.lit(3)).cast("int")

    def cluster(g: Column) -> Column:
        # taken apart: a letter may be composed of up to four
        bare = g.rlike(f"^[{marks}]")
        pair = F.array(F.struct(F.when(bare, "").otherwise(F.substr(g, F.lit(1), F.lit(1))).alias("b"), F.when(bare, g).otherwise(F.substr(g, F.lit(2))).alias("r")))

        def apart(p: Column) -> Column:
            where = F.when(p["b"] == "", 0).otherwise(at(p["b"], parts))
            return F.struct(
                F.when(where > 0, F.substr(F.lit(parts), where + 2, F.lit(1))).otherwise(p["b"]).alias("b"),
                F.when(where > 0, F.concat(F.substr(F.lit(parts), where + 3, F.lit(1)), p["r"])).otherwise(p["r"]).alias("r"),
            )

        for _ in range(3):
            pair = F.transform(pair, apart)
        return F.array_join(F.transform(pair, lambda p: put_together(p["b"], F.filter(F.split(p["r"], ""), lambda m: m != ""))), "")

    def put_together(base: Column, rest: Column) -> Column:
        ranked = F.array_sort(F.transform(rest, lambda m, i: F.struct(kind(m).alias("k"), i.alias("i"), m.alias("m"))))
        zero = F.struct(base.alias("base"), F.lit("").alias("rest"), F.lit(0).alias("kept"))

        def step(acc: Column, m: Column) -> Column:
            key = F.concat(acc["base"], m["m"])
            where = at(key, pairs)
            joins = (where > 0) & (acc["kept"] < m["k"])
            return F.struct(
                F.when(joins, F.substr(F.lit(pairs), where + 3, F.lit(1))).otherwise(acc["base"]).alias("base"),
                F.when(joins, acc["rest"]).otherwise(F.concat(acc["rest"], m["m"])).alias("rest"),
                F.when(joins, acc["kept"]).otherwise(m["k"]).alias("kept"),
            )

        return F.aggregate(ranked, zero, step, lambda acc: F.concat(acc["base"], acc["rest"]))

    groups = F.regexp_extract_all(x, F.lit(rf"(?s)[^{marks}][{marks}]+|[^{marks}]+(?![{marks}])|[{marks}]+"), F.lit(0))
    done = F.transform(groups, lambda g: F.when(g.rlike(f"[{marks}]"), cluster(g)).otherwise(g))
    return F.when(x.rlike(f"[{marks}]"), F.array_join(done, "")).otherwise(x)


def normalize(c: Column | str) -> Column:
    """Lower case, cedilla letters to comma letters, then composed; null stays null. Native throughout.

    A cedilla typed as a mark of its own comes out as a composed cedilla letter, as it is put together
    after the letters were replaced.
    """
    return compose(F.translate(F.lower(_col(c)), "şţ", "șț"))


def normalize_plain(c: Column | str) -> Column:
    """`normalize` for text known to be composed; native throughout."""
    return F.translate(F.lower(_col(c)), "şţ", "șț")


def fold(c: Column | str) -> Column:
    """Lower case without the alphabet's marks; other letters are left alone."""
    return F.translate(F.lower(_col(c)), MARKED, PLAIN)


def tokenize(c: Column | str, least: int = 3) -> Column:
    """Array of the tokens of at least `least` characters, in order, repeats kept; null gives null."""
    return F.filter(F.regexp_extract_all(normalize_plain(c), F.lit(TOKEN), F.lit(0)), lambda w: F.length(w) >= least)


def tokenize_wide(c: Column | str) -> Column:
    """Array of runs of word characters of any script, hyphens and apostrophes."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(?U)[\w\-']+"), F.lit(0))


def latest_year(c: Column | str) -> Column:
    """The latest year 1500-2099 named in free text, or null."""
    years = F.regexp_extract_all(_col(c), F.lit(r"(1[5-9]\d{2}|20\d{2})"), F.lit(1))
    return F.array_max(F.transform(years, lambda y: y.cast("int")))


def clean_markup(c: Column | str) -> Column:
    """Without {{...}} notes, the signs @#$% and leading digits; blanks collapsed; '' becomes null."""
    x = F.regexp_replace(_col(c), r"\{\{[^}]*\}\}", "")
    x = F.regexp_replace(F.translate(x, "@#$%", ""), r"^\d+", "")
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def clean_entry(c: Column | str) -> Column:
    """`clean_markup` and also without [123] references and underscores that emphasize."""
    return clean_markup(F.replace(F.regexp_replace(_col(c), r"\[\d+\]", ""), F.lit("__"), F.lit("")))


def pointer_target(c: Column | str) -> Column:
    """The word that a definition only points to ('vezi X'), or null."""
    return F.nullif(normalize_plain(F.regexp_extract(_col(c), r"(?iU)^\s*vezi\s+([^\s,;.]+)\s*\.?\s*$", 1)), F.lit(""))


def crumb_key(c: Column | str) -> Column:
    """A breadcrumb as an array of numbers, so that '10.' sorts after '9.'; null gives an empty one."""
    parts = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"\d+"), F.lit(0))
    return F.transform(parts, lambda x: x.cast("long"))


def semicolons_to_pipes(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r";\s?", "|")


def split_clean(c: Column | str, sep: str = r"\|") -> Column:
    """Parts between separators, trimmed, empty ones left out; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def to_number(c: Column | str) -> Column:
    """Tolerant: what isn't a number is null."""
    return F.expr(f"try_cast(trim({c}) as double)") if isinstance(c, str) else F.try_to_number(c, F.lit("999999999999.999999"))


def to_flag(c: Column | str) -> Column:
    """1 for 1, true, yes and da in any case, else 0."""
    return F.lower(F.trim(_col(c).cast("string"))).isin("1", "true", "yes", "da").cast("int")


def first_segment(c: Column | str, sep: str = "|") -> Column:
    return F.substring_index(_col(c), sep, 1)


def excerpt(c: Column | str, most: int = 160) -> Column:
    """The first segment without a trailing all-capitals head, blanks collapsed, cut at a blank with '…'."""
    x = F.regexp_replace(first_segment(c), r"\s*\p{Lu}{2,}[^.]*$", "")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    head = F.substring(x, 1, most)
    cut = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(x) <= most, x).otherwise(F.concat(cut, F.lit("…")))


def truncate(c: Column | str, most: int) -> Column:
    """At most so many characters, the last one '…' if something is left out."""
    x = _col(c)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most - 1), F.lit("…")))


def reveals_word(text: Column | str, word: Column | str) -> Column:
    """Whether a text gives its word away: some token of 4 letters or more shares with the word a
    beginning of 4 letters or more that reaches within 3 letters of the shorter one's end. Words under
    5 letters reveal nothing."""
    w = fold(word)
    toks = F.filter(F.regexp_extract_all(fold(text), F.lit(r"\p{L}+"), F.lit(0)), lambda t: F.length(t) >= 4)
    need = lambda t: F.greatest(F.lit(4), F.least(F.length(t), F.length(w)) - 3)
    hit = F.exists(toks, lambda t: F.substr(t, F.lit(1), need(t)) == F.substr(w, F.lit(1), need(t)))
    return F.when(F.length(w) < 5, False).otherwise(F.coalesce(hit, F.lit(False)))


def is_pointer(c: Column | str) -> Column:
    """A sense that says no more than where to look, or how the word was formed."""
    return F.coalesce(F.lower(F.trim(_col(c))).rlike(r"^(vezi|v\.)\s|^(diminutiv|augmentativ)"), F.lit(False))


def usable_senses(definition: Column | str, word: Column | str, least: int = 12) -> Column:
    """Segments of a definition that can be asked about: long enough, no pointer, no heading, no run of
    three capitals, not ending in a colon and not revealing the word."""
    return F.filter(
        split_clean(definition),
        lambda s: (F.length(s) >= least) & ~is_pointer(s) & ~s.rlike(r":$") & ~s.rlike(r"\p{Lu}{3}") & ~reveals_word(s, word),
    )


def mask_word(text: Column | str, word: Column | str, by: str = "———") -> Column:
    """Every occurrence of the word, whatever its case, replaced."""
    pattern = F.concat(F.lit(r"(?iu)\Q"), F.replace(_col(word), F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    return F.when(F.length(_col(word)) > 0, F.regexp_replace(_col(text), pattern, F.lit(by))).otherwise(_col(text))


def slug(c: Column | str) -> Column:
    """Folded, other characters to single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def clean_tags(c: Column | str, most: int = 20, longest: int = 40) -> Column:
    """Tags trimmed and cut, empty and repeated ones left out, the first so many."""
    x = F.transform(F.coalesce(_col(c), F.array().cast("array<string>")), lambda t: F.substring(F.trim(t), 1, longest))
    return F.slice(F.array_distinct(F.filter(x, lambda t: t != "")), 1, most)


def clean_time(c: Column | str, now: Column) -> Column:
    """A client's time: what can't be read is `now`, what lies over a minute ahead is `now`."""
    t = F.try_to_timestamp(_col(c).cast("string"))
    return F.when(t.isNull() | (t > now + F.expr("interval 60 seconds")), now).otherwise(t)


def count_phrase(n: Column | str, one: str, many: str) -> Column:
    """'1 cuvânt', '5 cuvinte', '20 de cuvinte': the language's way of counting."""
    k = _col(n)
    return F.when(k == 1, F.concat(F.lit("1 "), F.lit(one))).otherwise(
        F.concat(k.cast("string"), F.when((k == 0) | (k % 100).between(1, 19), F.lit(" ")).otherwise(F.lit(" de ")), F.lit(many))
    )


# Abbreviations of word classes that stand before a sense of a synonym entry.
ENTRY_ABBREVIATIONS = [
    "adj", "adv", "s", "sf", "sm", "sn", "vb", "vt", "vi", "interj", "art", "pron", "prep", "conj", "num", "pl", "sg",
]
# Signs that are cut off both ends of a listed word.
ENTRY_SIGNS = " \t\n-–—*≠~"


def entry_words(text: Column | str, head: Column | str) -> Column:
    """The words that a synonym entry lists, as they are written, in order and once each; null gives null.

    What stands in brackets goes, references ('v. X', up to the next mark), sense numbers and
    abbreviations of word classes; then the text is cut at commas, semicolons and full stops. Of each part
    stress marks, signs at the ends and a run of capitals before it are left out. Parts with a tilde,
    without a small letter, of over 40 characters or 4 words, of one character, the headword itself and
    what was there before (in normalized form) give nothing.
    """
    x = F.regexp_replace(_col(text), r"\([^)]*\)", " ")
    x = F.regexp_replace(x, r"(?iU)\bv\s*\.\s*[^,;.]+", " ")
    x = F.regexp_replace(x, r"(?U)\b\d+\s*\.", " ")
    x = F.regexp_replace(x, rf"(?iU)\b(?:{'|'.join(ENTRY_ABBREVIATIONS)})\s*\.", " ")
    sides = F.lit(ENTRY_SIGNS)
    parts = F.transform(F.split(x, r"[,;.]"), lambda p: F.btrim(strip_stress(p), sides))
    parts = F.filter(parts, lambda p: ~p.contains("~"))
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^[A-ZĂÂÎȘȚ][A-ZĂÂÎȘȚ0-9'\- ]*\s+", ""))
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")))
    parts = F.filter(parts, lambda p: p.rlike("[a-zăâîșț]") & (F.length(p) <= 40) & (F.size(F.split(p, " ")) <= 4))
    keyed = F.transform(parts, lambda p: F.struct(normalize(p).alias("k"), p.alias("p")))
    keyed = F.filter(keyed, lambda y: (F.length(y["k"]) >= 2) & ~y["k"].eqNullSafe(normalize(strip_stress(head))))
    # each key once, at its first place
    first = F.aggregate(
        keyed, F.struct(F.array().cast("array<string>").alias("k"), F.array().cast("array<string>").alias("p")),
        lambda acc, y: F.when(F.array_contains(acc["k"], y["k"]), acc).otherwise(F.struct(F.array_append(acc["k"], y["k"]).alias("k"), F.array_append(acc["p"], y["p"]).alias("p"))),
    )
    return first["p"]


def strip_stress(c: Column | str) -> Column:
    """Without the acute and grave marks of stress, whether composed or not; other marks stay."""
    return F.translate(F.translate(_col(c), "áàéèíìóòúùÁÀÉÈÍÌÓÒÚÙ", "aaeeiioouuAAEEIIOOUU"), "́̀", "")


def entry_headword(c: Column | str) -> Column:
    """The capitals that an entry begins with, in lower case; '' if there are none."""
    return F.lower(strip_stress(F.regexp_extract(F.trim(_col(c)), r"^(\p{Lu}[\p{Lu}\-]*)", 1)))


def is_dirty_token(c: Column | str) -> Column:
    """A scraped word that can't be one: an equals sign, over 40 characters, over 4 words or mostly capitals."""
    x = _col(c)
    letters, upper = F.length(F.regexp_replace(x, r"[^\p{L}]", "")), F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    return x.contains("=") | (F.length(x) > 40) | (F.size(F.split(F.trim(x), r"\s+")) > 4) | ((letters > 0) & (upper * 2 > letters))


def html_escape(c: Column | str) -> Column:
    x = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def human_count(c: Column | str) -> Column:
    n = _col(c)
    return (
        F.when(n >= 1_000_000_000, F.format_string("%.1fB", n / 1e9)).when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6))
        .when(n >= 1_000, F.format_string("%.1fk", n / 1e3)).otherwise(n.cast("string"))
    )


@F.pandas_udf(StringType())
def _one_place(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else f"{v:.1f}")  # of halves the even one, unlike format_string


def grouped_count(c: Column | str) -> Column:
    """12,345 with commas; from a million on 1.2M, from a billion on 1.2B."""
    n = _col(c)
    return (
        F.when(n >= 1_000_000_000, F.concat(_one_place(n / 1e9), F.lit("B"))).when(n >= 1_000_000, F.concat(_one_place(n / 1e6), F.lit("M")))
        .otherwise(F.format_number(n, 0))
    )


def human_size(c: Column | str) -> Column:
    """Bytes as B, KB, MB, GB or TB; all but bytes with one decimal place."""
    n = _col(c)
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (k + 1), F.concat(_one_place(n / float(1024**k)), F.lit(f" {unit}")))
    return out.when(n.isNotNull(), F.concat(_one_place(n / float(1024**4)), F.lit(" TB")))


def relative_time(at: Column | str, now: Column) -> Column:
    """How long before `now`: 'just now' (also if later), or whole minutes, hours or days."""
    s = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(_col(at).cast("timestamp"))) / 1_000_000)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).when(s.isNotNull(), part(86400, "d"))


def human_duration(seconds: Column | str) -> Column:
    s = _col(seconds).cast("long")
    return (
        F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
        .when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).when(s.isNotNull(), F.format_string("%ds", s))
    )


def page_url(base: str, word: Column | str) -> Column:
    """Address of a word's page; a blank is %20."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.replace(F.url_encode(_col(word)), F.lit("+"), F.lit("%20")))


def snippet_date(c: Column | str) -> Column:
    """A date in a text: an ISO date, else a year, as text; null if none."""
    x = _col(c)
    iso, year = F.regexp_extract(x, r"(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(x, r"\b((?:19|20)\d{2})\b", 1)
    return F.coalesce(F.nullif(iso, F.lit("")), F.nullif(year, F.lit("")))


def labels(c: Column | str, names: dict[str, str], default: str | None = None) -> Column:
    """Codes to labels by a literal map."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), _col(c)), F.lit(default))

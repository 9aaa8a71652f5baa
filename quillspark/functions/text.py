"""Column expressions over text: tokens, identifiers, links and dates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the token pattern, ASCII words and runs of Hangul syllables.
TOKEN = "[a-z0-9_]+|[가-힣]+"
HANGUL = "^[가-힣]"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composition, which Spark has no function for."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def tokens(text: Column) -> Column:
    """ASCII words of two characters or more; a Hangul run as a whole (up to six syllables) and as syllable pairs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))

    def expand(t: Column) -> Column:
        n = F.length(t)
        pairs = F.when(n > 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: t.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        whole = F.when(n <= 6, F.array(t)).otherwise(F.array().cast("array<string>"))
        return F.when(t.rlike(HANGUL), F.concat(whole, pairs)).when(n > 1, F.array(t)).otherwise(F.array().cast("array<string>"))

    # Most texts have no syllables: their tokens are the matches as they are.
    return F.when(low.rlike("[가-힣]"), F.flatten(F.transform(found, expand))).otherwise(F.regexp_extract_all(low, F.lit("[a-z0-9_]{2,}"), F.lit(0)))


def slug(path: Column) -> Column:
    """Document id of a path: without .md, separators and spaces as underscores, other characters dropped."""
    s = F.regexp_replace(F.regexp_replace(path, "\\.md$", ""), "[/\\\\\\s]", "_")
    s = F.lower(F.regexp_replace(s, "[^A-Za-z0-9_가-힣]", ""))
    return F.coalesce(F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit("")), F.lit("unnamed"))


def unique_ids(ids: Column, order: Column, window) -> Column:
    """The id, with _2, _3 ... for its second and later holders in scan order."""
    n = F.row_number().over(window.partitionBy(ids).orderBy(order))
    return F.when(n == 1, ids).otherwise(F.concat_ws("_", ids, n.cast("string")))


def link_key(link: Column) -> Column:
    """What a wikilink points at: no alias, heading, block, folder or extension; lower case."""
    s = F.regexp_replace(F.regexp_replace(link, "\\\\\\|", "|"), "[|#^].*$", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(s, "^.*/", ""), "(?i)\\.md$", "")))


def wikilinks(body: Column) -> Column:
    """Targets of [[links]], without embedded images."""
    return F.regexp_extract_all(body, F.lit(r"(?s)(?<!!)\[\[(.*?)\]\]"), F.lit(1))


def image_embeds(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"!\[\[(.*?)\]\]"), F.lit(1)))


def filename_date(name: Column) -> Column:
    """The first date in a file name (2026-09-12, 2026.09.12, 20260912, 26_09_12 or 260912; two-digit years from 50 are 19yy)."""
    full = F.regexp_extract(name, r"(?<!\d)((?:19|20)\d{2})[-._]?(\d{2})[-._]?(\d{2})(?!\d)", 0)
    digits = F.regexp_replace(full, r"\D", "")
    short = F.regexp_replace(F.regexp_extract(name, r"(?<!\d)(?:\d{2}[-_]\d{2}[-_]\d{2}|\d{6})(?!\d)", 0), r"\D", "")
    year = F.when(F.substring(short, 1, 2) >= "50", F.lit("19")).otherwise(F.lit("20"))
    return F.coalesce(F.try_to_date(F.nullif(digits, F.lit("")), "yyyyMMdd"), F.try_to_date(F.when(short != "", F.concat(year, short)), "yyyyMMdd"))


def content_date(name: Column, date: Column, mtime_ms: Column, latest: Column) -> Column:
    """The day of a file name if it isn't past `latest`, else of the frontmatter, else of the change; null without any."""
    named = filename_date(name)
    changed = F.to_date(F.timestamp_millis(F.when(mtime_ms > 0, mtime_ms)))
    return F.coalesce(F.when(named <= latest, named), F.try_to_date(date, "yyyy-MM-dd"), changed)


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(0).cast("int")


def body_chars(body: Column) -> Column:
    """Characters of a body without its frontmatter, headings' marks and surrounding space."""
    return F.length(F.trim(F.regexp_replace(strip_frontmatter(body), "(?m)^#.*$", "")))


def strip_frontmatter(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\A---\n(?s:.*?)\n---[^\n]*\n?", "")


def excerpt(text: Column, budget: int) -> Column:
    """Up to `budget` characters, ended at the last paragraph break if that keeps more than 60 %."""
    head = F.substring(text, 1, budget)
    at = F.length(head) - F.instr(F.reverse(head), "\n\n") - 1
    cut = F.when((F.instr(head, "\n\n") > 0) & (at > 0.6 * budget), head.substr(F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= budget, text).otherwise(F.rtrim(cut))


# Particles, the longest first, and units that numbers are split from.
PARTICLES = (
    "이라는", "이라고", "에서는", "에게서", "한테서", "으로서", "으로써", "으로는", "에서의", "으로의", "에서도", "으로도", "이라", "에서", "에게", "한테", "까지", "부터", "처럼", "같은", "같이",
    "만큼", "으로", "이랑", "라는", "라고", "이란", "에는", "하고", "님의", "님이", "님을", "님은", "님께", "님도", "님과", "은", "는", "이", "가", "을", "를", "와", "과", "에", "도", "만", "의", "로", "님",
)
UNITS = "년|월|일|주|시간|시|분|초|개|명|번|회|차"
BREAKS = r"[\s,.\-_?!;:()\[\]{}'\"《》「」【】]+"


def _words(text: Column) -> Column:
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(\d+)({UNITS})", "$1 $2")
    return F.filter(F.split(F.lower(spaced), BREAKS), lambda w: F.length(w) > 1)


def _stem(word: Column) -> Column:
    """The word without its particle, the longest that leaves two characters or more."""
    # The kept part is matched lazily, so that the longest particle goes.
    return F.when(word.rlike("[가-힣]$"), F.regexp_replace(word, rf"^(.{{2,}}?)(?:{'|'.join(PARTICLES)})$", "$1")).otherwise(word)


def _pairs(stem: Column) -> Column:
    s = F.regexp_replace(stem, "[^가-힣]", "")
    n = F.length(s)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: s.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _padded(text: Column) -> Column:
    """Days and months of one digit, with a zero before them."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)(\d{1,2})\s*(?:월|일)"), F.lit(1))
    return F.transform(F.filter(found, lambda x: F.length(x) == 1), lambda x: F.lpad(x, 2, "0"))


def primary_stems(text: Column) -> Column:
    """Words of two characters or more and what is left of them without a particle, then padded days and months."""
    both = F.flatten(F.transform(_words(text), lambda w: F.array_distinct(F.array(w, _stem(w)))))
    # Particles, units and what is padded are syllables; without one the words are all.
    plain = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: F.length(w) > 1)
    return F.when(text.rlike("[가-힣]"), F.concat(both, _padded(text))).otherwise(plain)


def sub_stems(text: Column) -> Column:
    """Pairs of neighbouring syllables of stems that have three or more."""
    pairs = F.flatten(F.transform(F.filter(_words(text), lambda w: w.rlike("[가-힣]")), lambda w: _pairs(_stem(w))))
    return F.when(text.rlike("[가-힣]"), pairs).otherwise(F.array().cast("array<string>"))


def weighted_stems(query: Column, share: float = 0.3) -> Column:
    """Each term of a query with its weight: 1, or a share if it is a pair of syllables alone."""
    first = F.array_distinct(primary_stems(query))
    rest = F.array_except(sub_stems(query), first)
    return F.map_from_entries(F.concat(F.transform(first, lambda t: F.struct(t.alias("key"), F.lit(1.0).alias("value"))), F.transform(rest, lambda t: F.struct(t.alias("key"), F.lit(share).alias("value")))))


def segments(text: Column) -> Column:
    """A text cut into plain runs and [[links]], in order: structs of kind (text or link) and value, without empty runs."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[\[[^\]]+\]\]|(?:(?!\[\[[^\]]+\]\])(?s:.))+"), F.lit(0))
    link = lambda p: p.rlike(r"\A\[\[[^\]]+\]\]\z")
    return F.transform(parts, lambda p: F.struct(F.when(link(p), "link").otherwise("text").alias("kind"), F.when(link(p), F.regexp_replace(p, r"\A\[\[|\]\]\z", "")).otherwise(p).alias("value")))

"""What a question's documents say, put together within a budget of characters: passages, labelled entries, and what still fits.

A context has a handful of candidates (the searches' and walks' limits); its entries meet in one row and are folded in
order there. Contexts are dealt over the cluster by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import strip_frontmatter

#: Characters for a document by its place after the walk (upto place, budget, label), and by hops from the start.
TIERS = ((3, 1500, "Core"), (8, 900, "Related"), (None, 500, "Peripheral"))
HOPS = (1500, 900, 500, 250)
HOP_LABELS = ("Selected", "1-hop", "2-hop", "3-hop")
SECTIONS = "array<struct<heading:string,body:string>>"


def shortened(text: Column, most: Column) -> Column:
    """The text, or its first characters without space at their end and a mark."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(text.substr(F.lit(1), most), r"\s+\z", ""), F.lit("…"))).otherwise(text)


def content(body: Column, sections: Column, terms: Column | None, budget: Column) -> Column:
    """What stands for a document: the section with the most terms, the whole body where that is better.

    sections: structs of heading and body, in order; the first of several with as many terms counts. An introduction's own
    title, and headings that only number slides or pages, count for nothing. The body stands in where there are no terms,
    no section holds one, or the passage is under 200 characters and the body more than three times as long.
    """
    whole = strip_frontmatter(F.coalesce(body, F.lit("")))
    short = shortened(whole, budget)
    if terms is None:
        return short
    trim = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")

    def scored(s: Column, i: Column) -> Column:
        plain = F.when(s["heading"] == "(intro)", trim(F.regexp_replace(s["body"], r"\A#[^\n]*\n?", ""))).otherwise(s["body"])
        heading = F.when(trim(s["heading"]).rlike(r"(?i)^(슬라이드|페이지|slide|page)\s*\d+$"), "").otherwise(s["heading"])
        low = F.lower(F.concat(heading, F.lit(" "), plain))
        title = F.when((s["heading"] == "") | (s["heading"] == "(intro)"), "").otherwise(F.concat(F.lit("### "), s["heading"], F.lit("\n")))
        return F.struct(F.size(F.filter(terms, lambda t: F.contains(low, t))).alias("hits"), (-i).alias("back"), F.concat(title, s["body"]).alias("text"))

    found = F.array_max(F.transform(F.filter(sections, lambda s: trim(s["body"]) != ""), scored))
    weak = (F.length(found["text"]) < 200) & (F.length(whole) > 3 * F.length(found["text"]))
    return F.when(found.isNull() | (found["hits"] <= 0) | weak, short).otherwise(shortened(found["text"], budget))


def tier_budget(place: Column, raw_chars: Column) -> Column:
    """Characters by place (from 1); documents over 10,000 characters get three hundredths of their own, up to twice as many."""
    base = F.lit(TIERS[-1][1])
    for upto, chars, _ in TIERS[-2::-1]:
        base = F.when(place <= upto, chars).otherwise(base)
    return F.when(raw_chars > 10_000, F.least(2 * base, F.greatest(base, F.floor(raw_chars * 0.03).cast("int")))).otherwise(base)


def tier_label(place: Column, seed: Column) -> Column:
    label = F.lit(TIERS[-1][2])
    for upto, _, name in TIERS[-2::-1]:
        label = F.when(place <= upto, name).otherwise(label)
    return F.when(seed, TIERS[0][2]).otherwise(label)


def hop_budget(hops: Column) -> Column:
    out = F.lit(HOPS[-1])
    for k, chars in list(enumerate(HOPS[:-1]))[::-1]:
        out = F.when(hops == k, chars).otherwise(out)
    return out


def hop_label(hops: Column) -> Column:
    out = F.concat(hops.cast("string"), F.lit("-hop"))
    for k, name in list(enumerate(HOP_LABELS))[::-1]:
        out = F.when(hops == k, name).otherwise(out)
    return out


def percent(score: Column) -> Column:
    """A score as per cent with one digit, none if it is 0."""
    return F.regexp_replace(F.round(score * 100, 1).cast("decimal(12,1)").cast("string"), r"\.0$", "")


def header(label: Column, name: Column, speaker: Column, date: Column | None = None, source: Column | None = None, outdated: Column | None = None, kind: Column | None = None) -> Column:
    """[label] flags [kind] name (speaker) [date] [source: ...]; what isn't known is left out."""
    known = lambda c, a, b: F.coalesce(F.when(c != "", F.concat(F.lit(a), c, F.lit(b))), F.lit(""))
    parts = [F.lit("["), label, F.lit("]"), F.when(outdated, " outdated").otherwise("") if outdated is not None else F.lit(""), known(kind, " [", "]") if kind is not None else F.lit("")]
    parts += [F.lit(" "), name, F.when(speaker == "unknown", "").otherwise(known(speaker, " (", ")"))]
    parts += [known(date, " [", "]")] if date is not None else []
    parts += [known(source, " [source: ", "]")] if source is not None else []
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def fitted(entries: DataFrame, key: list[str], total: int, lead: int, skip: bool) -> DataFrame:
    """The entries (key, place, entry and others) that fit into `total` characters after a lead of so many, in order of place.

    An entry that doesn't fit ends the context, or is left out alone (`skip`). Places are unique within a key.
    """
    n = F.coalesce(F.length("entry"), F.lit(0))
    held = entries.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", n.alias("n")))).alias("_e"))

    def step(now: Column, e: Column) -> Column:
        fits = (now["used"] + e["n"] <= total) & ~now["over"]
        return F.struct(
            F.when(fits, now["used"] + e["n"]).otherwise(now["used"]).alias("used"), (now["over"] | (~fits if not skip else F.lit(False))).alias("over"), F.when(fits, F.concat(now["kept"], F.array(e["place"]))).otherwise(now["kept"]).alias("kept"),
        )

    kind = entries.schema["place"].dataType.simpleString()
    start = F.struct(F.lit(lead).alias("used"), F.lit(False).alias("over"), F.array().cast(f"array<{kind}>").alias("kept"))
    kept = held.select(*key, F.explode(F.aggregate("_e", start, step, lambda now: now["kept"])).alias("place"))
    return entries.join(kept, [*key, "place"])


def rendered(entries: DataFrame, key: list[str], lead: str) -> DataFrame:
    """key and context: the lead and the entries in order of place, joined. A context's entries are bounded by its budget."""
    held = entries.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "entry"))).alias("_e"))
    return held.select(*key, F.concat(F.lit(lead), F.array_join(F.transform("_e", lambda e: e["entry"]), "")).alias("context"))


def compressed(results: DataFrame, neighbours: DataFrame, key: list[str], total: int = 3000, first: int = 300, second: int = 200) -> DataFrame:
    """key, role (document or connected), place, header and content: passages of results, then of neighbours, each cut to what is left.

    results, neighbours: key, place, header, content. Neighbours come only while 100 characters are left after the results.
    """
    one = lambda df, role: df.select(*key, F.lit(role).alias("role"), "place", "header", F.coalesce("content", F.lit("")).alias("content"))
    rows = one(results, 0).unionByName(one(neighbours, 1))
    held = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("role", "place", "header", "content"))).alias("_e")).where(F.exists("_e", lambda e: e["role"] == 0))

    def step(now: Column, e: Column) -> Column:
        # The second heading is counted once, when the first neighbour comes; nothing follows a part that doesn't fit.
        turn = (e["role"] == 1) & ~now["second"]
        shut = F.when(turn, now["used"] >= total - 100).otherwise(now["over"] & (e["role"] == now["role"]) | now["shut"])
        used = now["used"] + F.when(turn & ~shut, 12).otherwise(0)
        most = F.least(F.when(e["role"] == 0, first).otherwise(second), total - used - F.length(e["header"]) - 10)
        fits = ~shut & (most > 0)
        text = shortened(e["content"], most)
        return F.struct(
            F.when(fits, used + F.length(e["header"]) + F.length(text) + 2).otherwise(used).alias("used"), (~fits).alias("over"), (now["second"] | turn).alias("second"), (F.when(turn, shut).otherwise(now["shut"])).alias("shut"), e["role"].alias("role"),
            F.when(fits, F.concat(now["kept"], F.array(F.struct(e["role"].alias("role"), e["place"].alias("place"), e["header"].alias("header"), text.alias("content"))))).otherwise(now["kept"]).alias("kept"),
        )

    kind = rows.schema["place"].dataType.simpleString()
    start = F.struct(F.lit(10).alias("used"), F.lit(False).alias("over"), F.lit(False).alias("second"), F.lit(False).alias("shut"), F.lit(0).alias("role"), F.array().cast(f"array<struct<role:int,place:{kind},header:string,content:string>>").alias("kept"))
    kept = held.select(*key, F.explode(F.aggregate("_e", start, step, lambda now: now["kept"])).alias("e"))
    return kept.select(*key, F.when(F.col("e.role") == 0, "document").otherwise("connected").alias("role"), "e.place", "e.header", "e.content")

"""Matches with their places, sections of long texts, and records of line-by-line documents, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line heads of rate schedules, as a regular expression; the flags give \s, \w, ^ and $ the meaning they have for Unicode text with \n as line end.
SCHEDULE_HEAD = r"(?imdU)^\s*RATE\s+SCHEDULE\s+[\w-]+\s*$"
DEFAULT_HEAD = r"(?imdU)^\s*RATE\s+SCHEDULE\s+A-?1\s*$"
#: Least length of a text that is cut into sections, characters of a section that are searched for a name, longest general section, length of a default section without a next head, characters between heads, longest result.
LEAST, SEARCHED, GENERAL, DEFAULT, APART, MOST = 5000, 2000, 5000, 10_000, 100, 45_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<at,hit>>: the matches of a pattern from left to right and the characters before each; matches aren't empty."""
    gaps, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    step = lambda s, h: F.struct((s["at"] + F.length(F.element_at(gaps, F.size(s["out"]) + 1)) + F.length(h)).alias("at"), F.array_append(s["out"], F.struct((s["at"] + F.length(F.element_at(gaps, F.size(s["out"]) + 1))).alias("at"), h.alias("hit"))).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,hit:string>>").alias("out"))
    return F.aggregate(hits, start, step, lambda s: s["out"])


def _ends(text: Column, heads: Column) -> Column:
    """array<struct<at,end>> of the sections from each head to the next."""
    return F.transform(heads, lambda h, k: F.struct(h["at"].alias("at"), F.coalesce(F.get(heads, k + 1)["at"], F.length(text)).alias("end")))


def area_terms(name: Column) -> Column:
    """What names a service area: all after the first " - ", and its words over three letters; empty without one."""
    whole = F.trim(F.regexp_extract(F.lower(name), r"(?s)^.*? - (.*)$", 1))
    words = F.filter(F.split(whole, r"\s+"), lambda w: F.length(w) > 3)
    return F.when(F.contains(name, F.lit(" - ")), F.concat(F.array(whole), words)).otherwise(F.array().cast("array<string>"))


def area_section(text: Column, name: Column) -> Column:
    """The rate schedule of a service area out of a tariff of many areas, with the general one before it; else the default schedule; null if neither is there.

    Sections run from a line "RATE SCHEDULE x" to the next. The first of the sections whose head names the most terms of
    the area wins. Texts under LEAST characters, with fewer than two heads, or for a name without an area give null.
    """
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    note = lambda first, second: F.concat(F.lit(f"[{first}: "), name, F.lit(f"]\n[{second}]\n\n"))

    def of(heads: Column) -> Column:
        terms = area_terms(name)
        scored = F.transform(_ends(text, heads), lambda s: let(F.lower(F.left(piece(s["at"], s["end"]), F.lit(SEARCHED))), lambda head: F.struct(F.size(F.filter(terms, lambda t: head.contains(t))).alias("score"), (-s["at"]).alias("before"), s["end"].alias("end"))))

        def with_best(sections: Column) -> Column:
            best, first = F.array_max(sections), sections[0]
            whole = lambda s: piece(-s["before"], s["end"])
            general = F.when((whole(first) != whole(best)) & (first["end"] + first["before"] < GENERAL), F.concat(whole(first), F.lit("\n\n---\n\n"))).otherwise("")
            return F.when(best["score"] > 0, F.concat(note("Extracted rate schedule section for", "From multi-service-area tariff document"), general, whole(best)))

        plain = F.get(F.filter(heads, lambda h: h["hit"].rlike(DEFAULT_HEAD)), F.lit(0))["at"]
        after = F.get(F.filter(heads, lambda h: h["at"] > plain + APART), F.lit(0))["at"]
        default = F.concat(note("Default rate schedule (A-1) extracted for", "From multi-service-area tariff — no specific area match found"), piece(plain, F.coalesce(after, F.least(plain + DEFAULT, F.length(text)))))
        return F.when((F.size(heads) >= 2) & (F.size(terms) > 0), F.left(F.coalesce(let(scored, with_best), default), F.lit(MOST)))

    return F.when((F.length(text) >= LEAST) & (name != ""), let(matches(text, SCHEDULE_HEAD), of))


def survey_records(text: Column, skipped: list[str], places: list[str]) -> Column:
    """array<struct<name,place,amount>>: records of a text in which each stands over several lines: a name, its place, an amount.

    An automaton over the lines: lines are classed (o: a name or a part of one, c: a place, a: an amount, u: N/A, n: a
    number or mark, s: skipped), and a record is a run of classes. A name may go on for three lines or skip some; its
    place comes within four lines of it, the amount or N/A within ten, and a record may lack it. A name without a place
    is none. An empty text has no record.
    """
    bare = F.array(*[F.lit(p.lower().replace(" ", "").replace(".", "")) for p in places])
    skip = "(?i)^(?:" + "|".join(skipped) + ")"

    def kind(line: Column) -> Column:
        place = F.array_contains(bare, F.regexp_replace(F.lower(line), "[ .]", ""))
        return F.when(place, "c").when(line.rlike(skip), "s").when(line.rlike(r"^\$[\d,]+\.\d{2}$"), "a").when(line == "N/A", "u").when(line.rlike(r"^[\d,]+$") | line.isin("x", "N", "n"), "n").otherwise("o")

    # after the place at the m-th line below the name, lines up to the ninth below it are searched for the amount; a vain search takes one more
    forms = [rf"o[so]{{{m}}}c(?:[^au]{{0,{7 - m}}}[au]|[^au]{{{8 - m}}}.|[^au]*$)" for m in range(4)]

    def of(lines: Column) -> Column:
        def record(m: Column) -> Column:
            own = F.slice(lines, m["at"] + 1, F.length(m["hit"]))
            c = F.instr(m["hit"], "c")
            parts = F.filter(F.transform(F.slice(own, F.lit(1), c - 1), lambda x, k: F.when(F.substring(m["hit"], k + 1, F.lit(1)) == "o", x)), lambda x: x.isNotNull())
            amount = F.when((F.length(m["hit"]) <= 10) & (F.right(m["hit"], F.lit(1)) == "a"), F.regexp_replace(F.element_at(own, -1), "[$,]", "").cast("double"))
            return F.struct(F.regexp_replace(F.array_join(parts, " "), r"\s+", " ").alias("name"), F.element_at(own, c).alias("place"), amount.alias("amount"))

        return F.transform(matches(F.array_join(F.transform(lines, kind), ""), "|".join(forms)), record)

    return let(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), of)

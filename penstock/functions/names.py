"""Entity names: normalising by source, similarity, matching in stages, municipalities, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that one commission's names lose, in order.
COMMISSION_REMOVALS = [
    r"\bPUBLIC\s+SERVICE\s+DISTRICT\b", r"\bP\.?\s*S\.?\s*D\.?\b", r"\bWATER\s+(DEPARTMENT|DEPT|COMPANY|CO|SYSTEM|WORKS|ASSOC|ASSOCIATION|UTILITY|UTILITIES|DIST|DISTRICT)\b", r"\bSEWER\s+(DEPARTMENT|DEPT|COMPANY|CO|SYSTEM|WORKS)\b", r"\bWATER\s+AND\s+SEWER\b",
    r"\bTOWN\s+OF\b", r"\bCITY\s+OF\b", r"\bVILLAGE\s+OF\b", r"\bMUNICIPAL\s+(WATER|UTILITIES|UTILITY)\b", r"\b(INC|LLC|L\.L\.C)\b\.?", r"\bCOMMUNITY\s+(WATER|FACIL|FACILITIES)\b", r"\bIMPROVEMENT\b",
]
#: Patterns and what owners' names get in their place, in order.
OWNER_REPLACEMENTS = [(r"\bCO\.?\b", "COMPANY"), (r"\bCORP\.?\b", "CORPORATION"), (r"\bWTR\b", "WATER"), (r"\bSVC\b", "SERVICE"), (r"\bUTIL(?:S)?\b", "UTILITIES"), (r"\bINC\.?\b", ""), (r"\bLLC\b", ""), (r"\bLTD\b", ""), (r"\s+", " ")]
#: Patterns of companies' names and names of institutions, which are no municipality.
PRIVATE = [
    r"\bVEOLIA\b", r"\bAQUA\s+(AMERICA|UTILITIES|NY|PA|NJ|OH|IL|TX)\b", r"\bLIBERTY\s+UTILITIES\b", r"\bSUEZ\b", r"\bAMERICAN WATER\b", r"\bCAL[- ]AM\b", r"\bCONNECTICUT WATER\b", r"\bSJW\b", r"\bESSENTIAL UTILITIES\b", r"\bUTILITY,?\s+INC\b",
    r"\bCORP(ORATION)?\b", r",?\s+INC\.?\s*$", r",?\s+LLC\.?\s*$",
]
INSTITUTIONS = ["UNIVERSITY", "COLLEGE", "NATIONAL LABORATORY", "NATIONAL LAB", "CORRECTIONAL", "PRISON", "MILITARY", "AIR FORCE", "NAVAL", "U.S.M.A.", "USMA", "FORT DRUM", "WEST POINT", "CAMP ", "BASE ", "CSU MAIN", "CSU CAMPUS", "YMCA ", "HOUSING CAMPUS"]
#: Endings of a system's name, the first that fits goes.
SUFFIXES = [
    "JOINT WATER WORKS", "WATER AND SEWER AUTHORITY", "WATER & SEWER AUTHORITY", "WATER SUPPLY SYSTEM", "WATER SUPPLY DISTRICT", "WATER SUPPLY", "WATER WORKS", "WATER DEPARTMENT", "WATER AUTHORITY", "WATER DISTRICT", "WATER DEPT", "WATER SYSTEM", "WATER UTILITY",
    "WATER SERVICE", "WATER DIST", "CONSOLIDATED WATER DISTRICT", "CONSOLIDATED WD", "CONSOLIDATEDWD", "CONSOLD. WATER DIST.", "CONSOLIDATED W.D.", "CONSOLIDATED W.D", "CONS. W.D.", "CONS. WD", "CONS WD", "CONS. WATER DIST.", "UTILITY DISTRICT", "PUBLIC WATER SUPPLY",
    "CITY WATER WORKS", "CITY PWS", "CITY WATER", "TOWN CONS. WD", "TOWN WD", "PWS", "WSD", "CSA", "WD", "W.D.", "W.D", "CWS", "WSA", "WWWA", "WWSA", "MD NO", "MD",
]
#: Beginnings of a system's name that go.
PREFIXES = ["CITY OF", "TOWN OF", "VILLAGE OF", "BOROUGH OF", "HAMLET OF"]


def normalise(name: Column, removals: list[str] = COMMISSION_REMOVALS) -> Column:
    """Upper case without the source's removals, parentheses and punctuation, single blanks."""
    out = F.upper(name)
    for pattern in removals:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\(.*?\)", ""), r"[^\p{Alnum}_\s]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normalise_owner(name: Column) -> Column:
    """Upper case with abbreviations written out and forms of company left out."""
    out = F.upper(F.trim(name))
    for pattern, word in OWNER_REPLACEMENTS:
        out = F.regexp_replace(out, pattern, word)
    return F.trim(F.regexp_replace(out, "[^A-Z0-9 ]", ""))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Characters of the common words over characters of all words of two normalised names."""
    weight = lambda w: F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x))
    x, y = F.split(a, " "), F.split(b, " ")
    return weight(F.array_intersect(x, y)) / F.nullif(weight(F.array_union(x, y)), F.lit(0))


def similar_names(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(__name, __other, score) of distinct names whose weighted Jaccard similarity is ``least`` or more, with a common word over 3 letters.

    The words of a name are ordered, the rarest first. If two names are similar enough, they share a word of which no
    more than a part of each comes before it, as the words from there on must weigh enough; names meet by that word, their weight and
    what is left from the word on, and only where these can reach ``least``. A word that all names have comes last, where
    only names that are hardly more than the word meet by it.
    """
    bag = lambda df, c: df.filter(F.length(c) > 0).select(c, F.array_distinct(F.split(c, " ")).alias("__w"))
    a, b = bag(left, "__name"), bag(right, "__other")
    often = a.select(F.explode("__w").alias("__g")).unionByName(b.select(F.explode("__w").alias("__g"))).groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))

    def prefix(df: DataFrame, c: str, s: str) -> DataFrame:
        """A row a word of the prefix: the word, the name's weight, the weight from the word on."""
        ordered = df.select(c, F.explode("__w").alias("__g")).join(often, "__g").groupBy(c).agg(F.sort_array(F.collect_list(F.struct("__n", "__g"))).alias("__x"))
        weight = lambda x: F.aggregate(x, F.lit(0), lambda t, w: t + F.length(w["__g"]))
        rows = ordered.select(c, weight(F.col("__x")).alias(f"__t{s}"), F.posexplode("__x").alias("__k", "__y"), "__x")
        rows = rows.withColumn(f"__r{s}", weight(F.slice("__x", F.col("__k") + 1, F.size("__x"))))
        return rows.filter(F.col(f"__r{s}") >= least * F.col(f"__t{s}")).select(c, F.col("__y.__g").alias(f"__g{s}"), f"__t{s}", f"__r{s}")

    x, y = prefix(a, "__name", "a"), prefix(b, "__other", "b")
    # weights are small numbers: few kinds of each word
    kinds = lambda df, s: df.select(f"__g{s}", f"__t{s}", f"__r{s}").distinct()
    reach = (1 + least) * F.least("__ra", "__rb") >= least * (F.col("__ta") + F.col("__tb"))
    may = kinds(x, "a").join(kinds(y, "b"), (F.col("__ga") == F.col("__gb")) & reach)
    met = x.join(may, ["__ga", "__ta", "__ra"]).join(y, ["__gb", "__tb", "__rb"]).select("__name", "__other").distinct()
    long = F.exists(F.array_intersect(F.split("__name", " "), F.split("__other", " ")), lambda w: F.length(w) > 3)
    return met.filter(long).withColumn("score", weighted_jaccard(F.col("__name"), F.col("__other"))).filter(F.col("score") >= least)


def match_names(left: DataFrame, right: DataFrame, *, name: str = "name", other: str = "other", order: str = "order", least: float = 0.5) -> DataFrame:
    """``left`` (id, name) with its best of ``right`` (rid, other, order): exact, else one within the other, else by common words.

    Names are normalised already. Stages are equi-joins: of whole names, of the rarest run of 4 letters of the shorter
    one, and of words by similar_names. Within a stage the higher score wins, then ``order``.
    """
    one = right.groupBy(other).agg(F.min(F.struct(order, "rid")).alias("__o")).select(F.col(other).alias("__other"), F.col(f"__o.{order}").alias("__order"), F.col("__o.rid").alias("rid"))
    names = left.filter(F.length(name) > 0).select("id", F.col(name).alias("__name"))
    pick = lambda df, stage: df.select("id", "rid", F.lit(stage).alias("stage"), "score", "__order")
    exact = pick(names.join(one, F.col("__name") == F.col("__other")).withColumn("score", F.lit(1.0)), 1)
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda k: F.substr(c, k, F.lit(4))))
    a, b = names.filter("length(__name) >= 4"), one.filter("length(__other) >= 4")
    # a name within another: its rarest run of four letters is one of the other's runs
    counted = a.select(F.explode(runs(F.col("__name"))).alias("__g")).unionByName(b.select(F.explode(runs(F.col("__other"))).alias("__g"))).groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    rarest = lambda df, c: df.select(c, F.explode(runs(F.col(c))).alias("__g")).distinct().join(counted, "__g").groupBy(c).agg(F.min_by("__g", F.struct("__n", "__g")).alias("__g")).join(df, c)
    first = rarest(a, "__name").join(b.withColumn("__h", F.explode(runs(F.col("__other")))), (F.col("__g") == F.col("__h")) & F.col("__other").contains(F.col("__name")))
    second = a.withColumn("__h", F.explode(runs(F.col("__name")))).join(rarest(b, "__other"), (F.col("__g") == F.col("__h")) & F.col("__name").contains(F.col("__other")))
    inside = pick(first.select("id", "rid", "__order").union(second.select("id", "rid", "__order")).withColumn("score", F.lit(1.0)), 2)
    common = similar_names(names.select("__name").distinct(), one.select("__other"), least).join(names, "__name").join(one, "__other")
    found = exact.unionByName(inside).unionByName(pick(common, 3))
    best = found.groupBy("id").agg(F.min_by(F.struct("rid", "stage", "score"), F.struct("stage", -F.col("score"), "__order")).alias("__b"))
    method = F.when(F.col("__b").isNull(), "no_match").when(F.col("__b.stage") == 1, "exact").when(F.col("__b.stage") == 2, "substring").otherwise(F.concat(F.lit("word_overlap("), F.format_string("%.2f", F.col("__b.score")), F.lit(")")))
    return left.select("id").join(best, "id", "left").select("id", F.col("__b.rid").alias("rid"), method.alias("method"))


def match_city(city: DataFrame, systems: DataFrame) -> DataFrame:
    """``city`` (id, city, pop) with a system (rid, name, place, pop2, owner) of the name or, failing that, of the place.

    Names are normalised; municipal owners (M, L) come first, then the larger by name, the nearer in size by place.
    """
    s = systems.withColumn("__m", ~F.col("owner").isin("M", "L"))
    by_name = city.join(s, F.col("city") == F.col("name")).withColumn("__s", F.lit(1)).withColumn("__d", -F.col("pop2").cast("double"))
    by_place = city.join(s, F.col("city") == F.col("place")).withColumn("__s", F.lit(2)).withColumn("__d", F.when(F.col("pop") > 0, F.abs(F.col("pop2") - F.col("pop")).cast("double")).otherwise(0.0))
    bare = F.regexp_replace("city", r" (CITY|TWP|TOWNSHIP)$", "")
    stripped = city.filter(bare != F.col("city")).join(s, bare == F.col("place")).withColumn("__s", F.lit(3)).withColumn("__d", -F.col("pop2").cast("double"))
    best = by_name.union(by_place).union(stripped).groupBy("id").agg(F.min_by(F.struct("rid", "__s"), F.struct("__s", "__m", "__d", "rid")).alias("b"))
    stage = F.col("b.__s")
    method = F.when(stage == 1, "name_exact").when(stage == 2, "city_field").when(stage == 3, "city_field_stripped").otherwise("unmatched")
    return city.select("id").join(best, "id", "left").select("id", F.col("b.rid").alias("rid"), method.alias("method"))


def owner_of(name: Column, state: Column, patterns: list[tuple[str, str, dict[str, str]]]) -> Column:
    """struct<parent,url> of the first pattern that the name fits; null without one, or without a URL for the state."""
    out = F.lit(None).cast("struct<parent:string,url:string>")
    for pattern, parent, urls in reversed(patterns):
        url = F.try_element_at(F.create_map(*[F.lit(x) for kv in urls.items() for x in kv]), state)
        out = F.when(name.rlike(pattern), F.when(url.isNotNull(), F.struct(F.lit(parent).alias("parent"), url.alias("url")))).otherwise(out)
    return out


def owners_by_name(systems: DataFrame, subsidiaries: DataFrame) -> DataFrame:
    """``systems`` (id, name, state) with the first subsidiary (rank, sub, parent, sub_state) whose name is in theirs or the other way round.

    The list of subsidiaries is a configuration; a state-scoped join on runs of four letters, no nested loop.
    """
    named = systems.select("id", normalise_owner(F.col("name")).alias("other"), "state")
    subs = subsidiaries.select(F.col("rank"), normalise_owner(F.col("sub")).alias("__s"), "parent", "sub_state")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda k: F.substr(c, k, F.lit(4))))
    a, b = named.filter("length(other) >= 4"), subs.filter("length(__s) >= 4")
    here = F.col("sub_state").isNull() | (F.col("sub_state") == F.col("state"))
    first = a.withColumn("__g", F.left("other", F.lit(4))).join(b.withColumn("__h", F.explode(grams(F.col("__s")))), (F.col("__g") == F.col("__h")) & here & F.col("__s").contains(F.col("other")))
    second = a.withColumn("__g", F.explode(grams(F.col("other")))).join(b.withColumn("__h", F.left("__s", F.lit(4))), (F.col("__g") == F.col("__h")) & here & F.col("other").contains(F.col("__s")))
    both = first.select("id", "rank", "parent").union(second.select("id", "rank", "parent"))
    return both.groupBy("id").agg(F.min_by("parent", "rank").alias("parent"))


def municipality(name: Column) -> Column:
    """The place that a system's name names; null for companies and institutions."""
    from .tariff import let
    from .text import place_title

    quoted = lambda words: "|".join(w.replace(".", r"\.") for w in words)
    bare = lambda s, pattern, by="": F.trim(F.regexp_replace(s, pattern, by))

    def numbers(s: Column) -> Column:
        return bare(bare(bare(bare(s, r"\s*#\s*\d+\s*$"), r"\s+\d+(?:\s*,\s*\d+)+\s*$"), r"\s+NO\s+\d+\s*$"), r"\s*\([^)]*\)\s*", " ")

    def ending(s: Column) -> Column:
        out = F.lit("")
        for suffix in reversed(SUFFIXES):
            out = F.when(s.endswith(suffix), suffix).otherwise(out)
        return let(out, lambda e: F.when(e != "", F.regexp_replace(F.trim(F.left(s, F.length(s) - F.length(e))), r"[,\-. ]+$", "")).otherwise(s))

    def kind(s: Column) -> Column:
        s = bare(bare(s, rf"^({quoted(PREFIXES)})"), r" (CITY AND COUNTY OF|CITY OF|TOWN OF|VILLAGE OF)$")
        for tail in (r" CITY$", r" VILLAGE$", r"(?<=.)\s+V$"):
            s = bare(s, tail)
        return s

    def words(s: Column) -> Column:
        s = bare(s, r"(?<=.{5}) TOWN$")
        for word in ("JOINT", "GREATER", "CONSOLIDATED"):
            s = bare(bare(s, rf" {word}$"), rf"^{word} ")
        return F.trim(F.element_at(F.split(bare(s, r"\s+\d+\s*$"), "/"), 1))

    def spelt(s: Column) -> Column:
        out = s
        for short, long in (("FT", "FORT"), ("MT", "MOUNT"), ("ST", "SAINT"), ("CNTY", "COUNTY")):
            out = F.regexp_replace(out, rf"\b{short}\b", long)
        return out

    def capitals(s: Column) -> Column:
        """A capital for each run of letters, also behind an apostrophe or hyphen."""
        return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("[A-Z]+|[^A-Z]+"), F.lit(0)), lambda w: F.initcap(w)), "")

    def place(upper: Column) -> Column:
        gone = upper.rlike("(?i)" + "|".join(PRIVATE))
        for marker in INSTITUTIONS:
            gone = gone | upper.contains(marker)
        found = let(numbers(upper), lambda a: let(ending(a), lambda b: let(kind(b), lambda c: let(words(c), lambda d: F.when(d.endswith(" COUNTY"), capitals(d)).otherwise(let(spelt(d), lambda e: F.when(F.length(e) >= 2, place_title(e))))))))
        return F.when(~gone, found)

    return let(F.upper(F.trim(name)), place)

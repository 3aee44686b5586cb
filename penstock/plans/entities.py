"""Entity resolution as queries over names made from parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.pages import clean_text
from ..sources.readers import filled_down, html_tables, repaired_json, table, with_context

#: Names of two registers: a system a customer, and a filing a supplier.
SYSTEMS = "select c_custkey rid, case c_custkey % 4 when 0 then 'City of ' else '' end || case c_custkey % 5 when 0 then 'Clear Lake' when 1 then 'Oak' || cast(c_custkey % 30 as {text}) when 2 then 'New Harbor Springs' when 3 then 'Mill Creek Valley' || cast(c_custkey % 7 as {text}) else 'Elm' end || case c_custkey % 3 when 0 then ' Water Dept. (Main)' when 1 then ' P.S.D.' else ' Water Company, Inc.' end nm from {customer}"
FILINGS = "select s_suppkey id, case s_suppkey % 6 when 0 then 'CLEAR LAKE PUBLIC SERVICE DISTRICT' when 1 then 'Oak' || cast(s_suppkey % 40 as {text}) || ' Water System' when 2 then 'Harbor Springs' when 3 then 'Valley Creek East' when 4 then 'Town of Elm Water Works' else 'Nothing Alike' end nm from {supplier}"


def _both(spark, d):
    left = spark.sql(FILINGS.replace("{text}", "string"), supplier=table(spark, d, "supplier")).select("id", N.normalise(F.col("nm")).alias("name"))
    right = spark.sql(SYSTEMS.replace("{text}", "string"), customer=table(spark, d, "customer")).select("rid", N.normalise(F.col("nm")).alias("other"), F.col("rid").alias("order"))
    return left, right


def name_match(spark, d):
    """ER-1, ER-2, JOIN-17, STR-2: filings matched with systems in three stages."""
    return N.match_names(*_both(spark, d))


def city_match(spark, d):
    """ER-3: places matched by name, then by city, then without an ending."""
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.concat(F.lit("PLACE "), F.col("c_custkey") % 60).alias("name"), F.concat(F.lit("TOWN "), F.col("c_custkey") % 90).alias("place"), F.floor(F.abs("c_acctbal")).alias("pop2"), F.when(F.col("c_custkey") % 4 == 0, "M").otherwise("P").alias("owner"))
    k = F.col("s_suppkey")
    c = table(spark, d, "supplier").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("PLACE "), k)).when(k % 3 == 1, F.concat(F.lit("TOWN "), k)).otherwise(F.concat(F.lit("TOWN "), k, F.lit(" TWP"))).alias("city"), F.when(k % 2 == 0, F.lit(3000)).otherwise(0).alias("pop"))
    return N.match_city(c, s)


def owner_map(spark, d):
    """ER-5, JOIN-18, JOIN-19: parents by pattern, else by the name of a subsidiary, counted by state."""
    systems = spark.sql(SYSTEMS.replace("{text}", "string"), customer=table(spark, d, "customer")).select(F.col("rid").alias("id"), F.col("nm").alias("name"), F.when(F.col("rid") % 2 == 0, "WV").otherwise("NY").alias("state"))
    subs = spark.createDataFrame([(1, "Mill Creek Valley3 Wtr", "Great Water", "WV"), (2, "Elm Water Co", "Small Water", None)], "rank int, sub string, parent string, sub_state string")
    patterned = systems.withColumn("o", N.owner_of(F.col("name"), F.col("state"), [("Clear Lake", "Lake Holdings", {"WV": "https://wv", "NY": "https://ny"}), ("Oak1", "Oak Group", {"NY": "https://oak"})]))
    named = N.owners_by_name(patterned.filter("o is null"), subs).withColumnRenamed("parent", "sub_parent")
    out = patterned.join(named, "id", "left").withColumn("parent", F.coalesce("o.parent", "sub_parent"))
    return out.filter("parent is not null").groupBy("parent", "state").agg(F.count(F.lit(1)).alias("n"))


def municipalities(spark, d):
    """STR-13: places of systems' names."""
    c = spark.sql("select c_custkey k, case c_custkey % 8 when 0 then 'TROY CITY PWS' when 1 then 'SUFFOLK COUNTY WATER AUTHORITY' when 2 then 'VEOLIA WATER, INC.' when 3 then 'OAK' || cast(c_custkey as string) || ' TOWN WD #' || cast(c_custkey % 9 as string) when 4 then 'SARANAC LAKE V' when 5 then 'GREATER ELM WATER DISTRICT' when 6 then 'CITY OF FT ST ANNE (MAIN)' else 'ELM COLLEGE' end nm from {customer}", customer=table(spark, d, "customer"))
    return c.select("k", N.municipality(F.col("nm")).alias("place"))


def mended_json(spark, d):
    """TXT-12: objects with notes behind them, without commas, and cut off."""
    k = F.col("c_custkey")
    start = F.concat(F.lit('{"a": '), k.cast("string"))
    text = F.when(k % 4 == 0, F.concat(start, F.lit("} notes {"))).when(k % 4 == 1, F.concat(start, F.lit('\n"b": "x"}'))).when(k % 4 == 2, F.concat(start, F.lit(', "b": "cut'))).otherwise("none")
    c = table(spark, d, "customer").select(k.alias("k"), text.alias("t"))
    return repaired_json(c, "k", "t")


def labelled_lines(spark, d):
    """SRC-11, SRC-16, SRC-17: a label carried down to the lines below it, and the lines before each amount."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 40, F.concat(F.lit("GROUP "), F.col("l_partkey"))).otherwise(F.concat(F.lit("line "), F.col("l_partkey"))).alias("line"))
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("line").alias("line"))
    out = filled_down(with_context(li, ["l_orderkey"], "l_linenumber", "line", 2), F.when(F.col("line").startswith("GROUP"), F.col("line")), ["l_orderkey"], "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "label", F.array_join("context", "; ").alias("context"))


def page_tables(spark, d):
    """SRC-15, TXT-1: rows of a table in a page, and the page's clean text."""
    p = table(spark, d, "pages").select("page_id", F.format_string("<nav>menu here</nav><div class='content'>Rates of page %d<table><tr><th>Use<th>Rate<tr><td>%d gal<td>$1.%02d</table><p>ok<p>$5</div><footer>foot line</footer>", F.col("page_id"), F.col("page_id") * 100, F.col("page_id") % 100).alias("html"))
    rows = html_tables(p, "page_id", "html").filter("row = 1").select("page_id", F.col("cells")[0].alias("use"), F.col("cells")[1].alias("rate"))
    return rows.join(clean_text(p, "page_id", "html"), "page_id")


QUERIES = {f.__name__: f for f in (name_match, city_match, owner_map, municipalities, mended_json, labelled_lines, page_tables)}

_N = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(nm), '\b(PUBLIC\s+SERVICE\s+DISTRICT|P\.?\s*S\.?\s*D\.?\b|WATER\s+(DEPT|COMPANY|SYSTEM|WORKS)|CITY\s+OF|TOWN\s+OF|INC)\b\.?', '', 'g'), '\(.*?\)', '', 'g'), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
ORACLE = {
    "name_match": "with s as (select rid, " + _N + " o from (" + SYSTEMS.format(text="varchar", customer="customer") + ")), f as (select id, " + _N + " n from (" + FILINGS.format(text="varchar", supplier="supplier") + """)), u as (select o, min(rid) rid from s group by 1),
        w as (select *, list_distinct(string_split(n, ' ')) a, list_distinct(string_split(o, ' ')) b from f cross join u where n <> ''), j as (select *, list_sum([length(x) for x in list_intersect(a, b)]) / list_sum([length(x) for x in list_distinct(list_concat(a, b))])::double score, len([x for x in list_intersect(a, b) if length(x) > 3]) big from w),
        c as (select id, rid, case when n = o then 1 when length(n) >= 4 and length(o) >= 4 and (contains(n, o) or contains(o, n)) then 2 when big > 0 and score >= 0.5 then 3 end stage, score from j), b as (select * from c where stage is not null qualify row_number() over (partition by id order by stage, case when stage = 3 then -score else 0 end, rid) = 1)
        select f.id, b.rid, case stage when 1 then 'exact' when 2 then 'substring' when 3 then 'word_overlap(' || format('{:.2f}', score) || ')' else 'no_match' end "method" from f left join b using (id)""",
    "city_match": """with s as (select c_custkey rid, 'PLACE ' || c_custkey % 60 name, 'TOWN ' || c_custkey % 90 place, floor(abs(c_acctbal)) p2, c_custkey % 4 <> 0 m from customer), c as (select s_suppkey id, case s_suppkey % 3 when 0 then 'PLACE ' || s_suppkey when 1 then 'TOWN ' || s_suppkey else 'TOWN ' || s_suppkey || ' TWP' end city, case when s_suppkey % 2 = 0 then 3000 else 0 end pop from supplier),
        j as (select id, rid, m, case when city = name then 1 when city = place then 2 when replace(city, ' TWP', '') = place then 3 end st, case when city = place then case when pop > 0 then abs(p2 - pop) else 0 end else -p2 end dd from c join s on city = name or city = place or replace(city, ' TWP', '') = place), b as (select * from j qualify row_number() over (partition by id order by st, m, dd, rid) = 1)
        select c.id, rid, case st when 1 then 'name_exact' when 2 then 'city_field' when 3 then 'city_field_stripped' else 'unmatched' end "method" from c left join b using (id)""",
    "owner_map": "with s as (select rid id, nm, case when rid % 2 = 0 then 'WV' else 'NY' end state from (" + SYSTEMS.format(text="varchar", customer="customer") + """)), p as (select id, state, case when nm like '%Clear Lake%' then 'Lake Holdings' when nm like '%Oak1%' then case when state = 'NY' then 'Oak Group' end when nm like '%Mill Creek Valley3 Water%' and state = 'WV' then 'Great Water' when nm like '%Elm Water Comp%' then 'Small Water' end parent, nm like '%Oak1%' and state = 'WV' odd from s)
        select parent, state, count(*) n from p where parent is not null group by 1, 2""",
    "municipalities": "select c_custkey k, case c_custkey % 8 when 0 then 'Troy' when 1 then 'Suffolk County' when 3 then 'Oak' || c_custkey when 4 then 'Saranac Lake' when 5 then 'Elm' when 6 then 'Fort Saint Anne' end place from customer",
    "mended_json": """select c_custkey k, case c_custkey % 4 when 0 then '{"a": ' || c_custkey || '}' when 1 then '{"a": ' || c_custkey || ', "b": "x"}' when 2 then '{"a": ' || c_custkey || ', "b": "cut"}' end "json" from customer""",
    "labelled_lines": """with l as (select l_orderkey, l_linenumber, min(case when l_quantity > 40 then 'GROUP ' else 'line ' end || l_partkey) line from lineitem group by 1, 2)
        select l_orderkey, l_linenumber, last_value(case when line like 'GROUP%' then line end ignore nulls) over (partition by l_orderkey order by l_linenumber) "label", array_to_string(list(line) over (partition by l_orderkey order by l_linenumber rows between 2 preceding and current row), '; ') context from l""",
    "page_tables": "select page_id, page_id * 100 || ' gal' \"use\", '$1.' || lpad((page_id % 100)::varchar, 2, '0') rate, 'Rates of page ' || page_id || chr(10) || '| Use | Rate |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id * 100 || ' gal | $1.' || lpad((page_id % 100)::varchar, 2, '0') || ' |' || chr(10) || '$5' \"text\" from pages",
}

"""Sections of tariffs and records of surveys, over documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sections as S
from ..sources.readers import table

#: Tariffs of several areas: heads on lines of their own between parts of a document's text.
TARIFF = """select doc_id k, case doc_id % 5 when 0 then 'AQUA WATER - NORTH HAVEN' when 1 then 'AQUA WATER - LAKEVIEW' when 2 then 'AQUA WATER' when 3 then 'AQUA - X - OLD MILL' else 'AQUA - NOWHERE' end name,
  'TARIFF\n' || case when doc_id % 3 > 0 then ' Rate Schedule A-1 \n' else '\n\nRATE SCHEDULE B-1\n' end || substring(coalesce(text, ''), 1, 1500) || '\nas shown on Rate Schedule O-2 below\n\n RATE  SCHEDULE C-2\nService area: Lakeview\n' || substring(coalesce(text, ''), 1, 4000)
  || '\nRATE SCHEDULE D-3\nLakeview, Haven and North Haven\n' || substring(coalesce(text, ''), 200, 6000) || case when doc_id % 7 > 0 then '\nrate schedule E_4\nOLD MILL\n' || substring(coalesce(text, ''), 1, 30000) else '' end txt from {documents}"""
#: Fixed values of the survey: heads of pages, and places.
HEADS, PLACES = ["Page \\d", "TOTAL", "County$"], ["ALGERIA", "BRAZIL", "SAUDI ARABIA", "UNITED STATES", "ST. PETER"]
#: A survey a customer: each order gives a name and some of a second line, place, number and amount.
SURVEY = """select o_custkey k, o_orderkey o, case o_orderkey % 7 when 0 then 'Page ' || (o_orderkey % 9) when 1 then 'x' else 'Works ' || cast(o_orderkey as {text}) end || '\n' || case when o_orderkey % 3 = 0 then 'of  the Lake\n' when o_orderkey % 11 = 0 then 'TOTAL of all\n' else '' end
  || case o_orderkey % 5 when 0 then 'Algeria' when 1 then 'saudi arabia' when 2 then 'ST PETER' when 3 then 'UNITED STATES' else 'nowhere' end || '\n' || case when o_orderkey % 2 = 0 then '1,204\n' else '' end
  || case o_orderkey % 4 when 0 then 'N/A' when 1 then '$' || cast(o_orderkey % 1000 as {text}) || '.' || lpad(cast(o_custkey % 100 as {text}), 2, '0') when 2 then '$1,000.50' else '' end line from {orders}"""


def tariff_sections(spark, d):
    """TXT-3: the section of a service area out of a tariff of several, with the general one, or the default."""
    t = spark.sql(TARIFF, documents=table(spark, d, "documents")).withColumn("s", S.area_section(F.col("txt"), F.col("name")))
    return t.select("k", F.left("s", F.lit(60)).alias("head"), F.length("s").alias("n"), F.sha2("s", 256).alias("sha"))


def survey_records(spark, d):
    """SRC-16: records of name, place and amount from texts of lines."""
    lines = spark.sql(SURVEY.replace("{text}", "string"), orders=table(spark, d, "orders"))
    texts = lines.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("t"))
    return texts.select("k", F.posexplode(S.survey_records(F.col("t"), HEADS, PLACES)).alias("i", "r")).select("k", "i", "r.name", "r.place", "r.amount")


QUERIES = {f.__name__: f for f in (tariff_sections, survey_records)}

_HEAD = r"(?im)^\s*RATE\s+SCHEDULE\s+[\w-]+\s*$"
ORACLE = {
    "tariff_sections": "with t as (" + TARIFF.replace("{documents}", "documents") + rf"""),
        g as (select *, regexp_extract_all(txt, '{_HEAD}') h, regexp_split_to_array(txt, '{_HEAD}') p from t),
        e as (select k, name, txt, i, h[i] head, sum(length(p[i]) + case when i > 1 then length(h[i - 1]) else 0 end) over (partition by k order by i) a, length(txt) n, len(h) hs from (select *, unnest(range(1, len(h) + 1)) i from g)),
        s as (select *, coalesce(lead(a) over (partition by k order by i), n)::bigint b, case when contains(name, ' - ') then list_prepend(trim(regexp_extract(lower(name), '^.*? - (.*)$', 1)), [w for w in string_split(trim(regexp_extract(lower(name), '^.*? - (.*)$', 1)), ' ') if length(w) > 3]) else [] end terms from e),
        c as (select *, substring(txt, a::bigint + 1, b - a::bigint) sec from s), v as (select *, len([w for w in terms if contains(lower(left(sec, 2000)), w)]) score from c),
        best as (select * from v qualify row_number() over (partition by k order by score desc, i) = 1), one as (select k, sec fsec from v where i = 1),
        a1 as (select k, min(a)::bigint a from v where regexp_matches(head, '(?im)^\s*RATE\s+SCHEDULE\s+A-?1\s*$') group by 1), nx as (select v.k, min(v.a)::bigint b from v join a1 using (k) where v.a > a1.a + 100 group by 1),
        r as (select b.k, case when n < 5000 or hs < 2 or len(terms) = 0 then null when score > 0 then left('[Extracted rate schedule section for: ' || name || ']' || chr(10) || '[From multi-service-area tariff document]' || chr(10) || chr(10) || case when fsec <> sec and length(fsec) < 5000 then fsec || chr(10) || chr(10) || '---' || chr(10) || chr(10) else '' end || sec, 45000)
          when a1.a is not null then left('[Default rate schedule (A-1) extracted for: ' || name || ']' || chr(10) || '[From multi-service-area tariff — no specific area match found]' || chr(10) || chr(10) || substring(txt, a1.a + 1, coalesce(nx.b, least(a1.a + 10000, n)) - a1.a), 45000) end s from best b join one using (k) left join a1 using (k) left join nx using (k))
        select k, left(s, 60) head, length(s)::int n, sha256(s) sha from r""",
    "survey_records": "with recursive s as (" + SURVEY.format(text="varchar", orders="orders") + r"""), t as (select k, [x for x in [trim(y) for y in string_split(string_agg(line, chr(10) order by o), chr(10))] if x <> ''] l from s group by 1),
        c as (select k, l, [case when regexp_replace(lower(x), '[ .]', '', 'g') in ('algeria', 'brazil', 'saudiarabia', 'unitedstates', 'stpeter') then 'c' when regexp_matches(x, '(?i)^(Page \d|TOTAL|County$)') then 's' when regexp_matches(x, '^\$[\d,]+\.\d{2}$') then 'a' when x = 'N/A' then 'u' when regexp_matches(x, '^[\d,]+$') or x in ('x', 'N', 'n') then 'n' else 'o' end for x in l] q from t),
        o as (select k, l, q, i, list_position([x = 'c' for x in q[i + 1:i + 4]], true) c, list_position([x not in ('s', 'o') for x in q[i + 1:i + 4]], true) z from (select *, unnest(range(1, len(l) + 1)) i from c) where q[i] = 'o'),
        r as (select k, l, q, i, i + c p from o where c > 0 and c = z), w as (select *, list_position([x in ('a', 'u') for x in q[p + 1:i + 9]], true) f from r),
        rec as (select k, i, regexp_replace(array_to_string([l[x] for x in range(i, p) if q[x] = 'o'], ' '), '\s+', ' ', 'g') "name", l[p] place, case when f > 0 and q[p + f] = 'a' then regexp_replace(l[p + f], '[$,]', '', 'g')::double end amount, case when f > 0 then p + f + 1 else least(i + 10, len(l) + 1) + 1 end nxt from w),
        walk as (select k, min(i) i from rec group by 1 union all select walk.k, (select min(x.i) from rec x where x.k = walk.k and x.i >= rec.nxt) from walk join rec using (k, i) where (select min(x.i) from rec x where x.k = walk.k and x.i >= rec.nxt) is not null)
        select k, (row_number() over (partition by k order by i) - 1)::int i, "name", place, amount from walk join rec using (k, i)""",
}

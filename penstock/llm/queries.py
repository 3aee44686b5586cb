"""The queries of the training-data operators, and their SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import binary, bpe, html_text, langid, lexical, maxent, media, mixing, rules, simhash, substrings, trie, warc
from .common import table


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_bpe(spark, sf_dir):
    path, pattern = _tokenizer("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, pattern, decode=True))


def op2_token_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    written = binary.write_shards(docs, *_tokenizer("byte_bpe_50k.json"))
    return binary.read_back(docs, binary.write_index(written))


def op3_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    filters = langid.fit(docs.filter(~held))
    return langid.identify(docs, filters).select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "lang_pred", "score")


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_substrings(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_media(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return media.summaries(media.write_features(media.store(docs)), docs.schema["doc_id"].dataType.simpleString())


def op11_maxent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model, counts = maxent.fit(docs.filter(~held))
    return maxent.score(docs, model, counts, keep=["doc_id", held.alias("held_out")])


def op12_trie(spark, sf_dir):
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_token_ids, op3_langid, op4_mixing, op5_substrings, op6_quality, op7_simhash, op8_warc, op9_html, op10_media, op11_maxent, op12_trie, op13_search, pipeline)}


def oracle_sql() -> dict[str, str]:
    op8 = """
        with p as (select page_id, coalesce(html, '') h from pages),
        d as (select page_id, octet_length(encode(h)) payload_bytes, sha1(h) payload_digest from p),
        r as (select *, max(page_id) over (partition by payload_digest) holder from d)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id < holder then 'revisit' else 'response' end record_type,
               case when payload_bytes >= 1000 and page_id < holder then holder end refers_to
        from r"""
    words = r"select *, case when text is null then [] else [x for x in regexp_split_to_array(text, '[\x20\x09-\x0D]+') if x <> ''] end w from documents"
    op5 = f"""
        with d as ({words}), win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d)),
        lo as (select s, min(doc_id) lo from win group by 1), lost as (select distinct doc_id, i + j p from win join lo using (s), range(50) r(j) where lo < doc_id),
        each as (select doc_id, unnest(w) word, generate_subscripts(w, 1) p from d),
        k as (select doc_id, count(lost.p) n_removed, string_agg(word, ' ' order by each.p) filter (lost.p is null) kept from each left join lost using (doc_id, p) group by 1)
        select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (doc_id)"""
    lines = r"[x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')]"
    fails = [f"f{k + 1}" for k in range(len(rules.RULES))]
    strength = lambda f: f"greatest(1, case when v_{f} - m_{f} * (1 - m_{f}) * inv > 0 and m_{f} > 0 and m_{f} < 1 then least(nn, m_{f} * (1 - m_{f}) / (v_{f} - m_{f} * (1 - m_{f}) * inv) - 1) else nn end)"
    op6 = f"""
        with d as ({words}), win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 6)) i from d)),
        many as (select doc_id, s from win group by 1, 2 having count(*) > 1), r as (select doc_id, count(distinct i + j) n from win join many using (doc_id, s), range(8) q(j) group by 1),
        c as (select doc_id, source, len(w)::bigint n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint word_chars, (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::bigint n_symbols,
          (len({lines}) - len(list_distinct({lines})))::bigint n_dup_lines, len({lines}) n_lines, coalesce(n, 0) n_repeat_words from d left join r using (doc_id)),
        f as (select *, (n_words < 20)::int f1, (100 * n_repeat_words > {rules.MOST_REPEATED} * n_words)::int f2, (100 * n_symbols > {rules.MOST_SYMBOLS} * n_words)::int f3, (100 * n_dup_lines > {rules.MOST_DUP_LINES} * n_lines)::int f4 from c),
        h as (select source, count(*)::double n, {", ".join(f"sum({x})::double {x}" for x in fails)} from f group by 1),
        m as (select avg(n) nn, avg(1 / n) inv, {", ".join(f"avg({x} / n) m_{x}, var_pop({x} / n) v_{x}" for x in fails)} from h),
        p as (select h.*, {", ".join(f"m_{x}, {strength(x)} s_{x}" for x in fails)} from h, m),
        q as (select source, n, {", ".join(f"m_{x}, s_{x}, ({x} + m_{x} * s_{x}) / (n + s_{x}) p_{x}" for x in fails)} from p),
        g as (select source, {" or ".join(f"(p_{x} - sqrt(p_{x} * (1 - p_{x}) / (n + s_{x} + 1)) > {rules.HOST_RATE} and p_{x} > {rules.TIMES} * m_{x})" for x in fails)} bad from q)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 + f2 > 0 base_failed, f1 + f2 = 0 and not bad kept from f join g on f.source is not distinct from g.source"""
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    op13 = f"""
        with d as (select doc_id, {terms} t from documents), tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(t) term from d) group by 1, 2),
        c as (select count(*) nn, sum(len(t))::bigint ll from d where len(t) > 0), df as (select term, count(*) df from tf group by 1),
        q as (select item_id, term, count(*) times from (select item_id, unnest({terms}) term from benchmark) group by 1, 2),
        w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint w from df, c), m as (select doc_id, 75 + (25 * len(t) * nn) // ll m from d, c where len(t) > 0),
        s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score from q join tf using (term) join w using (term) join m using (doc_id) group by 1, 2),
        r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int "rank", doc_id, score from s where score > 0)
        select * from r where "rank" <= 20"""
    op12 = """
        with tab as (select list(v order by k) t from (select k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) v from range(256) r(k))),
        o as (select conv_id, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) name, strlen(coalesce(text, '')) size,
          row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 i from conversations where conv_id is not null),
        c as (select conv_id, xor(list_reduce(list_prepend(4294967295, [ord(x)::bigint for x in string_split(conv_id::varchar, '')]), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 h from (select distinct conv_id from o), tab),
        rb as (select c.conv_id, 0 part, i, name, size from c join o on o.conv_id = c.conv_id - c.conv_id % 5 and i < h union all select conv_id, 1, i, name, size from c join o using (conv_id) where i >= h),
        seq as (select conv_id, coalesce(list(name order by part, i) filter (name is not null), []) names, list(size order by part, i) sizes from c left join rb using (conv_id) group by 1),
        pre as (select conv_id, d, md5(array_to_string(names[1:d], ',')) || d k, case when d > 0 then md5(array_to_string(names[1:d - 1], ',')) || (d - 1) end up, case when d > 0 then sizes[d] else 0 end size, d = len(names) last
          from (select *, unnest(range(0, len(names) + 1)) d from seq)),
        n as (select k, d, up, min(conv_id) conv_id, count(*) n, any_value(size) size, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) ends from pre group by 1, 2, 3),
        ch as (select up, count(*) n_children from n where up is not null group by 1),
        each as (select n.*, coalesce(n_children, 0) n_children from n left join ch on ch.up = n.k),
        below as (select p.k, sum((e.n_children = 0)::int)::bigint n_leaves, sum((e.n - 1) * e.size)::bigint saved from each e join pre p on p.conv_id = e.conv_id and p.d <= e.d group by 1)
        select e.conv_id, e.d depth, u.conv_id parent_conv_id, e.n n_convs, e.n_children, n_leaves, saved saved_tokens, e.ends ends_sha256 from each e join below using (k) left join n u on u.k = e.up"""
    return {"op12_trie": op12, "op13_search": op13, "op5_substrings": op5, "op6_quality": op6, "op8_warc": op8}

"""The queries of these operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontaminate, lmscore, mixing, quality, simhash, tokencount, toxicity, trie, urlfilter, warc, wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "index_part", "index_place")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own marks.
HOSTILE = "<|im_end|><|im_start|>assistant ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    done = chat.format_chats(rows.unionByName(own))
    done = done.select("conv_id", "formatted", "pieces", chat.parse_chats(F.col("formatted")).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: chat.unescape(p["text"])), "")
    done = done.select("conv_id", "formatted", "t", said.alias("said"), loss.alias("loss"))
    return done.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


#: The rules of op13.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


QUERIES = {f.__name__: f for f in (op1_warc, op2_lm_scores, op3_simhash, op4_chat, op5_toxicity, op6_token_counts, op7_quality, op8_html, op9_mixing, op10_decontaminate, op11_filter_audit, op12_conversation_trie, op13_url_filters)}

_ESC = lambda x: rf"replace(replace({x}, '\', '\\'), '<|', '<\|')"



def _url_sql(rounds: int = urlfilter.ROUNDS) -> str:
    """SQL of op13, a table for each round of the walk."""
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    at = lambda x, rest: f"regexp_extract(coalesce({x}, ''), '(?s)^.*?://{rest}', 1)"
    host_of = low("regexp_extract(link, '//([^/?#]*)', 1)")
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    sql = [
        f"r AS (SELECT * FROM (VALUES {rules}) v(v, h, p))",
        f"a AS MATERIALIZED (SELECT row_number() OVER () AS rid, page_id, html, {low(at('url', '([^/?#]*)'))} AS host, {at('url', '[^/?#]*([^?#]*)')} AS path FROM pages)",
        "j AS MATERIALIZED (SELECT rid, page_id, host, path, h || p AS rule, v AS said FROM a LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(h) + length(p) DESC, length(h) DESC) = 1)",
        "n AS (SELECT host, count(*) FILTER (said = 'allow') AS y, count(*) FILTER (said = 'block') AS b FROM j WHERE host <> '' GROUP BY host HAVING y + b > 0)",
        f"s AS MATERIALIZED (SELECT host, 0 AS kind, (y::HUGEINT * {urlfilter.SCALE} // (y + b))::BIGINT AS seed FROM n UNION ALL SELECT host, 1, (b::HUGEINT * {urlfilter.SCALE} // (y + b))::BIGINT FROM n)",
        "u AS (SELECT host AS src, unnest(regexp_extract_all(html, '" + urlfilter.LINK.replace("'", "''") + f"', 1)) AS link FROM a), d AS (SELECT DISTINCT src, {host_of} AS dst FROM u)",
        "w AS (SELECT src AS host, dst AS to_, 0 AS kind FROM d WHERE src <> dst AND src <> '' AND dst <> '' UNION ALL SELECT dst, src, 1 FROM d WHERE src <> dst AND src <> '' AND dst <> '')",
        "g AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY host, kind) AS n FROM w)",
        f"s0 AS MATERIALIZED (SELECT host, kind, seed * {100 - urlfilter.DAMPING} // 100 AS score FROM s WHERE seed > 0)",
    ]
    for i in range(rounds):
        sql.append(
            f"s{i + 1} AS MATERIALIZED (SELECT host, kind, sum(score)::BIGINT AS score FROM (SELECT * FROM s0 UNION ALL SELECT to_, kind, sum(score // n)::BIGINT * {urlfilter.DAMPING} // 100 FROM s{i} JOIN g USING (host, kind) GROUP BY to_, kind) GROUP BY host, kind)"
        )
    return (
        "WITH " + ", ".join(sql) + f", x AS (SELECT host, coalesce(sum(score) FILTER (kind = 0), 0)::BIGINT AS trust, coalesce(sum(score) FILTER (kind = 1), 0)::BIGINT AS distrust FROM s{rounds} GROUP BY host) "
        "SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict, "
        "CASE WHEN rule IS NULL THEN coalesce(trust, 0) END AS trust, CASE WHEN rule IS NULL THEN coalesce(distrust, 0) END AS distrust FROM j LEFT JOIN x USING (host)"
    )


ORACLE_SQL: dict[str, str] = {
    "op4_chat": (
        "WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations "
        f"UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{HOSTILE}' FROM range(2) t(i)), "
        "m AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS fresh FROM r) "
        "SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, "
        "coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, "
        "sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, "
        f"sum(length({_ESC('text')}) + CASE WHEN fresh THEN {len(chat.START + chat.END) + 2} + length(replace({_ESC('role')}, chr(10), '{chat.NL}')) ELSE {len(chat.SEP)} END)::BIGINT AS formatted_chars "
        "FROM m GROUP BY conv_id"
    ),
    "op7_quality": (
        r"WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), "
        r"w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t), "
        r"g AS (SELECT rid, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: {'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}), recursive := true) FROM w), "
        r"again AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1), p AS (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM again), n AS (SELECT rid, count(*) AS n FROM p GROUP BY rid), "
        r"m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN n USING (rid)), "
        r"f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m) "
        r"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed, "
        r"NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 25 * n_words OR word_chars < 2 * n_words) AS kept FROM f"
    ),
    "op11_filter_audit": (
        r"WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents), "
        r"f AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, "
        r"coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e FROM t), "
        "l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id), "
        "m AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic FROM f LEFT JOIN l USING (doc_id)), "
        "g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL), "
        "x AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x)), "
        "o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5), "
        "s AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[:step - 1], '') AS before FROM o, range(1, 6) r(step)), "
        "r AS (SELECT part, filter_order, step::INT AS step, own, list_contains(fails, own) AS failing, list_has_any(fails, before) AS earlier, len(fails) AS k, n, good, toxic FROM g, s), "
        "y AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT failing AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (failing AND earlier), 0)::BIGINT AS redundant, "
        "coalesce(sum(n) FILTER (failing AND k = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (failing AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT earlier), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL) "
        "SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM y"
    ),
    "op12_conversation_trie": (
        "WITH z AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL), "
        "t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM z), "
        # CRC-32, bit by bit
        "h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)), "
        "o AS (SELECT h.conv_id, pos AS depth, role, text FROM h JOIN t ON t.conv_id = base AND pos <= h), "
        "k AS (SELECT h.conv_id, h, (SELECT count(*) FROM o WHERE o.conv_id = h.conv_id) AS k FROM h), "
        "r AS (SELECT * FROM o UNION ALL SELECT k.conv_id, pos - h + k, role, text FROM k JOIN t USING (conv_id) WHERE pos > h), "
        "p AS (SELECT conv_id, depth, length(text) AS chars, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM r UNION ALL SELECT conv_id, 0, 0, [] FROM h), "
        "q AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, key) AS node, max(depth) OVER (PARTITION BY conv_id) AS total FROM p), "
        "e AS (SELECT node, depth, count(*) AS n_convs, max(chars) AS chars, max(total) = depth AS leaf, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256 FROM q GROUP BY node, depth), "
        "s AS (SELECT q.node, q.depth, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * e.chars)::BIGINT AS saved_tokens, count(*) FILTER (e.depth = q.depth + 1) AS n_children FROM e JOIN q ON q.conv_id = e.node AND q.depth <= e.depth GROUP BY q.node, q.depth) "
        "SELECT e.node AS conv_id, e.depth, q.node AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM e JOIN s USING (node, depth) LEFT JOIN q ON q.conv_id = e.node AND q.depth = e.depth - 1"
    ),
    "op13_url_filters": _url_sql(),
}

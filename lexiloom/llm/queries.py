"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.pii import pseudonymise

    return pseudonymise(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents"))


def op7_sql() -> str:
    """The fit as a recursion over one row of factor lists, one marginal a step."""
    from lexiloom.llm import mixing as x

    def numbers(d: str) -> str:
        return f"n_{d} AS (SELECT {d}, CAST(row_number() OVER (ORDER BY {d}) AS INT) AS i_{d} FROM (SELECT DISTINCT {d} FROM cells))"

    def lists(d: str) -> str:
        return f"""g_{d} AS (SELECT list(g ORDER BY i_{d}) AS by_{d}, list(pow(own / (SELECT a FROM tot), {x.TEMPER[d]}) ORDER BY i_{d}) AS raw_{d}
            FROM (SELECT i_{d}, sum(m) AS own, list({{'s': i_source, 'l': i_lang, 't': i_topic, 'm': m}} ORDER BY i_source, i_lang, i_topic) AS g FROM num GROUP BY i_{d}))"""

    short = {"source": "s", "lang": "l", "topic": "t"}

    def step(d: str) -> str:
        others = " * ".join(f"f_{o}[c.{short[o]}]" for o in x.DIMS if o != d)
        return f"list_transform(range(1, len(by_{d}) + 1), lambda k: a * raw_{d}[k] / list_sum(raw_{d}) / list_sum(list_transform(by_{d}[k], lambda c: c.m * {others})))"

    factor = ", ".join(f"CASE WHEN i % 3 = {k} THEN {step(d)} ELSE f_{d} END" for k, d in enumerate(x.DIMS))
    ones = ", ".join(f"list_transform(by_{d}, lambda g: 1.0::DOUBLE) AS f_{d}" for d in x.DIMS)
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS x FROM documents),
u AS (SELECT doc_id, source, lang, x, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM t),
d AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(x, ' | ') THEN 'table' WHEN contains(x, 'Licensed under') THEN 'licensed'
    WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM u),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS m FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
tot AS MATERIALIZED (SELECT sum(m) AS a FROM cells),
{", ".join(numbers(d) for d in x.DIMS)},
num AS (SELECT * FROM cells JOIN n_source USING (source) JOIN n_lang USING (lang) JOIN n_topic USING (topic)),
{", ".join(lists(d) for d in x.DIMS)},
fit AS (SELECT 0 AS i, (SELECT a FROM tot) AS a, by_source, by_lang, by_topic, raw_source, raw_lang, raw_topic, {ones} FROM g_source, g_lang, g_topic
    UNION ALL SELECT i + 1, a, by_source, by_lang, by_topic, raw_source, raw_lang, raw_topic, {factor} FROM fit WHERE i < {3 * x.ROUNDS}),
w AS (SELECT source, lang, topic, m, f_source[i_source] * f_lang[i_lang] * f_topic[i_topic] AS w FROM num, fit WHERE i = {3 * x.ROUNDS}),
p AS (SELECT list({{'m': m, 'w': w}}) AS c FROM w),
sc AS (SELECT 0 AS i, (SELECT a FROM tot) AS a, {x.KEEP}::DOUBLE AS x, c FROM p UNION ALL
    SELECT i + 1, a, greatest(x, coalesce(({x.KEEP} * a - coalesce(list_sum(list_transform(c, lambda y: CASE WHEN x * y.w >= 1 THEN y.m ELSE 0 END)), 0))
        / nullif(list_sum(list_transform(c, lambda y: CASE WHEN x * y.w < 1 THEN y.m * y.w ELSE 0 END)), 0), x)), c FROM sc WHERE i < {x.SCALE_ROUNDS}),
r AS (SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(w, 1.0), 6) AS weight, round(coalesce(least(1.0, w * (SELECT x FROM sc WHERE i = {x.SCALE_ROUNDS})), 1.0), 6) AS probability
    FROM d LEFT JOIN w USING (source, lang, topic))
SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < probability AS sampled FROM r
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.bpe import round_trip

    return round_trip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.media import media_digests

    return media_digests(read(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.lm import lm_scores

    return lm_scores(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(read(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.quality import fit, score

    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.warc import read_archives, write_archives

    return read_archives(write_archives(read(spark, sf_dir, "pages")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.packing import packed_documents

    return packed_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.merkle import document_manifest

    return document_manifest(read(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiloom.llm.spelling import spelling_variants

    return spelling_variants(read(spark, sf_dir, "documents"))


#: Base 32 of a SHA-1 digest, five hexadecimal digits (four base-32 letters) at a time.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT page_id, payload_bytes, x, list_aggregate(list_transform(range(0, 8), lambda i:
    list_aggregate(list_transform([32768, 1024, 32, 1], lambda q:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, CAST(i * 5 + 1 AS INT), 5))::BIGINT // q) % 32 + 1)::INT, 1)), 'string_agg', '')
    ), 'string_agg', '') AS payload_digest FROM d),
g AS (SELECT x, payload_bytes, max(page_id) AS response FROM d GROUP BY x, payload_bytes)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM b JOIN g USING (x, payload_bytes)
"""


#: CRC-32 by its table, as SQL over lists: ``crc`` holds the table, ``_crc`` is the checksum of a text below U+0100.
_CRC = """crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc(text: str) -> str:
    utf8 = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] END))"
    return f"xor(list_reduce({utf8}, lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]), 4294967295), 4294967295)"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')" for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Level by level, one row for each node; a path is the nodes beside those above a leaf.
OP12_SQL = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, coalesce(CASE WHEN {_crc("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("n_chars + 1")} END, {_leaf("n_chars")}) AS tampered FROM documents, crc),
a AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (SELECT lang, 0 AS level, pos, leaf AS node, n FROM a
    UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, level, pos // 2),
sub AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, pos, subroot AS node, n FROM sub
    UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2),
walk AS (SELECT a.doc_id, a.leaf, a.tampered, s.subroot, u.level, (a.pos >> u.level) & 1 AS side, x.node AS sibling
    FROM a JOIN sub s ON a.lang IS NOT DISTINCT FROM s.lang JOIN up u ON u.lang IS NOT DISTINCT FROM a.lang AND u.pos = a.pos >> u.level AND u.n > 1
        LEFT JOIN up x ON x.lang IS NOT DISTINCT FROM a.lang AND x.level = u.level AND x.pos = xor(u.pos, 1)
    UNION ALL SELECT a.doc_id, a.leaf, a.tampered, s.subroot, 1000 + u.level, (s.pos >> u.level) & 1, x.node
    FROM a JOIN sub s ON a.lang IS NOT DISTINCT FROM s.lang JOIN top u ON u.pos = s.pos >> u.level AND u.n > 1 LEFT JOIN top x ON x.level = u.level AND x.pos = xor(u.pos, 1)
    UNION ALL SELECT a.doc_id, a.leaf, a.tampered, s.subroot, -1, 2, '' FROM a JOIN sub s ON a.lang IS NOT DISTINCT FROM s.lang),
p AS (SELECT doc_id, leaf, tampered, subroot, list({{'side': side, 'sibling': coalesce(sibling, '')}} ORDER BY level) AS path FROM walk GROUP BY ALL),
r AS (SELECT doc_id, leaf, subroot, (SELECT node FROM top WHERE n = 1) AS root, sha256(list_aggregate(list_transform(path, lambda x: x.sibling), 'string_agg', '')) AS proof_sha256,
    list_reduce(path, lambda acc, x: {{'side': 0::BIGINT, 'sibling': CASE WHEN x.side = 2 THEN acc.sibling WHEN x.side = 1 THEN sha256(x.sibling || acc.sibling) ELSE sha256(acc.sibling || x.sibling) END}}, {{'side': 0::BIGINT, 'sibling': tampered}}).sibling AS folded_root FROM p)
SELECT *, folded_root = root AS verified FROM r
"""

#: Near words by places left out: two words that are equal but for a place, and a word that another is without a place.
OP13_SQL = f"""
WITH RECURSIVE {_CRC},
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)) WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, k, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r, crc),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
o AS MATERIALIZED (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest, substr(word, i, 1) AS ch FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
e AS (SELECT a.word AS a, b.word AS b FROM o a JOIN o b ON a.rest = b.rest AND a.i = b.i AND a.ch <> b.ch
    UNION SELECT o.word, v.word FROM o JOIN v ON v.word = o.rest UNION SELECT v.word, o.word FROM o JOIN v ON v.word = o.rest),
m AS (SELECT e.a AS word, count(*) AS n_near, min({{'m': -x.n, 'w': x.word}}) AS best FROM e JOIN v x ON x.word = e.b GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * v.n THEN best.w END AS form, CASE WHEN -best.m >= 5 * v.n THEN -best.m END AS form_n FROM v LEFT JOIN m USING (word)),
w AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word JOIN f z ON z.word = w.at WHERE z.form IS NULL
"""


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_simhash": op2_simhash,
        "op3_media": op3_media,
        "op4_lm_scores": op4_lm_scores,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_pii": op6_pii,
        "op7_mixing": op7_mixing,
        "op8_bpe": op8_bpe,
        "op9_quality": op9_quality,
        "op10_warc": op10_warc,
        "op11_packing": op11_packing,
        "op12_merkle": op12_merkle,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op7_mixing": op7_sql(), "op10_warc": OP10_SQL, "op12_merkle": OP12_SQL, "op13_spelling": OP13_SQL}

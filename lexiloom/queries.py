"""Queries of the phrase index and the pattern search over the test tables, with the SQL that must give the same."""

from __future__ import annotations

import string
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import session
from lexiloom.functions import markup
from lexiloom.functions import text as T
from lexiloom.operators import exact
from lexiloom.operators import index as I
from lexiloom.operators import search as S
from lexiloom.plans.pattern import Matcher
from lexiloom.sources import readers as R

CUTOFF = 5
Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.attach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return R.lines_of(session.dealt(_table(spark, sf_dir, "documents")), "text", *keep)


def _streamed_lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """As ``_lines``, for tasks that hold a part of their texts at once: large tables are not dealt anew."""
    return R.lines_of(session.spread(_table(spark, sf_dir, "documents")), "text", *keep)


def _stamp(spark: SparkSession, path: str) -> str:
    """Tells versions of a table apart: by place, size and time of change."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{zlib.crc32(path.encode()):08x}-{fs.getContentSummary(at).getLength()}-{fs.getFileStatus(at).getModificationTime()}"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of ``documents``, built once per session and table as any search engine's is; it goes when the program ends."""
    path = f"{session.shared_dir(spark)}/index-{_stamp(spark, f'{sf_dir}/documents.parquet')}-{spark.sparkContext.applicationId}"
    if not session.exists(spark, path):
        R.save_index_rounds(I.index_rounds(_lines(spark, sf_dir), CUTOFF), path)
        session.remove_at_end(spark, path)
    session.attach(spark)
    return R.load_index(spark, path)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{session.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# SQL views: L lines, K chain counts, P prefix counts, I the pruned index, X its terminals.
_NORM = "ltrim(lower(regexp_replace(replace(line || chr(10), '''', ''), '[^A-Za-z0-9]+', ' ', 'g')))"
_L = "L AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"
_CHAINS = """list_transform(flatten(list_transform(list_filter(range(1, length(t) + 1), lambda i: i = 1 OR substr(t, i - 1, 1) = ' '),
    lambda s: range(s, s + length(split_part(substr(t, s), ' ', 1)), 40))), lambda s: substr(t, s, 40))"""
_PREFIXES = "list_transform(list_filter(range(1, length(chain) + 1), lambda i: substr(chain, i, 1) = ' '), lambda i: substr(chain, 1, i))"
_K = f"K AS (SELECT chain, count(*) AS n FROM (SELECT unnest({_CHAINS}) AS chain FROM (SELECT {_NORM} AS t FROM L) WHERE t <> '') GROUP BY chain)"
_P = f"P AS (SELECT text, sum(n)::BIGINT AS c FROM (SELECT unnest({_PREFIXES}) AS text, n FROM K) GROUP BY text)"
_I = f"I AS MATERIALIZED (SELECT text, c FROM P WHERE c >= {CUTOFF})"
_X = """X AS MATERIALIZED (SELECT I.text, (I.c - coalesce(b.s, 0))::BIGINT AS n FROM I LEFT JOIN
    (SELECT regexp_replace(text, '[^ ]+ $', '') AS text, sum(c) AS s FROM I GROUP BY 1) b ON b.text = I.text WHERE I.c > coalesce(b.s, 0))"""
_BASE = f"WITH {_L}, {_K}, {_P}, {_I}, {_X} "
_BARE = "replace(text, ' ', '')"
_FRAMING = """WITH F AS (SELECT doc_id AS file, CASE WHEN doc_id % 2 = 0 THEN 'BEGIN ARTICLE: doc ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || 'END ARTICLE: doc'
        ELSE '<doc id=' || doc_id || '>' || chr(10) || coalesce(text, '') || chr(10) || '</doc>' END AS t FROM documents),
    A AS (SELECT file, string_split(t, chr(10)) AS a FROM F),
    N AS (SELECT file, unnest(a) AS line, unnest(range(0, len(a))) AS line_no FROM A),
    T AS (SELECT *, starts_with(line, 'BEGIN ARTICLE:') OR coalesce(starts_with(lag(line) OVER (PARTITION BY file ORDER BY line_no), '<doc '), false) AS is_title FROM N),
    G AS (SELECT file, line_no, CASE WHEN starts_with(line, 'BEGIN ARTICLE:') THEN substr(line, 15) ELSE line END AS line, is_title, CASE WHEN is_title THEN 10 ELSE 1 END::BIGINT AS weight
    FROM T WHERE NOT starts_with(line, 'END ARTICLE:') AND NOT starts_with(line, '<doc ') AND (is_title OR NOT starts_with(line, '</doc>'))) """


def _spliced(words: str, free: str, more: str, whole: str) -> str:
    """All ways to join the phrases of ``words`` (text, c, use), by the best."""
    return f"""WITH RECURSIVE {_L}, {_K}, {_P}, {_I}, N AS (SELECT sum(c)::DOUBLE AS n FROM I WHERE instr(text, ' ') = length(text)), W AS MATERIALIZED ({words}),
        R AS (SELECT text, use, c::DOUBLE AS score FROM W UNION ALL
            SELECT r.text || w.text, {more}, r.score / n * 0.000001::DOUBLE * w.c FROM R r JOIN W w ON {free}, N)
        SELECT max(score) AS score, rtrim(text) AS text FROM R WHERE {whole} GROUP BY text"""


def _spliced_letters(letters: str) -> str:
    """For letters that are all different: a phrase uses each at most once, and two that are joined share none."""
    use = " + ".join(f"(CASE WHEN contains(text, '{c}') THEN {1 << i} ELSE 0 END)" for i, c in enumerate(letters))
    once = " AND ".join(f"length(text) - length(replace(text, '{c}', '')) <= 1" for c in letters)
    return _spliced(f"SELECT text, c, {use} AS use FROM I WHERE regexp_matches(text, '^[{letters} ]+$') AND {once}", "(r.use & w.use) = 0", "r.use | w.use", f"use = {(1 << len(letters)) - 1}")


def _spliced_digits(digits: str) -> str:
    key = "translate(replace(text, ' ', ''), 'abcdefghijklmnopqrstuvwxyz', '22233344455566677778889999')"
    return _spliced(f"SELECT text, c, {key} AS use FROM I WHERE contains('{digits}', {key})", f"starts_with('{digits}', r.use || w.use)", "r.use || w.use", f"use = '{digits}'")


def _found(where: str) -> str:
    return f"{_BASE} SELECT c::DOUBLE AS score, rtrim(text) AS text FROM I WHERE {where} ORDER BY score DESC, text"


#: name: (query, SQL condition on the index's text)
FIND = {
    "find_literal": ('"the"', "text = 'the '"),
    "find_unquoted_literal": ("thin", f"{_BARE} = 'thin'"),
    "find_prefix": ("the_*", f"regexp_matches({_BARE}, '^the[0-9a-z]*$')"),
    "find_suffix": ("_*est", f"regexp_matches({_BARE}, '^[0-9a-z]*est$')"),
    "find_quoted": ('"CVCVC"', "regexp_matches(text, '^[b-df-hj-np-tv-z][aeiou][b-df-hj-np-tv-z][aeiou][b-df-hj-np-tv-z] $')"),
    "find_unquoted_spaces": ("CVCVCV", f"regexp_matches({_BARE}, '^([b-df-hj-np-tv-z][aeiou]){{3}}$')"),
    "find_classes": ('"[^aeiou ]V[a-fr-t][#A]_{1,4}"', "regexp_matches(text, '^[0-9b-df-hj-np-tv-z][aeiou][a-fr-t][0-9a-z][0-9a-z]{1,4} $')"),
    "find_any": ('"the .{3}"', "regexp_matches(text, '^the [0-9a-z ]{3} $')"),
    "find_alternation": ('"(of|to|in) (the|and|a)"', "regexp_matches(text, '^(of|to|in) (the|and|a) $')"),
    "find_counted": ('"(th){2,3}_{0,2}|V{2}C{3}"', "regexp_matches(text, '^((th){2,3}[0-9a-z]{0,2}|[aeiou]{2}[b-df-hj-np-tv-z]{3}) $')"),
    "find_optional_space": ('"of-the-_*"', "regexp_matches(text, '^of ?the ?[0-9a-z]* $')"),
    "find_intersection": ('"_*a_*&_*b_*&_{5,}"', "regexp_matches(text, '^[0-9a-z]{5,} $') AND contains(text, 'a') AND contains(text, 'b')"),
    "find_letterbank": ("[aehnrt]*&_*a_*&_*e_*&_*t_*", f"regexp_matches({_BARE}, '^[aehnrt]+$') AND contains(text, 'a') AND contains(text, 'e') AND contains(text, 't')"),
    "find_nested_intersection": ("(t?h?e?&__)(_{3})", f"regexp_matches({_BARE}, '^(th|te|he)[0-9a-z]{{3}}$')"),
    "find_anagram_letters": ("<aeht>", f"list_aggregate(list_sort(string_split({_BARE}, '')), 'string_agg', '') = 'aeht'"),
    "find_anagram_chunks": ("<(th)(er)_>", f"regexp_matches({_BARE}, '^(ther[0-9a-z]|th[0-9a-z]er|erth[0-9a-z]|er[0-9a-z]th|[0-9a-z]ther|[0-9a-z]erth)$')"),
    # Parts that overlap stand in for each other: "ana" and "nan" are no true anagrams of these, but match part by part.
    "find_anagram_overlap": ("<(a)(n)(an)>", " AND ".join(f"regexp_matches({_BARE}, '^{x}$')" for x in ("(a|n|an){3}", "(n|an)*a(n|an)*", "(a|an)*n(a|an)*", "(a|n)*an(a|n)*"))),
    # Equal parts are counted together however they are written, and what repeats nothing matches nothing.
    "find_anagram_equal": ("<t(t|t)ha>", f"list_aggregate(list_sort(string_split({_BARE}, '')), 'string_agg', '') = 'ahtt'"),
    "find_empty_star": ('"(t?)*he(r*)*"', "regexp_matches(text, '^t*her* $')"),
    "find_anagram_ordered": ("<eth>&_*t_*h_*", f"{_BARE} IN ('the', 'teh', 'eth')"),
}


def _find(query: str) -> Query:
    return lambda spark, d: S.find(_index(spark, d), query)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to the most frequent phrases that start with "the", in one plan of native operators."""
    session.attach(spark)
    return S.find(I.build_index(_lines(spark, sf_dir), 2), '"the( _+)*"')


def normalize_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, "doc_id").select("doc_id", T.normalize(F.col("line")).alias("norm"))


def chain_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.chain_counts(_streamed_lines(spark, d))


def prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.prefix_counts(I.chain_rows(_lines(spark, d)), CUTOFF)


def prune_terminals(spark: SparkSession, d: str) -> DataFrame:
    return I.terminals(_index(spark, d).select("text", "c"))


def index_columns(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).select("text", "c", "first_ch", "n_words", "n_letters", "parent", "letters_key", "phone_key")


def corpus_total(spark: SparkSession, d: str) -> DataFrame:
    return I.corpus_total(_index(spark, d))


def merge_shards(spark: SparkSession, d: str) -> DataFrame:
    shards = [I.chain_rows(R.lines_of(session.dealt(_table(spark, d, t)))) for t in ("documents", "benchmark", "conversations")]
    return I.merge(shards, CUTOFF)


def merge_two_stage(spark: SparkSession, d: str) -> DataFrame:
    lines = _streamed_lines(spark, d, "source").select(F.coalesce("source", F.lit("")).alias("g"), "line")
    return I.merge_two_stage_lines(lines, "g", 2, CUTOFF)


def title_boost(spark: SparkSession, d: str) -> DataFrame:
    docs = session.dealt(_table(spark, d, "documents")).select(F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    weight = F.when(F.col("i") == 0, R.TITLE_WEIGHT).otherwise(1)
    return I.prefix_counts(I.chain_rows(docs, weight=weight), 20)


def _framed(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    plain = F.concat(F.lit("BEGIN ARTICLE: doc "), F.col("doc_id"), F.lit("\n"), text, F.lit("\nEND ARTICLE: doc"))
    block = F.concat(F.lit("<doc id="), F.col("doc_id"), F.lit(">\n"), text, F.lit("\n</doc>"))
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 2 == 0, plain).otherwise(block).alias("t"))
    return docs.select("file", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))


def framing(spark: SparkSession, d: str) -> DataFrame:
    return R.frame_articles(_framed(spark, d)).select("file", F.col("line_no").cast("long"), "line", "is_title", F.col("weight").cast("long"))


def dump_index(spark: SparkSession, d: str) -> DataFrame:
    return I.dump(_index(spark, d).select("text", "c"))


def explore_prefix(spark: SparkSession, d: str) -> DataFrame:
    return I.explore(_index(spark, d).select("text", "c"), "th", 4)


def children_range(spark: SparkSession, d: str) -> DataFrame:
    return I.children(_index(spark, d).select("text", "c"), "th", "a", "m")


def anagrams(spark: SparkSession, d: str) -> DataFrame:
    return S.find_anagrams(_index(spark, d), "teha")


def phone_words(spark: SparkSession, d: str) -> DataFrame:
    return S.find_phone_words(_index(spark, d), "843")


TWO = '"(the|of|to) (the|of|and)"'


def splice_two(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return S.splice(index, Matcher("pattern", TWO), I.corpus_total(index).first()[0], limit=None)


def splice_n(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return S.splice(index, Matcher("pattern", "<thandof>"), I.corpus_total(index).first()[0], limit=None)


def splice_anagram(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return S.splice(index, Matcher("anagram", "ofthe"), I.corpus_total(index).first()[0])


def splice_phone(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return S.splice(index, Matcher("phone", "63843"), I.corpus_total(index).first()[0])


def splice_quirk(spark: SparkSession, d: str) -> DataFrame:
    """A word that is accepted is not extended, so of the longer texts only those come that are phrases themselves."""
    index = _index(spark, d)
    return S.splice(index, Matcher("pattern", '"(the|of)( (the|of))?"'), I.corpus_total(index).first()[0])


def search_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How searches end: with more to come, complete, with nothing, at their budget, or at a query that is none."""
    index = _index(spark, d)
    n_total = I.corpus_total(index).first()[0]
    pages = [(q, S.search_page(index, q)) for q in ("the_*", '"the"', "zzzz", "the**", "<the", "THE", "[a-", "a{9,3}")]
    pages.append(("spliced", S.search_page(index, '"the( the)*x"', n_total=n_total, budget=1)))
    rows = [(q, p.outcome, p.rows.count() if p.rows is not None else 0, p.next_start, p.next_budget, p.message) for q, p in pages]
    return spark.createDataFrame(rows, "query string, outcome string, n long, next_start long, next_budget long, message string")


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _table(spark, d, "documents").select("doc_id", T.html_escape(text).alias("escaped"), T.url_quote(text).alias("quoted"))


def search_page(spark: SparkSession, d: str) -> DataFrame:
    page = S.search_page(_index(spark, d), "the_*", 20, 20)
    return page.rows.select("score", "text", F.round("font_size", 6).alias("font_size"))


def result_lines(spark: SparkSession, d: str) -> DataFrame:
    found = S.find(_index(spark, d), "the_*")
    return found.select(R.result_lines(found).alias("line"))


def _html(rule) -> Query:
    return lambda spark, d: session.spread(_table(spark, d, "pages")).select("page_id", rule(F.coalesce("html", F.lit(""))).alias("text"))


#: Markup around three words of a text, and what is left of it.
_THREE = "([a-z]+) ([a-z]+) ([a-z]+) "
_WIKI = (
    r"<!-- \1 --><ref name=n>\2</ref>[[File:\1|x [[\2]] y]]{{t|{{\3}}}}{| \1 | \2 |}<b class=c>\1</b> [[\2|\3]] &nbsp;[http://x.org/\1 \2] [[\3]] <gallery>\1</gallery><br/>",
    r" \1  \2   \2 \3  ",
)
_LINKED = r"[[\1|\2|\3]] [http://x.org/\1 \2 \3] [ftp://y.org/\1] [[\2]] [https://z.org] [x] "


_BARRED, _FIRST, _LAST = r"[[\1|\2|\3]]", r"\1", r"\3"
_ADDRESSES = (r"[http://x.org/\1 \2 \3] [ftp://y.org/\1]", r" \2 \3 ")


def _wiki(spark: SparkSession, d: str, around: str) -> DataFrame:
    """All documents with markup put around their words; what they have of its characters goes first."""
    plain = F.translate(F.coalesce("text", F.lit("")), "<>&[]{}|#", "")
    return session.spread(_table(spark, d, "documents")).select("doc_id", F.regexp_replace(plain, _THREE, around.replace("\\", "$")).alias("text"))


def _wiki_sql(around: str) -> str:
    plain = "translate(coalesce(text, ''), '<>&[]{}|#', '')"
    return f"W AS (SELECT doc_id, regexp_replace({plain}, '{_THREE}', '{around}', 'g') AS text FROM documents)"


def strip_wiki_links(spark: SparkSession, d: str) -> DataFrame:
    return _wiki(spark, d, _LINKED).select("doc_id", markup.strip_wiki_links(F.col("text")).alias("text"))


def strip_wiki_labels(spark: SparkSession, d: str) -> DataFrame:
    return _wiki(spark, d, _LINKED).select("doc_id", markup.strip_wiki_links(F.col("text"), "label").alias("text"))


def strip_url_links(spark: SparkSession, d: str) -> DataFrame:
    return _wiki(spark, d, _LINKED).select("doc_id", markup.strip_url_links(F.col("text")).alias("text"))


def strip_wiki_markup(spark: SparkSession, d: str) -> DataFrame:
    return markup.strip_markup(_wiki(spark, d, _WIKI[0]))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of an encyclopaedia, of which some are redirects."""
    text = F.coalesce("text", F.lit(""))
    mark = F.when(F.col("doc_id") % 5 == 0, "#REDIRECT [[x]]").when(F.col("doc_id") % 5 == 1, "#redirect x").otherwise("")
    return _table(spark, d, "documents").select(F.concat(F.lit("doc "), F.col("doc_id")).alias("title"), F.concat(mark, text).alias("text"))


def drop_redirects(spark: SparkSession, d: str) -> DataFrame:
    return R.with_text(_entries(spark, d))


def xml_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as a dump and read again; white space around a text is not kept."""
    body = F.concat(F.lit("<page><title>"), F.col("title"), F.lit('</title><revision><text xml:space="preserve">'), T.html_escape(F.col("text")), F.lit("</text></revision></page>"))
    path = _folder(spark, "dump")
    _entries(spark, d).select(body).write.text(path)
    return R.read_xml_dump(spark, path).select("title", T.normalize(F.replace("text", F.lit("\n"), F.lit(" "))).alias("norm"))


def doc_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as an extractor does and read by blocks."""
    path = _folder(spark, "blocks")
    block = F.concat(F.lit("<doc id="), F.col("doc_id"), F.lit(">\ndoc "), F.col("doc_id"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n</doc>"))
    _table(spark, d, "documents").select(block).write.text(path)
    return R.read_doc_blocks(spark, path)


def framing_files(spark: SparkSession, d: str) -> DataFrame:
    """Framed documents written to files and read line by line, in blocks of files."""
    path = _folder(spark, "framed")
    framed = _framed(spark, d)
    framed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"].alias("lines")).select(F.array_join("lines", "\n")).write.text(path)
    lines = R.frame_articles(R.read_numbered_lines(spark, path), block_col="block")
    return lines.groupBy("line", "is_title", F.col("weight").cast("long").alias("weight")).agg(F.count("*").alias("n"))


def stored_shards(spark: SparkSession, d: str) -> DataFrame:
    """Chain counts stored by source, read by their paths and merged."""
    path = _folder(spark, "shards")
    session.remove_at_end(spark, path)
    lines = _streamed_lines(spark, d, "source").select(F.coalesce("source", F.lit("")).alias("source"), "line")
    with session.shuffles_dropped(spark):
        R.save_shards(exact.counts_of_lines(lines, "line", "source"), path, "source")
    return I.merge([R.read_shards(spark, path)], CUTOFF, stored=True)


def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return markup.strip_markup(session.spread(_table(spark, d, "pages")).select("page_id", F.coalesce("html", F.lit("")).alias("text")))


def streaming_counts(spark: SparkSession, d: str) -> DataFrame:
    from lexiloom.streaming.incremental import current_counts, stream_counts

    base = f"{session.shared_dir(spark)}/stream-{zlib.crc32(d.encode()):08x}-{spark.sparkContext.applicationId}"
    session.remove_at_end(spark, base)
    source = _table(spark, d, "documents")
    lines = R.lines_of(spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(_stream_source(d)))
    stream_counts(lines, f"{base}/counts", f"{base}/progress").awaitTermination()
    return current_counts(spark, f"{base}/counts")


def _stream_source(d: str) -> str:
    """A pattern, since a stream reads folders and the table may be one file."""
    return f"{d}/documents.parque[t]"


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f.__name__: f for f in (normalize_lines, chain_counts, prefix_counts, prune_terminals, index_columns, corpus_total, merge_shards, merge_two_stage, title_boost, framing, dump_index, explore_prefix, children_range)}
    out |= {name: _find(q) for name, (q, _) in FIND.items()}
    out |= {f.__name__: f for f in (anagrams, phone_words, splice_two, splice_n, splice_anagram, splice_phone, splice_quirk, search_page, search_outcomes, result_lines, page_texts)}
    out |= {"strip_tags": _html(markup.strip_tags), "strip_entities": _html(markup.strip_entities), "remove_blocks": _html(markup.remove_blocks), "escape_article_marks": _html(markup.escape_article_marks)}
    return out | {f.__name__: f for f in (strip_wiki_links, strip_wiki_labels, strip_url_links, drop_redirects, strip_markup, strip_wiki_markup, xml_pages, doc_blocks, framing_files, stored_shards, streaming_counts)}


def _html_sql(pattern: str, to: str) -> str:
    return f"SELECT page_id, regexp_replace(coalesce(html, ''), '{pattern}', '{to}', 'gis') AS text FROM pages"


def _tags_sql() -> str:
    """Tags by a scan: of what stands before a closing mark, the first opening mark that a name follows begins the tag."""
    letters = string.ascii_letters
    name = "CASE WHEN contains(b, ' ') OR NOT ends_with(b, '/') THEN string_split(b, ' ')[1] ELSE left(b, length(b) - 1) END"
    named = f"list_transform([{name}], lambda w: w <> '' AND translate(left(w, 1), '{letters}', '') = '' AND translate(w, '{letters}{string.digits}', '') = '')[1]"
    begins = f"list_transform([array_to_string(p[i:], '<')], lambda s: list_transform([CASE WHEN starts_with(s, '/') THEN substr(s, 2) ELSE s END], lambda b: {named})[1])[1]"
    left = "CASE WHEN len(f) = 0 THEN array_to_string(p, '<') || '>' ELSE array_to_string(p[1:f[1] - 1], '<') || ' ' END"
    cleared = f"list_transform([string_split(x, '<')], lambda p: list_transform([list_filter(range(2, len(p) + 1), lambda i: {begins})], lambda f: {left})[1])[1]"
    return f"""SELECT page_id, coalesce(array_to_string(list_transform(g[1:len(g) - 1], lambda x: {cleared}), ''), '') || g[len(g)] AS text
        FROM (SELECT page_id, string_split(coalesce(html, ''), '>') AS g FROM pages)"""


def oracle_sql() -> dict[str, str]:
    union = " UNION ALL ".join(f"SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM {t}" for t in ("documents", "benchmark", "conversations"))
    group_chains = _K.replace("K AS (SELECT chain, count(*)", "K AS (SELECT g, chain, count(*)").replace("SELECT unnest", "SELECT g, unnest").replace("FROM (SELECT ltrim", "FROM (SELECT coalesce(source, '') AS g, ltrim").replace("GROUP BY chain", "GROUP BY g, chain")
    out = {
        "normalize_lines": f"WITH {_L} SELECT doc_id, {_NORM} AS norm FROM L",
        "chain_counts": f"WITH {_L}, {_K} SELECT chain, n::BIGINT AS n FROM K",
        "prefix_counts": f"WITH {_L}, {_K}, {_P} SELECT text, c FROM P WHERE c >= {CUTOFF}",
        "prune_terminals": f"{_BASE} SELECT text, n FROM X",
        "index_columns": f"""{_BASE} SELECT text, c, substr(text, 1, 1) AS first_ch, (length(text) - length({_BARE}))::INT AS n_words, length({_BARE})::INT AS n_letters,
            regexp_replace(text, '[^ ]+ $', '') AS parent, list_aggregate(list_sort(string_split({_BARE}, '')), 'string_agg', '') AS letters_key,
            translate({_BARE}, 'abcdefghijklmnopqrstuvwxyz', '22233344455566677778889999') AS phone_key FROM I""",
        "corpus_total": f"{_BASE} SELECT sum(c)::BIGINT AS n_total FROM I WHERE instr(text, ' ') = length(text)",
        "merge_shards": f"WITH L AS ({union}), {_K}, {_P} SELECT text, c FROM P WHERE c >= {CUTOFF}",
        "merge_two_stage": f"""WITH {_L}, {group_chains}, G AS (SELECT g, text, sum(n) AS c FROM (SELECT g, unnest({_PREFIXES}) AS text, n FROM K) GROUP BY g, text HAVING sum(n) >= 2)
            SELECT text, sum(c)::BIGINT AS c FROM G GROUP BY text HAVING sum(c) >= {CUTOFF}""",
        "title_boost": f"""WITH D AS (SELECT string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
            L AS (SELECT unnest(a) AS line FROM D UNION ALL SELECT a[1] FROM D, range(9)), {_K}, {_P} SELECT text, c FROM P WHERE c >= 20""",
        "framing": _FRAMING + "SELECT file, line_no, line, is_title, weight FROM G",
        "framing_files": _FRAMING + "SELECT line, is_title, weight, count(*)::BIGINT AS n FROM G GROUP BY ALL",
        "dump_index": f"{_BASE} SELECT printf('%5d [%s]', n, text) AS line FROM X ORDER BY text",
        "explore_prefix": f"""{_BASE}, C AS (SELECT unnest(list_transform(range(1, least(length(text), 4) + 1), lambda i: substr(text, 1, i))) AS prefix, n FROM X WHERE starts_with(text, 't'))
            SELECT prefix, sum(n)::BIGINT AS c FROM C WHERE starts_with('th', prefix) OR starts_with(prefix, 'th') GROUP BY prefix UNION ALL SELECT '', sum(n)::BIGINT FROM X""",
        "children_range": f"{_BASE} SELECT substr(text, 3, 1) AS ch, sum(n)::BIGINT AS c FROM X WHERE starts_with(text, 'th') AND substr(text, 3, 1) BETWEEN 'a' AND 'm' GROUP BY 1",
        "anagrams": _found(f"list_aggregate(list_sort(string_split({_BARE}, '')), 'string_agg', '') = 'aeht'"),
        "phone_words": _found(f"translate({_BARE}, 'abcdefghijklmnopqrstuvwxyz', '22233344455566677778889999') = '843'"),
        "splice_two": f"""{_BASE}, N AS (SELECT sum(c)::DOUBLE AS n FROM I WHERE instr(text, ' ') = length(text)),
            R AS (SELECT text, c::DOUBLE AS score FROM I WHERE regexp_matches(text, '^(the|of|to) (the|of|and) $')
                UNION ALL SELECT a.text || b.text, a.c::DOUBLE / n * 0.000001::DOUBLE * b.c FROM I a, I b, N WHERE a.text IN ('the ', 'of ', 'to ') AND b.text IN ('the ', 'of ', 'and '))
            SELECT max(score) AS score, rtrim(text) AS text FROM R GROUP BY text""",
        "search_page": f"""{_BASE} SELECT c::DOUBLE AS score, rtrim(text) AS text, round(greatest(0.4::DOUBLE, CASE WHEN c >= 1 THEN 1.5::DOUBLE + ln(c::DOUBLE) / 5 END), 6) AS font_size
            FROM I WHERE {FIND["find_prefix"][1]} ORDER BY score DESC, text LIMIT 20 OFFSET 20""",
        "splice_quirk": f"{_BASE} SELECT c::DOUBLE AS score, rtrim(text) AS text FROM I WHERE regexp_matches(text, '^(the|of)( (the|of))? $')",
        "search_outcomes": f"""{_BASE}, A AS (SELECT count(*) AS n FROM I WHERE {FIND["find_prefix"][1]}), B AS (SELECT count(*) AS n FROM I WHERE text = 'the '), C AS (SELECT count(*) AS n FROM I WHERE {_BARE} = 'zzzz'),
            R AS (SELECT 'the_*' AS query, n FROM A UNION ALL SELECT '"the"', n FROM B UNION ALL SELECT 'zzzz', n FROM C)
            SELECT query, CASE WHEN n > 100 THEN 'next' WHEN n > 0 THEN 'done' ELSE 'none' END AS outcome, least(n, 100)::BIGINT AS n, CASE WHEN n > 100 THEN 100 END::BIGINT AS next_start, NULL::BIGINT AS next_budget, '' AS message FROM R
            UNION ALL SELECT query, 'error', 0, NULL, NULL, 'can' || chr(39) || 't parse ' || chr(39) || rest || chr(39) FROM (SELECT unnest(['the**', '<the', 'THE', '[a-', 'a{{9,3}}']) AS query, unnest(['*', '<the', 'THE', '[a-', 'a{{9,3}}']) AS rest) e(query, rest)
            UNION ALL SELECT 'spliced', 'budget', 0, NULL, 2, ''""",
        "page_texts": """SELECT doc_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS escaped, url_encode(t) AS quoted
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
        "result_lines": f"SELECT score::BIGINT || ' ' || text AS line FROM ({_found(FIND['find_prefix'][1])})",
        "strip_tags": _tags_sql(),
        "strip_entities": _html_sql("&[a-z]+?;", " "),
        "escape_article_marks": _html_sql("(BEGIN|END) ARTICLE", r">\0"),
        # Pages have comments alone; they are cut out between their marks.
        "remove_blocks": """SELECT page_id, h[1] || coalesce(list_aggregate(list_transform(h[2:], lambda x: substr(x, instr(x, '-->') + 3)), 'string_agg', ''), '') AS text
            FROM (SELECT page_id, string_split(coalesce(html, ''), '<!--') AS h FROM pages)""",
        "strip_markup": """SELECT page_id, regexp_replace(regexp_replace(h[1] || coalesce(list_aggregate(list_transform(h[2:], lambda x: substr(x, instr(x, '-->') + 3)), 'string_agg', ''), ''),
                '</?[A-Za-z][A-Za-z0-9]*(\\s[^>]*)?/?>', ' ', 'g'), '&[A-Za-z]+;', ' ', 'g') AS text
            FROM (SELECT page_id, string_split(coalesce(html, ''), '<!--') AS h FROM pages)""",
        "strip_wiki_markup": f"WITH {_wiki_sql(_WIKI[1])} SELECT * FROM W",
        "strip_wiki_links": f"WITH {_wiki_sql(_LINKED.replace(_BARRED, _FIRST).replace('[[', '').replace(']]', ''))} SELECT * FROM W",
        "strip_wiki_labels": f"WITH {_wiki_sql(_LINKED.replace(_BARRED, _LAST).replace('[[', '').replace(']]', ''))} SELECT * FROM W",
        "strip_url_links": f"WITH {_wiki_sql(_LINKED.replace(_ADDRESSES[0], _ADDRESSES[1]).replace('[https://z.org]', ''))} SELECT * FROM W",
        "drop_redirects": "SELECT 'doc ' || doc_id AS title, coalesce(text, '') AS text FROM documents WHERE doc_id % 5 > 1 AND text <> ''",
        "xml_pages": f"WITH L AS (SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents WHERE doc_id % 5 > 1 AND text <> '') SELECT 'doc ' || doc_id AS title, {_NORM} AS norm FROM L",
        "doc_blocks": "SELECT 'doc ' || doc_id AS title, coalesce(text, '') || chr(10) AS text FROM documents",
        "stored_shards": f"WITH {_L}, {_K}, {_P} SELECT text, c FROM P WHERE c >= {CUTOFF}",
        "splice_n": _spliced_letters("thandof"),
        "splice_anagram": _spliced_letters("ofthe"),
        "splice_phone": _spliced_digits("63843"),
        "streaming_counts": f"WITH {_L}, {_K} SELECT chain, n::BIGINT AS n FROM K",
    }
    return out | {name: _found(where) for name, (_, where) in FIND.items()}

"""The registered queries of the library proper, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import file_queries, samples
from .functions import catalog
from .functions.batches import small_batches
from .functions.tables import column_types, parse_embedded_blocks, read_table, table_cells
from .functions.text import slug
from .operators import structure as st
from .operators.render import render
from .plans.files import new_folder
from .sources import archives, compact, elements, html, interchange, lines, markups, notebooks, prose, rtf
from .sources.registry import REGISTRY


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.read_prose(_docs(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.read_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc"), "html"))


def _plain(blocks: DataFrame) -> DataFrame:
    """Without maps, and without the cells of tables, which have queries of their own."""
    return blocks.select(
        "doc", "kind", "element_type", F.when(F.col("element_type") != "table", F.col("content")).alias("content"), "level", "encoding", "element_order",
        st.attribute("heading_level").alias("heading_level"), st.attribute("id").alias("id"), st.attribute("role").alias("role"), st.attribute("key").alias("key"),
    )


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[^\\p{{L}}\\p{{N}}_\\-. \\t\\r\\n]+', '', 'g'), '\\s+', '-', 'g'), '^[^\\p{{L}}]+', ''), ''), 'section')"
_LINES = """l as (select doc_id as doc, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from documents where text is not null),
w as (select *, len(string_split_regex(trim(line), ' +')) as words, contains(line, ' | ') as barred from l where trim(line) <> '')"""
_PROSE = f"""{_LINES},
b as (select doc, 'block' as kind, case when barred then 'table' when words <= 3 then 'heading' else 'paragraph' end as element_type, case when not barred then trim(line) end as content, 1 as level,
  case when barred then 'json' else 'text' end as encoding, (row_number() over (partition by doc order by n) - 1)::int as element_order, case when words <= 3 and not barred then words::varchar end as heading_level,
  case when words <= 3 and not barred then {_SLUG.format("line")} end as id, null::varchar as role, null::varchar as key from w)"""
_TOKEN = prose._TOKEN.replace("'", "''")
_NAMES = "|".join(prose.SECTIONS)
_PAGES = f"""t as (select page_id as doc, unnest(range(len(x))) as n, unnest(x) as token from (select page_id, regexp_extract_all(html, '{_TOKEN}', 1) as x from pages)),
g as (select *, lower(regexp_extract(token, '^<(/?[A-Za-z][A-Za-z0-9]*)', 1)) as tag from t),
d as (select *, sum(case when regexp_matches(tag, '^({_NAMES})$') then 1 when regexp_matches(tag, '^/({_NAMES})$') then -1 else 0 end) over (partition by doc order by n) as depth,
  last_value(case when regexp_matches(tag, '^/?(h[1-6]|li|p|title|div|article|nav|footer|header|aside|main|td|th|ul|ol|head|body)$') then tag end ignore nulls) over (partition by doc order by n rows between unbounded preceding and current row) as block,
  trim(regexp_replace(token, '\\s+', ' ', 'g')) as body, regexp_matches(tag, '^({_NAMES})$') as opens from g),
k as (select *, not starts_with(token, '<') and body <> '' as is_text, coalesce(regexp_matches(block, '^h[1-6]$'), false) as head from d),
m as (select *, case when opens then 'section' when block = 'title' then 'title' when head then 'heading' when block = 'li' then 'list_item' else 'paragraph' end as what from k where is_text or opens),
b as (select doc, case when what = 'title' then 'value' else 'block' end as kind, case when what = 'title' then 'string' else what end as element_type, case when is_text then body end as content,
  (case when what = 'title' then 1 else greatest(case when opens then depth else depth + 1 end, 1) end)::int as level, 'text' as encoding, (row_number() over (partition by doc order by what = 'title', n) - 1)::int as element_order,
  case when head and is_text then block[2] end as heading_level, case when head and is_text then {_SLUG.format("body")} end as id, case when opens then tag end as role, case when what = 'title' then 'title' end as key from m)"""
_COLUMNS = "doc, kind, element_type, content, level, encoding, element_order, heading_level, id, role, key"

# Letters and blanks alone, for elements of pages.
_LETTERS = r"[^\p{L} ]"
_LETTER_LINES = f"""l as (select doc_id as doc, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as n from documents where text is not null),
c as (select doc, n, trim(regexp_replace(raw, '{_LETTERS}', '', 'g')) as line from l),
w as (select *, len(string_split_regex(line, ' +')) as words from c where line <> '')"""


def _letter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    rows = rows.select("doc", "n", F.trim(F.regexp_replace("raw", _LETTERS, "")).alias("line")).where("line <> ''")
    return rows.withColumn("words", F.size(F.split("line", " +")))


def _sample_columns(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc", "kind", "element_type", "content", "level", "element_order", *[st.attribute(k).alias(k) for k in ("heading_level", "language", "list_type")])


def _read_text(format: str):
    return lambda spark, sf_dir: _sample_columns(lines.read_lines(samples.sample_texts(_docs(spark, sf_dir), format), format))


def _read_file(format: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = samples.sample_files(_docs(spark, sf_dir), format)
        if format == "rtf":
            return _sample_columns(rtf.read_rtf(files.select("doc", F.col("bytes").cast("string").alias("text"))))
        return _sample_columns(archives.read_archives(files, format))

    return query


def _toc(spark, sf_dir):
    return st.toc(_prose(spark, sf_dir))


def _round_trip_interchange(spark, sf_dir):
    """Documents with headings, lists, quotes, code, tables and marks, to ASTs and back."""
    blocks = lines.read_lines(samples.sample_texts(_docs(spark, sf_dir), "org"), "org")
    return _sample_columns(interchange.read_interchange(interchange.write_interchange(blocks)))


def _inline_texts(spark, sf_dir):
    """The words of each text as an AST's inlines, the first one strong, and back to text in both modes."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    inline = lambda t, c: F.struct(F.lit(t).alias("t"), c.alias("c"))
    strong = inline("Strong", F.array(inline("Str", F.get("words", F.lit(0)))))
    rest = F.flatten(F.transform(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(1))), lambda w: F.array(inline("Space", F.lit(None).cast("string")), inline("Str", w))))
    made = F.concat(F.lit("["), F.to_json(strong), F.when(F.size("words") > 1, F.lit(",")).otherwise(F.lit("")), F.substring(F.to_json(rest), 2, (1 << 31) - 1))
    docs = small_batches(_docs(spark, sf_dir).withColumn("words", words).where(F.size("words") > 0).select("doc", made.alias("json")))
    back = docs.withColumn("rows", interchange.inlines_to_rows("json"))
    return back.select("doc", interchange.inlines_to_text("json").alias("markdown"), interchange.inlines_to_text("json", "text").alias("plain"), F.size("rows").alias("n_rows"), interchange.inlines_to_text(interchange.rows_to_inlines("rows"), "text").alias("again"))


def _round_trip_compact(spark, sf_dir):
    return _plain(compact.read_compact(compact.write_compact(_prose(spark, sf_dir))))


def _notebook_texts(spark, sf_dir):
    """The lines of documents as the cells of notebooks, markdown and code in turn; a code cell has its line as output too."""
    docs = _docs(spark, sf_dir).where("text is not null")
    outputs = lambda x: F.array(F.struct(F.lit("stream").alias("output_type"), x.alias("text")))
    cells = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.when(i % 2 == 0, "markdown").otherwise("code").alias("cell_type"), x.alias("source"), F.when(i % 2 == 1, outputs(x)).alias("outputs")))
    return docs.select("doc", F.to_json(F.struct(cells.alias("cells"), F.struct(F.struct(F.lit("python").alias("language")).alias("kernelspec")).alias("metadata"))).alias("text"))


def _notebooks(spark, sf_dir):
    return notebooks.read_notebooks(_notebook_texts(spark, sf_dir)).select("doc", "element_type", "content", "level", "encoding", "element_order", st.attribute("language").alias("language"), st.attribute("source_type").alias("source_type"))


def _expanded(spark, sf_dir):
    """Notebooks whose markdown cells are headings, items and paragraphs, with the blocks of these in their place."""
    docs = samples.with_lines(_docs(spark, sf_dir), "markdown")

    def cell(x: Column) -> Column:
        source = F.when(x["k"] == samples.HEADING, F.concat(F.repeat(F.lit("#"), x["rank"]), F.lit(" "), x["clean"])).when(x["k"] == samples.ITEM, F.concat(F.lit("- "), x["clean"])).otherwise(F.concat(F.lit("So "), x["clean"]))
        is_code = x["k"] == samples.CODE
        return F.struct(F.when(is_code, "code").otherwise("markdown").alias("cell_type"), F.when(is_code, x["raw"]).otherwise(source).alias("source"))

    made = docs.select("doc", F.to_json(F.struct(F.transform("lines", cell).alias("cells"))).alias("text"))
    return st.expand_embedded(notebooks.read_notebooks(made)).select("doc", "element_type", "content", "level", "element_order", st.attribute("heading_level").alias("heading_level"))


def _embedded(spark, sf_dir):
    """The orders of each customer as a CSV code block, parsed into a table."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.struct("o_orderkey", F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit(', ""x"""'))).alias("line"))
    text = F.concat(F.lit("key,name\n"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"))
    blocks = orders.groupBy(F.col("o_custkey").alias("doc")).agg(text.alias("content")).select(
        "doc", F.lit("block").alias("kind"), F.lit("code").alias("element_type"), "content", F.lit(1).alias("level"), F.lit("text").alias("encoding"), F.create_map(F.lit("language"), F.lit("csv")).alias("attributes"), F.lit(0).alias("element_order")
    )
    return table_cells(parse_embedded_blocks(blocks)).select("doc", "row", "name", "value")


def _typed_table(spark, sf_dir):
    """The nations as a table block, read as a typed relation."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    cells = F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("cells")))), lambda x: x["cells"])
    content = F.to_json(F.struct(F.array(F.lit("key"), F.lit("name"), F.lit("region")).alias("headers"), rows.alias("rows")))
    blocks = nation.agg(content.alias("content")).select(
        F.lit(1).alias("doc"), F.lit("block").alias("kind"), F.lit("table").alias("element_type"), "content", F.lit(1).alias("level"), F.lit("json").alias("encoding"), F.create_map().cast("map<string,string>").alias("attributes"), F.lit(0).alias("element_order")
    )
    return read_table(blocks, 1, 0)


def _page_elements(spark, sf_dir):
    """The lines of documents as page elements, ten a page, headings in sizes by their number of words."""
    rows = _letter_lines(spark, sf_dir)
    kind = F.when(F.col("words") <= 3, "heading").otherwise("text")
    made = rows.select("doc", (F.floor(F.col("n") / 10) + 1).cast("int").alias("page_number"), (F.col("n") % 10).alias("element_idx"), kind.alias("element_type"), F.col("line").alias("text"), (24.0 - F.col("words")).alias("font_size"))
    return elements.read_elements(made).select("doc", "element_type", "content", "element_order", st.attribute("heading_level").alias("heading_level"), st.attribute("page_number").alias("page_number"))


def _body_sql(source: str) -> str:
    """A row is metadata if some root before it has had no row of its level or above since."""
    return f"""{source}, r as (select *, kind = 'value' or element_type = 'metadata' as root from b),
body as (select {_COLUMNS} from r x where not exists (select 1 from r m where m.doc = x.doc and m.root and m.element_order <= x.element_order
  and not exists (select 1 from r y where y.doc = x.doc and y.element_order > m.element_order and y.element_order <= x.element_order and y.level <= m.level)))"""


def _section_sql(hit: str, exact: bool) -> str:
    return f"""with {_PROSE}, h as (select doc, element_order as o, heading_level::int as lvl, row_number() over (partition by doc order by element_order) as rn from b where element_type = 'heading' and ({hit})),
s as (select h.doc, h.o, min(n.element_order) as e from h left join b n on n.doc = h.doc and n.element_type = 'heading' and n.element_order > h.o and n.heading_level::int <= h.lvl {"where rn = 1" if exact else ""} group by h.doc, h.o)
select {_COLUMNS} from b where exists (select 1 from s where s.doc = b.doc and b.element_order >= s.o and (s.e is null or b.element_order < s.e))"""


def _flat_cells(blocks: DataFrame) -> DataFrame:
    return table_cells(blocks).select("doc", "element_order", "row", "name", "value")


_CELLS = f"""with {_LINES}, o as (select *, (row_number() over (partition by doc order by n) - 1)::int as element_order from w),
c as (select doc, element_order, unnest(string_split(line, '|')) as cell, unnest(range(len(string_split(line, '|')))) as k from o where barred)"""
_FORMS = "case when bool_and(v = '' or regexp_matches(v, '^(0|-?[1-9][0-9]{0,17})$')) and bool_or(v <> '') then 'bigint' else 'string' end"

_BLOCKS_IN_READING = f"""with {_PAGES}, s as (select doc, element_order as o, level as lv, role from b where element_type = 'section' and role in ('main', 'article', 'header', 'nav', 'aside', 'footer')),
p as (select s.*, coalesce((select min(element_order) from b where b.doc = s.doc and b.element_order > s.o and b.level <= s.lv), 1000000000) as e from s),
chrome as (select * from p where role in ('nav', 'aside') or (role in ('header', 'footer') and not exists (select 1 from p a where a.doc = p.doc and a.role = 'article' and p.o > a.o and p.o < a.e))),
keep as (select * from p where role = 'main' or (role = 'article' and not exists (select 1 from p m where m.doc = p.doc and m.role = 'main')))
select {_COLUMNS} from b where case when kind = 'value' then key in ('title', 'author', 'description') else
  (not exists (select 1 from keep where keep.doc = b.doc) or exists (select 1 from keep where keep.doc = b.doc and b.element_order >= o and b.element_order < e))
  and not exists (select 1 from chrome where chrome.doc = b.doc and b.element_order >= o and b.element_order < e) end"""



def _rendered_sql(shown: str) -> str:
    return f"""with {_PAGES}, x as (select *, replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as e from b where kind <> 'value' and coalesce(content, '') <> '')
select doc, ltrim(string_agg(case when element_type = 'list_item' then chr(10) else chr(10) || chr(10) end || {shown}, '' order by element_order), chr(10)) as rendered from x group by doc"""


def _tokens_sql() -> str:
    """The tokens of the LaTeX samples, block by block."""
    one = lambda kind, text: f"{{'kind': '{kind}', 'text': {text}}}"
    word, group = lambda w: [one("control_word", w)], lambda t: [one("begin_group", "'{'"), one("text", t), one("end_group", "'}'")]
    text, row = lambda t: [one("text", t)], [one("control_symbol", "chr(92)")]
    within = lambda name, inner: word("'begin'") + group(name) + inner + word("'end'") + group(name)
    item = lambda name: within(name, text("chr(10)") + word("'item'") + text("clean || chr(10)"))
    made = {
        samples.HEADING: word("repeat('sub', rank - 1) || 'section'") + group("clean"), samples.ITEM: item("'itemize'"), samples.NUMBERED: item("'enumerate'"), samples.QUOTE: within("'quote'", text("chr(10) || clean || chr(10)")),
        samples.CODE: within("'lstlisting'", text("'[language=python]' || chr(10) || raw || chr(10)")),
        samples.TABLE: within("'tabular'", group("'ll'") + text("chr(10)") + word("'hline'") + text("chr(10) || 'key & text '") + row + text("chr(10)") + word("'hline'") + text("chr(10) || n || ' & ' || clean || ' '") + row + text("chr(10)")),
        samples.MARKED: text("'So ' || clean || ' '") + word("'textbf'") + group("'strong'") + text("' end'"),
    }
    cases = " ".join(f"when {k} then [{', '.join(x)}]" for k, x in made.items())
    lines_of = samples.sample_sql("latex").split("r as (")[0].rstrip().rstrip(",")
    return f"""{lines_of},
g as (select doc, n, case k {cases} end || case when lead(n) over (partition by doc order by n) is null then [] else [{one("par_break", "''")}] end as x from t),
h as (select doc, n, unnest(x) as x, unnest(range(len(x))) as i from g)
select doc, (row_number() over (partition by doc order by n, i) - 1)::int as n, x.kind as kind, x.text as text from h"""


_EXPANDED = f"""with l as (select doc_id as doc, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as n from documents where text is not null),
c as (select doc, n, raw, trim(regexp_replace(regexp_replace(raw, '{samples.SIGNS}', '', 'g'), '\\s+', ' ', 'g')) as clean from l),
v as (select doc, n, trim(raw) as raw, clean, n % 7 as k0, (1 + (n // 7) % 2)::int as rank, lag(n % 7) over (partition by doc order by n) as k1 from c where clean <> ''),
w as (select *, case when k0 = {samples.CODE} and k1 = {samples.CODE} then {samples.MARKED} else k0 end as k from v),
r as (select doc, n, 0 as sub, 'div' as element_type, null as content, 1 as level, null as heading_level from w
  union all select doc, n, 1, case k when {samples.HEADING} then 'heading' when {samples.ITEM} then 'list' when {samples.CODE} then 'code' else 'paragraph' end, case k when {samples.HEADING} then clean when {samples.ITEM} then null when {samples.CODE} then raw else 'So ' || clean end, 2, case when k = {samples.HEADING} then rank::varchar end from w
  union all select doc, n, 2, 'list_item', clean, 3, null from w where k = {samples.ITEM})
select doc, element_type, content, level, (row_number() over (partition by doc order by n, sub) - 1)::int as element_order, heading_level from r"""

def _html_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages rendered as HTML, written, and read back."""
    folder = new_folder(spark)
    pages = html.read_html(samples.sample_texts(_docs(spark, sf_dir), "html"), html="text")
    render(pages, "html").write.parquet(folder)
    return _sample_columns(html.read_html(spark.read.parquet(folder), html="rendered"))


QUERIES = {
    "read_prose": lambda s, d: _plain(_prose(s, d)),
    "read_pages": lambda s, d: _plain(_pages(s, d)),
    **{f"read_{f}": _read_text(f) for f in ("org", "rst", "mediawiki", "textile", "latex", "markdown")},
    **{f"read_{f}": _read_file(f) for f in ("docx", "odt", "epub", "rtf")},
    "read_html": lambda s, d: _sample_columns(html.read_html(samples.sample_texts(_docs(s, d), "html"), html="text")),
    "html_round_trip": _html_round_trip,
    "read_notebooks": _notebooks,
    "expand_embedded": _expanded,
    "doc_toc": _toc,
    "doc_section_exact": lambda s, d: _plain(st.section(_prose(s, d), "Of.")),
    "doc_section_contains": lambda s, d: _plain(st.section(_prose(s, d), "th%on", "contains")),
    "doc_section_glob": lambda s, d: _plain(st.section(_prose(s, d), "a?e*.", "glob")),
    "doc_search_sections": lambda s, d: _plain(st.search_sections(_prose(s, d), "licensed under")),
    "doc_container": lambda s, d: _plain(st.container(_pages(s, d).withColumn("attributes", F.when(st.attribute("role") == "article", F.map_concat("attributes", F.create_map(F.lit("id"), F.lit("art")))).otherwise(F.col("attributes"))), "art")).drop("id"),
    "doc_reading": lambda s, d: _plain(st.reading(_pages(s, d))),
    "doc_body": lambda s, d: _plain(st.body(_pages(s, d))),
    "doc_render_text": lambda s, d: render(_pages(s, d), "text"),
    "doc_renumber": lambda s, d: _plain(st.renumber(_pages(s, d).where("kind = 'block' and element_type <> 'section'"), 5)),
    "doc_collect_explode": lambda s, d: _plain(st.exploded(st.collected(_pages(s, d)))),
    "doc_repair": lambda s, d: _plain(st.repair(_pages(s, d))),
    "slug": lambda s, d: _docs(s, d).select("doc", slug(F.col("text")).alias("slug")),
    "table_cells": lambda s, d: _flat_cells(_prose(s, d)),
    "column_types": lambda s, d: column_types(_prose(s, d)).select("doc", "element_order", "name", "type"),
    "embedded_tables": _embedded,
    "interchange_round_trip": _round_trip_interchange,
    "inline_texts": _inline_texts,
    "typed_table": _typed_table,
    "doc_render_md": lambda s, d: render(_pages(s, d), "md"),
    "doc_render_html": lambda s, d: render(_pages(s, d), "html"),
    "compact_round_trip": _round_trip_compact,
    "latex_tokens": lambda s, d: markups.latex_tokens(samples.sample_texts(_docs(s, d), "latex")),
    "page_elements": _page_elements,
    "reader_registry": lambda s, d: REGISTRY.table(s),
    "supported_formats": lambda s, d: catalog.supported_formats(s),
    "interchange_map": lambda s, d: catalog.interchange_map(s),
}

ORACLES: dict[str, str] = {
    "read_prose": f"with {_PROSE} select {_COLUMNS} from b",
    "read_pages": f"with {_PAGES} select {_COLUMNS} from b",
    **{f"read_{f}": samples.sample_sql(f) for f in ("org", "rst", "mediawiki", "textile", "latex", "markdown", "docx", "odt", "epub", "rtf", "html")},
    "read_notebooks": """with l as (select doc_id as doc, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from documents where text is not null),
r as (select doc, n, 0 as sub, 'div' as element_type, null as content, 1 as level, 'text' as encoding, null as language, case when n % 2 = 0 then 'markdown' else 'code' end as source_type from l
  union all select doc, n, 1, case when n % 2 = 0 then 'raw' else 'code' end, nullif(line, ''), 2, case when n % 2 = 0 then 'markdown' else 'text' end, case when n % 2 = 1 then 'python' end, null from l
  union all select doc, n, 2, 'div', null, 2, 'text', null, 'stream' from l where n % 2 = 1 union all select doc, n, 3, 'code', line, 3, 'text', null, null from l where n % 2 = 1)
select doc, element_type, content, level, encoding, (row_number() over (partition by doc order by n, sub) - 1)::int as element_order, language, source_type from r""",
    "expand_embedded": _EXPANDED,
    "doc_toc": f"with {_PROSE} select doc, heading_level::int as level, content as title, id, heading_level::int - min(heading_level::int) over (partition by doc) as indent, element_order from b where element_type = 'heading'",
    "doc_section_exact": _section_sql("content = 'Of.' or id = 'Of.'", True),
    "doc_section_contains": _section_sql("content ilike '%th%on%' escape '\\' or id = 'th%on'", False),
    "doc_section_glob": _section_sql("content ilike '%a_e%.%' escape '\\' or id = 'a?e*.'", False),
    "doc_search_sections": f"""with {_PROSE}, t as (select *, max(case when element_type = 'heading' then element_order end) over (partition by doc order by element_order) as seg from b),
g as (select doc, seg, coalesce(string_agg(content, ' ' order by element_order) filter (content <> ''), '') as txt from t group by doc, seg),
m as (select doc, seg from g where txt ilike '%licensed under%')
select {_COLUMNS} from t where exists (select 1 from m where m.doc = t.doc and m.seg is not distinct from t.seg)""",
    "doc_container": f"""with {_PAGES}, h as (select doc, min(element_order) as o, min_by(level, element_order) as lv from b where role = 'article' group by doc),
e as (select h.doc, o, min(b.element_order) as e from h left join b on b.doc = h.doc and b.element_order > o and b.level <= lv group by h.doc, o)
select {_COLUMNS.replace(" id,", "")} from b where exists (select 1 from e where e.doc = b.doc and b.element_order >= o and (e is null or b.element_order < e))""",
    "doc_reading": _BLOCKS_IN_READING,
    "doc_body": f"with {_body_sql(_PAGES)} select {_COLUMNS} from body",
    "doc_render_text": f"""with {_PAGES} select doc, ltrim(coalesce(string_agg(case when element_type = 'list_item' then chr(10) else chr(10) || chr(10) end || content, '' order by element_order) filter (coalesce(content, '') <> ''), ''), chr(10)) as rendered
from b where kind <> 'value' group by doc""",
    "doc_repair": f"""with {_PAGES}, o as (select *, lag(element_type) over w as pt, lag(level) over w as pl from b window w as (partition by doc order by element_order)),
f as (select *, kind = 'block' and element_type = 'list_item' and (level <= 1 or pt is null) and coalesce(coalesce(pt, '') not in ('list_item', 'list', 'figure', 'caption') or pl < level - 1, true) as orphan from o),
u as (select doc, kind, element_type, content, level + orphan::int as level, encoding, element_order, heading_level, id, role, key, 1 as own from f
  union all select doc, 'block', 'list', null, level, 'text', element_order, null, null, null, null, 0 from f where orphan),
v as (select *, level - min(level) over (partition by doc) + 1 as lv, (row_number() over (partition by doc order by element_order, own) - 1)::int as pos from u)
select doc, kind, element_type, content, (select count(distinct y.lv) from v y where y.doc = x.doc and y.pos <= x.pos and y.lv <= x.lv and not exists (select 1 from v z where z.doc = x.doc and z.pos > y.pos and z.pos <= x.pos and z.lv < y.lv))::int as level,
  encoding, pos as element_order, heading_level, id, role, key from v x""",
    "doc_renumber": f"with {_PAGES} select {_COLUMNS.replace('element_order', '(row_number() over (partition by doc order by element_order) + 4)::int as element_order')} from b where kind = 'block' and element_type <> 'section'",
    "doc_collect_explode": f"with {_PAGES} select {_COLUMNS} from b",
    "slug": f"select doc_id as doc, case when text is null then 'section' else {_SLUG.format('text')} end as slug from documents",
    "table_cells": _CELLS + " select doc, element_order, 0 as row, 'column_' || (k + 1) as name, trim(cell) as value from c",
    "column_types": _CELLS + f" select doc, element_order, 'column_' || (k + 1) as name, {_FORMS.replace('v', 'trim(cell)')} as type from c group by doc, element_order, k".replace("trim(cell)alue", "value"),
    "latex_tokens": _tokens_sql(),
    "page_elements": f"""with {_LETTER_LINES}, r as (select doc, (n // 10 + 1)::int as page, n % 10 as idx, case when words <= 3 then 'heading' else 'paragraph' end as element_type, line as content,
  case when words <= 3 then dense_rank() over (partition by doc, words <= 3 order by words)::varchar end as heading_level, null::varchar as page_number from w),
a as (select * from r union all select distinct doc, page, -1, 'page_break', null, null, page::varchar from r)
select doc, element_type, content, (row_number() over (partition by doc order by page, idx) - 1)::int as element_order, heading_level, page_number from a""",
    "embedded_tables": """select o_custkey as doc, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as row, unnest(['key', 'name']) as name, unnest([o_orderkey::varchar, o_orderpriority || ', "x"']) as value from orders""",
    "typed_table": "select n_nationkey::bigint as key, n_name as name, n_regionkey::bigint as region from nation",
    "interchange_round_trip": samples.sample_sql("org"),
    "inline_texts": r"""with w as (select doc_id as doc, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents where text is not null)
select doc, '**' || w[1] || '**' || coalesce(nullif(' ' || array_to_string(w[2:], ' '), ' '), '') as markdown, array_to_string(w, ' ') as plain, case when len(w) > 1 then 2 else 1 end as n_rows, array_to_string(w, ' ') as again from w where len(w) > 0""",
    "doc_render_md": _rendered_sql("case when element_type = 'heading' then repeat('#', heading_level::int) || ' ' || content when element_type = 'list_item' then repeat('  ', greatest((level - 2) // 2, 0)) || '- ' || content else content end"),
    "doc_render_html": _rendered_sql("case when element_type = 'heading' then '<h' || heading_level || '>' || e || '</h' || heading_level || '>' when element_type = 'list_item' then '<li>' || e || '</li>' else '<p>' || e || '</p>' end"),
    "compact_round_trip": f"with {_PROSE} select {_COLUMNS} from b",
}

QUERIES |= file_queries.QUERIES | {name: lambda s, d, query=query: _plain(query(s, d)) for name, query in file_queries.BLOCKS.items()}
ORACLES["html_round_trip"] = ORACLES["read_html"]
ORACLES |= file_queries.oracles(ORACLES["read_prose"])

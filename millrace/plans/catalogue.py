"""Named queries over the test tables, each with the DuckDB SQL that must agree.

The tables trigger few of the rules, so most queries read a decorated view of the
documents' sentences: the place of a sentence decides whether it gets a bullet, a
dangling ending, odd white space, boilerplate, keywords, capitals, an invalid domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import langid, rules
from millrace.functions import text as t
from millrace.functions.session import saved, scratch
from millrace.operators import boundaries, cleaning, records
from millrace.plans import build, profile
from millrace.plans.duck import crc32
from millrace.sources import datasets, fetch, html, pairs

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{t.WS}+', ' ', 'g'))"


def bullet(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{t.SPACES}•‣◦\\-–—*+]+', ''), '^{t.WS}+|{t.WS}+$', '', 'g')"


def dangling(c: str) -> str:
    return f"regexp_matches({c}, ':{t.WS}*[-–—•*]*{t.WS}*$')"


def n_words(c: str) -> str:
    return f"CAST(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END AS INTEGER)"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def boiler(c: str) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{m}')" for m in rules.BOILERPLATE) + ")"


def keyword(c: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({c}), {quoted([w])})' for w in words)} THEN '{d}'" for d, words in rules.KEYWORDS.items())
    return f"CASE {cases} END"


SENTS = f"""norm AS (SELECT doc_id, lang, source, {norm('text')} AS t FROM documents),
arr AS (SELECT doc_id, lang, source, string_split(regexp_replace(t, '([.!?]) +([A-Z0-9"“''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS a FROM norm),
sents AS (SELECT doc_id, lang, source, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS text FROM arr)"""
DECO = f"""{SENTS},
marked AS (SELECT *, (doc_id * 31 + pos) % 24 AS d FROM sents),
deco AS (SELECT doc_id, pos, lang, source AS "Source", d,
  CASE WHEN d = 0 THEN '• ' || text WHEN d = 1 THEN text || ': -' WHEN d = 2 THEN replace(text, ' ', chr(160) || chr(9)) WHEN d = 3 THEN text || ' Sign up'
       WHEN d = 4 AND lang = 'en' THEN upper(replace(text, 'ß', 'ss')) WHEN d = 5 THEN 'visit the clinic ' || text WHEN d = 6 THEN '- * + irrigation ' || text WHEN d = 7 THEN 'abroad ' || text
       WHEN d = 8 THEN '' WHEN d = 9 THEN 'one classic rule for all of us today in ' || text WHEN d = 10 THEN text || ' (c) | court' WHEN d = 11 THEN text || ':' ELSE text END AS "English",
  CASE WHEN d % 3 = 0 THEN '  - ' || text ELSE '' END AS "Kiswahili",
  CASE WHEN d % 4 = 0 THEN 'fr' WHEN d % 4 = 1 THEN NULL ELSE 'sw' END AS sw_lang,
  CASE WHEN d % 11 = 10 THEN 'Space' WHEN d % 5 = 0 THEN 'Health' WHEN d % 5 = 1 THEN 'Education' WHEN d % 5 = 2 THEN 'Agriculture' WHEN d % 5 = 3 THEN 'Road Safety' ELSE 'Governance' END AS raw_domain FROM marked),
recs AS (SELECT doc_id, pos, lang, sw_lang, CASE WHEN raw_domain = 'Road Safety' THEN 'Security' ELSE raw_domain END AS "Domain", "English", "Kiswahili", "Source" FROM deco)"""
CLEAN = f"""{DECO},
tidy AS (SELECT * REPLACE ({bullet(norm('"English"'))} AS "English", {bullet(norm('"Kiswahili"'))} AS "Kiswahili") FROM recs),
c_empty AS (SELECT * FROM tidy WHERE "English" <> ''),
c_frag AS (SELECT * FROM c_empty WHERE NOT {dangling('"English"')}),
c_len AS (SELECT * FROM c_frag WHERE {n_words('"English"')} BETWEEN 4 AND 80),
c_dup AS (SELECT * FROM c_len QUALIFY row_number() OVER (PARTITION BY array_to_string(string_split(lower("English"), ' ')[1:8], ' ') ORDER BY doc_id, pos) = 1),
c_lang AS (SELECT * REPLACE (CASE WHEN "Kiswahili" <> '' AND sw_lang IS NOT NULL AND sw_lang <> 'sw' THEN '' ELSE "Kiswahili" END AS "Kiswahili") FROM c_dup WHERE {n_words('"English"')} < 10 OR lang IS NULL OR lang = 'en'),
c_out AS (SELECT * FROM c_lang WHERE "Domain" IN ({quoted(rules.DOMAINS)}))"""
ORDER = ["doc_id", "pos"]


def sents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(t.normal_sentences(F.col("text"))).alias("pos", "text"))


def decorated(spark, sf_dir) -> DataFrame:
    d, text = F.col("d"), F.col("text")
    add = lambda a="", b="": F.concat(F.lit(a), text, F.lit(b))
    english = (
        F.when(d == 0, add("• ")).when(d == 1, add(b=": -")).when(d == 2, F.replace(text, F.lit(" "), F.lit(" \t"))).when(d == 3, add(b=" Sign up"))
        .when((d == 4) & (F.col("lang") == "en"), F.upper(F.replace(text, F.lit("ß"), F.lit("ss")))).when(d == 5, add("visit the clinic ")).when(d == 6, add("- * + irrigation ")).when(d == 7, add("abroad "))
        .when(d == 8, F.lit("")).when(d == 9, add("one classic rule for all of us today in ")).when(d == 10, add(b=" (c) | court")).when(d == 11, add(b=":")).otherwise(text)
    )
    domain = F.when(d % 11 == 10, F.lit("Space"))
    for k, name in enumerate(("Health", "Education", "Agriculture", "Road Safety")):
        domain = domain.when(d % 5 == k, F.lit(name))
    return sents(spark, sf_dir).withColumn("d", (F.col("doc_id") * 31 + F.col("pos")) % 24).select(
        "doc_id", "pos", "lang", F.col("source").alias("Source"), "d", english.alias("English"), F.when(d % 3 == 0, add("  - ")).otherwise("").alias("Kiswahili"),
        F.when(d % 4 == 0, F.lit("fr")).when(d % 4 != 1, F.lit("sw")).alias("sw_lang"), domain.otherwise("Governance").alias("raw_domain"),
    )


def recs(spark, sf_dir) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", "pos", "lang", "sw_lang", t.alias_domain(F.col("raw_domain")).alias("Domain"), "English", "Kiswahili", "Source")


def cleaned(spark, sf_dir) -> DataFrame:
    return cleaning.steps(recs(spark, sf_dir), ORDER, detect=lambda c: F.col("lang"), detect_sw=lambda c: F.col("sw_lang"))


@query(f'WITH {DECO} SELECT doc_id, pos, {norm(chr(34) + "English" + chr(34))} AS text FROM deco')
def normalize(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", "pos", t.normalize(F.col("English")).alias("text"))


@query(f'WITH {DECO} SELECT doc_id, pos, {bullet(norm(chr(34) + "English" + chr(34)))} AS text FROM deco')
def strip_bullet(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", "pos", t.tidy(F.col("English")).alias("text"))


@query(f'WITH {DECO} SELECT doc_id, pos, {dangling(chr(34) + "English" + chr(34))} AS dangling FROM deco')
def dangling_intro(spark, sf_dir):
    return decorated(spark, sf_dir).select("doc_id", "pos", t.is_dangling(F.col("English")).alias("dangling"))


@query(f"WITH {SENTS} SELECT doc_id, pos, {n_words('text')} AS n_words FROM sents WHERE {n_words('text')} BETWEEN 4 AND 80")
def word_bounds(spark, sf_dir):
    return sents(spark, sf_dir).where(t.word_bounds(F.col("text"))).select("doc_id", "pos", t.n_words(F.col("text")).alias("n_words"))


@query(f"WITH {SENTS} SELECT doc_id, pos, text FROM sents")
def sentences(spark, sf_dir):
    return sents(spark, sf_dir).select("doc_id", "pos", "text")


@query(f'WITH {DECO} SELECT doc_id, pos, "English" AS text FROM deco WHERE {n_words(norm(chr(34) + "English" + chr(34)))} BETWEEN 7 AND 80 AND NOT {boiler(chr(34) + "English" + chr(34))}')
def site_keep(spark, sf_dir):
    d = decorated(spark, sf_dir).select("doc_id", "pos", F.col("English").alias("text"))
    return t.within(d, "text", 7, normal=False)


@query(f"WITH {SENTS} SELECT doc_id, pos FROM sents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id, pos) = 1")
def exact_dedupe(spark, sf_dir):
    return records.first_places(sents(spark, sf_dir).select("doc_id", "pos", F.lower("text").alias("k")), ["k"], ORDER)


@query(f"WITH {SENTS} SELECT doc_id, pos FROM sents QUALIFY row_number() OVER (PARTITION BY array_to_string(string_split(lower(text), ' ')[1:8], ' ') ORDER BY doc_id, pos) = 1")
def near_dedupe(spark, sf_dir):
    return records.first_places(sents(spark, sf_dir).select("doc_id", "pos", t.near_key(F.col("text"), normal=True).alias("k")), ["k"], ORDER)


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def raw_dedupe(spark, sf_dir):
    """Rows of equal texts, by a digest, so that no text is shuffled."""
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    return table(spark, sf_dir, "documents").groupBy(digest).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(f'WITH {DECO} SELECT doc_id, pos, {keyword(chr(34) + "English" + chr(34))} AS domain FROM deco WHERE {keyword(chr(34) + "English" + chr(34))} IS NOT NULL')
def keyword_domain(spark, sf_dir):
    d = decorated(spark, sf_dir).select("doc_id", "pos", "English")
    return t.with_domain(d, "English").where("domain is not null").select("doc_id", "pos", "domain")


@query(f'WITH {DECO} SELECT "Domain" AS domain, count(*) AS n FROM recs GROUP BY 1')
def domain_alias(spark, sf_dir):
    return recs(spark, sf_dir).groupBy(F.col("Domain").alias("domain")).agg(F.count("*").alias("n"))


@query(f'WITH {DECO} SELECT doc_id, pos FROM recs WHERE {n_words(norm(chr(34) + "English" + chr(34)))} < 10 OR lang IS NULL OR lang = \'en\'')
def english_gate(spark, sf_dir):
    return recs(spark, sf_dir).where(cleaning.english_gate(t.normalize(F.col("English")), F.col("lang"))).select("doc_id", "pos")


@query(f"WITH {DECO} SELECT doc_id, pos, CASE WHEN \"Kiswahili\" <> '' AND sw_lang IS NOT NULL AND sw_lang <> 'sw' THEN '' ELSE \"Kiswahili\" END AS kiswahili FROM recs")
def kiswahili_gate(spark, sf_dir):
    return recs(spark, sf_dir).select("doc_id", "pos", cleaning.kiswahili_gate(F.col("Kiswahili"), F.col("sw_lang")).alias("kiswahili"))


@query(f'WITH {DECO} SELECT doc_id, pos, "Domain" AS domain FROM recs WHERE "Domain" IN ({quoted(rules.DOMAINS)})')
def domain_valid(spark, sf_dir):
    return recs(spark, sf_dir).where(F.col("Domain").isin(rules.DOMAINS)).select("doc_id", "pos", F.col("Domain").alias("domain"))


@query(f'WITH {CLEAN} SELECT doc_id, pos, "Domain", "English", "Kiswahili", "Source" FROM c_out')
def clean_pipeline(spark, sf_dir):
    return cleaned(spark, sf_dir).select("doc_id", "pos", "Domain", "English", "Kiswahili", "Source")


@query(f'WITH {CLEAN} SELECT "Source" AS source, count(*) AS n FROM c_out GROUP BY 1')
def clean_per_source(spark, sf_dir):
    left = cleaning.kept(recs(spark, sf_dir), ORDER, ["Source"], lambda c: F.col("lang"))
    return left.groupBy(F.col("Source").alias("source")).agg(F.count("*").alias("n"))


STAGE_TABLES = dict(zip(cleaning.STAGES, ("recs", "c_empty", "c_frag", "c_len", "c_dup", "c_lang", "c_out"), strict=True))


@query(f"WITH {CLEAN} " + " UNION ALL ".join(f"SELECT '{k}' AS stage, count(*) AS n FROM {v}" for k, v in STAGE_TABLES.items()))
def clean_stats(spark, sf_dir):
    return cleaning.tally(recs(spark, sf_dir), records.packed(*ORDER), lambda c: F.col("lang"))


BLOCKS = f"""art AS (SELECT page_id, string_split(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<p>') AS a FROM pages),
cut AS (SELECT page_id, unnest(range(len(a) - 1)) AS k, unnest(a[2:]) AS x FROM art),
blocks AS (SELECT page_id, CAST(k AS INTEGER) AS block, {norm("replace(replace(replace(replace(regexp_replace(split_part(x, '</p>', 1), '<[^>]*>', ' ', 'g'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')")} AS text FROM cut)"""
SELECTORS = ["article p", "main p", "p"]


@query(f"WITH {BLOCKS} SELECT page_id, block, text FROM blocks")
def pages_blocks(spark, sf_dir):
    return html.blocks(table(spark, sf_dir, "pages"), SELECTORS).select("page_id", "block", t.normalize(F.col("text")).alias("text"))


PAGE_SENTS = f"""{BLOCKS},
parr AS (SELECT page_id, block, string_split(regexp_replace(text, '([.!?]) +([A-Z0-9"“''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS a FROM blocks),
psents AS (SELECT page_id, block, CAST(unnest(range(len(a))) AS INTEGER) AS unit, unnest(a) AS text FROM parr)"""


@query(f"WITH {PAGE_SENTS} SELECT page_id, block, unit, text FROM psents WHERE {n_words('text')} BETWEEN 4 AND 80 AND NOT {boiler('text')}")
def pages_sentences(spark, sf_dir):
    found = html.units(html.blocks(table(spark, sf_dir, "pages").select("page_id", "url", "html"), SELECTORS))
    return t.within(found, "text").select("page_id", "block", "unit", "text")


HOST = "regexp_extract(url, '^([^/:]+://[^/?#]*)', 1)"
LINKS = f"""href AS (SELECT page_id, {HOST} AS site, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages),
links AS (SELECT page_id, site, CAST(unnest(range(len(h))) AS INTEGER) AS pos, site || replace(unnest(h), '&amp;', '&') AS href FROM href),
first AS (SELECT * FROM links WHERE regexp_matches(href, '/[a-t][^/]*$') QUALIFY row_number() OVER (PARTITION BY site, href ORDER BY page_id, pos) = 1)"""


@query(f"WITH {LINKS} SELECT site, page_id, pos, href FROM first QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id, pos) <= 15")
def link_discovery(spark, sf_dir):
    pages = html.parsed(table(spark, sf_dir, "pages"), SELECTORS)
    links = pages.select(F.regexp_extract("url", r"^([^/:]+://[^/?#]*)", 1).alias("site"), "page_id", F.posexplode("links").alias("pos", "href"))
    return html.discover(links, ["/[a-t][^/]*$"], 15).select("site", "page_id", "pos", "href")


CAP = f"""{PAGE_SENTS},
kept AS (SELECT {HOST} AS site, page_id, block, unit, s.text FROM psents s JOIN pages USING (page_id) WHERE {n_words('s.text')} BETWEEN 4 AND 80 AND NOT {boiler('s.text')}),
uniq AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY site, lower(text) ORDER BY page_id, block, unit) = 1)"""


@query(f"WITH {CAP} SELECT site, page_id, block, unit FROM uniq QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id, block, unit) <= 20")
def site_cap(spark, sf_dir):
    found = t.within(html.units(html.blocks(table(spark, sf_dir, "pages").select("page_id", "url", "html"), SELECTORS)), "text")
    found = found.withColumn("site", F.regexp_extract("url", r"^([^/:]+://[^/?#]*)", 1)).withColumn("k", F.lower("text"))
    order = ["page_id", "block", "unit"]
    return records.cap_per(records.first_per(found, ["site", "k"], order), ["site"], order, 20).select("site", *order)


_PAGED = [s for s in rules.SITES if s["pagination"]]


@query(" UNION ALL ".join(
    f"SELECT '{s['name']}' AS name, CAST(n AS INTEGER) AS ordinal, CASE WHEN n < {len(s['start_urls'])} THEN list_extract([{quoted(s['start_urls'])}], n + 1) ELSE replace('{s['pagination']['template']}', '{{n}}', CAST(n - {len(s['start_urls'])} + {s['pagination']['start']} AS VARCHAR)) END AS url FROM (SELECT CAST(unnest(range({len(s['start_urls']) + s['pagination']['pages']})) AS INTEGER) AS n)"
    for s in _PAGED))
def pagination(spark, sf_dir):
    return html.start_urls(html.site_table(spark, _PAGED)).select("name", "ordinal", "url")


@query("SELECT name, domain, source, CAST(max_pages AS INTEGER) AS max_pages FROM (VALUES " + ", ".join(f"('{s['name']}', '{s['domain']}', '{s['source']}', {s['max_pages']})" for s in rules.SITES) + ") AS v(name, domain, source, max_pages)")
def site_registry(spark, sf_dir):
    return html.site_table(spark).select("name", "domain", "source", "max_pages")


LAST = "last AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'eng' ELSE 'swa' END AS lang, text FROM conversations WHERE role IN ('user', 'assistant'))"


@query(f"WITH {LAST} SELECT a.conv_id * 1000 + a.turn AS seq, CASE WHEN a.lang = 'eng' THEN a.text ELSE b.text END AS en, CASE WHEN a.lang = 'eng' THEN b.text ELSE a.text END AS sw FROM last a JOIN last b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.lang <> b.lang")
def pair_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    sentences = c.where(F.col("role").isin("user", "assistant")).select(key.alias("id"), F.when(F.col("role") == "user", "eng").otherwise("swa").alias("lang"), "text", F.col("turn").alias("ordinal"))
    return pairs.exports(sentences, c.select(key.alias("a"), (key + 1).alias("b"), key.alias("ordinal")))


_BREAKS = "".join(f" || chr({c})" for c in (10, 11, 12, 13, 28, 29, 30, 0x85, 0x2028, 0x2029)).removeprefix(" || ")


@query(f"WITH a AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS seq, translate(text, {_BREAKS}, '          ') AS en FROM benchmark), b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq, translate(text, {_BREAKS}, '          ') AS sw FROM documents) SELECT seq, en, sw FROM a JOIN b USING (seq)")
def line_zip(spark, sf_dir):
    """Texts of two tables written as files of lines and read back side by side."""
    flat = lambda: F.translate("text", "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029", " " * 10)
    paths = [scratch(spark, "lines"), scratch(spark, "lines")]
    for path, name, key in zip(paths, ("benchmark", "documents"), ("item_id", "doc_id"), strict=True):
        table(spark, sf_dir, name).repartitionByRange(key).sortWithinPartitions(key).select(flat()).write.text(path)
    return pairs.zipped(spark, *paths)


@query(f"WITH p AS (SELECT turn, conv_id, {norm('text')} AS en, CASE WHEN turn % 3 = 0 THEN '' ELSE {norm('role')} END AS sw FROM conversations ORDER BY conv_id, turn LIMIT 200) SELECT conv_id * 1000 + turn AS seq, 'Health' AS domain, en, sw FROM p WHERE en <> '' AND sw <> ''")
def memory_import(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("en"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("sw"))
    return pairs.import_memory(c, max_pairs=200).select("seq", F.col("Domain").alias("domain"), F.col("English").alias("en"), F.col("Kiswahili").alias("sw"))


@query(f"WITH p AS (SELECT turn, conv_id, {norm('text')} AS en, CASE WHEN turn % 3 = 0 THEN '' ELSE {norm('role')} END AS sw FROM conversations) SELECT conv_id * 1000 + turn AS seq, 'Health' AS domain, en, sw FROM p WHERE en <> '' AND sw <> ''")
def memory_import_whole(spark, sf_dir):
    """The import over the whole table, without the limit of memory_import."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("en"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("sw"))
    return pairs.import_memory(c).select("seq", F.col("Domain").alias("domain"), F.col("English").alias("en"), F.col("Kiswahili").alias("sw"))


@query(f'WITH {DECO}, s AS (SELECT doc_id, pos, {norm(chr(34) + "English" + chr(34))} AS en FROM recs) SELECT doc_id, pos, {keyword("en")} AS domain, en FROM s WHERE {n_words("en")} BETWEEN 4 AND 80 AND {keyword("en")} IS NOT NULL')
def sentence_import(spark, sf_dir):
    p = recs(spark, sf_dir).select(F.struct("doc_id", "pos").alias("seq"), F.col("English").alias("en"), F.col("Kiswahili").alias("sw"))
    return pairs.import_sentences(p).select("seq.doc_id", "seq.pos", F.col("Domain").alias("domain"), F.col("English").alias("en"))


@query("SELECT printf('PSA%06d', row_number() OVER (ORDER BY doc_id)) AS psa_id, text AS english FROM documents")
def assign_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", *records.record(F.lit("Health"), F.col("text"), source=F.col("source")))
    return records.assign_ids(d, ["doc_id"]).select(F.col("PSA_ID").alias("psa_id"), F.col("English").alias("english"))


@query(f"""WITH {DECO} SELECT array_to_string(list_sort(list(DISTINCT "Domain") FILTER (WHERE "Domain" NOT IN ({quoted(rules.DOMAINS)}))), '|') AS invalid_domains, count(*) FILTER (WHERE NOT regexp_matches("English", '[^{t.SPACES}]')) AS n_empty_english FROM recs""")
def validate(spark, sf_dir):
    return records.validation(recs(spark, sf_dir))


@query(f'WITH {DECO} SELECT "Domain" AS domain, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, min((doc_id, pos))) AS place FROM recs GROUP BY 1')
def per_domain(spark, sf_dir):
    d = recs(spark, sf_dir).groupBy(F.col("Domain").alias("domain")).agg(F.count("*").alias("rows"), F.min(F.struct(*ORDER)).alias("first"))
    return d.select("domain", "rows", F.row_number().over(Window.orderBy(F.desc("rows"), "first")).cast("long").alias("place"))


@query("SELECT source, count(*) AS rows, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM documents GROUP BY 1")
def per_source(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("rows"))
    return n.withColumn("share", F.col("rows") * F.lit(1.0) / F.sum("rows").over(Window.partitionBy()))


def _at():
    return F.col("doc_id") * (1 << 20) + F.col("pos")


_EN, _SW = n_words(norm('"English"')), n_words(norm('"Kiswahili"'))


@query(f"""WITH {DECO}, w AS (SELECT "Source", {_EN} AS en, CASE WHEN regexp_matches("Kiswahili", '[^{t.SPACES}]') THEN {_SW} END AS sw FROM recs)
SELECT count(*) AS total, count(sw) AS paired, count(DISTINCT CASE WHEN "Source" <> '' THEN "Source" END) AS sources, avg(en) AS en_mean, median(en) AS en_median, avg(sw) AS sw_mean, median(sw) AS sw_median FROM w""")
def word_stats(spark, sf_dir):
    return profile.figures(profile.state(recs(spark, sf_dir), _at()))


@query(f"""WITH {DECO}, w AS (SELECT doc_id * 1048576 + pos AS place, "Domain" AS domain, "Source" AS source, {_EN} AS en, CASE WHEN regexp_matches("Kiswahili", '[^{t.SPACES}]') THEN {_SW} END AS sw FROM recs)
SELECT 'domain' AS kind, domain AS key, count(*) AS n, min(place) AS first FROM w GROUP BY domain UNION ALL SELECT 'source', source, count(*), min(place) FROM w GROUP BY source UNION ALL SELECT 'en', CAST(en AS VARCHAR), count(*), min(place) FROM w GROUP BY en UNION ALL SELECT 'sw', CAST(sw AS VARCHAR), count(*), min(place) FROM w WHERE sw IS NOT NULL GROUP BY sw""")
def profile_merged(spark, sf_dir):
    """The profile of a whole table from those of its halves."""
    rows = recs(spark, sf_dir)
    return profile.merged(*(profile.state(rows.where(F.col("doc_id") % 2 == k), _at()) for k in (0, 1)))


BUILD = f"""{DECO},
pair AS (SELECT conv_id * 1000 + turn AS a, 0 AS b, {norm('text')} AS en, CASE WHEN turn % 3 = 0 THEN '' ELSE {norm('role')} END AS sw FROM conversations),
sentence AS (SELECT doc_id AS a, pos AS b, {norm(chr(34) + "English" + chr(34))} AS en, {norm(chr(34) + "Kiswahili" + chr(34))} AS sw FROM recs),
mix AS (SELECT 1 AS src, a, b, 'Health' AS domain, en, sw, '{rules.TICO["source"]}' AS source FROM pair WHERE en <> '' AND sw <> '' UNION ALL SELECT 2, a, b, {keyword("en")}, en, sw, '{rules.TATOEBA["source"]}' FROM sentence WHERE {n_words("en")} BETWEEN 4 AND 80 AND {keyword("en")} IS NOT NULL),
neat AS (SELECT * REPLACE ({bullet('en')} AS en, {bullet('sw')} AS sw) FROM mix),
first AS (SELECT * FROM neat WHERE en <> '' AND NOT {dangling('en')} AND {n_words('en')} BETWEEN 4 AND 80 QUALIFY row_number() OVER (PARTITION BY array_to_string(string_split(lower(en), ' ')[1:8], ' ') ORDER BY src, a, b) = 1)"""


@query(f"""WITH {BUILD} SELECT printf('PSA%06d', row_number() OVER (ORDER BY src, a, b)) AS psa_id, domain, en AS english, sw AS kiswahili, source FROM first""")
def build_run(spark, sf_dir):
    """A dataset built from two sources: a memory of turns and sentences with a domain."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("en"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("sw"))
    p = recs(spark, sf_dir).select(F.struct("doc_id", "pos").alias("seq"), F.col("English").alias("en"), F.col("Kiswahili").alias("sw"))
    df, _ = build.build(spark, {"tico19": pairs.import_memory(c), "tatoeba": pairs.import_sentences(p)}, langid.unknown)
    return df.select(F.col("PSA_ID").alias("psa_id"), F.col("Domain").alias("domain"), F.col("English").alias("english"), F.col("Kiswahili").alias("kiswahili"), F.col("Source").alias("source"))


@query(f"""WITH {DECO}, neat AS (SELECT doc_id, pos, "Domain" AS domain, {bullet(norm('"English"'))} AS en, "Source" AS source FROM recs),
first AS (SELECT * FROM neat WHERE en <> '' AND NOT {dangling('en')} AND {n_words('en')} BETWEEN 4 AND 80 QUALIFY row_number() OVER (PARTITION BY array_to_string(string_split(lower(en), ' ')[1:8], ' ') ORDER BY doc_id, pos) = 1)
SELECT printf('PSA%06d', row_number() OVER (ORDER BY doc_id, pos)) AS psa_id, domain, en AS english, source FROM first WHERE domain IN ({quoted(rules.DOMAINS)})""")
def reclean_run(spark, sf_dir):
    """A stored dataset, with ids that have gaps, cleaned again under the present rules, stored as a new version and read back."""
    path = scratch(spark, "dataset")
    raw = recs(spark, sf_dir).withColumns({"English": F.regexp_replace("English", "[\\r\\n]", " "), "PSA_ID": F.format_string("PSA%09d", F.col("doc_id") * 10_000 + F.col("pos"))})
    datasets.write(raw, path, columns=rules.COLUMNS)
    df, stats = build.reclean(datasets.read(spark, path), langid.unknown)
    build.store(df, stats, path, {}, made=True)
    return datasets.read(spark, path).select(F.col("PSA_ID").alias("psa_id"), F.col("Domain").alias("domain"), F.col("English").alias("english"), F.col("Source").alias("source"))


_CUT = "CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substring(text, 1, 119), '" + t.WS + "+$', '') || '…' END"


@query(f"SELECT doc_id, replace(replace({_CUT}, '|', '\\|'), chr(10), ' ') AS text FROM documents ORDER BY doc_id LIMIT 5")
def report_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy("doc_id").limit(5).select("doc_id", t.escape_markdown(t.truncate(F.col("text"))).alias("text"))


@query("SELECT src, count(*) AS n, sum(length(text)) AS chars FROM (SELECT 'documents' AS src, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY 1")
def union_sources(spark, sf_dir):
    out = None
    for name in ("documents", "conversations", "benchmark"):
        df = table(spark, sf_dir, name).select(F.lit(name).alias("src"), "text")
        out = df if out is None else out.unionByName(df)
    return out.groupBy("src").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).cast("decimal(38,0)").alias("chars"))


@query("""SELECT doc_id, '{"type": "scraped", "tool": "html.parser", "site": "' || source || '"}' AS metadata FROM documents""")
def metadata_json(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.json_object(type="scraped", tool="html.parser", site=F.col("source")).alias("metadata"))


@query(f"WITH {SENTS} SELECT doc_id, pos, text FROM sents WHERE length(text) >= 40")
def legacy_sentences(spark, sf_dir):
    return sents(spark, sf_dir).where(F.length("text") >= 40).select("doc_id", "pos", "text")


_WORD = "regexp_replace(regexp_replace(lower({0}), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}.]+$', '', 'g'), '\\.$', '')"
_STOP = "regexp_matches({0}, '\\.[^\\p{{L}}\\p{{N}}.]*$')"
ABBREVIATIONS = f"""token AS (SELECT unnest(string_split(t, ' ')) AS token FROM norm),
counted AS (SELECT {_WORD.format("token")} AS word, count(*) AS n, count(*) FILTER ({_STOP.format("token")}) AS n_stop FROM token WHERE token <> '' GROUP BY 1),
part AS (SELECT *, n - n_stop AS without, length(replace(word, '.', '')) AS letters, (SELECT sum(n_stop) / sum(n) FROM counted) AS p FROM counted),
abbreviation AS (SELECT word, n, n_stop, -2 * (n_stop * ln(p) + without * ln(1 - p) - n_stop * ln({boundaries.SURE}) - without * ln({1 - boundaries.SURE})) * exp(-letters) * (length(word) - letters + 1) * pow(letters, -without) AS score FROM part
  WHERE n_stop > 0 AND p < 1 AND regexp_matches(word, '\\p{{L}}') AND NOT regexp_matches(word, '\\p{{N}}'))"""


@query(f"WITH {SENTS}, {ABBREVIATIONS} SELECT word, n, n_stop, round(score, 6) AS score FROM abbreviation WHERE score >= {boundaries.LEAST}")
def abbreviations(spark, sf_dir):
    """Words of the documents that count as abbreviations."""
    return boundaries.abbreviations(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@query(f"""WITH {SENTS}, {ABBREVIATIONS}, ended AS (SELECT *, CASE WHEN {_STOP.format("last")} THEN {_WORD.format("last")} END AS word FROM (SELECT *, list_last(string_split(text, ' ')) AS last FROM sents)),
begun AS (SELECT e.doc_id, e.pos, e.text, CASE WHEN lag(a.word) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL THEN 0 ELSE 1 END AS begins FROM ended e LEFT JOIN (SELECT word FROM abbreviation WHERE score >= {boundaries.LEAST}) a ON e.word = a.word),
placed AS (SELECT doc_id, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS s, pos, text FROM begun)
SELECT doc_id, CAST(s AS INTEGER) AS pos, string_agg(text, ' ' ORDER BY pos) AS text FROM placed GROUP BY doc_id, s HAVING length(string_agg(text, ' ' ORDER BY pos)) >= 40""")
def learned_sentences(spark, sf_dir):
    """Sentences of at least forty characters, cut behind no abbreviation."""
    docs = table(spark, sf_dir, "documents")
    return boundaries.sentences(docs, ["doc_id"], boundaries.abbreviations(docs)).where(F.length("text") >= 40)


_FETCH = "length(regexp_extract(url, '^[^/:]+://([^/?#]*)', 1))"


@query(f"""SELECT url, CASE WHEN {_FETCH} % 5 <> 0 THEN CASE WHEN contains(url, '/en/') THEN 404 ELSE 200 END END AS status, CASE WHEN {_FETCH} % 5 <> 0 AND NOT contains(url, '/en/') THEN '<p>' || url || '</p>' END AS html,
CASE WHEN {_FETCH} % 5 = 0 THEN 'ConnectionError: refused' WHEN contains(url, '/en/') THEN 'status 404' END AS problem FROM pages""")
def page_fetch(spark, sf_dir):
    """All addresses of pages through a fetcher that some hosts refuse and that finds some pages missing."""

    def answer(url):
        host = url.split("/")[2].split("?")[0].split("#")[0]
        if len(host) % 5 == 0:
            raise ConnectionError("refused")
        return (404, None) if "/en/" in url else (200, f"<p>{url}</p>")

    return saved(fetch.pages(table(spark, sf_dir, "pages"), answer, delay=0), "fetched")


_TOKENS = f"string_split(regexp_replace(lower({norm('text')}), '[^\\p{{L}} ]', '', 'g'), ' ')"
_HITS = ", ".join("{'n': len(list_filter(w, lambda x: list_contains([" + quoted(words) + f"], x))), 'lang': '{k}'}}" for k, words in langid.WORDS.items())


@query(f"WITH {SENTS}, tok AS (SELECT doc_id, pos, length({norm('text')}) AS n, {_TOKENS} AS w FROM sents), ranked AS (SELECT doc_id, pos, n, list_reverse_sort([{_HITS}]) AS r FROM tok) SELECT doc_id, pos, CASE WHEN n >= 10 AND r[1].n >= 2 AND r[1].n > r[2].n THEN r[1].lang END AS lang FROM ranked")
def language(spark, sf_dir):
    """Detected language of every sentence."""
    return sents(spark, sf_dir).select("doc_id", "pos", langid.detect(F.col("text")).alias("lang"))


_LANGS = ("de", "en", "es", "fr")


def _slots(c: str) -> str:
    codes = f"list_transform(string_split(' ' || trim(regexp_replace(lower({c}), '[^\\p{{L}}]+', ' ', 'g')) || ' ', ''), lambda x: CAST(unicode(x) AS BIGINT))"
    return f"list_transform(list_transform([{codes}], lambda a: list_transform(range(1, greatest(len(a) - 1, 1)), lambda k: (a[k] * 7919 + a[k + 1] * 241 + a[k + 2]) % {langid.SLOTS}))[1], lambda s: s)"


@query(f"""WITH {SENTS}, fold AS (SELECT doc_id, {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS held_out FROM documents),
run AS (SELECT lang, unnest({_slots("t")}) AS slot FROM norm JOIN fold USING (doc_id) WHERE NOT held_out AND lang IN ({quoted(_LANGS)})),
seen AS (SELECT lang, slot, count(*) AS n FROM run GROUP BY ALL), total AS (SELECT lang, sum(n) AS n FROM seen GROUP BY 1),
weight AS (SELECT l.lang, s.slot, CAST(round(1000 * ln((coalesce(seen.n, 0) + 0.5) / (coalesce(total.n, 0) + 0.5 * {langid.SLOTS}))) AS BIGINT) AS w FROM (SELECT unnest([{quoted(_LANGS)}]) AS lang) l CROSS JOIN (SELECT unnest(range({langid.SLOTS})) AS slot) s LEFT JOIN seen ON seen.lang = l.lang AND seen.slot = s.slot LEFT JOIN total ON total.lang = l.lang),
each AS (SELECT doc_id, pos, unnest({_slots("text")}) AS slot FROM sents), score AS (SELECT doc_id, pos, lang, sum(w) AS n FROM each JOIN weight USING (slot) GROUP BY ALL),
ranked AS (SELECT doc_id, pos, list((n, lang) ORDER BY n DESC) AS r FROM score GROUP BY ALL)
SELECT doc_id, pos, held_out, lang AS labelled, CASE WHEN length(text) >= 10 AND r[1][1] > r[2][1] THEN r[1][2] END AS detected FROM sents JOIN fold USING (doc_id) LEFT JOIN ranked USING (doc_id, pos)""")
def language_profiles(spark, sf_dir):
    """Language of every sentence by profiles learned from the documents outside a fold."""
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("text", "lang", fold)
    profile = langid.learn(docs.where("not held_out"), _LANGS)
    return sents(spark, sf_dir).select("doc_id", "pos", fold, F.col("lang").alias("labelled"), profile.detect(F.col("text")).alias("detected"))


@query(f"WITH o AS (SELECT page_id, url, length({HOST}) % 3 AS kind FROM pages) SELECT page_id, url, kind = 1 OR (kind = 0 AND NOT regexp_matches(url, '^[^/:]+://[^/?#]*/en/')) AS allowed FROM o")
def robots_rules(spark, sf_dir):
    """Whether each page may be fetched, under rules that keep /en/ away from one host in three and answer some with an error."""
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    origin = F.regexp_extract("url", r"^([^/:]+://[^/?#]*)", 1).alias("origin")
    policies = urls.select(origin).distinct().withColumn("status", F.element_at(F.array(F.lit(200), F.lit(404), F.lit(403)), F.length("origin") % 3 + 1)).withColumn("body", F.lit("User-agent: *\nDisallow: /en/"))
    return html.robots(urls, policies)


def _records(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", *records.record(F.lit("Health"), F.col("text"), source=F.col("source"), date="2024-01-01", metadata=t.json_object(lang=F.col("lang"))))
    return d.withColumn("PSA_ID", F.format_string("PSA%06d", "doc_id")).drop("doc_id")


_DATASET = """SELECT printf('PSA%06d', doc_id) AS "PSA_ID", 'Health' AS "Domain", text AS "English", source AS "Source", '2024-01-01' AS "Date", '{"lang": "' || lang || '"}' AS "Metadata", 'Pending' AS "Status" FROM documents"""


@query(_DATASET)
def dataset_files(spark, sf_dir):
    """Records written as a dataset and read back."""
    path = scratch(spark, "dataset")
    datasets.write(_records(spark, sf_dir), path)
    return datasets.read(spark, path).select("PSA_ID", "Domain", "English", "Source", "Date", "Metadata", "Status")


_FLAT = "replace(replace({0}, chr(9), ' '), chr(10), ' ')"


@query(f"SELECT trim({_FLAT.format('text')}) AS en, role AS sw, count(*) AS n FROM conversations GROUP BY 1, 2")
def pair_files(spark, sf_dir):
    """Turns written as tab-separated pairs and read back."""
    path = scratch(spark, "pairs")
    flat = table(spark, sf_dir, "conversations").select(F.translate("text", "\t\n", "  "), "role")
    flat.write.options(sep="\t", quote="\u0000", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, extension="tsv").csv(path)
    return pairs.read_pairs(spark, path).groupBy("en", "sw").agg(F.count("*").alias("n"))


def _memory(spark, sf_dir, path: str, p: str = "", encoding: str = "UTF-8") -> None:
    """Turns written as units of translation memories; the kind of a unit is its turn's number modulo 8."""
    plain = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    kind = (F.col("conv_id") + F.col("turn")) % 8
    cdata = F.concat(F.lit("<![CDATA["), F.replace(F.col("text"), F.lit("]]>"), F.lit("]] >")), F.lit("]]>"))
    english = F.when(kind == 1, cdata).when(kind == 2, F.concat(F.lit("a & b "), plain)).when(kind == 3, F.concat(plain, F.lit("<br>"))).otherwise(plain)
    side = lambda lang, text: F.concat(F.lit(f"<{p}tuv {lang}><{p}seg>"), text, F.lit(f"</{p}seg></{p}tuv>"))
    swahili = F.when(kind != 4, side('xml:lang="sw"', F.col("role"))).otherwise("")
    lead = F.when(kind == 5, F.lit(f"<{p}tu><{p}tuv>left open ")).when(kind == 6, F.lit(f"<!-- <{p}tu></{p}tu> -->")).otherwise("")
    unit = F.concat(lead, F.lit(f'<{p}tu tuid="x">'), side('xml:lang="EN-us"', english), swahili, F.lit(f"</{p}tu>"))
    head = F.lit(f'<?xml version="1.0" encoding="{encoding}"?><{p}tmx><{p}body>')
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.when(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0, head).otherwise(""), unit).alias("value"))
    rows.write.option("encoding", encoding).text(path)


_GOOD = "(conv_id + turn) % 8 NOT IN (2, 3, 4)"


@query(f"SELECT {norm('text')} AS en, role AS sw, count(*) AS n FROM conversations WHERE {_GOOD} GROUP BY 1, 2")
def memory_scan(spark, sf_dir):
    """Units of all kinds written and read back: plain, with character data, not well-formed, without a second side, behind one left open, behind a comment."""
    path = scratch(spark, "memory")
    _memory(spark, sf_dir, path)
    return pairs.tmx(spark, path).groupBy("en", "sw").agg(F.count("*").alias("n"))


@query(f"SELECT {norm('text')} AS en, role AS sw, count(*) AS n FROM conversations WHERE {_GOOD} GROUP BY 1, 2")
def memory_scan_prefixed(spark, sf_dir):
    """The same with a namespace prefix on every element."""
    path = scratch(spark, "memory")
    _memory(spark, sf_dir, path, "t:")
    return pairs.tmx(spark, path).groupBy("en", "sw").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT (conv_id + turn) % 8 AS kind FROM conversations)
SELECT count(*) FILTER (kind NOT IN (2, 3, 4)) AS pairs, count(*) FILTER (kind = 4) AS one_sided, count(*) FILTER (kind IN (2, 3, 5)) AS bad FROM k""")
def memory_problems(spark, sf_dir):
    """What a scan found: pairs, units with one side, units that could not be parsed."""
    path = scratch(spark, "memory")
    _memory(spark, sf_dir, path)
    bad, pair = F.col("problem").isNotNull(), F.col("en").isNotNull() & F.col("sw").isNotNull()
    return pairs.tmx_units(spark, path).agg(F.count_if(pair).alias("pairs"), F.count_if(~bad & ~pair).alias("one_sided"), F.count_if(bad).alias("bad"))


@query(f"WITH {CLEAN} " + " UNION ALL ".join(f"SELECT '{k}' AS stage, count(*) AS n FROM {v}" for k, v in STAGE_TABLES.items()) + f" UNION ALL SELECT 'removed_total', (SELECT count(*) FROM recs) - (SELECT count(*) FROM c_out)")
def clean_counts(spark, sf_dir):
    """The counts that cleaning observes while its rows are written once; seven rows and their difference."""
    out, counts = cleaning.clean(recs(spark, sf_dir), ORDER, lambda c: F.col("lang"), stats=True, detect_sw=lambda c: F.col("sw_lang"))
    saved(out, "cleaned")
    return spark.createDataFrame(list(counts().items()), "stage string, n long")


SITE = {"name": "own", "domain": "Road Safety", "source": "Own", "start_urls": [], "link_patterns": [], "content_selectors": SELECTORS, "max_pages": 15, "split_sentences": True, "verify_ssl": True, "min_words": 7, "max_records": 200, "pagination": None}


@query(f"""WITH {PAGE_SENTS},
got AS (SELECT page_id, block, unit, url, s.text FROM pages JOIN psents s USING (page_id) WHERE {n_words('s.text')} BETWEEN 7 AND 80 AND NOT {boiler('s.text')}),
uniq AS (SELECT * FROM got QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY page_id, block, unit) = 1)
SELECT 'Security' AS domain, text AS english, 'Own' AS source, url, '{{"type": "scraped", "tool": "html.parser", "site": "own"}}' AS metadata FROM uniq ORDER BY page_id, block, unit LIMIT 200""")
def collect_site(spark, sf_dir):
    """Records of one site whose start addresses are those of all pages: their sentences, each once, capped as the site says."""
    pages = table(spark, sf_dir, "pages")
    starts = pages.select(F.lit("own").alias("name"), F.col("page_id").alias("ordinal"), "url")
    found = html.collect(pages, html.site_table(spark, [SITE]), starts, "2024-01-01")
    return found.select(F.col("Domain").alias("domain"), F.col("English").alias("english"), F.col("Source").alias("source"), F.col("URL").alias("url"), F.col("Metadata").alias("metadata"))


WORLD = f"""{PAGE_SENTS},
link AS (SELECT n, 'http://s' || n || '.example' || replace(href, '&amp;', '&') AS href, min(pos) AS pos FROM (SELECT page_id // 20 AS n, unnest(range(len(h))) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages WHERE page_id % 20 = 0)) GROUP BY ALL),
hit AS (SELECT * FROM link WHERE n % 3 <> 2 AND (regexp_matches(href, '/[a-f][^/]*$') OR regexp_matches(href, '/[n-t][^/]*$')) QUALIFY row_number() OVER (PARTITION BY n ORDER BY pos) <= 2 + n % 3),
content AS (SELECT n, pos, href AS url, page_id FROM hit JOIN pages ON page_id // 20 = n AND page_id % 20 = pos + 1 UNION ALL SELECT page_id // 20 AS n, -1, 'http://s' || page_id // 20 || '.example/', page_id FROM pages WHERE page_id % 20 = 0 AND page_id // 20 % 3 = 2),
unit AS (SELECT n, pos, url, block, unit, text FROM content JOIN psents USING (page_id) WHERE n % 2 = 0 UNION ALL SELECT n, pos, url, block, 0, text FROM content JOIN blocks USING (page_id) WHERE n % 2 = 1),
once AS (SELECT * FROM unit WHERE {n_words('text')} BETWEEN 4 + n % 4 AND 80 AND NOT {boiler('text')} QUALIFY row_number() OVER (PARTITION BY n, lower(text) ORDER BY pos, block, unit) = 1)"""


@query(f"""WITH {WORLD}
SELECT 's' || n AS site, pos AS link, block, unit, CASE n % 3 WHEN 0 THEN 'Health' WHEN 1 THEN 'Security' ELSE 'Education' END AS domain, text AS english, url FROM once QUALIFY n % 4 = 0 OR row_number() OVER (PARTITION BY n ORDER BY pos, block, unit) <= 10""")
def collect_sites(spark, sf_dir):
    """A site for each twenty pages: the first is its listing, the others stand where the listing's links lead. Patterns, selectors and limits differ by site, and all are collected in one plan."""
    pages = table(spark, sf_dir, "pages").withColumn("n", F.floor(F.col("page_id") / 20))
    base = F.concat(F.lit("http://s"), F.col("n").cast("string"), F.lit(".example/"))
    first = pages.where("page_id % 20 = 0").withColumn("url", base)
    links = html.parsed(first.select("n", "url", "html"), ()).select("n", F.posexplode("links").alias("pos", "href")).groupBy("n", "href").agg(F.min("pos").alias("pos"))
    rest = pages.where("page_id % 20 > 0").select("n", (F.col("page_id") % 20 - 1).alias("pos"), "html").join(links, ["n", "pos"]).select(F.col("href").alias("url"), "html")
    n = F.col("n")
    some = lambda *x: F.array(*map(F.lit, x))
    sites = first.select(
        F.concat(F.lit("s"), n.cast("string")).alias("name"), F.when(n % 3 == 0, "Health").when(n % 3 == 1, "Road Safety").otherwise("Education").alias("domain"), F.lit("made").alias("source"), F.array("url").alias("start_urls"),
        F.when(n % 3 == 2, F.array().cast("array<string>")).otherwise(some("/[a-f][^/]*$", "/[n-t][^/]*$")).alias("link_patterns"), some("!bad", *SELECTORS).alias("content_selectors"), (2 + n % 3).cast("int").alias("max_pages"),
        (n % 2 == 0).alias("split_sentences"), F.lit(True).alias("verify_ssl"), (4 + n % 4).cast("int").alias("min_words"), F.when(n % 4 != 0, 10).alias("max_records"), F.lit(None).cast("struct<template: string, start: int, pages: int>").alias("pagination"),
    )
    found = html.collect(first.select("url", "html").unionByName(rest), sites, date="2024-01-01")
    return found.select(F.col("_site").alias("site"), F.col("_link").alias("link"), F.col("_block").alias("block"), F.col("_unit").alias("unit"), F.col("Domain").alias("domain"), F.col("English").alias("english"), F.col("URL").alias("url"))

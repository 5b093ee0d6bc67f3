"""Queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import archives, codec, counts, intervals, jaccard, lattice, merkle, packing, pivots, quality, records, secrets, toxicity
from millrace.llm.common import fold, scratch, table
from millrace.plans.duck import crc32


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.documents(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans with one store: of four fifths of the paths, then of all, which scans the texts that the first did not see."""
    docs, store = table(spark, sf_dir, "documents"), scratch(spark, "secrets")
    secrets.scan(docs.where(F.coalesce(fold() != 0, F.lit(True))), store)
    return secrets.find(docs, store)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.export(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_archive_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages"))


def op13_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, lines, clicks = (table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clicks"))
    return intervals.join(sales, lines, clicks)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_lattice_score": op4_lattice_score,
    "op5_secret_scans": op5_secret_scans,
    "op6_token_records": op6_token_records,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_archive_converter": op12_archive_converter,
    "op13_interval_overlap": op13_interval_overlap,
}

REACH = "both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link), reach(id, far) AS (SELECT a, b FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.far = e.a)"
LINKED = "least({0}, coalesce((SELECT min(far) FROM reach WHERE id = {0}), {0}))"

OP3 = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
item AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS i FROM item a JOIN item b USING (x) WHERE a.doc_id < b.doc_id AND 3 * greatest(a.n, b.n) <= 4 * least(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM met WHERE 100 * i >= 75 * (n - i)),
{REACH},
class AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, {LINKED.format("doc_id")} AS component_id, coalesce(rep, doc_id) AS class_id FROM sets LEFT JOIN class ON list_sort(sets.s) = class.s"""

OP7 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE FALSE END),
{REACH},
named AS (SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, {LINKED.format("vec_id")} AS component_id FROM v)
SELECT vec_id, n_links, component_id, coalesce(vec_id = component_id, FALSE) AS kept FROM named"""


def _spans(rank: int, rule: secrets.Rule) -> str:
    """Matches of a rule with their places. What gives nothing back in Java's patterns, and what may not stand before, is said in RE2's way."""
    p = rule.pattern.replace("++", "+").replace("*+", "*").replace("}+", "}").replace("'", "''")
    lead = p.startswith("(?<!")
    if lead:
        before, _, rest = p.removeprefix("(?<!").partition(")")
        p = f"(^|{before.replace('[', '[^', 1)})({rest})"
    group = 2 if lead else rule.group
    start = "e - length(hit)" + (" + length(hit) - length(value)" if lead else "")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, {start} AS s, e FROM (SELECT doc_id, hit, value, sum(length(gap) + length(coalesce(hit, ''))) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM
(SELECT doc_id, unnest(range(len(g))) AS i, unnest(g) AS gap, unnest(list_resize(h, len(g))) AS hit, unnest(list_resize(v, len(g))) AS value FROM
(SELECT doc_id, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {group}) AS v FROM d WHERE regexp_matches(t, '{p}')))) WHERE hit IS NOT NULL AND length(value) >= {rule.least}"""


_BASE = [r.kind for r in secrets.RULES if r.base]
_LIST = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e){0}, '')"
OP5 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(_spans(k, r) for k, r in enumerate(secrets.RULES))})
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE)}, sha256({_LIST.format(" FILTER (rank < " + str(len(_BASE)) + ")")}) AS base_sha256, {_LIST.format("")} AS spans FROM d LEFT JOIN found USING (doc_id) GROUP BY doc_id"""



def _leaf(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in merkle.FIELDS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in fields) + ")"


_UP = "list_transform(range(0, (len(a) + 2) // 3), lambda i: sha256(array_to_string(a[3 * i + 1:3 * i + 3], '')))"
_SIDE = "{{'l': array_to_string(a[{0} - {0} % 3 + 1:{0}], ''), 'r': array_to_string(a[{0} + 2:{0} - {0} % 3 + 3], ''), 'v': ''}}"
OP11 = f"""WITH RECURSIVE row AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS tampered FROM documents),
level(source, k, a) AS (SELECT source, 0, list(leaf ORDER BY doc_id NULLS FIRST, leaf) FROM row GROUP BY source UNION ALL SELECT source, k + 1, {_UP} FROM level WHERE len(a) > 1),
sub AS (SELECT source, a[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM level WHERE len(a) = 1),
top(k, a) AS (SELECT 0, list(subroot ORDER BY i) FROM sub UNION ALL SELECT k + 1, {_UP} FROM top WHERE len(a) > 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM row),
own AS (SELECT p.source, p.i, list({_SIDE.format("(p.i // CAST(3 ** k AS BIGINT))")} ORDER BY k) FILTER (len(a) > 1) AS way FROM placed p JOIN level v ON p.source IS NOT DISTINCT FROM v.source GROUP BY 1, 2),
far AS (SELECT source, list({_SIDE.format("(s.i // CAST(3 ** k AS BIGINT))")} ORDER BY k) FILTER (len(a) > 1) AS way FROM sub s CROSS JOIN top GROUP BY 1),
one AS (SELECT p.*, subroot, (SELECT a[1] FROM top WHERE len(a) = 1) AS root, list_concat(coalesce(o.way, []), coalesce(f.way, [])) AS way FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source JOIN own o ON p.source IS NOT DISTINCT FROM o.source AND p.i = o.i JOIN far f ON p.source IS NOT DISTINCT FROM f.source),
done AS (SELECT *, list_reduce(list_concat([{{'l': '', 'r': '', 'v': coalesce(tampered, leaf)}}], way), lambda x, y: {{'l': '', 'r': '', 'v': sha256(y.l || x.v || y.r)}}).v AS folded_root FROM one)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda x: x.l || x.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done"""

OP12 = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS target FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM target THEN target END AS refers_to FROM last"""

_SLOT = "CAST(floor(epoch_us({0}) // 3600000000) AS BIGINT)"
OP13 = f"""WITH click AS (SELECT client_id, ts, bool_or(kind IS NOT DISTINCT FROM 'purchase') AS buy FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM click WINDOW w AS (PARTITION BY client_id ORDER BY ts)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY ts) AS k FROM gaps),
session AS (SELECT client_id, min(ts) AS f, max(ts) AS l, max_by(buy, ts) AS open, CAST(epoch_us(min(ts)) AS VARCHAR) AS us FROM numbered GROUP BY client_id, k),
b AS (SELECT client_id, {_SLOT.format("f")} AS s, CASE WHEN open THEN 'Infinity'::DOUBLE ELSE {_SLOT.format("l")} END AS e, {crc32("us")} AS crc FROM session),
line AS (SELECT sale_id, max(shipped_at) AS sent, bool_or(shipped_at IS NULL) AS unsent FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY 1),
a AS (SELECT sale_id, client_id, {_SLOT.format("sold_at")} AS s, CASE WHEN unsent THEN 'Infinity'::DOUBLE ELSE {_SLOT.format("greatest(sold_at, coalesce(sent, sold_at))")} END AS e FROM sales LEFT JOIN line USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
pair AS (SELECT sale_id, CASE WHEN a.s > b.s THEN CASE WHEN a.e < b.e THEN 'during' WHEN a.e = b.e THEN 'finishes' ELSE 'overlapped_by' END WHEN a.s = b.s THEN CASE WHEN a.e < b.e THEN 'starts' WHEN a.e = b.e THEN 'equals' ELSE 'started_by' END
ELSE CASE WHEN a.e < b.e THEN 'overlaps' WHEN a.e = b.e THEN 'finished_by' ELSE 'contains' END END AS relation, CASE WHEN isfinite(least(a.e, b.e)) THEN least(a.e, b.e) - greatest(a.s, b.s) + 1 END AS shared, crc FROM a JOIN b ON a.client_id = b.client_id AND a.s <= b.e AND b.s <= a.e)
SELECT sale_id, relation, count(*) AS n_pairs, CAST(sum(shared) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc FROM pair GROUP BY 1, 2"""

ORACLE = {"op3_ngram_jaccard": OP3, "op5_secret_scans": OP5, "op7_embedding_dedup": OP7, "op11_merkle_manifest": OP11, "op12_archive_converter": OP12, "op13_interval_overlap": OP13}

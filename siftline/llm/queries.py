"""Registered queries of this package, each over its whole table, next to the SQL that checks them where SQL can."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.llm import bpe, chat_format, exact_dedup, fingerprints, language_id, lexical_search, license_scan, near_dedup, packing, prefix_trie, quality, suffix_dedup, warc_zip
from siftline.llm.license_scan import BASE, MARK, TEMPLATES, WORD

QUERIES, ORACLES = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: license scan ------------------------------------------------------------------------------


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def _expression(template: str) -> str:
    """The template as a regular expression over words that each end with a space."""
    out = ""
    for part in MARK.split(template):
        if part == "optional":
            out += "("
        elif part == "/optional":
            out += ")?"
        elif part.startswith("any:"):
            out += f"([^ ]+ ){{0,{part[4:]}}}"
        else:
            out += "".join(f"{w} " for w in WORD.findall(part))
    return out


def _license_sql() -> str:
    tests = [(label, phrase, True) for phrase, label in BASE.items()] + [(label, t, False) for label, t in TEMPLATES]
    rows = ", ".join(
        f"({i}, '{label}', '^{_expression(t)}', {str(base).lower()}, '{first}', {len(WORD.findall(MARK.sub(' ', t))) + sum(map(int, re.findall(r'any:([0-9]+)', t)))})"
        for i, (label, t, base) in enumerate(tests)
        for first in sorted(license_scan.compiled(label, t).first())
    )
    return f"""
WITH rules(rule, label, expression, base, first, most) AS (VALUES {rows}),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(len(w))) AS i, w FROM words),
near AS (SELECT doc_id, i, label, base, expression, array_to_string(w[i + 1 : i + most], ' ') || ' ' AS s
  FROM (SELECT * FROM places WHERE w[i + 1] IN (SELECT first FROM rules)) p JOIN rules ON p.w[i + 1] = first),
found AS (SELECT doc_id, i, label, base, len(regexp_extract(s, expression)) - len(replace(regexp_extract(s, expression), ' ', '')) AS n FROM near WHERE regexp_matches(s, expression)),
inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
each AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(inside.n / len(w), 0.0)::DOUBLE AS score
FROM words LEFT JOIN each USING (doc_id) LEFT JOIN inside USING (doc_id)"""


ORACLES["op1_license_scan"] = _license_sql()


# --- 2: language ----------------------------------------------------------------------------------


@query
def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(table(spark, sf_dir, "documents"))


# --- 3: near-duplicates ---------------------------------------------------------------------------


@query
def op3_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


ORACLES["op3_bbit_minhash"] = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d, y FROM reached JOIN sides ON r = x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN reached ON d = doc_id GROUP BY doc_id, n"""


# --- 4: packing -----------------------------------------------------------------------------------


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


# --- 5: WARC --------------------------------------------------------------------------------------


@query
def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_round_trip(spark, table(spark, sf_dir, "pages"))


ORACLES["op5_warc_zip"] = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
firsts AS (SELECT page_id, p, strlen(p) AS n, CASE WHEN strlen(p) >= 100 THEN min(page_id) OVER (PARTITION BY p) END AS first FROM payloads)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(p) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts"""


# --- 6: byte-level BPE ----------------------------------------------------------------------------


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


# --- 7: suffix arrays -----------------------------------------------------------------------------


@query
def op7_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


ORACLES["op7_previous_factors"] = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
parts AS (SELECT doc_id, c, substr(x, 1000 * c + 1, 1098) AS part FROM (SELECT doc_id, x, unnest(range(0, len(x) // 1000 + 1)) AS c FROM texts)),
strings AS MATERIALIZED (SELECT doc_id, 500 * c + j AS i, substr(part, 2 * j + 1, 100) AS g FROM (SELECT doc_id, c, part, unnest(range(0, least(500, len(part) // 2 - 49))) AS j FROM parts)),
firsts AS (SELECT g, min(doc_id) AS d FROM strings GROUP BY g HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 < i, true) AS fresh FROM strings JOIN firsts USING (g) WHERE doc_id > d),
numbered AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM numbered GROUP BY doc_id, run),
pieces AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM runs),
each AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS upto, string_agg(substr(x, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS kept FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN each USING (doc_id)"""


# --- 8: fingerprints ------------------------------------------------------------------------------


@query
def op8_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


# --- 9: chat formatting ---------------------------------------------------------------------------


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = chat_format.format_chats(turns)
    back, loss = chat_format.read_back(F.col("formatted")), chat_format.loss_text(F.col("segments"))
    # The rows are generated once, so that the parsed turns are computed once.
    read = chats.select("conv_id", "valid", F.length("formatted").cast("bigint").alias("formatted_chars"), F.explode(F.array(F.struct(back.alias("turns"), loss.alias("loss")))).alias("r"))
    lines = F.array_join(F.transform("r.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("r.turns").cast("bigint").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("r.loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("r.loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "valid",
    )


def _chat_sql() -> str:
    t = chat_format.INSTRUCT
    more = lambda text: f"len(replace({text}, '\\', '')) + 2 * (len({text}) - len(replace({text}, '\\', '')))" + "".join(f" + 2 * (len({text}) - len(replace({text}, '{c}', ''))) // {len(c)}" for c in t.controls)
    marks = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in t.turns.items())
    moves = ", ".join(f"'{a}>{b}'" for a, to in t.moves.items() for b in to)
    ends = ", ".join(f"'{e}'" for e in sorted(t.ends))
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
moved AS (SELECT *, coalesce(lag(role) OVER w, 'start') || '>' || role AS move, last_value(role) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ending FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({more("text")} + CASE role {marks} ELSE {sum(map(len, t.other))} + {more("role")} END)::BIGINT AS formatted_chars,
  bool_and(move IN ({moves})) AND bool_and(ending IN ({ends})) AS valid
FROM moved GROUP BY conv_id"""


ORACLES["op9_chat_format"] = _chat_sql()


# --- 10: exact dedup ------------------------------------------------------------------------------


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op10_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


# --- 11: conversation prefix trie -----------------------------------------------------------------


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


# The CRC-32 of the decimal id, bit by bit: SQL has no function for it.
_CRC = "xor(list_reduce(list_concat([4294967295], [ascii(x)::BIGINT FOR x IN string_split(conv::VARCHAR, '')]), lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"
ORACLES["op11_prefix_trie"] = f"""
WITH turns AS (SELECT conv_id::BIGINT AS conv, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS nth FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv, list(said ORDER BY nth) AS own FROM turns GROUP BY conv),
heads AS (SELECT *, ({_CRC} % 6)::BIGINT AS h FROM convs),
rebuilt AS (SELECT c.conv, list_concat(coalesce(b.own, [])[1 : c.h], c.own[c.h + 1 :]) AS said FROM heads c LEFT JOIN convs b ON b.conv = c.conv - c.conv % 100),
prefixes AS (SELECT conv, d, sha256(said[1 : d]::VARCHAR || ' ' || d) AS node, sha256(said[1 : d - 1]::VARCHAR || ' ' || (d - 1)) AS above, len(said) = d AS ends, CASE WHEN d > 0 THEN len(said[d].t) ELSE 0 END AS chars
  FROM (SELECT conv, said, unnest(range(0, len(said) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT node, min(above) AS above, d, min(conv) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved, bool_or(true) AS one,
  sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY node, d),
children AS (SELECT above, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above),
each AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.above = n.node),
below AS (SELECT p.node, sum(e.saved) AS saved_tokens, count(*) FILTER (e.n_children = 0) AS n_leaves FROM each e JOIN prefixes p ON p.conv = e.conv_id AND p.d <= e.d GROUP BY p.node)
SELECT e.conv_id, e.d::BIGINT AS depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, e.ends_sha256
FROM each e JOIN below USING (node) LEFT JOIN nodes u ON u.node = e.above AND e.d > 0"""


# --- 12: quality ----------------------------------------------------------------------------------


@query
def op12_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# --- 13: ranked lexical search --------------------------------------------------------------------


@query
def op13_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLES["op13_max_sketch_search"] = f"""
WITH counts AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS t FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, t),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
asked AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE text IS NOT NULL)),
weights AS (SELECT t, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM counts WHERE t IN (SELECT t FROM asked) GROUP BY t), totals),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN counts USING (t) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50"""

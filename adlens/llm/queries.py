"""The registered queries of the training-data operators and their DuckDB SQL.

Every query runs its operator with production parameters over the whole
intended table. Oracles exist where SQL can state the result.
"""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm import bpe, chat, jaccard, langid, lines, lm, mixing, neardup, periods, phrases, secrets, substrings, topk
from adlens.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


@query("op1_ngram_jaccard")
def op1(spark, sf_dir):
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


ORACLES["op1_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(words[i:i + 3], 'string_agg', ' ') AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 2, 2))) AS i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle)
         WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = doc_id GROUP BY doc_id
"""


@query("op2_mix_sources")
def op2(spark, sf_dir):
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


ORACLES["op2_mix_sources"] = """
WITH keyed AS (
  SELECT *, md5(concat_ws(',', coalesce(md5(doc_id::VARCHAR), ''), coalesce(md5(text), ''), coalesce(md5(lang), ''),
                          coalesce(md5(source), ''), coalesce(md5(n_chars::VARCHAR), ''))) AS content
  FROM documents),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS total, sum(sqrt(n)) AS weight FROM n),
rates AS (SELECT source, sqrt(n.n) * t.total / t.weight / n.n AS rate FROM n, t),
rows AS (  -- equal rows draw together, at their joint rate
  SELECT any_value(keyed) AS doc, content, count(*) AS m, any_value(rate) * count(*) AS rate,
         greatest(ceil(any_value(rate) * count(*) / 16), 1)::INT AS splits
  FROM keyed JOIN rates ON keyed.source IS NOT DISTINCT FROM rates.source GROUP BY content),
mass AS (
  SELECT rate, k, exp(-rate / splits + k * ln(rate / splits) - coalesce(lgamma(k + 1), 0)) AS p
  FROM (SELECT DISTINCT rate, splits FROM rows), range(0, 81) r(k)),
cdf AS (SELECT rate, k, sum(p) OVER (PARTITION BY rate ORDER BY k) AS c FROM mass),
draws AS (
  SELECT doc, content, m, rate, splits, j, ('0x' || substr(md5('17:' || content || ':' || j), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM (SELECT *, unnest(range(1, splits + 1)) AS j FROM rows)),
counts AS (SELECT *, (SELECT count(*) FROM cdf WHERE cdf.rate = draws.rate AND c <= u)::INT AS n FROM draws),
copies AS (
  SELECT any_value(doc) AS doc, content, unnest(range(1, sum(n)::BIGINT + 1)) AS copy FROM counts WHERE m = 1 GROUP BY content
  UNION ALL SELECT doc, content, unnest([j + splits * i FOR i IN range(0, n)]) FROM counts WHERE m > 1)
SELECT doc.doc_id, doc.text, doc.lang, doc.source, doc.n_chars, copy AS mix_copy,
       ('0x' || substr(md5('17:' || content || ':' || copy), 1, 15))::BIGINT AS mix_key
FROM copies
"""


@query("op3_exact_top_k")
def op3(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(x::DOUBLE * 1024)::BIGINT FOR x IN embedding] AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_sum([p[1] * p[2] FOR p IN list_zip(q.vec, v.vec)])::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scores QUALIFY rank <= 10
"""


@query("op4_language_id")
def op4(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", langid.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@query("op5_embedding_near_dups")
def op5(spark, sf_dir):
    return neardup.near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLES["op5_embedding_near_dups"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.vec, b.vec) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, min(reach.b) AS component_id,
       min(reach.b) = vec_id AS kept
FROM v JOIN reach ON reach.a = vec_id GROUP BY vec_id
"""


@query("op6_secret_ledger")
def op6(spark, sf_dir):
    found = secrets.scan_versions(read(spark, sf_dir, "documents"), path_col="doc_id")

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    text = secrets.span_text(F.col("spans"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"),
                        F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))


def _duck_spans(kind: str, rank: int, pattern: str, ok: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, len_before AS s, len_before + length(m) AS e
  FROM (SELECT doc_id, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS len_before
        FROM (SELECT doc_id, unnest(hits) AS m, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i
              FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{quoted}') AS hits,
                           string_split_regex(coalesce(text, ''), '{quoted}') AS gaps FROM documents)))
  WHERE {ok}"""


_ASSIGN = secrets.RULES[0].pattern
ORACLES["op6_secret_ledger"] = "WITH spans AS (" + " UNION ALL ".join([
    _duck_spans("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8"),
    _duck_spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 16"),
    _duck_spans("hex", 2, "[0-9a-f]+", "length(m) >= 32")]) + """),
all_spans AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN all_spans USING (doc_id)
"""


@query("op7_attention_lm")
def op7(spark, sf_dir):
    return lm.score_texts(read(spark, sf_dir, "documents"), langid.held_out("doc_id", 10, 0),
                          rank_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


@query("op8_substring_dedup")
def op8(spark, sf_dir):
    kept = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op8_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
wins AS (
  SELECT doc_id, i, list_aggregate(words[i:i + 34], 'string_agg', ' ') AS win
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 33)) AS i) WHERE len(words) >= 35),
again AS (SELECT win FROM wins GROUP BY win HAVING count(*) > 1),
starts AS (SELECT doc_id, i FROM wins JOIN again USING (win)),
gone AS (SELECT doc_id, i + max_back AS place FROM starts, LATERAL (SELECT unnest(range(0, 35)) AS max_back)),
places AS (SELECT DISTINCT doc_id, place FROM gone),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM each ANTI JOIN places USING (doc_id, place)
         GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op9_chat_rotations")
def op9(spark, sf_dir):
    rows = chat.rotate_perspectives(read(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "perspective", "part", "n_turns", "start", "chat", chat.mask_text(F.col("mask")).alias("mask"))


ORACLES["op9_chat_rotations"] = """
WITH t AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') AS text
  FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
said AS (
  SELECT t.conv_id, perspective, speaker, text,
         row_number() OVER whole - 1 AS number,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
                                ELSE 'user name=' || speaker END || chr(10) AS head
  FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id
  WINDOW whole AS (PARTITION BY t.conv_id, perspective ORDER BY turn NULLS LAST, speaker, text)),
placed AS (
  SELECT *, sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY number) - 1 AS e FROM said)
SELECT conv_id, perspective, number // 64 AS part, count(*)::INT AS n_turns,
       min(e - length(text) - 10 - length(head))::BIGINT AS start,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY number) AS chat,
       coalesce(string_agg((e - length(text) - 10) || ':' || e, ',' ORDER BY number) FILTER (speaker = perspective), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""


@query("op10_byte_bpe")
def op10(spark, sf_dir):
    return bpe.token_digests(read(spark, sf_dir, "documents"),
                             rank_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             pattern=public_tokenizers.PATTERN)


@query("op11_phrase_collocations")
def op11(spark, sf_dir):
    return phrases.collocations(read(spark, sf_dir, "documents"))


ORACLES["op11_phrase_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (SELECT lang, unnest(pieces) AS piece FROM p)),
grams AS (
  SELECT lang, 1 AS size, unnest(words) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) FROM w
  UNION ALL SELECT lang, 3, unnest([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT *, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:size], ' ') AS tail
  FROM (SELECT lang, size, phrase, a, ws, unnest(range(1, size)) AS k FROM cand)),
scored AS (
  SELECT cuts.lang, cuts.size, cuts.phrase, a, k, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM cand WHERE size = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN inside USING (lang, phrase) JOIN total USING (lang)
WHERE NOT coalesce(100 * longer >= 50 * a, FALSE)
QUALIFY rank <= 2000
"""


def _planted_periods(id_col: str, text_col: str) -> F.Column:
    """The text whose words from some place on repeat with a period, for one id in ten."""
    text = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(lines.SPACE))
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def cycled(words, a, p):
        return F.transform(F.sequence(F.lit(0), F.size(words) - 1),
                           lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p)))

    # names of a lambda hold each value once: the words, where the repetition starts, its period
    words = F.split(text, r"[\x20\x09-\x0D]+", -1)
    with_a = F.transform(F.array(F.struct(words.alias("w"), g.alias("g"))),
                         lambda s: F.struct(s["w"].alias("w"), (s["g"] % F.size(s["w"])).cast("int").alias("a"), s["g"].alias("g")))
    with_p = F.transform(with_a, lambda s: F.struct(s["w"].alias("w"), s["a"].alias("a"), (
        1 + F.floor((F.size(s["w"]) - s["a"]) / (3 + s["g"] % 8))).cast("int").alias("p")))
    planted = F.element_at(F.transform(with_p, lambda s: F.array_join(cycled(s["w"], s["a"], s["p"]), " ")), 1)
    return F.when((h % 10 == 0) & (text != ""), planted).otherwise(F.col(text_col))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", _planted_periods("doc_id", "text").alias("text"))
    found = periods.periodic_runs(docs)
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op13_line_dedup")
def op13(spark, sf_dir):
    kept = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op13_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
owners AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, coalesce(owner <> doc_id, FALSE) AS gone FROM k LEFT JOIN owners USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


QUERIES["pipeline"] = corpus_pipeline.run

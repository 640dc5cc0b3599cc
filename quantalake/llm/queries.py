"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalake.llm.common import load, scratch, stored


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantalake.llm.linedup import line_dedup

    kept = line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quantalake.llm.tokenfiles import read_token_files, write_token_files

    out = scratch(spark, "tokens")
    write_token_files(load(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, out)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quantalake.llm.packing import pack

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantalake.llm.fingerprint import fingerprints

    return fingerprints(load(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantalake.llm.neardup import near_duplicates

    classes = near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "n_shingles", "component_id", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantalake.llm.substring import substring_dedup

    kept = substring_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantalake.llm.quality import fit, score

    docs = load(spark, sf_dir, "documents")
    return score(docs, fit(docs, load(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantalake.llm.langid import fit, identify

    docs = load(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantalake.llm.decontam import leaks

    found = leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").cast("long").alias("n_tiles"))


def op10_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantalake.llm.chat import REPLY, conversation_calls, link_tool_calls

    calls, results = conversation_calls(load(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, REPLY)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantalake.llm.convrepair import damage, digests, repair

    report, repaired = repair(damage(load(spark, sf_dir, "conversations")), copies_col="copies")
    found = digests(repaired).withColumnRenamed("conv_id", "k")
    both = report.join(found, F.col("conv_id").eqNullSafe(F.col("k")), "left").drop("k")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantalake.llm.pagetext import page_texts

    return page_texts(load(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantalake.llm.vectorcodes import label_errors, vector_codes

    codes, books = vector_codes(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    found = label_errors(stored(codes, "codes"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_fingerprints": op4_fingerprints,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_files": op9_token_files,
    "op10_chat_tool_calls": op10_chat_tool_calls,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_page_text": op12_page_text,
    "op13_vector_codes": op13_vector_codes,
}


def _crc(text: str) -> str:
    """crc32 of an ASCII text, where the table ``crc_table`` has been joined."""
    codes = f"[ord(c_) FOR c_ IN string_split({text}, '')]"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, x: xor(c >> 8, v[1 + (xor(c, x) & 255)])), 4294967295)"


#: The table of crc32, by eight steps of a bit, as CTEs.
CRC_TABLE = ",\n".join(["crc_0 AS (SELECT i, i AS c FROM range(256) t(i))", *[f"crc_{k} AS (SELECT i, xor(c >> 1, 3988292384 * (c & 1)) AS c FROM crc_{k - 1})" for k in range(1, 9)], "crc_table AS (SELECT list(c ORDER BY i) AS v FROM crc_8)"])


def _way(*ways: tuple[str, int | str, str]) -> str:
    """The least of states after an edit: (state, cost, letter)."""
    return "list_min([" + ", ".join(f"{{'c': {s}.c + {c}, 'a': {s}.a || {a}}}" for s, c, a in ways) + "])"


_USER, _ASSISTANT = ("CASE s WHEN 'u' THEN 0 ELSE 1 END + cut", "CASE s WHEN 'u' THEN 'K' ELSE 'R' END"), ("CASE s WHEN 'a' THEN 0 ELSE 1 END + cut", "CASE s WHEN 'a' THEN 'K' ELSE 'R' END")
#: The cheapest edits row by row: what turns may be inserted before a row, then what may become of it.
REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
had AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS how FROM conversations, crc_table),
hurt AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, how FROM had WHERE how <> 0),
twice AS (SELECT conv_id, turn, role, text FROM hurt UNION ALL SELECT conv_id, turn, role, text FROM hurt WHERE how = 3),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM twice),
faults AS (SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
left(role, 1) AS s, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank')::BIGINT AS blank, count(*) FILTER (WHERE fault = 'duplicate')::BIGINT AS duplicate,
count(*) FILTER (WHERE fault = 'truncated')::BIGINT AS truncated, count(*) FILTER (WHERE i > 1 AND before || s NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM faults GROUP BY conv_id),
best AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 1000000000::BIGINT, 'a': ''}} AS s1, {{'c': 5::BIGINT, 'a': 'I'}} AS s2, {{'c': 10::BIGINT, 'a': 'II'}} AS s3 FROM (SELECT DISTINCT conv_id FROM faults)
UNION ALL SELECT conv_id, i, n0, n1, two, list_min([n3, {{'c': two.c + 5, 'a': two.a || 'I'}}]) FROM (
SELECT conv_id, i, n0, n1, list_min([n2, {{'c': n0.c + 5, 'a': n0.a || 'I'}}, {{'c': n1.c + 5, 'a': n1.a || 'I'}}, {{'c': n3.c + 5, 'a': n3.a || 'I'}}]) AS two, n3 FROM (
SELECT conv_id, i, {_way(("s0", 2, "'D'"))} AS n0,
CASE WHEN stays AND s = 's' THEN {_way(("s1", 2, "'D'"), ("s0", "cut", "'K'"))} ELSE {_way(("s1", 2, "'D'"))} END AS n1,
CASE WHEN stays THEN {_way(("s2", 2, "'D'"), *[(q, *_USER) for q in ("s0", "s1", "s3")])} ELSE {_way(("s2", 2, "'D'"))} END AS n2,
CASE WHEN stays THEN {_way(("s3", 2, "'D'"), ("s2", *_ASSISTANT))} ELSE {_way(("s3", 2, "'D'"))} END AS n3
FROM (SELECT b.conv_id, f.i, s0, s1, s2, s3, s, fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut
FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1)))),
ends AS (SELECT conv_id, list_min([s0, s3]) AS e FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
walk AS (SELECT conv_id, e.a AS audit, 0::BIGINT AS step, 0::BIGINT AS i, 'x' AS q, NULL::VARCHAR AS line FROM ends
UNION ALL SELECT w.conv_id, audit, step + 1, w.i + CASE edit WHEN 'I' THEN 0 ELSE 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN left(f.role, 1) ELSE goes END,
CASE edit WHEN 'D' THEN NULL WHEN 'K' THEN f.role || ':' || f.text ELSE CASE goes WHEN 'u' THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN f.text ELSE '' END END
FROM (SELECT *, audit[step + 1] AS edit, CASE q WHEN 'u' THEN 'a' ELSE 'u' END AS goes FROM walk WHERE step < length(audit)) w
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY step) AS t FROM walk GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _rounds(rounds: int = 4) -> str:
    """CTEs of Lloyd's rounds over ``own`` (vec_id, p, v) from ``book_0`` (p, e, v)."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"near_{n} AS (SELECT vec_id, p, any_value(x.v) AS v, min({{'d': list_sum([(x.v[i_] - b.v[i_]) * (x.v[i_] - b.v[i_]) FOR i_ IN range(1, len(x.v) + 1)])::BIGINT, 'e': e}}) AS m FROM own x JOIN book_{n} b USING (p) GROUP BY vec_id, p)")
        if n < rounds:
            steps.append(f"mean_{n} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY pos) AS v FROM (SELECT p, m.e AS e, pos, sum(v[pos])::BIGINT AS s, count(*) AS c FROM near_{n}, range(1, 1 + (SELECT max(len(v)) FROM own)) t(pos) GROUP BY p, m.e, pos) GROUP BY p, e)")
            steps.append(f"book_{n + 1} AS (SELECT p, e, coalesce(m.v, b.v) AS v FROM book_{n} b LEFT JOIN mean_{n} m USING (p, e))")
    return ",\n".join(steps)


CODES = f"""
WITH kept AS (SELECT vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
own AS (SELECT vec_id, p, v[1 + p * (len(v) // 4):(p + 1) * (len(v) // 4)] AS v FROM kept, range(4) t(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 256),
book_0 AS (SELECT p, e, v FROM own JOIN firsts USING (vec_id)),
{_rounds()},
codes AS (SELECT vec_id, string_agg(right('0' || lower(to_hex(m.e)), 2), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near_4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book_4) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
"""

SQL = {
    "op13_vector_codes": CODES,
    "op11_conversation_repair": REPAIR,
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
""",
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
          FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN sizes x ON u = x.doc_id JOIN sizes y ON v = y.doc_id
          WHERE 100 * common >= 75 * (x.n + y.n - common)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS doc_id, u AS r FROM edges UNION SELECT reach.doc_id, e.v FROM reach JOIN edges e ON reach.r = e.u),
least AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept
FROM sizes s LEFT JOIN least USING (doc_id)
""",
    "op8_substring_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+34], ' ')) AS h FROM starts JOIN words USING (doc_id)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS j FROM windows JOIN again USING (h), range(0, 35) t(k)),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words),
kept AS (SELECT e.doc_id, count(c.j)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY e.j) FILTER (WHERE c.j IS NULL) AS t
         FROM each_word e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.j = c.j GROUP BY e.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""",
    "op10_chat_tool_calls": r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, text FROM conversations WHERE role = 'user'),
results AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn AS result_turn, text AS content,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS LAST) AS nth
  FROM conversations WHERE role = 'assistant'),
nodes AS (SELECT DISTINCT conv_id, turn FROM calls),
levels AS (
  SELECT conv_id, turn, 0 AS level FROM nodes c
  WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, level + 1 FROM levels p JOIN nodes c ON c.conv_id = p.conv_id AND c.turn = p.turn + 2)
SELECT c.conv_id, c.turn, c.call_id, 'reply' AS name, r.result_turn, l.level,
       CASE WHEN c.text IS NULL THEN '$: text is missing' WHEN r.call_id IS NULL THEN 'no result' ELSE 'ok' END AS status,
       '{"arguments":{' || CASE WHEN c.text IS NULL THEN '' ELSE '"text":' || to_json(c.text)::VARCHAR || ',' END
       || '"turn":' || c.turn || '},"call_id":"' || c.call_id || '","name":"reply","result":'
       || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS json
FROM calls c JOIN levels l ON c.conv_id = l.conv_id AND c.turn = l.turn
LEFT JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id AND nth = 1
""",
}

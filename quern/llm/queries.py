"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bpe import bpe_round_trip
from quern.llm.conversation_repair import damaged, repair_conversations
from quern.llm.decontaminate import benchmark_leaks
from quern.llm.exact_dedup import exact_dedup
from quern.llm.jaccard_join import similar_sets
from quern.llm.language_id import language_id
from quern.llm.lm import lm_scores
from quern.llm.quality import fit_quality, score_quality
from quern.llm.sequence_patterns import click_events, sequence_patterns
from quern.llm.secrets import joined, of_kind, secret_scan
from quern.llm.substring_dedup import remove_repeats
from quern.llm.suffix_dedup import remove_seen_bytes
from quern.llm.token_output import token_files

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, white space aside: one row per row of `documents`, as exact_dedup() defines null, empty and repeated rows."""
    return exact_dedup(table(spark, sf_dir, "documents")).drop("content")


def fold(n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages; a row with a null id is never held out and never learned from. No row for an empty table."""
    got = language_id(table(spark, sf_dir, "documents"), fold(3) != 1)
    return got.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "distance", "rejected")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written to files in id order and read back by place: null texts have their end id alone, null ids come first."""
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), crc=True)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text; null texts count as empty, null and repeated ids are passed on."""
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), digest=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores; null texts count as empty, and where a label or all labels are missing every score is 0.5."""
    docs = table(spark, sf_dir, "documents")
    got = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), fold(4) != 2))
    return got.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts alike in their 4-word shingles; empty texts are alone, rows are judged by text where ids are null or repeat."""
    return similar_sets(table(spark, sf_dir, "documents"), k=4, num=85, den=100).drop("content")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of documents that benchmark items leak into; null and empty texts and items give no row."""
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removal of repeated 35-word passages leaves; rows are judged by text where ids are null or repeat."""
    return remove_repeats(table(spark, sf_dir, "documents"), window=35, digest=True).withColumnRenamed("kept", "kept_sha256")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that look like secrets; null texts have none, each row keeps its own where ids are null or repeat."""
    got = secret_scan(table(spark, sf_dir, "documents"))
    n = [F.size(of_kind(F.col("found"), o)).cast("long").alias(f"n_{k}") for o, k in enumerate(("assign", "access", "hex"))]
    base = joined(F.filter("found", lambda x: x["o"] < 3))
    return got.select("doc_id", *n, F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 scores; null texts are their end alone, rows with a null id are scored but not learned from."""
    got = lm_scores(table(spark, sf_dir, "documents"), fold(7) != 2)
    return got.select("doc_id", F.coalesce(fold(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of clicks and of what opens and shuts them; clicks without client, time or kind are left out, equal ones count once."""
    return sequence_patterns(click_events(table(spark, sf_dir, "clicks")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left without 50-byte strings that smaller ids have; null texts are empty, null ids come after all others."""
    return remove_seen_bytes(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repairs of damaged conversations; a null conv_id is one of its own, null roles and texts count as one space."""
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""


#: The words of each document, A-Z lower-cased or not.
_WORDS = r"SELECT doc_id, regexp_extract_all({}, '[^\x20\x09-\x0D]+') AS w FROM documents"

OP6_SQL = f"""
WITH RECURSIVE words AS ({_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

OP8_SQL = f"""
WITH words AS ({_WORDS.format("coalesce(text, '')")}),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
again AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


OP12_SQL = """
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, i, md5(b[i + 1:i + 50]) AS h FROM (SELECT doc_id, b, unnest(range(n - 49)) AS i FROM bytes)),
gone AS (SELECT doc_id, i FROM windows JOIN (SELECT h, min(doc_id) AS least FROM windows GROUP BY h) USING (h) WHERE doc_id > least),
begun AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true)::INTEGER AS new FROM gone),
spans AS (
  SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM begun) GROUP BY doc_id, k
),
pieces AS (
  SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM spans
),
left_of AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s)::BIGINT AS n_removed, max(e) AS last,
         string_agg(hex(b[before + 1:s]), '' ORDER BY s) AS kept FROM pieces JOIN bytes USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1:]))) AS kept_sha256
FROM bytes LEFT JOIN left_of USING (doc_id)
"""

#: crc32 of ASCII text: a table of the 256 bytes (`crc_bytes.known`), then a step a character.
_CRC_BYTES = "crc_bytes AS (SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) FOR n IN range(256)] AS known)"
_CRC = "xor(4294967295, list_reduce(list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c // 256, known[xor(c, x) % 256 + 1]), 4294967295::BIGINT))"

#: Of all ways to end at an event the latest start is kept, level by level.
_LONGER = """
level{n} AS (
  SELECT l.client_id, list_append(l.p, e.kind) AS p, e.t, max(l.begun) AS begun FROM level{before} l JOIN events e
  ON l.client_id = e.client_id AND e.t > l.t AND e.t <= l.t + 300000000 AND e.t <= l.begun + 450000000 GROUP BY ALL
)"""

OP11_SQL = f"""
WITH {_CRC_BYTES},
clicked AS (
  SELECT client_id, epoch_us(ts) AS t, kind, click_id IS NOT NULL AND {_CRC.format("coalesce(click_id, 0)::VARCHAR")} % 5 = 0 AS marked
  FROM clicks, crc_bytes WHERE client_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL
),
events AS (
  SELECT client_id, t, kind FROM clicked UNION SELECT client_id, t - 1000000, 'open' FROM clicked WHERE marked
  UNION SELECT client_id, t + 1000000, 'shut' FROM clicked WHERE marked
),
level1 AS (SELECT client_id, [kind] AS p, t, t AS begun FROM events),
{",".join(_LONGER.format(n=n, before=n - 1) for n in (2, 3, 4))},
supports AS (SELECT DISTINCT client_id, p FROM (FROM level1 UNION ALL FROM level2 UNION ALL FROM level3 UNION ALL FROM level4)),
clients_crc AS (SELECT client_id, {_CRC.format("client_id::VARCHAR")} AS crc FROM (SELECT DISTINCT client_id FROM events), crc_bytes),
kept AS (
  SELECT p, count(*) AS support, sum(crc)::BIGINT AS clients_crc FROM supports JOIN clients_crc USING (client_id) GROUP BY p
  HAVING count(*) >= 2 AND 100 * count(*) >= 3 * (SELECT count(*) FROM clients_crc)
),
parts AS (SELECT DISTINCT p AS longer, support, [p[i] FOR i IN range(1, len(p) + 1) IF (m >> (i - 1)) % 2 = 1] AS p FROM kept, range(1, 15) AS r(m) WHERE m < (1 << len(p)) - 1),
wider AS (SELECT p, support, count(DISTINCT longer) AS n FROM parts GROUP BY p, support)
SELECT array_to_string(p, '>') AS pattern, len(p)::INTEGER AS length, support, clients_crc, coalesce(n, 0) AS n_wider, n IS NULL AS closed
FROM kept LEFT JOIN wider USING (p, support)
"""

#: The best way {c: cost, a: audit, t: text} to each of four states, row by row; insertions stand before a row or at the end.
_NONE = "{'c': 1000000000, 'a': '', 't': ''}"
_STEP = "CASE WHEN {w}.c >= 1000000000 THEN {w} ELSE {{'c': {w}.c + {cost}, 'a': {w}.a || '{edit}', 't': {w}.t || {text}}} END"


def _step(w: str, cost: str, edit: str, text: str = "''") -> str:
    return _STEP.format(w=w, cost=cost, edit=edit, text=text)


def _row(w: dict[int, str]) -> list[str]:
    """What each state is after a row, from the states before it."""
    charge = "5 * (r.fault = 't')::INTEGER"
    keep = lambda q, initial: f"CASE WHEN left(r.role, 1) = '{initial}' THEN {_step(w[q], charge, 'K', turn)} ELSE {_NONE} END"
    turn = "r.role || ':' || r.text || chr(10)"
    say = lambda q, role: _step(w[q], f"1 + {charge}", "R", f"'{role}:' || r.text || chr(10)")
    stay = {1: [keep(0, "s")], 2: [keep(q, "u") for q in (0, 1, 3)] + [say(q, "user") for q in (0, 1, 3)], 3: [keep(2, "a"), say(2, "assistant")], 0: []}
    out = []
    for q in range(4):
        gone = _step(w[q], "2", "D")
        ways = f"list_min([{', '.join([gone, *stay[q]])}])" if stay[q] else gone
        out.append(f"CASE WHEN r.fault IN ('b', 'd') THEN {gone} ELSE {ways} END")
    return out


_USER, _ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"


def _ready() -> str:
    """The states with the insertions before a row: up to two of them lead from any state to any that can be said next."""
    one = {2: [_step(f"w{q}", "5", "I", _USER) for q in (0, 1, 3)], 3: [_step("w2", "5", "I", _ASSISTANT)]}
    first = {2: f"list_min([w2, {', '.join(one[2])}])", 3: f"list_min([w3, {', '.join(one[3])}])"}
    cols = f"SELECT *, {first[2]} AS x2, {first[3]} AS x3 FROM states"
    return f"SELECT * REPLACE (list_min([x2, {_step('x3', '5', 'I', _USER)}]) AS w2, list_min([x3, {_step('x2', '5', 'I', _ASSISTANT)}]) AS w3) FROM ({cols})"


OP13_SQL = rf"""
WITH RECURSIVE {_CRC_BYTES},
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations, crc_bytes
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(2) AS r(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
turns AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM placed
),
states AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS w0, {_NONE} AS w1, {_NONE} AS w2, {_NONE} AS w3 FROM turns
  UNION ALL
  SELECT r.conv_id, r.i, {", ".join(f"{x} AS w{q}" for q, x in enumerate(_row({q: f"s.w{q}" for q in range(4)})))}
  FROM ({_ready()}) s JOIN turns r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1
),
ended AS (
  SELECT conv_id, list_min([w0, w3, {_step("w2", "5", "I", _ASSISTANT)}, {_step("w1", "10", "II", _USER + " || " + _ASSISTANT)}]) AS w
  FROM states WHERE (conv_id, i) IN (SELECT (conv_id, max(i)) FROM turns GROUP BY conv_id)
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(w.t[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN ended USING (conv_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_jaccard_join": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op11_patterns": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_conversation_repair": OP13_SQL}

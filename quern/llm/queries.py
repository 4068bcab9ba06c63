"""The queries over the shared tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .secret_scan import RULES, plain_pattern

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import preference_rows

    return preference_rows(table(spark, sf_dir, "conversations"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import in_two_commits, report, scan_commit

    docs, ledger, findings = table(spark, sf_dir, "documents"), None, None
    for commit in in_two_commits(docs):
        ledger, findings = scan_commit(commit, ledger, findings)
    return report(docs, findings).drop("blob")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunks import chunk_dedup

    return chunk_dedup(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(marked, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    return manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": n_chars}).withColumnRenamed("id", "doc_id").drop("path")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encoded

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations")).drop("node")


QUERIES: dict[str, Query] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_secret_scan": op4_secret_scan,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_html_extraction": op6_html_extraction,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_content_defined_chunks": op9_content_defined_chunks,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_conversation_trie": op13_conversation_trie,
}


def _places_sql() -> str:
    """Places of all matches: lengths of the pieces between them, summed."""
    parts = []
    for rank, r in enumerate(RULES):
        pattern = plain_pattern(r).replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS v, regexp_split_to_array(text, '{pattern}') AS p FROM docs""")
    return " UNION ALL ".join(parts)


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch) >> b) & 1)))"
    steps = "lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), {steps}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
spots AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM spots),
least AS (SELECT g, min(doc_id) AS f FROM w GROUP BY g),
late AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN least USING (g) WHERE doc_id > f),
numbered AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM late),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
    UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, coalesce(2 * (y - x), length(h))), '' ORDER BY x) AS t FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)""",
    "op3_chat_formatting": """
WITH t AS (SELECT coalesce(conv_id, -9223372036854775808) AS conv, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
bag AS (SELECT conv, turn, list({'role': role, 'text': text} ORDER BY role, text) AS said FROM t GROUP BY conv, turn),
named AS (SELECT conv, turn, list({'turn': turn, 'said': said}) OVER (PARTITION BY conv ORDER BY turn) AS prefix FROM bag),
whole AS (SELECT conv, max(turn) AS last_turn, arg_max(prefix, turn) AS whole FROM named GROUP BY conv),
one AS (SELECT min(conv) AS conv FROM whole GROUP BY whole),
own AS (SELECT named.* FROM named JOIN one USING (conv)),
shared AS (SELECT prefix FROM own GROUP BY prefix HAVING count(*) > 1),
deepest AS (SELECT conv, max(turn) AS turn, arg_max(prefix, turn) AS prefix FROM own JOIN shared USING (prefix) GROUP BY conv),
able AS (SELECT conv, turn, prefix, substr(sha256(conv::VARCHAR), 1, 2) AS share FROM deepest JOIN whole USING (conv) WHERE turn < last_turn),
dealt AS (SELECT *, (row_number() OVER (PARTITION BY prefix, share ORDER BY conv) - 1) // 2 AS nth FROM able),
first_pairs AS (SELECT prefix, turn, min(conv) AS chosen, max(conv) AS rejected FROM dealt GROUP BY prefix, turn, share, nth),
again AS (SELECT *, (row_number() OVER (PARTITION BY prefix ORDER BY chosen) - 1) // 2 AS nth FROM first_pairs WHERE chosen = rejected),
pairs AS (SELECT chosen, rejected, turn AS split FROM first_pairs WHERE chosen <> rejected
    UNION ALL SELECT * FROM (SELECT min(chosen) AS chosen, max(chosen) AS rejected, turn FROM again GROUP BY prefix, turn, nth) WHERE chosen <> rejected),
alone AS (SELECT * FROM t WHERE conv NOT IN (SELECT chosen FROM pairs UNION ALL SELECT rejected FROM pairs)),
ends AS (SELECT conv, min(turn) AS first_turn, max(turn) FILTER (role = 'assistant') AS branch FROM alone GROUP BY conv),
answers AS (SELECT conv, turn, max(text) AS text, sha256(max(text)) AS answer FROM alone JOIN ends USING (conv) WHERE role = 'assistant' AND turn = branch GROUP BY conv, turn),
distinct_answers AS (SELECT answer, min(conv) AS conv FROM answers GROUP BY answer),
dealing AS (SELECT count(*) AS digits FROM range(16) r(k) WHERE (SELECT count(*) FROM distinct_answers) >= 5000 * power(16, k)),
ring AS (SELECT answer, conv, coalesce(lead(conv) OVER w, first(conv) OVER w) AS rejected FROM distinct_answers, dealing
    WINDOW w AS (PARTITION BY substr(answer, 1, digits::BIGINT) ORDER BY answer)),
branched AS (SELECT ends.conv, branch, ring.rejected FROM ends JOIN answers USING (conv) JOIN ring USING (answer) WHERE first_turn < branch AND ring.conv <> ring.rejected),
parts AS (SELECT chosen, rejected, 'prefix' AS pairing, CASE WHEN turn <= split THEN 'prompt' ELSE 'chosen' END AS part, turn, role, text FROM pairs JOIN t ON conv = chosen
    UNION ALL SELECT chosen, rejected, 'prefix', 'rejected', turn, role, text FROM pairs JOIN t ON conv = rejected WHERE turn > split
    UNION ALL SELECT conv, rejected, CASE WHEN branch IS NULL THEN 'none' ELSE 'branch' END, CASE WHEN branch IS NULL OR turn < branch THEN 'prompt' ELSE 'chosen' END, turn, role, text FROM alone LEFT JOIN branched USING (conv)
    UNION ALL SELECT branched.conv, rejected, 'branch', 'rejected', turn, 'assistant', text FROM branched JOIN answers ON answers.conv = branched.rejected)
SELECT nullif(chosen, -9223372036854775808) AS chosen_id, nullif(rejected, -9223372036854775808) AS rejected_id, pairing, part, nullif(turn, 9223372036854775807) AS turn, role,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
    CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END::BIGINT AS trained_from,
    CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 + length(text) + 8 ELSE 0 END::BIGINT AS trained_to
FROM parts""",
    "op4_secret_scan": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_places_sql()}),
ends AS (SELECT doc_id, rank, kind, least, generate_subscripts(m, 1) AS i, m, v, p FROM found WHERE len(m) > 0),
places AS (SELECT doc_id, rank, kind, length(v[i]) >= least AS fits, length(m[i]) AS size,
    list_sum([length(x) for x in p[1:i]]) + list_sum([length(x) for x in m[1:i]]) AS stop FROM ends),
kept AS (SELECT doc_id, rank, stop - size AS start, kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS span FROM places WHERE fits),
rolled AS (SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN rolled USING (doc_id)""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS part, {_leaf('n_chars')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS ix FROM d),
low AS (SELECT part, 0 AS height, ix, count(*) OVER (PARTITION BY part) AS n, leaf AS h FROM leaves
    UNION ALL SELECT part, height + 1, ix // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY ix)) FROM low WHERE n > 1 GROUP BY part, height, ix // 2, n),
subroots AS (SELECT part, h, row_number() OVER (ORDER BY part) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (SELECT 0 AS height, place AS ix, n, h FROM subroots
    UNION ALL SELECT height + 1, ix // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY ix)) FROM top WHERE n > 1 GROUP BY height, ix // 2, n),
walk AS (SELECT doc_id, part, ix AS id, leaf, 0 AS height, ix, other AS acc, '' AS proof FROM leaves
    UNION ALL SELECT doc_id, w.part, id, leaf, w.height + 1, w.ix // 2, sha256(CASE WHEN w.ix % 2 = 0 THEN acc || coalesce(s.h, '') ELSE s.h || acc END), proof || coalesce(s.h, '')
        FROM walk w JOIN low o ON o.part = w.part AND o.height = w.height AND o.ix = w.ix AND o.n > 1 LEFT JOIN low s ON s.part = w.part AND s.height = w.height AND s.ix = xor(w.ix, 1)),
ended AS (SELECT w.*, s.h AS subroot, s.place FROM walk w JOIN low o ON o.part = w.part AND o.height = w.height AND o.ix = w.ix AND o.n = 1 JOIN subroots s ON s.part = w.part),
climb AS (SELECT doc_id, part, id, leaf, subroot, 0 AS height, place AS ix, acc, proof FROM ended
    UNION ALL SELECT doc_id, part, id, leaf, subroot, c.height + 1, c.ix // 2, sha256(CASE WHEN c.ix % 2 = 0 THEN acc || coalesce(s.h, '') ELSE s.h || acc END), proof || coalesce(s.h, '')
        FROM climb c JOIN top o ON o.height = c.height AND o.ix = c.ix AND o.n > 1 LEFT JOIN top s ON s.height = c.height AND s.ix = xor(c.ix, 1))
SELECT doc_id, leaf, subroot, o.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = o.h AS verified
FROM climb c JOIN top o ON o.height = c.height AND o.ix = c.ix AND o.n = 1""",
    "op13_conversation_trie": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS said FROM t GROUP BY conv_id),
shared AS (SELECT conv_id, said, {_crc32('conv_id::VARCHAR')} % 9 AS h FROM own),
built AS (SELECT c.conv_id, list_concat(coalesce(b.said, [])[1:c.h], c.said[c.h + 1:]) AS said FROM shared c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
paths AS (SELECT conv_id, said, unnest(range(0, len(said) + 1)) AS depth FROM built),
nodes AS (SELECT said[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(said) = depth), '')) AS ends_sha256 FROM paths GROUP BY 1, 2),
below AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sized AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(node[depth].text) END AS saved FROM nodes LEFT JOIN below USING (node)),
spread AS (SELECT node[1:k] AS node, n_children = 0 AS leaf, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM sized)),
sums AS (SELECT node, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM spread GROUP BY node)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, s.ends_sha256
FROM sized s JOIN sums USING (node) LEFT JOIN nodes p ON s.depth > 0 AND p.depth = s.depth - 1 AND p.node = s.node[1:s.depth - 1]""",
    "op7_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM items),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
grams AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram FROM spots),
found AS (SELECT doc_id, i, size, item_id FROM grams JOIN windows USING (size, gram)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""".replace("\\\\", "\\"),
}

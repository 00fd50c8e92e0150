"""The corpus operators' registered queries, each over its whole table, and the DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, language, licenses, merkle, minhash, neighbours, packing, quality, scoring, sharding, substring, suffix
from ._util import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_sharding": op2_sharding,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": op4_decontamination,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_licenses": op6_licenses,
    "op7_neighbours": op7_neighbours,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
    "op11_collocations": op11_collocations,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


def _field(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(n_chars if f == 'n_chars' else f) for f in merkle.FIELDS)})"


#: The unsigned checksum of a decimal number's text, bit by bit, the lowest first.
_CRC_OF_ID = """xor(list_reduce(list_concat([4294967295], list_transform(range(8 * len(CAST(doc_id AS VARCHAR))), lambda i: (ascii(substr(CAST(doc_id AS VARCHAR), 1 + i // 8, 1)) >> (i % 8)) & 1)),
    lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""
_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(licenses.TEMPLATES.items()))
_NEEDED = ", ".join("('{}', [{}]::VARCHAR[])".format(name, ", ".join(f"'{p}'" for p in licenses.needed_bigrams(name, text))) for name, text in sorted(licenses.TEMPLATES.items()))
_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        chunks AS (SELECT doc_id, c, substr(h, 2 * c + 1, 698) AS h, least(n - c, 349) AS n FROM (SELECT *, unnest(range(0, n, 300)) AS c FROM d)),
        windows AS (SELECT doc_id, c + i AS i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, c, h, unnest(range(0, n - 49)) AS i FROM chunks WHERE n >= 50)),
        earliest AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
        hit AS (SELECT doc_id, i FROM windows JOIN earliest USING (w) WHERE first < doc_id),
        spans AS (
            SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
                SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
                    SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit))
            GROUP BY doc_id, g),
        ends AS (
            SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p
            FROM (SELECT * FROM spans UNION ALL SELECT doc_id, n, n + 1 FROM d)),
        kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) AS body FROM ends JOIN d USING (doc_id) GROUP BY doc_id),
        removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(body)) AS kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)""",
    "op5_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_words("text", _SPACED)} AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN {_PAIRS} ELSE w END AS s FROM d),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM items a JOIN items b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT x, y FROM common WHERE 100 * c >= 80 * (na + nb - c)),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r)
        SELECT doc_id, len(s) AS n_shingles, component_id, component_id = doc_id AS kept
        FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)""",
    "op6_licenses": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        lines AS (SELECT r, unnest(string_split(text, chr(10))) AS unit FROM d),
        blocks AS (SELECT r, unnest(string_split_regex(text, '\\n([\\x20\\x09\\x0B-\\x0D]*\\n)+')) AS unit FROM d),
        spans AS (
            SELECT r, unit FROM lines WHERE regexp_matches(unit, '{_SPACED}')
            UNION ALL
            SELECT r, unit FROM blocks
            WHERE len(list_filter(string_split(unit, chr(10)), lambda x: regexp_matches(x, '{_SPACED}'))) > 1),
        unit_sets AS (
            SELECT row_number() OVER () AS u, r, {_PAIRS} AS own
            FROM (SELECT r, {_words("unit", _ALNUM)} AS w FROM spans) WHERE len(w) > 1),
        templates AS (
            SELECT name, {_PAIRS} AS theirs
            FROM (SELECT name, {_words("text", _ALNUM)} AS w FROM (VALUES {_TEMPLATES}) AS t(name, text))),
        needed AS (SELECT * FROM (VALUES {_NEEDED}) AS t(name, needed)),
        common AS (
            SELECT u, name, count(*) AS n
            FROM (SELECT u, unnest(own) AS b FROM unit_sets) JOIN (SELECT name, unnest(theirs) AS b FROM templates) USING (b)
            GROUP BY u, name),
        matches AS (
            SELECT u, r, name, dice FROM (
                SELECT u, r, name, dice, row_number() OVER (PARTITION BY u ORDER BY dice DESC, name) AS k
                FROM (SELECT u, r, name, CAST(2 * n AS DOUBLE) / (len(own) + len(theirs)) AS dice
                      FROM common JOIN unit_sets USING (u) JOIN templates USING (name) JOIN needed USING (name) WHERE list_has_all(own, needed))
                WHERE dice >= {licenses.THRESHOLD}) WHERE k = 1),
        best AS (
            SELECT r, count(*) AS n_matches, arg_max(split_part(name, '/', 1), dice) AS license_id, max(dice) AS dice,
                array_to_string(list_sort(list_distinct(list(split_part(name, '/', 1)))), ',') AS licenses
            FROM (SELECT * FROM matches ORDER BY name) GROUP BY r),
        counted AS (SELECT r, count(*) AS n FROM spans GROUP BY r)
        SELECT doc_id, coalesce(n, 0) AS n_units, coalesce(n_matches, 0) AS n_matches, license_id, dice,
            coalesce(licenses, '') AS licenses
        FROM d LEFT JOIN counted USING (r) LEFT JOIN best USING (r)""",
    "op4_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", _ALNUM)} AS w FROM documents),
        b AS (SELECT item_id, {_words("text", _ALNUM)} AS w FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM item_windows),
        doc_windows AS (
            SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        found AS (SELECT r, i, n, item_id FROM doc_windows JOIN item_windows USING (n, t)),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
        items AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op11_collocations": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
        sizes AS (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS k),
        grams AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, sizes WHERE len(w) >= k)),
        f AS (SELECT lang, k, g, count(*) AS c FROM grams GROUP BY lang, k, g),
        n AS (SELECT lang, sum(c)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
        candidates AS (SELECT * FROM f WHERE k > 1 AND c >= {collocations.LEAST}),
        inside AS (
            SELECT DISTINCT s.lang, s.g FROM candidates s JOIN candidates t ON s.lang = t.lang AND s.k < t.k AND 100 * t.c >= 100 * s.c
            WHERE len(list_filter(range(1, t.k - s.k + 2), lambda i: t.g[i : i + s.k - 1] = s.g)) > 0),
        cuts AS (SELECT lang, k, g, c, unnest(range(1, k)) AS j FROM candidates ANTI JOIN inside USING (lang, g)),
        scored AS (
            SELECT cuts.lang, cuts.g, cuts.c AS a, x.c AS l, y.c AS r, n, j, (1000 * cuts.c::HUGEINT * n) // (x.c::HUGEINT * y.c) AS score
            FROM cuts JOIN n USING (lang) JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1 : j] JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[j + 1 : cuts.k]),
        worst AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS p, array_to_string(g, ' ') AS phrase FROM scored)
        SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst WHERE p = 1) WHERE rank <= {collocations.MOST}""",
    "op12_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
        windows AS (SELECT r, doc_id, i, array_to_string(w[i : i + {substring.WINDOW - 1}], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - {substring.WINDOW - 2})) AS i FROM d WHERE len(w) >= {substring.WINDOW} AND doc_id IS NOT NULL)),
        earliest AS (SELECT t, min(doc_id) AS first FROM windows GROUP BY t),
        gone AS (SELECT r, list(DISTINCT p) AS p FROM (SELECT r, unnest(range(i, i + {substring.WINDOW})) AS p FROM windows JOIN earliest USING (t) WHERE first < doc_id) GROUP BY r),
        words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS body FROM words ANTI JOIN (SELECT r, unnest(p) AS p FROM gone) USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf, presented
            FROM (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC_OF_ID} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS presented FROM documents)),
        nodes(tree, level, i, node, n) AS (
            SELECT tree, 0, i, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
            UNION ALL
            SELECT tree, level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2),
        subroots AS (SELECT tree, level AS height, node AS subroot FROM nodes WHERE n = 1),
        tops(level, i, node, n) AS (
            SELECT 0, tree, subroot, count(*) OVER () FROM subroots
            UNION ALL
            SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2),
        root AS (SELECT level AS top_height, node AS root FROM tops WHERE n = 1),
        own AS (SELECT * FROM leaves JOIN subroots USING (tree), root),
        steps AS (
            SELECT o.tree, o.i, o.level AS step, node AS beside, (o.i >> o.level) % 2 = 0 AS goes_right
            FROM (SELECT *, unnest(range(height)) AS level FROM own) o LEFT JOIN nodes s ON s.tree = o.tree AND s.level = o.level AND s.i = xor(o.i >> o.level, 1)
            UNION ALL
            SELECT o.tree, o.i, height + o.level, node, (o.tree >> o.level) % 2 = 0
            FROM (SELECT *, unnest(range(top_height)) AS level FROM own) o LEFT JOIN tops s ON s.level = o.level AND s.i = xor(o.tree >> o.level, 1)),
        proofs AS (SELECT tree, i, string_agg(beside, '' ORDER BY step) AS proof FROM steps GROUP BY tree, i),
        folded(tree, i, step, node) AS (
            SELECT tree, i, 0, presented FROM own
            UNION ALL
            SELECT tree, i, step + 1, sha256(CASE WHEN beside IS NULL THEN f.node WHEN goes_right THEN f.node || beside ELSE beside || f.node END) FROM folded f JOIN steps USING (tree, i, step))
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
        FROM own LEFT JOIN proofs USING (tree, i) JOIN folded f ON f.tree = own.tree AND f.i = own.i AND f.step = height + top_height""",
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

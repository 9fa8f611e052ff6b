"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

from . import jaccard_join, prefix_trie, quality_rules, vector_near

_WORD = r"[^\x20\x09-\x0D]+"


def _count(text: str, chars: str) -> str:
    return f"length(regexp_replace({text}, '[^{chars}]', '', 'g'))"


def _windows(table: str, words: str, keys: str) -> str:
    """The number of words in windows of three that come twice or more, by key."""
    return (
        f"SELECT {keys}, count(DISTINCT p) AS inside FROM (SELECT {keys}, unnest([i, i + 1, i + 2]) AS p FROM (SELECT {keys}, i, count(*) OVER (PARTITION BY {keys}, {words}[i], {words}[i + 1], {words}[i + 2]) AS c "
        f"FROM (SELECT {keys}, {words}, unnest(range(1, len({words}) - 1)) AS i FROM {table})) WHERE c > 1) GROUP BY {keys}"
    )


def quality_rules_sql() -> str:
    q = quality_rules
    phrases = "|".join(q.BOILERPLATE)
    long = f"n >= {q.SHORT_LINE}"
    failed = " OR ".join(
        [
            f"({long} AND stops = 0)", f"({long} AND 2 * shout > n)", f"({long} AND uppers > 3 * lowers AND uppers > 3 * n)", "10 * marks > 3 * n", "(5 * bars > n AND bars >= 2)", f"({long} AND 10 * stutter > 3 * n)",
            f"({long} AND 2 * coalesce(inside, 0) > n)", f"regexp_matches(line, '(?i){phrases}')",
        ]
    )
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents), "
        f"r AS ({_windows('d', 'w', 'doc_id')}), "
        "l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d), "
        f"l1 AS (SELECT *, regexp_extract_all(line, '{_WORD}') AS v, len(regexp_extract_all(line, '{_WORD}')) AS n FROM l0), "
        f"lr AS ({_windows('l1', 'v', 'doc_id, k')}), "
        f"l2 AS (SELECT l1.*, inside, row_number() OVER (PARTITION BY l1.doc_id, line ORDER BY l1.k) AS nth, {_count('line', '!')} AS shout, {_count('line', '|<>')} AS bars, {_count('line', '#*$%&|<>')} AS marks, "
        f"{_count('line', '.!?:;')} + {_count('line', chr(0x2000) + '-' + chr(0x3FFF))} AS stops, {_count('line', 'A-Z')} AS uppers, {_count('line', 'a-z')} AS lowers, len(list_filter(range(2, n + 1), lambda j: v[j] = v[j - 1])) AS stutter "
        "FROM l1 LEFT JOIN lr ON lr.doc_id = l1.doc_id AND lr.k = l1.k), "
        f"l3 AS (SELECT *, n > 0 AND ({failed}) AS failed FROM l2), "
        "l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n > 0 AND nth > 1) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(n) FILTER (failed), 0) AS lost_words FROM l3 GROUP BY doc_id), "
        f"b AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_count('t', '#*$%&|<>')} AS n_symbols, n_dup_lines, coalesce(inside, 0) AS n_repeat_words, n_lines, n_failed_lines, CAST(lost_words AS BIGINT) AS lost_words "
        "FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id) "
        f"SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= {q.MOST_LOST} * n_words AS kept FROM b"
    )


def jaccard_join_sql() -> str:
    """All pairs by their common runs of words; components by following links."""
    n, threshold = jaccard_join.WORDS, jaccard_join.THRESHOLD
    return (
        r"WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents), "
        f"k AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [chr(1) || t] END)) AS h FROM d), "
        "s AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id), "
        "p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k AS a JOIN k AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id), "
        f"l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN s AS x ON x.doc_id = a JOIN s AS y ON y.doc_id = b WHERE c >= {threshold}e0 * (x.n + y.n - c) - 1e-9), "
        "e AS (SELECT a, b, same FROM l UNION ALL SELECT b, a, same FROM l), "
        "f AS (SELECT doc_id, least(doc_id, coalesce(min(b) FILTER (same), doc_id)) AS first FROM d LEFT JOIN e ON a = doc_id GROUP BY doc_id), "
        "r(doc_id, x) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.x = e.a), "
        "c AS (SELECT doc_id, min(x) AS class_id FROM r GROUP BY doc_id), "
        "n AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS twins, count(DISTINCT CASE WHEN NOT same THEN f.first END) AS n_similar FROM e JOIN f ON f.doc_id = b GROUP BY a) "
        "SELECT c.doc_id, class_id, coalesce(n_links, 0) AS n_links, 1 + coalesce(twins, 0) AS n_copies, coalesce(n_similar, 0) AS n_similar FROM c LEFT JOIN n ON n.doc_id = c.doc_id"
    )


def vector_near_sql() -> str:
    """All pairs of a label by their cosine; components by following links."""
    return (
        "WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings), "
        "g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0), "
        f"l AS (SELECT a.k AS a, b.k AS b FROM g AS a JOIN g AS b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {vector_near.THRESHOLD}e0), "
        "r(k, x) AS (SELECT k, k FROM v UNION SELECT r.k, l.b FROM r JOIN l ON r.x = l.a), "
        "c AS (SELECT r.k, min(v.vec_id) AS component_id FROM r JOIN v ON v.k = r.x GROUP BY r.k), n AS (SELECT a AS k, count(*) AS n_links FROM l GROUP BY a) "
        "SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c ON c.k = v.k LEFT JOIN n ON n.k = v.k"
    )


def prefix_trie_sql() -> str:
    """Prefixes by the MD5 of their turns' MD5s; subtrees by the path of each node's smallest member."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    crc = f"list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)), lambda y, z: list_reduce(list_prepend(xor(y, z), CAST(range(8) AS BIGINT[])), lambda x, k: {step}), CAST(4294967295 AS BIGINT))"
    return (
        "WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS i FROM t), "
        f"c AS (SELECT conv_id AS c, xor({crc}, 4294967295) % {prefix_trie.MOST_TAKEN} AS h FROM (SELECT DISTINCT conv_id FROM t)), "
        f"b AS (SELECT c, i AS d, r, x FROM c JOIN o ON o.conv_id = c - c % {prefix_trie.FAMILY} AND i <= h), nb AS (SELECT c, count(*) AS n FROM b GROUP BY c), "
        "a AS (SELECT * FROM b UNION ALL SELECT c.c, i - h + coalesce(n, 0), r, x FROM c JOIN o ON o.conv_id = c.c AND i > h LEFT JOIN nb ON nb.c = c.c), "
        f"q AS (SELECT c, d, len(regexp_extract_all(x, '{_WORD}')) AS w, md5(string_agg(md5(concat(md5(r), x)), '') OVER (PARTITION BY c ORDER BY d)) AS key, d = max(d) OVER (PARTITION BY c) AS last FROM a), "
        "p AS (SELECT c, d, w, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), 'root') AS up, last FROM q UNION ALL SELECT c.c, 0, 0, 'root', NULL, NOT EXISTS (SELECT 1 FROM a WHERE a.c = c.c) FROM c), "
        "n AS (SELECT key, min(c) AS conv_id, min(d) AS depth, min(up) AS up, min(w) AS w, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY key), "
        "k AS (SELECT up AS key, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up), "
        "s AS (SELECT p.key, count(*) FILTER (k.n IS NULL) AS leaves, sum((n.n_convs - 1) * n.w) AS saved FROM n LEFT JOIN k ON k.key = n.key JOIN p ON p.c = n.conv_id AND p.d <= n.depth GROUP BY p.key) "
        "SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256 "
        "FROM n LEFT JOIN n AS m ON m.key = n.up LEFT JOIN k ON k.key = n.key JOIN s ON s.key = n.key"
    )

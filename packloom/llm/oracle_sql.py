"""The results of operators as DuckDB SQL, by plain comparison of all words, windows and turns."""
from __future__ import annotations

_TABLE = """crc AS MATERIALIZED (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab)"""


def _crc32(text: str) -> str:
    """CRC-32 of a UTF-8 text, with ``crc.tab`` in scope."""
    raw = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({raw}), 2), lambda i: CAST('0x' || substr({raw}, CAST(i AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c // 256, crc.tab[xor(c, b) % 256 + 1])), 4294967295)"


_REPEATS = r"""
WITH texts AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS MATERIALIZED (
    SELECT r, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS seq
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM texts WHERE len(ws) >= 35)),
gone AS MATERIALIZED (
    SELECT DISTINCT r, p FROM (
        SELECT r, unnest(range(i, i + 35)) AS p FROM windows
        WHERE seq IN (SELECT seq FROM windows GROUP BY seq HAVING count(*) > 1))),
places AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM texts),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS words FROM places ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""

_SPELLING = f"""
WITH RECURSIVE {_TABLE},
runs AS MATERIALIZED (
    SELECT run, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents), crc),
vocabulary AS MATERIALIZED (
    SELECT word, count(*) AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM runs)
    WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cuts AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS MATERIALIZED (
    SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b USING (i, head, tail) WHERE a.word <> b.word
    UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocabulary v ON v.word = c.head || c.tail
    UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocabulary v ON v.word = c.head || c.tail),
formed AS MATERIALIZED (
    SELECT v.word, v.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.top >= 10 * v.n THEN x.form END AS form,
        CASE WHEN x.top >= 10 * v.n THEN x.top END AS form_n
    FROM vocabulary v LEFT JOIN (
        SELECT word, count(*) AS n_near, max(n) AS top, first(other ORDER BY n DESC, encode(other)) AS form FROM near GROUP BY word) x USING (word)),
followed AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT f.word, g.form FROM followed f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL)
SELECT formed.word, form, root, n, n_near, form_n
FROM formed JOIN followed ON followed.word = formed.word
WHERE root IN (SELECT word FROM formed WHERE form IS NULL)
"""

_TRIE = rf"""
WITH {_TABLE},
own AS (
    SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c, t, c - c % 20 AS base, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h FROM own, crc),
rebuilt AS (
    SELECT heads.c, list_concat(coalesce(list_slice(b.t, 1, h), []), list_slice(heads.t, h + 1, len(heads.t))) AS s
    FROM heads LEFT JOIN own b ON b.c = heads.base),
prefixes AS MATERIALIZED (
    SELECT c, d, list_slice(s, 1, d) AS k, d = len(s) AS ending FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
    SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ending) AS ends,
        CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) END AS own
    FROM prefixes GROUP BY k, d),
paths AS MATERIALIZED (SELECT prefixes.c, prefixes.d, nodes.conv_id FROM prefixes JOIN nodes USING (k, d)),
children AS (
    SELECT p.conv_id, p.d, count(*) AS n FROM nodes v JOIN paths p ON p.c = v.conv_id AND p.d = v.d - 1 GROUP BY p.conv_id, p.d),
sums AS (
    SELECT p.conv_id, p.d, count(*) FILTER (x.n IS NULL) AS n_leaves, sum(v.own) AS saved
    FROM nodes v JOIN paths p ON p.c = v.conv_id AND p.d <= v.d LEFT JOIN children x ON x.conv_id = v.conv_id AND x.d = v.d
    GROUP BY p.conv_id, p.d)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(x.n, 0) AS n_children, s.n_leaves,
    CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN sums s ON s.conv_id = v.conv_id AND s.d = v.d
LEFT JOIN paths p ON p.c = v.conv_id AND p.d = v.d - 1 LEFT JOIN children x ON x.conv_id = v.conv_id AND x.d = v.d
"""

ORACLE_SQL: dict[str, str] = {
    "op11_substring_dedup": _REPEATS,
    "op12_spelling_variants": _SPELLING,
    "op13_turn_trie": _TRIE,
}

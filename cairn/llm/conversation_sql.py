"""SQL for the operators on conversations."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an expression of ASCII characters, bit by bit."""
    step = "list_reduce(range(8), lambda y, j: xor(y >> 1, 3988292384 * (y & 1)), xor(x, CAST(b AS BIGINT)))"
    return f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda c: ord(c)), lambda x, b: {step}, CAST(4294967295 AS BIGINT)))"


OP11 = f"""
    WITH own AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ),
    c AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)),
    rebuilt AS (
        SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
        UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN own o ON o.conv_id = c.conv_id AND pos > h
    ),
    placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, sha256(length(role) || ':' || role || text) AS t, length(text) AS chars FROM rebuilt),
    paths AS (
        SELECT conv_id, d, chars, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY d) AS path,
            coalesce(string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS above
        FROM placed UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c
    ),
    nodes AS (SELECT path, any_value(above) AS above, any_value(d) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY path),
    kids AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
    below AS (
        SELECT p.path, sum((n.n_convs - 1) * n.chars) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
        FROM nodes n LEFT JOIN kids k USING (path) JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.path
    ),
    ends AS (
        SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
        FROM (SELECT conv_id, arg_max(path, d) AS path FROM paths GROUP BY conv_id) GROUP BY path
    )
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
        CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
        sha256(coalesce(ids, '')) AS ends_sha256
    FROM nodes n LEFT JOIN nodes u ON u.path = n.above LEFT JOIN kids k ON k.path = n.path JOIN below b ON b.path = n.path LEFT JOIN ends e ON e.path = n.path
"""


def _label(state: int, cost: str, letter: str) -> str:
    return f"{{'c': e[{state + 1}].c + {cost}, 'a': e[{state + 1}].a || '{letter}'}}"


def _least(*labels: str) -> str:
    return f"list_min([{', '.join(labels)}])"


#: Labels of the four states (cost, audit) after one more insertion at the most.
_INSERT = f"[e[1], e[2], {_least('e[3]', *[_label(q, '3', 'I') for q in (0, 1, 3)])}, {_least('e[4]', _label(2, '3', 'I'))}]"


def _bind(value: str, body: str) -> str:
    return f"list_transform([{value}], lambda e: {body})[1]"


def _row_step() -> str:
    """Labels e before a row, x: its role's first letter r, whether it must go, and what it costs to stay -> labels after it."""
    keep = lambda q, r: _label(q, f"CASE WHEN x.r = '{r}' AND NOT x.go THEN x.more ELSE 1000000 END", "K")
    give = lambda q: _label(q, "CASE WHEN x.go THEN 1000000 ELSE x.more + 3 END", "R")
    gone = lambda q: _label(q, "4", "D")
    user = [f(q) for q in (0, 1, 3) for f in (lambda q: keep(q, "u"), give)]
    return f"[{gone(0)}, {_least(gone(1), keep(0, 's'))}, {_least(gone(2), *user)}, {_least(gone(3), keep(2, 'a'), give(2))}]"


_INSERTS = _bind(_INSERT, _INSERT)
_SOLVE = f"""list_reduce(list_transform(rows, lambda r: {{'r': left(r.role, 1), 'go': r.fault IN ('blank', 'duplicate'), 'more': CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END}}),
    lambda e, x: {_bind(_INSERTS, _row_step())}, [{{'c': 0, 'a': ''}}, {{'c': 1000000, 'a': ''}}, {{'c': 1000000, 'a': ''}}, {{'c': 1000000, 'a': ''}}])"""

_GIVEN = "CASE WHEN s.q = 2 THEN 'assistant' ELSE 'user' END"
_AFTER = "CASE WHEN s.q = 2 THEN 3 ELSE 2 END"
_REPLAY = f"""list_reduce(CASE WHEN best.a = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(best.a, '') END, lambda s, x: CASE x
    WHEN 'D' THEN {{'q': s.q, 'i': s.i + 1, 'out': s.out}}
    WHEN 'I' THEN {{'q': {_AFTER}, 'i': s.i, 'out': list_append(s.out, {_GIVEN} || ':')}}
    WHEN 'R' THEN {{'q': {_AFTER}, 'i': s.i + 1, 'out': list_append(s.out, {_GIVEN} || ':' || rows[s.i + 1].text)}}
    ELSE {{'q': CASE left(rows[s.i + 1].role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'i': s.i + 1,
        'out': list_append(s.out, rows[s.i + 1].role || ':' || rows[s.i + 1].text)}} END,
    {{'q': 0, 'i': 0, 'out': CAST([] AS VARCHAR[])}}).out"""

OP13 = rf"""
    WITH hashed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations
    ),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM hashed WHERE kind != 0
    ),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM damaged),
    judged AS (
        SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
    ),
    convs AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            list({{'role': role, 'text': text, 'fault': fault}} ORDER BY turn NULLS FIRST, role, text, copy) AS rows
        FROM judged GROUP BY conv_id
    ),
    solved AS (
        SELECT * EXCLUDE (labels), {_bind(f"list_transform([labels], lambda e: {_INSERTS})[1]", _least("e[1]", "e[4]"))} AS best,
            len(list_filter(range(1, len(rows)), lambda i: left(rows[i].role, 1) || left(rows[i + 1].role, 1) NOT IN ('su', 'ua', 'au'))) AS illegal
        FROM (SELECT *, {_SOLVE} AS labels FROM convs)
    )
    SELECT i.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
        CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit,
        sha256(coalesce(array_to_string({_REPLAY}, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
"""

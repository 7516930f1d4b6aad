"""SQL (DuckDB) for the queries whose whole result SQL can express, written from what the results are and not from how the operators find them."""

from __future__ import annotations

from . import collocations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM, _SOLID = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

#: Every window of an item is looked for among all windows of its length of all documents.
DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[j : j + least(10, len(w)) - 1], ' ') AS key FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM i WHERE len(w) > 0)),
spots AS (SELECT rid, j, m, array_to_string(w[j : j + m - 1], ' ') AS key FROM (SELECT d.*, m, unnest(range(1, len(w) - m + 2)) AS j FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
found AS (SELECT rid, j, m, item_id FROM spots JOIN windows USING (m, key)),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(j, j + m)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

#: All pairs that share a shingle, their similarity, and what can be reached by links.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_SOLID}') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[j : j + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id, d.doc_id = min(o.doc_id) AS kept
FROM d JOIN reach ON reach.a = d.rid JOIN d o ON o.rid = reach.b LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id
"""


def _conversations() -> str:
    """A row of a signature is its role's initial and its fault; costs and audits of the four states are folded over the rows from the last to the first."""
    states, following = "zsua", {"z": "u", "s": "u", "u": "a", "a": "u"}
    kept = {("z", "s"): "s", ("z", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    never = "{'c': 1000000000, 'p': ''}"

    def pay(cost: str, letter: str, to: str) -> str:
        return f"{{'c': ({cost} + acc.{to}.c)::BIGINT, 'p': '{letter}' || acc.{to}.p}}"

    def options(q: str) -> str:
        keeps = [(role, to) for (a, role), to in kept.items() if a == q]
        can = f"x[2] IN ('n', 't')"
        more = "CASE x[2] WHEN 't' THEN 3 ELSE 0 END"
        keep = "CASE " + " ".join(f"WHEN {can} AND x[1] = '{role}' THEN {pay(more, 'K', to)}" for role, to in keeps) + f" ELSE {never} END"
        return f"list_min([{pay('4', 'D', q)}, {keep}, CASE WHEN {can} THEN {pay(f'3 + {more}', 'R', following[q])} ELSE {never} END])"

    def settled(base: str) -> str:
        """Inserted rows before a row: one or two in a row, more never pay."""
        one = lambda q: f"{{'c': (3 + {base}.{following[q]}.c)::BIGINT, 'p': 'I' || {base}.{following[q]}.p}}"
        two = lambda q: f"{{'c': (6 + {base}.{following[following[q]]}.c)::BIGINT, 'p': 'II' || {base}.{following[following[q]]}.p}}"
        return "{" + ", ".join(f"'{q}': list_min([{base}.{q}, {one(q)}, {two(q)}])" for q in states) + "}"

    end = "{'z': {'c': 0::BIGINT, 'p': ''}, 's': {'c': 6::BIGINT, 'p': 'II'}, 'u': {'c': 3::BIGINT, 'p': 'I'}, 'a': {'c': 0::BIGINT, 'p': ''}}"
    step = "{" + ", ".join(f"'{q}': {options(q)}" for q in states) + "}"
    fold = f"list_reduce(rows, lambda acc, x: list_transform([{step}], lambda b: {settled('b')})[1], {end})"
    crc = "list_reduce(list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), 4294967295)"
    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
keys AS (SELECT DISTINCT k, xor({crc}, 4294967295) % 20 AS h FROM t),
r AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS twice FROM t JOIN keys USING (k) WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(rtrim(text, e' \t\n\x0b\x0c\r'), 1) AS last FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r)),
f AS (SELECT *, left(role, 1) AS first, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE 'n' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (i > 1 AND before || first NOT IN ('su', 'ua', 'au')) AS illegal, list([first, fault] ORDER BY i DESC) AS rows FROM f GROUP BY conv_id),
solved AS (SELECT rows, {fold}.z AS best FROM (SELECT DISTINCT rows FROM g)),
a AS (SELECT g.*, best.c AS cost, best.p AS audit FROM g JOIN solved USING (rows)),
edits AS (SELECT conv_id, e, pos, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS pos FROM a WHERE audit <> '')),
left_over AS (SELECT conv_id, e, role, CASE WHEN e = 'I' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY edits.conv_id ORDER BY pos) AS nth FROM edits LEFT JOIN f USING (conv_id, i) WHERE e <> 'D'),
headed AS (SELECT *, max(CASE WHEN nth = 1 AND e = 'K' AND role LIKE 's%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM left_over),
text AS (SELECT conv_id, string_agg((CASE WHEN e = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, e'\n' ORDER BY nth) AS whole FROM headed GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = {"op8_benchmark_decontamination": DECONTAMINATION, "op10_minhash": NEAR_DUPLICATES, "op11_conversation_repair": _conversations(), "op13_collocations": collocations.SQL}

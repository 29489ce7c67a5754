"""SQL for DuckDB of the queries of this subpackage that SQL can express."""

WORDS = r"list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '')"

SQL = {
    "op3_quality_rules": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, COUNT(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(3)) AS k) GROUP BY 1),
lin AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') AS l FROM d),
m AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
CAST(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS caps, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d JOIN lin USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, coalesce(chars, 0) AS word_chars, CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(100 * n_symbols > 25 * n_words AS INT) + 8 * CAST(n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines AS INT)
+ 16 * CAST(coalesce(chars, 0) < 3 * n_words AS INT) + 32 * CAST(coalesce(chars, 0) > 12 * n_words AS INT) + 64 * CAST(100 * caps > 40 * coalesce(chars, 0) AS INT) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits FROM b""",
    "op2_chat_format": """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')) + length(role) + 24 AS n FROM c)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(n) AS BIGINT) AS formatted_chars FROM l GROUP BY conv_id""",
    "op10_mixing": f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT) AS weight, 3 * source_size AS cap FROM s),
k AS (SELECT *, row_number() OVER o AS k, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remain FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST)),
v AS (SELECT *, CAST(total - before AS DOUBLE) / CAST(remain AS DOUBLE) AS level FROM k),
t AS (SELECT *, least(CAST(cap AS DOUBLE), weight * coalesce((SELECT arg_min(level, k) FROM v WHERE level * weight <= CAST(cap AS DOUBLE)), 0)) AS target FROM v),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix-1'), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM r""",
}

FILTER_AUDIT = f"""WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, doc_id, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) AS INT)
+ 8 * CAST(length(translate(t, '#$%&*|', '')) < length(t) AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d),
c AS (SELECT part, mask, COUNT(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(range(5)) AS i),
p AS (SELECT [a.i, b.i, x.i, y.i, z.i] AS o FROM f a, f b, f x, f y, f z WHERE len(list_distinct([a.i, b.i, x.i, y.i, z.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', CAST(i + 1 AS INT), 1)), '') AS filter_order, CAST(unnest(range(1, 6)) AS INT) AS step, o FROM p),
b AS (SELECT filter_order, step, CAST(pow(2, o[step]) AS INT) AS bit, CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda i: pow(2, i))), 0) AS INT) AS before FROM s),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost FROM c, b GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""


def _step(x: str, cost: str, letter: str, out: str | None) -> str:
    """A state's best (cost in 8 digits, then edits; rows given), with one more edit."""
    rows = f"list_append({x}.o, {out})" if out else f"{x}.o"
    return f"CASE WHEN {x} IS NOT NULL THEN {{'k': lpad(CAST(CAST(left({x}.k, 8) AS INT) + {cost} AS VARCHAR), 8, '0') || substr({x}.k, 9) || '{letter}', 'o': {rows}}} END"


def _if(when: str, then: str) -> str:
    return f"CASE WHEN {when} THEN {then} END"


def _best(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


_KEEP, _NEW = "role || ':' || t", {"u": "'user:' || t", "a": "'assistant:' || t"}
_USER = [_if(f"NOT gone AND i1 = 'u' AND {s} IS NOT NULL", _step(s, "cut", "K", _KEEP)) for s in ("s0", "s1", "s3")] + [_if("NOT gone", _step(s, "3 + cut", "R", _NEW["u"])) for s in ("s0", "s1", "s3")]
CONVERSATION_REPAIR = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM conversations),
h AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, crc.t[CAST((xor(c, x) & 255) + 1 AS INT)])), 4294967295) % 20 AS h FROM raw, crc),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(t, '.!?', '') ELSE t END AS t, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(role || chr(0) || t), copy) AS pos, regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g') AS body, left(role, 1) AS i1 FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, t ORDER BY pos) > 1 AS again, lag(i1) OVER (PARTITION BY conv_id ORDER BY pos) || i1 AS pair FROM q),
r AS (SELECT *, body = '' OR again AS gone, CASE WHEN body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS cut FROM g),
n AS (SELECT conv_id, COUNT(*) AS n, coalesce(max(turn) - min(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (body = '') AS blank, COUNT(*) FILTER (body <> '' AND again) AS duplicate, COUNT(*) FILTER (cut = 3) AS truncated, COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'k': '00000000', 'o': CAST([] AS VARCHAR[])}} AS s0, CAST(NULL AS STRUCT(k VARCHAR, o VARCHAR[])) AS s1, {{'k': '00000003I', 'o': ['user:']}} AS s2, {{'k': '00000006II', 'o': ['user:', 'assistant:']}} AS s3 FROM n
UNION ALL SELECT conv_id, pos, p0, p1, s2, {_best("p3", _step("s2", "3", "I", "'assistant:'"))} AS s3 FROM (SELECT *, {_best("p2", _step("p0", "3", "I", "'user:'"), _step("p1", "3", "I", "'user:'"), _step("p3", "3", "I", "'user:'"))} AS s2 FROM (
SELECT r.conv_id, r.pos, {_step("s0", "4", "D", None)} AS p0, {_best(_step("s1", "4", "D", None), _if("NOT gone AND i1 = 's'", _step("s0", "cut", "K", _KEEP)))} AS p1,
{_best(_step("s2", "4", "D", None), *_USER)} AS p2, {_best(_step("s3", "4", "D", None), _if("NOT gone AND i1 = 'a'", _step("s2", "cut", "K", _KEEP)), _if("NOT gone", _step("s2", "3 + cut", "R", _NEW["a"])))} AS p3
FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos + 1))),
e AS (SELECT dp.conv_id, {_best("s0", "s3")} AS x FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.pos),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(left(x.k, 8), '0') AS BIGINT) AS cost, coalesce(substr(x.k, 9), '') AS audit,
sha256(coalesce(array_to_string(x.o, chr(10)), '')) AS repaired_sha256 FROM c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""

SQL |= {"op11_filter_audit": FILTER_AUDIT, "op13_conversation_repair": CONVERSATION_REPAIR}


def _ablations() -> str:
    """Counts by policy and rule, from the bits of the rules' SQL."""
    from walkloom.llm.quality_rules import POLICIES, mask

    bits = SQL["op3_quality_rules"].rpartition("SELECT doc_id, n_words")[0]
    cells = [f"SELECT '{p}' AS policy, '{r}' AS rule, COUNT(*) FILTER (bits & {mask(rules)} = 0) AS kept, COUNT(*) FILTER (bits & {mask(rules) & ~mask([r])} = 0) AS kept_without, CAST(bit_or(bits & {mask(rules)}) AS BIGINT) AS bits_seen, CAST(bit_and(bits & {mask(rules)}) AS BIGINT) AS bits_in_all FROM b" for p, rules in POLICIES.items() for r in rules]
    return bits + " UNION ALL ".join(cells)


SQL["quality_rule_ablations"] = _ablations()

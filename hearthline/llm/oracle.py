"""The same results in SQL for a second engine, where SQL can state them."""

from __future__ import annotations

from hearthline.llm.common import LOWER, UPPER
from hearthline.llm.queries import RULES
from hearthline.llm.warc import BASE32

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _base32(hexed: str) -> str:
    digits = []
    for part in range(8):
        bits = f"CAST('0x' || substr({hexed}, {5 * part + 1}, 5) AS BIGINT)"
        digits += [f"substr('{BASE32}', CAST(({bits} >> {s}) & 31 AS BIGINT) + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(digits)


HAMMING = """
WITH codes AS (
  SELECT vec_id, CAST(list_sum(list_transform(range(0, len(embedding)),
    lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END)) AS UBIGINT) AS code
  FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance
  FROM codes q, codes c WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance
FROM pairs QUALIFY rank <= 10
"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, {_base32("x")} AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g
  FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM k WHERE 100 * k >= 80 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM reach JOIN edges ON a = id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(root) AS component_id FROM s JOIN reach ON id = s.doc_id GROUP BY ALL
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
keys AS (SELECT DISTINCT item_id, l, array_to_string(w[p : p + l - 1], ' ') AS g FROM i),
sizes AS (SELECT DISTINCT l FROM keys),
spots AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, sizes WHERE len(w) >= l),
hits AS (SELECT doc_id, item_id, p, spots.l FROM spots JOIN keys ON spots.l = keys.l AND array_to_string(w[p : p + spots.l - 1], ' ') = g),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(CAST(len(ids) AS BIGINT), 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _rule(pick: int) -> str:
    cases = []
    for says, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        shown = (h + p, says)[pick]
        cases.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{shown}'")
    return f"CASE {' '.join(cases)} END"


def _settled(x: str) -> str:
    return f"floor({x} * 1e6 + CAST(0.4137 AS DOUBLE)) / 1e6"


def _strength(source: str, prior: str) -> str:
    apart = f"(k - n * {prior})"
    over = f"sum({apart} * {apart} - n * {prior} * (1 - {prior}))"
    pairs = f"sum(n * (n - 1) * {prior} * (1 - {prior}))"
    rho = _settled(f"greatest(CAST(0.001 AS DOUBLE), least(CAST(0.999 AS DOUBLE), coalesce({over} / nullif({pairs}, 0), CAST(0.5 AS DOUBLE))))")
    return f"(SELECT (1 - rho) / rho AS s FROM (SELECT {rho} AS rho FROM {source}))"


REPUTATION = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
hosts AS (
  SELECT host, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
    CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN '' ELSE string_split(host, '.')[-1] END AS suffix,
    count(quality) AS n, coalesce(CAST(sum(CASE WHEN quality > 0 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS BIGINT), 0) AS k
  FROM p LEFT JOIN labels ON page_id = doc_id GROUP BY host),
a AS (SELECT (coalesce(sum(k), 0) + CAST(1 AS DOUBLE)) / (coalesce(sum(n), 0) + CAST(2 AS DOUBLE)) AS overall FROM hosts),
s0 AS (SELECT suffix, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k, any_value(overall) AS m FROM hosts, a GROUP BY suffix),
s1 AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM s0, {_strength("s0", "m")}),
d0 AS (SELECT domain, suffix, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k, any_value(m) AS m FROM hosts JOIN s1 USING (suffix) GROUP BY ALL),
d1 AS (SELECT domain, suffix, (k + s * m) / (n + s) AS m FROM d0, {_strength("d0", "m")}),
h0 AS (SELECT host, n, k, m FROM hosts JOIN d1 USING (domain, suffix)),
h1 AS (SELECT host, n, k, k + s * m AS a, n - k + s * (1 - m) AS b FROM h0, {_strength("h0", "m")}),
h2 AS (SELECT host, n, k, {_settled("least(CAST(1 AS DOUBLE), a / (a + b) + CAST(1.645 AS DOUBLE) * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))")} AS bound FROM h1)
SELECT page_id, host, path, {_rule(0)} AS rule, coalesce({_rule(1)}, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  n AS labelled, k AS good, bound
FROM p JOIN h2 USING (host)
"""


# crc32 by its table, which is made by the rule of the polynomial.
CRC_TABLE = """
SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
"""


def _crc32(text: str) -> str:
    """crc32 of a text's UTF-8 bytes; t is the table of CRC_TABLE, in a column of the same row."""
    byte = f"CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)"
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: {byte})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"


def _edit(costs: str, letter: str, line: str, then: str) -> str:
    """What an edit adds in front of the cheapest edits that follow."""
    return f"{{'c': {then}.c + {costs}, 'a': '{letter}' || {then}.a, 'o': {line} || {then}.o}}"


def _by_state() -> str:
    """For each state the cheapest edits from a turn on: first without insertions before it, then with them."""
    leads = (("s1", "s2", None), (None, "s2", None), (None, None, "s3"), (None, "s2", None))
    nexts = (("user", "s2"), ("user", "s2"), ("assistant", "s3"), ("user", "s2"))
    far = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}"
    plain, full = [], []
    for state in range(4):
        options = [_edit("4", "D", "''", f"s{state}")]
        for initial, then in zip("sua", leads[state]):
            if then:
                kept = _edit("more", "K", "chr(10) || role || ':' || text", then)
                options.append(f"CASE WHEN p = '{initial}' AND NOT bad THEN {kept} ELSE {far} END")
        role, then = nexts[state]
        rerole = _edit("more + 3", "R", f"chr(10) || '{role}:' || text", then)
        options.append(f"CASE WHEN NOT bad THEN {rerole} ELSE {far} END")
        plain.append(f"list_min([{', '.join(options)}]) AS b{state}")
        turn = lambda who, what: _edit("3", "I", f"chr(10) || '{who}:'", what)
        if state == 2:
            full.append(f"list_min([b2, {turn('assistant', 'b3')}]) AS s2")
        elif state == 3:
            full.append(f"list_min([b3, {turn('user', 'b2')}]) AS s3")
        else:
            full.append(f"list_min([b{state}, {turn('user', 'b2')}, {turn('user', '(' + turn('assistant', 'b3') + ')')}]) AS s{state}")
    return f"SELECT conv_id, pos, {', '.join(full)} FROM (SELECT conv_id, pos, {', '.join(plain)} FROM step)"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

TURN_REPAIR = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
m AS (SELECT conv_id, turn, role, text, {_crc32("name")} % 20 AS code FROM d, crc),
x AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
  CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM m WHERE code <> 0),
r AS (SELECT *, substr(role, 1, 1) AS p, rtrim(text, {_BLANKS}) AS body,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM x),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
  WHEN substr(body, -1, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(p) OVER (PARTITION BY conv_id ORDER BY pos) || p AS pair FROM r),
turns AS (SELECT conv_id, pos, role, text, p, fault IN ('blank', 'duplicate') AS bad,
  CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM f),
dp AS (
  SELECT conv_id, max(pos) + 1 AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS s0,
    {{'c': CAST(6 AS BIGINT), 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s1,
    {{'c': CAST(3 AS BIGINT), 'a': 'I', 'o': chr(10) || 'assistant:'}} AS s2, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS s3
  FROM turns GROUP BY conv_id
  UNION ALL
  (WITH step AS (SELECT t.*, s0, s1, s2, s3 FROM dp JOIN turns t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.pos = dp.pos - 1)
  {_by_state()})),
best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit, sha256(substr(s0.o, 2)) AS repaired FROM dp WHERE pos = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(CAST(gaps AS BIGINT), 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
"""

RESAMPLING = f"""
WITH crc AS ({CRC_TABLE}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
dw AS (SELECT row, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
words AS (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN words USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN words USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM s) AS ss, (SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM t) AS ts),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (ss + 10000) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (ts + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), sums),
sizes AS (SELECT row, sum(gain) AS total FROM dw JOIN words USING (w) JOIN gains USING (bucket) GROUP BY row),
scored AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(floor(CAST(total AS DOUBLE) / len(w)), 0) AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS noise
  FROM d LEFT JOIN sizes USING (row)),
placed AS (SELECT *, n_features >= 20 AS may, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, row) AS place FROM scored)
SELECT doc_id, n_features, weight, weight + noise AS score,
  CASE WHEN may AND place <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
FROM placed
"""


def sql() -> dict[str, str]:
    return {
        "op1_hamming_topk": HAMMING,
        "op2_warc_archive": WARC,
        "op4_jaccard_join": JACCARD,
        "op8_url_reputation": REPUTATION,
        "op9_decontamination": DECONTAMINATION,
        "op11_turn_repair": TURN_REPAIR,
        "op12_importance_resampling": RESAMPLING,
    }

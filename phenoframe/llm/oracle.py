"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from phenoframe.llm import mixing, quality, sharding

WORD = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def draw(key: str, salt: str) -> str:
    """Uniform number in (0, 1) from a text key and a salt."""
    return f"((('0x' || substr(md5({key} || '{salt}'), 1, {sharding.DRAW_DIGITS}))::BIGINT + 0.5::DOUBLE) / {sharding.DRAW_RANGE:.0f}::DOUBLE)"


KEY = "coalesce(doc_id::VARCHAR, '')"


def op8() -> str:
    m = mixing
    shares = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {c})::DOUBLE, {m.FLATTEN}) AS {c}_raw" for c in m.MARGINALS)
    steps, last = [], "start"
    for i in range(m.SWEEPS):
        for c in m.MARGINALS:
            steps.append(f"s{i}_{c} AS (SELECT * REPLACE (weight * {c}_share * total / sum(weight) OVER (PARTITION BY {c}) AS weight) FROM {last})")
            last = f"s{i}_{c}"
    totals = ", ".join(f"{c}_raw / (SELECT sum(x) FROM (SELECT DISTINCT {c}, {c}_raw AS x FROM raw)) AS {c}_share" for c in m.MARGINALS)
    factors = ["k0 AS (SELECT 0.0::DOUBLE AS k)"]
    for i in range(m.FACTOR_ROUNDS):
        factors.append(f"k{i + 1} AS (SELECT CASE WHEN coalesce(sum(weight) FILTER (WHERE weight * k < tokens), 0) = 0 THEN max(k) ELSE "
                       f"greatest(0.0, {m.KEEP} * sum(tokens) - coalesce(sum(tokens) FILTER (WHERE weight * k >= tokens), 0))"
                       f" / sum(weight) FILTER (WHERE weight * k < tokens) END AS k FROM fitted, k{i})")
    return f"""
WITH texts AS (SELECT doc_id, coalesce(source, '{m.NONE}') AS source, coalesce(lang, '{m.NONE}') AS lang, coalesce(text, '') AS t FROM documents),
measured AS (
    SELECT doc_id, source, lang, length(t) AS n, length(t) - length(translate(t, '{m.DIGITS}', '')) AS digits,
        length(t) - length(replace(t, chr(10), '')) + 1 AS lines, len(regexp_extract_all(t, '{WORD}')) + 1 AS tokens FROM texts),
rows AS MATERIALIZED (
    SELECT doc_id, source, lang, tokens::BIGINT AS tokens,
        CASE WHEN n = 0 THEN 'empty' WHEN digits * 50 >= n THEN 'figures' WHEN lines * 80 >= n THEN 'list' WHEN n >= 4000 THEN 'long' ELSE 'short' END AS topic
    FROM measured),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL),
raw AS MATERIALIZED (SELECT *, sum(tokens) OVER () AS total, {shares} FROM cells),
start AS (SELECT source, lang, topic, tokens, tokens AS weight, total, {totals} FROM raw),
{', '.join(steps)},
fitted AS MATERIALIZED (SELECT source, lang, topic, tokens, weight FROM {last}),
{', '.join(factors)}
SELECT doc_id, source, lang, topic, rows.tokens AS tokens, round(least(1.0, weight * k / fitted.tokens), 6) AS probability,
    {draw(KEY, m.DRAW_SALT)} < least(1.0, weight * k / fitted.tokens) AS kept
FROM rows JOIN fitted USING (source, lang, topic), k{m.FACTOR_ROUNDS}"""


def crc_table() -> list[int]:
    """Checksums of single bytes under the reflected polynomial of CRC-32."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def crc32(hex_text: str, n: str) -> str:
    """Checksum of ``n`` bytes given in hex digits."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range({n}), lambda i: ('0x' || substr({hex_text}, 2 * i + 1, 2))::BIGINT)), "
            f"lambda c, b: xor(c >> 8, {crc_table()}[xor(c & 255, b) + 1])), 4294967295::BIGINT)")


def crc32_of_id(id_: str) -> str:
    return crc32(f"hex(encode({id_}::VARCHAR))", f"length({id_}::VARCHAR)")


def op11() -> str:
    return f"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM texts),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, least(doc_id, coalesce(b, doc_id)) = doc_id AS kept
FROM sets LEFT JOIN least ON a = doc_id"""


def op12() -> str:
    # The root's parent is NULL; readers of the two results then see doubles in either.
    shared = f"({crc32_of_id('conv')} % 9)"
    return f"""
WITH said AS (SELECT conv_id AS conv, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sized AS (SELECT *, {shared} AS h FROM said),
rebuilt AS MATERIALIZED (SELECT c.conv, list_concat(coalesce(b.own, [])[:c.h], c.own[c.h + 1:]) AS chain FROM sized c LEFT JOIN said b ON b.conv = c.conv - c.conv % 5),
paths AS (SELECT conv, chain, unnest(range(len(chain) + 1)) AS depth FROM rebuilt),
members AS MATERIALIZED (SELECT depth, chain[:depth] AS key, conv, len(chain) = depth AS ends FROM paths),
nodes AS MATERIALIZED (
    SELECT depth, key, min(conv) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE ends), '')) AS ends_sha256
    FROM members GROUP BY depth, key),
children AS (SELECT depth - 1 AS depth, key[:depth - 1] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
linked AS MATERIALIZED (SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.key[n.depth].text) END AS own_saved
    FROM nodes n LEFT JOIN children c USING (depth, key)),
upward AS (SELECT n_children = 0 AS leaf, own_saved, key AS chain, unnest(range(depth + 1)) AS depth FROM linked),
totals AS (SELECT depth, chain[:depth] AS key, sum(leaf::BIGINT) AS n_leaves, sum(own_saved) AS saved_tokens FROM upward GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id::DOUBLE AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves,
    t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM linked n JOIN totals t USING (depth, key) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[:n.depth - 1]"""


def op13() -> str:
    def field(x: str) -> str:
        return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def levels(name: str, start: str) -> str:
        return f"""{name}(tree, level, place, n, digest) AS ({start}
    UNION ALL
    SELECT tree, level + 1, place // 8, max((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY tree, level, place // 8),
{name}_runs AS MATERIALIZED (SELECT tree, level, place // 8 AS run, list(digest ORDER BY place) AS ds FROM {name} WHERE n > 1 GROUP BY ALL)"""

    def climb(name: str, of: str, start: str) -> str:
        others = "array_to_string(ds[:{p}], '') || {x} || array_to_string(ds[{p} + 2:], '')"
        p = "(c.place % 8)"
        return f"""{name}(row, tree, level, place, folded, path) AS ({start}
    UNION ALL
    SELECT c.row, c.tree, c.level + 1, c.place // 8, sha256({others.format(p=p, x='c.folded')}), c.path || {others.format(p=p, x="''")}
    FROM {name} c JOIN {of}_runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.place // 8),
{name}_end AS MATERIALIZED (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY row ORDER BY level DESC) = 1)"""

    return f"""
WITH RECURSIVE leafs AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf,
        CASE WHEN {crc32_of_id('doc_id')} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS told FROM documents),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, told) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leafs),
{levels('nodes', "SELECT tree, 0, place, n, leaf FROM ranked")},
subroots AS MATERIALIZED (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
{levels('tops', "SELECT '', 0, place, n, digest FROM subroots")},
{climb('inside', 'nodes', "SELECT row, tree, 0, place, told, '' FROM ranked")},
{climb('outside', 'tops', "SELECT row, '', 0, s.place, folded, path FROM inside_end e JOIN subroots s USING (tree)")}
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified
FROM ranked JOIN outside_end USING (row) JOIN subroots s ON s.tree = ranked.tree, (SELECT digest FROM tops WHERE n = 1) t"""


def op5() -> str:
    def shard(n: int) -> str:
        # Equal weights: the smallest -ln(u) is the largest u.
        return f"list_position(us[:{n}], list_max(us[:{n}])) - 1"

    n = sharding.N_SHARDS
    us = ", ".join(draw(KEY, f":{i}") for i in range(n + 1))
    return f"""
WITH bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
    SELECT doc_id, n + 1 AS size, {crc32('h', 'n')} AS text_crc32 FROM bytes),
dealt AS (SELECT *, [{us}] AS us FROM crc),
placed AS (SELECT doc_id, size, text_crc32, ({shard(n)})::INTEGER AS shard, ({shard(n + 1)})::INTEGER AS grown_shard FROM dealt)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY md5({KEY}), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM placed"""


def op1() -> str:
    q = quality
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    symbols = quoted(q.SYMBOLS)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w, string_split(t, chr(10)) AS lines FROM texts),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS x,
    unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM repeated, range(3) AS s(j) GROUP BY doc_id),
worded AS (SELECT *, list_filter(lines, lambda x: trim(x, {blanks}) <> '') AS lw FROM split),
judged AS (
    SELECT *, list_transform(lines, lambda x: trim(x, {blanks}) <> '' AND (
        NOT regexp_matches(right(rtrim(x, {blanks}), 6), {quoted(q.CLOSING)})
        OR (length(x) - length(translate(x, {quoted(q.NOISE)}, ''))) * 10 >= length(x)
        OR (length(x) - length(translate(x, {quoted(q.SEPARATORS)}, '')) >= 2
            AND (length(x) - length(translate(x, {quoted(q.SEPARATORS)}, ''))) * 30 >= length(x))
        OR (length(x) <= {q.STOCK_LINE_CHARS} AND regexp_matches(lower(x), {quoted(q.STOCK)})))) AS bad
    FROM worded),
counted AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, {symbols}, '')))::BIGINT AS n_symbols, (len(lw) - len(list_distinct(lw)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_filter(bad, lambda x: x))::BIGINT AS n_lines_removed,
        length(translate(array_to_string(list_filter(lines, lambda x, i: bad[i]), ''), {blanks}, ''))::BIGINT AS chars_removed,
        array_to_string(list_filter(lines, lambda x, i: NOT bad[i]), chr(10)) AS cleaned
    FROM judged LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 100 * chars_removed <= {q.MAX_LOSS_PERCENT} * word_chars AS kept, n_lines_removed, chars_removed, sha256(cleaned) AS cleaned_sha256
FROM based"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": op1(), "op5_sharding": op5(), "op8_source_mixing": op8(), "op11_bayes_minhash": op11(),
            "op12_conversation_trie": op12(), "op13_merkle_manifest": op13()}

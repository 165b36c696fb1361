"""SQL with the results of those queries that SQL can express, for checking only."""

from __future__ import annotations

from shelfmark.llm.common import ALNUM_WORD, BLANK_WORD, UPPER
from shelfmark.llm.quality_rules import RULES, STEPS_BITS
from shelfmark.llm.secrets import BASE, MORE


def _lowered(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{UPPER.lower()}')"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


DECONTAMINATION = f"""
    WITH item AS (
        SELECT item_id, regexp_extract_all({_lowered("text")}, '{ALNUM_WORD}') AS ws FROM benchmark),
    cut AS (
        SELECT item_id, ws, least(len(ws), 10) AS w, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS k
        FROM item WHERE len(ws) > 0),
    win AS (SELECT DISTINCT item_id, w, array_to_string(ws[k:k + w - 1], ' ') AS gram FROM cut),
    doc AS (
        SELECT doc_id, regexp_extract_all({_lowered("coalesce(text, '')")}, '{ALNUM_WORD}') AS ws FROM documents),
    place AS (
        SELECT doc_id, ws, w, unnest(generate_series(1, len(ws) - w + 1)) AS k
        FROM doc, (SELECT DISTINCT w FROM win) WHERE len(ws) >= w),
    hit AS (
        SELECT DISTINCT doc_id, k, p.w, item_id
        FROM place p JOIN win ON win.w = p.w AND win.gram = array_to_string(ws[k:k + p.w - 1], ' ')),
    inside AS (
        SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(range(w)) AS j FROM hit)
        GROUP BY doc_id),
    named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN inside USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _secrets() -> str:
    rules = (*BASE, *MORE)
    found = " UNION ALL ".join(
        f"""SELECT doc_id, '{rule.kind}' AS kind, {number} AS place, v, ms[k] AS m,
                   CAST(list_sum(list_transform(parts[1:k], lambda x: len(x)))
                        + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: len(x))), 0) AS BIGINT) AS start
            FROM (SELECT *, unnest(generate_series(1, len(ms))) AS k, unnest(vs) AS v FROM (
                SELECT doc_id, string_split_regex(text, {_text(rule.pattern)}) AS parts,
                       regexp_extract_all(text, {_text(rule.pattern)}, 0) AS ms,
                       regexp_extract_all(text, {_text(rule.pattern)}, {rule.group}) AS vs
                FROM doc WHERE regexp_matches(text, {_text(rule.pattern)})))
            WHERE len(v) >= {rule.least}"""
        for number, rule in enumerate(rules)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in BASE)
    shown = "string_agg(kind || ':' || start || ':' || (start + len(m)), ',' ORDER BY start, place)"
    zero = ", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in BASE)
    return f"""
        WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        found AS ({found}),
        told AS (
            SELECT doc_id, {counts}, {shown} FILTER (place < {len(BASE)}) AS base, {shown} AS spans
            FROM found GROUP BY doc_id)
        SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM doc LEFT JOIN told USING (doc_id)"""


def _quality() -> str:
    rates = {name: f"{rule.scale} * {rule.part} // greatest({rule.whole}, 1)" for name, rule in RULES.items()}
    values = " UNION ALL ".join(
        f"SELECT lang, source, '{name}' AS measure, {value} AS v FROM stat WHERE n_words > 0"
        + (f" AND {value} > 0" if RULES[name].present else "")
        for name, value in rates.items()
    )
    levels = " UNION ALL ".join(
        f"SELECT {level} AS level, {lang} AS lang, {source} AS source, measure, bucket, n FROM sketch"
        for level, lang, source in ((0, "lang", "source"), (1, "lang", "''"), (2, "''", "''"))
    )
    quantiles = ", ".join(f"min(bucket) FILTER (upto * 100 >= total * {q}) AS q{q}" for q in (25, 50, 75))
    limits, chosen, outside = [], [], []
    for name, rule in RULES.items():
        far = f"{rule.spreads} * greatest({rule.least}, least(q50 - q25, q75 - q50))"
        ends = {"most": f"q50 + {far}"} | ({"least": f"greatest(q50 - {far}, q50 // 4)"} if rule.lower else {})
        held = f"FILTER (measure = '{name}')"
        limits += [f"max(total) {held} AS n_{name}"] + [f"max({value}) {held} AS {end}_{name}" for end, value in ends.items()]
        for end in ends:
            nearest = " ".join(f"WHEN {at}.n_{name} >= {rule.few} THEN {at}.{end}_{name}" for at in ("o", "l"))
            otherwise = "NULL" if rule.otherwise is None else rule.otherwise
            chosen.append(f"coalesce(CASE {nearest} ELSE a.{end}_{name} END, {otherwise}) AS {end}_{name}")
            outside.append(f"{rates[name]} {'>' if end == 'most' else '<'} {end}_{name}")
    limits, chosen, outside = ", ".join(limits), ", ".join(chosen), " OR ".join(outside)
    return f"""
        WITH doc AS (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{BLANK_WORD}')) AS lines
            FROM documents),
        place AS (
            SELECT doc_id, k, array_to_string(ws[k:k + 7], ' ') AS gram
            FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS k FROM doc WHERE len(ws) >= 8)),
        often AS (SELECT doc_id, k FROM place QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
        repeated AS (
            SELECT doc_id, count(DISTINCT k + j) AS n FROM (SELECT doc_id, k, unnest(range(8)) AS j FROM often)
            GROUP BY doc_id),
        stat AS (
            SELECT doc_id, lang, source, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
                   len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
                   len(lines) AS n_lines,
                   len(text) - len(regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g')) AS n_marks
            FROM doc LEFT JOIN repeated USING (doc_id)),
        sketch AS (
            SELECT lang, source, measure, count(*) AS n,
                   CASE WHEN v < {1 << STEPS_BITS} THEN v
                        ELSE (v >> (len(bin(v)) - {STEPS_BITS})) << (len(bin(v)) - {STEPS_BITS}) END AS bucket
            FROM ({values}) GROUP BY ALL),
        merged AS (SELECT level, lang, source, measure, bucket, sum(n) AS n FROM ({levels}) GROUP BY ALL),
        ranked AS (
            SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
                   sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM merged),
        quantile AS (
            SELECT level, lang, source, measure, total, {quantiles} FROM ranked GROUP BY ALL),
        cutoff AS (SELECT level, lang, source, {limits} FROM quantile GROUP BY ALL),
        chosen AS (
            SELECT o.lang, o.source, {chosen}
            FROM cutoff o LEFT JOIN cutoff l ON l.level = 1 AND l.lang = o.lang LEFT JOIN cutoff a ON a.level = 2
            WHERE o.level = 0),
        judged AS (
            SELECT s.*, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
                   coalesce({outside}, false) AS outside
            FROM stat s LEFT JOIN chosen c ON c.lang = s.lang AND c.source = s.source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT outside AS kept
        FROM judged"""


CHAT = r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    said AS (
        SELECT conv_id, count(*) AS n_turns,
               string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS everything,
               coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS learned,
               -- around each text: '### ', the role's name, ': ' and ' </turn>', line feed
               CAST(sum(4 + len(role) + 2 + len(regexp_replace(text, '(\\|</turn>|###)', '\\\1', 'g')) + 9) AS BIGINT)
                   AS formatted_chars,
               string_agg(role[1:1], '' ORDER BY turn, role, text) AS roles
        FROM turns GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(everything) AS turns_sha256, len(learned) AS loss_chars,
           sha256(learned) AS loss_sha256, formatted_chars, regexp_full_match(roles, 's?(ua)*u?') AS valid
    FROM said"""

# CRC-32 of a number written out, byte by byte and bit by bit.
_CRC = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
    lambda crc, c: list_reduce(
        list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, bit: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

PERIODIC = f"""
    WITH doc AS (
        SELECT doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '{BLANK_WORD}') AS ws FROM documents),
    part AS (
        SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM doc),
    tail AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM part),
    said AS (
        SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE
               list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws
        FROM tail),
    word AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM said),
    same AS (
        SELECT x.doc_id, x.i, y.i - x.i AS q
        FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
    stretch AS (
        SELECT doc_id, q, min(i) AS start, count(*) + q AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same)
        GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
    run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
    listed AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), ''
               ORDER BY start, period) AS runs FROM run GROUP BY doc_id),
    best AS (
        SELECT x.* FROM run x WHERE NOT EXISTS (
            SELECT 1 FROM run y WHERE y.doc_id = x.doc_id AND (
                y.length * x.period > x.length * y.period
                OR (y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period))))),
    kept AS (
        SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM word
        WHERE NOT EXISTS (
            SELECT 1 FROM run WHERE run.doc_id = word.doc_id AND i >= start + period AND i < start + length)
        GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
           sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM said LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLES = {
    "op1_decontamination": DECONTAMINATION,
    "op3_secret_scans": _secrets(),
    "op7_quality_rules": _quality(),
    "op9_chat_formatting": CHAT,
    "op11_periodic_runs": PERIODIC,
}
